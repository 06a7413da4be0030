"""A session's voices: enrolled windows, their trials, the gate and the registry, beside the same in plain SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.columns import dot, whole
from ..operators import precision, signals
from ..sources import tables as T
from .queries import query


def windows(spark: SparkSession, sf: str) -> DataFrame:
    """vec_id, name, v: embeddings whose first six components weigh eightfold, named after the largest of these; one in thirteen bears another's name."""
    e = T.table(spark, sf, "embeddings")
    head = F.slice("embedding", 1, 6)
    k = F.array_position(head, F.array_max(head)) + F.when(F.col("vec_id") % 13 == 0, 1).otherwise(0)
    return e.select("vec_id", F.concat(F.lit("p"), (k % 6).cast("string")).alias("name"), F.transform(whole(F.col("embedding")), lambda x, i: F.when(i < 6, x * 8).otherwise(x)).alias("v"))


_WINDOWS = """w0 AS (SELECT vec_id, embedding AS e, list_position(embedding[1:6], list_max(embedding[1:6])) + CASE WHEN vec_id % 13 = 0 THEN 1 ELSE 0 END AS k FROM embeddings),
w AS (SELECT vec_id, e, 'p' || CAST(k % 6 AS VARCHAR) AS name, CASE (row_number() OVER (PARTITION BY k % 6 ORDER BY vec_id) - 1) % 5 WHEN 0 THEN 'held_out' WHEN 1 THEN 'calibration' ELSE 'training' END AS part FROM w0),
u0 AS (SELECT vec_id, name, part, unnest(e) AS x, generate_subscripts(e, 1) AS i FROM w), u AS (SELECT vec_id, name, part, i, CAST(floor(CAST(x AS DOUBLE) * 64) AS BIGINT) * CASE WHEN i <= 6 THEN 8 ELSE 1 END AS v FROM u0),
c AS (SELECT name AS profile, i, CAST(sum(v) AS BIGINT) AS s FROM u WHERE part = 'training' GROUP BY ALL), cn AS (SELECT profile, CAST(CAST(sum(s * s) AS BIGINT) AS DOUBLE) AS cn FROM c GROUP BY ALL), vn AS (SELECT vec_id, CAST(CAST(sum(v * v) AS BIGINT) AS DOUBLE) AS vn FROM u GROUP BY ALL),
d AS (SELECT u.vec_id, name, part, profile, CAST(CAST(sum(v * s) AS BIGINT) AS DOUBLE) AS d FROM u JOIN c ON u.i = c.i WHERE part <> 'training' GROUP BY ALL), z AS (SELECT d.*, CASE WHEN vn * cn > 0 THEN d / sqrt(vn * cn) ELSE 0 END AS cos FROM d JOIN cn ON cn.profile = d.profile JOIN vn ON vn.vec_id = d.vec_id),
r AS (SELECT *, lead(cos) OVER o AS second, row_number() OVER o AS rn, max(cos) FILTER (profile = name) OVER (PARTITION BY vec_id) AS actual FROM z WINDOW o AS (PARTITION BY vec_id ORDER BY cos DESC, profile)),
t AS (SELECT vec_id, name, part, profile AS best, cos AS score, coalesce(second, -1) AS second, actual, profile = name AS hit, cos - coalesce(second, -1) AS lead FROM r WHERE rn = 1)"""

_GATE = _WINDOWS + """, th AS (SELECT greatest(CAST(0.5 AS DOUBLE), coalesce(max(score) FILTER (part = 'calibration' AND NOT hit), -1) + CAST(0.02 AS DOUBLE)) AS th FROM t),
n AS (SELECT name, count(*) FILTER (part = 'training') AS training, count(*) FILTER (part = 'calibration') AS calibration, count(*) FILTER (part = 'held_out') AS held_out FROM w GROUP BY name),
f AS (SELECT count(*) >= 2 AND bool_and(training >= 3 AND calibration >= 1 AND held_out >= 1) AS fine, CAST(sum(held_out) AS BIGINT) AS every FROM n),
b AS (SELECT best AS name, count(*) FILTER (hit) AS good, count(*) FILTER (NOT hit) AS bad FROM t, th WHERE part = 'held_out' AND score >= th AND lead >= CAST(0.12 AS DOUBLE) GROUP BY best),
g0 AS (SELECT n.*, fine, CASE WHEN fine THEN th END AS th, CASE WHEN fine THEN coalesce(good, 0) END AS accepted, CASE WHEN fine THEN coalesce(bad, 0) END AS false_accepts, CASE WHEN fine THEN every - held_out END AS impostors FROM n LEFT JOIN b ON b.name = n.name, th, f),
g1 AS (SELECT *, concat_ws(',', CASE WHEN accepted < 3 THEN 'insufficient_held_out_accepts' END, CASE WHEN false_accepts > 0 THEN 'held_out_false_accept' END, CASE WHEN impostors < 20 THEN 'insufficient_impostor_trials' END) AS reasons FROM g0),
g2 AS (SELECT *, fine AND reasons = '' AS eligible FROM g1),
g AS (SELECT *, CASE WHEN NOT bool_or(eligible) OVER () THEN 'insufficient_for_precision_calibration' WHEN bool_and(eligible) OVER () THEN 'precision_calibrated' ELSE 'partial_precision_calibrated' END AS status FROM g2)"""


def _parts(c: str):
    return F.floor(F.col(c) * 10_000).alias(c)


@query(f"""WITH {_WINDOWS} SELECT vec_id, name, part, best, hit, CAST(floor(score * 10000) AS BIGINT) AS score, CAST(floor(actual * 10000) AS BIGINT) AS actual, CAST(floor(lead * 10000) AS BIGINT) AS lead FROM t""")
def j10_trials(spark: SparkSession, sf: str) -> DataFrame:
    """Calibration and held-out windows against the profiles; cosines in ten-thousandths."""
    return precision.trials(windows(spark, sf), ["vec_id"]).select("vec_id", "name", "part", "best", "hit", _parts("score"), _parts("actual"), _parts("lead"))


@query(f"""WITH {_GATE} SELECT name, training, calibration, held_out, CAST(floor(th * 10000) AS BIGINT) AS threshold, accepted, false_accepts, impostors, reasons, eligible, status FROM g""")
def j10_precision_gate(spark: SparkSession, sf: str) -> DataFrame:
    """Which profiles may name voices, and why others may not."""
    g = precision.gate(windows(spark, sf), ["vec_id"])
    return g.withColumns({"threshold": _parts("threshold"), "reasons": F.concat_ws(",", "reasons")})


@query(f"""WITH {_GATE}, a AS (SELECT name, max(vec_id) - min(vec_id) AS span, bool_or(part = 'training') AS trained, count(*) FILTER (part = 'training') AS k, count(*) AS n FROM w GROUP BY name),
q AS (SELECT u.name, i, CAST(sum(v) AS BIGINT) AS s FROM u JOIN a ON a.name = u.name WHERE part = 'training' OR NOT trained GROUP BY ALL), l AS (SELECT name, sqrt(CAST(CAST(sum(s * s) AS BIGINT) AS DOUBLE)) AS l FROM q GROUP BY name)
SELECT q.name, CASE WHEN trained THEN k ELSE n END AS samples, span, eligible, status, CAST(i AS BIGINT) AS i, CAST(floor(s * 1000000 / l) AS BIGINT) AS x FROM q JOIN l ON l.name = q.name JOIN a ON a.name = q.name JOIN g ON g.name = q.name""")
def j12_session_registry(spark: SparkSession, sf: str) -> DataFrame:
    """Profiles of unit length, a row a component (millionths), with what the gate says of them."""
    r = precision.registry(windows(spark, sf), ["vec_id"], "vec_id").withColumn("l", F.sqrt(dot(F.col("sums"), F.col("sums")).cast("double")))
    return r.select("name", "samples", "span", "eligible", "status", "l", F.posexplode("sums").alias("i", "s")).select("name", "samples", "span", "eligible", "status", (F.col("i") + 1).cast("long").alias("i"), F.floor(F.col("s") * 1_000_000 / F.col("l")).alias("x"))


#: Samples a second, of a window and between windows; samples of a recording.
RATE, WIDTH, HOP, SIZE = 16_000, 64, 32, 4096


def sounds(spark: SparkSession, sf: str) -> DataFrame:
    """rec, i, x: events by number stand for samples."""
    e = T.table(spark, sf, "events")
    return e.select(F.floor(F.col("event_id") / SIZE).alias("rec"), (F.col("event_id") % SIZE).alias("i"), (F.col("value") - 20).alias("x"))


_EDGES = ", ".join(f"CAST({float(e)!r} AS DOUBLE)" for e in signals.edges(RATE))


@query(f"""WITH s AS (SELECT event_id // {SIZE} AS rec, event_id % {SIZE} AS i, value - 20 AS x FROM events WHERE value IS NOT NULL), w AS (SELECT rec, i, x, unnest(generate_series(greatest(0, i // {HOP} - {WIDTH // HOP - 1}), i // {HOP})) AS win FROM s),
f AS (SELECT rec, win, x, row_number() OVER o - 1 AS j, count(*) OVER (PARTITION BY rec, win) AS n, lag(x) OVER o AS p FROM w WINDOW o AS (PARTITION BY rec, win ORDER BY i)), g AS (SELECT *, x * (0.5 - 0.5 * cos(2 * pi() * j / (n - 1))) AS h FROM f WHERE n >= 32),
k AS (SELECT rec, win, n, j, h, unnest(generate_series(1, n // 2)) AS k FROM g), sp AS (SELECT rec, win, n, k, pow(sum(h * cos(2 * pi() * j * k / n)), 2) + pow(sum(h * sin(2 * pi() * j * k / n)), 2) AS power FROM k GROUP BY ALL),
ed AS (SELECT b - 1 AS b, e[b] AS low, e[b + 1] AS high FROM (SELECT unnest(generate_series(1, {signals.BANDS})) AS b, [{_EDGES}] AS e)),
bd AS (SELECT rec, win, b, ln(avg(power) + 1e-10) AS v FROM sp JOIN ed ON k * CAST({RATE} AS DOUBLE) / n >= low AND k * CAST({RATE} AS DOUBLE) / n < high GROUP BY ALL),
al AS (SELECT rec, win, ln(sqrt(avg(x * x) + 1e-12) + 1e-10) AS rms, count(*) FILTER ((x < 0) <> (p < 0)) / (max(n) - 1) AS turns FROM g GROUP BY ALL),
o AS (SELECT al.rec, al.win, ed.b, coalesce(v, -23) AS v FROM al CROSS JOIN ed LEFT JOIN bd ON bd.rec = al.rec AND bd.win = al.win AND bd.b = ed.b UNION ALL SELECT rec, win, {signals.BANDS}, rms FROM al UNION ALL SELECT rec, win, {signals.BANDS + 1}, turns FROM al)
SELECT rec, win AS "window", CAST(b AS BIGINT) AS feature, CAST(floor(v * 100 + 0.5) AS BIGINT) AS value FROM o""")
def j3_band_energies(spark: SparkSession, sf: str) -> DataFrame:
    """Band energies of overlapping windows, a row a feature, in hundredths."""
    w = signals.framed(sounds(spark, sf), ["rec"], WIDTH, HOP)
    e = signals.band_energies(w, RATE, 32 / RATE).where("features IS NOT NULL").select("rec", "window", F.posexplode("features").alias("feature", "v"))
    return e.select("rec", "window", F.col("feature").cast("long").alias("feature"), F.floor(F.col("v") * 100 + 0.5).alias("value"))
