"""Voice clusters named end to end from what is seen, beside the same in plain SQL: orders stand for turns, their lines for frames."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import clusters
from ..sources import tables as T
from .queries import query

#: Names seen with the eight voices of each recording, by place: the third changes, two have the same, the sixth has two.
SEEN_WITH = ("Ana", "Ben", "Cy", "Eve", "Eve", "Fay", "Gil", "Hal")


def turns(spark: SparkSession, sf: str) -> DataFrame:
    """rec, turn, speaker, start_ms, end_ms: a thousand orders a recording, eight seconds in every ten."""
    o = T.table(spark, sf, "orders")
    start = F.col("o_orderkey") % 1000 * 10_000
    return o.select(F.floor(F.col("o_orderkey") / 1000).alias("rec"), F.col("o_orderkey").alias("turn"), F.concat(F.lit("s"), (F.col("o_custkey") % 8).cast("string")).alias("speaker"), start.alias("start_ms"), (start + 8000).alias("end_ms"))


def frames(spark: SparkSession, sf: str) -> DataFrame:
    """rec, id, t, name, score: an order's lines, some between turns; one in forty shows someone else, and the eighth voice is seldom seen."""
    line = T.table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("turn"), F.col("l_linenumber").cast("long").alias("line"), (F.col("l_partkey") * 7919 + F.col("l_linenumber") * 1117).alias("h"), F.col("l_quantity").cast("long").alias("q"))
    r = line.join(turns(spark, sf), "turn")
    k = F.substring("speaker", 2, 1).cast("int")
    usual = F.element_at(F.array(*map(F.lit, SEEN_WITH)), k + 1)
    name = (F.when(F.col("h") % 40 == 0, "Ida").when((k == 7) & (F.col("turn") % 10 > 0), F.lit(None)).when((k == 2) & (F.col("turn") % 1000 >= 700), "Dee")
            .when((k == 5) & (F.col("turn") % 3 == 0), "Flo").when((k == 4) & (F.col("rec") % 2 == 0), "Eva").otherwise(usual))
    return r.select("rec", F.concat(F.lit("f"), "turn", F.lit("-"), "line").alias("id"), (F.col("start_ms") + F.col("h") % 10_000).alias("t"), name.alias("name"), (F.col("q") * 12).alias("score"))


_ROWS = """tu AS (SELECT o_orderkey // 1000 AS rec, o_orderkey AS turn, o_custkey % 8 AS k, 's' || (o_custkey % 8) AS speaker, o_orderkey % 1000 * 10000 AS a, o_orderkey % 1000 * 10000 + 8000 AS b FROM orders),
fr AS (SELECT rec, 'f' || turn || '-' || l_linenumber AS id, a + (l_partkey * 7919 + l_linenumber * 1117) % 10000 AS t, CASE WHEN (l_partkey * 7919 + l_linenumber * 1117) % 40 = 0 THEN 'Ida' WHEN k = 7 AND turn % 10 > 0 THEN NULL WHEN k = 2 AND turn % 1000 >= 700 THEN 'Dee'
 WHEN k = 5 AND turn % 3 = 0 THEN 'Flo' WHEN k = 4 AND rec % 2 = 0 THEN 'Eva' ELSE ['Ana', 'Ben', 'Cy', 'Eve', 'Eve', 'Fay', 'Gil', 'Hal'][k + 1] END AS name, CAST(l_quantity AS BIGINT) * 12 AS score FROM lineitem JOIN tu ON turn = l_orderkey)"""

_VOTES = _ROWS + """, al AS (SELECT f.rec, f.t, f.name, tu.turn, speaker, a, b FROM fr f ASOF JOIN tu ON f.rec = tu.rec AND f.t >= tu.a WHERE f.name IS NOT NULL),
ero AS (SELECT *, unnest([600, 800, 1000]) AS erosion FROM al), vn AS (SELECT rec, erosion, turn, speaker, (a + b) // 2 AS "time", name, count(*) AS k FROM ero WHERE t >= a + erosion AND t <= b - erosion GROUP BY ALL),
vr AS (SELECT *, sum(k) OVER (PARTITION BY rec, erosion, turn) AS n, row_number() OVER (PARTITION BY rec, erosion, turn ORDER BY k DESC, name) AS rn FROM vn),
vt AS (SELECT rec, erosion, turn, speaker, "time", name, CAST(n AS BIGINT) AS "of", k AS votes FROM vr WHERE rn = 1 AND n >= 2 AND k * 1000 >= n * 800)"""


def _passes(k: str, n: str, turns: int, share: int, bound: int) -> str:
    p, z = f"({k} / {n})", "CAST(1.96 AS DOUBLE)"
    low = f"({p} + {z} * {z} / (2 * {n}) - {z} * sqrt(({p} * (1 - {p}) + {z} * {z} / (4 * {n})) / {n})) / (1 + {z} * {z} / {n})"
    return f"coalesce({n} >= {turns} AND floor({p} * 1000 + 0.5) >= {share} AND floor({low} * 1000 + 0.5) >= {bound}, false)"


_PARTS = ("early", "late", "q0", "q1", "q2", "q3")
_CLUSTERS = _VOTES + f""", pi AS (SELECT *, row_number() OVER (PARTITION BY rec, speaker ORDER BY "time", turn) - 1 AS i, count(*) OVER (PARTITION BY rec, speaker) AS n FROM vt WHERE erosion = 800),
pp AS (SELECT *, i < ceil(n * CAST(0.6 AS DOUBLE)) AS early, NOT (i < ceil(n * CAST(0.6 AS DOUBLE))) AS late, {", ".join(f"i >= n * {q} // 4 AND i < n * {q + 1} // 4 AS q{q}" for q in range(4))} FROM pi),
tot AS (SELECT rec, speaker, count(*) AS n, {", ".join(f"count(*) FILTER ({c}) AS {c}_n" for c in _PARTS)} FROM pp GROUP BY ALL),
nm AS (SELECT rec, speaker, name, count(*) AS good, max("time") - min("time") AS span, {", ".join(f"count(*) FILTER ({c}) AS {c}" for c in _PARTS)} FROM pp GROUP BY ALL),
fw AS (SELECT rec, speaker, name FROM nm WHERE early > 0 QUALIFY row_number() OVER (PARTITION BY rec, speaker ORDER BY early DESC, name) = 1), rv AS (SELECT rec, speaker, name FROM nm WHERE late > 0 QUALIFY row_number() OVER (PARTITION BY rec, speaker ORDER BY late DESC, name) = 1),
ca AS (SELECT tot.*, fw.name AS candidate FROM tot LEFT JOIN fw ON fw.rec = tot.rec AND fw.speaker = tot.speaker AND EXISTS (SELECT 1 FROM rv WHERE rv.rec = tot.rec AND rv.speaker = tot.speaker AND rv.name = fw.name)),
cb AS (SELECT ca.*, coalesce(good, 0) AS good, span, {", ".join(_PARTS)} FROM ca LEFT JOIN nm ON nm.rec = ca.rec AND nm.speaker = ca.speaker AND nm.name = ca.candidate),
e0 AS (SELECT rec, speaker, erosion, name, count(*) AS k FROM vt GROUP BY ALL), ec AS (SELECT *, CAST(sum(k) OVER (PARTITION BY rec, speaker, erosion) AS BIGINT) AS n, row_number() OVER (PARTITION BY rec, speaker, erosion ORDER BY k DESC, name) AS rn FROM e0),
ok AS (SELECT cb.rec, cb.speaker, erosion FROM cb JOIN ec ON ec.rec = cb.rec AND ec.speaker = cb.speaker AND ec.name = candidate AND rn = 1 WHERE {_passes("k", "ec.n", 12, 900, 750)}),
wh AS (SELECT cb.*, [x FOR x IN [
 CASE WHEN candidate IS NULL OR NOT ({_passes("early", "early_n", 12, 900, 750)} AND {_passes("late", "late_n", 8, 850, 750)}) THEN 'early_to_late_validation_failed' END,
 CASE WHEN candidate IS NULL OR NOT ({_passes("late", "late_n", 12, 900, 750)} AND {_passes("early", "early_n", 8, 850, 750)}) THEN 'late_to_early_validation_failed' END,
 CASE WHEN candidate IS NULL THEN 'directional_candidates_disagree' END, CASE WHEN candidate IS NULL THEN 'no_candidate' END,
 CASE WHEN candidate IS NOT NULL AND NOT ({" AND ".join(_passes(f"q{q}", f"q{q}_n", 2, 850, 0) for q in range(4))}) THEN 'quartile_stability_failed' END, CASE WHEN span < 120000 THEN 'insufficient_time_span' END,
 {", ".join(f"CASE WHEN candidate IS NOT NULL AND NOT EXISTS (SELECT 1 FROM ok WHERE ok.rec = cb.rec AND ok.speaker = cb.speaker AND erosion = {e}) THEN 'erosion_{e}_unstable' END" for e in (600, 800, 1000))}] IF x IS NOT NULL] AS found FROM cb),
cl AS (SELECT rec, speaker, candidate, n AS turns, good, array_to_string(list_sort(CASE WHEN len(found) = 0 AND count(*) FILTER (len(found) = 0) OVER (PARTITION BY rec, candidate) > 1 THEN ['name_collision'] ELSE found END), ',') AS reasons FROM wh)"""


@query(f"""WITH {_VOTES} SELECT rec, erosion, turn, speaker, "time", name, "of", votes FROM vt""")
def e3_turn_votes(spark: SparkSession, sf: str) -> DataFrame:
    """What the frames inside each turn say, at three erosions."""
    return clusters.turn_votes(frames(spark, sf), turns(spark, sf))


@query(f"""WITH {_CLUSTERS} SELECT rec, speaker, candidate, turns, good, reasons, reasons = '' AS accepted FROM cl""")
def g12_cluster_names(spark: SparkSession, sf: str) -> DataFrame:
    """The name of each voice, or why it has none."""
    return _named(spark, sf).withColumn("reasons", F.concat_ws(",", "reasons"))


def _named(spark: SparkSession, sf: str) -> DataFrame:
    return clusters.named(clusters.turn_votes(frames(spark, sf), turns(spark, sf)))


def _applied(spark: SparkSession, sf: str) -> DataFrame:
    """Segments two seconds after the turns, a second shorter at every third: named by frames, or else by their voice."""
    s = turns(spark, sf).select("rec", F.col("turn").alias("ord"), "speaker", (F.col("start_ms") + 2000).alias("start_ms"), (F.col("end_ms") - F.col("turn") % 3 * 1000 - 4500).alias("end_ms"), F.array(F.concat(F.lit("e"), F.col("turn") % 5)).alias("refs"))
    fallback = _named(spark, sf).where("accepted").select("rec", "speaker", F.col("candidate").alias("name"))
    return clusters.applied(s, frames(spark, sf), fallback)


_APPLIED = _CLUSTERS + """, sg AS (SELECT rec, turn AS ord, speaker, a + 2000 AS a, b - turn % 3 * 1000 - 4500 AS b, 'e' || (turn % 5) AS ref FROM tu),
ev AS (SELECT s.rec, s.ord, f.name, f.id, f.score FROM sg s JOIN fr f ON f.rec = s.rec AND f.t >= s.a - 750 AND f.t <= s.b + 750 WHERE f.name IS NOT NULL), en AS (SELECT rec, ord, name, count(*) AS k, max(score) AS score FROM ev GROUP BY ALL),
er AS (SELECT *, CAST(sum(k) OVER (PARTITION BY rec, ord) AS BIGINT) AS n, row_number() OVER (PARTITION BY rec, ord ORDER BY k DESC, name) AS rn FROM en), es AS (SELECT * FROM er WHERE rn = 1 AND k * 1000 >= greatest(1000, n * 600)),
ei AS (SELECT rec, ord, list(id) AS ids FROM ev GROUP BY ALL),
ap AS (SELECT s.rec, s.ord, s.speaker, coalesce(es.name, cl.candidate) AS name, CASE WHEN es.name IS NOT NULL THEN 'visual_active_speaker_highlight' WHEN cl.candidate IS NOT NULL THEN 'visual_confirmed_cluster_fallback' ELSE 'needs_review_visual_or_voice_enrollment' END AS name_source,
 CAST(CASE WHEN es.name IS NOT NULL THEN least(750, 500 + es.score // 2) WHEN cl.candidate IS NOT NULL THEN 720 ELSE 0 END AS BIGINT) AS confidence, coalesce(es.n, 0) AS seen, CASE WHEN es.name IS NULL THEN ref ELSE array_to_string(list_sort(list_distinct(list_append(ids, ref)))[1:4], ',') END AS refs
 FROM sg s LEFT JOIN es ON es.rec = s.rec AND es.ord = s.ord LEFT JOIN ei ON ei.rec = s.rec AND ei.ord = s.ord LEFT JOIN cl ON cl.rec = s.rec AND cl.speaker = s.speaker AND cl.reasons = '')"""


@query(f"""WITH {_APPLIED} SELECT rec, ord, name, name_source, confidence, seen, refs FROM ap""")
def f15_visual_names(spark: SparkSession, sf: str) -> DataFrame:
    return _applied(spark, sf).select("rec", "ord", "name", "name_source", "confidence", "seen", F.concat_ws(",", "refs").alias("refs"))


@query(f"""WITH {_APPLIED}, k AS (SELECT unnest(CASE WHEN name IS NOT NULL AND confidence >= 600 THEN [['source', name_source], ['person', name]] ELSE [['unresolved', speaker]] END) AS x FROM ap) SELECT x[1] AS what, x[2] AS key, count(*) AS n FROM k GROUP BY ALL""")
def f15_visual_summary(spark: SparkSession, sf: str) -> DataFrame:
    return clusters.summary(_applied(spark, sf))
