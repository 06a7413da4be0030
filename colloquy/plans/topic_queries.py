"""Proposed topics of each user's events, with faults of every kind, and their repair, beside the same in plain SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators import topics
from ..sources import tables as T
from .queries import FRAME, query

#: Rows of a chunk.
CHUNK = 24


def records(spark: SparkSession, sf: str) -> DataFrame:
    """rec, pos, id, start, end, text: a user's events in order, one every twenty seconds or so."""
    f = T.frames(spark, sf).withColumn("pos", F.row_number().over(Window.partitionBy("rec").orderBy("t", "id")).cast("long") - 1)
    start = F.col("pos") * 20_000 + F.col("id") * 7919 % 7000
    size = F.when(F.col("id") % 5 == 0, 20_000).otherwise(10_000 + F.col("id") * 31 % 5000)
    return f.select("rec", "pos", F.concat(F.lit("r"), "rec", F.lit("_"), "pos").alias("id"), (start / 1000).alias("start"), ((start + size) / 1000).alias("end"), F.concat("name", F.lit(" "), "score").alias("text"))


def chunks(records: DataFrame) -> DataFrame:
    last = records.groupBy("rec").agg(F.max("pos").alias("last"))
    c = last.select("rec", "last", F.explode(F.sequence(F.lit(0).cast("long"), F.floor(F.col("last") / CHUNK))).alias("chunk"))
    return c.select("rec", "chunk", "last", (F.col("chunk") * CHUNK).alias("core_from"), F.least(F.col("chunk") * CHUNK + CHUNK - 1, F.col("last")).alias("core_to"))


def proposals(chunks: DataFrame) -> DataFrame:
    """Two to nine topics a chunk: ranges that overlap, cross, nest, leave gaps or name rows that don't exist; anchors in and out of place."""
    m, h = 2 + (F.col("rec") + F.col("chunk")) % 8, (F.col("rec") * 7919 + F.col("chunk") * 104_729 + F.col("k") * 1_299_709) % 1_000_003
    t = chunks.withColumn("k", F.explode(F.sequence(F.lit(1).cast("long"), m))).withColumn("h", h)
    s = F.least(F.greatest(F.col("core_from") + F.floor((F.col("k") - 1) * CHUNK / m) + F.col("h") % 4 - 1, F.lit(0)), F.col("last"))
    e = F.least(s + F.floor(F.col("h") / 4) % 11 - F.when(F.col("h") % 211 == 0, 12).otherwise(0), F.col("last") + F.when(F.col("h") % 97 == 0, 1).otherwise(0))
    name = lambda pos: F.concat(F.lit("r"), "rec", F.lit("_"), pos.cast("string"))
    anchors = F.array(name(s + F.col("h") % 3), name(F.col("core_from") + F.col("h") % 31 - 3), name(s + F.col("h") % 13 - 6), name(s - F.col("h") % 3))
    title = F.concat(F.lit("T"), "k", F.when(F.col("h") % 13 == 0, F.repeat(F.lit("x"), 118)).otherwise(F.lit("")))
    return t.select("rec", "chunk", "k", title.alias("title"), F.concat(F.lit("about "), "k").alias("summary"), F.when(F.col("h") % 7 < 6, topics.SUBSTANTIVE).otherwise(topics.TRANSITIONAL).alias("importance"), name(s).alias("start_id"), name(e).alias("end_id"), F.when(F.col("h") % 17 > 0, anchors).alias("anchors"))


_PROPOSED = f"""{FRAME}, r AS (SELECT rec, pos, 'r' || rec || '_' || pos AS id, (pos * 20000 + id * 7919 % 7000) / 1000.0 AS a, (pos * 20000 + id * 7919 % 7000 + CASE WHEN id % 5 = 0 THEN 20000 ELSE 10000 + id * 31 % 5000 END) / 1000.0 AS b, length(name || ' ' || score) AS size
  FROM (SELECT *, row_number() OVER (PARTITION BY rec ORDER BY t, id) - 1 AS pos FROM fr)),
ch AS (SELECT rec, last, unnest(range(0, last // {CHUNK} + 1)) AS chunk FROM (SELECT rec, max(pos) AS last FROM r GROUP BY rec)),
co AS (SELECT *, chunk * {CHUNK} AS c0, least(chunk * {CHUNK} + {CHUNK - 1}, last) AS c1, 2 + (rec + chunk) % 8 AS m FROM ch),
hk AS (SELECT *, (rec * 7919 + chunk * 104729 + k * 1299709) % 1000003 AS h FROM (SELECT *, unnest(range(1, m + 1)) AS k FROM co)),
sk AS (SELECT *, least(greatest(c0 + (k - 1) * {CHUNK} // m + h % 4 - 1, 0), last) AS s FROM hk),
pk AS (SELECT *, least(s + (h // 4) % 11 - CASE WHEN h % 211 = 0 THEN 12 ELSE 0 END, last + CASE WHEN h % 97 = 0 THEN 1 ELSE 0 END) AS e, CASE WHEN h % 17 > 0 THEN [s + h % 3, c0 + h % 31 - 3, s + h % 13 - 6, s - h % 3] ELSE [] END AS an,
  'T' || k || CASE WHEN h % 13 = 0 THEN repeat('x', 118) ELSE '' END AS title, 'about ' || k AS summary, h % 7 < 6 AS sub FROM sk),
"""

# positions stand for ids here: an id that names no row is a position outside 0 ... last
_REPAIRED = f"""WITH {_PROPOSED} u AS (SELECT *, bool_and(e BETWEEN s AND last AND e >= 0) OVER (PARTITION BY rec, chunk) AS usable FROM pk),
x1 AS (SELECT u.*, lead(s) OVER w AS ns, lead(e) OVER w AS ne FROM u WHERE usable WINDOW w AS (PARTITION BY rec, chunk ORDER BY k)),
x2 AS (SELECT x1.*, ra.b - rb.a AS shared FROM x1 JOIN r ra ON ra.rec = x1.rec AND ra.pos = x1.e LEFT JOIN r rb ON rb.rec = x1.rec AND rb.pos = x1.ns),
x3 AS (SELECT *, coalesce(ns <= e AND ns > s AND (shared <= 30 OR e < ne), false) AS trim, e < ne AND shared > 30 AS parted FROM x2),
x4 AS (SELECT * EXCLUDE (e), CASE WHEN trim THEN ns - 1 ELSE e END AS e FROM x3),
x5 AS (SELECT *, [a FOR a IN an IF a BETWEEN c0 AND c1 AND a > e AND a < coalesce(ns, c1 + 1)] AS af FROM x4),
x6 AS (SELECT *, greatest(e, list_max(af)) AS e2 FROM x5),
x7 AS (SELECT *, coalesce(lag(e2) OVER (PARTITION BY rec, chunk ORDER BY k), c0 - 1) AS pe FROM x6),
x8 AS (SELECT *, least(s, list_min([a FOR a IN an IF a BETWEEN c0 AND c1 AND a < s AND a > pe])) AS s2 FROM x7),
x9 AS (SELECT *, list({{'k': k, 's': s2, 'e': e2}}) OVER (PARTITION BY rec, chunk) AS rg FROM x8),
y1 AS (SELECT *, [a FOR a, i IN an IF (a < 0 OR a > last) OR a BETWEEN s2 AND e2 OR (a BETWEEN c0 AND c1 AND len([1 FOR q IN rg IF q.k <> k AND a BETWEEN q.s AND q.e]) = 0)] AS keep FROM x9),
y2 AS (SELECT y1.*, lead(s2) OVER w AS s3, lead(e2) OVER w AS e3, lead(title) OVER w AS t3, lead(summary) OVER w AS m3, lead(sub) OVER w AS sub3, lead(keep) OVER w AS keep3 FROM y1 WINDOW w AS (PARTITION BY rec, chunk ORDER BY k)),
y3 AS (SELECT y2.*, coalesce(s2 <= s3 AND e3 <= e2 AND sub AND sub3 AND rb.b - ra.a >= 30 AND length(title || t3) <= 117 AND len([1 FOR a IN list_concat(keep, keep3) IF a < 0 OR a > last]) = 0, false) AS link FROM y2 LEFT JOIN r ra ON ra.rec = y2.rec AND ra.pos = s3 LEFT JOIN r rb ON rb.rec = y2.rec AND rb.pos = e3),
-- pairs are taken from the left, one after the other
y4 AS (SELECT rec, chunk, k, link AS takes FROM y3 WHERE k = 1 UNION ALL SELECT y3.rec, y3.chunk, y3.k, y3.link AND NOT y4.takes FROM y4 JOIN y3 ON y3.rec = y4.rec AND y3.chunk = y4.chunk AND y3.k = y4.k + 1),
y5 AS (SELECT y3.*, takes, coalesce(lag(takes) OVER (PARTITION BY rec, chunk ORDER BY k), false) AS eaten FROM y3 JOIN y4 USING (rec, chunk, k)),
y6 AS (SELECT rec, chunk, k, c0, c1, s2, e2, CASE WHEN takes THEN title || ' / ' || t3 ELSE title END AS title, CASE WHEN takes THEN '[' || title || '] ' || summary || chr(10) || '[' || t3 || '] ' || m3 ELSE summary END AS summary, sub, CASE WHEN takes THEN list_sort(list_distinct(list_concat(keep, keep3))) ELSE keep END AS an FROM y5 WHERE NOT eaten),
y7 AS (SELECT y6.*, row_number() OVER w AS i, lag(e2) OVER w AS pe, lead(k) OVER w IS NULL AS fin FROM y6 WINDOW w AS (PARTITION BY rec, chunk ORDER BY k)),
g AS (SELECT y7.rec, chunk, 2 * i - 1 AS place, coalesce(pe + 1, c0) AS f, s2 - 1 AS l, CASE WHEN i = 1 THEN 'inserted_start_coverage_topic' ELSE 'inserted_gap_topic_before:' || i END AS code, i * 10 AS pl FROM y7 JOIN r ra ON ra.rec = y7.rec AND ra.pos = s2 LEFT JOIN r rb ON rb.rec = y7.rec AND rb.pos = pe WHERE CASE WHEN i = 1 THEN s2 > c0 ELSE s2 > pe + 1 AND ra.a - rb.b > 30 END
  UNION ALL SELECT rec, chunk, 2 * i + 1, e2 + 1, c1, 'inserted_end_coverage_topic', i * 10 + 1 FROM y7 WHERE fin AND e2 < c1),
gg AS (SELECT g.rec, chunk, place, f, l, r.pos, row_number() OVER (PARTITION BY g.rec, chunk, place ORDER BY size DESC, a, pos) AS best FROM g JOIN r ON r.rec = g.rec AND r.pos BETWEEN f AND l),
z1 AS (SELECT rec, chunk, 2 * i AS place, title, summary, CASE WHEN sub THEN 'substantive' ELSE 'transitional' END AS importance, s2 AS f, e2 AS l, an, false AS fill FROM y7
  UNION ALL SELECT rec, chunk, place, '{topics.FILLER_TITLE}', '{topics.FILLER_SUMMARY}', 'transitional', f, l, [pos], true FROM gg WHERE best = 1),
z2 AS (SELECT *, count(*) OVER (PARTITION BY rec, chunk) AS n, lag(fill) OVER w AS pf, lag(f) OVER w AS bf, lag(an) OVER w AS ban, lead(fill) OVER w AS nf, lead(l) OVER w AS nl, lead(an) OVER w AS nan, lead(place, 2) OVER w IS NULL AS near FROM z1 WINDOW w AS (PARTITION BY rec, chunk ORDER BY place)),
firsts AS MATERIALIZED (SELECT *, n > 8 AND NOT fill AND coalesce(pf, false) AS into_, n > 8 AND NOT fill AND coalesce(nf, false) AND near AS back_ FROM z2),
z3 AS (SELECT *, CASE WHEN into_ THEN list_concat(ban, an) ELSE an END AS an1 FROM firsts WHERE NOT (n > 8 AND fill)),
-- distinct in order of first place
z4 AS (SELECT *, CASE WHEN into_ THEN [v FOR v, j IN an1 IF list_position(an1, v) = j][1:4] ELSE an1 END AS an2 FROM z3),
z5 AS (SELECT *, CASE WHEN back_ THEN list_concat(an2, nan) ELSE an2 END AS an3 FROM z4),
z6 AS (SELECT rec, chunk, place, title, summary, importance, CASE WHEN into_ THEN bf ELSE f END AS f, CASE WHEN back_ THEN nl ELSE l END AS l, CASE WHEN back_ THEN [v FOR v, j IN an3 IF list_position(an3, v) = j][1:4] ELSE an3 END AS an, into_, back_, count(*) OVER (PARTITION BY rec, chunk) AS n FROM z5)"""


@query(_REPAIRED.replace("WITH fr", "WITH RECURSIVE fr", 1) + """, o AS (SELECT rec, chunk, row_number() OVER (PARTITION BY rec, chunk ORDER BY place) AS k, title, importance, summary, f, l, an FROM z6 WHERE n <= 8
  UNION ALL SELECT rec, chunk, k, title, CASE WHEN sub THEN 'substantive' ELSE 'transitional' END, summary, s, e, an FROM u WHERE NOT usable OR (rec, chunk) IN (SELECT (rec, chunk) FROM z6 WHERE n > 8))
SELECT rec, chunk, k, title, summary, importance, 'r' || rec || '_' || f AS start_id, 'r' || rec || '_' || l AS end_id, coalesce(array_to_string(['r' || rec || '_' || a FOR a IN an], ','), '') AS anchors FROM o""")
def g23_topics(spark: SparkSession, sf: str) -> DataFrame:
    """The repaired topics of all chunks, a row each."""
    r = records(spark, sf)
    c = chunks(r)
    out = topics.normalized(proposals(c), r, c).select("rec", "chunk", F.posexplode("topics").alias("k", "x"))
    return out.select("rec", "chunk", (F.col("k") + 1).cast("long").alias("k"), "x.title", "x.summary", "x.importance", "x.start_id", "x.end_id", F.array_join("x.anchors", ",").alias("anchors"))


@query(_REPAIRED.replace("WITH fr", "WITH RECURSIVE fr", 1) + """, c AS (SELECT rec, chunk, 1 AS step, k AS pl, 0 AS nth, CASE WHEN parted THEN 'partitioned_crossing_overlap_before:' ELSE 'trimmed_overlap_before:' END || (k + 1) AS code FROM x4 WHERE trim
  UNION ALL SELECT rec, chunk, 2, k, j, 'topic:' || k || ':expanded_end_for_anchor:r' || rec || '_' || a FROM (SELECT *, unnest(an) AS a, generate_subscripts(an, 1) AS j FROM x8) WHERE list_contains(af, a) AND len([1 FOR q, n IN an IF n < j AND q >= a AND list_contains(af, q)]) = 0
  UNION ALL SELECT rec, chunk, 2, k, j, 'topic:' || k || ':expanded_start_for_anchor:r' || rec || '_' || a FROM (SELECT *, unnest(an) AS a, generate_subscripts(an, 1) AS j FROM x8) WHERE a BETWEEN c0 AND c1 AND a < s AND a > pe AND len([1 FOR q, n IN an IF n < j AND q <= a AND q BETWEEN c0 AND c1 AND q > pe]) = 0
  UNION ALL SELECT rec, chunk, 3, k, j, 'topic:' || k || ':dropped_misplaced_anchor:r' || rec || '_' || a FROM (SELECT *, unnest(an) AS a, generate_subscripts(an, 1) AS j FROM y1) WHERE NOT list_contains(keep, a)
  UNION ALL SELECT rec, chunk, 4, k, 0, 'merged_nested_topics:' || k || ':' || (k + 1) FROM y5 WHERE takes
  UNION ALL SELECT rec, chunk, 5, pl, 0, code FROM g
  UNION ALL SELECT rec, chunk, 6, place, 0, 'folded_gap_into_following_topic' FROM z6 WHERE into_
  UNION ALL SELECT rec, chunk, 7, place, 0, 'folded_end_gap_into_previous_topic' FROM z6 WHERE back_
  UNION ALL SELECT DISTINCT rec, chunk, 8, 0, 0, 'coverage_normalization_topic_limit' FROM z6 WHERE n > 8)
SELECT rec, chunk, string_agg(code, ' ' ORDER BY step, pl, nth) AS changes FROM c GROUP BY rec, chunk""")
def g23_changes(spark: SparkSession, sf: str) -> DataFrame:
    """What was changed, in order, in each chunk in which anything was."""
    r = records(spark, sf)
    c = chunks(r)
    return topics.normalized(proposals(c), r, c).where(F.size("changes") > 0).select("rec", "chunk", F.array_join("changes", " ").alias("changes"))
