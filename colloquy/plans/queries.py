"""Queries over the given tables, each beside the same in plain SQL (None: not expressible, see the tests)."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import columns as C
from ..operators import gates, intervals, ledger, sequences, vectors, votes
from ..sources import tables as T

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, tuple[Query, str | None]] = {}

SEG = """seg AS (SELECT conv_id AS rec, turn AS ord, role AS speaker, text, start_ms, start_ms + size AS end_ms FROM (
  SELECT *, CAST(60 * length(text) AS BIGINT) AS size, CAST(coalesce(sum(60 * length(text)) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS start_ms FROM conversations))"""
TURN = SEG + """, turn AS (SELECT rec, ord // 2 AS turn, arg_min(speaker, ord) AS speaker, min(start_ms) + 700 AS start_ms, max(end_ms) + 700 AS end_ms, 500 + (rec * 7 + (ord // 2) * 13) % 500 AS conf FROM seg GROUP BY rec, ord // 2)"""
FRAME = """fr AS (SELECT user_id AS rec, event_id AS id, epoch_us(ts) // 1000 AS t, event_type AS name, CAST(floor(value * 1000) AS BIGINT) AS score FROM events)"""


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f, sql
        return f

    return add


@query(f"""WITH {TURN}, p AS (
  SELECT s.rec, s.ord, s.start_ms, s.end_ms, t.turn, t.speaker, least(s.end_ms, t.end_ms) - greatest(s.start_ms, t.start_ms) AS shared
  FROM seg s JOIN turn t ON s.rec = t.rec AND t.start_ms < s.end_ms AND s.start_ms < t.end_ms
), b AS (SELECT rec, ord, start_ms, end_ms, speaker, sum(shared) AS best, min(turn) AS first FROM p GROUP BY ALL),
r AS (SELECT *, sum(best) OVER (PARTITION BY rec, ord) AS total, row_number() OVER (PARTITION BY rec, ord ORDER BY best DESC, first) AS rn FROM b)
SELECT rec, ord, speaker, CAST(best * 1000 // total AS BIGINT) AS share, CAST(best * 1000 // (end_ms - start_ms) AS BIGINT) AS coverage FROM r WHERE rn = 1""")
def e1_attach_speakers(spark: SparkSession, sf: str) -> DataFrame:
    return intervals.attach_speakers(T.segments(spark, sf), T.turns(spark, sf))


@query(f"""WITH {TURN}, w AS (SELECT rec, ord, i - 1 AS word, start_ms + (i - 1) * 240 AS a, start_ms + i * 240 AS b FROM seg, unnest(generate_series(1, len(string_split(text, ' ')))) AS g(i)),
p AS (SELECT w.*, t.turn, least(b, t.end_ms) - greatest(a, t.start_ms) AS shared FROM w JOIN turn t ON w.rec = t.rec AND t.start_ms < b AND a < t.end_ms),
m AS (SELECT *, max(shared) OVER (PARTITION BY rec, ord, word) AS best FROM p)
SELECT rec, ord, CAST(word AS BIGINT) AS word, CASE WHEN count(*) = 1 THEN min(turn) END AS turn FROM m WHERE shared = best GROUP BY rec, ord, word""")
def e2_words_to_turns(spark: SparkSession, sf: str) -> DataFrame:
    """Ambiguous words have no turn."""
    s = T.segments(spark, sf).select("rec", "ord", "start_ms", F.posexplode(F.split("text", " ")).alias("word", "w"))
    w = s.select("rec", "ord", F.col("word").cast("long").alias("word"), (F.col("start_ms") + F.col("word") * 240).alias("start_ms"), (F.col("start_ms") + (F.col("word") + 1) * 240).alias("end_ms"))
    p = intervals.overlap_join(w, T.turns(spark, sf), ["rec"])
    p = p.withColumn("best", F.max("shared").over(Window.partitionBy("rec", "ord", "word"))).where("shared = best")
    return p.groupBy("rec", "ord", "word").agg(F.when(F.count("*") == 1, F.min("r_turn")).alias("turn"))


@query(f"""WITH {FRAME}, v AS (SELECT rec, t, id FROM fr WHERE name = 'view')
SELECT l.id, coalesce((SELECT arg_max(v.id, v.t) FROM v WHERE v.rec = l.rec AND v.t <= l.t), -1) AS view_id FROM fr l WHERE l.name = 'purchase'""")
def e3_as_of(spark: SparkSession, sf: str) -> DataFrame:
    f = T.frames(spark, sf)
    return intervals.as_of(f.where("name = 'purchase'").select("rec", "id", "t"), f.where("name = 'view'").select("rec", "t", "id"), ["rec"], ["id"]).select("id", F.coalesce("r_id", F.lit(-1)).alias("view_id"))


@query(f"""WITH {FRAME}, i AS (SELECT rec, id, t, coalesce(least(lead(t) OVER (PARTITION BY rec ORDER BY t, id), t + 21600000), t + 21600000) AS e FROM fr)
SELECT c.id, CAST(count(*) AS BIGINT) AS n, min(i.id) AS interval_id FROM fr c JOIN i ON c.rec = i.rec AND i.t <= c.t - 60000 AND c.t - 60000 < i.e GROUP BY c.id""")
def e4_point_in_interval(spark: SparkSession, sf: str) -> DataFrame:
    """A minute before each event, the half-open interval between events that it lies in."""
    f = T.frames(spark, sf)
    end = F.least(F.lead("t").over(Window.partitionBy("rec").orderBy("t", "id")), F.col("t") + 21_600_000)
    i = f.select("rec", F.col("id").alias("interval_id"), F.col("t").alias("start_ms"), F.coalesce(end, F.col("t") + 21_600_000).alias("end_ms"))
    p = f.select("rec", "id", (F.col("t") - 60_000).alias("start_ms"), (F.col("t") - 59_999).alias("end_ms"))
    return intervals.overlap_join(p, i, ["rec"], 21_600_000).groupBy("id").agg(F.count("*").alias("n"), F.min("r_interval_id").alias("interval_id"))


@query(f"""WITH {FRAME}, p AS (SELECT c.id, n.name, count(*) AS votes FROM fr c JOIN fr n ON c.rec = n.rec AND abs(c.t - n.t) <= 3600000 AND c.id <> n.id WHERE c.name = 'error' GROUP BY ALL),
r AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY votes DESC, name) AS rn FROM p) SELECT id, name, votes FROM r WHERE rn = 1""")
def e5_band_votes(spark: SparkSession, sf: str) -> DataFrame:
    f = T.frames(spark, sf)
    p = intervals.band_join(f.where("name = 'error'").select("rec", "id", "t"), f.select("rec", "id", "t", "name"), ["rec"], 3_600_000).where("id <> r_id")
    w = Window.partitionBy("id").orderBy(F.desc("votes"), "name")
    return p.groupBy("id", F.col("r_name").alias("name")).agg(F.count("*").alias("votes")).withColumn("rn", F.row_number().over(w)).where("rn = 1").drop("rn")


@query(f"""WITH {FRAME}, k AS (SELECT rec, t // 600000 AS slot, arg_min(name, id) AS name FROM fr GROUP BY ALL) SELECT f.id, k.name AS first_name FROM fr f JOIN k ON f.rec = k.rec AND f.t // 600000 = k.slot""")
def e6_equal_time(spark: SparkSession, sf: str) -> DataFrame:
    """The first observation of each ten minutes, joined back on that time."""
    f = T.frames(spark, sf).withColumn("slot", F.floor(F.col("t") / 600_000))
    return f.join(f.groupBy("rec", "slot").agg(F.min_by("name", "id").alias("first_name")), ["rec", "slot"]).select("id", "first_name")


@query(f"""WITH {TURN}, p AS (SELECT s.rec, s.ord, t.speaker, least(s.end_ms, t.end_ms) - greatest(s.start_ms, t.start_ms) AS shared, t.conf FROM seg s JOIN turn t ON s.rec = t.rec AND t.start_ms < s.end_ms AND s.start_ms < t.end_ms WHERE t.conf >= 600)
SELECT rec, ord, speaker, count(*) AS n, CAST(sum(shared) AS BIGINT) AS seconds, CAST(sum(shared * conf) AS BIGINT) AS weighted FROM p GROUP BY ALL""")
def e11_window_votes(spark: SparkSession, sf: str) -> DataFrame:
    p = intervals.overlap_join(T.segments(spark, sf).drop("speaker"), T.turns(spark, sf).where("conf >= 600"), ["rec"])
    return p.groupBy("rec", "ord", F.col("r_speaker").alias("speaker")).agg(F.count("*").alias("n"), F.sum("shared").alias("seconds"), F.sum(F.col("shared") * F.col("r_conf")).alias("weighted"))


@query(f"""WITH {TURN} SELECT rec, ord FROM seg s WHERE EXISTS (SELECT 1 FROM turn t WHERE t.rec = s.rec AND t.speaker = s.speaker AND s.start_ms BETWEEN t.start_ms AND t.end_ms)""")
def e12_semi_join(spark: SparkSession, sf: str) -> DataFrame:
    """Segments that start in a turn (both ends in) of the same speaker."""
    return intervals.starting_inside(T.segments(spark, sf).drop("text"), T.turns(spark, sf), ["rec", "speaker"]).select("rec", "ord")


@query(f"""WITH {SEG}, h AS (SELECT rec, start_ms, end_ms FROM seg WHERE contains(lower(text), 'price') OR contains(lower(text), 'the ')) SELECT s.rec, s.ord, CAST(count(*) AS BIGINT) AS hits FROM seg s JOIN h ON s.rec = h.rec AND s.start_ms < h.end_ms + 8000 AND h.start_ms - 8000 < s.end_ms GROUP BY ALL""")
def e15_context(spark: SparkSession, sf: str) -> DataFrame:
    s = T.segments(spark, sf)
    h = s.where(F.contains(F.lower("text"), F.lit("price")) | F.contains(F.lower("text"), F.lit("the "))).select("rec", (F.col("start_ms") - 8000).alias("start_ms"), (F.col("end_ms") + 8000).alias("end_ms"))
    return intervals.overlap_join(s, h, ["rec"]).groupBy("rec", "ord").agg(F.count("*").alias("hits"))


@query(f"""WITH {SEG}, h AS (SELECT rec, ord FROM seg WHERE length(text) >= 600) SELECT DISTINCT s.rec, s.ord FROM seg s JOIN h ON s.rec = h.rec AND s.ord BETWEEN h.ord - 1 AND h.ord + 1""")
def e24_row_offsets(spark: SparkSession, sf: str) -> DataFrame:
    s = T.segments(spark, sf)
    h = s.where(F.length("text") >= 600).select("rec", F.explode(F.sequence(F.col("ord") - 1, F.col("ord") + 1)).alias("ord")).distinct()
    return s.join(h, ["rec", "ord"], "left_semi").select("rec", "ord")


@query(f"""WITH {FRAME}, p AS (SELECT c.id, n.id AS other, abs(c.t - n.t) AS distance, row_number() OVER (PARTITION BY c.id ORDER BY abs(c.t - n.t), n.id) AS rank FROM fr c JOIN fr n ON c.rec = n.rec AND n.name = 'click' AND abs(c.t - n.t) <= 10800000 WHERE c.name = 'signup') SELECT id, other, distance, rank FROM p WHERE rank <= 4""")
def e25_nearest_candidates(spark: SparkSession, sf: str) -> DataFrame:
    f = T.frames(spark, sf)
    p = intervals.band_join(f.where("name = 'signup'").select("rec", "id", "t"), f.where("name = 'click'").select("rec", "id", "t"), ["rec"], 10_800_000)
    p = p.select("id", F.col("r_id").alias("other"), F.abs(F.col("t") - F.col("r_t")).alias("distance"))
    return p.withColumn("rank", F.row_number().over(Window.partitionBy("id").orderBy("distance", "other")).cast("long")).where("rank <= 4")


@query("""WITH c AS (SELECT o_custkey AS k, count(*) AS n FROM orders WHERE o_totalprice > 200000 GROUP BY 1) SELECT c_custkey, c_mktsegment FROM customer LEFT JOIN c ON k = c_custkey WHERE k IS NULL""")
def e30_anti_join(spark: SparkSession, sf: str) -> DataFrame:
    return T.table(spark, sf, "customer").join(T.table(spark, sf, "orders").where("o_totalprice > 200000").select(F.col("o_custkey").alias("c_custkey")), "c_custkey", "left_anti").select("c_custkey", "c_mktsegment")


@query("""WITH a AS (SELECT DISTINCT l_suppkey AS k FROM lineitem WHERE l_returnflag = 'R' AND l_quantity > 49), b AS (SELECT DISTINCT s_suppkey AS k FROM supplier WHERE s_acctbal > 0) SELECT coalesce(a.k, b.k) AS k, CASE WHEN a.k IS NULL THEN 'missing' ELSE 'unexpected' END AS reason FROM a FULL OUTER JOIN b ON a.k = b.k WHERE a.k IS NULL OR b.k IS NULL""")
def e19_set_equality(spark: SparkSession, sf: str) -> DataFrame:
    return gates.set_difference(T.table(spark, sf, "lineitem").where("l_returnflag = 'R' AND l_quantity > 49").select(F.col("l_suppkey").alias("k")), T.table(spark, sf, "supplier").where("s_acctbal > 0").select(F.col("s_suppkey").alias("k")), ["k"])


@query(f"""WITH {TURN}, a AS (SELECT rec, speaker, count(*) AS a_n FROM seg GROUP BY ALL), b AS (SELECT rec, speaker, count(*) AS b_n FROM turn GROUP BY ALL) SELECT coalesce(a.rec, b.rec) AS rec, coalesce(a.speaker, b.speaker) AS speaker, coalesce(a_n, 0) AS a_n, coalesce(b_n, 0) AS b_n, coalesce(a_n, 0) = coalesce(b_n, 0) AS ok FROM a FULL OUTER JOIN b ON a.rec = b.rec AND a.speaker = b.speaker""")
def e22_paired_once(spark: SparkSession, sf: str) -> DataFrame:
    return gates.paired_once(T.segments(spark, sf), T.turns(spark, sf), ["rec", "speaker"], "start_ms")


@query("""WITH n AS (SELECT l_suppkey, l_returnflag || l_linestatus AS name, CAST(sum(l_quantity) AS BIGINT) AS weight FROM lineitem GROUP BY 1, 2), t AS (SELECT l_suppkey, sum(weight) AS total, max(weight) AS weight FROM n GROUP BY 1)
SELECT n.l_suppkey, n.weight, min(name) AS winner, CAST(total AS BIGINT) AS "all", n.weight >= 100 AND n.weight * 100 >= total * 20 AS accepted FROM n JOIN t ON n.l_suppkey = t.l_suppkey AND n.weight = t.weight GROUP BY n.l_suppkey, n.weight, total""")
def f1_cluster_consensus(spark: SparkSession, sf: str) -> DataFrame:
    l = T.table(spark, sf, "lineitem").select("l_suppkey", F.concat("l_returnflag", "l_linestatus").alias("name"), F.col("l_quantity").cast("long").alias("q"))
    return votes.consensus(l, "l_suppkey", "name", "q", 100, 20)


@query(f"""WITH {TURN}, o AS (SELECT *, max(end_ms) OVER (PARTITION BY rec, speaker ORDER BY start_ms, end_ms ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS e FROM turn),
i AS (SELECT *, sum(CASE WHEN start_ms <= e THEN 0 ELSE 1 END) OVER (PARTITION BY rec, speaker ORDER BY start_ms, end_ms ROWS UNBOUNDED PRECEDING) AS island FROM o),
m AS (SELECT rec, speaker, island, max(end_ms) - min(start_ms) AS n FROM i GROUP BY ALL) SELECT rec, speaker, CAST(sum(n) AS BIGINT) AS covered FROM m GROUP BY ALL HAVING sum(n) >= 60000""")
def f2_coverage(spark: SparkSession, sf: str) -> DataFrame:
    return intervals.coverage(T.turns(spark, sf), ["rec", "speaker"], 60_000)


@query(f"""WITH {SEG} SELECT speaker, CAST(sum(end_ms - start_ms) AS BIGINT) AS total FROM seg WHERE speaker <> 'system' GROUP BY 1 HAVING sum(end_ms - start_ms) >= 60000""")
def f3_durations(spark: SparkSession, sf: str) -> DataFrame:
    return T.segments(spark, sf).where("speaker <> 'system'").groupBy("speaker").agg(F.sum(F.col("end_ms") - F.col("start_ms")).alias("total")).where("total >= 60000")


@query("""WITH x AS (SELECT label, unnest(embedding) AS v, generate_subscripts(embedding, 1) AS i FROM embeddings), s AS (SELECT label, i, sum(CAST(floor(CAST(v AS DOUBLE) * 64) AS BIGINT)) AS s, count(*) AS n FROM x GROUP BY ALL)
SELECT label, CAST(max(n) AS BIGINT) AS n, CAST(sum(s) AS BIGINT) AS total, CAST(sum(s * i) AS BIGINT) AS weighted FROM s GROUP BY label""")
def f5_centroids(spark: SparkSession, sf: str) -> DataFrame:
    c = vectors.centroids(T.table(spark, sf, "embeddings"))
    weighted = F.aggregate(F.transform("sums", lambda s, i: s * (i + 1)), F.lit(0).cast("long"), lambda a, x: a + x)
    return c.select("label", "n", F.aggregate("sums", F.lit(0).cast("long"), lambda a, x: a + x).alias("total"), weighted.alias("weighted"))


@query(f"""WITH {FRAME}, v AS (SELECT rec, name, count(*) AS votes FROM fr GROUP BY ALL), r AS (SELECT *, row_number() OVER w AS rn, coalesce(lead(votes) OVER w, 0) AS runner_up, CAST(sum(votes) OVER (PARTITION BY rec) AS BIGINT) AS total FROM v WINDOW w AS (PARTITION BY rec ORDER BY votes DESC, name))
SELECT rec, name, votes, runner_up, total AS "all", CAST(floor(1000 * ((votes / total + 1.96 * 1.96 / (2 * total) - 1.96 * sqrt((votes / total * (1 - votes / total) + 1.96 * 1.96 / (4 * total)) / total)) / (1 + 1.96 * 1.96 / total))) AS BIGINT) AS wilson FROM r WHERE rn = 1""")
def f6_wilson_votes(spark: SparkSession, sf: str) -> DataFrame:
    return votes.ranked(T.frames(spark, sf), "rec", "name").withColumn("wilson", F.floor(1000 * C.wilson(F.col("votes"), F.col("all"))))


@query(f"""WITH {FRAME}, i AS (SELECT rec, score, row_number() OVER (PARTITION BY rec ORDER BY t, id) - 1 AS i, count(*) OVER (PARTITION BY rec) AS n FROM fr)
SELECT rec, CAST(CASE WHEN i < n // 4 THEN 0 WHEN i < n // 2 THEN 1 WHEN i < 3 * n // 4 THEN 2 ELSE 3 END AS BIGINT) AS quarter, count(*) AS n, CAST(sum(score) AS BIGINT) AS total FROM i GROUP BY ALL""")
def f7_quartiles(spark: SparkSession, sf: str) -> DataFrame:
    return votes.quartiles(T.frames(spark, sf), "rec", ["t", "id"], "score")


@query("""SELECT source, count(*) AS n, CAST(count(*) FILTER (lang = 'en') AS BIGINT) AS english, CAST(count(*) FILTER (text IS NULL OR text = '') AS BIGINT) AS empty, CAST(max(n_chars) AS BIGINT) AS longest FROM documents GROUP BY source""")
def f9_conditional_counts(spark: SparkSession, sf: str) -> DataFrame:
    d = T.table(spark, sf, "documents")
    return d.groupBy("source").agg(F.count("*").alias("n"), F.count_if(F.col("lang") == "en").alias("english"), F.count_if(F.col("text").isNull() | (F.col("text") == "")).alias("empty"), F.max("n_chars").alias("longest"))


@query(f"""WITH {FRAME}, g AS (SELECT rec, name, score, t - lag(t) OVER (PARTITION BY rec, name ORDER BY t, id) AS gap FROM fr) SELECT rec, name, count(*) >= 3 AND bool_and(score >= 0) AND coalesce(min(gap), 0) >= 1000 AS passed FROM g GROUP BY ALL""")
def f13_anchor_gate(spark: SparkSession, sf: str) -> DataFrame:
    f = T.frames(spark, sf)
    g = f.withColumn("gap", F.col("t") - F.lag("t").over(Window.partitionBy("rec", "name").orderBy("t", "id")))
    return g.groupBy("rec", "name").agg(((F.count("*") >= 3) & F.bool_and(F.col("score") >= 0) & (F.coalesce(F.min("gap"), F.lit(0)) >= 1000)).alias("passed"))


@query(f"""WITH {SEG} SELECT rec, greatest(max(end_ms) - min(start_ms), 1000) AS span, arg_min(ord, start_ms) AS first FROM seg GROUP BY rec""")
def f16_span(spark: SparkSession, sf: str) -> DataFrame:
    return T.segments(spark, sf).groupBy("rec").agg(F.greatest(F.max("end_ms") - F.min("start_ms"), F.lit(1000)).alias("span"), F.min_by("ord", "start_ms").alias("first"))


@query("""WITH a AS (SELECT o_orderkey AS k, o_orderstatus AS s FROM orders), b AS (SELECT o_orderkey AS k, CASE WHEN o_orderkey % 97 = 0 THEN 'X' ELSE o_orderstatus END AS s FROM orders) SELECT k, s, 'first' AS side FROM (FROM a EXCEPT ALL FROM b) UNION ALL SELECT k, s, 'second' FROM (FROM b EXCEPT ALL FROM a)""")
def f17_recompute_and_compare(spark: SparkSession, sf: str) -> DataFrame:
    o = T.table(spark, sf, "orders").select(F.col("o_orderkey").alias("k"), F.col("o_orderstatus").alias("s"))
    return gates.unchanged(o, o.withColumn("s", F.when(F.col("k") % 97 == 0, "X").otherwise(F.col("s"))))


@query(f"""WITH {FRAME}, o AS (SELECT *, CASE WHEN name = lag(name) OVER (PARTITION BY rec ORDER BY id) THEN 0 ELSE 1 END AS new FROM fr), r AS (SELECT *, sum(new) OVER (PARTITION BY rec ORDER BY id) AS run FROM o), n AS (SELECT *, row_number() OVER (PARTITION BY rec, run ORDER BY id) AS n FROM r) SELECT rec, id, name FROM n WHERE n <= 1""")
def g1_drop_repeats(spark: SparkSession, sf: str) -> DataFrame:
    return sequences.drop_repeats(T.frames(spark, sf).select("rec", "id", "name"), ["rec"], "id", "name", keep=1)


_NEAR = "(start_ms - lag(end_ms) OVER w <= 1000) AND (lead(start_ms) OVER w - end_ms <= 1000) AS near"


@query(f"""WITH {SEG}, a AS (SELECT *, {_NEAR} FROM seg WINDOW w AS (PARTITION BY rec ORDER BY start_ms, end_ms)),
b AS (SELECT * REPLACE (CASE WHEN lag(speaker) OVER w = lead(speaker) OVER w AND near THEN lag(speaker) OVER w ELSE speaker END AS speaker) FROM a WINDOW w AS (PARTITION BY rec ORDER BY start_ms, end_ms)),
c AS (SELECT * REPLACE (CASE WHEN lag(speaker) OVER w = lead(speaker) OVER w AND near THEN lag(speaker) OVER w ELSE speaker END AS speaker) FROM b WINDOW w AS (PARTITION BY rec ORDER BY start_ms, end_ms)) SELECT rec, ord, speaker FROM c""")
def g2_smooth_labels(spark: SparkSession, sf: str) -> DataFrame:
    return sequences.smooth(T.segments(spark, sf), ["rec"], "speaker").select("rec", "ord", "speaker")


@query(f"""WITH {TURN}, c AS (SELECT *, start_ms + end_ms AS c FROM turn), x AS (SELECT rec, speaker, greatest(start_ms, coalesce((lag(c) OVER w + c) // 4, start_ms)) AS a, least(end_ms, coalesce((lead(c) OVER w + c) // 4, end_ms)) AS b FROM c WINDOW w AS (PARTITION BY rec ORDER BY start_ms, end_ms)),
n AS (SELECT *, CASE WHEN speaker = lag(speaker) OVER w AND a - lag(b) OVER w <= 1000 THEN 0 ELSE 1 END AS new FROM x WHERE b > a WINDOW w AS (PARTITION BY rec ORDER BY a, b)), r AS (SELECT *, sum(new) OVER (PARTITION BY rec ORDER BY a, b) AS run FROM n)
SELECT rec, speaker, min(a) AS start_ms, max(b) AS end_ms, count(*) AS n FROM r GROUP BY rec, speaker, run HAVING max(b) - min(a) >= 350""")
def g3_merge_windows(spark: SparkSession, sf: str) -> DataFrame:
    return sequences.merge_windows(T.turns(spark, sf), ["rec"], "speaker")


@query(f"""WITH {FRAME}, o AS (SELECT rec, t, t + 60000 AS e, max(t + 60000) OVER (PARTITION BY rec ORDER BY t, t + 60000 ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS p FROM fr), i AS (SELECT *, sum(CASE WHEN t <= p + 1800000 THEN 0 ELSE 1 END) OVER (PARTITION BY rec ORDER BY t, e ROWS UNBOUNDED PRECEDING) AS island FROM o) SELECT rec, min(t) AS start_ms, max(e) AS end_ms, count(*) AS n FROM i GROUP BY rec, island""")
def g5_merge_gaps(spark: SparkSession, sf: str) -> DataFrame:
    f = T.frames(spark, sf).select("rec", F.col("t").alias("start_ms"), (F.col("t") + 60_000).alias("end_ms"))
    return intervals.merged(f, ["rec"], 1_800_000)


@query(f"""WITH RECURSIVE {FRAME}, k(rec, t) AS (SELECT rec, min(t) FROM fr GROUP BY rec UNION ALL SELECT k.rec, (SELECT min(f.t) FROM fr f WHERE f.rec = k.rec AND f.t >= k.t + 7200000) FROM k WHERE (SELECT min(f.t) FROM fr f WHERE f.rec = k.rec AND f.t >= k.t + 7200000) IS NOT NULL) SELECT rec, count(*) AS n, CAST(sum(t % 1000000007) AS BIGINT) AS digest FROM k GROUP BY rec""")
def g6_greedy_thinning(spark: SparkSession, sf: str) -> DataFrame:
    k = sequences.greedy(T.frames(spark, sf), ["rec"], "t", 7_200_000)
    return k.select("rec", F.size("kept").cast("long").alias("n"), F.aggregate("kept", F.lit(0).cast("long"), lambda a, x: a + x % 1_000_000_007).alias("digest"))


@query(f"""WITH {SEG} SELECT s.rec, s.ord, count(p.ord) AS context FROM seg s LEFT JOIN seg p ON p.rec = s.rec AND p.ord BETWEEN s.ord - 7 AND s.ord - 1 AND s.start_ms - p.start_ms <= 45000 GROUP BY ALL""")
def g8_look_back(spark: SparkSession, sf: str) -> DataFrame:
    return sequences.look_back(T.segments(spark, sf), ["rec"], "ord", 7, 45_000).select("rec", "ord", "context")


@query(f"""WITH {SEG}, f AS (SELECT *, min(start_ms) OVER (PARTITION BY rec, speaker) AS first FROM seg) SELECT rec, ord, CAST(dense_rank() OVER (PARTITION BY rec ORDER BY first, speaker) AS BIGINT) AS number FROM f""")
def g9_speaker_numbers(spark: SparkSession, sf: str) -> DataFrame:
    return sequences.speaker_numbers(T.segments(spark, sf), ["rec"], "speaker").select("rec", "ord", "number")


@query(f"""WITH {FRAME} SELECT id, CASE (row_number() OVER (PARTITION BY rec ORDER BY t, id) - 1) % 5 WHEN 0 THEN 'held_out' WHEN 1 THEN 'calibration' ELSE 'training' END AS part FROM fr""")
def g10_splits(spark: SparkSession, sf: str) -> DataFrame:
    return sequences.splits(T.frames(spark, sf), ["rec"], ["t", "id"]).select("id", "part")


@query(f"""WITH {SEG}, s AS (SELECT 'id' || (rec % 10) AS id, rec, ord, row_number() OVER (PARTITION BY 'id' || (rec % 10) ORDER BY rec, ord) AS k FROM seg) SELECT rec, ord, CASE WHEN k = 1 THEN id ELSE id || '-' || k END AS id FROM s""")
def g15_unique_ids(spark: SparkSession, sf: str) -> DataFrame:
    s = T.segments(spark, sf).select(F.concat(F.lit("id"), (F.col("rec") % 10).cast("string")).alias("id"), "rec", "ord")
    return sequences.unique_ids(s, "id", ["rec", "ord"])


@query(f"""WITH RECURSIVE {SEG}, s AS (SELECT rec, ord, length(text) AS n, row_number() OVER (PARTITION BY rec ORDER BY ord) AS i FROM seg), k AS (
SELECT rec, ord, i, n AS used, 0 AS chunk FROM s WHERE i = 1 UNION ALL SELECT s.rec, s.ord, s.i, CASE WHEN k.used + s.n <= 2000 THEN k.used + s.n ELSE s.n END, CASE WHEN k.used + s.n <= 2000 THEN chunk ELSE chunk + 1 END FROM k JOIN s ON s.rec = k.rec AND s.i = k.i + 1) SELECT rec, ord, CAST(chunk AS BIGINT) AS chunk FROM k""")
def g18_pack_chunks(spark: SparkSession, sf: str) -> DataFrame:
    return sequences.packed(T.segments(spark, sf), ["rec"], "ord", F.length("text"), 2000)


@query(f"""WITH {SEG}, n AS (SELECT rec, ord, start_ms // 30000 AS "window", row_number() OVER (PARTITION BY rec, start_ms // 30000 ORDER BY length(trim(text)) DESC, start_ms, ord) AS n FROM seg) SELECT rec, "window", ord FROM n WHERE n = 1""")
def g21_longest_in_windows(spark: SparkSession, sf: str) -> DataFrame:
    return sequences.longest_in_windows(T.segments(spark, sf), ["rec"], 30_000).select("rec", "window", "ord")


@query(f"""WITH {SEG}, m AS (SELECT *, min(start_ms) OVER (PARTITION BY rec) AS first FROM seg) SELECT rec, ord FROM m WHERE end_ms - first <= 120000""")
def g25_from_first(spark: SparkSession, sf: str) -> DataFrame:
    return T.segments(spark, sf).withColumn("first", F.min("start_ms").over(Window.partitionBy("rec"))).where("end_ms - first <= 120000").select("rec", "ord")


@query(f"""WITH {SEG} SELECT speaker, count(*) AS n, min(rec * 100 + ord) AS first FROM seg GROUP BY speaker ORDER BY n DESC, first LIMIT 2""")
def h1_most_common(spark: SparkSession, sf: str) -> DataFrame:
    return T.segments(spark, sf).groupBy("speaker").agg(F.count("*").alias("n"), F.min(F.col("rec") * 100 + F.col("ord")).alias("first")).orderBy(F.desc("n"), "first").limit(2)


@query("""WITH x AS (SELECT vec_id, label, unnest(embedding) AS v, generate_subscripts(embedding, 1) AS i FROM embeddings), w AS (SELECT vec_id, label, i, CAST(floor(CAST(v AS DOUBLE) * 64) AS BIGINT) AS v FROM x),
c AS (SELECT label AS profile, i, CAST(floor(sum(v) / count(*)) AS BIGINT) AS m FROM w GROUP BY ALL), s AS (SELECT vec_id, profile, CAST(sum(v * m) AS BIGINT) AS score FROM w JOIN c ON w.i = c.i GROUP BY ALL),
r AS (SELECT *, score - lead(score) OVER o AS margin, row_number() OVER o AS rn FROM s WINDOW o AS (PARTITION BY vec_id ORDER BY score DESC, profile)) SELECT vec_id, profile AS best, score, margin FROM r WHERE rn = 1""")
def h6_nearest_profile(spark: SparkSession, sf: str) -> DataFrame:
    e = T.table(spark, sf, "embeddings")
    return vectors.nearest(e, vectors.centroids(e))


@query(f"""WITH {FRAME} SELECT DISTINCT t // 60000 AS minute FROM fr""")
def h8_distinct_times(spark: SparkSession, sf: str) -> DataFrame:
    return T.frames(spark, sf).select(F.floor(F.col("t") / 60_000).alias("minute")).distinct()


@query("""WITH s AS (SELECT CAST(floor(value * 10) AS BIGINT) AS score, event_type IN ('view', 'click') AS good FROM events), a AS (SELECT score, count(*) FILTER (good) AS g, count(*) FILTER (NOT good) AS b FROM s GROUP BY 1),
u AS (SELECT score, sum(g) OVER (ORDER BY score DESC) AS accepted, sum(b) OVER (ORDER BY score DESC) AS bad, sum(b) OVER () AS total FROM a) SELECT score AS threshold, CAST(accepted AS BIGINT) AS accepted, CAST(bad AS BIGINT) AS false_accepted FROM u WHERE bad <= total * CAST(0.1 AS DOUBLE) ORDER BY accepted DESC, score LIMIT 1""")
def j8_threshold_sweep(spark: SparkSession, sf: str) -> DataFrame:
    s = T.table(spark, sf, "events").select(F.floor(F.col("value") * 10).alias("score"), F.col("event_type").isin("view", "click").alias("right"))
    return votes.threshold_sweep(s, 0.1)


@query()
def j1_kmeans(spark: SparkSession, sf: str) -> DataFrame:
    e = T.table(spark, sf, "embeddings").select("vec_id", "embedding", (F.col("label") % 4).cast("long").alias("rec"))
    return vectors.clusters(e, "rec", 3)


@query()
def j2_cosine_kmeans(spark: SparkSession, sf: str) -> DataFrame:
    e = T.table(spark, sf, "embeddings").select("vec_id", "embedding", (F.col("label") % 4).cast("long").alias("rec"))
    return vectors.clusters(e, "rec", 3, vectors.cosine_kmeans)


@query()
def h5_suppressed_boxes(spark: SparkSession, sf: str) -> DataFrame:
    f = T.frames(spark, sf).select("rec", "id", (F.col("id") % 7).cast("double").alias("x0"), (F.col("id") % 5).cast("double").alias("y0"), (F.col("id") % 7 + 4).cast("double").alias("x1"), (F.col("id") % 5 + 4).cast("double").alias("y1"), F.col("score").cast("double").alias("score"))
    return vectors.suppressed(f, "rec").select("rec", "id")


@query("""WITH c AS (SELECT doc_id, regexp_replace(text, '[ \\t\\n\\x0B\\f\\r]+', '', 'g') AS t FROM documents), x AS (SELECT doc_id, unnest(string_split(t, '')) AS ch FROM c), n AS (SELECT doc_id, ch, count(*) AS n FROM x WHERE ch <> '' GROUP BY ALL), s AS (SELECT doc_id, max(n) AS top, sum(n) AS total FROM n GROUP BY doc_id) SELECT doc_id, CAST(coalesce(top, 0) AS INTEGER) AS top, CAST(coalesce(total, 0) AS INTEGER) AS total FROM documents LEFT JOIN s USING (doc_id)""")
def c1_char_share(spark: SparkSession, sf: str) -> DataFrame:
    top, n = C.top_char_share(F.col("text"))
    return T.table(spark, sf, "documents").select("doc_id", top.alias("top"), n.alias("total"))


@query(f"""WITH {SEG} SELECT rec, ord, start_ms, (start_ms + end_ms) // 2 AS middle FROM seg WHERE {' OR '.join(f"contains(lower(text), '{k}')" for k in C.KEYWORDS)}""")
def c7_keywords(spark: SparkSession, sf: str) -> DataFrame:
    return T.segments(spark, sf).where(C.has_keyword(F.col("text"))).select("rec", "ord", "start_ms", F.floor((F.col("start_ms") + F.col("end_ms")) / 2).alias("middle"))


@query("""WITH s AS (SELECT o_orderkey AS k, CAST(round_even(o_totalprice / 10, 0) AS BIGINT) AS s FROM orders) SELECT k, CASE WHEN s >= 3600 THEN printf('%02d:%02d:%02d', s // 3600, s % 3600 // 60, s % 60) ELSE printf('%02d:%02d', s // 60, s % 60) END AS clock, s AS seconds FROM s""")
def d1_d2_clock(spark: SparkSession, sf: str) -> DataFrame:
    o = T.table(spark, sf, "orders").select(F.col("o_orderkey").alias("k"), C.clock(F.col("o_totalprice") / 10).alias("clock"))
    return o.withColumn("seconds", C.seconds(F.col("clock")))


@query("""SELECT doc_id, 'doc-' || substr(sha256(doc_id || chr(31) || source || chr(31) || lang), 1, 16) AS id FROM documents""")
def d6_stable_ids(spark: SparkSession, sf: str) -> DataFrame:
    return T.table(spark, sf, "documents").select("doc_id", C.stable_id("doc", F.col("doc_id").cast("string"), F.col("source"), F.col("lang")).alias("id"))


@query("""WITH b AS (SELECT item_id, list_distinct([substr(text, i, 2) FOR i IN generate_series(1, length(text) - 1)]) AS g FROM benchmark) SELECT a.item_id AS a, b.item_id AS b, CAST(len(list_intersect(a.g, b.g)) AS INTEGER) AS both, CAST(len(list_distinct(list_concat(a.g, b.g))) AS INTEGER) AS either FROM b a JOIN b ON a.item_id + 1 = b.item_id""")
def d16_bigram_jaccard(spark: SparkSession, sf: str) -> DataFrame:
    b = T.table(spark, sf, "benchmark")
    p = b.select(F.col("item_id").alias("a"), F.col("text").alias("x")).join(b.select(F.col("item_id").alias("b"), F.col("text").alias("y")), F.col("a") + 1 == F.col("b"))
    both, either = C.bigram_share(F.col("x"), F.col("y"))
    return p.select("a", "b", both.alias("both"), either.alias("either"))


@query(f"""WITH {TURN} SELECT s.rec, s.ord, min(greatest(0, t.start_ms - s.end_ms, s.start_ms - t.end_ms)) AS gap FROM seg s JOIN turn t ON s.rec = t.rec AND s.speaker = t.speaker GROUP BY ALL""")
def d27_gap(spark: SparkSession, sf: str) -> DataFrame:
    return intervals.nearest_gap(T.segments(spark, sf).drop("text"), T.turns(spark, sf), ["rec", "speaker"]).select("rec", "ord", "gap")


@query(f"""WITH {SEG} SELECT count(*) AS n, CAST(count(*) FILTER (speaker = 'user') AS BIGINT) AS users, CAST(count(*) FILTER (speaker = 'system') AS BIGINT) AS systems, count(DISTINCT rec) AS recordings FROM seg""")
def b6_metrics(spark: SparkSession, sf: str) -> DataFrame:
    return T.segments(spark, sf).agg(F.count("*").alias("n"), F.count_if(F.col("speaker") == "user").alias("users"), F.count_if(F.col("speaker") == "system").alias("systems"), F.count_distinct("rec").alias("recordings"))


@query(f"""WITH {SEG} SELECT rec, ord, concat_ws(',', CASE WHEN speaker = 'system' THEN 'speaker_unknown' END, CASE WHEN end_ms - start_ms < 6000 THEN 'short' END) AS reasons FROM seg WHERE speaker = 'system' OR end_ms - start_ms < 6000""")
def b7_review_reasons(spark: SparkSession, sf: str) -> DataFrame:
    reasons = F.array_compact(F.array(F.when(F.col("speaker") == "system", "speaker_unknown"), F.when(F.col("end_ms") - F.col("start_ms") < 6000, "short")))
    return T.segments(spark, sf).withColumn("r", reasons).where(F.size("r") > 0).select("rec", "ord", F.array_join("r", ",").alias("reasons"))


@query(f"""WITH {FRAME}, r AS (SELECT *, row_number() OVER (PARTITION BY name ORDER BY score DESC, id) AS rank FROM fr) SELECT name, id, score, rank FROM r WHERE rank <= 12""")
def b8_top_per_speaker(spark: SparkSession, sf: str) -> DataFrame:
    w = Window.partitionBy("name").orderBy(F.desc("score"), "id")
    return T.frames(spark, sf).withColumn("rank", F.row_number().over(w).cast("long")).where("rank <= 12").select("name", "id", "score", "rank")


@query(f"""WITH {SEG} SELECT rec, string_agg(speaker || ': ' || length(text), chr(10) ORDER BY ord) AS document FROM seg GROUP BY rec""")
def k9_ordered_document(spark: SparkSession, sf: str) -> DataFrame:
    line = F.concat("speaker", F.lit(": "), F.length("text").cast("string"))
    rows = F.transform(F.array_sort(F.collect_list(F.struct("ord", line.alias("line")))), lambda x: x["line"])
    return T.segments(spark, sf).groupBy("rec").agg(F.array_join(rows, "\n").alias("document"))


@query("""WITH a AS (SELECT c_nationkey AS k, count(*) AS n FROM customer GROUP BY 1), b AS (SELECT s_nationkey AS k, count(*) AS n FROM supplier GROUP BY 1) SELECT b.k, CASE WHEN a.n IS NULL THEN 'missing' ELSE 'changed' END AS reason FROM b LEFT JOIN a ON a.k = b.k WHERE a.n IS DISTINCT FROM b.n""")
def n3_stale_fingerprints(spark: SparkSession, sf: str) -> DataFrame:
    a = T.table(spark, sf, "customer").groupBy(F.col("c_nationkey").alias("k")).agg(F.count("*").alias("n"))
    b = T.table(spark, sf, "supplier").groupBy(F.col("s_nationkey").alias("k")).agg(F.count("*").alias("n"))
    return gates.stale(a, b, "k", "n")


@query(f"""WITH {FRAME}, s AS (SELECT rec, id // 50 AS position FROM fr), g AS (SELECT rec, position, position - lag(position) OVER (PARTITION BY rec ORDER BY position) AS step FROM s) SELECT rec, position, CASE WHEN step = 0 THEN 'duplicated' ELSE 'gap' END AS reason FROM g WHERE step = 0 OR step > 1""")
def i3_ordered_cover(spark: SparkSession, sf: str) -> DataFrame:
    return gates.ordered_cover(T.frames(spark, sf).select("rec", F.floor(F.col("id") / 50).alias("position")), ["rec"], "position")


#: Fixed rows with real cues: the given tables hold invented words only.
def queries() -> dict[str, Query]:
    return {k: f for k, (f, _) in QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {k: sql for k, (_, sql) in QUERIES.items() if sql}
