"""Queries on names, votes, samples and profiles, each beside its SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators import authority, boxes, intervals, sampling, sequences, vectors, votes
from ..sources import tables as T
from .queries import FRAME, SEG, TURN, query

_LIST = ", ".join(f"'{s}'" for s in T.SOURCES)
NAMED = f"""{SEG}, named AS (SELECT *, CASE speaker WHEN 'user' THEN 'Person ' || rec % 5 WHEN 'assistant' THEN 'Guest ' || ord % 3 ELSE 'Speaker 1' END AS name, [{_LIST}][(rec + ord) % 8 + 1] AS source, 400 + (rec * 7 + ord * 13) % 600 AS confidence, (rec + ord) % 2 = 0 AS confirmed FROM seg)"""
_SAID = ", ".join("'" + x.replace("'", "''") + "'" for x in T.SAID)
SPOKEN = f"""{NAMED}, spoken AS (SELECT * EXCLUDE (text), [{_SAID}][(rec * 3 + ord * 7) % {len(T.SAID)} + 1] AS text FROM named)"""
_HUMAN = "(source IN ('participant_map', 'manual_review', 'reviewed_notes'))"


@query(f"""WITH {NAMED} SELECT rec, ord, speaker <> 'system' AND confidence >= 600 AND (source <> 'visual_active_speaker_highlight' OR confirmed) AS trusted FROM named""")
def c2_trusted_names(spark: SparkSession, sf: str) -> DataFrame:
    return T.named_segments(spark, sf).select("rec", "ord", authority.trusted().alias("trusted"))


@query(f"""WITH {NAMED} SELECT source, CAST(count(*) FILTER ({_HUMAN}) AS BIGINT) AS human, CAST(count(*) FILTER ({_HUMAN} AND source <> 'participant_map') AS BIGINT) AS locked, CAST(count(*) FILTER (source NOT IN ('', 'ocr_candidates_only')) AS BIGINT) AS protected FROM named GROUP BY source""")
def c5_authority(spark: SparkSession, sf: str) -> DataFrame:
    s = T.named_segments(spark, sf)
    return s.groupBy(F.col("name_source").alias("source")).agg(F.count_if(authority.human_reviewed()).alias("human"), F.count_if(authority.locked()).alias("locked"), F.count_if(authority.protected()).alias("protected"))


@query(f"""WITH {NAMED} SELECT rec, ord, CASE WHEN source = 'voice_registry' THEN '' ELSE name END AS name, CASE WHEN source = 'voice_registry' THEN 0 ELSE confidence END AS confidence FROM named""")
def l1_retract_stage(spark: SparkSession, sf: str) -> DataFrame:
    r = authority.retracted(T.named_segments(spark, sf), ["voice_registry"])
    return r.select("rec", "ord", F.coalesce("name", F.lit("")).alias("name"), "confidence")


@query(f"""WITH {NAMED}, p AS (SELECT rec, ord, 'Person ' || ord % 5 AS t FROM named WHERE text <> ''), k AS (SELECT n.*, t, source NOT IN ('', 'ocr_candidates_only') AS keep FROM named n LEFT JOIN p USING (rec, ord))
SELECT rec, ord, CASE WHEN t IS NOT NULL AND NOT keep THEN t ELSE name END AS name, CASE WHEN t IS NOT NULL AND NOT keep THEN 700 ELSE confidence END AS confidence, CASE WHEN keep AND lower(t) <> lower(name) THEN t ELSE '' END AS conflict FROM k""")
def l2_preserve_and_record(spark: SparkSession, sf: str) -> DataFrame:
    """Protected names stay; what was proposed instead is recorded."""
    s = T.named_segments(spark, sf)
    names = s.where("text <> ''").select("rec", "ord", F.concat(F.lit("Person "), (F.col("ord") % 5).cast("string")).alias("to"), F.lit(700).cast("long").alias("sure"))
    out = authority.proposed(s, names, ["rec", "ord"], "ocr", authority.protected())
    return out.select("rec", "ord", "name", "confidence", F.coalesce("conflict", F.lit("")).alias("conflict"))


def _sampled_sql(of: str, least: int, share: int, confidence: str) -> str:
    return f"""WITH {FRAME}, f AS (SELECT rec, t // 86400000 AS day, CASE WHEN score >= 1000 THEN name END AS name, score FROM fr), e AS (SELECT rec, day, name, count(*) AS votes, sum(score) AS s FROM f GROUP BY ALL),
o AS (SELECT *, CAST({of} OVER (PARTITION BY rec, day) AS BIGINT) AS "of" FROM e), r AS (SELECT *, row_number() OVER (PARTITION BY rec, day ORDER BY votes DESC, name) AS rn FROM o WHERE name IS NOT NULL), k AS (SELECT *, CAST(votes * 1000 // "of" AS BIGINT) AS share_k, CAST(s // votes AS BIGINT) AS score_k FROM r WHERE rn = 1)
SELECT rec, day, name, votes, "of", CASE WHEN votes >= {least} AND share_k >= {share * 10} THEN {confidence} ELSE 0 END AS confidence, CASE WHEN votes >= {least} AND share_k >= {share * 10} THEN 'named' WHEN votes < {least} THEN 'few' ELSE 'mixed' END AS outcome FROM k"""


def _samples(spark: SparkSession, sf: str) -> DataFrame:
    return T.frames(spark, sf).select("rec", F.floor(F.col("t") / 86_400_000).alias("day"), F.when(F.col("score") >= 1000, F.col("name")).alias("name"), "score")


NAMED_FRAMES = "sum(CASE WHEN name IS NOT NULL THEN votes END)"


@query(_sampled_sql(NAMED_FRAMES, 1, 60, "least(940, 620 + 160 * share_k // 1000 + 220 * least(score_k, 1000) // 1000)"))
def e6_static_visual_votes(spark: SparkSession, sf: str) -> DataFrame:
    """Share of the named frames."""
    c = F.least(F.lit(940), 620 + F.floor(160 * F.col("share_k") / 1000) + F.floor(220 * F.least("score_k", F.lit(1000)) / 1000))
    return votes.sampled(_samples(spark, sf), ["rec", "day"], False, 1, 60, c)


@query(_sampled_sql("sum(votes)", 1, 60, "least(940, 640 + 160 * share_k // 1000 + 200 * least(score_k, 1000) // 1000)"))
def e7_dynamic_visual_votes(spark: SparkSession, sf: str) -> DataFrame:
    """Share of all frames."""
    c = F.least(F.lit(940), 640 + F.floor(160 * F.col("share_k") / 1000) + F.floor(200 * F.least("score_k", F.lit(1000)) / 1000))
    return votes.sampled(_samples(spark, sf), ["rec", "day"], True, 1, 60, c)


@query(_sampled_sql("sum(votes)", 1, 50, "least(940, 520 + 250 * least(score_k, 1000) // 1000 + 100 * share_k // 1000)"))
def e8_avatar_votes(spark: SparkSession, sf: str) -> DataFrame:
    c = F.least(F.lit(940), 520 + F.floor(250 * F.least("score_k", F.lit(1000)) / 1000) + F.floor(100 * F.col("share_k") / 1000))
    return votes.sampled(_samples(spark, sf), ["rec", "day"], True, 1, 50, c)


@query(_sampled_sql("sum(votes)", 2, 67, "least(900, 420 + 260 * least(score_k, 1000) // 1000 + 140 * share_k // 1000)"))
def e9_roster_votes(spark: SparkSession, sf: str) -> DataFrame:
    """Two frames at least, and two thirds."""
    c = F.least(F.lit(900), 420 + F.floor(260 * F.least("score_k", F.lit(1000)) / 1000) + F.floor(140 * F.col("share_k") / 1000))
    return votes.sampled(_samples(spark, sf), ["rec", "day"], True, 2, 67, c)


@query(f"""WITH {FRAME}, i AS (SELECT rec, id, t, t + 60000 AS e FROM fr WHERE name = 'purchase') SELECT i.id, count(*) AS n FROM i JOIN fr f ON f.rec = i.rec AND f.t >= i.t - 7500000 AND f.t <= i.e + 7500000 WHERE f.name = 'view' GROUP BY i.id""")
def e14_frames_near(spark: SparkSession, sf: str) -> DataFrame:
    """Both ends of the widened interval count."""
    f = T.frames(spark, sf)
    i = f.where("name = 'purchase'").select("rec", "id", (F.col("t") - 7_500_000).alias("start_ms"), (F.col("t") + 60_000 + 7_500_001).alias("end_ms"))
    p = f.where("name = 'view'").select("rec", F.col("t").alias("start_ms"), (F.col("t") + 1).alias("end_ms"))
    return intervals.overlap_join(i, p, ["rec"], 15_000_000).groupBy("id").agg(F.count("*").alias("n"))


@query(f"""WITH RECURSIVE {SEG}, k(rec, speaker, t) AS (SELECT rec, speaker, min(start_ms) FROM seg GROUP BY ALL UNION ALL SELECT k.rec, k.speaker, (SELECT min(s.start_ms) FROM seg s WHERE s.rec = k.rec AND s.speaker = k.speaker AND s.start_ms > k.t + 45000) FROM k WHERE (SELECT min(s.start_ms) FROM seg s WHERE s.rec = k.rec AND s.speaker = k.speaker AND s.start_ms > k.t + 45000) IS NOT NULL),
c AS (SELECT k.rec, k.speaker, k.t, s.ord, row_number() OVER (PARTITION BY k.rec, k.speaker, k.t ORDER BY s.ord) AS n FROM k JOIN seg s ON s.rec = k.rec AND s.start_ms < k.t + 30000 AND s.end_ms > k.t - 30000) SELECT rec, speaker, t AS anchor, string_agg(CAST(ord AS VARCHAR), ',' ORDER BY ord) AS context FROM c WHERE n <= 16 GROUP BY ALL""")
def e16_follow_up_context(spark: SparkSession, sf: str) -> DataFrame:
    """Around each greedy anchor of a speaker, the first 16 rows within half a minute."""
    s = T.segments(spark, sf)
    k = sequences.greedy(s, ["rec", "speaker"], "start_ms", 45_000, inclusive=False).select("rec", "speaker", F.explode("kept").alias("anchor"))
    k = k.withColumn("start_ms", F.col("anchor") - 30_000).withColumn("end_ms", F.col("anchor") + 30_000)
    p = intervals.overlap_join(k, s.select("rec", "start_ms", "end_ms", "ord"), ["rec"])
    first = F.slice(F.array_sort(F.collect_list("r_ord")), 1, 16)
    return p.groupBy("rec", "speaker", "anchor").agg(F.array_join(first, ",").alias("context"))


@query(f"""WITH {FRAME}, b AS (SELECT id, rec, t + (id % 3) * 40 AS t2, name FROM fr WHERE score > 500) SELECT fr.id, CASE WHEN b.id IS NULL THEN 'missing' WHEN abs(b.t2 - fr.t) > 50 THEN 'moved' ELSE 'restored' END AS outcome FROM fr LEFT JOIN b ON b.id = fr.id""")
def e27_restore_with_tolerance(spark: SparkSession, sf: str) -> DataFrame:
    f = T.frames(spark, sf)
    b = f.where("score > 500").select("id", (F.col("t") + F.col("id") % 3 * 40).alias("t2"))
    return f.join(b, "id", "left").select("id", F.when(F.col("t2").isNull(), "missing").when(F.abs(F.col("t2") - F.col("t")) > 50, "moved").otherwise("restored").alias("outcome"))


@query(f"""WITH {TURN}, o AS (SELECT *, max(end_ms) OVER (PARTITION BY rec, speaker ORDER BY start_ms, end_ms ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS e FROM turn), i AS (SELECT *, sum(CASE WHEN start_ms <= e + 5000 THEN 0 ELSE 1 END) OVER (PARTITION BY rec, speaker ORDER BY start_ms, end_ms ROWS UNBOUNDED PRECEDING) AS island FROM o),
m AS (SELECT rec, speaker, min(start_ms) AS a, max(end_ms) AS b FROM i GROUP BY rec, speaker, island) SELECT s.rec, s.ord, min(a) AS in_a, min(b) AS in_b FROM seg s JOIN m ON s.rec = m.rec AND s.speaker = m.speaker AND s.start_ms >= a AND s.end_ms <= b WHERE s.end_ms > s.start_ms GROUP BY ALL""")
def e28_in_support_interval(spark: SparkSession, sf: str) -> DataFrame:
    m = intervals.merged(T.turns(spark, sf).select("rec", "speaker", "start_ms", "end_ms"), ["rec", "speaker"], 5000)
    s = T.segments(spark, sf).select("rec", "ord", "speaker", "start_ms", "end_ms")
    return intervals.contained(s, m, ["rec", "speaker"]).select("rec", "ord", "in_a", "in_b")


@query("""WITH x AS (SELECT label, unnest(embedding) AS v, generate_subscripts(embedding, 1) AS i FROM embeddings), s AS (SELECT label, i, CAST(sum(CAST(floor(CAST(v AS DOUBLE) * 64) AS BIGINT)) AS BIGINT) AS s FROM x GROUP BY ALL),
n AS (SELECT label, sum(CAST(s AS DOUBLE) * s) AS n FROM s GROUP BY label), p AS (SELECT a.label AS a, b.label AS b, sum(CAST(a.s AS DOUBLE) * b.s) AS d FROM s a JOIN s b ON a.i = b.i AND a.label < b.label GROUP BY ALL),
c AS (SELECT a, b FROM p JOIN n x ON x.label = a JOIN n y ON y.label = b WHERE d > 0 AND d * d >= CAST(0.01 AS DOUBLE) * x.n * y.n) SELECT a AS label FROM c UNION SELECT b FROM c""")
def e29_colliding_profiles(spark: SparkSession, sf: str) -> DataFrame:
    return vectors.colliding(vectors.centroids(T.table(spark, sf, "embeddings")), 0.1)


@query("""WITH x AS (SELECT vec_id, label, unnest(embedding) AS v, generate_subscripts(embedding, 1) AS i FROM embeddings), w AS (SELECT vec_id, label, i, CAST(floor(CAST(v AS DOUBLE) * 64) AS BIGINT) AS v FROM x),
c AS (SELECT label AS profile, i, CAST(floor(sum(v) / count(*)) AS BIGINT) AS m FROM w GROUP BY ALL), s AS (SELECT vec_id, label, profile, CAST(sum(v * m) AS BIGINT) AS score FROM w JOIN c ON w.i = c.i GROUP BY ALL),
r AS (SELECT *, score - lead(score) OVER o AS margin, row_number() OVER o AS rn FROM s WINDOW o AS (PARTITION BY vec_id ORDER BY score DESC, profile))
SELECT label, count(*) AS n, CAST(count(*) FILTER (margin >= 500 AND profile = label) AS BIGINT) AS accepted, CAST(count(*) FILTER (margin >= 500 AND profile <> label) AS BIGINT) AS false_accepted, count(*) FILTER (margin >= 500 AND profile = label) >= 3 AND count(*) FILTER (margin >= 500 AND profile <> label) = 0 AS usable FROM r WHERE rn = 1 GROUP BY label""")
def f14_template_calibration(spark: SparkSession, sf: str) -> DataFrame:
    e = T.table(spark, sf, "embeddings")
    r = vectors.nearest(e, vectors.centroids(e)).join(e.select("vec_id", "label"), "vec_id").withColumn("hit", (F.col("margin") >= 500) & (F.col("best") == F.col("label"))).withColumn("miss", (F.col("margin") >= 500) & (F.col("best") != F.col("label")))
    return r.groupBy("label").agg(F.count("*").alias("n"), F.count_if("hit").alias("accepted"), F.count_if("miss").alias("false_accepted")).withColumn("usable", (F.col("accepted") >= 3) & (F.col("false_accepted") == 0))


@query(f"""WITH {TURN}, w AS (SELECT rec, ord, i - 1 AS word, start_ms + (i - 1) * 240 AS a, start_ms + i * 240 AS b FROM seg, unnest(generate_series(1, len(string_split(text, ' ')))) AS g(i)), p AS (SELECT w.*, t.turn, least(b, t.end_ms) - greatest(a, t.start_ms) AS shared FROM w JOIN turn t ON w.rec = t.rec AND t.start_ms < b AND a < t.end_ms),
m AS (SELECT *, max(shared) OVER (PARTITION BY rec, ord, word) AS best FROM p), v AS (SELECT rec, ord, word, CASE WHEN count(*) = 1 THEN min(turn) ELSE -1 END AS turn FROM m WHERE shared = best GROUP BY rec, ord, word),
n AS (SELECT *, CASE WHEN turn = lag(turn) OVER o AND word = lag(word) OVER o + 1 THEN 0 ELSE 1 END AS new FROM v WINDOW o AS (PARTITION BY rec, ord ORDER BY word)), r AS (SELECT *, sum(new) OVER (PARTITION BY rec, ord ORDER BY word) AS part FROM n)
SELECT rec, ord, CAST(part AS BIGINT) AS part, min(turn) AS turn, CAST(min(word) AS BIGINT) AS first, CAST(max(word) AS BIGINT) AS last FROM r GROUP BY rec, ord, part""")
def g4_split_at_turns(spark: SparkSession, sf: str) -> DataFrame:
    """Runs of neighbouring words in one turn; -1 is no certain turn."""
    from .queries import e2_words_to_turns

    w = Window.partitionBy("rec", "ord").orderBy("word")
    v = e2_words_to_turns(spark, sf).withColumn("turn", F.coalesce("turn", F.lit(-1).cast("long")))
    v = v.withColumn("new", F.when((F.col("turn") == F.lag("turn").over(w)) & (F.col("word") == F.lag("word").over(w) + 1), 0).otherwise(1)).withColumn("part", F.sum("new").over(w))
    return v.groupBy("rec", "ord", "part").agg(F.min("turn").alias("turn"), F.min("word").alias("first"), F.max("word").alias("last"))


@query(f"""WITH {SEG}, d AS (SELECT rec, max(end_ms) AS d FROM seg GROUP BY rec), i AS (SELECT rec, greatest(1, least(10, (d + 1499999) // 1500000)) AS ideal FROM d) SELECT rec, CAST(greatest(1, ideal - 1) AS BIGINT) AS least, CAST(least(10, ideal + 2) AS BIGINT) AS most FROM i""")
def g17_topic_count_bounds(spark: SparkSession, sf: str) -> DataFrame:
    ideal = F.greatest(F.lit(1), F.least(F.lit(10), F.ceil(F.max("end_ms") / 1_500_000)))
    return T.segments(spark, sf).groupBy("rec").agg(ideal.alias("i")).select("rec", F.greatest(F.lit(1), F.col("i") - 1).alias("least"), F.least(F.lit(10), F.col("i") + 2).alias("most"))


@query(f"""WITH RECURSIVE {TURN}, x AS (SELECT rec, list([start_ms, end_ms] ORDER BY start_ms, end_ms) AS x FROM turn GROUP BY rec), k AS (SELECT rec, x, 0 AS j, [0] AS best FROM x UNION ALL
SELECT rec, x, j + 1, list_append(best, coalesce(list_max([best[i] + 1 FOR i IN range(1, len(best) + 1) IF best[i] >= 0 AND x[j + 1][2] - x[i][1] >= 20000]), -1)) FROM k WHERE j < len(x))
SELECT rec, CAST(greatest(0, best[-1]) AS BIGINT) AS parts FROM k WHERE j = len(x)""")
def g17_long_parts(spark: SparkSession, sf: str) -> DataFrame:
    """The most parts of 20 seconds or more that a conversation's turns can be joined to."""
    return sequences.long_parts(T.turns(spark, sf), "rec", 20_000.0)


_PACKED = """s AS (SELECT rec, ord, length(text) AS n, row_number() OVER (PARTITION BY rec ORDER BY ord) AS i FROM seg), k AS (
SELECT rec, ord, i, n AS used, 0 AS chunk FROM s WHERE i = 1 UNION ALL SELECT s.rec, s.ord, s.i, CASE WHEN k.used + s.n <= 2000 THEN k.used + s.n ELSE s.n END, CASE WHEN k.used + s.n <= 2000 THEN chunk ELSE chunk + 1 END FROM k JOIN s ON s.rec = k.rec AND s.i = k.i + 1)"""


@query(f"""WITH RECURSIVE {SEG}, {_PACKED}, e AS (SELECT rec, max(ord) AS e FROM k GROUP BY rec) SELECT k.rec, CAST(chunk AS BIGINT) AS chunk, min(ord) AS first, max(ord) AS last, greatest(0, min(ord) - 2) AS supplied_first, least(min(e), max(ord) + 2) AS supplied_last FROM k JOIN e ON k.rec = e.rec GROUP BY k.rec, chunk""")
def g18_supplied_ranges(spark: SparkSession, sf: str) -> DataFrame:
    """Places of a chunk's own rows, and with two more on each side."""
    chunks = sequences.packed(T.segments(spark, sf), ["rec"], "ord", F.length("text"), 2000)
    return sequences.supplied(chunks, ["rec"], "ord").withColumnsRenamed({"from": "supplied_first", "to": "supplied_last"})


@query(f"""WITH RECURSIVE {SEG}, {_PACKED}, c AS (SELECT rec, chunk, min(ord) AS a, max(ord) AS b FROM k GROUP BY rec, chunk) SELECT rec, CAST(chunk AS BIGINT) AS chunk, 0 AS half, a AS first, CASE WHEN a = b THEN b ELSE (a + b) // 2 END AS last FROM c UNION ALL SELECT rec, CAST(chunk AS BIGINT), 1, (a + b) // 2 + 1, b FROM c WHERE a < b""")
def g22_halved_chunks(spark: SparkSession, sf: str) -> DataFrame:
    c = sequences.packed(T.segments(spark, sf), ["rec"], "ord", F.length("text"), 2000).groupBy("rec", "chunk").agg(F.min("ord").alias("a"), F.max("ord").alias("b"))
    middle = F.floor((F.col("a") + F.col("b")) / 2)
    halves = F.when(F.col("a") == F.col("b"), F.array(F.struct(F.lit(0).alias("half"), F.col("a").alias("first"), F.col("b").alias("last")))).otherwise(F.array(F.struct(F.lit(0).alias("half"), F.col("a").alias("first"), middle.alias("last")), F.struct(F.lit(1).alias("half"), (middle + 1).alias("first"), F.col("b").alias("last"))))
    return c.select("rec", "chunk", F.inline(halves))


@query(f"""WITH {SEG}, c AS (SELECT rec, ord // 2 AS k, min(ord) AS a, max(ord) + 1 AS b FROM seg GROUP BY ALL), p AS (SELECT *, lag(b) OVER (PARTITION BY rec ORDER BY a, b) AS p FROM c) SELECT rec, k, CASE WHEN a <= p AND p < b THEN p + 1 ELSE a END AS first, b AS last FROM p""")
def g24_clamped_boundaries(spark: SparkSession, sf: str) -> DataFrame:
    c = T.segments(spark, sf).groupBy("rec", F.floor(F.col("ord") / 2).alias("k")).agg(F.min("ord").alias("first"), (F.max("ord") + 1).alias("last"))
    return sequences.without_overlap(c, ["rec"]).select("rec", "k", "first", "last")


@query(f"""WITH {FRAME}, i AS (SELECT rec, score, row_number() OVER (PARTITION BY rec ORDER BY t, id) - 1 AS i FROM fr), g AS (SELECT rec, i, i - row_number() OVER (PARTITION BY rec ORDER BY i) AS g FROM i WHERE score > 5000) SELECT rec, min(i) AS first, max(i) AS last, count(*) AS n FROM g GROUP BY rec, g HAVING count(*) >= 3""")
def g26_runs(spark: SparkSession, sf: str) -> DataFrame:
    return sequences.runs(T.frames(spark, sf), ["rec"], ["t", "id"], F.col("score") > 5000, 3)


@query(f"""WITH {FRAME}, r AS (SELECT *, row_number() OVER (PARTITION BY rec, name ORDER BY t, id) - 1 AS i, count(*) OVER (PARTITION BY rec, name) AS n FROM fr), b AS (SELECT rec, id, row_number() OVER (PARTITION BY rec, t // 86400000 ORDER BY score DESC, t, id) AS k FROM fr)
SELECT rec, id FROM r WHERE n <= 3 OR list_contains([CAST(round_even(k * (n - 1) / 2, 0) AS BIGINT) FOR k IN [0, 1, 2]], i) UNION SELECT rec, id FROM b WHERE k = 1""")
def h4_audit_samples(spark: SparkSession, sf: str) -> DataFrame:
    """Three spread frames of each name, and each day's best."""
    f = T.frames(spark, sf)
    best = f.withColumn("k", F.row_number().over(Window.partitionBy("rec", F.floor(F.col("t") / 86_400_000)).orderBy(F.desc("score"), "t", "id"))).where("k = 1")
    return sequences.spread(f, ["rec", "name"], ["t", "id"], 3).select("rec", "id").union(best.select("rec", "id")).distinct()


_WINDOWS = """w AS (SELECT rec, ord, unnest(CASE WHEN end_ms - 1600 <= start_ms THEN [start_ms] ELSE list_distinct(list_append(generate_series(start_ms, end_ms - 1600, 800), end_ms - 1600)) END) AS a, end_ms FROM seg WHERE end_ms > start_ms), z AS (SELECT rec, ord, a, least(a + 1600, end_ms) AS b FROM w)"""


@query(f"""WITH {SEG}, {_WINDOWS} SELECT rec, ord, a, b FROM z WHERE b - a >= 450""")
def j4_sliding_windows(spark: SparkSession, sf: str) -> DataFrame:
    return sampling.sliding(T.segments(spark, sf)).select("rec", "ord", "a", "b")


@query(f"""WITH {FRAME}, g AS (SELECT rec, greatest(quantile_cont(score, 0.4) * CAST(0.5 AS DOUBLE), max(score) * CAST(0.125 AS DOUBLE)) AS g FROM fr GROUP BY rec) SELECT fr.rec, fr.id FROM fr JOIN g ON fr.rec = g.rec WHERE fr.score >= g.g""")
def j4_loud_windows(spark: SparkSession, sf: str) -> DataFrame:
    return sampling.loud(T.frames(spark, sf), ["rec"], "score", 0.4, 0.5, 0.125).select("rec", "id")


@query("""WITH x AS (SELECT vec_id, label, unnest(embedding) AS v, generate_subscripts(embedding, 1) AS i FROM embeddings), w AS (SELECT vec_id, label, i, CAST(floor(CAST(v AS DOUBLE) * 64) AS BIGINT) AS v FROM x), c AS (SELECT label AS profile, i, CAST(floor(sum(v) / count(*)) AS BIGINT) AS m FROM w GROUP BY ALL),
s AS (SELECT vec_id, profile, CAST(sum(v * m) AS BIGINT) AS score FROM w JOIN c ON w.i = c.i GROUP BY ALL), r AS (SELECT *, score - lead(score) OVER o AS margin, row_number() OVER o AS rn FROM s WINDOW o AS (PARTITION BY vec_id ORDER BY score DESC, profile)) SELECT vec_id, CASE WHEN score < 4000 THEN 'weak' WHEN margin < 800 THEN 'ambiguous' ELSE 'p' || profile END AS name FROM r WHERE rn = 1""")
def j7_open_set_names(spark: SparkSession, sf: str) -> DataFrame:
    """The nearest profile, if its score and its lead suffice."""
    e = T.table(spark, sf, "embeddings")
    name = F.when(F.col("score") < 4000, "weak").when(F.col("margin") < 800, "ambiguous").otherwise(F.concat(F.lit("p"), F.col("best").cast("string")))
    return vectors.nearest(e, vectors.centroids(e)).select("vec_id", name.alias("name"))


@query(f"""WITH {TURN}, p AS (SELECT s.rec, s.ord, s.end_ms - s.start_ms AS n, t.speaker, least(s.end_ms, t.end_ms) - greatest(s.start_ms, t.start_ms) AS shared, t.conf FROM seg s JOIN turn t ON s.rec = t.rec AND t.start_ms < s.end_ms AND s.start_ms < t.end_ms WHERE t.conf >= 600),
v AS (SELECT rec, ord, n, speaker, count(*) AS windows, CAST(sum(shared) AS BIGINT) AS shared, CAST(sum(conf) // count(*) AS BIGINT) AS mean FROM p GROUP BY ALL), r AS (SELECT *, CAST(sum(shared) OVER (PARTITION BY rec, ord) AS BIGINT) AS total, row_number() OVER (PARTITION BY rec, ord ORDER BY shared DESC, speaker) AS rn FROM v)
SELECT rec, ord, speaker, CAST(least(980, 450 + 350 * mean // 1000) AS BIGINT) AS confidence FROM r WHERE rn = 1 AND shared * 100 >= total * 67 AND (windows >= 2 OR n <= 60000)""")
def e11_registry_attach(spark: SparkSession, sf: str) -> DataFrame:
    """By overlap; two thirds of it, and two windows unless the segment is short."""
    p = intervals.overlap_join(T.segments(spark, sf).drop("speaker", "text"), T.turns(spark, sf).where("conf >= 600"), ["rec"])
    v = p.groupBy("rec", "ord", (F.col("end_ms") - F.col("start_ms")).alias("n"), F.col("r_speaker").alias("speaker")).agg(F.count("*").alias("windows"), F.sum("shared").alias("shared"), F.floor(F.sum("r_conf") / F.count("*")).alias("mean"))
    w = Window.partitionBy("rec", "ord")
    r = v.withColumn("total", F.sum("shared").over(w)).withColumn("rn", F.row_number().over(w.orderBy(F.desc("shared"), "speaker")))
    r = r.where("rn = 1 AND shared * 100 >= total * 67 AND (windows >= 2 OR n <= 60000)")
    return r.select("rec", "ord", "speaker", F.least(F.lit(980), 450 + F.floor(350 * F.col("mean") / 1000)).alias("confidence"))


_IN = """c AS (SELECT *, start_ms + least(50, (end_ms - start_ms) // 8) AS ua, end_ms - least(50, (end_ms - start_ms) // 8) AS ub FROM seg), d AS (SELECT rec, ord, ua, ub, ub - ua AS n, unnest(CASE WHEN (ub - ua) * 100 <= 1600 * 145 THEN [5] ELSE [3, 7] END) AS tenths FROM c WHERE ub - ua >= 450),
e AS (SELECT *, least(1600, n) AS size FROM d), f AS (SELECT *, least(ub, greatest(ua, ua + n * tenths // 10 - size // 2) + size) AS b FROM e)"""


@query(f"""WITH {SEG}, {_IN} SELECT rec, ord, CAST(greatest(ua, b - size) AS BIGINT) AS a, CAST(b AS BIGINT) AS b FROM f""")
def j13_windows_in_segments(spark: SparkSession, sf: str) -> DataFrame:
    return sampling.in_segments(T.segments(spark, sf)).select("rec", "ord", "a", "b")


@query(f"""WITH {SEG}, f AS (SELECT rec, ord, start_ms, end_ms - start_ms AS n, unnest(CASE WHEN end_ms - start_ms <= 8000 THEN [5] WHEN end_ms - start_ms <= 16000 THEN [3, 7] ELSE [2, 5, 8] END) AS tenths FROM seg) SELECT rec, ord, tenths, start_ms + n * tenths // 10 AS "at" FROM f""")
def j14_sample_requests(spark: SparkSession, sf: str) -> DataFrame:
    return sampling.requests(T.segments(spark, sf), 8000).select("rec", "ord", "tenths", "at")


@query(f"""WITH {FRAME}, v AS (SELECT rec, t // 86400000 AS day, name, count(*) AS votes FROM fr GROUP BY ALL), r AS (SELECT *, row_number() OVER o AS rn, coalesce(lead(votes) OVER o, 0) AS up FROM v WINDOW o AS (PARTITION BY rec, day ORDER BY votes DESC, name)) SELECT rec, day, CASE WHEN votes < 2 THEN 'weak' WHEN votes = up THEN 'ambiguous' ELSE 'active' END AS reason FROM r WHERE rn = 1""")
def j16_top_slot_reason(spark: SparkSession, sf: str) -> DataFrame:
    f = T.frames(spark, sf).withColumn("k", F.struct("rec", F.floor(F.col("t") / 86_400_000).alias("day")))
    r = votes.ranked(f, "k", "name")
    return r.select("k.rec", "k.day", F.when(F.col("votes") < 2, "weak").when(F.col("votes") == F.col("runner_up"), "ambiguous").otherwise("active").alias("reason"))


@query(f"""WITH {NAMED}, v AS (SELECT rec, speaker, name, count(*) AS n, CAST(sum(confidence) AS BIGINT) AS c FROM named WHERE confidence >= 500 GROUP BY ALL), r AS (SELECT *, CAST(sum(n) OVER (PARTITION BY rec, speaker) AS BIGINT) AS total, row_number() OVER (PARTITION BY rec, speaker ORDER BY n DESC, name) AS rn FROM v) SELECT rec, speaker, CASE WHEN n * 100 >= total * 80 THEN name ELSE '' END AS name, CAST(least(900, 400 + 420 * (c // n) // 1000) AS BIGINT) AS confidence FROM r WHERE rn = 1""")
def j11_same_session_votes(spark: SparkSession, sf: str) -> DataFrame:
    """By count; four fifths, else nobody."""
    v = T.named_segments(spark, sf).where("confidence >= 500").groupBy("rec", "speaker", "name").agg(F.count("*").alias("n"), F.sum("confidence").alias("c"))
    w = Window.partitionBy("rec", "speaker")
    r = v.withColumn("total", F.sum("n").over(w)).withColumn("rn", F.row_number().over(w.orderBy(F.desc("n"), "name"))).where("rn = 1")
    return r.select("rec", "speaker", F.when(F.col("n") * 100 >= F.col("total") * 80, F.col("name")).otherwise("").alias("name"), F.least(F.lit(900), 400 + F.floor(420 * F.floor(F.col("c") / F.col("n")) / 1000)).alias("confidence"))


@query(f"""WITH {FRAME}, b AS (SELECT rec, id, t // 86400000 AS day, id % 7 AS x, id % 5 AS y, id % 7 + 4 AS u, id % 5 + 3 + id % 2 AS v FROM fr), p AS (SELECT a.id AS a, b.id AS b, greatest(0, least(a.u, b.u) - greatest(a.x, b.x)) * greatest(0, least(a.v, b.v) - greatest(a.y, b.y)) AS s, (a.u - a.x) * (a.v - a.y) AS m, (b.u - b.x) * (b.v - b.y) AS n, a.x >= b.x AND a.y >= b.y AND a.u <= b.u AND a.v <= b.v AS inside FROM b a JOIN b ON a.rec = b.rec AND a.day = b.day AND a.id < b.id)
SELECT a, b, CAST(floor(s * 1000 / (m + n - s)) AS BIGINT) AS union_share, CAST(floor(s * 1000 / least(m, n)) AS BIGINT) AS smaller_share, inside FROM p""")
def d22_box_shares(spark: SparkSession, sf: str) -> DataFrame:
    """Boxes of one frame's day, pair by pair."""
    f = T.frames(spark, sf).select("rec", F.floor(F.col("t") / 86_400_000).alias("day"), "id")
    a, b = f.withColumnRenamed("id", "a"), f.withColumnRenamed("id", "b")

    def box(i: str) -> boxes.Box:
        k = F.col(i)
        return k % 7, k % 5, k % 7 + 4, k % 5 + 3 + k % 2

    p, q = box("a"), box("b")
    s, m, n = boxes.shared(p, q), boxes.area(p), boxes.area(q)
    return a.join(b, ["rec", "day"]).where("a < b").select("a", "b", F.floor(s * 1000 / (m + n - s)).alias("union_share"), F.floor(s * 1000 / F.least(m, n)).alias("smaller_share"), boxes.inside(p, q).alias("inside"))
