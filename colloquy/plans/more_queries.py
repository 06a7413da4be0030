"""Further queries, each beside its SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import columns as C
from ..operators import documents, identity, intervals, sequences
from ..sources import tables as T
from .queries import FRAME, SEG, TURN, query

ROW = """fr0 AS (SELECT *, row_number() OVER (PARTITION BY rec ORDER BY t, id) AS i, count(*) OVER (PARTITION BY rec) AS n FROM fr)"""


@query(f"""WITH {FRAME} SELECT DISTINCT greatest(t, 0) // 1000 AS second FROM fr WHERE score >= 0""")
def a6_sample_times(spark: SparkSession, sf: str) -> DataFrame:
    return T.frames(spark, sf).where("score >= 0").select(F.floor(F.greatest("t", F.lit(0)) / 1000).alias("second")).distinct()


@query("""SELECT page_id, CASE WHEN url IS NULL OR url = '' THEN 'invalid_path' WHEN html IS NULL THEN 'invalid_record' WHEN length(html) < 400 THEN 'too_short' ELSE 'accepted' END AS outcome FROM pages""")
def a7_manifest_rows(spark: SparkSession, sf: str) -> DataFrame:
    """The first failing reason of each row."""
    p = T.table(spark, sf, "pages")
    return p.select("page_id", F.when(F.col("url").isNull() | (F.col("url") == ""), "invalid_path").when(F.col("html").isNull(), "invalid_record").when(F.length("html") < 400, "too_short").otherwise("accepted").alias("outcome"))


@query(f"""WITH {FRAME}, p AS (SELECT rec, id, t, t + score - 3000 AS e, lag(t + score - 3000) OVER (PARTITION BY rec ORDER BY t, id) AS p FROM fr) SELECT id, CASE WHEN e <= t THEN 'empty' ELSE 'overlap' END AS reason FROM p WHERE e <= t OR t < p""")
def a10_range_errors(spark: SparkSession, sf: str) -> DataFrame:
    """Ranges that end before they start, or start before the one before them ends."""
    end = F.col("t") + F.col("score") - 3000
    p = T.frames(spark, sf).withColumn("e", end).withColumn("p", F.lag("e").over(Window.partitionBy("rec").orderBy("t", "id")))
    return p.select("id", F.when(F.col("e") <= F.col("t"), "empty").when(F.col("t") < F.col("p"), "overlap").alias("reason")).where("reason IS NOT NULL")


@query("""SELECT label, count(*) AS n, count(DISTINCT len(embedding)) = 1 AS one_dimension FROM embeddings GROUP BY label""")
def a12_profile_dimensions(spark: SparkSession, sf: str) -> DataFrame:
    return T.table(spark, sf, "embeddings").groupBy("label").agg(F.count("*").alias("n"), (F.count_distinct(F.size("embedding")) == 1).alias("one_dimension"))


@query(f"""WITH {SEG} SELECT rec, ord, CASE WHEN start_ms >= 3600000 THEN printf('%02d:%02d:%02d', start_ms // 3600000, start_ms % 3600000 // 60000, start_ms % 60000 // 1000) ELSE printf('%02d:%02d', start_ms // 60000, start_ms % 60000 // 1000) END || ' ' || speaker || ': ' || length(text) AS line FROM seg""")
def b3_transcript_lines(spark: SparkSession, sf: str) -> DataFrame:
    return T.segments(spark, sf).select("rec", "ord", F.concat(C.clock(F.floor(F.col("start_ms") / 1000)), F.lit(" "), "speaker", F.lit(": "), F.length("text").cast("string")).alias("line"))


@query("""SELECT count(*) AS checks, CAST(count(*) FILTER (n = 0) AS BIGINT) AS failed FROM (SELECT count(*) AS n FROM region UNION ALL SELECT count(*) FROM nation UNION ALL SELECT count(*) FROM part UNION ALL SELECT count(*) FROM supplier WHERE s_suppkey < 0)""")
def b17_environment_check(spark: SparkSession, sf: str) -> DataFrame:
    checks = [T.table(spark, sf, t).where(w).agg(F.count("*").alias("n")) for t, w in (("region", "true"), ("nation", "true"), ("part", "true"), ("supplier", "s_suppkey < 0"))]
    a, b, c, d = checks
    return a.union(b).union(c).union(d).agg(F.count("*").alias("checks"), F.count_if(F.col("n") == 0).alias("failed"))


@query(r"""WITH w AS (SELECT item_id, unnest(string_split(replace(text, chr(10), ' '), ' ')) AS name FROM benchmark) SELECT item_id, name, count(*) AS n FROM w WHERE regexp_full_match(name, '[A-Z][a-z]{3,27}') GROUP BY ALL""")
def c8_candidate_names(spark: SparkSession, sf: str) -> DataFrame:
    """Words in title case of a name's length."""
    w = T.table(spark, sf, "benchmark").select("item_id", F.explode(F.split(F.replace("text", F.lit("\n"), F.lit(" ")), " ")).alias("name"))
    return w.where(F.col("name").rlike("^[A-Z][a-z]{3,27}$")).groupBy("item_id", "name").agg(F.count("*").alias("n"))


@query("""SELECT r_regionkey AS id, CASE r_regionkey % 4 WHEN 0 THEN r_name WHEN 1 THEN CASE WHEN 2.0 * (length(r_name) - 1) / (2 * length(r_name) - 1) >= 0.82 THEN r_name END WHEN 2 THEN CASE WHEN 2.0 * length(r_name) / (2 * length(r_name) + 4) >= 0.82 THEN r_name END END AS resolved FROM region""")
def c9_whitelist(spark: SparkSession, sf: str) -> DataFrame:
    """Names in another case, with the last letter lost, with four signs more, and digits only: resolved if alike enough."""
    n, k, name = T.table(spark, sf, "region"), F.col("r_regionkey") % 4, F.col("r_name")
    changed = F.when(k == 0, F.lower(name)).when(k == 1, F.substring(name, F.lit(1), F.length(name) - 1)).when(k == 2, F.concat(name, F.lit("0123"))).otherwise(F.lit("4567"))
    seen = n.select(F.col("r_regionkey").alias("id"), changed.alias("name"))
    return identity.resolved(seen, n.select(F.col("r_name").alias("name"))).select("id", "resolved")


@query(f"""WITH {FRAME}, b AS (SELECT id, rec, id % 7 AS x, id % 5 AS y FROM fr), p AS (SELECT o.id, count(*) AS tiles FROM b o JOIN b i ON o.rec = i.rec AND o.id // 100 = i.id // 100 AND o.id <> i.id AND i.x >= o.x AND i.x + 1 <= o.x + 3 AND i.y >= o.y AND i.y + 1 <= o.y + 3 GROUP BY o.id) SELECT id, tiles FROM p""")
def c17_box_containment(spark: SparkSession, sf: str) -> DataFrame:
    b = T.frames(spark, sf).select("id", "rec", F.floor(F.col("id") / 100).alias("k"), (F.col("id") % 7).alias("x"), (F.col("id") % 5).alias("y"))
    i = b.select(F.col("id").alias("j"), "rec", "k", F.col("x").alias("ix"), F.col("y").alias("iy"))
    return b.join(i, ["rec", "k"]).where("id <> j AND ix >= x AND ix + 1 <= x + 3 AND iy >= y AND iy + 1 <= y + 3").groupBy("id").agg(F.count("*").alias("tiles"))


@query(r"""SELECT item_id, lower(trim(regexp_replace(nfc_normalize(text), '[^\p{L}\p{N}_]+', ' ', 'g'))) AS plain FROM benchmark""")
def d4_normal_form(spark: SparkSession, sf: str) -> DataFrame:
    return T.table(spark, sf, "benchmark").select("item_id", identity.normal_form("text").alias("plain"))


@query(r"""SELECT doc_id, array_to_string(list_sort(regexp_extract_all(text, '[0-9]+(?:\.[0-9]+)?')), ',') AS numbers FROM documents WHERE text IS NOT NULL""")
def d13_number_multiset(spark: SparkSession, sf: str) -> DataFrame:
    return T.table(spark, sf, "documents").where("text IS NOT NULL").select("doc_id", F.array_join(documents.numbers(F.col("text")), ",").alias("numbers"))


@query(f"""WITH {FRAME}, k AS (SELECT rec, t // 3600000 AS hour, name FROM fr) SELECT rec, hour, CASE WHEN count(DISTINCT name) = 1 THEN min(name) ELSE '' END AS only FROM k GROUP BY ALL""")
def e10_single_name(spark: SparkSession, sf: str) -> DataFrame:
    k = T.frames(spark, sf).withColumn("hour", F.floor(F.col("t") / 3_600_000))
    return k.groupBy("rec", "hour").agg(F.when(F.count_distinct("name") == 1, F.min("name")).otherwise("").alias("only"))


@query(f"""WITH {FRAME}, s AS (SELECT id, rec, t FROM fr WHERE name = 'error'), d AS (SELECT id FROM fr WHERE name IN ('error', 'click') AND score > 3000) SELECT count(*) AS signals, CAST(count(*) FILTER (d.id IS NOT NULL) AS BIGINT) AS matched FROM s LEFT JOIN d ON s.id = d.id""")
def e17_signal_matches(spark: SparkSession, sf: str) -> DataFrame:
    f = T.frames(spark, sf)
    d = f.where("name IN ('error', 'click') AND score > 3000").select("id", F.lit(True).alias("hit"))
    return f.where("name = 'error'").join(d, "id", "left").agg(F.count("*").alias("signals"), F.count_if(F.col("hit")).alias("matched"))


@query(f"""WITH {FRAME}, a AS (SELECT id // 10 AS sample, name AS agent, arg_min(score > 5000, id) AS yes FROM fr GROUP BY ALL), w AS (SELECT sample, agent FROM (SELECT DISTINCT id // 10 AS sample FROM fr), (VALUES ('click'), ('view')) AS v(agent))
SELECT w.sample, bool_and(a.yes IS NOT NULL) AS complete, bool_and(coalesce(a.yes, false)) AS agreed FROM w LEFT JOIN a ON a.sample = w.sample AND a.agent = w.agent GROUP BY w.sample""")
def e26_quorum(spark: SparkSession, sf: str) -> DataFrame:
    f = T.frames(spark, sf).select(F.floor(F.col("id") / 10).alias("sample"), F.col("name").alias("agent"), F.col("id").alias("ord"), (F.col("score") > 5000).alias("yes"))
    return identity.quorum(f, f.select("sample").distinct(), spark.createDataFrame([("click",), ("view",)], "agent string"))


@query("""WITH r AS (SELECT o_custkey AS k, o_orderpriority AS name FROM orders), v AS (SELECT k, name, count(*) AS votes FROM r WHERE name <> '1-URGENT' GROUP BY ALL), b AS (SELECT k, name, votes, sum(votes) OVER (PARTITION BY k) AS named, row_number() OVER (PARTITION BY k ORDER BY votes DESC, name) AS rn FROM v), t AS (SELECT k, count(*) AS total FROM r GROUP BY k)
SELECT b.k, name AS winner, votes, CAST(named AS BIGINT) AS named, total AS "all", votes >= 2 AND votes >= named * CAST(0.3 AS DOUBLE) AND named >= total * CAST(0.75 AS DOUBLE) AS accepted FROM b JOIN t ON b.k = t.k WHERE rn = 1""")
def f4_consensus_gates(spark: SparkSession, sf: str) -> DataFrame:
    r = T.table(spark, sf, "orders").select(F.col("o_custkey").alias("k"), F.when(F.col("o_orderpriority") == "1-URGENT", "unknown").otherwise(F.col("o_orderpriority")).alias("name"))
    return identity.gated_clusters(r, "k", 2, 0.75, 0.3)


@query(f"""WITH {FRAME}, v AS (SELECT rec % 10 AS slot, name, count(*) AS n FROM fr GROUP BY ALL), r AS (SELECT *, row_number() OVER (PARTITION BY slot ORDER BY n DESC, name) AS rn FROM v) SELECT slot, string_agg(name || '=' || n, ',' ORDER BY rn) AS top FROM r WHERE rn <= 3 GROUP BY slot""")
def f8_slot_candidates(spark: SparkSession, sf: str) -> DataFrame:
    v = T.frames(spark, sf).groupBy((F.col("rec") % 10).alias("slot"), "name").agg(F.count("*").alias("n"))
    r = v.withColumn("rn", F.row_number().over(Window.partitionBy("slot").orderBy(F.desc("n"), "name"))).where("rn <= 3")
    items = F.array_sort(F.collect_list(F.struct("rn", F.concat("name", F.lit("="), F.col("n").cast("string")).alias("x"))))
    return r.groupBy("slot").agg(F.array_join(F.transform(items, lambda i: i["x"]), ",").alias("top"))


@query("""SELECT o_custkey, array_to_string(list_sort(list(DISTINCT o_orderstatus)), ',') AS states, arg_max(o_orderpriority, o_orderkey) AS last FROM orders GROUP BY o_custkey""")
def f11_sets_and_last(spark: SparkSession, sf: str) -> DataFrame:
    return T.table(spark, sf, "orders").groupBy("o_custkey").agg(F.array_join(F.array_sort(F.collect_set("o_orderstatus")), ",").alias("states"), F.max_by("o_orderpriority", "o_orderkey").alias("last"))


@query(f"""WITH RECURSIVE {FRAME}, e AS (SELECT rec, t FROM fr WHERE name = 'error'), k(rec, t) AS (SELECT rec, min(t) FROM e GROUP BY rec UNION ALL SELECT k.rec, (SELECT min(e.t) FROM e WHERE e.rec = k.rec AND e.t > k.t + 45000000) FROM k WHERE (SELECT min(e.t) FROM e WHERE e.rec = k.rec AND e.t > k.t + 45000000) IS NOT NULL) SELECT rec, count(*) AS n FROM k GROUP BY rec""")
def g7_suppression(spark: SparkSession, sf: str) -> DataFrame:
    return sequences.greedy(T.frames(spark, sf).where("name = 'error'"), ["rec"], "t", 45_000_000, inclusive=False).select("rec", F.size("kept").cast("long").alias("n"))


@query(f"""WITH {FRAME}, {ROW}, e AS (SELECT *, i <= ceil(CAST(0.6 AS DOUBLE) * n) AS early FROM fr0), c AS (SELECT rec, name, count(*) AS k FROM e WHERE early GROUP BY ALL), b AS (SELECT rec, name AS candidate FROM (SELECT *, row_number() OVER (PARTITION BY rec ORDER BY k DESC, name) AS rn FROM c) WHERE rn = 1),
a AS (SELECT e.rec, candidate, max(n) AS n, count(*) FILTER (early AND name = candidate) AS early_good, count(*) FILTER (early) AS early_n, count(*) FILTER (NOT early AND name = candidate) AS late_good, count(*) FILTER (NOT early) AS late_n FROM e JOIN b ON e.rec = b.rec GROUP BY ALL) SELECT *, count(*) OVER (PARTITION BY candidate) > 1 AS collides FROM a""")
def g11_agreement_over_time(spark: SparkSession, sf: str) -> DataFrame:
    return identity.agreement_over_time(T.frames(spark, sf), "rec", ["t", "id"])


@query(f"""WITH {FRAME}, l AS (SELECT rec, id, score, lag(score) OVER (PARTITION BY rec ORDER BY t, id) AS p, row_number() OVER (PARTITION BY rec ORDER BY t, id) AS i FROM fr) SELECT rec, id, CASE WHEN i = 1 THEN 'first' ELSE 'scene' END AS reason FROM l WHERE i = 1 OR abs(score - p) >= 30000""")
def g13_keyframes(spark: SparkSession, sf: str) -> DataFrame:
    w = Window.partitionBy("rec").orderBy("t", "id")
    f = T.frames(spark, sf).withColumn("p", F.lag("score").over(w)).withColumn("i", F.row_number().over(w))
    return f.select("rec", "id", F.when(F.col("i") == 1, "first").when(F.abs(F.col("score") - F.col("p")) >= 30_000, "scene").alias("reason")).where("reason IS NOT NULL")


@query(f"""WITH {FRAME}, {ROW} SELECT rec, id FROM fr0 WHERE n <= 5 OR list_contains([CAST(round_even(k * (n - 1) / 4, 0) AS BIGINT) FOR k IN [0, 1, 2, 3, 4]], i - 1)""")
def g14_spread(spark: SparkSession, sf: str) -> DataFrame:
    return sequences.spread(T.frames(spark, sf), ["rec"], ["t", "id"], 5).select("rec", "id")


@query(f"""WITH {SEG}, b AS (SELECT rec, max(end_ms) AS e FROM seg GROUP BY rec), w AS (SELECT rec, k * 30000 AS a, least((k + 1) * 30000, e) AS z FROM b, unnest(generate_series(0, CAST((e - 1) // 30000 AS BIGINT))) AS g(k)) SELECT w.rec, w.a, CAST(w.z AS BIGINT) AS z, count(s.ord) AS n FROM w JOIN seg s ON s.rec = w.rec AND s.start_ms < w.z AND w.a < s.end_ms GROUP BY ALL""")
def g20_coverage_windows(spark: SparkSession, sf: str) -> DataFrame:
    s = T.segments(spark, sf)
    w = s.groupBy("rec").agg(F.max("end_ms").alias("e")).select("rec", "e", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("e") - 1) / 30_000))).alias("k"))
    w = w.select("rec", (F.col("k") * 30_000).alias("start_ms"), F.least((F.col("k") + 1) * 30_000, "e").alias("end_ms"))
    return intervals.overlap_join(w, s.select("rec", "start_ms", "end_ms", "ord"), ["rec"], 30_000).groupBy("rec", F.col("start_ms").alias("a"), F.col("end_ms").alias("z")).agg(F.count("r_ord").alias("n"))


@query(r"""WITH l AS (SELECT doc_id, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS i, unnest(string_split(text, chr(10))) AS line FROM documents), h AS (SELECT doc_id, i, last_value(CASE WHEN length(line) < 25 THEN line END IGNORE NULLS) OVER (PARTITION BY doc_id ORDER BY i) AS head FROM l) SELECT doc_id, CAST(i AS INTEGER) AS line_no, coalesce(head, '') AS head FROM h""")
def g27_sections(spark: SparkSession, sf: str) -> DataFrame:
    """Lines under the last short line."""
    d = T.table(spark, sf, "documents")
    marked = F.array_join(F.transform(F.split("text", "\n"), lambda x: F.when(F.length(x) < 25, F.concat(F.lit("## "), x)).otherwise(x)), "\n")
    raw = F.last(F.when(F.col("line").startswith("## "), F.substring("line", 4, 1000)), ignorenulls=True).over(Window.partitionBy("doc_id").orderBy("line_no"))
    return documents.lines(d.withColumn("m", marked), "doc_id", "m").select("doc_id", "line_no", F.coalesce(raw, F.lit("")).alias("head"))


@query(f"""WITH {SEG}, p AS (SELECT rec, ord, row_number() OVER (PARTITION BY rec, speaker ORDER BY length(text) DESC, ord) AS k FROM seg), a AS (SELECT rec, ord FROM p WHERE k <= 2 UNION SELECT rec, ord + 1 FROM p WHERE k = 1) SELECT s.rec, s.ord FROM seg s JOIN a ON s.rec = a.rec AND s.ord = a.ord""")
def h3_evidence_packet(spark: SparkSession, sf: str) -> DataFrame:
    """The two longest rows of each speaker, and the row after the longest."""
    s = T.segments(spark, sf)
    p = s.withColumn("k", F.row_number().over(Window.partitionBy("rec", "speaker").orderBy(F.desc(F.length("text")), "ord")))
    a = p.where("k <= 2").select("rec", "ord").union(p.where("k = 1").select("rec", F.col("ord") + 1)).distinct()
    return s.join(a, ["rec", "ord"], "left_semi").select("rec", "ord")


@query("""SELECT item_id, CAST(unnest(generate_series(0, length(text), 50)) AS BIGINT) AS at FROM benchmark UNION SELECT item_id, CAST(length(text) AS BIGINT) FROM benchmark""")
def h7_time_steps(spark: SparkSession, sf: str) -> DataFrame:
    b = T.table(spark, sf, "benchmark").select("item_id", F.length("text").cast("long").alias("n"))
    return b.select("item_id", F.explode(F.sequence(F.lit(0).cast("long"), "n", F.lit(50).cast("long"))).alias("at")).union(b).distinct()


@query(f"""WITH {FRAME}, f AS (SELECT id, CASE name WHEN 'error' THEN 0 WHEN 'purchase' THEN 1 ELSE 2 END AS severity FROM fr) SELECT id, severity FROM f ORDER BY severity, id LIMIT 4""")
def h9_worst_findings(spark: SparkSession, sf: str) -> DataFrame:
    severity = F.when(F.col("name") == "error", 0).when(F.col("name") == "purchase", 1).otherwise(2)
    return T.frames(spark, sf).select("id", severity.alias("severity")).orderBy("severity", "id").limit(4)


@query("""WITH o AS (SELECT l_orderkey AS k, list(l_suppkey ORDER BY l_linenumber) AS ids FROM lineitem GROUP BY 1), u AS (SELECT k, unnest(ids) AS id FROM o), n AS (SELECT k, count(DISTINCT id) AS n, count(DISTINCT id) FILTER (id % 10 = 0) AS unknown FROM u GROUP BY k) SELECT k, CAST(n AS INTEGER) AS n, CAST(unknown AS INTEGER) AS unknown FROM n""")
def i2_distinct_ids(spark: SparkSession, sf: str) -> DataFrame:
    o = T.table(spark, sf, "lineitem").groupBy(F.col("l_orderkey").alias("k")).agg(F.transform(F.array_sort(F.collect_list(F.struct("l_linenumber", "l_suppkey"))), lambda x: x["l_suppkey"]).alias("ids"))
    ids = F.array_distinct("ids")
    return o.select("k", F.size(ids).alias("n"), F.size(F.filter(ids, lambda x: x % 10 == 0)).alias("unknown"))


@query(f"""WITH {SEG}, u AS (SELECT rec, ord, 0 AS part FROM seg WHERE speaker = 'user' UNION ALL SELECT rec, ord, 1 FROM seg WHERE speaker <> 'user') SELECT rec, ord, row_number() OVER (PARTITION BY rec ORDER BY part, ord) AS k FROM u""")
def i4_union_renumbered(spark: SparkSession, sf: str) -> DataFrame:
    s = T.segments(spark, sf).select("rec", "ord", "speaker")
    u = s.where("speaker = 'user'").withColumn("part", F.lit(0)).unionByName(s.where("speaker <> 'user'").withColumn("part", F.lit(1)))
    return u.select("rec", "ord", F.row_number().over(Window.partitionBy("rec").orderBy("part", "ord")).cast("long").alias("k"))


@query(f"""WITH {FRAME} (SELECT id FROM fr WHERE name = 'view' EXCEPT SELECT id FROM fr WHERE score > 5000) UNION SELECT id FROM fr WHERE name = 'signup' AND score < 1000""")
def i5_union_except(spark: SparkSession, sf: str) -> DataFrame:
    f = T.frames(spark, sf)
    a = f.where("name = 'view'").select("id").join(f.where("score > 5000").select("id"), "id", "left_anti")
    return a.union(f.where("name = 'signup' AND score < 1000").select("id")).distinct()


@query(f"""WITH {TURN}, b AS (SELECT rec, speaker, sum(end_ms - start_ms) AS n, min(conf) AS c FROM turn GROUP BY ALL) SELECT rec, speaker, CAST(greatest(350, least(950, 450 + n // 400 + c // 10)) AS BIGINT) AS confidence FROM b""")
def j6_clamped_confidence(spark: SparkSession, sf: str) -> DataFrame:
    b = T.turns(spark, sf).groupBy("rec", "speaker").agg(F.sum(F.col("end_ms") - F.col("start_ms")).alias("n"), F.min("conf").alias("c"))
    return b.select("rec", "speaker", F.greatest(F.lit(350), F.least(F.lit(950), 450 + F.floor(F.col("n") / 400) + F.floor(F.col("c") / 10))).alias("confidence"))


@query("""WITH x AS (SELECT vec_id, label, vec_id % 5 AS source, unnest(embedding) AS v, generate_subscripts(embedding, 1) AS i FROM embeddings), w AS (SELECT vec_id, label, source, i, CAST(floor(CAST(v AS DOUBLE) * 64) AS BIGINT) AS v FROM x),
a AS (SELECT label, i, sum(v) AS s FROM w GROUP BY ALL), o AS (SELECT label, source, i, sum(v) AS s FROM w GROUP BY ALL),
t AS (SELECT w.vec_id, w.label, w.source, a.label AS profile, CAST(sum(w.v * (a.s - CASE WHEN a.label = w.label THEN o.s ELSE 0 END)) AS BIGINT) AS score FROM w JOIN a ON w.i = a.i JOIN o ON o.label = w.label AND o.source = w.source AND o.i = w.i GROUP BY ALL) SELECT vec_id, profile, score, profile = label AS own FROM t""")
def j9_leave_one_source_out(spark: SparkSession, sf: str) -> DataFrame:
    """Every vector against every profile; its own profile without the vector's source."""
    e = T.table(spark, sf, "embeddings").select("vec_id", "label", (F.col("vec_id") % 5).alias("source"), C.whole(F.col("embedding")).alias("v"))
    parts = e.select("label", "source", F.posexplode("v").alias("i", "x"))
    ordered = lambda: F.transform(F.array_sort(F.collect_list(F.struct("i", "x"))), lambda s: s["x"])
    every = parts.groupBy("label", "i").agg(F.sum("x").alias("x")).groupBy(F.col("label").alias("profile")).agg(ordered().alias("all"))
    own = parts.groupBy("label", "source", "i").agg(F.sum("x").alias("x")).groupBy("label", "source").agg(ordered().alias("mine"))
    rows = e.join(own, ["label", "source"]).join(F.broadcast(every) if every.limit(10_001).count() <= 10_000 else every)
    other = F.when(F.col("profile") == F.col("label"), F.zip_with("all", "mine", lambda a, b: a - b)).otherwise(F.col("all"))
    return rows.select("vec_id", "profile", C.dot(F.col("v"), other).alias("score"), (F.col("profile") == F.col("label")).alias("own"))


@query("""SELECT doc_id, CAST(len(regexp_extract_all(text, '\\|')) AS BIGINT) AS bars FROM documents WHERE contains(text, '| ')""")
def k13_table_rows(spark: SparkSession, sf: str) -> DataFrame:
    return T.table(spark, sf, "documents").where(F.contains("text", F.lit("| "))).select("doc_id", F.regexp_count("text", F.lit(r"\|")).cast("long").alias("bars"))


@query("""WITH n AS (SELECT n_nationkey AS speaker, n_name AS name FROM nation UNION ALL SELECT r_regionkey, r_name FROM region), g AS (SELECT speaker, min(name) AS name FROM n GROUP BY speaker HAVING count(*) = 1) SELECT s_suppkey, coalesce(g.name, s_name) AS name FROM supplier LEFT JOIN g ON g.speaker = s_nationkey""")
def l3_relabel(spark: SparkSession, sf: str) -> DataFrame:
    s = T.table(spark, sf, "supplier").select("s_suppkey", F.col("s_nationkey").alias("speaker"), F.col("s_name").alias("name"))
    names = T.table(spark, sf, "nation").select("n_nationkey", "n_name").union(T.table(spark, sf, "region").select("r_regionkey", "r_name")).toDF("speaker", "name")
    return identity.relabelled(s, names).select("s_suppkey", "name")


@query(f"""WITH {SEG} SELECT rec, ord, CASE WHEN speaker <> 'user' OR rec % 3 = 0 THEN 'n' || rec ELSE '' END AS name FROM seg""")
def l5_veto_overlay(spark: SparkSession, sf: str) -> DataFrame:
    s = T.segments(spark, sf).select("rec", "ord", F.concat(F.lit("n"), F.col("rec").cast("string")).alias("name"), (F.col("speaker") == "user").alias("direct"))
    audit = s.select("rec", "ord", (F.col("rec") % 3 == 0).alias("confirmed"))
    return identity.confirmed_only(s, audit, ["rec", "ord"]).select("rec", "ord", F.coalesce("name", F.lit("")).alias("name"))


@query(f"""WITH {SEG}, b AS (SELECT rec, ord, CASE WHEN ord = 2 THEN text || ' 7' ELSE text END AS text FROM seg WHERE speaker <> 'system') SELECT s.rec, s.ord, CASE WHEN b.rec IS NULL THEN 'row_missing' ELSE 'numbers_differ' END AS reason FROM seg s LEFT JOIN b ON s.rec = b.rec AND s.ord = b.ord WHERE b.rec IS NULL OR s.ord = 2""")
def m12_alignment(spark: SparkSession, sf: str) -> DataFrame:
    s = T.segments(spark, sf).select("rec", "ord", "text", "speaker")
    b = s.where("speaker <> 'system'").withColumn("text", F.when(F.col("ord") == 2, F.concat("text", F.lit(" 7"))).otherwise(F.col("text")))
    return documents.misaligned(s, b, "rec", "ord", "text")


#: Fixed rows: three documents, one right, one with a heading too few, one in another order.
