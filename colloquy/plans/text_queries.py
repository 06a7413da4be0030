"""Queries on texts, claims, references and documents, each beside its SQL."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import columns as C
from ..operators import claims, ledger, sequences
from ..sources import tables as T
from .identity_queries import NAMED, SPOKEN
from .queries import FRAME, SEG, TURN, query


@query(f"""WITH {SEG} SELECT 'seg_' || rec || '_' || ord AS id, CAST(start_ms AS DOUBLE) / 1000 AS start, CAST(end_ms AS DOUBLE) / 1000 AS "end", text, speaker FROM seg""")
def a1_b1_json_round_trip(spark: SparkSession, sf: str) -> DataFrame:
    """Written as JSON and read back with the transcript's schema."""
    s = T.segments(spark, sf)
    path = f"{T.scratch(spark)}/json-{uuid.uuid4().hex}"
    s.select(F.concat_ws("_", F.lit("seg"), "rec", "ord").alias("id"), (F.col("start_ms").cast("double") / 1000).alias("start"), (F.col("end_ms").cast("double") / 1000).alias("end"), "text", "speaker").write.json(path)
    return spark.read.schema(T.SEGMENT_SCHEMA).json(path).select("id", "start", "end", "text", "speaker")


@query("""SELECT item_id, printf('seg_%05d', item_id) AS id FROM benchmark WHERE trim(text) <> '' AND NOT contains(lower(text), 'subscribe to')""")
def a2_numbered_rows(spark: SparkSession, sf: str) -> DataFrame:
    """Rows numbered before blank and junk ones go."""
    b = T.table(spark, sf, "benchmark").select("item_id", "text", F.format_string("seg_%05d", "item_id").alias("id"))
    return b.where((F.trim("text") != "") & ~F.contains(F.lower("text"), F.lit("subscribe to"))).select("item_id", "id")


@query(f"""WITH {SEG} SELECT s.rec, s.ord, coalesce(n_name, '') AS name FROM seg s LEFT JOIN nation ON n_nationkey = s.rec % 30""")
def a9_participant_map(spark: SparkSession, sf: str) -> DataFrame:
    """A small map looked up from every row; Spark broadcasts it where its size allows."""
    s, n = T.segments(spark, sf), T.table(spark, sf, "nation")
    return s.join(n, n.n_nationkey == s.rec % 30, "left").select("rec", "ord", F.coalesce("n_name", F.lit("")).alias("name"))


@query("""SELECT l_orderkey AS k, l_linenumber AS i FROM lineitem JOIN orders ON o_orderkey = l_orderkey WHERE l_quantity >= 45 AND o_orderstatus = 'F' AND o_totalprice >= 300000""")
def a21_filtered_scan(spark: SparkSession, sf: str) -> DataFrame:
    """Predicates and columns that reach both scans."""
    l, o = T.table(spark, sf, "lineitem").where("l_quantity >= 45"), T.table(spark, sf, "orders").where("o_orderstatus = 'F' AND o_totalprice >= 300000")
    return l.join(o, F.col("o_orderkey") == F.col("l_orderkey")).select(F.col("l_orderkey").alias("k"), F.col("l_linenumber").alias("i"))


@query(f"""WITH {SEG}, n AS (SELECT speaker, count(*) AS n, min(rec * 1000 + ord) AS f FROM seg GROUP BY speaker), k AS (SELECT rec * 1000 + ord AS p FROM seg WHERE contains(lower(text), 'the ') OR contains(lower(text), 'price') ORDER BY 1 LIMIT 12)
SELECT 0 AS section, row_number() OVER (ORDER BY n DESC, f) AS line, speaker || ' ' || n AS text FROM n UNION ALL SELECT 1, row_number() OVER (ORDER BY p), CAST(p AS VARCHAR) FROM k""")
def b4_digest(spark: SparkSession, sf: str) -> DataFrame:
    """Counts by speaker, then the first twelve rows with a keyword: sections of one relation."""
    s = T.segments(spark, sf).withColumn("p", F.col("rec") * 1000 + F.col("ord"))
    n = s.groupBy("speaker").agg(F.count("*").alias("n"), F.min("p").alias("f"))
    head = n.select(F.lit(0).alias("section"), F.row_number().over(Window.orderBy(F.desc("n"), "f")).cast("long").alias("line"), F.concat_ws(" ", "speaker", "n").alias("text"))
    hits = s.where(C.has_keyword(F.col("text"), ("the ", "price"))).select("p").orderBy("p").limit(12)
    return head.unionByName(hits.select(F.lit(1).alias("section"), F.row_number().over(Window.orderBy("p")).cast("long").alias("line"), F.col("p").cast("string").alias("text")))


@query("""SELECT label, count(*) AS n FROM embeddings GROUP BY label""")
def b12_library_without_vectors(spark: SparkSession, sf: str) -> DataFrame:
    return T.table(spark, sf, "embeddings").drop("embedding").groupBy("label").agg(F.count("*").alias("n"))


@query(r"""WITH c AS (SELECT doc_id, text AS t FROM documents), e AS (SELECT doc_id, CASE WHEN length(trim(t)) = 0 THEN ['empty'] ELSE [] END || CASE WHEN length(t) > 300 THEN ['too_long'] ELSE [] END || CASE WHEN regexp_matches(t, '(?i)https?://|www\.') THEN ['web_address'] ELSE [] END || CASE WHEN regexp_matches(t, '(?i)\b(?:will|must|shall|todo)\b') THEN ['action_wording'] ELSE [] END || CASE WHEN regexp_matches(t, '[{}<>\[\]]') THEN ['markup'] ELSE [] END AS r FROM c)
SELECT doc_id, array_to_string(r, ',') AS reasons FROM e WHERE len(r) > 0""")
def c14_claim_errors(spark: SparkSession, sf: str) -> DataFrame:
    d = T.table(spark, sf, "documents").select("doc_id", claims.text_errors(F.col("text"), 300).alias("r"))
    return d.where(F.size("r") > 0).select("doc_id", F.array_join("r", ",").alias("reasons"))


@query(r"""SELECT p_partkey, array_to_string(CASE WHEN length(p_name) > 25 THEN ['too_long'] ELSE [] END || CASE WHEN contains(p_name, '/') THEN ['combined'] ELSE [] END || CASE WHEN regexp_full_match(lower(p_name), '(?:part|item|general).*') THEN ['generic'] ELSE [] END, ',') AS reasons FROM part""")
def c16_title_errors(spark: SparkSession, sf: str) -> DataFrame:
    n = F.col("p_name")
    r = claims.reasons((F.length(n) > 25, "too_long"), (F.contains(n, F.lit("/")), "combined"), (F.lower(n).rlike("^(?:part|item|general)"), "generic"))
    return T.table(spark, sf, "part").select("p_partkey", F.array_join(r, ",").alias("reasons"))


@query(f"""WITH {TURN} SELECT s.rec, s.ord, t.turn, greatest(0, least(s.end_ms, t.end_ms) - greatest(s.start_ms, t.start_ms)) AS shared FROM seg s JOIN turn t ON t.rec = s.rec AND t.turn = s.ord // 2""")
def d3_overlap(spark: SparkSession, sf: str) -> DataFrame:
    s, t = T.segments(spark, sf).withColumn("turn", F.floor(F.col("ord") / 2)), T.turns(spark, sf).select("rec", "turn", F.col("start_ms").alias("a"), F.col("end_ms").alias("b"))
    return s.join(t, ["rec", "turn"]).select("rec", "ord", "turn", C.overlap(F.col("start_ms"), F.col("end_ms"), F.col("a"), F.col("b")).alias("shared"))


@query(r"""SELECT doc_id, sha256(trim(regexp_replace(text, '[ \t\n\x0B\f\r]+', ' ', 'g'))) AS plain FROM documents WHERE text IS NOT NULL""")
def d5_normal_space(spark: SparkSession, sf: str) -> DataFrame:
    return T.table(spark, sf, "documents").where("text IS NOT NULL").select("doc_id", F.sha2(C.normal_space(F.col("text")), 256).alias("plain"))


@query(f"""WITH {SEG} SELECT rec, sha256(string_agg(ord || chr(31) || start_ms || chr(31) || end_ms || chr(31) || speaker || chr(31) || text, chr(30) ORDER BY ord)) AS fingerprint FROM seg GROUP BY rec""")
def d7_transcript_fingerprints(spark: SparkSession, sf: str) -> DataFrame:
    """Of what was said and when, not of who it was found to be."""
    row = F.concat_ws("\x1f", "ord", "start_ms", "end_ms", "speaker", "text")
    rows = F.transform(F.array_sort(F.collect_list(F.struct("ord", row.alias("row")))), lambda x: x["row"])
    return T.segments(spark, sf).groupBy("rec").agg(F.sha2(F.array_join(rows, "\x1e"), 256).alias("fingerprint"))


def misspelled(word: Column, k: Column) -> Column:
    """A word as it is, without its last letter, with two letters swapped, with another first letter, or with a strange ending."""
    n = F.length(word)
    return F.when(k == 0, word).when(k == 1, F.substring(word, F.lit(1), n - 1)).when(k == 2, F.concat(F.substring(word, F.lit(1), n - 2), F.right(word, F.lit(1)), F.substring(word, n - 1, F.lit(1)))).when(k == 3, F.concat(F.lit("q"), F.substring(word, F.lit(2), n))).otherwise(F.concat(word, F.lit("zqx")))


@query()
def d17_grounded_tokens(spark: SparkSession, sf: str) -> DataFrame:
    """The last word of seven letters or more of each whole text, spelled in five ways, against that text."""
    word = F.coalesce(F.try_element_at(F.regexp_extract_all("text", F.lit(r"\b[A-Za-z]{7,}\b"), F.lit(0)), F.lit(-1)), F.when(F.col("text").isNotNull(), ""))
    d = T.table(spark, sf, "documents").select("doc_id", "text", misspelled(word, F.pmod(F.xxhash64("doc_id"), F.lit(5))).alias("token"))
    return d.select("doc_id", "token", claims.grounded(F.col("token"), F.col("text")).alias("grounded"))


_WORDS = {"release": "release|deploy", "testing": "test|verify", "maintenance": "maintenance|restart|downtime"}


@query(f"""WITH {SPOKEN} SELECT rec, ord, array_to_string(list_filter([{', '.join(f"CASE WHEN regexp_matches(text, '(?i)\\b(?:{w})\\b') THEN '{t}' END" for t, w in _WORDS.items())}], lambda x: x IS NOT NULL), ',') AS topics,
array_to_string(list_sort(list_distinct(list_concat([60 * CAST(x AS BIGINT) FOR x IN regexp_extract_all(text, '(?i)\\b(\\d+)\\s*hours?\\b', 1)], [CAST(x AS BIGINT) FOR x IN regexp_extract_all(text, '(?i)\\b(\\d+)\\s*minutes?\\b', 1)], [1440 * CAST(x AS BIGINT) FOR x IN regexp_extract_all(text, '(?i)\\b(\\d+)\\s*days?\\b', 1)]))), ',') AS minutes,
CASE WHEN regexp_matches(text, '(?i)\\b(?:no|without|zero)\\s+downtime\\b') THEN 'false' WHEN contains(lower(text), 'downtime') THEN 'true' ELSE '' END AS downtime FROM spoken""")
def d9_d12_attributes(spark: SparkSession, sf: str) -> DataFrame:
    """Topics, lengths and the three values of downtime of all spoken rows."""
    t = F.col("text")
    return T.spoken(spark, sf).select("rec", "ord", F.array_join(ledger.topics(t), ",").alias("topics"), F.array_join(F.transform(ledger.durations(t), lambda x: x.cast("string")), ",").alias("minutes"), F.coalesce(ledger.downtime(t).cast("string"), F.lit("")).alias("downtime"))


@query("""SELECT o_orderkey AS k, CASE dayname(o_orderdate) WHEN 'Saturday' THEN 'weekend' WHEN 'Sunday' THEN 'weekend' ELSE lower(substr(dayname(o_orderdate), 1, 3)) END AS day FROM orders""")
def d14_weekday_keys(spark: SparkSession, sf: str) -> DataFrame:
    names = F.create_map(*[F.lit(x) for kv in {"Sat": "weekend", "Sun": "weekend"}.items() for x in kv])
    day = F.date_format("o_orderdate", "E")
    return T.table(spark, sf, "orders").select(F.col("o_orderkey").alias("k"), F.coalesce(F.try_element_at(names, day), F.lower(day)).alias("day"))


@query(r"""SELECT doc_id, array_to_string(list_sort(list_distinct(regexp_extract_all(text, '[A-Za-z]+[-_]?[0-9]+'))), ',') AS names FROM documents WHERE text IS NOT NULL""")
def d15_identifiers(spark: SparkSession, sf: str) -> DataFrame:
    found = F.array_sort(F.array_distinct(F.regexp_extract_all("text", F.lit(r"[A-Za-z]+[-_]?[0-9]+"), F.lit(0))))
    return T.table(spark, sf, "documents").where("text IS NOT NULL").select("doc_id", F.array_join(found, ",").alias("names"))


@query("""SELECT s_suppkey, length('{"k":' || s_suppkey || ',"n":"' || s_name || '"}') AS size FROM supplier""")
def d19_json_length(spark: SparkSession, sf: str) -> DataFrame:
    return T.table(spark, sf, "supplier").select("s_suppkey", F.length(F.to_json(F.struct(F.col("s_suppkey").alias("k"), F.col("s_name").alias("n")))).cast("long").alias("size"))


@query("""SELECT event_id, coalesce(TRY_CAST(props->>'k' AS BIGINT), -1) AS k, coalesce(TRY_CAST(event_type AS BIGINT), 0) AS number FROM events""")
def d21_lenient_casts(spark: SparkSession, sf: str) -> DataFrame:
    k = F.get_json_object("props", "$.k").try_cast("bigint")
    return T.table(spark, sf, "events").select("event_id", F.coalesce(k, F.lit(-1).cast("long")).alias("k"), F.coalesce(F.col("event_type").try_cast("bigint"), F.lit(0).cast("long")).alias("number"))


@query("""WITH x AS (SELECT vec_id, unnest(embedding) AS v, generate_subscripts(embedding, 1) AS i FROM embeddings), w AS (SELECT vec_id, i, CAST(floor(CAST(v AS DOUBLE) * 64) AS BIGINT) AS v FROM x), m AS (SELECT vec_id, CAST(sum(v) AS BIGINT) AS s, CAST(sum(v * v) AS BIGINT) AS q, count(*) AS n FROM w GROUP BY vec_id),
p AS (SELECT a.vec_id AS a, b.vec_id AS b, CAST(sum(a.v * b.v) AS BIGINT) AS d FROM w a JOIN w b ON b.vec_id = a.vec_id + 1 AND a.i = b.i GROUP BY ALL) SELECT a, CAST(m.n * d - m.s * k.s AS BIGINT) AS cov, CAST((m.n * m.q - m.s * m.s) AS BIGINT) AS va, CAST((k.n * k.q - k.s * k.s) AS BIGINT) AS vb FROM p JOIN m ON m.vec_id = a JOIN m k ON k.vec_id = b""")
def d23_centred_similarity(spark: SparkSession, sf: str) -> DataFrame:
    """The whole-number parts of a correlation with the next vector: cov / sqrt(va * vb)."""
    e = T.table(spark, sf, "embeddings").select("vec_id", C.whole(F.col("embedding")).alias("v"))
    a, b = e.toDF("a", "v"), e.select((F.col("vec_id") - 1).alias("a"), F.col("v").alias("u"))
    n, one = F.size("v").cast("long"), lambda x: F.aggregate(x, F.lit(0).cast("long"), lambda s, y: s + y)
    v, u = F.col("v"), F.col("u")
    return a.join(b, "a").select("a", (n * C.dot(v, u) - one(v) * one(u)).alias("cov"), (n * C.dot(v, v) - one(v) * one(v)).alias("va"), (n * C.dot(u, u) - one(u) * one(u)).alias("vb"))


@query("""WITH c AS (SELECT label, count(*) AS n FROM embeddings GROUP BY label) SELECT label, CASE WHEN n >= 45 THEN 650 + n ELSE 720 END AS threshold FROM c""")
def d24_resolved_thresholds(spark: SparkSession, sf: str) -> DataFrame:
    """A calibrated value, else the default."""
    c = T.table(spark, sf, "embeddings").groupBy("label").agg(F.count("*").alias("n"))
    return c.select("label", F.coalesce(F.lit(None).cast("long"), F.when(F.col("n") >= 45, 650 + F.col("n")), F.lit(720).cast("long")).alias("threshold"))


@query(r"""SELECT item_id, sha256(trim(regexp_replace(text, '[^.,\n]*(?:der|the)[^.,\n]*[.,]', '', 'g'))) AS rest FROM benchmark""")
def d25_dropped_clauses(spark: SparkSession, sf: str) -> DataFrame:
    """Clauses that hold a listed word go."""
    return T.table(spark, sf, "benchmark").select("item_id", F.sha2(F.trim(F.regexp_replace("text", r"[^.,\n]*(?:der|the)[^.,\n]*[.,]", "")), 256).alias("rest"))


@query(r"""SELECT p_partkey, trim(regexp_replace(lower(p_name), '[^a-z0-9]+', '-', 'g'), '-') AS slug, CASE WHEN p_retailprice < 1000 THEN 'before' ELSE 'after' END AS mode FROM part""")
def d28_d29_cases_and_slugs(spark: SparkSession, sf: str) -> DataFrame:
    slug = F.regexp_replace(F.regexp_replace(F.lower("p_name"), "[^a-z0-9]+", "-"), "^-+|-+$", "")
    return T.table(spark, sf, "part").select("p_partkey", slug.alias("slug"), F.when(F.col("p_retailprice") < 1000, "before").otherwise("after").alias("mode"))


@query(f"""WITH {NAMED} SELECT rec, ord, array_to_string([x FOR x IN [speaker, source] IF x IN ('user', 'manual_review', 'voice_registry')], ',') AS allowed FROM named""")
def d31_allowed_reasons(spark: SparkSession, sf: str) -> DataFrame:
    allowed = F.array_intersect(F.array("speaker", "name_source"), F.array(*map(F.lit, ("user", "manual_review", "voice_registry"))))
    return T.named_segments(spark, sf).select("rec", "ord", F.array_join(allowed, ",").alias("allowed"))


@query(f"""WITH {FRAME}, w AS (SELECT DISTINCT id FROM fr WHERE name = 'error'), g AS (SELECT id, count(*) AS n FROM (SELECT id FROM fr WHERE name IN ('error', 'signup') AND score > 2000 UNION ALL SELECT id FROM fr WHERE name = 'error' AND score > 90000) GROUP BY id)
SELECT coalesce(w.id, g.id) AS id, CASE WHEN g.id IS NULL THEN 'missing' WHEN w.id IS NULL THEN 'unknown' ELSE 'repeated' END AS reason FROM w FULL OUTER JOIN g ON w.id = g.id WHERE g.id IS NULL OR w.id IS NULL OR n > 1""")
def e20_m5_m10_exact_cover(spark: SparkSession, sf: str) -> DataFrame:
    """Every signal has exactly one disposition."""
    f = T.frames(spark, sf)
    given = f.where("name IN ('error', 'signup') AND score > 2000").select("id").union(f.where("name = 'error' AND score > 90000").select("id"))
    return claims.exact_cover(f.where("name = 'error'"), given, "id")


@query("""WITH o AS (SELECT o_orderkey AS k FROM orders WHERE o_orderstatus = 'F'), s AS (SELECT DISTINCT l_orderkey AS k FROM lineitem WHERE l_returnflag = 'R') SELECT k, k IN (SELECT k FROM s) AS shadowed FROM o""")
def e21_shadowed(spark: SparkSession, sf: str) -> DataFrame:
    o = T.table(spark, sf, "orders").where("o_orderstatus = 'F'").select(F.col("o_orderkey").alias("k"))
    r = T.table(spark, sf, "lineitem").where("l_returnflag = 'R'").select(F.col("l_orderkey").alias("k"))
    return o.join(r, "k", "left_semi").withColumn("shadowed", F.lit(True)).union(o.join(r, "k", "left_anti").withColumn("shadowed", F.lit(False)))


@query(f"""WITH RECURSIVE {SEG}, s AS (SELECT rec, ord, text, length(text) AS n, row_number() OVER (PARTITION BY rec ORDER BY ord) AS i FROM seg), k AS (
SELECT rec, ord, text, i, n AS used, 0 AS chunk FROM s WHERE i = 1 UNION ALL SELECT s.rec, s.ord, s.text, s.i, CASE WHEN k.used + s.n <= 2000 THEN k.used + s.n ELSE s.n END, CASE WHEN k.used + s.n <= 2000 THEN chunk ELSE chunk + 1 END FROM k JOIN s ON s.rec = k.rec AND s.i = k.i + 1) SELECT rec, CAST(chunk AS BIGINT) AS chunk, count(*) AS hints FROM k WHERE contains(lower(text), 'the ') GROUP BY ALL""")
def e23_hints_of_chunks(spark: SparkSession, sf: str) -> DataFrame:
    s = T.segments(spark, sf)
    hints = s.where(F.contains(F.lower("text"), F.lit("the "))).select("rec", "ord")
    return sequences.packed(s, ["rec"], "ord", F.length("text"), 2000).join(hints, ["rec", "ord"], "left_semi").groupBy("rec", "chunk").agg(F.count("*").alias("hints"))


@query(f"""WITH {SEG}, g AS (SELECT rec, ord, speaker, text, list_distinct([substr(text, i, 2) FOR i IN generate_series(1, length(text) - 1)]) AS g FROM seg) SELECT a.rec, a.ord AS a, b.ord AS b FROM g a JOIN g b ON a.rec = b.rec AND a.speaker = b.speaker AND a.ord < b.ord WHERE length(a.text) >= 4 AND length(b.text) >= 4 AND 2 * len(list_intersect(a.g, b.g)) >= len(list_distinct(list_concat(a.g, b.g)))""")
def e31_repeated_actions(spark: SparkSession, sf: str) -> DataFrame:
    """Two rows of one speaker and recording that share half of their letter pairs.

    The pairs are numbers, made once a row; rows meet only where their sizes allow a half. Sets of letter pairs share nearly all that
    is frequent, so meeting on a rare pair would make more candidates than a speaker's rows of one recording do."""
    code = F.transform(F.split("text", ""), lambda c: F.ascii(c).cast("long"))
    s = T.segments(spark, sf).where(F.length("text") >= 4).select("rec", "speaker", "ord", code.alias("c"))
    g = F.array_distinct(F.zip_with(F.slice("c", F.lit(1), F.size("c") - 1), F.slice("c", F.lit(2), F.size("c") - 1), lambda x, y: x * (1 << 21) + y))
    s = s.select("rec", "speaker", "ord", g.alias("g")).withColumn("n", F.size("g"))
    p = s.withColumnsRenamed({"ord": "a", "g": "x", "n": "m"}).join(s.withColumnsRenamed({"ord": "b", "g": "y"}), ["rec", "speaker"]).where("a < b AND 2 * m >= n AND 2 * n >= m")
    return p.withColumn("both", F.size(F.array_intersect("x", "y"))).where("3 * both >= m + n").select("rec", "a", "b")


@query("""SELECT o_custkey, o_orderpriority AS topic, string_agg(CAST(o_orderkey AS VARCHAR), ',' ORDER BY o_orderkey) AS ids FROM orders WHERE o_orderstatus = 'O' GROUP BY ALL""")
def f10_required_groups(spark: SparkSession, sf: str) -> DataFrame:
    o = T.table(spark, sf, "orders").where("o_orderstatus = 'O'")
    return o.groupBy("o_custkey", F.col("o_orderpriority").alias("topic")).agg(F.array_join(F.array_sort(F.collect_list("o_orderkey")), ",").alias("ids"))


@query("""SELECT lower(c_name) AS name FROM customer WHERE c_acctbal > 0 UNION SELECT lower(s_name) FROM supplier UNION SELECT lower(n_name) FROM nation""")
def f12_known_names(spark: SparkSession, sf: str) -> DataFrame:
    a, b, c = T.table(spark, sf, "customer").where("c_acctbal > 0").select(F.lower("c_name").alias("name")), T.table(spark, sf, "supplier").select(F.lower("s_name")), T.table(spark, sf, "nation").select(F.lower("n_name"))
    return a.union(b).union(c).distinct()


@query("""WITH r AS (SELECT o_custkey, o_orderpriority, o_orderkey, row_number() OVER w AS i, count(*) OVER (PARTITION BY o_custkey, o_orderpriority) AS n FROM orders WINDOW w AS (PARTITION BY o_custkey, o_orderpriority ORDER BY o_orderdate, o_orderkey)) SELECT o_custkey, o_orderpriority, o_orderkey, n FROM r WHERE i = 1""")
def h2_first_of_duplicates(spark: SparkSession, sf: str) -> DataFrame:
    o = T.table(spark, sf, "orders").select("o_custkey", "o_orderpriority", "o_orderkey", "o_orderdate")
    return claims.first_of_duplicates(o, ["o_custkey", "o_orderpriority"], ["o_orderdate", "o_orderkey"]).drop("o_orderdate")


@query("""WITH l AS (SELECT l_orderkey AS k, list_sort(list(DISTINCT l_returnflag)) AS a, list_sort(list(DISTINCT l_linestatus)) AS b, count(*) AS n FROM lineitem GROUP BY 1) SELECT k, array_to_string(CASE WHEN NOT list_has_any(a, ['N']) THEN ['topics_disjoint'] ELSE [] END || CASE WHEN n > 6 THEN ['too_many_rows'] ELSE [] END || CASE WHEN len(b) <> 1 THEN ['not_single'] ELSE [] END, ',') AS reasons FROM l""")
def i1_candidate_errors(spark: SparkSession, sf: str) -> DataFrame:
    l = T.table(spark, sf, "lineitem").groupBy(F.col("l_orderkey").alias("k")).agg(F.collect_set("l_returnflag").alias("a"), F.collect_set("l_linestatus").alias("b"), F.count("*").alias("n"))
    r = claims.reasons((~F.arrays_overlap("a", F.array(F.lit("N"))), "topics_disjoint"), (F.col("n") > 6, "too_many_rows"), (F.size("b") != 1, "not_single"))
    return l.select("k", F.array_join(r, ",").alias("reasons"))


@query("""WITH e AS (SELECT vec_id % 5 AS source, label FROM embeddings), s AS (SELECT DISTINCT source FROM e), d AS (SELECT DISTINCT source, label FROM e) SELECT s.source, count(DISTINCT d.label) AS others FROM s JOIN d ON d.source <> s.source GROUP BY s.source""")
def i7_leave_one_out_complement(spark: SparkSession, sf: str) -> DataFrame:
    """Names that the other sources have: all sources of a name but one, without pairing sources."""
    d = T.table(spark, sf, "embeddings").select((F.col("vec_id") % 5).alias("source"), "label").distinct()
    by = d.groupBy("label").agg(F.count("*").alias("n"))
    every = by.agg(F.count("*").alias("all"))
    lone = d.join(by.where("n = 1"), "label").groupBy("source").agg(F.count("*").alias("lone"))
    return d.select("source").distinct().join(lone, "source", "left").join(F.broadcast(every)).select("source", (F.col("all") - F.coalesce("lone", F.lit(0))).alias("others"))


@query(f"""WITH {SEG}, a AS (SELECT rec, list(speaker ORDER BY ord) AS s, list(length(text) ORDER BY ord) AS n FROM seg GROUP BY rec), z AS (SELECT rec, unnest(list_zip(s, n)) AS z FROM a) SELECT rec, z[1] AS speaker, CAST(sum(z[2]) AS BIGINT) AS letters FROM z GROUP BY ALL""")
def k7_positional_zip(spark: SparkSession, sf: str) -> DataFrame:
    ordered = lambda c: F.transform(F.array_sort(F.collect_list(F.struct("ord", F.col(c).alias("x")))), lambda x: x["x"])
    a = T.segments(spark, sf).withColumn("n", F.length("text")).groupBy("rec").agg(ordered("speaker").alias("s"), ordered("n").alias("n"))
    return a.select("rec", F.explode(F.arrays_zip("s", "n")).alias("z")).groupBy("rec", F.col("z.s").alias("speaker")).agg(F.sum("z.n").alias("letters"))


@query("""SELECT o_custkey, CAST(count(DISTINCT l_suppkey) AS BIGINT) AS ids FROM orders JOIN lineitem ON l_orderkey = o_orderkey GROUP BY o_custkey""")
def k8_ids_in_payload(spark: SparkSession, sf: str) -> DataFrame:
    """Distinct ids in a customer's nested orders."""
    l = T.table(spark, sf, "lineitem").groupBy("l_orderkey").agg(F.collect_set("l_suppkey").alias("ids"))
    o = T.table(spark, sf, "orders").join(l, F.col("o_orderkey") == F.col("l_orderkey")).groupBy("o_custkey").agg(F.collect_list("ids").alias("nested"))
    return o.select("o_custkey", F.size(F.array_distinct(F.flatten("nested"))).cast("long").alias("ids"))


@query(f"""WITH {SEG}, a AS (SELECT rec, list(ord ORDER BY ord) FILTER (length(text) > 200) AS s FROM seg GROUP BY rec) SELECT rec, array_to_string([x FOR x IN s IF x > 0], ',') AS kept FROM a WHERE len([x FOR x IN s IF x > 0]) > 0""")
def k11_nested_filter(spark: SparkSession, sf: str) -> DataFrame:
    a = T.segments(spark, sf).groupBy("rec").agg(F.array_sort(F.collect_list(F.struct("ord", F.length("text").alias("n")))).alias("s"))
    kept = F.transform(F.filter("s", lambda x: (x["n"] > 200) & (x["ord"] > 0)), lambda x: x["ord"])
    return a.withColumn("k", kept).where(F.size("k") > 0).select("rec", F.array_join("k", ",").alias("kept"))


@query("""SELECT p.page_id, CASE WHEN sha256(p.html) = sha256(CASE WHEN length(p.html) > 2000 THEN p.html || 'x' ELSE p.html END) THEN 'bound' ELSE 'changed' END AS outcome FROM pages p WHERE p.html IS NOT NULL""")
def k12_bound_hashes(spark: SparkSession, sf: str) -> DataFrame:
    """A hash added to a nested record, then checked against today's content."""
    p = T.table(spark, sf, "pages").where("html IS NOT NULL")
    m = p.select("page_id", "html", F.struct("url").withField("sha256", F.sha2("html", 256)).alias("frame"))
    now = F.sha2(F.when(F.length("html") > 2000, F.concat("html", F.lit("x"))).otherwise(F.col("html")), 256)
    return m.select("page_id", F.when(F.col("frame.sha256") == now, "bound").otherwise("changed").alias("outcome"))


@query(f"""WITH {FRAME}, p AS (SELECT rec, id, name, row_number() OVER (PARTITION BY rec, name ORDER BY t, id) AS place FROM fr) SELECT id, place, CASE WHEN name = 'error' THEN 'section_unknown' WHEN place > CASE name WHEN 'view' THEN 4 WHEN 'click' THEN 12 ELSE 8 END THEN 'section_full' ELSE '' END AS reason FROM p""")
def m1_section_caps(spark: SparkSession, sf: str) -> DataFrame:
    capped = claims.capped(T.frames(spark, sf), ["rec"], "name", ["t", "id"], {"view": 4, "click": 12, "purchase": 8, "signup": 8})
    return capped.select("id", "place", F.coalesce("reason", F.lit("")).alias("reason"))


@query(f"""WITH {FRAME}, b AS (SELECT *, min(t) OVER (PARTITION BY rec, name) AS f, max(t + 60000) OVER (PARTITION BY rec, name) - min(t) OVER (PARTITION BY rec, name) AS span FROM fr) SELECT id, span <= 864000000 AS whole FROM b WHERE span <= 864000000 OR t + 60000 - f <= 864000000""")
def m4_bounded_evidence(spark: SparkSession, sf: str) -> DataFrame:
    """All of a claim's evidence if its span is short enough, else what lies within that span of the first."""
    w = Window.partitionBy("rec", "name")
    b = T.frames(spark, sf).withColumn("f", F.min("t").over(w)).withColumn("span", F.max(F.col("t") + 60_000).over(w) - F.col("f"))
    return b.where("span <= 864000000 OR t + 60000 - f <= 864000000").select("id", (F.col("span") <= 864_000_000).alias("whole"))


@query(f"""WITH {TURN}, p AS (SELECT *, lag(end_ms) OVER (PARTITION BY rec ORDER BY start_ms, end_ms) AS p FROM turn), e AS (SELECT rec, start_ms, unnest(CASE WHEN start_ms < p THEN ['overlap'] ELSE [] END || CASE WHEN start_ms - p > 30000 THEN ['gap'] ELSE [] END || CASE WHEN end_ms - start_ms < 20000 THEN ['short'] ELSE [] END) AS reason FROM p) SELECT * FROM e""")
def m6_partition_errors(spark: SparkSession, sf: str) -> DataFrame:
    return claims.partition_errors(T.turns(spark, sf).select("rec", "start_ms", "end_ms"), ["rec"], 30_000, 20_000)


@query(r"""WITH n AS (SELECT doc_id, unnest(regexp_extract_all(text, '[0-9]+(?:\.[0-9]+)?')) AS n FROM documents), p AS (SELECT doc_id - 1 AS doc_id, n FROM n), m AS (SELECT DISTINCT n.doc_id, n.n FROM n ANTI JOIN p ON p.doc_id = n.doc_id AND p.n = n.n) SELECT doc_id, string_agg(n, ',' ORDER BY n) AS missing FROM m GROUP BY doc_id""")
def m8_ungrounded_numbers(spark: SparkSession, sf: str) -> DataFrame:
    """Numbers of a document that the next one lacks."""
    d = T.table(spark, sf, "documents")
    found = claims.ungrounded_numbers(d.select("doc_id", "text"), d.select((F.col("doc_id") - 1).alias("doc_id"), "text"), "doc_id")
    return found.select("doc_id", F.array_join("missing", ",").alias("missing"))


@query("""WITH c AS (SELECT event_type || ':' || user_id || CASE WHEN value > 50 THEN ':' || event_id ELSE '' END AS code FROM events), e AS (SELECT string_split(code, ':') AS p FROM c WHERE code LIKE 'error:%') SELECT CAST(p[2] AS BIGINT) AS row, coalesce(p[3], '') AS value FROM e""")
def m15_error_codes(spark: SparkSession, sf: str) -> DataFrame:
    e = T.table(spark, sf, "events").select(F.concat_ws(":", "event_type", "user_id", F.when(F.col("value") > 50, F.col("event_id"))).alias("code"))
    return claims.coded(e, "error").select("row", F.coalesce("value", F.lit("")).alias("value"))


@query(f"""WITH {TURN}, a AS (SELECT rec, row_number() OVER (PARTITION BY rec ORDER BY ord) AS i, speaker FROM seg), b AS (SELECT rec, row_number() OVER (PARTITION BY rec ORDER BY start_ms, turn) AS i, speaker FROM turn) SELECT coalesce(a.rec, b.rec) AS rec, coalesce(a.i, b.i) AS i, CASE WHEN a.i IS NULL OR b.i IS NULL THEN 'row_missing' ELSE 'owner_differs' END AS reason FROM a FULL OUTER JOIN b ON a.rec = b.rec AND a.i = b.i WHERE a.speaker IS DISTINCT FROM b.speaker""")
def n2_positional_alignment(spark: SparkSession, sf: str) -> DataFrame:
    w = Window.partitionBy("rec")
    a = T.segments(spark, sf).select("rec", F.row_number().over(w.orderBy("ord")).cast("long").alias("i"), F.col("speaker").alias("x"))
    b = T.turns(spark, sf).select("rec", F.row_number().over(w.orderBy("start_ms", "turn")).cast("long").alias("i"), F.col("speaker").alias("y"))
    both = a.join(b, ["rec", "i"], "full_outer").where(~F.col("x").eqNullSafe(F.col("y")))
    return both.select("rec", "i", F.when(F.col("x").isNull() | F.col("y").isNull(), "row_missing").otherwise("owner_differs").alias("reason"))


@query("""WITH e AS (SELECT 'keys' AS gate, count(*) AS n FROM (SELECT o_orderkey FROM orders GROUP BY 1 HAVING count(*) > 1) UNION ALL SELECT 'references', count(*) FROM lineitem ANTI JOIN orders ON o_orderkey = l_orderkey UNION ALL SELECT 'balance', count(*) FROM customer WHERE c_acctbal < 0) SELECT gate, n, n = 0 AS passed FROM e""")
def n4_publication_gates(spark: SparkSession, sf: str) -> DataFrame:
    """One relation of all gates: publish if each has no row."""
    o, l, c = (T.table(spark, sf, t) for t in ("orders", "lineitem", "customer"))
    errors = (("keys", o.groupBy("o_orderkey").count().where("count > 1")), ("references", l.join(o, F.col("o_orderkey") == F.col("l_orderkey"), "left_anti")), ("balance", c.where("c_acctbal < 0")))
    rows = [e.agg(F.count("*").alias("n")).select(F.lit(g).alias("gate"), "n", (F.col("n") == 0).alias("passed")) for g, e in errors]
    return rows[0].union(rows[1]).union(rows[2])
