"""Queries on cues, names, states, records and small documents, each beside its SQL."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import columns as C
from ..operators import cues, documents, ledger, sequences
from ..sources import tables as T
from .identity_queries import NAMED, SPOKEN
from .queries import SEG, query


def _re2(pattern: str) -> str:
    """A pattern as a literal of the SQL dialect."""
    return "'" + pattern.replace("'", "''") + "'"


#: Whether what stands from a cue on is no commitment.
_NOT_MEANT = " OR ".join(f"regexp_matches(substr(text, start + 1), {_re2(p)})" for p in (cues.CONVERSATIONAL, cues.IDEA, cues.NEGATED, r"^\s*我(?:将|会)\s*不(?:[^\p{L}\p{N}_]|$)"))  # the last for want of word ends after such letters


def _plain_cue(cue: str) -> str:
    return f"trim(regexp_replace(lower({cue}), '[^a-z0-9_一-鿿]+', ' ', 'g'))"


def _places(pattern: str, source: str = "spoken") -> str:
    """Relation of rec, ord, text, i, cue, start of all matches."""
    return f"""m AS (SELECT rec, ord, text, regexp_extract_all(text, {_re2(pattern)}) AS cues, string_split_regex(text, {_re2(pattern)}) AS pieces FROM {source}),
u AS (SELECT *, unnest(range(1, len(cues) + 1)) AS i FROM m),
p AS (SELECT rec, ord, text, i, cues[i] AS cue, CAST(length(array_to_string(pieces[1:i], '')) + length(array_to_string(cues[1:i - 1], '')) AS INTEGER) AS start FROM u)"""


@query(f"""WITH {NAMED}, n AS (SELECT rec, ord, confidence, trim(regexp_replace('  ' || replace(name, ' ', '   '), '\\s+', ' ', 'g')) AS name FROM named) SELECT rec, ord, name, name <> '' AND NOT starts_with(lower(name), 'speaker ') AND lower(name) NOT IN ('unknown', 'unresolved') AND confidence >= 600 AS trusted FROM n""")
def c3_trusted_names(spark: SparkSession, sf: str) -> DataFrame:
    """Names with single spaces; trusted from a confidence on, unless anonymous. No audit takes part."""
    s = T.named_segments(spark, sf).withColumn("name", C.normal_space(F.concat(F.lit("  "), F.replace(F.col("name"), F.lit(" "), F.lit("   ")))))
    low = F.lower("name")
    return s.select("rec", "ord", "name", ((F.col("name") != "") & ~F.startswith(low, F.lit("speaker ")) & ~low.isin("unknown", "unresolved") & (F.col("confidence") >= 600)).alias("trusted"))


_LABELS = ("Speaker 3", "speaker_12", "Speakerphone", "unknown", "Unknown person", "unresolved", "Unassigned", "Ana", "", "speaker unknown")


@query(f"""WITH {SEG}, n AS (SELECT rec, ord, [{', '.join(f"'{x}'" for x in _LABELS)}][(rec + ord) % {len(_LABELS)} + 1] AS name FROM seg)
SELECT rec, ord, name <> '' AND NOT regexp_matches(name, '(?i)^(?:speaker(?:[_\\s-]*\\d+| unknown)?|unknown|unresolved|unassigned)$') AS real, name <> '' AND NOT starts_with(lower(name), 'speaker') AND lower(name) <> 'unknown' AS real_abroad FROM n""")
def c4_real_names(spark: SparkSession, sf: str) -> DataFrame:
    """Two rules of what a name is: not an anonymous label as a whole; not one that begins like one."""
    name = F.element_at(F.array(*map(F.lit, _LABELS)), ((F.col("rec") + F.col("ord")) % len(_LABELS) + 1).cast("int"))
    n = T.segments(spark, sf).withColumn("name", name)
    one = (F.col("name") != "") & ~F.col("name").rlike(r"(?i)^(?:speaker(?:[_\s-]*\d+| unknown)?|unknown|unresolved|unassigned)$")
    return n.select("rec", "ord", one.alias("real"), ((F.col("name") != "") & ~F.startswith(F.lower("name"), F.lit("speaker")) & (F.lower("name") != "unknown")).alias("real_abroad"))


_REVIEWED = ("participant_map", "manual_review", "reviewed_notes")


@query(f"""WITH {NAMED} SELECT source, count(*) FILTER (source = 'voice_registry' OR source IN {_REVIEWED}) AS trusted, count(*) FILTER (source IN {_REVIEWED}) AS above_direct, count(*) FILTER (source = 'visual_roster_avatar_match') AS roster FROM named WHERE name <> '' GROUP BY source""")
def c6_trusted_identity(spark: SparkSession, sf: str) -> DataFrame:
    """By source: trusted by a person or a registry, above a direct cue (a registry is not), and from the roster."""
    human = F.col("name_source").isin(*_REVIEWED)
    s = T.named_segments(spark, sf).where("name <> ''")
    return s.groupBy(F.col("name_source").alias("source")).agg(F.count_if((F.col("name_source") == "voice_registry") | human).alias("trusted"), F.count_if(human).alias("above_direct"), F.count_if(F.col("name_source") == "visual_roster_avatar_match").alias("roster"))


@query(f"""WITH {SPOKEN} SELECT rec, ord, regexp_matches(text, {_re2(cues.ASSURANCE)}) AND NOT regexp_matches(regexp_extract(text, {_re2(cues.ASSURANCE)}, 1), {_re2(cues.PREDICATE)}) AS incomplete FROM spoken""")
def c11_incomplete_assurances(spark: SparkSession, sf: str) -> DataFrame:
    return T.spoken(spark, sf).select("rec", "ord", cues.incomplete_assurance(F.col("text")).alias("incomplete"))


@query(f"""WITH {SPOKEN}, {_places(cues.COMMITMENT)}, k AS (SELECT rec, ord, bool_or(NOT ({_NOT_MEANT})) AS c FROM p GROUP BY ALL)
SELECT s.rec, s.ord // 4 AS block, bool_or(coalesce(c, false)) AS commits, regexp_matches(string_agg(text, ' ' ORDER BY s.ord), {_re2(cues.REQUEST)}) AS requested, regexp_matches(string_agg(text, ' ' ORDER BY s.ord), {_re2(cues.FOLLOW_UP)}) AS follow_up FROM spoken s LEFT JOIN k ON s.rec = k.rec AND s.ord = k.ord GROUP BY ALL""")
def c12_group_cues(spark: SparkSession, sf: str) -> DataFrame:
    """Cues of groups of evidence: a commitment in some row, requests and follow-ups in all texts together."""
    return cues.group_cues(T.spoken(spark, sf).withColumn("block", F.floor(F.col("ord") / 4)), ["rec", "block"], "ord")


def _context_sql(n: str, pattern: str, source: str) -> str:
    return f"""{_places(pattern, source).replace('m AS', f'm{n} AS').replace('u AS', f'u{n} AS').replace('p AS', f'p{n} AS').replace('FROM m', f'FROM m{n}').replace('FROM u', f'FROM u{n}')},
x{n} AS (SELECT rec, ord, substr(text, greatest(0, start - 48) + 1, start + length(cue) + 48 - greatest(0, start - 48)) AS c FROM p{n}),
s{n} AS (SELECT rec, ord, bool_or(regexp_matches(c, {_re2(cues.DONE)}) AND NOT regexp_matches(c, {_re2(cues.NOT_DONE)})) AS done, bool_or(regexp_matches(c, {_re2(cues.PENDING)})) AS pending FROM x{n} GROUP BY ALL)"""


@query(f"""WITH {SPOKEN}, pair AS (SELECT rec, ord, text AS said, lead(text) OVER (PARTITION BY rec ORDER BY ord) AS heard FROM spoken), said AS (SELECT rec, ord, said AS text FROM pair), heard AS (SELECT rec, ord, heard AS text FROM pair WHERE heard IS NOT NULL),
{', '.join(_context_sql(f'{k}{i}', o, k) for i, o in enumerate(cues.OPERATIONS.values()) for k in ('said', 'heard'))}
SELECT rec, ord, array_to_string(list_filter([{', '.join(f"CASE WHEN EXISTS (FROM ssaid{i} a JOIN sheard{i} b ON a.rec = b.rec AND a.ord = b.ord WHERE a.rec = pair.rec AND a.ord = pair.ord AND a.done AND b.pending AND NOT b.done) THEN '{o}' END" for i, o in enumerate(cues.OPERATIONS))}], lambda x: x IS NOT NULL), ',') AS operations FROM pair WHERE heard IS NOT NULL""")
def c13_unsupported_completions(spark: SparkSession, sf: str) -> DataFrame:
    """A row as a claim on the next one: operations said to be completed that are pending only there."""
    s = T.spoken(spark, sf).withColumn("heard", F.lead("text").over(Window.partitionBy("rec").orderBy("ord"))).where("heard IS NOT NULL")
    return s.select("rec", "ord", F.array_join(cues.unsupported_completions(F.col("text"), F.col("heard")), ",").alias("operations"))


_ERRORS = ("json_truncated", "theme:overlap", "theme:gap", "owner_missing", "evidence_unknown")


@query(f"""WITH e AS (SELECT user_id AS k, [{', '.join(f"'{x}'" for x in _ERRORS)}][event_id % {len(_ERRORS)} + 1] AS error FROM events WHERE value > 20)
SELECT k, bool_or(error = 'json_truncated') AS shorter, bool_and(starts_with(error, 'theme:')) AS topology_only, bool_or(error IN ('owner_missing', 'evidence_unknown')) AND NOT bool_or(error = 'json_truncated') AS rewrite FROM e GROUP BY k""")
def c18_repair_routes(spark: SparkSession, sf: str) -> DataFrame:
    """Where a set of errors goes: a shorter answer, a repair of ranges only, or a rewrite."""
    e = T.table(spark, sf, "events").where("value > 20").select(F.col("user_id").alias("k"), F.element_at(F.array(*map(F.lit, _ERRORS)), (F.col("event_id") % len(_ERRORS) + 1).cast("int")).alias("error"))
    cut, ranges = F.col("error") == "json_truncated", F.startswith("error", F.lit("theme:"))
    return e.groupBy("k").agg(F.bool_or(cut).alias("shorter"), F.bool_and(ranges).alias("topology_only"), (F.bool_or(F.col("error").isin("owner_missing", "evidence_unknown")) & ~F.bool_or(cut)).alias("rewrite"))


_HOSTS = ("localhost", "127.0.0.1", "[::1]", "127.9.9.9", "127.example.org", "LOCALHOST")


@query(f"""WITH h AS (SELECT page_id, CASE WHEN page_id % 3 = 0 THEN [{', '.join(f"'http://{x}:8080/v1'" for x in _HOSTS)}][page_id % {len(_HOSTS)} + 1] ELSE url END AS url FROM pages), x AS (SELECT page_id, lower(regexp_extract(url, '^[a-z]+://(\\[[^]]*\\]|[^/:]*)', 1)) AS host FROM h)
SELECT page_id, host, host IN ('localhost', '[::1]') OR regexp_matches(host, '^127(?:\\.\\d{{1,3}}){{3}}$') AS loopback FROM x""")
def c19_loopback_hosts(spark: SparkSession, sf: str) -> DataFrame:
    """Hosts of addresses, and whether they are this machine."""
    k = F.col("page_id")
    own = F.element_at(F.array(*[F.lit(f"http://{x}:8080/v1") for x in _HOSTS]), (k % len(_HOSTS) + 1).cast("int"))
    host = F.lower(F.regexp_extract(F.when(k % 3 == 0, own).otherwise(F.col("url")), r"^[a-z]+://(\[[^]]*\]|[^/:]*)", 1))
    return T.table(spark, sf, "pages").select("page_id", host.alias("host")).withColumn("loopback", F.col("host").isin("localhost", "[::1]") | F.col("host").rlike(r"^127(?:\.\d{1,3}){3}$"))


@query("""SELECT o_orderkey AS k, o_orderstatus = 'F' AND o_totalprice > 0 AND o_orderpriority NOT LIKE '1%' AS succeeded FROM orders""")
def c20_review_states(spark: SparkSession, sf: str) -> DataFrame:
    """A state is a success only if it is final, has a result and bears no error."""
    return T.table(spark, sf, "orders").select(F.col("o_orderkey").alias("k"), ((F.col("o_orderstatus") == "F") & (F.col("o_totalprice") > 0) & ~F.startswith("o_orderpriority", F.lit("1"))).alias("succeeded"))


@query("""SELECT page_id, sha256(html) AS sha, CAST(octet_length(encode(html)) AS BIGINT) AS size FROM pages WHERE html IS NOT NULL""")
def d8_content_hashes(spark: SparkSession, sf: str) -> DataFrame:
    """Provenance of contents: digest and bytes. Of files: the same of the source ``binaryFile``."""
    return T.table(spark, sf, "pages").where("html IS NOT NULL").select("page_id", F.sha2(F.col("html").cast("binary"), 256).alias("sha"), F.octet_length("html").cast("long").alias("size"))


_CLOCK = "CASE WHEN {0} >= 3600 THEN printf('%02d:%02d:%02d', {0} // 3600, {0} % 3600 // 60, {0} % 60) ELSE printf('%02d:%02d', {0} // 60, {0} % 60) END"
_LINES = f"""lines AS (SELECT rec, ord, '[' || {_CLOCK.format('(start_ms // 1000)')} || '-' || {_CLOCK.format('(end_ms // 1000)')} || '] ' || speaker || ': ' || text AS line, end_ms - start_ms AS duration FROM seg)"""


def _lines(spark: SparkSession, sf: str) -> DataFrame:
    s = T.segments(spark, sf)
    times = [C.clock(F.floor(F.col(c) / 1000)) for c in ("start_ms", "end_ms")]
    return s.select("rec", "ord", F.concat(F.lit("["), times[0], F.lit("-"), times[1], F.lit("] "), F.col("speaker"), F.lit(": "), F.col("text")).alias("line"), (F.col("end_ms") - F.col("start_ms")).alias("duration"))


@query(f"""WITH {SEG}, {_LINES} SELECT * FROM lines""")
def d20_lines(spark: SparkSession, sf: str) -> DataFrame:
    return _lines(spark, sf)


#: Headings and line beginnings of a document in English, and the same in the contract's language.
_VOCABULARY = {"# Meeting Minutes": "# 会议纪要", "## Topics and Outcomes": "## 议题与结论", "## Project Updates": "## 项目进展", "## Confirmed Decisions": "## 已确认决定", "## Action Items": "## 行动项"}
_BEGINNINGS = {"- Current state:": "- 现状：", "- Outcome:": "- 讨论结果：", "- Next step:": "- 下一步："}
_DRAFT = (*_VOCABULARY, "  ## Action Items  ", "- Outcome: agreed", "- Next step:  to send", "- Current state:open", "### Plan (00:10-01:20)", "plain words", "## Action items")


@query(f"""WITH l AS (SELECT event_id, [{', '.join(f"'{x}'" for x in _DRAFT)}][event_id % {len(_DRAFT)} + 1] AS line FROM events), t AS (SELECT *, trim(line) AS t FROM l)
SELECT event_id, CASE {' '.join(f"WHEN t = '{a}' THEN '{b}'" for a, b in _VOCABULARY.items())} {' '.join(f"WHEN starts_with(t, '{a}') THEN '{b}' || ltrim(substr(t, {len(a) + 1}))" for a, b in _BEGINNINGS.items())}
WHEN regexp_matches(t, '^### .+ \\([0-9:]+-[0-9:]+\\)$') THEN regexp_replace(t, ' \\(([0-9:]+-[0-9:]+)\\)$', '（\\1）') ELSE line END AS line FROM t""")
def d30_vocabulary(spark: SparkSession, sf: str) -> DataFrame:
    """Lines in the contract's vocabulary: whole lines by a map, beginnings, and headings with times; all others stay."""
    line = F.element_at(F.array(*map(F.lit, _DRAFT)), (F.col("event_id") % len(_DRAFT) + 1).cast("int"))
    words = F.create_map(*[F.lit(x) for p in _VOCABULARY.items() for x in p])
    t = F.trim("line")
    out = F.try_element_at(words, t)
    for a, b in _BEGINNINGS.items():
        out = F.coalesce(out, F.when(F.startswith(t, F.lit(a)), F.concat(F.lit(b), F.ltrim(F.substring(t, F.lit(len(a) + 1), F.length(t))))))
    heading = r" \(([0-9:]+-[0-9:]+)\)$"
    out = F.coalesce(out, F.when(t.rlike(r"^### .+" + heading), F.regexp_replace(t, heading, "（$1）")), F.col("line"))
    return T.table(spark, sf, "events").select("event_id", line.alias("line")).select("event_id", out.alias("line"))


@query(f"""WITH {SPOKEN} SELECT rec, ord, sha256(text) AS content_hash, CASE WHEN name <> 'Speaker 1' AND confidence >= 600 THEN name ELSE speaker END AS label, name <> 'Speaker 1' AND confidence >= 600 AS trusted, contains(lower(text), 'downtime') AS speaks_of_downtime FROM spoken""")
def k1_segment_records(spark: SparkSession, sf: str) -> DataFrame:
    """Each row as a record: digest of its text, the trusted name or else the label, attributes."""
    trusted = C.is_named(F.col("name")) & (F.col("confidence") >= 600)
    return T.spoken(spark, sf).select("rec", "ord", F.sha2("text", 256).alias("content_hash"), F.when(trusted, F.col("name")).otherwise(F.col("speaker")).alias("label"), trusted.alias("trusted"), ledger.downtime(F.col("text")).isNotNull().alias("speaks_of_downtime"))


@query(f"""WITH {SPOKEN}, {_places(cues.COMMITMENT)}, k AS (SELECT *, row_number() OVER w AS n, lag(start) OVER w AS before, lag({_plain_cue('cue')}) OVER w AS same FROM p WHERE NOT ({_NOT_MEANT}) WINDOW w AS (PARTITION BY rec, ord ORDER BY i))
SELECT rec, ord, start, cue FROM k WHERE NOT coalesce(same = {_plain_cue('cue')} AND start - before <= 16, false)""")
def k2_commitments(spark: SparkSession, sf: str) -> DataFrame:
    """Commitments with their places; a cue that comes again at once counts once."""
    return T.spoken(spark, sf).select("rec", "ord", F.explode(cues.commitments(F.col("text"))).alias("x")).select("rec", "ord", "x.start", "x.cue")


_QUOTES = "(?i)\\b(?:i will|i''ll|i need to|let me)\\b"
_WEAK = "(?i)\\b(?:i might|maybe i|i could)\\b"


_TOPICS = {"release": "release|deploy", "testing": "test|verify", "maintenance": "maintenance|restart|downtime"}


def _topics(text: str) -> str:
    cases = ", ".join(f"CASE WHEN regexp_matches({text}, '(?i)\\b(?:{w})\\b') THEN '{t}' END" for t, w in _TOPICS.items())
    return f"list_filter([{cases}], lambda x: x IS NOT NULL)"


_LEDGER = f"""q AS (SELECT rec, ord, name, text, 'self' AS kind, unnest(string_split(regexp_replace(text, '({_QUOTES})', chr(1) || '\\1', 'g'), chr(1))[2:]) AS raw FROM spoken UNION ALL SELECT rec, ord, name, text, 'weak', unnest(string_split(regexp_replace(text, '({_WEAK})', chr(1) || '\\1', 'g'), chr(1))[2:]) FROM spoken),
c AS (SELECT rec, ord, name, kind, trim(raw, ' ' || chr(9) || ',;:.-') AS quote, text FROM q),
ledger AS (SELECT rec, ord, kind, quote, {_topics('quote')} AS topics, array_to_string(list_sort(list_filter([CASE WHEN regexp_matches(text, '(?i)\\bif\\b[^.!?]*$') AND NOT regexp_matches(quote, '(?i)\\bif\\b') THEN 'conditional' END, CASE WHEN name = 'Speaker 1' THEN 'owner_unknown' END, CASE WHEN len({_topics('quote')}) <> 1 THEN 'topic_not_single' END, CASE WHEN kind = 'weak' THEN 'weak_intent' END], lambda x: x IS NOT NULL)), ',') AS reasons FROM c)"""


@query(f"""WITH {SPOKEN}, {_LEDGER} SELECT rec, ord, kind, quote, array_to_string(topics, ',') AS topics, CASE WHEN reasons = '' THEN 'accepted' ELSE 'review' END AS status, reasons FROM ledger""")
def k5_ledger(spark: SparkSession, sf: str) -> DataFrame:
    """The ledger over all spoken rows: every candidate, its status and what holds it back."""
    found = ledger.candidates(T.spoken(spark, sf).select("rec", "ord", "name", "text"))
    return found.select("rec", "ord", "kind", "quote", F.array_join("topics", ",").alias("topics"), "status", F.array_join("reasons", ",").alias("reasons"))


@query(f"""WITH {SPOKEN}, {_LEDGER} SELECT CASE WHEN reasons = '' THEN 'accepted' ELSE 'review' END AS section, count(*) AS n FROM ledger GROUP BY ALL UNION ALL SELECT 'constraints', count(*) FROM spoken WHERE contains(lower(text), 'downtime') AND len({_topics('text')}) = 1""")
def b5_ledger_sections(spark: SparkSession, sf: str) -> DataFrame:
    """Rows of each of the ledger's sections; K6's facts are the third."""
    rows = T.spoken(spark, sf).select("rec", "ord", "name", "text")
    c = ledger.candidates(rows).select(F.col("status").alias("section"))
    return c.unionByName(ledger.constraints(rows).select(F.lit("constraints").alias("section"))).groupBy("section").agg(F.count("*").alias("n"))


@query(f"""WITH {SPOKEN}, {_LEDGER}, i AS (SELECT rec, ord, row_number() OVER (PARTITION BY rec, ord ORDER BY kind, quote) AS i, topics FROM ledger)
SELECT rec, ord, i, CASE ord % 4 WHEN 1 THEN 'candidate_unknown' ELSE array_to_string(list_filter([CASE WHEN ord % 4 = 2 THEN 'quote_changed' END, CASE WHEN NOT list_contains(topics, 'release') THEN 'topic_added' END, CASE WHEN ord % 4 = 3 THEN 'duration_added' END], lambda x: x IS NOT NULL), ',') END AS reasons FROM i""")
def e18_published_items(spark: SparkSession, sf: str) -> DataFrame:
    """Every candidate as a published item on releases: as it is (in another case), under an unknown id, with another text, with a length more."""
    known = ledger.candidates(T.spoken(spark, sf).select("rec", "ord", "name", "text"))
    k = F.col("ord") % 4
    items = known.withColumn("i", F.row_number().over(Window.partitionBy("rec", "ord").orderBy("kind", "quote")))
    items = items.select(F.concat_ws("/", "rec", "ord", "i").alias("item"), F.when(k == 1, "action-0").otherwise(F.col("id")).alias("id"), F.when(k == 2, "other").otherwise(F.upper("quote")).alias("text"), F.array(F.lit("release")).alias("topics"), F.when(k == 3, F.array(F.lit(7777).cast("long"))).otherwise(F.array().cast("array<bigint>")).alias("minutes"))
    part = F.split("item", "/")
    # equal quotes of one row have one id
    found = ledger.published_errors(items, known.dropDuplicates(["id"]))
    return found.select(part[0].cast("long").alias("rec"), part[1].cast("long").alias("ord"), part[2].cast("int").alias("i"), F.array_join("reasons", ",").alias("reasons"))


@query("""SELECT event_id, CASE event_id % 4 WHEN 3 THEN -1 ELSE CAST(event_id % 5 AS INTEGER) END AS n FROM events""")
def d26_fenced_json(spark: SparkSession, sf: str) -> DataFrame:
    """Samples in an answer's JSON, with words around it, with a fence, alone; -1 is no JSON."""
    k = F.col("event_id")
    body = F.concat(F.lit('{"samples": ['), F.array_join(F.transform(F.sequence(F.lit(1), F.lit(5)), lambda i: F.when(i <= k % 5, F.format_string('{"id": %d}', i))), ", "), F.lit("]}"))
    text = F.when(k % 4 == 0, F.concat(F.lit("So:\n```json\n"), body, F.lit("\n```"))).when(k % 4 == 1, F.concat(F.lit("Here it is: "), body, F.lit(" as asked."))).when(k % 4 == 2, body).otherwise("none [1, 2]")
    found = F.regexp_extract("text", r"(?s)(\{.*\})", 1)
    n = F.json_array_length(F.get_json_object(found, "$.samples"))
    return T.table(spark, sf, "events").select("event_id", text.alias("text")).select("event_id", F.coalesce(n, F.lit(-1)).alias("n"))


_PARTS = ("## Topics", "| 00:00 | a |", "## Actions", "plain")


@query(f"""WITH l AS (SELECT o_custkey AS doc, o_orderkey AS k, [{', '.join(f"'{x}'" for x in _PARTS)}][o_orderkey % 4 + 1] AS line FROM orders WHERE o_orderkey % 3 <> 0), h AS (SELECT doc, coalesce(list(substr(line, 4) ORDER BY k) FILTER (starts_with(line, '## ')), []) AS heads FROM l GROUP BY doc)
SELECT doc, CASE WHEN NOT (list_contains(heads, 'Topics') AND list_contains(heads, 'Actions')) THEN 'heading_missing' ELSE 'heading_order' END AS reason FROM h WHERE heads <> ['Topics', 'Actions']""")
def n1_heading_contract(spark: SparkSession, sf: str) -> DataFrame:
    """Documents whose headings aren't the contract's, in order: each customer's orders are the lines of one."""
    line = F.element_at(F.array(*map(F.lit, _PARTS)), (F.col("o_orderkey") % 4 + 1).cast("int"))
    rows = T.table(spark, sf, "orders").where("o_orderkey % 3 <> 0").select(F.col("o_custkey").alias("doc"), F.col("o_orderkey").alias("line_no"), line.alias("line"))
    return documents.heading_errors(rows.withColumn("heading", F.substring("line", 4, 100)), "doc", ["Topics", "Actions"])


@query(f"""WITH {NAMED} SELECT rec, ord, CAST(start_ms AS DOUBLE) / 1000 AS start, speaker, CASE WHEN source NOT IN ('', 'ocr_candidates_only') AND name <> 'Speaker 1' THEN name ELSE '' END AS name, confidence FROM named""")
def k10_ledger_rows(spark: SparkSession, sf: str) -> DataFrame:
    """Records as the ledger's rows: a name only where the identity isn't anonymous."""
    named = ~F.col("name_source").isin("", "ocr_candidates_only") & C.is_named(F.col("name"))
    return T.named_segments(spark, sf).select("rec", "ord", (F.col("start_ms").cast("double") / 1000).alias("start"), "speaker", F.when(named, F.col("name")).otherwise("").alias("name"), "confidence")


_PEOPLE = ("Ana", "Ben", "Person 1")


@query(f"""WITH {SPOKEN} SELECT rec, ord, array_to_string(list_filter([{', '.join(f"CASE WHEN regexp_matches(text, {_re2(f'(?i){n}[^。.!?]{{0,28}}{cues.FUTURE}')}) THEN '{n}' END" for n in _PEOPLE)}], lambda x: x IS NOT NULL), ',') AS owners FROM spoken""")
def m9_future_owners(spark: SparkSession, sf: str) -> DataFrame:
    return T.spoken(spark, sf).select("rec", "ord", F.array_join(cues.future_owners(F.col("text"), _PEOPLE), ",").alias("owners"))


@query(f"""WITH {SPOKEN}, {_places(cues.WEAK_INTENT)} SELECT rec, ord, start, cue FROM p WHERE NOT regexp_matches(text, '{_QUOTES}')""")
def i6_recall_signals(spark: SparkSession, sf: str) -> DataFrame:
    """Weak intents of rows that gave no candidate."""
    s = T.spoken(spark, sf)
    return cues.recall_signals(s, ledger.candidates(s.select("rec", "ord", "name", "text")).where("kind = 'self'"), ["rec", "ord"])


@query(f"""WITH {SEG}, c AS (SELECT rec, ord // 8 AS chunk, min(start_ms) AS a, max(end_ms) AS b FROM seg GROUP BY ALL), f AS (SELECT rec, ord, start_ms + (ord % 3) * 400 AS t FROM seg) SELECT c.rec, c.chunk, count(*) AS frames, min(t) AS first FROM c JOIN f ON f.rec = c.rec AND t BETWEEN a AND b GROUP BY ALL""")
def e13_frames_of_chunks(spark: SparkSession, sf: str) -> DataFrame:
    """Frames with a time in a chunk, ends included: both sides go by stretches of a minute, a frame is in one of them."""
    s = T.segments(spark, sf)
    minute = F.lit(60_000)
    c = s.groupBy("rec", F.floor(F.col("ord") / 8).alias("chunk")).agg(F.min("start_ms").alias("a"), F.max("end_ms").alias("b"))
    c = c.withColumn("k", F.explode(F.sequence(F.floor(F.col("a") / minute), F.floor(F.col("b") / minute))))
    f = s.select("rec", (F.col("start_ms") + F.col("ord") % 3 * 400).alias("t")).withColumn("k", F.floor(F.col("t") / minute))
    return f.join(c, ["rec", "k"]).where("t BETWEEN a AND b").groupBy("rec", "chunk").agg(F.count("*").alias("frames"), F.min("t").alias("first"))


@query(f"""WITH RECURSIVE {SEG}, {_LINES}, s AS (SELECT rec, ord, length(line) + 1 AS n, row_number() OVER (PARTITION BY rec ORDER BY ord) AS i FROM lines), k AS (
SELECT rec, ord, i, n AS used, 0 AS chunk FROM s WHERE i = 1 UNION ALL SELECT s.rec, s.ord, s.i, CASE WHEN k.used + s.n <= 1500 THEN k.used + s.n ELSE s.n END, CASE WHEN k.used + s.n <= 1500 THEN chunk ELSE chunk + 1 END FROM k JOIN s ON s.rec = k.rec AND s.i = k.i + 1) SELECT rec, ord, CAST(chunk AS BIGINT) AS chunk FROM k""")
def g19_line_chunks(spark: SparkSession, sf: str) -> DataFrame:
    """Rows packed by the length of their lines, each with its line end."""
    return sequences.packed(_lines(spark, sf), ["rec"], "ord", F.length("line") + 1, 1500).select("rec", "ord", "chunk")


@query("""SELECT item_id, regexp_replace(text, '\\s+$', '') AS text FROM benchmark""")
def b2_text_documents(spark: SparkSession, sf: str) -> DataFrame:
    """Documents as text files, a folder of its own for each write (so that nothing is replaced in place), and read back."""
    b = T.table(spark, sf, "benchmark")
    path = f"{T.scratch(spark)}/text-{uuid.uuid4().hex}"
    one = F.concat(F.col("item_id").cast("string"), F.lit("\t"), F.regexp_replace(F.regexp_replace("text", r"\s+$", ""), "\n", "\x01"))
    b.select(one.alias("value")).write.text(path)
    part = F.split("value", "\t", 2)
    return spark.read.text(path).select(part[0].cast("long").alias("item_id"), F.replace(part[1], F.lit("\x01"), F.lit("\n")).alias("text"))


_BOXES = "map<string, map<string, struct<x: double, y: double, width: double, height: double>>>"


@query("""SELECT event_id, 'm' || event_id % 3 AS mode, 'tile ' || event_id % 5 AS label, (event_id % 7) / 10.0::DOUBLE AS x, CASE WHEN (event_id % 7) / 10.0::DOUBLE + (event_id % 6) / 10.0::DOUBLE > 1 THEN 'box_outside' WHEN event_id % 6 = 0 THEN 'box_empty' ELSE '' END AS error FROM events""")
def a19_boxes(spark: SparkSession, sf: str) -> DataFrame:
    """Profiles as JSON (mode → label → box), read with a schema, one row a box, with what is wrong with it."""
    k = F.col("event_id")
    text = F.format_string('{"m%d": {"tile %d": {"x": %s, "y": 0.0, "width": %s, "height": 0.5}}}', k % 3, k % 5, ((k % 7) / 10).cast("string"), ((k % 6) / 10).cast("string"))
    e = T.table(spark, sf, "events").select("event_id", F.explode(F.from_json(text, _BOXES)).alias("mode", "labels")).select("event_id", "mode", F.explode("labels").alias("label", "box"))
    error = F.when(F.col("box.x") + F.col("box.width") > 1, "box_outside").when(F.col("box.width") <= 0, "box_empty").otherwise("")
    return e.select("event_id", "mode", "label", F.col("box.x").alias("x"), error.alias("error"))


@query(f"""WITH {SEG} SELECT rec, speaker, ord, CASE WHEN ord % 2 = 0 THEN 'range ' || ord ELSE 'label' END AS label, CAST(start_ms AS DOUBLE) / 1000 AS time FROM seg""")
def a22_samples(spark: SparkSession, sf: str) -> DataFrame:
    """Samples that come as objects or as pairs: JSON of both kinds, read as one relation."""
    s, time = T.segments(spark, sf), (F.col("start_ms").cast("double") / 1000).cast("string")
    text = F.when(F.col("ord") % 2 == 0, F.concat(F.lit('{"range": "range '), F.col("ord").cast("string"), F.lit('", "time": '), time, F.lit("}"))).otherwise(F.concat(F.lit('["label", "'), time, F.lit('"]')))
    s = s.select("rec", "speaker", "ord", text.alias("t"))
    whole, pair = F.from_json("t", "range string, label string, time double"), F.from_json("t", "array<string>")
    is_pair = F.startswith("t", F.lit("["))
    return s.select("rec", "speaker", "ord", F.when(is_pair, pair[0]).otherwise(F.coalesce(whole["range"], whole["label"])).alias("label"), F.when(is_pair, pair[1].cast("double")).otherwise(whole["time"]).alias("time"))


_WINDOWS = f"""w AS (SELECT rec, ord, start_ms AS a, CASE WHEN ord % 5 = 4 THEN NULL ELSE end_ms - (ord % 4) * 30000 + (ord % 3) * 2000 END AS b FROM seg)"""


@query(f"""WITH {SEG}, {_WINDOWS}, o AS (SELECT *, lag(b) OVER (PARTITION BY rec ORDER BY a, ord) AS before, lag(ord) OVER (PARTITION BY rec ORDER BY a, ord) IS NOT NULL AS has FROM w) SELECT rec, ord, b IS NOT NULL AND b <= a AS empty, has AND (before IS NULL OR before > a) AS overlaps FROM o""")
def a13_layout_windows(spark: SparkSession, sf: str) -> DataFrame:
    """A profile's windows (no end: open): those that end before they start, and those that the one before reaches into."""
    ord_ = F.col("ord")
    w = T.segments(spark, sf).select("rec", "ord", F.col("start_ms").alias("a"), F.when(ord_ % 5 != 4, F.col("end_ms") - ord_ % 4 * 30000 + ord_ % 3 * 2000).alias("b"))
    order = Window.partitionBy("rec").orderBy("a", "ord")
    before, first = F.lag(F.struct("b")).over(order), F.row_number().over(order) == 1
    return w.select("rec", "ord", F.coalesce(F.col("b") <= F.col("a"), F.lit(False)).alias("empty"), (~first & (before["b"].isNull() | (before["b"] > F.col("a")))).alias("overlaps"))
