"""Cues, lengths and topics of texts that are put together by each order's key, and reviews of each user's events; beside the same in plain SQL."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import actions, cues, identity
from ..sources import tables as T
from .queries import query
from .rule_queries import _NOT_MEANT, _places, _plain_cue, _re2

#: What an order's text is put together of; a part's place is key * step + key // by, modulo its length.
PARTS = (
    (37, 5, ("I will", "i'll", "I’ll", "I plan to", "I'm gonna", "I’m not gonna", "I will not", "I won't", "Let me", "Let me explain how to", "Let me continue my idea was to", "I would like to", "We need to", "I'd like us to", "Ana Lopez should", "ana  lopez will", "Ben is going to", "Do you think I will", "If it fails I need to", "If so. I intend to", "我会", "我将 不", "We want them to", "I am going to")),
    (11, 3, (" deploy", " test", " review", " send", " sleep on", " follow up on")),
    (7, 11, (" the gateway", " the invoice", " MPC keys", " the API docs", " it", " the git-lab move", " zero confirmation", " bps", " bps encryption", " the meeting notes", " a contract; business needs", " the 合同")),
    (13, 17, (" in 2", " in two", " in twenty five", " in a hundred and five", " in half an", " in half a", " in half", " in two and half", " in an", " in a couple of", " in several", " in zero", " 十五", " 二十", " 半个", " 两个", " 一百零五", " 万", " 3十", " in 1.5", " in hundred", " in two hundred", " in nineteen")),
    (19, 2, (" hours", " minutes", " hr", " min", " 小时", " 分钟", " 钟头", " days", "h", "小时", "分")),
    (29, 7, (", no downtime.", ", it requires downtime", "; I will I will check.", " and I will test it. I WILL deploy it", "? We want them to fix it.", "", "，不需要停机。", " which doesn't require a downtime", "! Ben needs to  open a file, Ana Lopez will not", ". I’ll do it, I'll do it.", ". Did you say that I will move it in 30 min?", ". If it rains, we plan to onboard it and let me say so.", ", 需要停机")),
)
OWNERS = ("Ben", "Ana Lopez", "Li (PM)")


def texts(spark: SparkSession, sf: str) -> DataFrame:
    """rec, ord (0), text, speaker, trusted."""
    k = F.col("o_orderkey")
    part = lambda step, by, of: F.element_at(F.array(*map(F.lit, of)), ((k * step + F.floor(k / by)) % len(of) + 1).cast("int"))
    o = T.table(spark, sf, "orders")
    return o.select(k.alias("rec"), F.lit(0).alias("ord"), F.concat(*[part(*p) for p in PARTS]).alias("text"), F.concat(F.lit("Clerk "), (F.col("o_custkey") % 100).cast("string")).alias("speaker"), (k % 3 > 0).alias("trusted"))


def _listed(of: tuple[str, ...]) -> str:
    return "[" + ", ".join("'" + x.replace("'", "''") + "'" for x in of) + "]"


_TEXTS = f"""spoken AS (SELECT o_orderkey AS rec, 0 AS ord, {' || '.join(f'{_listed(of)}[(o_orderkey * {step} + o_orderkey // {by}) % {len(of)} + 1]' for step, by, of in PARTS)} AS text, 'Clerk ' || o_custkey % 100 AS speaker, o_orderkey % 3 > 0 AS trusted FROM orders)"""
_PLAIN = f"""{_TEXTS}, plain AS (SELECT rec, ord, trim(regexp_replace(lower(text), '[^\\p{{L}}\\p{{N}}_]+', ' ', 'g')) AS text FROM spoken)"""
_MAP = lambda table: "MAP {" + ", ".join(f"'{k}': {v}" for k, v in table.items()) + "}"
_CLASSES = {**{k: v for k, v in actions.DIGITS.items()}, **{k: -v for k, v in actions.POWERS.items()}}


def _named(name: str, pattern: str, source: str) -> str:
    """The relations of :func:`_places` under names of their own; the last is p and the name."""
    return _places(pattern, source).replace("m AS", f"m{name} AS").replace("u AS", f"u{name} AS").replace("p AS", f"p{name} AS").replace("FROM m", f"FROM m{name}").replace("FROM u", f"FROM u{name}")


_HAS = lambda p: f"regexp_matches(text, {_re2(p)})"
_TOPICS_SQL = "list_filter([" + ", ".join(f"CASE WHEN {_HAS(p)}" + (f" AND NOT {_HAS(dict(actions.TOPICS)[actions.UNLESS[t]])}" if t in actions.UNLESS else "") + f" THEN '{t}' END" for t, p in actions.TOPICS) + "], lambda x: x IS NOT NULL)"


@query(f"""WITH {_PLAIN}, {_named('d', actions.DURATION, 'plain')}, {_named('s', actions.SIGNAL, 'plain')},
a AS (SELECT *, trim(regexp_replace(cue, {_re2(actions.ANY_UNIT)}, '')) AS n, CASE WHEN regexp_matches(cue, {_re2(actions.HOURS)}) THEN 60 ELSE 1 END AS unit FROM pd),
w AS (SELECT *, list_filter(string_split_regex(n, '\\s+'), lambda x: x NOT IN ('and', 'a', 'an', '')) AS words, list_transform(string_split(n, ''), lambda x: {_MAP(_CLASSES)}[x]) AS signs FROM a),
v AS (SELECT *, list_transform(words, lambda x: CASE WHEN x = 'hundred' THEN -1.0 ELSE {_MAP(actions.WORDS)}[x] END) AS values FROM w),
c AS (SELECT *, list_reduce(list_prepend(0, signs), lambda s, x: CASE WHEN x >= 0 THEN s - s % 10 + x ELSE (s // 10 + CASE WHEN s % 10 = 0 THEN 1 ELSE s % 10 END * -x) * 10 END) AS fold FROM v),
e AS (SELECT *, CASE WHEN regexp_full_match(n, '\\d+') THEN CAST(n AS DOUBLE) WHEN n = '半' THEN 0.5 WHEN regexp_full_match(n, '[a-z ]+') THEN
  CASE WHEN len(words) = 0 THEN 1 WHEN words = ['half'] THEN 0.5 WHEN len(list_filter(values, lambda x: x IS NULL)) = 0 THEN list_reduce(list_prepend(0.0, values), lambda s, x: CASE WHEN x < 0 THEN greatest(s, 1) * 100 ELSE s + x END) END
  WHEN len(list_filter(signs, lambda x: x IS NULL)) = 0 THEN fold // 10 + fold % 10 END AS amount FROM c),
f AS (SELECT *, CASE WHEN amount > 0 THEN CAST(round_even(amount * unit, 0) AS BIGINT) END AS minutes FROM e),
g AS (SELECT rec, list_sort(list_distinct(list(minutes))) AS minutes FROM f WHERE minutes IS NOT NULL GROUP BY rec),
b AS (SELECT ps.rec, list_sort(list_distinct(list(ps.cue))) AS bare FROM ps WHERE NOT EXISTS (FROM f WHERE f.rec = ps.rec AND minutes IS NOT NULL AND f.start <= ps.start AND ps.start + length(ps.cue) <= f.start + length(f.cue)) GROUP BY ps.rec)
SELECT plain.rec, array_to_string({_TOPICS_SQL}, ',') AS topics, coalesce(array_to_string(minutes, ','), '') AS minutes, coalesce(array_to_string(bare, ','), '') AS unparsed, CASE WHEN {_HAS(actions.NO_DOWNTIME)} THEN 'false' WHEN {_HAS(actions.DOWNTIME)} THEN 'true' ELSE '' END AS downtime
FROM plain LEFT JOIN g ON g.rec = plain.rec LEFT JOIN b ON b.rec = plain.rec""")
def d9_d12_text_attributes(spark: SparkSession, sf: str) -> DataFrame:
    """Topics, lengths in digits and in words of two languages, mentions without a value, and downtime of each order's text."""
    rows = texts(spark, sf).select("rec", identity.normal_form("text").alias("plain")).select("rec", actions.attributes(F.col("plain")).alias("x"))
    joined = lambda c: F.array_join(F.col(f"x.{c}").cast("array<string>"), ",")
    return rows.select("rec", joined("topics").alias("topics"), joined("duration_minutes").alias("minutes"), joined("unparsed_duration_mentions").alias("unparsed"), F.coalesce(F.col("x.downtime").cast("string"), F.lit("")).alias("downtime"))


_ASSIGN = rf"(?i)\b(?:Ana Lopez|Li \(PM\)|Ben){cues.ASSIGNS}\b"
_IF = f"regexp_matches(substr(text, greatest(0, start - {cues.CONDITION_REACH}) + 1, start - greatest(0, start - {cues.CONDITION_REACH})), {_re2(cues.CONDITION)})"
_ASKED = f"regexp_matches(substr(text, greatest(0, start - {cues.REPORTED_REACH}) + 1, start - greatest(0, start - {cues.REPORTED_REACH})), {_re2(cues.REPORTED)})"


@query(f"""WITH {_TEXTS}, {_named('c', cues.COMMITMENT, 'spoken')}, {_named('n', _ASSIGN, 'spoken')}, {_named('g', cues.WEAK_GROUP, 'spoken')}, {_named('s', cues.WEAK_SELF, 'spoken')},
-- of cues of one kind close together each is judged by the last one that stays
k AS (SELECT *, {_plain_cue('cue')} AS same, row_number() OVER (PARTITION BY rec ORDER BY i) AS nth FROM pc WHERE NOT ({_NOT_MEANT})),
o AS (SELECT * FROM k QUALIFY NOT coalesce(lag(same) OVER (PARTITION BY rec ORDER BY nth) = same AND start - lag(start) OVER (PARTITION BY rec ORDER BY nth) <= {cues.APART}, false)),
x AS (SELECT rec, text, start, cue, 'self' AS kind, '' AS cue_kind, 0 AS rank, NULL AS named FROM o UNION ALL
  SELECT rec, text, start, cue, 'direct_assignment', '', 1, CASE WHEN starts_with(lower(cue), 'ana') THEN 'Ana Lopez' WHEN starts_with(lower(cue), 'ben') THEN 'Ben' ELSE 'Li (PM)' END FROM pn UNION ALL
  SELECT rec, text, start, cue, 'weak_intent', 'weak_group_intent', 2, NULL FROM pg UNION ALL SELECT rec, text, start, cue, 'weak_intent', 'weak_self_intent', 2, NULL FROM ps),
y AS (SELECT x.*, speaker, trusted, {_IF} AS cond, {_ASKED} AS asked FROM (SELECT * EXCLUDE (text) FROM x) AS x JOIN spoken USING (rec)),
z AS (SELECT *, CASE rank WHEN 0 THEN CASE WHEN trusted THEN 'speaker_self_commitment' ELSE 'unresolved_speaker' END WHEN 1 THEN 'explicit_name_assignment' ELSE CASE WHEN trusted AND cue_kind = 'weak_self_intent' THEN 'speaker_weak_intent' ELSE 'unresolved_weak_intent' END END AS evidence,
  coalesce(named, CASE WHEN trusted AND cue_kind <> 'weak_group_intent' THEN speaker END, '') AS owner,
  list_filter([CASE WHEN rank = 1 THEN 'owner_acceptance_unverified' END, CASE WHEN rank = 2 THEN 'weak_intent_cue' END, CASE WHEN cue_kind = 'weak_group_intent' THEN 'owner_unresolved' END, CASE WHEN cond AND rank <> 1 THEN 'conditional_or_hypothetical' END, CASE WHEN asked AND rank = 0 THEN 'questioned_or_reported_commitment' END], lambda r: r IS NOT NULL) AS reasons FROM y)
SELECT rec, row_number() OVER (PARTITION BY rec ORDER BY start, evidence, rank) AS n, start, cue, owner, evidence, kind, cue_kind, array_to_string(reasons, ',') AS reasons FROM z""")
def k4_action_specs(spark: SparkSession, sf: str) -> DataFrame:
    """Every cue of work in each order's text, with its owner and what holds it back."""
    owners: Column = F.array(*map(F.lit, OWNERS))
    found = texts(spark, sf).select("rec", F.posexplode(actions.specs(F.col("text"), F.col("speaker"), F.col("trusted"), owners)).alias("n", "x"))
    blank = lambda c: F.coalesce(f"x.{c}", F.lit(""))
    return found.select("rec", (F.col("n") + 1).cast("long").alias("n"), "x.start", "x.cue", blank("owner").alias("owner"), "x.evidence", "x.kind", blank("cue_kind").alias("cue_kind"), F.array_join("x.reasons", ",").alias("reasons"))


_MODAL = r"(?i)\b(?:will|must|shall|needs? to)\b"


@query(f"""WITH {_TEXTS}, {_places(_MODAL, 'spoken')} SELECT rec, ord, CAST(start + 1 AS BIGINT) AS cue_at, {_IF} AS conditional FROM p""")
def c10_conditional_cues(spark: SparkSession, sf: str) -> DataFrame:
    """Every modal cue of each order's text, and whether an if-clause is open before it."""
    return actions.conditional_cues(texts(spark, sf), _MODAL)
