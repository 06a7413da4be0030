"""The contract of minutes over a document of each customer, beside the same rules as relations of lines."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import contract
from ..sources import tables as T
from .queries import query

_W = contract.CHINESE
#: Contents of the sections, dealt to customers by key, and over how many keys a content stays.
_TITLE = (*[_W.headings[0]] * 6, _W.headings[0] + "\n## Source\n# Other")
_TOPICS = (
    "### 1. Release（00:10-20:00）\n- 现状：a\n- 讨论结果：b\n### 2. Budget（00:25:00-00:50:00）\n- 现状：a\n- 讨论结果：b",
    "### 1. Late（40:00-45:00）\n- 现状：a\n- 讨论结果：b\n### 2. Later（02:10:00-02:11:00）\n- 现状：a\n- 讨论结果：b",
    "### 1. Back（30:00-20:00）\n- 现状：a\n### 2. Wrong（00:75-01:00）\n- 讨论结果：b\n### 3. First（01:00-02:00）",
    "### Untimed\n- 现状：a\n### 1. Timed（01:00-29:00）\n- 现状：a, - 讨论结果：b",
    "- 现状：a\n\n### 1. Half（01:00）",
)
_UPDATES = (
    f"{_W.updates[0]}\n{_W.updates[1]}\n| 00:10-00:20 | Ana | P | done |\n\n| 05:00-06:00 | Ben | Q | begun |",
    _W.updates[2],
    f"{_W.updates[2]}\n| 00:10-00:20 | Ana | P | done |",
    f"{_W.updates[0]}\n| - |\n| 05:00-06:00 | speaker_2 | P | x |\n| 09:00-08:00 | Ana | | x |\n| 1:00 | Ana | P | x |\n| 01:99-02:00 | Ana | P | x |\n| 06:00-07:00 | 未知 | P | x |\n| 01:00-02:00 | Ana |\nplain\n|",
    "",
    f"{_W.updates[0]}\n{_W.updates[1]}",
)
_DECISIONS = ("- Ship it.", "", "- Ship it.\n- Test it.", "- Ship it.", "- Ship it.", "- Ship it.\n" + _W.headings[4], "- Ship it.", "- Ship it.")
_ACTIONS = (
    f"{_W.actions[0]}\n{_W.actions[1]}\n| 00:10-00:20 | test | Ana |\n| 00:30-00:40 | test | {_W.unassigned} |",
    _W.actions[2],
    f"| a | b | c |\n{_W.actions[1]}\n| 02:00-01:00 | | Ben（明天） |\n| 00:10 | test | unknown |\n| 00:10-00:20 | test | Ana | x |\n| open",
    f"{_W.actions[2]}\nmore",
    "",
)
_DEALT = ((_TITLE, 1), ((_W.headings[1],), 1), (_TOPICS, 1), ((_W.headings[2],), 1), (_UPDATES, 5), (("", _W.headings[3]), 0), (_DECISIONS, 3), ((_W.headings[4],), 1), (_ACTIONS, 2))


def _index(choices: tuple[str, ...], every: int, k: str) -> str:
    """Place of the content from 1; the one heading that is dealt at all lacks in one document of 13."""
    return f"CASE WHEN {k} % 13 = 0 THEN 1 ELSE 2 END" if not every else f"CAST(floor({k} / {every}) AS INT) % {len(choices)} + 1"


def _lit(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def _seconds(t: str) -> str:
    p = f"string_split({t}, ':')"
    at = [f"CAST({p}[{i}] AS BIGINT)" for i in (1, 2, 3)]
    return f"CASE WHEN regexp_full_match({t}, '\\d+(:[0-5]\\d){{1,2}}') THEN CASE WHEN len({p}) = 2 THEN {at[0]} * 60 + {at[1]} ELSE {at[0]} * 3600 + {at[1]} * 60 + {at[2]} END END"


def _rows_sql(j: int, name: str, words: tuple[str, str, str], width: int, marker: str) -> str:
    """Breaches that both tables share."""
    table = f"f.j = {j} AND f.n >= 3 AND f.a <> {_lit(words[2])}"
    row = f"FROM c JOIN f USING (doc, j) WHERE {table}"
    whole = f"framed AND len(cells) = {width}"
    return f"""SELECT doc, '{name}_section_empty' AS reason, 0 AS place, '' AS detail FROM f WHERE j = {j} AND n = 0
UNION ALL SELECT doc, '{marker}', 0, '' FROM f WHERE j = {j} AND n > 1 AND a = {_lit(words[2])}
UNION ALL SELECT doc, '{name}_table_incomplete', 0, '' FROM f WHERE j = {j} AND n IN (1, 2) AND a <> {_lit(words[2])}
UNION ALL SELECT doc, '{name}_table_header_invalid', 0, '' FROM f WHERE {table} AND a <> {_lit(words[0])}
UNION ALL SELECT doc, '{name}_table_separator_invalid', 0, '' FROM f WHERE {table} AND b <> {_lit(words[1])}
UNION ALL SELECT doc, '{name}_row_not_table', place, '' {row} AND NOT framed
UNION ALL SELECT doc, '{name}_row_column_count', place, CAST(len(cells) AS VARCHAR) {row} AND framed AND len(cells) <> {width}
UNION ALL SELECT doc, '{name}_row_empty_cell', place, '' {row} AND {whole} AND list_contains(cells, '')
UNION ALL SELECT doc, '{name}_time_range_invalid', place, '' {row} AND {whole} AND (s IS NULL OR e IS NULL OR e <= s)
UNION ALL SELECT doc, '{name}_time_range_out_of_bounds', place, '' {row} AND {whole} AND s IS NOT NULL AND e IS NOT NULL AND d > 0 AND (s >= d OR e > d + 0.5)"""


_TEXT = ", ".join(f"[{', '.join(map(_lit, c))}][{_index(c, n, 'c_custkey')}]" for c, n in _DEALT)
_GROUP = "'(\\d{2}:\\d{2}(?::\\d{2})?)-(\\d{2}:\\d{2}(?::\\d{2})?)'"
_SQL = rf"""WITH doc AS (SELECT c_custkey AS doc, c_custkey % 11 * 900 AS d, array_to_string([{_TEXT}], chr(10)) AS text FROM customer),
l AS (SELECT doc, d, i, trim(ls[i]) AS line FROM (SELECT doc, d, ls, unnest(range(1, len(ls) + 1)) AS i FROM (SELECT doc, d, string_split(text, chr(10)) AS ls FROM doc))),
h AS (SELECT * FROM (VALUES {', '.join(f'({j}, {_lit(x)})' for j, x in enumerate(_W.headings))}) v(j, heading)),
n AS (SELECT x.doc, x.j, x.heading, count(l.line) AS n, min(l.i) AS pos FROM (SELECT doc, j, heading FROM doc, h) x LEFT JOIN l ON l.doc = x.doc AND l.line = x.heading GROUP BY ALL),
sound AS (SELECT doc FROM n GROUP BY doc HAVING bool_and(n = 1)),
s AS (SELECT l.doc, l.d, l.i, l.line, last_value(n.j IGNORE NULLS) OVER (PARTITION BY l.doc ORDER BY l.i) AS j, n.j IS NOT NULL AS head FROM l LEFT JOIN n ON n.doc = l.doc AND n.pos = l.i WHERE l.doc IN (SELECT doc FROM sound)),
t AS (SELECT doc, d, line, row_number() OVER w AS k, regexp_matches(line, {_lit(_W.topic)}) AS timed, sum(CASE WHEN regexp_matches(line, {_lit(_W.topic)}) THEN 1 ELSE 0 END) OVER w AS topic FROM s WHERE j = 1 AND NOT head WINDOW w AS (PARTITION BY doc ORDER BY i)),
g AS (SELECT doc, d, topic, max(line) FILTER (timed) AS line, bool_or(NOT timed AND contains(line, '- 现状：')) AS state, bool_or(NOT timed AND contains(line, '- 讨论结果：')) AS result FROM t WHERE topic > 0 GROUP BY ALL),
v AS (SELECT doc, d, topic, state, result, {_seconds(f"regexp_extract(line, {_GROUP}, 1)")} AS s, {_seconds(f"regexp_extract(line, {_GROUP}, 2)")} AS e FROM g),
r AS (SELECT doc, d, s, e, row_number() OVER w AS k, lag(s) OVER w AS s0, lag(e) OVER w AS e0 FROM v WHERE s IS NOT NULL AND e IS NOT NULL WINDOW w AS (PARTITION BY doc ORDER BY topic)),
o AS (SELECT doc, d, count(*) AS n, arg_min(s, k) AS opens, arg_max(e, k) AS closes FROM r GROUP BY ALL),
q AS (SELECT doc, j, line, row_number() OVER (PARTITION BY doc, j ORDER BY i) AS k FROM s WHERE NOT head AND line <> '' AND j >= 2 AND doc IN (SELECT doc FROM o)),
f AS (SELECT o.doc, o.d, x.j, count(q.line) AS n, max(q.line) FILTER (q.k = 1) AS a, max(q.line) FILTER (q.k = 2) AS b FROM o CROSS JOIN (SELECT unnest([2, 3, 4]) AS j) x LEFT JOIN q ON q.doc = o.doc AND q.j = x.j GROUP BY ALL),
c0 AS (SELECT doc, j, k - 2 AS place, line, starts_with(line, '|') AND ends_with(line, '|') AS framed, [trim(y) FOR y IN string_split(substr(line, 2, greatest(length(line) - 2, 0)), '|')] AS cells FROM q WHERE k > 2),
c1 AS (SELECT *, CASE WHEN framed AND regexp_matches(cells[1], {_lit(contract.RANGE)}) AND len(cells) = CASE j WHEN 2 THEN 4 ELSE 3 END THEN cells[1] END AS time FROM c0),
c AS (SELECT *, {_seconds(f"regexp_extract(time, {_GROUP}, 1)")} AS s, {_seconds(f"regexp_extract(time, {_GROUP}, 2)")} AS e FROM c1),
w AS (SELECT doc, place, s, lag(s) OVER (PARTITION BY doc ORDER BY place) AS s0 FROM c JOIN f USING (doc, j) WHERE j = 2 AND s IS NOT NULL AND e IS NOT NULL AND f.n >= 3 AND f.a <> {_lit(_W.updates[2])})
SELECT doc, reason, CAST(place AS BIGINT) AS place, detail FROM (
SELECT doc, 'required_heading_count' AS reason, 0 AS place, heading || ':' || n AS detail FROM n WHERE n <> 1
UNION ALL SELECT doc, 'contract_version_mismatch', 0, 'project_updates_v4_required' FROM n WHERE j = 2 AND n = 0
UNION ALL SELECT doc, 'required_headings_out_of_order', 0, '' FROM n WHERE doc IN (SELECT doc FROM sound) GROUP BY doc HAVING list(pos ORDER BY j) <> list(pos ORDER BY pos)
UNION ALL SELECT DISTINCT doc, 'forbidden_heading', 0, line FROM l WHERE line IN ({', '.join(map(_lit, contract.FORBIDDEN))})
UNION ALL SELECT doc, 'unexpected_top_level_heading', 0, line FROM l WHERE regexp_matches(line, '^#{{1,2}}\s+') AND line NOT IN (SELECT heading FROM h)
UNION ALL SELECT doc, 'topic_heading_invalid', k, '' FROM t WHERE starts_with(line, '###') AND NOT timed
UNION ALL SELECT doc, 'no_timed_topics', 0, '' FROM sound WHERE doc NOT IN (SELECT doc FROM g)
UNION ALL SELECT doc, 'topic_missing_current_state', topic, '' FROM v WHERE NOT state
UNION ALL SELECT doc, 'topic_missing_discussion_result', topic, '' FROM v WHERE NOT result
UNION ALL SELECT doc, 'topic_timestamp_invalid', topic, '' FROM v WHERE s IS NULL OR e IS NULL
UNION ALL SELECT doc, 'topic_invalid_range', topic, '' FROM v WHERE e <= s
UNION ALL SELECT doc, 'topic_range_out_of_bounds', topic, '' FROM v WHERE s IS NOT NULL AND e IS NOT NULL AND d > 0 AND (s >= d OR e > d + 0.5)
UNION ALL SELECT doc, 'topic_not_chronological', k, '' FROM r WHERE s < s0
UNION ALL SELECT doc, 'topic_gap_too_large', k, '' FROM r WHERE s - e0 > 2700
UNION ALL SELECT doc, 'topic_coverage_too_sparse', 0, n || '<' || CAST(ceil(d / 1800) AS BIGINT) FROM o WHERE d > 0 AND n < ceil(d / 1800)
UNION ALL SELECT doc, 'opening_coverage_missing', 0, '' FROM o WHERE d > 0 AND opens > 1800
UNION ALL SELECT doc, 'closing_coverage_missing', 0, '' FROM o WHERE d > 0 AND closes < d - 1800
UNION ALL {_rows_sql(2, 'project_updates', _W.updates, 4, 'no_project_updates_marker_mixed_with_rows')}
UNION ALL SELECT doc, 'project_updates_participant_unresolved', place, '' FROM c JOIN f USING (doc, j) WHERE j = 2 AND f.n >= 3 AND f.a <> {_lit(_W.updates[2])} AND framed AND len(cells) = 4 AND regexp_matches(cells[2], {_lit(contract.NOBODY)})
UNION ALL SELECT doc, 'project_updates_not_chronological', place, '' FROM w WHERE s < s0
UNION ALL SELECT doc, 'decisions_section_empty', 0, '' FROM f WHERE j = 3 AND n = 0
UNION ALL {_rows_sql(4, 'action_items', _W.actions, 3, 'no_actions_marker_mixed_with_rows')}
UNION ALL SELECT doc, 'action_items_owner_unresolved', place, '' FROM c JOIN f USING (doc, j) WHERE j = 4 AND f.n >= 3 AND f.a <> {_lit(_W.actions[2])} AND framed AND len(cells) = 3 AND regexp_matches(cells[3], {_lit(contract.NOBODY)}) AND cells[3] <> {_lit(_W.unassigned)}
UNION ALL SELECT doc, 'action_items_owner_contains_schedule', place, '' FROM c JOIN f USING (doc, j) WHERE j = 4 AND f.n >= 3 AND f.a <> {_lit(_W.actions[2])} AND framed AND len(cells) = 3 AND regexp_matches(cells[3], {_lit(contract.DATED)}))"""


@query(_SQL)
def c15_n1_minutes_contract(spark: SparkSession, sf: str) -> DataFrame:
    """Every breach of every document; place 0 and an empty detail where a rule has none."""
    parts = [F.element_at(F.array(*map(F.lit, c)), F.expr(f"CAST({_index(c, n, 'c_custkey')} AS INT)")) for c, n in _DEALT]
    docs = T.table(spark, sf, "customer").select(F.col("c_custkey").alias("doc"), (F.col("c_custkey") % 11 * 900).alias("d"), F.array_join(F.array(*parts), "\n").alias("text"))
    return contract.breaches(docs, "doc", "text", "d").select("doc", "reason", F.coalesce("place", F.lit(0).cast("long")).alias("place"), F.coalesce("detail", F.lit("")).alias("detail"))
