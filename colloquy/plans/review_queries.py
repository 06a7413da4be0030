"""Reviews and proposed minutes of each user's events, with faults of every kind, their reasons and one round of repair, beside the same in plain SQL."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import cues, minutes, repairs
from ..sources import tables as T
from . import topic_queries
from .queries import FRAME, query
from .rule_queries import _NOT_MEANT, _places, _re2

#: What rows say, who is named, and what actions are called; dealt by key.
SAID = ("I will review the latest invoice.", "The build is green.", "I'll send the notes.", "We selected the single path.", "Agreed, sounds good.", "I won't do it.", "Let me see.", "Let me test it, we agreed.")
PEOPLE = ("Billy", "Xin", "Ana", "Speaker 1")
ITEMS = ("review the invoice", "看发票，并 发送发票", "test the gateway and send it", "send the notes", "plan; 然后 部署它", "note it", "review the invoices")


def records(spark: SparkSession, sf: str) -> DataFrame:
    r = topic_queries.records(spark, sf)
    of = lambda values, at: F.element_at(F.array(*map(F.lit, values)), (at % len(values) + 1).cast("int"))
    return r.select(F.col("rec").alias("doc"), "pos", "id", "start", "end", of(PEOPLE, F.col("pos")).alias("speaker"), of(SAID, F.col("pos") * 3 + F.col("rec")).alias("text"))


def reviews(records: DataFrame) -> DataFrame:
    """Four actions, candidates, dispositions and updates and three decisions of each recording."""
    n = records.groupBy("doc").agg(F.count("*").alias("n"))
    of = lambda values, at: F.element_at(F.array(*map(F.lit, values)), (at % len(values) + 1).cast("int"))
    hash_ = lambda k, salt: (F.col("doc") * 7919 + k * 104_729 + salt * 1_299_709) % 1_000_003

    def ids(h: Column) -> Column:
        name = lambda p: F.concat(F.lit("r"), "doc", F.lit("_"), p.cast("string"))
        p = F.floor(h / 7) % F.col("n")
        return F.when(h % 4 == 0, F.array(name(p))).when(h % 6 == 1, F.array(name(p), name((p + 30) % F.col("n")))).otherwise(F.array(name(p), name((p + h % 5) % F.col("n")), F.lit("none")))

    each = lambda most, f: F.transform(F.sequence(F.lit(1).cast("long"), F.lit(most).cast("long")), f)
    work = lambda h: (of(PEOPLE, h).alias("owner"), of(ITEMS, F.floor(h / 3)).alias("item"), ids(h).alias("ids"), F.when(h % 3 < 2, "self_commitment").otherwise("accepted_assignment").alias("basis"))

    def candidate(c: Column) -> Column:
        h = F.when(hash_(c, 2) % 3 == 0, hash_(c, 1)).otherwise(hash_(c, 2))
        return F.struct(*work(h), (hash_(c, 2) % 2 == 0).alias("must_keep"))

    def disposition(c: Column) -> Column:
        h = hash_(c, 3)
        kept = h % 4 > 0
        return F.struct(c.cast("int").alias("c"), kept.alias("kept"), F.when(kept, 1 + F.floor(h / 4) % 4).cast("int").alias("k"), F.when(kept, "supported").otherwise("unsupported_item").alias("code"), F.repeat(F.lit("x"), (h % 150).cast("int")).alias("reason"))

    def update(k: Column) -> Column:
        h = hash_(k, 4)
        return F.struct(of(PEOPLE, h).alias("participant"), F.when(h % 2 == 0, repairs.FOLLOW_UP).otherwise("P").alias("project"), F.concat(F.lit("update "), k.cast("string")).alias("text"), ids(h).alias("ids"))

    return n.select(
        "doc",
        each(4, lambda k: F.struct(*work(hash_(k, 1)))).alias("actions"),
        each(4, candidate).alias("candidates"),
        each(4, disposition).alias("dispositions"),
        each(4, update).alias("updates"),
        each(3, lambda k: F.struct(F.concat(F.lit("decision "), k.cast("string")).alias("text"), ids(hash_(k, 5)).alias("ids"))).alias("decisions"),
        each(3, lambda k: F.struct(k.cast("int").alias("k"), ids(hash_(k, 6)).alias("ids"), F.when(hash_(k, 6) % 2 == 0, "explicit_agreement").otherwise("selected_direction").alias("basis"))).alias("decision_supports"),
    )


def _list(of: tuple[str, ...]) -> str:
    return "[" + ", ".join("'" + x.replace("'", "''") + "'" for x in of) + "]"


def _of(values: tuple[str, ...], at: str) -> str:
    return f"{_list(values)}[({at}) % {len(values)} + 1]"


def _hash(k: str, salt: int) -> str:
    return f"((doc * 7919 + {k} * 104729 + {salt} * 1299709) % 1000003)"


_IDS = "CASE WHEN h % 4 = 0 THEN [h // 7 % n] WHEN h % 6 = 1 THEN [h // 7 % n, (h // 7 % n + 30) % n] ELSE [h // 7 % n, (h // 7 % n + h % 5) % n] END"
_WORK = f"{_of(PEOPLE, 'h')} AS owner, {_of(ITEMS, 'h // 3')} AS item, {_IDS} AS ids, CASE WHEN h % 3 < 2 THEN 'self_commitment' ELSE 'accepted_assignment' END AS basis"

# ids are positions here; the id of no row is left out, as no rule asks for it
_REVIEWS = f"""{FRAME}, texts AS (SELECT x AS rec, 0 AS ord, {_list(SAID)}[x + 1] AS text FROM unnest(range({len(SAID)})) AS q(x)), {_places(cues.COMMITMENT, 'texts')},
says AS (SELECT texts.rec AS x, texts.text, coalesce(bool_or(NOT ({_NOT_MEANT.replace('text', 'p.text')})), false) AS commits FROM texts LEFT JOIN p ON p.rec = texts.rec GROUP BY ALL),
r AS (SELECT f.rec AS doc, pos, (pos * 20000 + id * 7919 % 7000) / 1000.0 AS a, (pos * 20000 + id * 7919 % 7000 + CASE WHEN id % 5 = 0 THEN 20000 ELSE 10000 + id * 31 % 5000 END) / 1000.0 AS b, {_of(PEOPLE, 'pos')} AS who, commits, regexp_matches(text, {_re2(repairs.AGREES)}) AS agrees, regexp_matches(text, {_re2(repairs.SELECTS)}) AS selects
  FROM (SELECT *, row_number() OVER (PARTITION BY rec ORDER BY t, id) - 1 AS pos FROM fr) AS f JOIN says ON says.x = (pos * 3 + f.rec) % {len(SAID)}),
docs AS (SELECT doc, count(*) AS n FROM r GROUP BY doc), four AS (SELECT *, unnest(range(1, 5)) AS k FROM docs), three AS (SELECT *, unnest(range(1, 4)) AS k FROM docs),
ac AS (SELECT doc, k, {_WORK} FROM (SELECT *, {_hash('k', 1)} AS h FROM four)),
ca AS (SELECT doc, k AS c, {_WORK}, must FROM (SELECT *, {_hash('k', 2)} % 2 = 0 AS must, CASE WHEN {_hash('k', 2)} % 3 = 0 THEN {_hash('k', 1)} ELSE {_hash('k', 2)} END AS h FROM four)),
di AS (SELECT doc, k AS c, h % 4 > 0 AS kept, CASE WHEN h % 4 > 0 THEN 1 + h // 4 % 4 END AS k, h % 150 AS size FROM (SELECT *, {_hash('k', 3)} AS h FROM four)),
up AS (SELECT doc, k, {_of(PEOPLE, 'h')} AS who, CASE WHEN h % 2 = 0 THEN '{repairs.FOLLOW_UP}' ELSE 'P' END AS project, {_IDS} AS ids FROM (SELECT *, {_hash('k', 4)} AS h FROM four)),
su AS (SELECT doc, k, {_IDS} AS ids, CASE WHEN h % 2 = 0 THEN 'explicit_agreement' ELSE 'selected_direction' END AS basis FROM (SELECT *, {_hash('k', 6)} AS h FROM three)),
acr AS (SELECT ac.doc, ac.k, max(b) - min(a) AS span, coalesce(bool_or(who = owner AND commits), false) AS ground FROM (SELECT *, unnest(ids) AS pos FROM ac) AS ac JOIN r ON r.doc = ac.doc AND r.pos = ac.pos GROUP BY ALL),
upr AS (SELECT up.doc, up.k, up.who, max(b) FILTER (r.who = up.who) - min(a) FILTER (r.who = up.who) AS span, count(*) FILTER (r.who = up.who) AS own FROM (SELECT *, unnest(ids) AS pos FROM up) AS up JOIN r ON r.doc = up.doc AND r.pos = up.pos GROUP BY ALL),
kept AS (SELECT di.doc, di.c, di.k, owner, item, ids, basis FROM di JOIN ca ON ca.doc = di.doc AND ca.c = di.c WHERE kept AND must),
er AS (SELECT doc, 'action:' || k || ':evidence_span_too_wide' AS code, 'wide' AS kind, k FROM acr WHERE span > {repairs.SPAN}
  UNION ALL SELECT doc, 'action:' || k || ':atomicity_review_required', 'atomic', k FROM ac WHERE regexp_matches(item, {_re2(repairs.SECOND_TASK)})
  UNION ALL SELECT ac.doc, 'publication_gate_action_support:' || ac.k || ':self_commitment_not_grounded', 'invalid', ac.k FROM ac JOIN acr ON acr.doc = ac.doc AND acr.k = ac.k WHERE basis = 'self_commitment' AND NOT ground
  UNION ALL SELECT di.doc, 'publication_gate_candidate_disposition:' || di.c || ':must_keep_candidate_rejected', 'rejected', di.c FROM di JOIN ca ON ca.doc = di.doc AND ca.c = di.c WHERE NOT kept AND must
  UNION ALL SELECT doc, 'publication_gate_candidate_disposition:' || c || ':must_keep_candidates_collapsed:' || k, 'collapsed', k FROM kept QUALIFY row_number() OVER (PARTITION BY doc, k ORDER BY c) > 1
  UNION ALL SELECT doc, 'publication_gate_candidate_disposition:' || c || ':reason_too_long', 'long', c FROM di WHERE size > {repairs.MOST_REASON}
  UNION ALL SELECT doc, 'project_update:' || k || ':participant_evidence_mismatch', 'mismatched', k FROM upr WHERE who NOT LIKE 'Speaker%' AND own = 0
  UNION ALL SELECT doc, 'project_update:' || k || ':evidence_span_too_wide', 'wide_update', k FROM upr WHERE who NOT LIKE 'Speaker%' AND span > {repairs.SPAN}
  UNION ALL SELECT doc, 'project_update:' || k || ':participant_duplicate', 'repeated', k FROM up QUALIFY row_number() OVER (PARTITION BY doc, who ORDER BY k) > 1
  UNION ALL SELECT su.doc, 'publication_gate_decision_support:' || su.k || ':' || basis || '_not_grounded', basis, su.k FROM (SELECT *, unnest(ids) AS pos FROM su) AS su JOIN r ON r.doc = su.doc AND r.pos = su.pos GROUP BY su.doc, su.k, basis HAVING NOT bool_or(CASE WHEN basis = 'explicit_agreement' THEN agrees ELSE selects END))"""


@query(f"""WITH {_REVIEWS} SELECT doc, code FROM er""")
def m13_reasons(spark: SparkSession, sf: str) -> DataFrame:
    """What is wrong with each review, a row a reason."""
    r = records(spark, sf)
    return repairs.reasons(repairs.with_evidence(reviews(r), r)).select("doc", F.explode("errors").alias("code"))


_CORE = f"CASE WHEN regexp_extract(item, {_re2(repairs.LAST_TASK)}, 1) <> '' THEN regexp_extract(item, {_re2(repairs.LAST_TASK)}, 1) ELSE item END"
_PAIRS = lambda t: f"list_distinct([substr({t}, i, 2) FOR i IN range(1, length({t}))])"

_ROUND = f"""{_REVIEWS}, fl AS (SELECT ac.*, EXISTS (FROM er WHERE er.doc = ac.doc AND er.k = ac.k AND kind = 'wide') AS wide, EXISTS (FROM er WHERE er.doc = ac.doc AND er.k = ac.k AND kind = 'atomic') AS atomic, EXISTS (FROM er WHERE er.doc = ac.doc AND er.k = ac.k AND kind = 'invalid') AS invalid, EXISTS (FROM er WHERE er.doc = ac.doc AND er.k = ac.k AND kind = 'collapsed') AS collapsed, (SELECT count(*) FROM kept WHERE kept.doc = ac.doc AND kept.k = ac.k) AS own FROM ac),
m1 AS (SELECT fl.doc, fl.k AS old, kept.c AS sub, kept.owner, kept.item, kept.ids, kept.basis, false AS narrow FROM fl JOIN kept ON kept.doc = fl.doc AND kept.k = fl.k WHERE wide OR collapsed
  UNION ALL SELECT fl.doc, fl.k, 0, kept.owner, kept.item, kept.ids, kept.basis, false FROM fl JOIN (FROM kept QUALIFY row_number() OVER (PARTITION BY doc, k ORDER BY c) = 1) AS kept ON kept.doc = fl.doc AND kept.k = fl.k WHERE NOT (wide OR collapsed) AND (invalid OR atomic)
  UNION ALL SELECT doc, k, -1, owner, item, ids, basis, wide FROM fl WHERE CASE WHEN own = 0 THEN NOT invalid ELSE NOT (wide OR collapsed OR invalid OR atomic) END),
-- of wide evidence what ends near the first start
m2 AS (SELECT m1.* EXCLUDE (ids, item), CASE WHEN sub >= 0 THEN {_CORE} ELSE item END AS item, CASE WHEN narrow THEN (SELECT list(pos ORDER BY a, j) FROM (SELECT q.pos, r.a, q.j, r.b, min(r.a) OVER () AS f FROM (SELECT unnest(m1.ids) AS pos, generate_subscripts(m1.ids, 1) AS j) AS q JOIN r ON r.doc = m1.doc AND r.pos = q.pos) WHERE b - f <= {repairs.SPAN}) ELSE ids END AS ids, row_number() OVER (PARTITION BY doc ORDER BY old, sub) AS k FROM m1),
fo AS (SELECT ca.doc, ca.c, ca.owner, {_CORE} AS item, ca.item AS full_item, ca.ids, ca.basis FROM ca JOIN er ON er.doc = ca.doc AND er.k = ca.c AND kind = 'rejected'),
me AS (SELECT fo.doc, fo.c, min(m2.k) AS k FROM fo JOIN m2 ON m2.doc = fo.doc AND m2.owner = fo.owner WHERE list_has_any(m2.ids, fo.ids) OR (length(m2.item) >= 4 AND length(fo.full_item) >= 4 AND 2 * len(list_intersect({_PAIRS('m2.item')}, {_PAIRS('fo.full_item')})) >= len(list_distinct(list_concat({_PAIRS('m2.item')}, {_PAIRS('fo.full_item')})))
  AND (SELECT max(b) - min(a) FROM r WHERE r.doc = fo.doc AND list_contains(list_concat(m2.ids, fo.ids), pos)) <= {repairs.SPAN}) GROUP BY ALL),
fr2 AS (SELECT fo.* FROM fo ANTI JOIN me ON me.doc = fo.doc AND me.c = fo.c QUALIFY row_number() OVER (PARTITION BY fo.doc, owner ORDER BY fo.c) = 1),
na AS (SELECT doc, k, owner, item, ids, basis FROM m2 UNION ALL SELECT doc, coalesce((SELECT max(k) FROM m2 WHERE m2.doc = fr2.doc), 0) + row_number() OVER (PARTITION BY doc ORDER BY c), owner, item, ids, basis FROM fr2),
stuck AS (SELECT DISTINCT er.doc FROM er JOIN up ON up.doc = er.doc AND up.k = er.k WHERE kind = 'mismatched' AND NOT EXISTS (FROM na WHERE na.doc = up.doc AND na.owner = up.who))"""


@query(f"""WITH {_ROUND}, z AS (SELECT * FROM na WHERE doc NOT IN (FROM stuck) UNION ALL SELECT doc, k, owner, item, ids, basis FROM ac WHERE doc IN (FROM stuck))
SELECT doc, k, owner, item, array_to_string(['r' || doc || '_' || x FOR x IN ids], ',') AS ids, basis FROM z""")
def m13_actions(spark: SparkSession, sf: str) -> DataFrame:
    """The actions of each review after one round: dropped, restored, split, narrowed and added."""
    r = records(spark, sf)
    done = repairs.once(reviews(r), r)
    known = F.filter("x.ids", lambda i: i != "none")
    return done.select("doc", F.posexplode("actions").alias("k", "x")).select("doc", (F.col("k") + 1).cast("long").alias("k"), "x.owner", "x.item", F.array_join(known, ",").alias("ids"), "x.basis")


@query()
def m13_rounds(spark: SparkSession, sf: str) -> DataFrame:
    """Every round of every review until nothing changes, and what no round mended (round 0)."""
    r = records(spark, sf)
    s = repairs.settled(reviews(r), r)
    told = s.rounds.select("doc", F.col("round").cast("long").alias("round"), F.array_join("changes", " ").alias("what"))
    return told.unionByName(s.left.select("doc", F.lit(0).cast("long").alias("round"), F.array_join("errors", " ").alias("what")))


#: Contents of proposed minutes, dealt by key.
TITLES = ("发布", "a / b", "一般讨论", "", "长" * 57, "测试")
STATES = ("进行中", "Speaker 2 说", "", "好")
OUTCOMES = ("继续", "系统将上线", "将实施", "形成共识", "Billy 负责测试", "系统计划将上线", "Xin 推进")
OWNERS = ("Billy", "Xin", minutes.UNASSIGNED, "Ana", "Speaker 1", "Eve")
REQUIRED = ("Billy", "Ana")


def proposed(records: DataFrame) -> DataFrame:
    """doc, payload: two themes, two updates, a decision and three actions of each recording, as JSON; one in 19 has a wrong key."""
    n = records.groupBy("doc").agg(F.count("*").alias("n"))
    of = lambda values, at: F.element_at(F.array(*map(F.lit, values)), (at % len(values) + 1).cast("int"))
    hash_ = lambda k, salt: (F.col("doc") * 7919 + k * 104_729 + salt * 1_299_709) % 1_000_003

    def ids(h: Column) -> Column:
        name = lambda p: F.concat(F.lit("r"), "doc", F.lit("_"), p.cast("string"))
        p = F.floor(h / 7) % F.col("n")
        return F.when(h % 4 == 0, F.array(name(p))).when(h % 6 == 1, F.array(name(p), name((p + 30) % F.col("n")))).otherwise(F.array(name(p), name((p + h % 5) % F.col("n")), F.lit("none")))

    each = lambda most, f: F.transform(F.sequence(F.lit(1).cast("long"), F.lit(most).cast("long")), f)
    text = lambda what, k: F.concat(F.lit(what), k.cast("string"))

    def theme(k: Column) -> Column:
        h = hash_(k, 11)
        point = F.struct(of(PEOPLE, F.floor(h / 5)).alias("speaker"), F.lit("p").alias("text_zh"), F.lit("p").alias("text_en"), ids(hash_(k, 12)).alias("segment_ids"))
        return F.struct(of(TITLES, h).alias("title_zh"), text("T", k).alias("title_en"), of(STATES, F.floor(h / 2)).alias("current_state_zh"), F.lit("s").alias("current_state_en"), of(OUTCOMES, F.floor(h / 3)).alias("outcome_zh"), F.lit("o").alias("outcome_en"), ids(h).alias("evidence_segment_ids"), F.when(h % 3 > 0, F.array(point)).otherwise(F.slice(F.array(point), 1, 0)).alias("key_points"))

    def update(k: Column) -> Column:
        h = hash_(k, 13)
        return F.struct(of(PEOPLE, h).alias("participant"), F.lit("项").alias("project_zh"), F.lit("p").alias("project_en"), text("好", k).alias("update_zh"), text("u", k).alias("update_en"), ids(h).alias("segment_ids"))

    def action(k: Column) -> Column:
        h = hash_(k, 15)
        return F.struct(of(OWNERS, h).alias("owner"), of(ITEMS, F.floor(h / 3)).alias("item_zh"), text("I", h % 2).alias("item_en"), ids(h).alias("segment_ids"))

    decision = lambda k: F.struct(F.lit("定").alias("text_zh"), F.lit("d").alias("text_en"), ids(hash_(k, 14)).alias("segment_ids"))
    payload = F.to_json(F.struct(each(2, theme).alias("themes"), each(2, update).alias("project_updates"), each(1, decision).alias("decisions"), each(3, action).alias("actions")))
    return n.select("doc", F.when(F.col("doc") % 19 == 7, F.replace(payload, F.lit('"owner"'), F.lit('"boss"'))).when(F.col("doc") % 19 == 8, F.replace(payload, F.lit('"themes"'), F.lit('"topics"'))).otherwise(payload).alias("payload"))


def _unit(kind: str, source: str, k: str, salt: int, path: str, name: str, more: str = "'' AS zh") -> str:
    return f"SELECT doc, '{kind}' AS kind, {k} AS i, {path} AS path, {name} AS who, {_IDS} AS ids, h % 4 <> 0 AND h % 6 <> 1 AS odd, {more} FROM (SELECT *, {_hash(k, salt)} AS h FROM {source})"


_T = _hash("k", 11)
_MINUTES = f"""{_REVIEWS}, good AS (SELECT * FROM docs WHERE doc % 19 <> 8), two AS (SELECT *, unnest([1, 2]) AS k FROM good), one AS (SELECT *, 1 AS k FROM good), acts3 AS (SELECT *, unnest([1, 2, 3]) AS k FROM good WHERE doc % 19 <> 7),
un AS ({_unit('theme', 'two', 'k', 11, "'theme:' || k", "''", f"{_of(OUTCOMES, 'h // 3')} AS zh")}
  UNION ALL {_unit('point', f'(SELECT * FROM two WHERE {_T} % 3 > 0)', 'k', 12, "'theme:' || k || ':point:1'", _of(PEOPLE, f'{_T} // 5'))}
  UNION ALL {_unit('project_update', 'two', 'k', 13, "'project_update:' || k", _of(PEOPLE, 'h'))}
  UNION ALL {_unit('decision', 'one', 'k', 14, "'decision:' || k", "''")}
  UNION ALL {_unit('action', 'acts3', 'k', 15, "'action:' || k", _of(OWNERS, 'h'), f"{_of(ITEMS, 'h // 3')} AS zh")}),
ev AS (SELECT un.doc, un.kind, un.i, un.path, un.who, un.zh, r.pos, r.a, r.b, r.who AS said, r.agrees FROM (SELECT *, unnest(list_distinct(ids)) AS pos FROM un) AS un JOIN r ON r.doc = un.doc AND r.pos = un.pos),
own AS (SELECT doc, kind, path, who, count(*) FILTER (said = who) AS n, max(b) - min(a) AS span, max(b) FILTER (said = who) - min(a) FILTER (said = who) AS own_span FROM ev GROUP BY ALL),
th AS (SELECT doc, i, min(a) AS f, max(b) AS l, bool_or(agrees) AS agrees, list(pos) AS poss FROM ev WHERE kind IN ('theme', 'point') GROUP BY ALL),
ou AS (SELECT un.doc, un.i, un.zh AS o, f, l, agrees, poss FROM un JOIN th ON th.doc = un.doc AND th.i = un.i WHERE kind = 'theme'),
tx AS (SELECT doc, k, {_of(TITLES, _T)} AS title, {_of(STATES, f'{_T} // 2')} AS state FROM two),
bad AS (SELECT doc, 'top_level_keys_invalid' AS code FROM docs WHERE doc % 19 = 8
  UNION ALL SELECT doc, 'action:' || unnest([1, 2, 3]) || ':invalid' FROM docs WHERE doc % 19 = 7
  UNION ALL SELECT doc, 'theme:' || k || ':title_zh_' || CASE title WHEN 'a / b' THEN 'combined_topic' WHEN '一般讨论' THEN 'generic' WHEN '' THEN 'missing' ELSE 'too_long' END FROM tx WHERE title NOT IN ('发布', '测试')
  UNION ALL SELECT doc, 'theme:' || k || ':current_state_' || CASE state WHEN '' THEN 'zh_missing' ELSE 'anonymous_speaker_reference' END FROM tx WHERE state IN ('', 'Speaker 2 说')
  UNION ALL SELECT doc, path || ':evidence_unknown:none' FROM un WHERE odd
  UNION ALL SELECT un.doc, un.path || ':key_points_missing' FROM un JOIN (SELECT doc, path FROM ev WHERE kind = 'theme' AND said NOT LIKE 'Speaker%' GROUP BY ALL) AS n ON n.doc = un.doc AND n.path = un.path WHERE {_hash('i', 11).replace('doc', 'un.doc')} % 3 = 0
  UNION ALL SELECT doc, path || CASE WHEN who LIKE 'Speaker%' THEN ':speaker_anonymous' ELSE ':speaker_evidence_mismatch' END FROM own WHERE kind = 'point' AND (who LIKE 'Speaker%' OR n = 0)
  UNION ALL SELECT doc, path || CASE WHEN who LIKE 'Speaker%' THEN ':participant_unknown' WHEN n = 0 THEN ':participant_evidence_mismatch' ELSE ':evidence_span_too_wide:' || printf('%.1f', own_span) || '>120.0' END FROM own WHERE kind = 'project_update' AND (who LIKE 'Speaker%' OR n = 0 OR own_span > 120)
  UNION ALL SELECT doc, path || CASE WHEN who = '{minutes.UNASSIGNED}' THEN ':requested_follow_up_not_grounded' WHEN who LIKE 'Speaker%' OR who = 'Eve' THEN ':owner_unknown' WHEN n = 0 THEN ':owner_evidence_mismatch' ELSE ':evidence_span_too_wide:' || printf('%.1f', span) || '>120.0' END FROM own WHERE kind = 'action' AND (who = '{minutes.UNASSIGNED}' OR who LIKE 'Speaker%' OR who = 'Eve' OR n = 0 OR span > 120)
  UNION ALL SELECT doc, path || ':atomicity_review_required' FROM un WHERE kind = 'action' AND regexp_matches(zh, {_re2(repairs.SECOND_TASK)})
  UNION ALL SELECT doc, path || ':participant_duplicate' FROM un WHERE kind = 'project_update' QUALIFY row_number() OVER (PARTITION BY doc, who ORDER BY i) > 1
  UNION ALL SELECT doc, 'action:' || k || ':duplicate' FROM (SELECT *, {_hash('k', 15)} AS h FROM acts3) QUALIFY row_number() OVER (PARTITION BY doc, {_of(OWNERS, 'h')}, h % 2 ORDER BY k) > 1
  UNION ALL SELECT b.doc, 'action:' || b.i || ':semantic_duplicate:' || a.i FROM un a JOIN un b ON a.doc = b.doc AND a.kind = 'action' AND b.kind = 'action' AND a.i < b.i AND a.who = b.who WHERE length(a.zh) >= 4 AND length(b.zh) >= 4 AND 2 * len(list_intersect({_PAIRS('a.zh')}, {_PAIRS('b.zh')})) >= len(list_distinct(list_concat({_PAIRS('a.zh')}, {_PAIRS('b.zh')})))
  UNION ALL SELECT good.doc, 'project_update_missing:' || q.who FROM good, (SELECT unnest({_list(REQUIRED)}) AS who) AS q WHERE NOT EXISTS (FROM un WHERE un.doc = good.doc AND un.kind = 'project_update' AND un.who = q.who)
  UNION ALL SELECT doc, 'theme:' || i || ':future_fact_unqualified' FROM ou WHERE o = '系统将上线'
  UNION ALL SELECT doc, 'theme:' || i || ':outcome_unconfirmed_commitment' FROM ou WHERE o = '将实施' AND NOT EXISTS (FROM ev WHERE ev.doc = ou.doc AND kind = 'decision' AND list_contains(poss, pos))
  UNION ALL SELECT doc, 'theme:' || i || ':outcome_ungrounded_consensus' FROM ou WHERE o = '形成共识' AND NOT agrees
  UNION ALL SELECT ou.doc, 'theme:' || ou.i || ':future_owner_without_action:' || split_part(o, ' ', 1) FROM ou WHERE o IN ('Billy 负责测试', 'Xin 推进') AND NOT EXISTS (FROM ev WHERE ev.doc = ou.doc AND kind = 'action' AND ev.who = split_part(o, ' ', 1) AND ev.a BETWEEN f - 120 AND l + 120))"""


@query(f"""WITH {_MINUTES} SELECT DISTINCT doc, code FROM bad""")
def m7_breaches(spark: SparkSession, sf: str) -> DataFrame:
    """Every breach of each recording's proposed minutes."""
    r = records(spark, sf)
    p = proposed(r)
    return minutes.breaches(p, r, p.select("doc", F.explode(F.array(*map(F.lit, REQUIRED))).alias("participant")))
