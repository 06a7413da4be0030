"""Repair of reviews by their reasons, round after round until nothing changes.

A review is one row: its actions, candidates, dispositions, updates, decisions and what supports these, as arrays (a review is short). The rows of the
recording that it cites are looked up once and travel with it as ``evidence``. After that a round is column expressions over a row: it moves
nothing, whatever the number of reviews. :func:`reasons` says what is wrong, :func:`repaired` mends what it can, :func:`settled` goes
on until no review changes and keeps every round's changes.

Actions carry the basis of their support; a support cites what its action cites."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.columns import bigram_share, is_named, normal_space
from ..sources.tables import scratch
from . import cues

#: Longest span of cited rows (seconds), longest reason of a disposition, alike actions, project of an update made from an action.
SPAN, MOST_REASON, ALIKE, FOLLOW_UP = 120.0, 120, 0.5, "后续跟进"
#: Texts and bases that tell agreement, a chosen direction, a second task in an action, and what leads to it.
AGREES = r"(?i)\b(?:we\s+(?:agree|agreed)|agreed|sounds\s+good|that['’]s\s+the\s+plan|we(?:'ll|\s+will)\s+go\s+with|let['’]s\s+do\s+that|decision\s+is)\b|(?:一致同意|已经决定|就这么定|方案确定为)"
SELECTS = r"(?i)\b(?:we(?:'re|\s+are)\s+going\s+with|we(?:'ll|\s+will)\s+use|we\s+(?:chose|selected|decided)|let['’]s\s+use|the\s+direction\s+is)\b|(?:选择采用|确定采用|方向是)"
SECOND_TASK = r"(?i)(?:，|,|;|；)?\s*(?:并|以及|同时|然后)\s*(?:推动|要求|发送|提供|迁移|创建|部署|审查|整理|跟进|测试|更新|完成|获取)|\band\s+(?:push|require|send|provide|migrate|move|create|deploy|review|prepare|follow\s+up|test|update|complete|obtain|get)\b"
LAST_TASK = r"(?:，|,|;|；)\s*(?:并|以及|同时|然后)\s*(.+)$"
#: Ends of clauses, what a text must not begin with once a clause is gone, and what stands where nothing is left.
CLAUSE_END, LOOSE_START = r"(?<=[，,；;。！？!?])", r"(?i)^[，,；;\s]*(?:但|而|并且|且|以及|同时|but|and|while)\s*"
OPEN_ZH, OPEN_EN = "该项细节尚待确认。", "This detail remains to be confirmed."
#: How well an action stands for its owner's work.
MINOR, MAJOR = r"(?i)(?:发送.*(?:链接|会议记录)|send.*(?:link|notes))", r"(?i)(?:入驻|测试|迁移|整理|审查|跟进|开发|实施|onboard|test|migrate|review|follow\s+up|implement)"
#: Reasons of dispositions that a repair gives.
DELIVERY = "The cited evidence reports a third-party delivery estimate, not an owner follow-up commitment."
NO_COMMITMENT = "The mapped action does not have a grounded owner commitment."
RETAINED = "Deterministic commitment validation requires retaining this candidate."
NOT_CONCRETE = "The owner spoke, but the transcript does not establish a concrete supported commitment."
SHORT = {"kept": "Cited evidence supports this action.", "unsupported_owner": "Cited evidence does not establish this owner.", "unsupported_commitment": "Cited evidence does not establish a concrete commitment.", "unsupported_item": "Cited evidence does not establish this follow-up item.", "": "Cited evidence does not support this disposition."}

ACTION = "struct<owner:string,item:string,ids:array<string>,basis:string>"
SCHEMA = f"""doc long, actions array<{ACTION}>, candidates array<struct<owner:string,item:string,ids:array<string>,basis:string,must_keep:boolean>>,
dispositions array<struct<c:int,kept:boolean,k:int,code:string,reason:string>>, updates array<struct<participant:string,project:string,text:string,ids:array<string>>>,
decisions array<struct<text:string,ids:array<string>>>, decision_supports array<struct<k:int,ids:array<string>,basis:string>>"""
COLUMNS = ("actions", "candidates", "dispositions", "updates", "decisions", "decision_supports")


def with_evidence(reviews: DataFrame, records: DataFrame) -> DataFrame:
    """reviews with evidence: of each row of the recording (doc, id, start, end, speaker, text) that the review cites, what the rules ask of it."""
    cited = F.array_distinct(F.flatten(F.array(*[F.flatten(F.transform(c, lambda x: F.coalesce(x["ids"], F.array().cast("array<string>")))) for c in ("actions", "candidates", "updates", "decisions", "decision_supports")])))
    r = records.select("doc", "id", F.struct(F.col("start").cast("double").alias("start"), F.col("end").cast("double").alias("end"), "speaker", (F.size(cues.commitments(F.col("text"))) > 0).alias("commits"), F.col("text").rlike(AGREES).alias("agrees"), F.col("text").rlike(SELECTS).alias("selects")).alias("row"))
    found = reviews.select("doc", F.explode(cited).alias("id")).join(r, ["doc", "id"]).groupBy("doc").agg(F.map_from_entries(F.collect_list(F.struct("id", "row"))).alias("evidence"))
    none = F.create_map().cast("map<string,struct<start:double,end:double,speaker:string,commits:boolean,agrees:boolean,selects:boolean>>")
    return reviews.join(found, "doc", "left").withColumn("evidence", F.coalesce("evidence", none))


def _row(id_: Column) -> Column:
    return F.try_element_at(F.col("evidence"), id_)


def _known(ids: Column) -> Column:
    return F.filter(ids, lambda x: F.map_contains_key("evidence", x))


def span(ids: Column) -> Column:
    """From the first start to the last end of the cited rows; 0 without any."""
    rows = F.transform(_known(ids), _row)
    return F.coalesce(F.array_max(F.transform(rows, lambda r: r["end"])) - F.array_min(F.transform(rows, lambda r: r["start"])), F.lit(0.0))


def _first_cluster(ids: Column) -> Column:
    """Of the cited rows, in order of start (then as cited), those that end within SPAN of the first start."""
    order = F.array_sort(F.transform(_known(ids), lambda x, i: F.struct(_row(x)["start"].alias("start"), i.alias("i"), _row(x)["end"].alias("end"), x.alias("id"))))
    return F.transform(F.filter(order, lambda x: x["end"] - F.get(order, F.lit(0))["start"] <= SPAN), lambda x: x["id"])


def core(item: Column) -> Column:
    """What an item of several tasks ends with."""
    text = normal_space(item)
    last = F.regexp_extract(text, LAST_TASK, 1)
    return F.when(last != "", normal_space(last)).otherwise(text)


def without_clauses(text: Column, gone: Callable[[Column], Column]) -> Column:
    """The text without its clauses for which ``gone`` holds."""
    kept = F.trim(F.array_join(F.filter(F.split(normal_space(text), CLAUSE_END), lambda c: (c != "") & ~gone(c)), ""))
    kept = F.regexp_replace(F.regexp_replace(kept, LOOSE_START, ""), r"(?:[，,；;]\s*){2,}", "，")
    return F.regexp_replace(kept, r"^[ ，,；;]+|[ ，,；;]+$", "")


def without_entities(text: Column, names: Column) -> Column:
    return F.when(F.size(names) == 0, normal_space(text)).otherwise(without_clauses(text, lambda c: F.exists(names, lambda n: F.contains(F.lower(c), F.lower(n)))))


def without_literals(text: Column, values: Column) -> Column:
    """Clauses that hold one of the values by itself go; a text that has no other says that it is open."""
    alone = lambda c: F.exists(values, lambda v: F.concat(F.lit(" "), F.regexp_replace(F.lower(c), "[^0-9a-z.]+", " "), F.lit(" ")).contains(F.concat(F.lit(" "), F.lower(v), F.lit(" "))))
    left = without_clauses(text, alone)
    return F.when(F.size(values) == 0, normal_space(text)).when(left != "", left).when(normal_space(text).rlike(r"[一-鿿]"), OPEN_ZH).otherwise(OPEN_EN)


def _at(pattern: str, group: int = 1) -> Column:
    """The numbers that reasons of a kind name."""
    return F.transform(F.filter("errors", lambda e: e.rlike(pattern)), lambda e: F.regexp_extract(e, pattern, group).cast("int"))


def _values(kind: str, k: Column, *what: str) -> Column:
    """What the reasons of one row name: ``kind:k:what_ungrounded:value``."""
    pattern = rf"^{kind}:(\d+):(?:{'|'.join(what)})_ungrounded:(.+)$"
    mine = F.filter("errors", lambda e: e.rlike(pattern) & (F.regexp_extract(e, pattern, 1).cast("int") == k))
    return F.transform(mine, lambda e: F.regexp_extract(e, pattern, 2))


def _has(numbers: str, k: Column) -> Column:
    return F.array_contains(numbers, k)


def _codes(*codes: tuple[Column, Column]) -> Column:
    return F.array_compact(F.array(*[F.when(holds, code) for holds, code in codes]))


def _code(name: str, *at: Column) -> Column:
    return F.concat_ws(":", F.lit(name), *[a.cast("string") for a in at])


def reasons(reviews: DataFrame) -> DataFrame:
    """reviews with errors: codes of what their rules find, beside those that ``given`` (array of codes, may be null) brings from outside."""
    on = lambda name, f: F.flatten(F.transform(name, f))
    mine = lambda ids, who, what: F.exists(_known(ids), lambda x: (_row(x)["speaker"] == who) & what(_row(x)))

    def of_action(a: Column, i: Column) -> Column:
        k = i + 1
        return _codes((span(a["ids"]) > SPAN, _code("action", k, F.lit("evidence_span_too_wide"))), (a["item"].rlike(SECOND_TASK), _code("action", k, F.lit("atomicity_review_required"))), ((a["basis"] == "self_commitment") & ~mine(a["ids"], a["owner"], lambda r: r["commits"]), _code("publication_gate_action_support", k, F.lit("self_commitment_not_grounded"))))

    def of_disposition(d: Column, i: Column) -> Column:
        p, candidate = i + 1, F.get("candidates", d["c"] - 1)
        beside = F.exists("dispositions", lambda o: o["kept"] & (o["k"] == d["k"]) & (o["c"] < d["c"]) & F.get("candidates", o["c"] - 1)["must_keep"])
        kept = d["kept"] & candidate["must_keep"]
        return _codes((~d["kept"] & candidate["must_keep"], _code("publication_gate_candidate_disposition", p, F.lit("must_keep_candidate_rejected"))), (kept & beside, _code("publication_gate_candidate_disposition", p, F.lit("must_keep_candidates_collapsed"), d["k"])), (F.length(d["reason"]) > MOST_REASON, _code("publication_gate_candidate_disposition", p, F.lit("reason_too_long"))))

    def of_update(u: Column, i: Column) -> Column:
        own = F.filter(_known(u["ids"]), lambda x: _row(x)["speaker"] == u["participant"])
        named, cites = is_named(u["participant"]), F.size(_known(u["ids"])) > 0
        again = F.exists(F.slice("updates", F.lit(1), i), lambda o: o["participant"] == u["participant"])
        return _codes((named & cites & (F.size(own) == 0), _code("project_update", i + 1, F.lit("participant_evidence_mismatch"))), (named & (span(own) > SPAN), _code("project_update", i + 1, F.lit("evidence_span_too_wide"))), (again, _code("project_update", i + 1, F.lit("participant_duplicate"))))

    def of_decision(s: Column, i: Column) -> Column:
        some = lambda what: F.exists(_known(s["ids"]), lambda x: _row(x)[what])
        return _codes(((s["basis"] == "explicit_agreement") & ~some("agrees"), _code("publication_gate_decision_support", i + 1, F.lit("explicit_agreement_not_grounded"))), ((s["basis"] == "selected_direction") & ~some("selects"), _code("publication_gate_decision_support", i + 1, F.lit("selected_direction_not_grounded"))))

    found = F.concat(on("actions", of_action), on("dispositions", of_disposition), on("updates", of_update), on("decision_supports", of_decision))
    given = F.coalesce(F.col("given"), F.array().cast("array<string>")) if "given" in reviews.columns else F.array().cast("array<string>")
    return reviews.withColumn("errors", F.array_sort(F.array_distinct(F.concat(found, given))))


def repaired(reviews: DataFrame) -> DataFrame:
    """One round: reviews (with evidence and errors) mended, and changes (codes, in order).

    An action without a ground goes, unless a candidate that must be kept stands behind it: then that candidate takes its place; so does each of
    several that share one action, and those behind an action that cites rows too far apart (others keep what lies near the first). A rejected
    candidate that must be kept joins the owner's first action that cites one of its rows, or a like one near it; else it becomes an action, one of each
    owner a round, so that the next sees it. Dispositions, supports and updates follow the actions' new places. Updates without a ground are made
    anew from the owner's weightiest action, repeated ones go; decisions take the other basis where their rows tell it, else go. A review in
    which that can't be done (an update that no action can replace, a candidate without a task) stays as it is, without changes."""
    flags = {
        "invalid": _at(r"^publication_gate_action_support:(\d+):(?:self_commitment|accepted_assignment|owned_follow_up)_not_grounded$"),
        "external": _at(r"^publication_gate_action_support:(\d+):external_delivery_status_not_action$"),
        "atomic": _at(r"^action:(\d+):atomicity_review_required$"),
        "wide": _at(r"^action:(\d+):evidence_span_too_wide"),
        "collapsed": _at(r"^publication_gate_candidate_disposition:\d+:must_keep_candidates_collapsed:(\d+)$"),
        "rejected": _at(r"^publication_gate_candidate_disposition:(\d+):(?:unsupported_commitment_conflicts_with_evidence|must_keep_candidate_rejected)$"),
        "wrong_owner": _at(r"^publication_gate_candidate_disposition:(\d+):unsupported_owner_conflicts_with_evidence$"),
        "long_reason": _at(r"^publication_gate_candidate_disposition:(\d+):reason_too_long$"),
        "mismatched": _at(r"^project_update:(\d+):participant_evidence_mismatch$"),
        "wide_update": _at(r"^project_update:(\d+):evidence_span_too_wide"),
        "repeated": _at(r"^project_update:(\d+):participant_duplicate$"),
        "no_agreement": _at(r"^publication_gate_decision_support:(\d+):explicit_agreement_not_grounded$"),
        "no_direction": _at(r"^publication_gate_decision_support:(\d+):selected_direction_not_grounded$"),
    }
    r = reviews.withColumns(flags)
    none = F.array().cast("array<string>")

    # candidates that must be kept, by the action that they are kept as
    behind = lambda k: F.transform(F.filter("dispositions", lambda d: d["kept"] & (d["k"] == k) & F.coalesce(F.get("candidates", d["c"] - 1)["must_keep"], F.lit(False))), lambda d: F.struct(d["c"].alias("c"), F.get("candidates", d["c"] - 1).alias("x")))

    # step by step, so that no step repeats what one before it found
    asked = lambda a, i: F.struct((i + 1).cast("int").alias("k"), a.alias("a"), behind(i + 1).alias("own"), *[_has(n, i + 1).alias(n) for n in ("external", "invalid", "wide", "collapsed", "atomic")], _values("action", i + 1, "named_entity").alias("names"), _values("action", i + 1, "number", "weekday").alias("values"))
    r = r.withColumn("asked", F.transform("actions", asked))

    def parts(q: Column) -> Column:
        one = lambda c, x, item, split, code: F.struct(q["k"].alias("old"), c.cast("int").alias("c"), x["owner"].alias("owner"), item.alias("item"), x["ids"].alias("ids"), x["basis"].alias("basis"), F.lit(split).alias("split"), (q["wide"] & F.lit(not split)).alias("narrow"), q["names"].alias("names"), q["values"].alias("values"), code.alias("code"))
        several, n = F.size(q["own"]) > 0, F.size(q["own"])
        split = F.transform(q["own"], lambda o, j: one(o["c"], o["x"], core(o["x"]["item"]), True, F.when(j == n - 1, _code("split_must_keep_action", q["k"], n))))
        restored = F.transform(F.slice(q["own"], 1, 1), lambda o: one(F.lit(None), o["x"], core(o["x"]["item"]), False, _code("restored_must_keep_action", q["k"])))
        drop = q["external"] | (q["invalid"] & ~several)
        same = F.array(one(F.lit(None), q["a"], q["a"]["item"], False, F.lit(None).cast("string")))
        return F.when(drop, F.slice(split, 1, 0)).when(several & (q["wide"] | q["collapsed"]), split).when(several & (q["invalid"] | q["atomic"]), restored).otherwise(same)

    r = r.withColumn("parts", F.flatten(F.transform("asked", parts)))
    carry = lambda m, *new: F.struct(*[m[c].alias(c) for c in ("old", "c", "owner", "item", "ids", "basis", "split", "narrow", "names", "values", "code") if c not in {n for n, _ in new}], *[x.alias(n) for n, x in new])
    r = r.withColumn("parts", F.transform("parts", lambda m: carry(m, ("near", F.when(m["narrow"], _first_cluster(m["ids"])).otherwise(none)), ("clear", F.when(F.size(m["names"]) > 0, without_entities(m["item"], m["names"])).otherwise(F.lit(""))))))
    r = r.withColumn("parts", F.transform("parts", lambda m: F.struct(*[m[c].alias(c) for c in ("old", "c", "owner", "item", "basis", "split", "values", "code")], F.when(F.size(m["near"]) > 0, m["near"]).otherwise(m["ids"]).alias("ids"), ((F.size(m["near"]) > 0) & (m["near"] != m["ids"])).alias("nearer"), F.when(m["clear"] != "", m["clear"]).otherwise(m["item"]).alias("clean"), ((m["clear"] != "") & (m["clear"] != normal_space(m["item"]))).alias("cleared"))))
    r = r.withColumn("parts", F.transform("parts", lambda m: F.struct(*[m[c].alias(c) for c in ("old", "c", "owner", "basis", "split", "code", "ids", "nearer", "clean", "cleared")], F.when(F.size(m["values"]) > 0, without_literals(m["clean"], m["values"])).otherwise(m["clean"]).alias("item"))))
    made = lambda m: F.struct(*[m[c].alias(c) for c in ("old", "c", "owner", "item", "ids", "basis", "split")], F.concat(_codes((m["code"].isNotNull(), m["code"])), _codes((m["nearer"], _code("narrowed_action_evidence", m["old"])), (m["cleared"], _code("dropped_ungrounded_action_entity_clause", m["old"])), (m["item"] != m["clean"], _code("neutralized_ungrounded_action_literals", m["old"])))).alias("changes"))
    r = r.withColumn("made", F.transform("parts", made))
    dropped = F.flatten(F.transform("asked", lambda q: _codes((q["external"], _code("dropped_external_delivery_status_action", q["k"])), (~q["external"] & q["invalid"] & (F.size(q["own"]) == 0), _code("dropped_unsupported_action", q["k"])))))
    told = F.flatten(F.transform("made", lambda m: F.transform(m["changes"], lambda c: F.struct(m["old"].alias("old"), c.alias("code")))))
    gone = F.transform(dropped, lambda c: F.struct(F.element_at(F.split(c, ":"), -1).cast("int").alias("old"), c.alias("code")))
    r = r.withColumn("told", F.transform(F.concat(gone, told), lambda x, i: F.struct(x["old"].alias("old"), i.alias("i"), x["code"].alias("code"))))

    # candidates that were rejected and must not be
    def meets(m: Column, x: Column) -> Column:
        both, of = bigram_share(m["item"], x["item"])
        near = (both * 1.0 / of >= ALIKE) & (span(F.array_distinct(F.concat(m["ids"], x["ids"]))) <= SPAN)
        return (m["owner"] == x["owner"]) & (F.arrays_overlap(m["ids"], _known(x["ids"])) | near)

    def forced(p: Column) -> Column:
        c = F.get("dispositions", p - 1)["c"]
        x = F.get("candidates", c - 1)
        found = F.filter(F.transform("made", lambda m, j: F.when(meets(m, x), (j + 1).cast("int"))), lambda j: j.isNotNull())
        return F.struct(c.alias("c"), F.get(found, F.lit(0)).alias("k"), x["owner"].alias("owner"), core(x["item"]).alias("item"), x["ids"].alias("ids"), x["basis"].alias("basis"))

    r = r.withColumn("forced", F.array_sort(F.transform(F.array_distinct("rejected"), forced)))
    fresh = F.filter("forced", lambda f, i: f["k"].isNull() & ~F.exists(F.slice("forced", F.lit(1), i), lambda o: o["k"].isNull() & (o["owner"] == f["owner"])))
    r = r.withColumn("fresh", fresh).withColumn("n_made", F.size("made"))
    r = r.withColumn("forced_at", F.concat(F.transform(F.filter("forced", lambda f: f["k"].isNotNull()), lambda f: F.struct(f["c"].alias("c"), f["k"].alias("k"))), F.transform("fresh", lambda f, i: F.struct(f["c"].alias("c"), (F.col("n_made") + i + 1).cast("int").alias("k")))))
    as_action = lambda x: F.struct(x["owner"].alias("owner"), x["item"].alias("item"), x["ids"].alias("ids"), x["basis"].alias("basis"))
    r = r.withColumn("new_actions", F.concat(F.transform("made", as_action), F.transform("fresh", as_action)))

    # dispositions follow
    place = lambda old: F.get(F.filter(F.transform("made", lambda m, j: F.when(m["old"] == old, (j + 1).cast("int"))), lambda j: j.isNotNull()), F.lit(0))
    part = lambda c: F.get(F.filter(F.transform("made", lambda m, j: F.when(m["split"] & (m["c"] == c), (j + 1).cast("int"))), lambda j: j.isNotNull()), F.lit(0))

    where = lambda d, i: F.struct(d.alias("d"), F.get(F.filter("forced_at", lambda f: f["c"] == d["c"]), F.lit(0))["k"].alias("force"), part(d["c"]).alias("part"), place(d["k"]).alias("place"), _has("wrong_owner", i + 1).alias("wrong"), _has("long_reason", i + 1).alias("long"), _has("external", d["k"]).alias("external"))
    r = r.withColumn("placed", F.transform("dispositions", where))

    def disposition(q: Column) -> Column:
        d, forced_ = q["d"], q["force"].isNotNull()
        lost = d["k"].isNotNull() & q["place"].isNull() & (d["k"] <= F.size("actions"))
        wrong = ~forced_ & q["wrong"]
        k = F.when(forced_, q["force"]).when(lost, F.lit(None).cast("int")).otherwise(F.coalesce(q["part"], q["place"], d["k"]))
        code = F.when(forced_, "supported").when(lost | wrong, "unsupported_commitment").otherwise(d["code"])
        reason = F.when(forced_, RETAINED).when(wrong, NOT_CONCRETE).when(lost & q["external"], DELIVERY).when(lost, NO_COMMITMENT).otherwise(d["reason"])
        return F.struct(d["c"].alias("c"), F.when(forced_, True).when(lost, False).otherwise(d["kept"]).alias("kept"), k.alias("k"), code.alias("code"), reason.alias("reason"), q["long"].alias("long"))

    def shortened(x: Column) -> Column:
        short = F.when(x["kept"], SHORT["kept"])
        for name in ("unsupported_owner", "unsupported_commitment", "unsupported_item"):
            short = short.when(x["code"] == name, SHORT[name])
        short = short.otherwise(SHORT[""])
        cut = x["long"] & (normal_space(x["reason"]) != short)
        return F.struct(F.struct(*[x[c].alias(c) for c in ("c", "kept", "k", "code")], F.when(cut, short).otherwise(x["reason"]).alias("reason")).alias("x"), cut.alias("cut"))

    r = r.withColumn("placed", F.transform("placed", disposition)).withColumn("new_dispositions", F.transform("placed", shortened))

    # decisions
    def support(s: Column, i: Column) -> Column:
        tells = lambda what: F.exists(_known(s["ids"]), lambda x: _row(x)[what])
        bad = _has("no_agreement", i + 1) | _has("no_direction", i + 1)
        other = F.when(_has("no_agreement", i + 1) & tells("selects"), "selected_direction").when(_has("no_direction", i + 1) & tells("agrees"), "explicit_agreement")
        return F.struct(s["k"].alias("k"), s["ids"].alias("ids"), F.coalesce(F.when(bad, other), s["basis"]).alias("basis"), (bad & other.isNull()).alias("gone"), (bad & other.isNotNull()).alias("other"))

    r = r.withColumn("supported", F.transform("decision_supports", support))
    r = r.withColumn("lost", F.transform(F.filter("supported", lambda s: s["gone"]), lambda s: s["k"]))

    def decision(x: Column, i: Column) -> Column:
        names = _values("decision", i + 1, "named_entity")
        clean = without_entities(x["text"], names)
        changed = (F.size(names) > 0) & (clean != "") & (clean != normal_space(x["text"]))
        return F.struct((i + 1).cast("int").alias("old"), _has("lost", i + 1).alias("gone"), F.when(changed, clean).otherwise(x["text"]).alias("text"), x["ids"].alias("ids"), changed.alias("changed"))

    r = r.withColumn("decided", F.transform("decisions", decision))
    r = r.withColumn("left", F.transform(F.filter("decided", lambda x: ~x["gone"]), lambda x: x["old"]))
    new_supports = F.filter(F.transform("supported", lambda s: F.struct(F.array_position("left", s["k"]).cast("int").alias("k"), s["ids"].alias("ids"), s["basis"].alias("basis"))), lambda s: s["k"] > 0)

    # updates
    weight = lambda a: F.when(a["item"].rlike(MINOR), 0).when(a["item"].rlike(MAJOR), 2).otherwise(1)
    best = lambda who: F.get(F.array_sort(F.transform(F.filter(F.transform("new_actions", lambda a, j: F.struct(a.alias("a"), j.alias("j"))), lambda y: y["a"]["owner"] == who), lambda y: F.struct((-weight(y["a"])).alias("w"), y["j"].alias("j"), y["a"]["item"].alias("item"), y["a"]["ids"].alias("ids")))), F.lit(0))

    def judged(u: Column, i: Column) -> Column:
        again = (F.size("repeated") > 0) & F.exists(F.slice("updates", F.lit(1), i), lambda o: o["participant"] == u["participant"])
        flags_ = [_has(n, i + 1).alias(n) for n in ("mismatched", "wide_update")]
        return F.struct((i + 1).alias("k"), u.alias("u"), best(u["participant"]).alias("best"), again.alias("again"), *flags_, _values("project_update", i + 1, "named_entity").alias("names"), _values("project_update", i + 1, "number", "weekday").alias("values"))

    def first_step(q: Column) -> Column:
        rebuilt = q["best"].isNotNull() & (q["mismatched"] | (F.size(q["names"]) > 0) | (q["wide_update"] & (q["u"]["project"] == FOLLOW_UP)))
        near = F.when(~rebuilt & q["wide_update"], _first_cluster(q["u"]["ids"])).otherwise(none)
        text = F.when(rebuilt, normal_space(q["best"]["item"])).otherwise(q["u"]["text"])
        return F.struct(*[q[c].alias(c) for c in ("k", "u", "best", "again", "mismatched", "names", "values")], rebuilt.alias("rebuilt"), near.alias("near"), text.alias("text"))

    def second_step(q: Column) -> Column:
        ids = F.when(q["rebuilt"], q["best"]["ids"]).when(F.size(q["near"]) > 0, q["near"]).otherwise(q["u"]["ids"])
        clear = F.when(F.size(q["names"]) > 0, without_entities(q["text"], q["names"])).otherwise(q["text"])
        nearer = ~q["rebuilt"] & (F.size(q["near"]) > 0) & (q["near"] != q["u"]["ids"])
        return F.struct(*[q[c].alias(c) for c in ("k", "u", "best", "again", "mismatched", "values", "rebuilt", "text")], ids.alias("ids"), nearer.alias("nearer"), clear.alias("clear"))

    def third_step(q: Column) -> Column:
        clean = F.when(q["clear"] == "", q["text"]).otherwise(q["clear"])
        return F.struct(*[q[c].alias(c) for c in ("k", "u", "best", "again", "mismatched", "rebuilt", "text", "ids", "nearer")], clean.alias("clean"), F.when(F.size(q["values"]) > 0, without_literals(clean, q["values"])).otherwise(clean).alias("final"))

    def update(q: Column) -> Column:
        k = q["k"]
        codes = _codes((q["rebuilt"], _code("rebuilt_project_update", k)), (q["nearer"], _code("narrowed_project_update_evidence", k)), (q["clean"] != q["text"], _code("dropped_ungrounded_project_update_entity_clause", k)), (q["final"] != q["clean"], _code("neutralized_ungrounded_project_update_literals", k)))
        x = F.struct(q["u"]["participant"].alias("participant"), F.when(q["rebuilt"], FOLLOW_UP).otherwise(q["u"]["project"]).alias("project"), q["final"].alias("text"), q["ids"].alias("ids"), q["best"].alias("best"))
        return F.struct(x.alias("x"), codes.alias("codes"), F.when(q["again"], _code("dropped_duplicate_project_update", k)).alias("again"), (q["mismatched"] & q["best"].isNull()).alias("stuck"))

    r = r.withColumn("updated", F.transform("updates", judged))
    for step in (first_step, second_step, third_step, update):
        r = r.withColumn("updated", F.transform("updated", step))
    r = r.withColumn("single", F.transform(F.filter("updated", lambda y: y["again"].isNull()), lambda y: y["x"]))

    def upgrade(u: Column, i: Column) -> Column:
        up = F.coalesce((u["project"] == FOLLOW_UP) & u["best"].isNotNull() & (u["ids"] != u["best"]["ids"]), F.lit(False))
        return F.struct(F.struct(u["participant"].alias("participant"), u["project"].alias("project"), F.when(up, normal_space(u["best"]["item"])).otherwise(u["text"]).alias("text"), F.when(up, u["best"]["ids"]).otherwise(u["ids"]).alias("ids")).alias("x"), F.when(up, _code("upgraded_project_update", i + 1)).alias("code"))

    r = r.withColumn("upgraded", F.transform("single", upgrade))

    some = lambda name, f: F.array_compact(F.transform(name, f))
    changes = F.concat(
        F.transform(F.array_sort("told"), lambda x: x["code"]),
        F.transform("fresh", lambda f: _code("restored_supported_candidate", f["c"])),
        some("decided", lambda x: F.when(x["gone"], _code("dropped_ungrounded_decision", x["old"])).when(x["changed"], _code("dropped_ungrounded_decision_entity_clause", x["old"]))),
        some("supported", lambda s, i: F.when(s["other"] & F.array_contains("left", s["k"]), _code("repaired_decision_support_basis", i + 1))),
        some("new_dispositions", lambda d, i: F.when(d["cut"], _code("shortened_candidate_disposition_reason", i + 1))),
        F.flatten(F.transform("updated", lambda y: y["codes"])),
        some("updated", lambda y: y["again"]),
        some("upgraded", lambda y: y["code"]),
    )
    stuck = F.exists("updated", lambda y: y["stuck"]) | F.exists("made", lambda m: m["item"] == "") | F.exists("fresh", lambda f: f["item"] == "") | F.exists("actions", lambda a: a["basis"].isNull())
    new = {
        "actions": F.col("new_actions"),
        "dispositions": F.transform("new_dispositions", lambda d: d["x"]),
        "updates": F.transform("upgraded", lambda y: y["x"]),
        "decisions": F.transform(F.filter("decided", lambda x: ~x["gone"]), lambda x: F.struct(x["text"].alias("text"), x["ids"].alias("ids"))),
        "decision_supports": new_supports,
    }
    r = r.withColumns({"stuck": F.coalesce(stuck, F.lit(False)), "changes": changes, **{f"out_{n}": c for n, c in new.items()}})
    keep = {n: F.when(F.col("stuck"), F.col(n)).otherwise(F.col(f"out_{n}")) for n in new}
    return r.select(*[c for c in reviews.columns if c not in keep], *[c.alias(n) for n, c in keep.items()], F.when(F.col("stuck"), none).otherwise(F.col("changes")).alias("changes"))


def once(reviews: DataFrame, records: DataFrame) -> DataFrame:
    """The outcome of one round. What the reviews are made of is written to the shared scratch folder first: the round asks for it again and again."""
    scratch(reviews.sparkSession)
    return repaired(reasons(with_evidence(reviews.checkpoint(), records)).checkpoint())


@dataclass
class Settled:
    """reviews: their last state. rounds: doc, round (from 1), errors (found before it), changes. left: doc, errors that no round mended."""

    reviews: DataFrame
    rounds: DataFrame
    left: DataFrame


def settled(reviews: DataFrame, records: DataFrame, most: int = 12) -> Settled:
    """Rounds until no review changes, of those that changed only. A review that a round brings back to an earlier state, or that still
    changes after ``most`` rounds, stays as that round leaves it, so that it ends on any input. Reasons from outside (``given``) hold for the first
    round only: what they name may have moved. Each round is written to the shared scratch folder."""
    scratch(reviews.sparkSession)
    state = F.xxhash64(*COLUMNS)
    now = reasons(with_evidence(reviews.checkpoint(), records)).withColumn("seen", F.array(state)).checkpoint()
    kept = [c for c in now.columns if c not in ("given", "errors", "seen")]
    done, log, left = None, None, None
    for n in range(1, most + 1):
        out = repaired(now).withColumn("was", F.col("errors")).drop("given")
        out = reasons(out).withColumn("state", state).checkpoint()
        again = (F.size("changes") == 0) | F.array_contains("seen", F.col("state"))
        rounds = out.where(F.size("changes") > 0).select("doc", F.lit(n).alias("round"), F.col("was").alias("errors"), "changes")
        ended = out.where(again)
        log = rounds if log is None else log.unionByName(rounds)
        done = ended.select(*kept) if done is None else done.unionByName(ended.select(*kept))
        lacks = ended.where(F.size("errors") > 0).select("doc", "errors")
        left = lacks if left is None else left.unionByName(lacks)
        now = out.where(~again).withColumn("seen", F.concat("seen", F.array("state"))).select(*kept, "errors", "seen")
        if now.isEmpty():
            break
    else:
        done, left = done.unionByName(now.select(*kept)), left.unionByName(now.where(F.size("errors") > 0).select("doc", "errors"))
    return Settled(done, log, left)
