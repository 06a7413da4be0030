"""Contract of proposed minutes: a nested JSON payload against the recording that it tells of.

Each level is taken apart once: sections into items, themes into points, and whatever cites rows into its ids, which meet the recording in one join. A breach
is a row (doc, path, code); siblings see each other by windows. Payloads are read as text level by level, so that a wrong kind at one place
is a breach there and not the loss of the whole."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.columns import bigram_share, normal_space, one_decimal
from ..sources.tables import scratch
from .cues import FUTURE
from .repairs import AGREES, SECOND_TASK, SPAN

#: Sizes of sections and titles, shortest long recording and span of a theme in it, widest gap in a theme's rows (seconds), seconds a theme.
MOST = {"themes": 10, "decisions": 4, "actions": 24}
MOST_POINTS, TITLE_ZH, TITLE_EN = 3, 56, 88
LONG, THEME_SPAN, THEME_GAP, PER_THEME = 3600.0, 180.0, 1500.0, 1800.0
#: The keys of each kind of item, and which of its texts are asked for by which name.
KEYS = {
    "theme": ("title_zh", "title_en", "current_state_zh", "current_state_en", "outcome_zh", "outcome_en", "evidence_segment_ids", "key_points"),
    "point": ("speaker", "text_zh", "text_en", "segment_ids"),
    "project_update": ("participant", "project_zh", "project_en", "update_zh", "update_en", "segment_ids"),
    "decision": ("text_zh", "text_en", "segment_ids"),
    "action": ("owner", "item_zh", "item_en", "segment_ids"),
}
TEXTS = {"theme": ("title", "current_state", "outcome"), "point": ("text",), "project_update": ("project", "update"), "decision": ("text",), "action": ("item",)}
SECTIONS = {"themes": "theme", "project_updates": "project_update", "decisions": "decision", "actions": "action"}
#: The owner of a request to nobody, names of nobody, and wording that titles and outcomes must not have, or need beside it.
UNASSIGNED = "待确认"
NOBODY, ANONYMOUS = r"(?i)^(?:speaker(?:[_\s-]*\d+| unknown)?|unknown|unresolved|unassigned)$", r"(?i)\bspeaker(?:[_\s-]*(?:\d+|unknown))\b"
COMBINED, GENERIC = "[／/]", r"(?i)^(?:intermediate\s+operational\s+discussion|general\s+discussion|other\s+discussion|miscellaneous|中间运营讨论|一般讨论|其他讨论)$"
FACT, QUALIFIED = r"(?i)(?:API\s*Gateway|API网关|网关|系统|平台|BPS|文档)[^。.!?]{0,20}(?:将|will\b|is\s+going\s+to\b)", r"(?i)(?:讨论|提议|建议|方向|计划|预计|可能|尚未|待评估|proposal|proposed|direction|plan|expected|may|might|not\s+decided)"
CONSENSUS = r"(?i)(?:讨论(?:形成|达成)共识|(?:形成|达成)共识|\b(?:a\s+)?consensus\s*(?::|was\s+(?:formed|reached)|has\s+been\s+(?:formed|reached))|\bconsensus\s*:)"
UNCONFIRMED = r"(?i)(?:(?:将|会)\s*(?:构建|实施|迁移|部署|建立|替换|开发|实现|安排|推进|采用)|(?:团队|大家|我们)(?:已)?(?:同意|一致同意|决定|确认)\s*(?:将|会)?\s*(?:构建|实施|迁移|部署|建立|替换|开发|实现|安排|推进|采用)|\b(?:we|the\s+team|team)\s+(?:agreed?\s+to|decid(?:e|ed)\s+to|will)\s+(?:build|implement|migrate|deploy|establish|replace|develop|arrange|advance|adopt)|\b(?:the\s+)?(?:system|platform|api\s+gateway|bps|document)\s+will\s+(?:build|implement|migrate|deploy|establish|replace|develop|arrange|advance|adopt))"
UNRESOLVED = r"(?i)(?:尚未|未形成|待(?:评估|确认|决定)|可能|提议|建议|方案|discussion|proposed|proposal|may|might|not\s+(?:be\s+)?decided|pending)"
REQUESTED = r"(?i)\bi\s+need\s+(?:your\s+)?help(?:\s+\w+){0,8}?\s+to\s+(?:retest|retry|regenerate|generate|test|collect|provide|send|prepare|review|fix|implement|investigate|coordinate|schedule|update|deploy)\b"
#: Texts alike by so much are one action.
ALIKE = 0.5

_NAMES = ("speaker", "participant", "owner")
_UNIT = "struct<" + ",".join(f"{k}:string" for k in sorted({k for ks in KEYS.values() for k in ks} - {"evidence_segment_ids", "segment_ids"})) + ",evidence_segment_ids:string,segment_ids:string>"


def _list(text: Column) -> Column:
    """A JSON list's elements as texts; null for anything else."""
    return F.when(F.ltrim(text).startswith("["), F.from_json(text, "array<string>"))


def _is(raw: Column, keys: tuple[str, ...]) -> Column:
    """Whether a JSON text is an object with just these keys."""
    return F.coalesce(F.array_sort(F.json_object_keys(raw)) == F.array_sort(F.array(*map(F.lit, keys))), F.lit(False))


def _plain(text: Column) -> Column:
    return normal_space(F.coalesce(text, F.lit("")))


def real(name: Column) -> Column:
    return (name != "") & ~name.rlike(NOBODY)


def units(payloads: DataFrame) -> DataFrame:
    """doc, kind, i, j (0 but for points), path, raw, fine (the keys are as they must be), x (its fields as texts), ids (cited, as given; null: no list)."""
    sections = F.array(*[F.struct(F.lit(k).alias("kind"), F.get_json_object("payload", f"$.{s}").alias("list")) for s, k in SECTIONS.items()])
    items = payloads.select("doc", F.explode(sections).alias("s")).select("doc", "s.kind", F.posexplode(_list(F.col("s.list"))).alias("i", "raw"))
    items = items.select("doc", "kind", F.col("i") + 1, F.lit(0).alias("j"), "raw").toDF("doc", "kind", "i", "j", "raw")
    points = items.where("kind = 'theme'").where(_is(F.col("raw"), KEYS["theme"])).select("doc", F.lit("point").alias("kind"), "i", F.posexplode(_list(F.get_json_object("raw", "$.key_points"))).alias("j", "raw"))
    rows = items.unionByName(points.withColumn("j", F.col("j") + 1))
    fine = F.lit(False)
    for kind, keys in KEYS.items():
        fine = fine | ((F.col("kind") == kind) & _is(F.col("raw"), keys))
    path = F.when(F.col("kind") == "point", F.concat_ws(":", F.lit("theme"), "i", F.lit("point"), "j")).otherwise(F.concat_ws(":", "kind", "i"))
    rows = rows.withColumns({"path": path, "fine": fine}).withColumn("x", F.when(F.col("fine"), F.from_json("raw", _UNIT)))
    return rows.withColumn("ids", _list(F.coalesce("x.evidence_segment_ids", "x.segment_ids")))


def breaches(payloads: DataFrame, records: DataFrame, required: DataFrame) -> DataFrame:
    """doc, code: every breach once. payloads: doc, payload (JSON). records: doc, id, start, end, speaker, text. required: doc, participant.

    The payloads, and what their items cite, are written to the shared scratch folder once. A payload that is no object, has other keys or no themes has that one breach only. Items of a wrong shape have that breach and take part in
    nothing else. Null payloads are no objects; a recording without rows has no speakers."""
    top = F.array_sort(F.json_object_keys("payload"))
    shape = F.when(top.isNull(), "payload_not_object").when(top != F.array_sort(F.array(*map(F.lit, SECTIONS))), "top_level_keys_invalid").when(F.coalesce(F.size(_list(F.get_json_object("payload", "$.themes"))), F.lit(0)) <= 0, "themes_missing")
    scratch(payloads.sparkSession)
    shaped = payloads.select("doc", "payload", shape.alias("shape")).checkpoint()
    unfit = shaped.where("shape IS NOT NULL").select("doc", F.col("shape").alias("code"))
    p = shaped.where("shape IS NULL").select("doc", "payload")

    r = records.select("doc", "id", F.col("start").cast("double").alias("start"), F.col("end").cast("double").alias("end"), "speaker", "text")
    said = r.groupBy("doc").agg(F.max("end").alias("duration"), F.collect_set("speaker").alias("speakers"))  # a recording's speakers are few
    docs = p.join(said, "doc", "left").select("doc", "payload", F.coalesce("duration", F.lit(0.0)).alias("duration"), F.coalesce("speakers", F.array().cast("array<string>")).alias("speakers"))
    n = {s: F.size(_list(F.get_json_object("payload", f"$.{s}"))) for s in SECTIONS}
    least = F.greatest(F.lit(1), F.ceil(F.col("duration") / PER_THEME))
    whole = [
        F.when(n["themes"] < least, F.concat(F.lit("themes_too_sparse:"), n["themes"].cast("string"), F.lit("<"), least.cast("string"))),
        F.when(n["themes"] > MOST["themes"], F.concat(F.lit("themes_too_many:"), n["themes"].cast("string"), F.lit(f">{MOST['themes']}"))),
        *[F.when(_list(F.get_json_object("payload", f"$.{s}")).isNull(), f"{s}_invalid") for s in ("project_updates", "decisions", "actions")],
        *[F.when(n[s] > MOST[s], f"{s}_too_many") for s in ("decisions", "actions")],
    ]
    codes = lambda *c: F.array_compact(F.array(*c))
    of_docs = docs.select("doc", F.explode(codes(*whole)).alias("code"))

    # what is cited, and by whom
    u = units(p)
    cited = u.where("fine").select("doc", "kind", "i", "j", F.posexplode(F.array_distinct(F.filter(F.transform(F.coalesce("ids", F.array().cast("array<string>")), _plain), lambda x: x != ""))).alias("n", "id"))
    cited = cited.join(r, ["doc", "id"], "left")
    row = F.struct("n", "id", "start", "end", "speaker", "text")
    cites = cited.groupBy("doc", "kind", "i", "j").agg(F.array_sort(F.collect_list(F.when(F.col("start").isNotNull(), row))).alias("rows"), F.collect_list(F.when(F.col("start").isNull(), F.col("id"))).alias("strange"))
    none = F.array().cast("array<struct<n:int,id:string,start:double,end:double,speaker:string,text:string>>")
    u = u.join(cites, ["doc", "kind", "i", "j"], "left").join(docs.drop("payload"), "doc")
    u = u.withColumns({"rows": F.coalesce("rows", none), "strange": F.coalesce("strange", F.array().cast("array<string>")), "who": _plain(F.coalesce(*[F.col(f"x.{c}") for c in _NAMES])), "named": F.filter("speakers", real)})
    u = u.withColumn("own", F.filter("rows", lambda x: x["speaker"] == F.col("who"))).checkpoint()  # all rules ask for it
    span = lambda rows: F.array_max(F.transform(rows, lambda x: x["end"])) - F.array_min(F.transform(rows, lambda x: x["start"]))
    at = lambda *code: F.concat_ws(":", "path", *[F.lit(c) if isinstance(c, str) else c for c in code])
    kind = lambda *k: F.col("kind").isin(*k)
    long_ = lambda rows: F.when(span(rows) > SPAN, F.concat(F.col("path"), F.lit(":evidence_span_too_wide:"), one_decimal(span(rows)), F.lit(f">{SPAN:.1f}")))
    own, cites_some = F.size("own") > 0, F.size("rows") > 0
    texts = []
    for k, names in TEXTS.items():
        for name in names:
            for lang in ("zh", "en"):
                texts.append(F.when(kind(k) & (_plain(F.col(f"x.{name}_{lang}")) == ""), at(f"{name}_{lang}_missing")))
            texts.append(F.when(kind(k) & (_plain(F.col(f"x.{name}_zh")).rlike(ANONYMOUS) | _plain(F.col(f"x.{name}_en")).rlike(ANONYMOUS)), at(f"{name}_anonymous_speaker_reference")))
    for lang, longest in (("zh", TITLE_ZH), ("en", TITLE_EN)):
        title = _plain(F.col(f"x.title_{lang}"))
        texts += [F.when(kind("theme") & c, at(f"title_{lang}_{name}")) for name, c in (("too_long", F.length(title) > longest), ("combined_topic", title.rlike(COMBINED)), ("generic", title.rlike(GENERIC)))]
    points = _list(F.col("x.key_points"))
    rules = codes(
        *texts,
        F.when(F.coalesce(F.size("ids"), F.lit(0)) <= 0, at("evidence_missing")).when(~cites_some, at("evidence_unknown")),
        F.when(kind("theme") & (points.isNull() | ((F.size(points) == 0) & F.exists("rows", lambda x: real(x["speaker"])))), at("key_points_missing")),
        F.when(kind("theme") & (F.size(points) > MOST_POINTS), at("key_points_too_many")),
        F.when(kind("point"), F.when(~F.array_contains("speakers", F.col("who")), at("speaker_unknown")).when(~real(F.col("who")), at("speaker_anonymous")).when(cites_some & ~own, at("speaker_evidence_mismatch"))),
        F.when(kind("project_update"), F.when(~F.array_contains("named", F.col("who")), at("participant_unknown")).when(cites_some & ~own, at("participant_evidence_mismatch")).otherwise(long_(F.col("own")))),
        F.when(kind("action"), F.when(F.col("who") == UNASSIGNED, F.when(cites_some & ~F.array_join(F.transform("rows", lambda x: x["text"]), " ").rlike(REQUESTED), at("requested_follow_up_not_grounded"))).when(~F.array_contains("named", F.col("who")), at("owner_unknown")).when(cites_some & ~own, at("owner_evidence_mismatch")).otherwise(long_(F.col("rows")))),
        F.when(kind("action") & _plain(F.col("x.item_zh")).rlike(SECOND_TASK), at("atomicity_review_required")),
    )
    shape_code = F.when(kind("theme") & F.json_object_keys("raw").isNull(), at("not_object")).when(kind("theme"), at("keys_invalid")).otherwise(at("invalid"))
    strange = F.transform("strange", lambda x: F.concat(F.col("path"), F.lit(":evidence_unknown:"), x))
    of_units = u.select("doc", F.explode(F.when(F.col("fine"), F.concat(rules, F.when(F.size("ids") > 0, strange).otherwise(F.array().cast("array<string>")))).otherwise(F.array(shape_code))).alias("code"))

    # siblings
    fine = u.where("fine")
    before = lambda *key: Window.partitionBy("doc", *key).orderBy("i")
    again = fine.where(kind("project_update")).withColumn("m", F.row_number().over(before("who"))).where("m > 1").select("doc", at("participant_duplicate").alias("code"))
    acts = fine.where(kind("action")).withColumns({"zh": _plain(F.col("x.item_zh")), "key": F.lower(_plain(F.col("x.item_en")))})
    same = acts.withColumn("m", F.row_number().over(Window.partitionBy("doc", F.lower("who"), "key").orderBy("i"))).where("m > 1").select("doc", at("duplicate").alias("code"))
    nth = acts.withColumn("nth", F.row_number().over(Window.partitionBy("doc").orderBy("i")))  # places among the fine ones
    earlier = nth.withColumn("earlier", F.collect_list(F.struct("nth", "zh")).over(Window.partitionBy("doc", "who").orderBy("nth").rowsBetween(Window.unboundedPreceding, -1)))

    def alike(e: Column) -> Column:
        both, of = bigram_share(F.col("zh"), e["zh"])
        return both * 1.0 / of >= ALIKE

    pairs = earlier.select("doc", "nth", F.explode(F.filter("earlier", alike)).alias("e")).select("doc", F.concat_ws(":", F.lit("action"), "nth", F.lit("semantic_duplicate"), "e.nth").alias("code"))
    there = fine.where(kind("project_update")).select("doc", F.col("who").alias("participant")).distinct()
    absent = required.join(p.select("doc"), "doc").select("doc", "participant").distinct().join(there, ["doc", "participant"], "left_anti").select("doc", F.concat(F.lit("project_update_missing:"), "participant").alias("code"))

    # themes with all that they and their points cite; places among the fine ones
    themes = fine.where(kind("theme", "point")).groupBy("doc", "i").agg(F.array_distinct(F.flatten(F.collect_list(F.transform("rows", lambda x: F.struct(*[x[c].alias(c) for c in ("start", "end", "id", "text")]))))).alias("all"), F.max(F.when(kind("theme"), _plain(F.col("x.outcome_zh")))).alias("outcome"), F.first("duration").alias("duration"), F.first("named").alias("named"))
    doing = acts.groupBy("doc").agg(F.collect_list(F.struct("who", F.transform("rows", lambda x: x["start"]).alias("starts"))).alias("doing"))  # at most some dozens
    decided = fine.where(kind("decision")).groupBy("doc").agg(F.array_distinct(F.flatten(F.collect_list(F.transform("rows", lambda x: x["id"])))).alias("decided"))
    themes = themes.join(doing, "doc", "left").join(decided, "doc", "left").withColumn("decided", F.coalesce("decided", F.array().cast("array<string>")))
    themes = themes.withColumns({"nth": F.row_number().over(Window.partitionBy("doc").orderBy("i")), "all": F.array_sort("all")})
    gaps = F.zip_with(F.slice("all", F.lit(2), F.size("all")), F.slice("all", F.lit(1), F.greatest(F.size("all") - 1, F.lit(0))), lambda b, a: b["start"] - a["end"])
    reach = F.element_at("all", -1)["end"] - F.get("all", F.lit(0))["start"]
    told = F.array_join(F.transform("all", lambda x: x["text"]), " ")
    theme = lambda *code: F.concat_ws(":", F.lit("theme"), "nth", *[F.lit(c) if isinstance(c, str) else c for c in code])
    some, is_long = F.size("all") > 0, F.col("duration") >= LONG
    of_themes = themes.select("doc", F.explode(codes(
        F.when(is_long & some & (reach < THEME_SPAN), theme("span_too_short", F.concat(one_decimal(reach), F.lit(f"<{THEME_SPAN:.1f}")))),
        F.when(is_long & some & (F.array_max(gaps) > THEME_GAP), theme("evidence_gap_too_wide", F.concat(one_decimal(F.array_max(gaps)), F.lit(f">{THEME_GAP:.1f}")))),
        F.when(F.col("outcome").rlike(FACT) & ~F.col("outcome").rlike(QUALIFIED), theme("future_fact_unqualified")),
        F.when(F.col("outcome").rlike(UNCONFIRMED) & ~F.col("outcome").rlike(UNRESOLVED) & ~F.arrays_overlap(F.transform("all", lambda x: x["id"]), "decided"), theme("outcome_unconfirmed_commitment")),
        F.when(F.col("outcome").rlike(CONSENSUS) & ~told.rlike(AGREES), theme("outcome_ungrounded_consensus")),
    )).alias("code"))
    safe = lambda name: F.regexp_replace(name, r"([\\.\[\]{}()*+?^$|-])", r"\\$1")
    promised = F.filter("named", lambda m: F.rlike(F.col("outcome"), F.concat(F.lit("(?i)"), safe(m), F.lit(f"[^。.!?]{{0,28}}{FUTURE}"))))
    early, late = F.get(F.col("all"), F.lit(0))["start"] - SPAN, F.array_max(F.transform("all", lambda x: x["end"])) + SPAN
    lone = F.filter(promised, lambda m: ~F.coalesce(F.exists("doing", lambda a: (a["who"] == m) & F.exists(a["starts"], lambda t: t.between(early, late))), F.lit(False)))
    owed = themes.where(some).select("doc", "nth", F.explode(lone).alias("m")).select("doc", F.concat_ws(":", F.lit("theme"), "nth", F.lit("future_owner_without_action"), "m").alias("code"))
    out = unfit.unionByName(owed)
    for more in (of_docs, of_units, again, same, pairs, absent, of_themes):
        out = out.unionByName(more)
    return out.distinct()
