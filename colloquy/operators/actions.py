"""What a text says of work to be done: who takes it on, with which cue, and for how long. Column expressions only.

Texts are compared in their normal form, a column made before (see :func:`identity.normal_form`). Spans of several families of cues are found side by side and
put in one order by place; a text gives as many rows as it has cues."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import cues

#: Topics and what their texts hold, in order; one that counts only where another doesn't.
TOPICS = (
    ("mpc", r"(?:^|[^a-z0-9])mpc(?:[^a-z0-9]|$)"),
    ("private_key_encryption", "private key|encrypt|私钥|加密"),
    ("bps", r"(?:^|[^a-z0-9])bps(?:[^a-z0-9]|$)"),
    ("zero_confirmation", "zero confirmation|零确认"),
    ("api_gateway", "gateway|网关"),
    ("merchant_onboarding", r"\b(?:onboard|onboarding)\b|商户接入"),
    ("meeting_notes", r"\b(?:meeting notes?|minutes)\b|会议纪要"),
    ("business_requirements", r"\bbusiness (?:needs?|requirements?)\b|业务需求"),
    ("source_control_migration", "github|gitlab|git lab"),
    ("invoice_review", "invoice|发票|账单"),
    ("contract", "contract|合同"),
    ("api_documentation", "swagger|postman|documentation|api docs|文档"),
    ("manual_payout", "manual payout|手动付款|手动出款"),
    ("merchant_authentication", "api key|authentication|merchant id|认证|商户标识"),
    ("team_metrics", " kpi|metrics|code lines|merge requests|绩效|度量"),
)
UNLESS = {"bps": "private_key_encryption"}
#: What denies and what claims downtime.
NO_DOWNTIME = "(?:does not|doesnt|doesn t|do not|dont|don t) require (?:a )?downtime|no downtime|without downtime|不需要停机|无需停机"
DOWNTIME = "(?:requires?|needs?) (?:a )?downtime|需要停机|需停机"
#: Number words, units of Chinese numbers, words without a value, units of time, and where they stand together.
WORDS = dict(zip("one two three four five six seven eight nine ten eleven twelve thirteen fourteen fifteen sixteen seventeen eighteen nineteen".split(), range(1, 20), strict=True)) | dict(zip("twenty thirty forty fifty sixty seventy eighty ninety".split(), range(20, 100, 10), strict=True))
DIGITS, POWERS = {**{c: i for i, c in enumerate("零一二三四五六七八九")}, "〇": 0, "两": 2}, {"十": 10, "百": 100, "千": 1000, "万": 10_000}
UNIT = r"(?:hours?|hrs?|hr|h|minutes?|mins?|min)"
TOKEN = "(?:a|an|half|zero|" + "|".join(WORDS) + "|hundred|and)"
CHINESE_UNIT, CHINESE_NUMBER = "(?:小时|钟头|分钟|分)", r"[零〇一二两三四五六七八九十百千万\d]+"
DURATION = rf"(?i)\b\d+(?:\.\d+)?\s*{UNIT}\b|\b(?:{TOKEN}\s+)*{TOKEN}\s*{UNIT}\b|半\s*(?:个)?{CHINESE_UNIT}|{CHINESE_NUMBER}\s*(?:个|多)?\s*{CHINESE_UNIT}"
VAGUE = f"(?:{TOKEN}|couple|few|several|dozen)"
SIGNAL = rf"(?i)\b(?:\d+(?:\.\d+)?|{VAGUE}(?:\s+(?:{VAGUE}|of))*)\s*{UNIT}\b|(?:半|{CHINESE_NUMBER})\s*(?:个|多)?\s*{CHINESE_UNIT}"
HOURS, ANY_UNIT = r"(?:hours?|hrs?|hr|h|小时|钟头)$", r"\s*(?:hours?|hrs?|hr|h|minutes?|mins?|min|(?:个|多)?\s*(?:小时|钟头|分钟|分))$"


def topics(plain: Column) -> Column:
    """Topics that a text in normal form tells, in the order of the rules."""
    told = {t: plain.rlike(p) for t, p in TOPICS}
    return F.array_compact(F.array(*[F.when(told[t] & (~told[UNLESS[t]] if t in UNLESS else F.lit(True)), F.lit(t)) for t, _ in TOPICS]))


def downtime(plain: Column) -> Column:
    """Three values: a denial comes first, then a claim, else nothing is known."""
    return F.when(plain.rlike(NO_DOWNTIME), False).when(plain.rlike(DOWNTIME), True)


def let(value: Column, then: Callable[[Column], Column]) -> Column:
    """``then`` of a value that is found once, however often ``then`` names it."""
    return F.get(F.transform(F.array(value), then), F.lit(0))


def _looked_up(table: dict[str, int], key: Column) -> Column:
    return F.try_element_at(F.create_map(*[F.lit(x) for kv in table.items() for x in kv]), key)


def english_amount(words: Column) -> Column:
    """Number words as a number: a hundred multiplies what stands before it, all else adds up. Null for words without a value and for a half that isn't
    alone; one where only articles are left."""

    def step(s: Column, t: Column) -> Column:
        return F.when(t == "hundred", F.greatest(s, F.lit(1.0)) * 100).otherwise(s + _looked_up(WORDS, t))

    def amount(tokens: Column) -> Column:
        total = F.aggregate(tokens, F.lit(0.0), step)  # null once a word is unknown
        return F.when(F.size(tokens) == 0, 1.0).when((F.size(tokens) == 1) & (tokens[0] == "half"), 0.5).otherwise(F.when(~F.array_contains(tokens, "half"), total))

    return let(F.filter(F.split(F.trim(words), r"\s+"), lambda t: ~t.isin("and", "a", "an", "")), amount)


def chinese_amount(number: Column) -> Column:
    """Chinese numerals as a number: each power takes the digit before it, or one. Null where digits of both kinds meet."""
    start = F.struct(F.lit(0).cast("long").alias("total"), F.lit(0).cast("long").alias("digit"))

    def step(s: Column, c: Column) -> Column:
        digit, power = _looked_up(DIGITS, c), _looked_up(POWERS, c)
        total = F.when(digit.isNotNull(), s["total"]).otherwise(s["total"] + F.when(s["digit"] == 0, 1).otherwise(s["digit"]) * power)
        return F.struct(total.cast("long").alias("total"), F.when(digit.isNotNull(), digit).otherwise(0).cast("long").alias("digit"))

    folded = F.aggregate(F.filter(F.split(number, ""), lambda c: c != ""), start, step, lambda s: (s["total"] + s["digit"]).cast("double"))
    return F.when(number.rlike(r"^\d+$"), number.cast("double")).otherwise(folded)


def minutes(mention: Column) -> Column:
    """Minutes of one mention of a length; null if its amount has no value. Halves round to even."""
    def number(amount: Column) -> Column:
        return F.when(amount.rlike(r"^\d+(?:\.\d+)?$"), amount.cast("double")).when(amount == "半", 0.5).when(amount.rlike("^[a-z ]+$"), english_amount(amount)).otherwise(chinese_amount(amount))

    n = let(F.trim(F.regexp_replace(F.lower(mention), ANY_UNIT, "")), number)
    return let(n * F.when(F.lower(mention).rlike(HOURS), 60).otherwise(1), lambda x: F.when(x > 0, F.bround(x, 0).cast("long")))


def durations(plain: Column) -> Column:
    """minutes (distinct, in order) and unparsed (mentions that no parsed one covers, distinct, in order) of a text in normal form."""
    spans = F.transform(cues.places(plain, DURATION), lambda x: F.struct(x["start"].alias("a"), (x["start"] + F.length(x["cue"])).alias("b"), minutes(x["cue"]).alias("n")))

    def of(parsed: Column) -> Column:
        bare = F.filter(cues.places(plain, SIGNAL), lambda s: ~F.exists(parsed, lambda x: (x["a"] <= s["start"]) & (s["start"] + F.length(s["cue"]) <= x["b"])))
        return F.struct(F.array_sort(F.array_distinct(F.transform(parsed, lambda x: x["n"]))).alias("minutes"), F.array_sort(F.array_distinct(F.transform(bare, lambda s: s["cue"]))).alias("unparsed"))

    return let(F.filter(spans, lambda x: x["n"].isNotNull()), of)


def attributes(plain: Column) -> Column:
    """topics, duration_minutes, unparsed_duration_mentions, downtime of a text in normal form."""
    return let(durations(plain), lambda d: F.struct(topics(plain).alias("topics"), d["minutes"].alias("duration_minutes"), d["unparsed"].alias("unparsed_duration_mentions"), downtime(plain).alias("downtime")))


def _before(text: Column, at: Column, reach: int) -> Column:
    first = F.greatest(F.lit(0), at - reach)
    return F.substring(text, first + 1, at - first)


def conditional(text: Column, at: Column) -> Column:
    """Whether an if-clause is open where a cue stands (from 0)."""
    return _before(text, at, cues.CONDITION_REACH).rlike(cues.CONDITION)


def conditional_cues(rows: DataFrame, pattern: str) -> DataFrame:
    """rec, ord, cue_at (from 1), conditional of every match in the whole texts of rows (rec, ord, text)."""
    at = rows.select("rec", "ord", "text", F.explode(cues.places(F.col("text"), pattern)).alias("x"))
    return at.select("rec", "ord", (F.col("x.start") + 1).cast("long").alias("cue_at"), conditional(F.col("text"), F.col("x.start")).alias("conditional"))


def reported(text: Column, at: Column) -> Column:
    """Whether a cue stands in a question to someone, or a report of one."""
    return _before(text, at, cues.REPORTED_REACH).rlike(cues.REPORTED)


def assignments(text: Column, owners: Column) -> Column:
    """start, cue and owner of assignments to one of ``owners`` (array of names; of names with one plain form the last counts), longer names first."""
    safe = F.transform(F.array_sort(F.transform(owners, lambda n: F.struct((-F.length(n)).alias("l"), n.alias("n")))), lambda x: F.regexp_replace(x["n"], r"([\\.\[\]{}()*+?^$|-])", r"\\$1"))
    pattern = F.concat(F.lit(r"(?i)\b(?:"), F.array_join(safe, "|"), F.lit(f"){cues.ASSIGNS}\\b"))
    named = lambda cue: F.element_at(F.filter(owners, lambda n: cues.plain_cue(n) == cues.plain_cue(F.regexp_replace(cue, f"(?i){cues.ASSIGNS}$", ""))), -1)
    none = F.array().cast("array<struct<start:int,cue:string,owner:string>>")
    found = F.transform(cues.places(text, pattern), lambda x: F.struct(x["start"].alias("start"), x["cue"].alias("cue"), named(x["cue"]).alias("owner")))
    return F.when(F.size(owners) > 0, F.filter(found, lambda x: x["owner"].isNotNull())).otherwise(none)


def weak_intents(text: Column) -> Column:
    """start, cue and cue_kind of intents that lack the force of a commitment, by place."""

    def found(pattern: str, kind: str) -> Column:
        return F.transform(cues.places(text, pattern), lambda x: F.struct(x["start"].alias("start"), F.lit(kind).alias("cue_kind"), x["cue"].alias("cue")))

    return F.array_sort(F.concat(found(cues.WEAK_GROUP, "weak_group_intent"), found(cues.WEAK_SELF, "weak_self_intent")))


def specs(text: Column, speaker: Column, trusted: Column, owners: Column) -> Column:
    """start, evidence, rank, cue, owner, kind, cue_kind, reasons of every cue of work in a text, by place, then by what tells its owner.

    Commitments of the speaker, assignments by name and weak intents are found side by side and all stay, also where they overlap; reasons hold one back
    for review. A null text has none; null owners are none."""
    text, owners = F.coalesce(text, F.lit("")), F.coalesce(owners, F.array().cast("array<string>"))
    codes = lambda *c: F.array_compact(F.array(*[F.when(holds, F.lit(code)) for holds, code in c]))

    def spec(rank: int, x: Column, owner: Column, evidence: Column, kind: str, cue_kind: Column, reasons: Column) -> Column:
        return F.struct(x["start"].alias("start"), evidence.alias("evidence"), F.lit(rank).alias("rank"), x["cue"].alias("cue"), owner.alias("owner"), F.lit(kind).alias("kind"), cue_kind.alias("cue_kind"), reasons.alias("reasons"))

    no_kind, yes = F.lit(None).cast("string"), F.lit(True)
    own = F.transform(cues.commitments(text), lambda x: spec(0, x, F.when(trusted, speaker), F.when(trusted, "speaker_self_commitment").otherwise("unresolved_speaker"), "self", no_kind, codes((conditional(text, x["start"]), "conditional_or_hypothetical"), (reported(text, x["start"]), "questioned_or_reported_commitment"))))
    direct = F.transform(assignments(text, owners), lambda x: spec(1, x, x["owner"], F.lit("explicit_name_assignment"), "direct_assignment", no_kind, codes((yes, "owner_acceptance_unverified"))))

    def weak(x: Column) -> Column:
        group = x["cue_kind"] == "weak_group_intent"
        owner = F.when(trusted & ~group, speaker)
        evidence = F.when(F.coalesce(owner, F.lit("")) != "", "speaker_weak_intent").otherwise("unresolved_weak_intent")
        return spec(2, x, owner, evidence, "weak_intent", x["cue_kind"], codes((yes, "weak_intent_cue"), (group, "owner_unresolved"), (conditional(text, x["start"]), "conditional_or_hypothetical")))

    return F.array_sort(F.concat(own, direct, F.transform(weak_intents(text), weak)))
