"""Action ledger: commitments in transcript rows, their attributes and status, by rules.

The cue lists are fixed values of our own; extend them by parameter. All rules are column expressions: a row is cut at its
cues, each piece from one cue to the next is a quote."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.columns import is_named, normal_space, stable_id

#: First-person commitments, weak intents, topics and their words, units in minutes.
SELF_CUES = ("i will", "i'll", "i need to", "let me")
WEAK_CUES = ("i might", "maybe i", "i could")
TOPICS = {"release": ("release", "deploy"), "testing": ("test", "verify"), "maintenance": ("maintenance", "restart", "downtime")}
UNITS = {"hour": 60, "minute": 1, "day": 1440}


def _any(words: tuple[str, ...]) -> str:
    return r"(?i)\b(?:" + "|".join(words) + r")\b"


def topics(text: Column) -> Column:
    """Topics whose words the text holds, in the order of the rules."""
    return F.array_compact(F.array(*[F.when(text.rlike(_any(w)), F.lit(t)) for t, w in TOPICS.items()]))


def durations(text: Column) -> Column:
    """Distinct lengths in minutes, in order."""

    def minutes(unit: str, k: int) -> Column:
        return F.transform(F.regexp_extract_all(text, F.lit(rf"(?i)\b(\d+)\s*{unit}s?\b"), F.lit(1)), lambda n: n.cast("long") * k)

    found = [minutes(u, k) for u, k in UNITS.items()]
    return F.array_sort(F.array_distinct(F.concat(*found)))


def downtime(text: Column) -> Column:
    """Three values: a denial comes first, then a claim, else nothing is known."""
    return F.when(text.rlike(r"(?i)\b(?:no|without|zero)\s+downtime\b"), False).when(text.rlike(r"(?i)\bdowntime\b"), True)


def quotes(text: Column, cues: tuple[str, ...]) -> Column:
    """Pieces from each cue to the next."""
    pieces = F.split(F.regexp_replace(text, f"({_any(cues)})", "\x01$1"), "\x01")
    return F.transform(F.slice(pieces, F.lit(2), F.greatest(F.size(pieces) - 1, F.lit(0))), lambda q: F.regexp_replace(q, r"^[ \t,;:.\-]+|[ \t,;:.\-]+$", ""))


def candidates(segments: DataFrame) -> DataFrame:
    """id, rec, ord, owner, kind, quote, topics, durations, downtime, status, reasons. segments: rec, ord, name, text.

    Accepted: a named owner, exactly one topic, a first-person commitment that isn't conditional."""

    def found(kind: str, cues: tuple[str, ...]) -> Column:
        return F.transform(quotes(F.col("text"), cues), lambda q: F.struct(F.lit(kind).alias("kind"), q.alias("quote")))

    rows = segments.withColumn("x", F.explode(F.concat(found("self", SELF_CUES), found("weak", WEAK_CUES)))).select("rec", "ord", "name", "text", "x.*")
    rows = rows.withColumns({"topics": topics(F.col("quote")), "durations": durations(F.col("quote")), "downtime": downtime(F.col("quote"))})
    reasons = F.array_sort(F.array_compact(F.array(F.when(~is_named(F.col("name")), "owner_unknown"), F.when(F.size("topics") != 1, "topic_not_single"), F.when(F.col("kind") == "weak", "weak_intent"), F.when(F.col("text").rlike(r"(?i)\bif\b[^.!?]*$") & ~F.col("quote").rlike(r"(?i)\bif\b"), "conditional"))))
    rows = rows.withColumn("reasons", reasons).withColumn("status", F.when(F.size("reasons") == 0, "accepted").otherwise("review"))
    return rows.select(stable_id("action", F.col("rec").cast("string"), F.col("ord").cast("string"), F.col("kind"), F.col("quote")).alias("id"), "rec", "ord", F.col("name").alias("owner"), "kind", "quote", "topics", "durations", "downtime", "status", "reasons")


def constraints(segments: DataFrame) -> DataFrame:
    """rec, ord, topic, downtime of rows with one topic that say whether there is downtime."""
    rows = segments.withColumn("topics", topics(F.col("text"))).withColumn("downtime", downtime(F.col("text")))
    return rows.where((F.size("topics") == 1) & F.col("downtime").isNotNull()).select("rec", "ord", F.col("topics")[0].alias("topic"), "downtime")


def published_errors(items: DataFrame, ledger: DataFrame) -> DataFrame:
    """item, reasons of published items (item, id, text, topics, minutes) against candidates: an unknown id is the only reason; else
    a text that isn't the quote (case and space aside), and topics or lengths that the candidate lacks."""
    known = ledger.select("id", F.col("quote").alias("__q"), F.col("topics").alias("__t"), F.col("durations").alias("__d"))
    both = items.join(known, "id", "left")

    def same(text: str) -> Column:
        return F.lower(normal_space(F.col(text)))

    found = F.array_compact(F.array(F.when(same("text") != same("__q"), "quote_changed"), F.when(F.size(F.array_except("topics", "__t")) > 0, "topic_added"), F.when(F.size(F.array_except("minutes", "__d")) > 0, "duration_added")))
    return both.select("item", F.when(F.col("__q").isNull(), F.array(F.lit("candidate_unknown"))).otherwise(found).alias("reasons"))
