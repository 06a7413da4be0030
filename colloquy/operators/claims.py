"""Checks of proposed claims against their evidence. Each gives reasons; none is a pass."""

from __future__ import annotations

import difflib

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType

from .documents import numbers

#: Wording that a claim must not have.
WEB, ACTION, SIGNS = r"(?i)https?://|www\.", r"(?i)\b(?:will|must|shall|todo)\b", r"[{}<>\[\]]"
#: Letters of a token that may be spelled in another way, and how alike the spellings must be.
LONG, LIKE = 7, 0.84


def reasons(*checks: tuple[Column, str]) -> Column:
    """Names of the checks that hold, in order; a check of unknown outcome doesn't hold."""
    return F.array_compact(F.array(*[F.when(c, F.lit(n)) for c, n in checks]))


def text_errors(text: Column, longest: int) -> Column:
    return reasons((F.length(F.trim(text)) == 0, "empty"), (F.length(text) > longest, "too_long"), (text.rlike(WEB), "web_address"), (text.rlike(ACTION), "action_wording"), (text.rlike(SIGNS), "markup"))


def capped(rows: DataFrame, by: list[str], section: str, order: list[str], most: dict[str, int]) -> DataFrame:
    """rows with place (from 1, in its section of ``by``) and reason: sections unknown to ``most``, and places beyond it."""
    limits = F.create_map(*[F.lit(x) for kv in most.items() for x in kv])
    place = F.row_number().over(Window.partitionBy(*by, section).orderBy(*order)).cast("long")
    limit = F.try_element_at(limits, F.col(section))
    return rows.withColumn("place", place).withColumn("reason", F.when(limit.isNull(), "section_unknown").when(F.col("place") > limit, "section_full"))


def ungrounded_numbers(claims: DataFrame, evidence: DataFrame, key: str) -> DataFrame:
    """key, missing: numbers of a claim (key, text) that none of its evidence (key, text) has. Distinct numbers by key meet, not texts."""
    have = evidence.select(key, F.explode(numbers(F.col("text"))).alias("n")).distinct()
    need = claims.select(key, F.explode(numbers(F.col("text"))).alias("n")).distinct()
    return need.join(have, [key, "n"], "left_anti").groupBy(key).agg(F.array_sort(F.collect_set("n")).alias("missing"))


def exact_cover(wanted: DataFrame, given: DataFrame, key: str) -> DataFrame:
    """key, reason: keys given not at all, more than once, or unasked."""
    a = wanted.select(key).distinct().withColumn("__w", F.lit(True))
    n = given.groupBy(key).agg(F.count("*").alias("__n"))
    both = a.join(n, key, "full_outer")
    reason = F.when(F.col("__n").isNull(), "missing").when(F.col("__w").isNull(), "unknown").when(F.col("__n") > 1, "repeated")
    return both.select(key, reason.alias("reason")).where("reason IS NOT NULL")


def partition_errors(ranges: DataFrame, by: list[str], most_gap: int, least: int) -> DataFrame:
    """by, start_ms, reason: ranges in order that overlap, leave a gap over ``most_gap``, or span less than ``least``."""
    end = F.lag("end_ms").over(Window.partitionBy(*by).orderBy("start_ms", "end_ms"))
    rows = ranges.withColumn("__p", end)
    found = reasons((F.col("start_ms") < F.col("__p"), "overlap"), (F.col("start_ms") - F.col("__p") > most_gap, "gap"), (F.col("end_ms") - F.col("start_ms") < least, "short"))
    return rows.select(*by, "start_ms", F.explode(found).alias("reason"))


def coded(errors: DataFrame, name: str) -> DataFrame:
    """row, value: of codes ``name:row`` or ``name:row:value``; others are left out."""
    parts = F.split("code", ":", 3)
    return errors.where(F.col("code").rlike(rf"^{name}:\d+(:.*)?$")).select(parts[1].cast("long").alias("row"), F.try_element_at(parts, F.lit(3)).alias("value"))


def first_of_duplicates(rows: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The first row of each key in order, with n: how many there are."""
    w = Window.partitionBy(*keys)
    return rows.withColumn("__i", F.row_number().over(w.orderBy(*order))).withColumn("n", F.count("*").over(w)).where("__i = 1").drop("__i")


@F.pandas_udf(BooleanType())
def _spelled_like(token: pd.Series, near: pd.Series) -> pd.Series:
    """Whether one of a few words shares enough blocks with the token, batch by batch."""
    return pd.Series([any(difflib.SequenceMatcher(None, t, w).ratio() >= LIKE for w in words) for t, words in zip(token, near, strict=True)], dtype=bool)


def grounded(token: Column, evidence: Column) -> Column:
    """Whether the evidence holds the token, case, space and punctuation aside; or, for a long token of ASCII letters and digits, a word
    spelled almost so. An empty or null token needs no ground; null evidence is empty. Python sees only words of a like length and start."""

    def compact(text: Column) -> Column:
        return F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), r"[^a-z0-9\u4e00-\u9fff]+", "")

    t = compact(token)
    exact = F.contains(compact(evidence), t)
    words = F.regexp_extract_all(F.lower(F.coalesce(evidence, F.lit(""))), F.lit("[a-z0-9]+"), F.lit(0))
    near = F.filter(F.array_distinct(words), lambda w: (F.length(w) >= LONG) & (F.abs(F.length(w) - F.length(t)) <= 2) & (F.left(w, F.lit(4)) == F.left(t, F.lit(4))))
    return exact | _spelled_like(t, F.when(~exact & t.rlike(f"^[a-z0-9]{{{LONG},}}$"), near).otherwise(F.array().cast("array<string>")))
