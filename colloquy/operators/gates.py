"""Gates: relations of reasons. A relation without rows passes."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def set_difference(a: DataFrame, b: DataFrame, on: list[str]) -> DataFrame:
    """on, reason: keys of one side only."""
    x = a.select(*on).distinct().withColumn("__a", F.lit(1))
    y = b.select(*on).distinct().withColumn("__b", F.lit(1))
    both = x.join(y, on, "full_outer")
    return both.where("__a IS NULL OR __b IS NULL").select(*on, F.when(F.col("__a").isNull(), "missing").otherwise("unexpected").alias("reason"))


def unknown_references(rows: DataFrame, ids: str, known: DataFrame, key: str) -> DataFrame:
    """rows' exploded ids that ``known`` lacks."""
    each = rows.withColumn(key, F.explode(ids)).drop(ids)
    return each.join(known.select(key).distinct(), key, "left_anti")


def paired_once(a: DataFrame, b: DataFrame, on: list[str], order: str) -> DataFrame:
    """on, a_n, b_n, ok: each key's rows on both sides pair one to one."""
    x, y = a.groupBy(*on).agg(F.count("*").alias("a_n")), b.groupBy(*on).agg(F.count("*").alias("b_n"))
    zero = F.lit(0).cast("long")
    out = x.join(y, on, "full_outer").select(*on, F.coalesce("a_n", zero).alias("a_n"), F.coalesce("b_n", zero).alias("b_n"))
    return out.withColumn("ok", F.col("a_n") == F.col("b_n"))


def ordered_cover(rows: DataFrame, by: list[str], position: str) -> DataFrame:
    """by, position, reason: positions that repeat, or leave a gap after the one before."""
    w = Window.partitionBy(*by).orderBy(position)
    step = F.col(position) - F.lag(position).over(w)
    return rows.withColumn("reason", F.when(step == 0, "duplicated").when(step > 1, "gap")).where("reason IS NOT NULL").select(*by, position, "reason")


def stale(now: DataFrame, bound: DataFrame, key: str, value: str) -> DataFrame:
    """key, reason: bound fingerprints that differ from today's, or have none."""
    joined = bound.select(key, F.col(value).alias("__was")).join(now.select(key, F.col(value).alias("__is")), key, "left")
    return joined.where(~F.col("__was").eqNullSafe(F.col("__is"))).select(key, F.when(F.col("__is").isNull(), "missing").otherwise("changed").alias("reason"))


def unchanged(a: DataFrame, b: DataFrame) -> DataFrame:
    """Rows of either relation that the other lacks, duplicates counted."""
    return a.exceptAll(b).withColumn("side", F.lit("first")).unionByName(b.exceptAll(a).withColumn("side", F.lit("second")))
