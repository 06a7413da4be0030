"""Joins and unions of intervals."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.columns import overlap


def overlap_join(left: DataFrame, right: DataFrame, on: list[str], width: int = 60_000) -> DataFrame:
    """Pairs with equal keys whose [start_ms, end_ms) overlap, and ``shared``; the right side's other columns get the prefix r_.

    Both sides are dealt to time buckets of ``width``, so that the join is on equal values and a long recording is no
    single key; a pair is kept in the first bucket that both have."""
    right = right.select(*on, *[F.col(c).alias(f"r_{c}") for c in right.columns if c not in on])
    a = left.where("end_ms > start_ms").withColumn("bucket", F.explode(F.sequence(F.floor(F.col("start_ms") / width), F.floor((F.col("end_ms") - 1) / width))))
    b = right.where("r_end_ms > r_start_ms").withColumn("bucket", F.explode(F.sequence(F.floor(F.col("r_start_ms") / width), F.floor((F.col("r_end_ms") - 1) / width))))
    first = F.greatest(F.floor(F.col("start_ms") / width), F.floor(F.col("r_start_ms") / width))
    shared = overlap(F.col("start_ms"), F.col("end_ms"), F.col("r_start_ms"), F.col("r_end_ms"))
    return a.join(b, [*on, "bucket"]).where(F.col("bucket") == first).withColumn("shared", shared).where("shared > 0").drop("bucket")


def band_join(left: DataFrame, right: DataFrame, on: list[str], radius: int) -> DataFrame:
    """Pairs with equal keys and \\|t - r_t\\| <= radius. left and right have t; a bucket is one radius wide."""
    width = max(1, radius)
    a = left.withColumn("bucket", F.explode(F.array(*[F.floor(F.col("t") / width) + i for i in (-1, 0, 1)])))
    b = right.select(*on, *[F.col(c).alias(f"r_{c}") for c in right.columns if c not in on]).withColumn("bucket", F.floor(F.col("r_t") / width))
    return a.join(b, [*on, "bucket"]).where(F.abs(F.col("t") - F.col("r_t")) <= radius).drop("bucket")


def attach_speakers(segments: DataFrame, turns: DataFrame) -> DataFrame:
    """rec, ord, speaker, share and coverage (thousandths): of each segment with an overlap, the speaker with the most of it.

    A tie goes to the speaker whose turn comes first. share is of all overlap, coverage of the segment."""
    pairs = overlap_join(segments.drop("speaker"), turns, ["rec"])
    by = pairs.groupBy("rec", "ord", "start_ms", "end_ms", F.col("r_speaker").alias("speaker")).agg(F.sum("shared").alias("best"), F.min("r_turn").alias("first"))
    best = Window.partitionBy("rec", "ord").orderBy(F.desc("best"), "first")
    by = by.withColumn("all", F.sum("best").over(Window.partitionBy("rec", "ord"))).withColumn("rn", F.row_number().over(best)).where("rn = 1")
    return by.select("rec", "ord", "speaker", F.floor(F.col("best") * 1000 / F.col("all")).alias("share"), F.floor(F.col("best") * 1000 / (F.col("end_ms") - F.col("start_ms"))).alias("coverage"))


def merged(rows: DataFrame, by: list[str], reach: int = 0) -> DataFrame:
    """by, start_ms, end_ms, n: intervals merged where the next starts no later than ``reach`` after all before it end."""
    order = Window.partitionBy(*by).orderBy("start_ms", "end_ms")
    end = F.max("end_ms").over(order.rowsBetween(Window.unboundedPreceding, -1))
    rows = rows.withColumn("new", F.when(F.col("start_ms") <= end + reach, 0).otherwise(1))
    rows = rows.withColumn("island", F.sum("new").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    return rows.groupBy(*by, "island").agg(F.min("start_ms").alias("start_ms"), F.max("end_ms").alias("end_ms"), F.count("*").alias("n")).drop("island")


def coverage(rows: DataFrame, by: list[str], least: int) -> DataFrame:
    """by, covered: length of the union of intervals, of those with ``least`` or more."""
    return merged(rows, by).groupBy(*by).agg(F.sum(F.col("end_ms") - F.col("start_ms")).alias("covered")).where(F.col("covered") >= least)


def as_of(left: DataFrame, right: DataFrame, on: list[str], keep: list[str]) -> DataFrame:
    """left (t, id), and of the latest right row with t no later, the columns ``keep`` with prefix r_ (null if there is none).

    One sorted pass over the union of both sides; no pairs are formed."""
    a = left.withColumn("__side", F.lit(1)).withColumn("__row", F.lit(None).cast(right.select(F.struct(*keep)).schema[0].dataType))
    b = right.select(*on, "t", F.struct(*keep).alias("__row")).withColumn("__side", F.lit(0))
    order = Window.partitionBy(*on).orderBy("t", "__side").rowsBetween(Window.unboundedPreceding, 0)
    both = a.unionByName(b, allowMissingColumns=True).withColumn("__last", F.last("__row", ignorenulls=True).over(order)).where("__side = 1")
    return both.select(*left.columns, *[F.col("__last")[c].alias(f"r_{c}") for c in keep])


def _merged(left: DataFrame, right: DataFrame, on: list[str], at: str) -> DataFrame:
    """Both sides in one relation: left rows whole in __row with __t their ``at``, right rows with __t their start, __b their end."""
    known = reduce(Column.__and__, (F.col(c).isNotNull() for c in on))
    a = left.where(known & F.col(at).isNotNull()).select(*on, F.col(at).alias("__t"), F.struct(*left.columns).alias("__row"))
    b = right.where(known & F.col("start_ms").isNotNull() & F.col("end_ms").isNotNull()).select(*on, F.col("start_ms").alias("__t"), F.col("end_ms").alias("__b"))
    return a.unionByName(b, allowMissingColumns=True)


def nearest_gap(left: DataFrame, right: DataFrame, on: list[str]) -> DataFrame:
    """left (start_ms, end_ms and others) with gap to the nearest interval of right with equal keys, 0 where they touch or overlap.

    Of the intervals that start no later than a row ends, the one that ends last is nearest; of the others, the one that starts first.
    So one sorted pass each way over both sides gives both, and no pairs are formed. An interval ends no earlier than it starts. Rows
    without an interval of their keys, and rows and intervals with a null key or time, are left out."""
    key = Window.partitionBy(*on)
    side = F.col("__row").isNotNull()  # at equal times an interval comes before the rows it meets
    before = F.max("__b").over(key.orderBy("__t", side).rowsBetween(Window.unboundedPreceding, 0))
    after = F.min(F.when(~side, F.col("__t"))).over(key.orderBy(F.desc("__t"), F.desc(side)).rowsBetween(Window.unboundedPreceding, 0))
    both = _merged(left.where("start_ms IS NOT NULL"), right, on, "end_ms").withColumns({"__before": before, "__after": after}).where(side)
    gap = F.least(F.when(F.col("__before").isNotNull(), F.greatest(F.lit(0), F.col("__row.start_ms") - F.col("__before"))), F.col("__after") - F.col("__row.end_ms"))
    return both.withColumn("__gap", gap).where("__gap IS NOT NULL").select("__row.*", F.col("__gap").alias("gap"))


def starting_inside(left: DataFrame, right: DataFrame, on: list[str]) -> DataFrame:
    """left rows that start in an interval of right with equal keys, its ends included: that of all begun so far which ends last is not over.

    One sorted pass; a row with a null key or start is in none."""
    side = F.col("__row").isNotNull()
    last = F.max("__b").over(Window.partitionBy(*on).orderBy("__t", side).rowsBetween(Window.unboundedPreceding, 0))
    return _merged(left, right, on, "start_ms").withColumn("__last", last).where(side & (F.col("__last") >= F.col("__t"))).select("__row.*")


def contained(left: DataFrame, right: DataFrame, on: list[str], width: int = 60_000) -> DataFrame:
    """left rows wholly in an interval of right, with the start and end of the first one, as in_a and in_b."""
    pairs = overlap_join(left, right.select(*on, "start_ms", "end_ms"), on, width).where("start_ms >= r_start_ms AND end_ms <= r_end_ms")
    first = F.min(F.struct("r_start_ms", "r_end_ms")).alias("x")
    return pairs.groupBy(*left.columns).agg(first).select(*left.columns, F.col("x.r_start_ms").alias("in_a"), F.col("x.r_end_ms").alias("in_b"))
