"""Where to look: sample times and windows in intervals, in whole milliseconds."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def requests(rows: DataFrame, short: int, most: int = 3) -> DataFrame:
    """rows with tenths and at: one sample time in the middle of a short interval, two in one up to twice as long (or with
    ``most`` 2), else three."""
    n = F.col("end_ms") - F.col("start_ms")

    def places(*tenths: int) -> Column:
        return F.array(*map(F.lit, tenths))

    two = (n <= 2 * short) if most > 2 else F.lit(True)
    tenths = F.when((n <= short) | F.lit(most == 1), places(5)).when(two, places(3, 7)).otherwise(places(2, 5, 8))
    return rows.withColumn("tenths", F.explode(tenths)).withColumn("at", F.col("start_ms") + F.floor(n * F.col("tenths") / 10))


def sliding(rows: DataFrame, width: int = 1600, hop: int = 800, least: int = 450) -> DataFrame:
    """rows with a, b: windows every ``hop``, and a last one that ends with the interval; a short interval is one window, and
    nothing under ``least`` is."""
    last = F.col("end_ms") - width
    starts = F.when(last <= F.col("start_ms"), F.array("start_ms")).otherwise(F.array_distinct(F.concat(F.sequence(F.col("start_ms"), last, F.lit(hop).cast("long")), F.array(last))))
    out = rows.where("end_ms > start_ms").withColumn("a", F.explode(starts)).withColumn("b", F.least(F.col("a") + width, "end_ms"))
    return out.where(F.col("b") - F.col("a") >= least)


def in_segments(rows: DataFrame, width: int = 1600, least: int = 450, edge: int = 50) -> DataFrame:
    """rows with a, b: inside the edges one window in the middle, or two about 3 and 7 tenths in a long interval; kept within it."""
    n = F.col("end_ms") - F.col("start_ms")
    cut = F.least(F.lit(edge), F.floor(n / 8))
    rows = rows.withColumn("__a", F.col("start_ms") + cut).withColumn("__b", F.col("end_ms") - cut).withColumn("__n", F.col("__b") - F.col("__a")).where(F.col("__n") >= least)
    rows = rows.withColumn("__t", F.explode(F.when(F.col("__n") * 100 <= width * 145, F.array(F.lit(5))).otherwise(F.array(F.lit(3), F.lit(7)))))
    size = F.least(F.lit(width).cast("long"), "__n")
    start = F.greatest("__a", F.col("__a") + F.floor(F.col("__n") * F.col("__t") / 10) - F.floor(size / 2))
    rows = rows.withColumn("b", F.least("__b", start + size)).withColumn("a", F.greatest("__a", F.col("b") - size))
    return rows.drop("__a", "__b", "__n", "__t")


def loud(rows: DataFrame, by: list[str], value: str, at: float = 0.4, share: float = 0.55, floor: float = 0.015) -> DataFrame:
    """Rows of each group that reach ``share`` of its quantile ``at``, and ``floor`` of its largest value."""
    gate = rows.groupBy(*by).agg(F.greatest(F.percentile(value, F.lit(at)) * share, F.max(value) * floor).alias("__gate"))
    return rows.join(gate, by).where(F.col(value) >= F.col("__gate")).drop("__gate")
