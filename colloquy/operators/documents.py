"""Documents line by line: sections, tables, alignment of two versions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def lines(docs: DataFrame, key: str, text: str) -> DataFrame:
    """key, line_no, line, heading: each line under the last heading (``## ``) at or before it."""
    rows = docs.select(key, F.posexplode(F.split(text, "\n")).alias("line_no", "line"))
    title = F.when(F.col("line").startswith("## "), F.trim(F.substring("line", 4, 1_000_000)))
    return rows.withColumn("heading", F.last(title, ignorenulls=True).over(Window.partitionBy(key).orderBy("line_no").rowsBetween(Window.unboundedPreceding, 0)))


def table_cells(line: Column) -> Column:
    """Cells of a table row, trimmed; null for other lines and for the rule below the head."""
    cells = F.transform(F.split(F.regexp_replace(F.trim(line), r"^\||\|$", ""), r"\|"), lambda c: F.trim(c))
    return F.when(F.trim(line).rlike(r"^\|.*\|$") & ~F.trim(line).rlike(r"^[|:\- ]+$"), cells)


def heading_errors(rows: DataFrame, key: str, wanted: list[str]) -> DataFrame:
    """key, reason: headings that aren't exactly the wanted ones, in order."""
    heads = F.transform(F.array_sort(F.collect_list(F.when(F.col("line").startswith("## "), F.struct("line_no", "heading")))), lambda x: x["heading"])
    got = rows.groupBy(key).agg(heads.alias("heads"))
    want = F.array(*map(F.lit, wanted))
    reason = F.when(F.size(F.array_except(want, F.col("heads"))) > 0, "heading_missing").when(F.size(F.array_except(F.col("heads"), want)) > 0, "heading_unknown").when(F.col("heads") != want, "heading_order")
    return got.select(key, reason.alias("reason")).where("reason IS NOT NULL")


def numbers(text: Column) -> Column:
    """Sorted multiset of the numbers in a text."""
    return F.array_sort(F.regexp_extract_all(text, F.lit(r"\d+(?:\.\d+)?"), F.lit(0)))


def misaligned(a: DataFrame, b: DataFrame, key: str, position: str, text: str) -> DataFrame:
    """key, position, reason: rows of two versions that lack each other or differ in their numbers."""
    joined = a.select(key, position, F.col(text).alias("x")).join(b.select(key, position, F.col(text).alias("y")), [key, position], "full_outer")
    reason = F.when(F.col("x").isNull() | F.col("y").isNull(), "row_missing").when(numbers(F.col("x")) != numbers(F.col("y")), "numbers_differ")
    return joined.select(key, position, reason.alias("reason")).where("reason IS NOT NULL")
