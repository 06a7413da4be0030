"""Operators over rows in order: runs, smoothing, greedy choices, packing, splits."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.tables import scratch


def drop_repeats(rows: DataFrame, by: list[str], order: str, text: str, keep: int = 3, short: int = 12) -> DataFrame:
    """Without the rows after the first ``keep`` of a run of equal short texts (ends and case aside)."""
    w = Window.partitionBy(*by).orderBy(order)
    plain = F.lower(F.trim(F.col(text)))
    rows = rows.withColumn("__new", F.when(plain == F.lag(plain).over(w), 0).otherwise(1)).withColumn("__run", F.sum("__new").over(w))
    rows = rows.withColumn("__n", F.row_number().over(Window.partitionBy(*by, "__run").orderBy(order)))
    return rows.where((F.col("__n") <= keep) | (F.length(plain) > short)).drop("__new", "__run", "__n")


def smooth(rows: DataFrame, by: list[str], label: str, most_gap: int = 1000, passes: int = 2) -> DataFrame:
    """A label between two equal others, near both, becomes theirs; twice. Ends stay."""
    w = Window.partitionBy(*by).orderBy("start_ms", "end_ms")
    near = (F.col("start_ms") - F.lag("end_ms").over(w) <= most_gap) & (F.lead("start_ms").over(w) - F.col("end_ms") <= most_gap)
    rows = rows.withColumn("__near", near)
    for _ in range(passes):
        before, after = F.lag(label).over(w), F.lead(label).over(w)
        rows = rows.withColumn("__to", F.when((before == after) & F.col("__near"), before).otherwise(F.col(label))).withColumn(label, F.col("__to")).drop("__to")
    return rows.drop("__near")


def merge_windows(rows: DataFrame, by: list[str], label: str, least: int = 350, most_gap: int = 1000) -> DataFrame:
    """by, label, start_ms, end_ms, n: trimmed to the midpoints between neighbours' centres, empty ones dropped, equal
    neighbours merged over gaps up to ``most_gap``, and short results dropped after that."""
    w = Window.partitionBy(*by).orderBy("start_ms", "end_ms")
    centre = F.col("start_ms") + F.col("end_ms")  # twice the centre
    rows = rows.withColumn("__c", centre)
    rows = rows.withColumn("__a", F.greatest("start_ms", F.coalesce(F.floor((F.lag("__c").over(w) + F.col("__c")) / 4), F.col("start_ms")))).withColumn("__b", F.least("end_ms", F.coalesce(F.floor((F.lead("__c").over(w) + F.col("__c")) / 4), F.col("end_ms"))))
    rows = rows.where("__b > __a").select(*by, label, F.col("__a").alias("start_ms"), F.col("__b").alias("end_ms"))
    same = (F.col(label) == F.lag(label).over(w)) & (F.col("start_ms") - F.lag("end_ms").over(w) <= most_gap)
    rows = rows.withColumn("__new", F.when(same, 0).otherwise(1)).withColumn("__run", F.sum("__new").over(w))
    out = rows.groupBy(*by, "__run", label).agg(F.min("start_ms").alias("start_ms"), F.max("end_ms").alias("end_ms"), F.count("*").alias("n"))
    return out.where(F.col("end_ms") - F.col("start_ms") >= least).drop("__run")


def chained(links: DataFrame, by: list[str]) -> DataFrame:
    """by, pos: the first position of each group and all that its links lead to. links: by, pos (from 1), next (a later position, null at the end).

    By doubling: after n rounds all within 2**n links are known, and each link spans 2**n. A group of any length is spread over tasks, and
    a chain of a million takes twenty rounds, each written to the shared scratch folder."""
    scratch(links.sparkSession)
    jump = links.where("next IS NOT NULL").select(*by, "pos", "next").checkpoint()
    on = links.where("pos = 1").select(*by, "pos").checkpoint()
    while True:
        reached = on.join(jump, [*by, "pos"]).select(*by, F.col("next").alias("pos")).checkpoint()
        if reached.isEmpty():
            return on
        on = on.unionByName(reached)
        further = jump.select(*by, F.col("pos").alias("next"), F.col("next").alias("last"))
        jump = jump.join(further, [*by, "next"]).select(*by, "pos", F.col("last").alias("next")).checkpoint()


def _next_from(rows: DataFrame, by: list[str], value: str, least: Column, side: int) -> DataFrame:
    """rows (by, pos, value) with next: the first position whose value reaches ``least`` (side 0), or goes beyond it (side 2). One sorted pass over the rows and
    what they look for."""
    have = rows.select(*by, F.col(value).alias("__v"), F.lit(1).alias("__side"), F.col("pos").alias("__have"), F.lit(None).cast("long").alias("__seeks"))
    seek = rows.select(*by, least.alias("__v"), F.lit(side).alias("__side"), F.lit(None).cast("long").alias("__have"), F.col("pos").alias("__seeks"))
    ahead = Window.partitionBy(*by).orderBy("__v", "__side", "__have").rowsBetween(Window.currentRow, Window.unboundedFollowing)
    found = have.unionByName(seek).withColumn("next", F.first("__have", ignorenulls=True).over(ahead)).where("__seeks IS NOT NULL")
    return rows.join(found.select(*by, F.col("__seeks").alias("pos"), "next"), [*by, "pos"])


def greedy(rows: DataFrame, by: list[str], t: str, apart: int, inclusive: bool = True) -> DataFrame:
    """by, kept: times that lie ``apart`` (at least, or more than) after the last one kept; the first is kept. Null times are none, and null keys no group.

    Each time's successor is found for all at once, then those that the first leads to (see :func:`chained`)."""
    x = rows.where(F.col(t).isNotNull()).select(*by, F.col(t).cast("long").alias("__t"))
    x = x.withColumn("pos", F.row_number().over(Window.partitionBy(*by).orderBy("__t")).cast("long"))
    if inclusive and apart <= 0:
        kept = x
    else:
        scratch(rows.sparkSession)
        linked = _next_from(x, by, "__t", F.col("__t") + apart, 0 if inclusive else 2).checkpoint()
        kept = linked.join(chained(linked, by), [*by, "pos"])
    found = kept.groupBy(*by).agg(F.array_sort(F.collect_list("__t")).alias("kept"))
    return rows.select(*by).distinct().join(found, by, "left").select(*by, F.coalesce("kept", F.array().cast("array<bigint>")).alias("kept"))


def packed(rows: DataFrame, by: list[str], order: str, size: Column, most: int) -> DataFrame:
    """rows with chunk: filled in order up to ``most``; a row beyond it starts the next, and may exceed it alone (rows without size before it aside).

    Every row's end of a chunk that would begin there is found for all at once from running sums, then the chunks that do begin (see :func:`chained`)."""
    scratch(rows.sparkSession)
    along = Window.partitionBy(*by).orderBy("__o")
    x = rows.select(*by, F.col(order).cast("long").alias("__o"), F.coalesce(size, F.lit(0)).cast("long").alias("__n"))
    x = x.withColumns({"pos": F.row_number().over(along).cast("long"), "__up": F.sum("__n").over(along)})
    # the first row with a size from here on: it stays in the chunk whatever its size
    weighty = F.first(F.when(F.col("__n") > 0, F.col("pos")), ignorenulls=True).over(along.rowsBetween(Window.currentRow, Window.unboundedFollowing))
    x = x.withColumn("__first", weighty)
    linked = _next_from(x, by, "__up", F.col("__up") - F.col("__n") + most, 2)
    last = F.max("pos").over(Window.partitionBy(*by))
    beyond = F.greatest("next", F.col("__first") + 1)
    linked = linked.withColumn("next", F.when(F.col("next").isNotNull() & (beyond <= last), beyond)).checkpoint()
    begins = chained(linked, by).withColumn("__b", F.lit(1))
    chunk = F.sum(F.coalesce("__b", F.lit(0))).over(along) - 1
    return linked.join(begins, [*by, "pos"], "left").select(*by, F.col("__o").alias(order), chunk.cast("long").alias("chunk"))


def speaker_numbers(rows: DataFrame, by: list[str], label: str) -> DataFrame:
    """rows with number: labels in order of their first start, from 1."""
    first = rows.withColumn("__first", F.min("start_ms").over(Window.partitionBy(*by, label)))
    return first.withColumn("number", F.dense_rank().over(Window.partitionBy(*by).orderBy("__first", label)).cast("long")).drop("__first")


def splits(rows: DataFrame, by: list[str], order: list[str]) -> DataFrame:
    """rows with part: position mod 5 in order: 0 held out, 1 calibration, others training."""
    k = (F.row_number().over(Window.partitionBy(*by).orderBy(*order)) - 1) % 5
    return rows.withColumn("part", F.when(k == 0, "held_out").when(k == 1, "calibration").otherwise("training"))


def spread(rows: DataFrame, by: list[str], order: list[str], k: int) -> DataFrame:
    """At most ``k`` rows at evenly spaced places, ends included; places round half to even."""
    w = Window.partitionBy(*by)
    rows = rows.withColumn("__i", F.row_number().over(w.orderBy(*order)) - 1).withColumn("__n", F.count("*").over(w))
    places = F.transform(F.sequence(F.lit(0), F.lit(k - 1)), lambda i: F.bround(i * (F.col("__n") - 1) / (k - 1), 0).cast("int"))
    return rows.where((F.col("__n") <= k) | F.array_contains(places, F.col("__i"))).drop("__i", "__n")


def unique_ids(rows: DataFrame, name: str, order: list[str]) -> DataFrame:
    """Repeated ids get -2, -3 ... in order."""
    k = F.row_number().over(Window.partitionBy(name).orderBy(*order))
    return rows.withColumn(name, F.when(k == 1, F.col(name)).otherwise(F.concat(F.col(name), F.lit("-"), k.cast("string"))))


def longest_in_windows(rows: DataFrame, by: list[str], width: int) -> DataFrame:
    """Of each tumbling window by start, the row with the longest text; ties to the earliest."""
    w = Window.partitionBy(*by, "window").orderBy(F.desc(F.length(F.trim("text"))), "start_ms", "ord")
    return rows.withColumn("window", F.floor(F.col("start_ms") / width)).withColumn("__n", F.row_number().over(w)).where("__n = 1").drop("__n")


def look_back(rows: DataFrame, by: list[str], order: str, most_rows: int, most_ms: int) -> DataFrame:
    """rows with context: how many of up to ``most_rows`` rows before are reached without a start more than ``most_ms`` away."""
    w = Window.partitionBy(*by).orderBy(order).rowsBetween(-most_rows, -1)
    starts = F.reverse(F.collect_list("start_ms").over(w))
    n = F.aggregate(starts, F.struct(F.lit(0).cast("long").alias("n"), F.lit(True).alias("on")), lambda s, x: F.struct((s["n"] + F.when(s["on"] & (F.col("start_ms") - x <= most_ms), 1).otherwise(0)).alias("n"), (s["on"] & (F.col("start_ms") - x <= most_ms)).alias("on")), lambda s: s["n"])
    return rows.withColumn("context", n)


def runs(rows: DataFrame, by: list[str], order: list[str], true: Column, least: int) -> DataFrame:
    """by, first, last, n: maximal runs of rows for which ``true`` holds, of ``least`` rows or more; first and last are places from 0."""
    w = Window.partitionBy(*by).orderBy(*order)
    rows = rows.withColumn("__i", F.row_number().over(w) - 1).where(true)
    rows = rows.withColumn("__g", F.col("__i") - F.row_number().over(w))  # equal within a run
    return rows.groupBy(*by, "__g").agg(F.min("__i").cast("long").alias("first"), F.max("__i").cast("long").alias("last"), F.count("*").alias("n")).where(F.col("n") >= least).drop("__g")


def without_overlap(rows: DataFrame, by: list[str]) -> DataFrame:
    """Ranges (first, last) of places whose start moves behind the range before; one wholly inside it stays as it is."""
    before = F.lag("last").over(Window.partitionBy(*by).orderBy("first", "last"))
    rows = rows.withColumn("__p", before)
    return rows.withColumn("first", F.when((F.col("first") <= F.col("__p")) & (F.col("__p") < F.col("last")), F.col("__p") + 1).otherwise(F.col("first"))).drop("__p")


def supplied(chunks: DataFrame, by: list[str], position: str, around: int = 2) -> DataFrame:
    """by, chunk, first, last, from, to: places of a chunk's own rows, and with ``around`` rows more on each side within the whole."""
    ends = chunks.groupBy(*by).agg(F.max(position).alias("__end"))
    own = chunks.groupBy(*by, "chunk").agg(F.min(position).alias("first"), F.max(position).alias("last"))
    return own.join(ends, by).select(*by, "chunk", "first", "last", F.greatest(F.lit(0), F.col("first") - around).alias("from"), F.least(F.col("__end"), F.col("last") + around).alias("to"))


def long_parts(rows: DataFrame, by: str, least: float) -> DataFrame:
    """by, parts: the most contiguous parts of each group's ranges in order, each from its first range's start to its last range's end ``least`` or longer;
    0 if there are none, or if a range ends before it starts. A group's ranges are few (one per proposed topic)."""
    ranges = F.array_sort(F.collect_list(F.struct(F.col("start_ms").cast("double").alias("a"), F.col("end_ms").cast("double").alias("b"))))
    x = F.col("x")

    def step(best: Column, j: Column) -> Column:
        # best: of each number of ranges at the beginning the most parts, -1 if they make none
        ends = F.transform(best, lambda n, i: F.when((n >= 0) & (F.get(x, j)["b"] - F.get(x, i)["a"] >= least), n + 1))
        return F.concat(best, F.array(F.coalesce(F.array_max(ends), F.lit(-1))))

    most = F.aggregate(F.sequence(F.lit(0), F.size(x) - 1), F.array(F.lit(0)), step, lambda best: F.greatest(F.lit(0), F.element_at(best, -1)))
    return rows.groupBy(by).agg(ranges.alias("x")).select(by, F.when(F.exists(x, lambda r: r["b"] < r["a"]), 0).otherwise(most).cast("long").alias("parts"))
