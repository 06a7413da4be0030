"""Mixing sources to target weights by weighted fair queueing. DataFrame functions only.

A source is a queue of its shuffled documents, once and once more. A copy's virtual finish time is the source's cumulative
size up to its end over the source's target. All copies, sorted by that time, are the mix; it is cut where their
cumulative size reaches the budget, the sum of the targets. Cumulative sums run in two levels, over groups and inside
each, so that no task holds a whole source, or the whole mix.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import WORD, cut, packed, prepare, unpacked

#: Weights of the sources in order, repeating; what they share, in parts of all sizes; how often a document may come.
WEIGHTS, SHARE, COPIES = (3, 1, 2), 1.5, 2
#: Rows of a source in a group of its queue, about, and groups at least.
GROUP, LEAST = 5000, 512


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, copies: int = COPIES) -> DataFrame:
    """source, source_size, target of each source. sizes: source, source_size.

    Sources in code-point order, null last, take the weights in turn. Each gets its weight's part of ``share`` times all sizes, at most
    ``copies`` times its own; what a source can't take is shared among the others by weight. So there is a level at which all
    sources with room stand, in order of the level that fills them."""
    order = Window.orderBy(F.asc_nulls_last("source"))
    weight = F.element_at(F.array(*map(F.lit, weights)), (F.row_number().over(order) - 1) % len(weights) + 1).cast("long")
    rows = sizes.select("source", "source_size", weight.alias("w"), (F.lit(copies) * F.col("source_size")).alias("cap"))
    filled = Window.orderBy(F.col("cap") / F.col("w"), F.asc_nulls_last("source"))
    before, after = filled.rowsBetween(Window.unboundedPreceding, -1), filled.rowsBetween(0, Window.unboundedFollowing)
    rows = rows.withColumn("level", (F.sum("source_size").over(Window.partitionBy()) * share - F.coalesce(F.sum("cap").over(before), F.lit(0))) / F.sum("w").over(after))
    # the first source that its level does not fill, and all after it, stand at that level
    rows = rows.withColumn("open", F.when(F.col("level") * F.col("w") < F.col("cap"), F.col("level")))
    level = F.first("open", ignorenulls=True).over(filled.rowsBetween(Window.unboundedPreceding, 0))
    return rows.select("source", "source_size", F.coalesce(level * F.col("w"), F.col("cap").cast("double")).alias("target"))


def mix(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, copies: int = COPIES) -> DataFrame:
    """doc_id, source, row, size, source_size, target, taken, and copies (how many copies the mix takes, at least half of each); ``row`` tells rows with one doc_id apart.

    Size is the number of words. The mix takes whole copies; the one at the cut is taken in part. Reruns agree: the shuffle
    is by a hash of doc_id, and ties fall to source and size. A null text has size 0 and is taken as nothing; a null source is
    a source; rows without a doc_id are shuffled by their text; repeated rows queue one by one; an empty table gives an empty result; other
    columns are ignored. ``row`` is the hash of the row's text."""
    prepare(docs.sparkSession)
    sized = cut(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "source", F.xxhash64("text").alias("row"), word_count(F.col("text")).alias("size")))
    goals = cut(targets(sized.groupBy("source").agg(F.sum("size").alias("source_size")), weights, share, copies))
    n, budget = sized.count(), goals.agg(F.floor(F.sum("target"))).first()[0] or 0
    groups = max(LEAST, -(-n // GROUP))
    shuffled = sized.withColumn("turn", F.md5(F.coalesce(F.col("doc_id").cast("string"), F.concat(F.lit("-"), F.col("row"))).cast("binary")))
    shuffled = shuffled.withColumn("group", F.floor(F.conv(F.substring("turn", 1, 8), 16, 10).cast("long") * groups / (1 << 32)))
    part = shuffled.groupBy("source", "group").agg(F.sum("size").alias("n"))
    part = part.select("source", "group", (F.sum("n").over(Window.partitionBy("source").orderBy("group")) - F.col("n")).alias("group_start"))
    inside = Window.partitionBy("source", "group").orderBy("turn", "doc_id", "size", "row")
    queued = shuffled.withColumn("own", F.sum("size").over(inside.rowsBetween(Window.unboundedPreceding, 0))).withColumn("nth", F.row_number().over(inside))

    def same(a: DataFrame, b: DataFrame, *on: str) -> DataFrame:
        b = b.withColumnRenamed("source", "__source")
        for c in on:
            b = b.withColumnRenamed(c, f"__{c}")
        match = F.col("source").eqNullSafe(F.col("__source"))
        for c in on:
            match &= F.col(c) == F.col(f"__{c}")
        return a.join(b, match).drop("__source", *[f"__{c}" for c in on])

    head = cut(same(part, goals))
    queued = same(queued, head, "group").withColumn("end", F.col("group_start") + F.col("own")).drop("own", "group_start")
    items = queued.withColumn("copy", F.explode(F.sequence(F.lit(0), F.lit(copies - 1)))).withColumn("finish", F.when(F.col("size") > 0, (F.col("copy") * F.col("source_size") + F.col("end")) / F.col("target")))
    order = ("finish", "source", "copy", "turn", "doc_id", "size", "row", "nth")
    # the global sort; where each range begins follows from the ranges' sums
    ranged = cut(items.where("size > 0").repartitionByRange(*order).withColumn("range", F.spark_partition_id()))
    starts = ranged.groupBy("range").agg(F.sum("size").alias("n"))
    starts = starts.select("range", (F.sum("n").over(Window.orderBy("range")) - F.col("n")).alias("range_start"))
    mixed = ranged.join(starts, "range").withColumn("stop", F.col("range_start") + F.sum("size").over(Window.partitionBy("range").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)))
    mixed = mixed.withColumn("part", F.greatest(F.lit(0), F.least("size", F.lit(budget) - F.col("stop") + F.col("size"))))
    whole = F.count_if(2 * F.col("part") >= F.col("size"))
    keys = ["doc_id", "source", "row", "size", "source_size", "target", "group", "nth"]
    taken = mixed.groupBy(*keys).agg(F.sum("part").alias("taken"), whole.alias("copies"))
    empty = queued.where("size = 0").select(*keys, F.lit(0).cast("long").alias("taken"), F.lit(0).cast("long").alias("copies"))
    return taken.unionByName(empty).select("doc_id", "source", "row", "size", "source_size", "target", "taken", "copies")


def mixed_documents(docs: DataFrame) -> DataFrame:
    """The mix itself: each row of ``docs``, all columns, as often as the mix takes it (a copy cut in two comes if half of it does).

    Null, empty and repeated rows as in :func:`mix`; texts of size 0 do not come. Columns of any name return untouched; an empty
    table gives an empty result."""

    def keys(doc: str, text_hash: Column, source: str) -> list[Column]:
        return [F.coalesce(F.col(doc).cast("long"), F.lit(-(1 << 63))).alias("doc"), text_hash.alias("hash"), F.coalesce(F.col(source).cast("string"), F.lit("\x00")).alias("of")]

    # rows that agree in the keys are told apart by number only: how many of them come once at least, twice at least ...
    took = mix(docs).where("copies > 0").select(*keys("doc_id", F.col("row"), "source"), "copies")
    took = took.groupBy("doc", "hash", "of").agg(F.array(*[F.count_if(F.col("copies") >= k) for k in range(1, COPIES + 1)]).alias("rows"))
    own = docs.select(packed(docs).alias("row")).select("row", *keys("row.doc_id", F.xxhash64("row.text"), "row.source"))
    found = own.join(took, ["doc", "hash", "of"])
    plain = [F.col("row").getField(f.name) for f in docs.schema if "map<" not in f.dataType.simpleString() and f.name != "text"]
    found = found.withColumn("nth", F.row_number().over(Window.partitionBy("doc", "hash", "of").orderBy(F.xxhash64(*plain))))
    times = F.size(F.filter("rows", lambda n: n >= F.col("nth")))
    return unpacked(found.withColumn("times", times).where("times > 0").select("row", F.explode(F.sequence(F.lit(1), F.col("times")))), docs.columns)
