"""Line dedup over levelled sorted runs of line hashes. DataFrame functions only.

A run is a table of line hashes with their number of documents and their holder (the largest doc_id), in buckets by hash, each one
file sorted by hash. Batches come in order of falling doc_id. A new batch is merge-anti-joined with all runs: what is new was never
seen in a larger doc_id, so its holder is final; what is known only adds to its count. Both become the batch's own run. As soon as
a level has ``FAN`` runs they are merged into one of the next level. Buckets meet buckets and are in order, so neither the
anti-join nor a merge moves a run again. Runs stay in their folder: more batches can be added later.
"""

from __future__ import annotations

import uuid
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import cut, packed, prepare

#: Batches of a call, runs that a level holds before it is merged.
BATCHES, FAN = 4, 2
#: Documents to a bucket, about; there are as many buckets as shuffle partitions at least.
BUCKET = 50_000
BLANK = " \t\n\x0b\x0c\r"
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
NO_ID = -(1 << 63)
KEY = ["h1", "h2"]
_RUN = "h1 bigint, h2 bigint, n bigint, holder bigint"


def line_key(line: Column) -> Column:
    return F.translate(F.btrim(line, F.lit(BLANK)), UPPER, UPPER.lower())


def _hashes(lines: Column, least: int) -> Column:
    """(position, 128-bit hash) of each line whose key is long enough; others have none."""
    keyed = F.transform(lines, lambda x, i: F.struct(i.alias("pos"), line_key(x).alias("key")))
    return F.transform(F.filter(keyed, lambda x: F.length(x["key"]) >= least), lambda x: F.struct(x["pos"].alias("pos"), F.xxhash64(x["key"]).alias("h1"), F.xxhash64(F.lit(1), x["key"]).alias("h2")))


class Runs:
    """The levelled runs below ``path``, each known by its level and name; ``told`` lists them so that another session can go on."""

    def __init__(self, spark: SparkSession, path: str, buckets: int, told: list[tuple[int, str]] = ()):
        prepare(spark)
        # a bucket is one file here, so that its order can be relied on
        spark.conf.set("spark.sql.legacy.bucketedTableScan.outputOrdering", "true")
        self.spark, self.path, self.buckets = spark, path, buckets
        self.levels: list[list[str]] = []
        for level, name in told:
            self._put(level, name)

    @property
    def told(self) -> list[tuple[int, str]]:
        return [(level, name) for level, names in enumerate(self.levels) for name in names]

    def _put(self, level: int, name: str) -> None:
        while len(self.levels) <= level:
            self.levels.append([])
        self.levels[level].append(name)

    def dealt(self, rows: DataFrame) -> DataFrame:
        """``rows`` in buckets; those of a run are, and stay where they lie."""
        return rows.repartition(self.buckets, *KEY)

    def write(self, rows: DataFrame, name: str, columns: str = _RUN) -> DataFrame:
        """``rows``, dealt to the buckets already, as a table."""
        rows = rows.select(*[c.split()[0] for c in columns.split(", ")])
        table = f"colloquy_{uuid.uuid4().hex}"
        rows.write.bucketBy(self.buckets, *KEY).sortBy(*KEY).option("path", f"{self.path}/{name}").saveAsTable(table)
        return self._read(table)

    def _read(self, table: str) -> DataFrame:
        out = self.spark.table(table)
        out.schema  # noqa: B018  (the table is known to the plan from here on; the catalogue need not keep it)
        self.spark.sql(f"DROP TABLE {table}")
        return out

    def read(self, name: str, columns: str = _RUN) -> DataFrame:
        table = f"colloquy_{uuid.uuid4().hex}"
        where = f"{self.path}/{name}".replace("'", "\\'")
        self.spark.sql(f"CREATE TABLE {table} ({columns}) USING parquet CLUSTERED BY (h1, h2) SORTED BY (h1, h2) INTO {self.buckets} BUCKETS LOCATION '{where}'")
        return self._read(table)

    @staticmethod
    def both(a: DataFrame, b: DataFrame) -> DataFrame:
        """Two runs as one: a merge join of two sorted tables, bucket by bucket. (A union would keep the buckets too, but Spark 4.1
        sums a union of columnar scans as if it had, when its rows lie elsewhere.)"""
        a, b = a.select(*KEY, F.col("n").alias("n1"), F.col("holder").alias("p1")), b.select(*KEY, F.col("n").alias("n2"), F.col("holder").alias("p2"))
        none = F.lit(0).cast("long")
        return a.join(b.hint("merge"), KEY, "full").select(*KEY, (F.coalesce("n1", none) + F.coalesce("n2", none)).alias("n"), F.greatest("p1", "p2").alias("holder"))

    def merged(self) -> DataFrame:
        """All runs as one."""
        return reduce(self.both, [self.read(name) for _, name in reversed(self.told)])

    def add(self, batch: DataFrame) -> None:
        """Anti-join a batch with the runs, add its own run, merge full levels. batch: h1, h2 (once each), n, holder; its doc_ids are smaller than those of all before."""
        batch = self.dealt(batch)
        for _, name in self.told:
            # known from a run: only a count; what no run knows stays as it is
            run = self.read(name).select(*KEY, F.lit(True).alias("known"))
            batch = batch.join(run.hint("merge"), KEY, "left").select(*KEY, "n", F.when(F.col("known").isNull(), F.col("holder")).alias("holder"))
        level, name = 0, uuid.uuid4().hex
        self.write(batch, name)
        self._put(level, name)
        while len(self.levels[level]) >= FAN:
            name = uuid.uuid4().hex
            self.write(reduce(self.both, map(self.read, self.levels[level])), name)
            self.levels[level] = []
            level += 1
            self._put(level, name)


def repeated_lines(docs: DataFrame, least_chars: int, least_docs: int, batches: int = BATCHES) -> DataFrame:
    """h1, h2, holder of the lines that lose all copies but the holder's. docs: doc_id, lines.

    The lines are hashed once, summed by batch and dealt to buckets; from there on all goes bucket by bucket."""
    spark = docs.sparkSession
    prepare(spark)
    n, ids, edges = docs.select("doc_id").agg(F.count("*"), F.count_distinct("doc_id"), F.percentile_approx("doc_id", [i / batches for i in range(1, batches)], 1000)).first()
    edges = sorted(set(edges or []), reverse=True)
    batch = sum((F.when(F.col("doc_id") <= e, 1).otherwise(0) for e in edges), F.lit(0))
    own = F.array_distinct(F.transform(_hashes(F.col("lines"), least_chars), lambda x: F.struct(x["h1"].alias("h1"), x["h2"].alias("h2"))))
    seen = docs.select("doc_id", batch.alias("k"), F.explode(own).alias("h")).select("k", "h.h1", "h.h2", "doc_id")
    if n != ids:  # rows that repeat a doc_id are one document
        seen = seen.distinct()
    runs = Runs(spark, f"{spark.sparkContext.getCheckpointDir()}/lines-{uuid.uuid4().hex}", max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-n // BUCKET)))
    sums = runs.write(runs.dealt(seen.groupBy("k", *KEY).agg(F.count("*").alias("n"), F.max("doc_id").alias("holder"))), "batches", "k int, " + _RUN)
    for k in range(len(edges) + 1):
        runs.add(sums.where(F.col("k") == k).drop("k"))
    return runs.merged().where(F.col("n") >= least_docs).select(*KEY, "holder")


def drop_repeated_lines(docs: DataFrame, least_chars: int = 20, least_docs: int = 3, batches: int = BATCHES) -> DataFrame:
    """row (a struct of all columns of ``docs``), kept (the lines that stay, joined by newlines), n_lines (before), n_dropped.

    A line's key is the line without white space at its ends, A-Z in lower case. Keys of ``least_chars`` code points in ``least_docs``
    documents lose all their lines except in the largest doc_id that holds them, where all stay.

    A null or empty text is one empty line; a null doc_id counts as one document with the smallest id; rows that repeat a doc_id are
    one document for the counts, and each keeps its own text; a very long text is one row like others; an empty table gives an empty
    result. Columns of any name return untouched in ``row``."""
    prepare(docs.sparkSession)
    docs = docs.select(packed(docs).alias("row"))
    docs = docs.select("row", F.coalesce(F.col("row.doc_id").cast("long"), F.lit(NO_ID)).alias("doc_id"), F.xxhash64("row.text").alias("hash"), F.split(F.coalesce("row.text", F.lit("")), "\n", -1).alias("lines"))
    repeated = cut(repeated_lines(docs.select("doc_id", "lines"), least_chars, least_docs, batches))  # so that a common line's rows can be split in the join
    places = docs.select("doc_id", "hash", F.explode(_hashes(F.col("lines"), least_chars)).alias("h")).select("doc_id", "hash", "h.*")
    gone = places.join(repeated, KEY).where(F.col("doc_id") != F.col("holder")).groupBy("doc_id", "hash").agg(F.collect_set("pos").alias("gone"))
    out = docs.drop("lines").join(gone, ["doc_id", "hash"], "left").withColumn("lines", F.split(F.coalesce("row.text", F.lit("")), "\n", -1))
    lines, gone = F.col("lines"), F.coalesce("gone", F.array().cast("array<int>"))
    # positions are told apart by a hash set, so that the work is in proportion to the lines
    stay = F.array_except(F.sequence(F.lit(0), F.size(lines) - 1), gone)
    kept = F.when(F.size(gone) == 0, F.coalesce("row.text", F.lit(""))).otherwise(F.array_join(F.transform(stay, lambda i: lines[i]), "\n"))
    return out.select("row", kept.alias("kept"), F.size(lines).cast("long").alias("n_lines"), F.size(gone).cast("long").alias("n_dropped"))
