"""Token-id files: each shard one compressed wavelet matrix.

Documents are range-partitioned and sorted by doc_id and encoded in that order; a shard is a run of whole documents, closed at ``SHARD_TOKENS``.
It is one row of a Parquet table (so that committing, retries and any store are Spark's concern):

    part, shard      place in the order of all shards
    n_docs, n_tokens
    docs             doc_ids, 8 bytes each, and their token counts, 8 bytes each, little-endian
    data             the bit-planes with their rank and select directories (see :class:`wavelet.WaveletMatrix`)

:func:`tokens_at`, :func:`token_counts` and :func:`token_occurrences` answer from the files without undoing the planes.
"""

from __future__ import annotations

import os
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import prepare
from .pieces import Coded, Pieces
from .wavelet import WaveletMatrix

#: Tokens after which a shard ends with its document.
SHARD_TOKENS = 1 << 18
#: The id that ends each document.
END = 0
NO_ID = np.iinfo(np.int64).min

_SHARD = "part int, shard int, n_docs long, n_tokens long, docs binary, data binary"
_loaded: dict[str, Pieces] = {}


def encoder(vocabulary: str) -> Pieces:
    """The tokenizers library over ``vocabulary``, once per worker; ids as little-endian unsigned 32-bit integers."""
    if vocabulary not in _loaded:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        tokenizer = Tokenizer.from_file(vocabulary)
        added = [t.content for t in tokenizer.get_added_tokens_decoder().values()]
        first = np.array([(tokenizer.id_to_token(i) or "").startswith("Ġ") for i in range(tokenizer.get_vocab_size())])

        def encode(texts: list[str], spaced: bool) -> Coded:
            if not spaced:
                found = [np.array(e.ids, np.uint32) for e in tokenizer.encode_batch_fast(texts, add_special_tokens=False)]
                return np.concatenate([np.zeros(0, np.uint32), *found]), np.array([len(x) for x in found], np.int64)
            # many pieces in one go: a token that begins with a space begins the next
            joined = ["".join(texts[i : i + 512]) for i in range(0, len(texts), 512)]
            ids = np.concatenate([np.zeros(0, np.uint32), *[np.array(e.ids, np.uint32) for e in tokenizer.encode_batch_fast(joined, add_special_tokens=False)]])
            return ids, np.diff(np.flatnonzero(first[ids]), append=len(ids))

        # texts that hold an added token go to the library whole
        _loaded[vocabulary] = Pieces(encode, whole=added)
    return _loaded[vocabulary]


def _shards(vocabulary: str, tokens: int):
    end = np.uint32(END)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, part, shard = encoder(vocabulary), TaskContext.get().partitionId(), 0
        ids: list[int] = []
        coded: list[np.ndarray] = []
        size = 0

        def close() -> pa.RecordBatch:
            values = np.concatenate(coded)
            values = values.astype(np.uint16) if values.max() < 1 << 16 else values
            docs = np.array([ids, [len(c) for c in coded]], np.int64).tobytes()
            row = {"part": [part], "shard": [shard], "n_docs": [len(ids)], "n_tokens": [len(values)], "docs": [docs], "data": [WaveletMatrix.of(values).to_bytes()]}
            return pa.RecordBatch.from_pydict(row, pa.schema([("part", pa.int32()), ("shard", pa.int32()), ("n_docs", pa.int64()), ("n_tokens", pa.int64()), ("docs", pa.binary()), ("data", pa.binary())]))

        for batch in batches:
            for i in range(0, batch.num_rows, 4000):
                some = batch.slice(i, 4000)
                found, cuts = encode.texts(some.column("text"))
                for name, j, k in zip(some.column("doc_id").to_pylist(), cuts.tolist(), cuts[1:].tolist(), strict=False):
                    ids.append(name)
                    coded.append(np.append(found[j:k], end))
                    size += k - j + 1
                    if size >= tokens:
                        yield close()
                        ids, coded, size, shard = [], [], 0, shard + 1
        if ids:
            yield close()

    return run


def write_tokens(docs: DataFrame, path: str, vocabulary: str, shard_tokens: int = SHARD_TOKENS) -> None:
    """Encode every whole text, END after each document, in ascending doc_id order, and write the shards to ``path``.

    A null text is an empty one (only END); a null doc_id sorts first; rows with one doc_id are documents of
    their own, in order of a hash of their text; very long texts make a shard of their own; an empty table makes no
    shard; other columns are ignored."""
    prepare(docs.sparkSession)
    docs = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(int(NO_ID))).alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    order = (F.col("doc_id"), F.xxhash64("text"))
    docs = docs.repartitionByRange(*order).sortWithinPartitions(*order)
    docs.mapInArrow(_shards(vocabulary, shard_tokens), _SHARD).write.parquet(path)


def _placed(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """The shards, and part, shard, n_tokens, base (tokens of all shards before it) of each."""
    shards = spark.read.schema(_SHARD).parquet(path)
    # places of shards from their counts: by part, then inside it
    sizes = shards.select("part", "shard", "n_tokens")
    parts = sizes.groupBy("part").agg(F.sum("n_tokens").alias("n")).select("part", (F.sum("n").over(Window.orderBy("part")) - F.col("n")).alias("part_start"))
    inside = F.sum("n_tokens").over(Window.partitionBy("part").orderBy("shard")) - F.col("n_tokens")
    starts = sizes.select("part", "shard", "n_tokens", inside.alias("shard_start")).join(parts, "part")
    return shards, starts.select("part", "shard", "n_tokens", (F.col("part_start") + F.col("shard_start")).alias("base"))


def read_tokens(spark: SparkSession, path: str, **derived: Column) -> DataFrame:
    """doc_id, start (ids of all documents before it), ids (binary, little-endian unsigned 32-bit, with END).

    derived: columns to return instead of ids; what they are made of need not move."""
    shards, starts = _placed(spark, path)
    starts = starts.drop("n_tokens")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                names, counts = np.frombuffer(row["docs"], np.int64).reshape(2, -1)
                values = WaveletMatrix.from_bytes(row["data"])
                values = values.values(np.uint16 if len(values.planes) <= 16 else np.uint32).astype("<u4")
                at = np.cumsum(counts) - counts
                ids = [values[i : i + n].tobytes() for i, n in zip(at.tolist(), counts.tolist(), strict=True)]
                k = len(ids)
                yield pa.RecordBatch.from_arrays([pa.array([row["part"]] * k, pa.int32()), pa.array([row["shard"]] * k, pa.int32()), pa.array(names), pa.array(at), pa.array(ids, pa.binary())], ["part", "shard", "doc_id", "at", "ids"])

    docs = shards.select("part", "shard", "docs", "data").mapInArrow(run, "part int, shard int, doc_id long, at long, ids binary")
    docs = docs.select("part", "shard", "doc_id", "at", *[c.alias(n) for n, c in (derived or {"ids": F.col("ids")}).items()])
    found = docs.join(starts, ["part", "shard"]).withColumn("start", F.col("base") + F.col("at")).drop("part", "shard", "base", "at")
    return found.withColumn("doc_id", F.when(F.col("doc_id") != int(NO_ID), F.col("doc_id")))


def _answers(shards: DataFrame, columns: str, answer: Callable[[dict, WaveletMatrix], tuple[np.ndarray, ...]]) -> DataFrame:
    """Rows of ``answer`` for each shard, in columns of longs."""
    names = [c.split()[0] for c in columns.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                yield pa.RecordBatch.from_arrays([pa.array(np.asarray(c, np.int64)) for c in answer(row, WaveletMatrix.from_bytes(row["data"]))], names)

    return shards.mapInArrow(run, columns)


def token_counts(spark: SparkSession, path: str, tokens: list[int]) -> DataFrame:
    """token, n: how often each of the given tokens occurs in the files of ``path``, by rank."""
    given = spark.createDataFrame([(int(t),) for t in sorted(set(tokens))], "token long")
    counts = _answers(spark.read.schema(_SHARD).parquet(path).select("data"), "token long, n long", lambda _, w: (sorted(set(tokens)), w.rank(np.array(sorted(set(tokens)), np.int64), w.n)))
    return given.join(counts.groupBy("token").agg(F.sum("n").alias("n")), "token", "left").select("token", F.coalesce("n", F.lit(0).cast("long")).alias("n"))


def token_occurrences(spark: SparkSession, path: str, token: int) -> DataFrame:
    """doc_id, at (place in the document) of every occurrence of a token, by select."""

    def answer(row: dict, w: WaveletMatrix) -> tuple[np.ndarray, np.ndarray]:
        names, counts = np.frombuffer(row["docs"], np.int64).reshape(2, -1)
        at, first = w.occurrences(token), np.cumsum(counts) - counts
        doc = np.searchsorted(first, at, side="right") - 1
        return names[doc], at - first[doc]

    found = _answers(spark.read.schema(_SHARD).parquet(path).select("docs", "data"), "doc_id long, at long", answer)
    return found.withColumn("doc_id", F.when(F.col("doc_id") != int(NO_ID), F.col("doc_id")))


def tokens_at(spark: SparkSession, path: str, wanted: DataFrame) -> DataFrame:
    """position, token of each distinct position (counted over all shards in order) in ``wanted``; those beyond the end and nulls are left out."""
    shards, starts = _placed(spark, path)
    # both sides go by stretches of positions; a shard is in all it reaches
    stretch = F.lit(SHARD_TOKENS).cast("long")
    reach = F.sequence(F.floor(F.col("base") / stretch), F.floor((F.col("base") + F.greatest("n_tokens", F.lit(1)) - 1) / stretch))
    spread = starts.select("part", "shard", "base", "n_tokens", F.explode(reach).alias("stretch"))
    asked = wanted.where("position >= 0").select(F.col("position").cast("long").alias("position")).distinct().withColumn("stretch", F.floor(F.col("position") / stretch))
    asked = asked.join(spread, "stretch").where((F.col("position") >= F.col("base")) & (F.col("position") < F.col("base") + F.col("n_tokens")))
    asked = asked.groupBy("part", "shard", "base", "stretch").agg(F.collect_list("position").alias("positions"))  # no more than a stretch

    def answer(row: dict, w: WaveletMatrix) -> tuple[np.ndarray, np.ndarray]:
        at = np.array(row["positions"], np.int64)
        return at, w.access(at - row["base"])

    return _answers(shards.select("part", "shard", "data").join(asked, ["part", "shard"]).select("base", "positions", "data"), "position long, token long", answer)


def new_path(spark: SparkSession, name: str) -> str:
    """A new folder in the shared checkpoint folder."""
    prepare(spark)
    return f"{spark.sparkContext.getCheckpointDir()}/{name}-{uuid.uuid4().hex}"
