"""From raw documents to encoded training data: classify, drop repeated lines, keep one of near copies, mix, encode."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from colloquy.llm import lines, mixing, quality, simhash
from colloquy.llm.common import prepare, table
from colloquy.llm.queries import coded


def classify(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps documents that score 0.7 or more; the model is fitted on the labelled ones among ``docs``.

    Null texts score as empty ones; null and repeated ids are judged row by row; all columns return untouched; without
    labelled rows every document scores 0.5 and goes."""
    return quality.good_documents(docs, quality.fit(docs, table(spark, sf_dir, "labels")))


def drop_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops lines found in three documents or more, except in the last; n_chars, where there is one, follows.

    A null text stays null; rows with null or repeated ids stay, with their own texts; columns of other names return untouched; an
    empty table gives an empty result."""
    out = lines.drop_repeated_lines(docs)
    kept = F.when(F.col("row.text").isNotNull(), F.col("kept"))
    own = {"text": kept, "n_chars": F.length(kept).cast("long")}
    return out.select(*[own[c].alias(c) if c in own else F.col("row").getField(c).alias(c) for c in docs.columns])


def one_of_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each group of near copies: that with the smallest doc_id (null first).

    Null texts are empty, and copies of each other; rows that repeat a doc_id, or have none, are documents of their own; all
    columns return untouched; an empty table gives an empty result."""
    return simhash.one_of_each(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeats and leaves out documents so that sources come near their targets.

    Null and empty texts weigh nothing and do not come; a null source is a source; repeated rows are taken one by one; all columns
    return untouched; an empty table gives an empty result."""
    return mixing.mixed_documents(docs)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of each document of the mix, as digests; decoding gives the text again.

    Null texts are empty; null and repeated ids return as they come; other columns are left; an empty table gives an empty result."""
    return coded(docs)


STAGES = [("quality classifier", classify), ("line dedup", drop_lines), ("simhash near-dedup", one_of_copies), ("source mixing", mix_sources), ("bpe encoding", encode)]

#: Classifier, fingerprints and tokens aren't SQL; the tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    prepare(spark)
    base = f"{spark.sparkContext.getCheckpointDir()}/pipeline-{uuid.uuid4().hex}"
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs.write.parquet(f"{base}/{k}")
            docs = spark.read.parquet(f"{base}/{k}")
    return docs
