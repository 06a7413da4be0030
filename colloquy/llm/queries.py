"""The thin queries opN_<name>: each applies its operator to a whole table and derives the digest columns."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, lines, matching, merkle, mixing, prefixbpe, quality, rules, simhash, suffixes, tokenfile, topk, whitening
from .common import table


def _sha(text: object) -> F.Column:
    return F.sha2(text, 256)


def op1_vector_approximation_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.top_k(table(spark, sf_dir, "embeddings"), F.pmod("vec_id", F.lit(20)) == 0, k=20)


def op2_wavelet_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = tokenfile.new_path(spark, "tokens")
    tokenfile.write_tokens(table(spark, sf_dir, "documents"), path, public_tokenizers.path("byte_bpe_50k.json"))
    found = tokenfile.read_tokens(spark, path, n_tokens=(F.octet_length("ids") / 4).cast("long"), ids_crc32=F.crc32("ids"))
    return found.select("doc_id", "start", "n_tokens", "ids_crc32")


def op3_naive_bayes_svm_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = quality.fit(docs, table(spark, sf_dir, "labels"))
    return quality.score(docs, model).select("doc_id", quality.held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= quality.CUT).cast("int").alias("predicted"))


def op4_weighted_fair_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


def op5_suffix_interval_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = suffixes.remove_substrings(table(spark, sf_dir, "documents"))
    removed = F.aggregate("spans", F.lit(0).cast("long"), lambda a, s: a + s["end"] - s["start"])
    return found.select("doc_id", F.col("n").alias("n_bytes"), removed.alias("n_removed"), F.size("spans").cast("long").alias("n_spans"), _sha("kept").alias("kept_sha256"))


def op6_robust_outlier_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rules.judged(table(spark, sf_dir, "documents")).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def op7_fm_index_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = matching.remove_passages(table(spark, sf_dir, "documents"))
    removed = F.aggregate("spans", F.lit(0).cast("long"), lambda a, s: a + s["end"] - s["start"])
    return found.select("doc_id", F.col("n").alias("n_words"), removed.alias("n_removed"), _sha("kept").alias("kept_sha256"))


def coded(docs: DataFrame, share: float = 1.0) -> DataFrame:
    """doc_id, n_tokens and digests of the ids and of what they decode to; nulls, empty and repeated rows as in :func:`bpe.encode_and_decode`."""
    found = bpe.encode_and_decode(docs, public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN, share)
    ids = F.array_join(F.col("ids").cast("array<string>"), ",")
    return found.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), _sha(ids).alias("ids_sha256"), _sha(F.col("decoded").cast("binary")).alias("decoded_sha256"))


def op8_transducer_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return coded(table(spark, sf_dir, "documents"))


def op9_gray_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op10_levelled_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = lines.drop_repeated_lines(table(spark, sf_dir, "documents"))
    return found.select("row.doc_id", "n_lines", "n_dropped", _sha("kept").alias("kept_sha256"))


def op11_prefix_dp_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = prefixbpe.encode_and_decode(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))
    return found.select("doc_id", (F.octet_length("ids") / 4).cast("long").alias("n_tokens"), _sha("ids").alias("ids_sha256"), _sha(F.col("decoded").cast("binary")).alias("decoded_sha256"))


def op12_pregel_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merkle.sealed(table(spark, sf_dir, "documents"))


def op13_lobpcg_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening.whiten(table(spark, sf_dir, "embeddings"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    import corpus_pipeline

    own = [f for name, f in globals().items() if name.startswith("op") and callable(f)]
    return {f.__name__: f for f in own} | {"pipeline": corpus_pipeline.run}
