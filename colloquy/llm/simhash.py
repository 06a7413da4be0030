"""SimHash near-duplicates over Gray-order hierarchical indexes.

Equal fingerprints are one. Two that differ in at most three bits agree in all but three of any ``blocks`` blocks of bits, so they
meet where the others are equal; for each such choice, rows with equal blocks are a bucket. A bucket beyond ``PART`` is split by
further bits in the same way, so no task holds a large bucket. A task has one index over all its buckets: in each, the fingerprints
are sorted by Gray rank, where neighbours share long bit patterns; a node knows the bits that all below it share, the upper ones those
of whole groups. Pairs of nodes go down the index together, adding up the differences in bits that both know; beyond three the pair is
left with all below. Only a spanning forest leaves the task; forests are joined into components by alternating star contractions.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import cut, packed, prepare, unpacked

#: Shingle length, seed, and the bits in which linked fingerprints may differ.
SHINGLE, SEED, BITS = 3, 42, 3
#: Fingerprints in a bucket that a task takes whole; children of a node; pairs of nodes looked at in one go.
PART, FAN, PAIRS = 4096, 16, 1 << 12
NO_ID = -(1 << 63)
#: Names of a row's key.
ROW = ("doc_id", "h1", "h2")


def fingerprint(text: str) -> int:
    """Of the lower-cased (A-Z) words' shingles, repeats included; fewer words are one shingle, none give 0."""
    words = text.encode().lower().split()
    if not words:
        return 0
    joined = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    k = min(SHINGLE, len(words)) - 1
    digest = xxhash.xxh64_intdigest
    hashes = np.array([digest(joined[i:j], SEED) for i, j in zip(starts.tolist(), ends[k:].tolist(), strict=False)], np.uint64)
    count = np.zeros(64, np.int64)
    for i in range(0, len(hashes), 1 << 16):
        count += np.unpackbits(hashes[i : i + (1 << 16)].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(2 * count > len(hashes), bitorder="little").view(np.uint64)[0])


def _row_key(doc_id: str = "doc_id", text: str = "text") -> list[Column]:
    """What tells rows apart that differ in doc_id or text."""
    keys = [F.coalesce(F.col(doc_id).cast("long"), F.lit(NO_ID)), F.xxhash64(text), F.xxhash64(F.lit(1), text)]
    return [c.alias(n) for c, n in zip(keys, ROW, strict=True)]


def fingerprints(docs: DataFrame) -> DataFrame:
    """doc_id (null: NO_ID), h1 and h2 (128 bits of a hash of the text), fp (the fingerprint's bits as a long)."""
    prepare(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fps = np.array([fingerprint(t or "") for t in batch.column("text").to_pylist()], np.uint64)
            yield pa.RecordBatch.from_arrays([*map(batch.column, ROW), pa.array(fps.view(np.int64))], [*ROW, "fp"])

    return docs.select(*_row_key(), "text").mapInArrow(run, "doc_id long, h1 long, h2 long, fp long")


def gray_rank(codes: np.ndarray) -> np.ndarray:
    rank = codes.copy()
    for shift in (1, 2, 4, 8, 16, 32):
        rank ^= rank >> np.uint64(shift)
    return rank


class GrayIndex:
    """One index over the buckets of a shard: groups of at most ``FAN`` neighbours in Gray order, inside their bucket, and groups of these up to
    the bucket itself. Of each node: the bits that all below share, their values, and where its children begin."""

    def __init__(self, fps: np.ndarray, buckets: np.ndarray):
        self.order = np.lexsort((gray_rank(fps), buckets))
        x, bucket = fps[self.order], buckets[self.order]
        self.levels = [(np.full(len(x), ~np.uint64(0)), x, None)]
        while True:
            mask, bits, _ = self.levels[-1]
            new = np.concatenate(([True], bucket[1:] != bucket[:-1]))[: len(bucket)]
            if new.all():
                break
            first = np.flatnonzero(new)
            place = np.arange(len(bucket)) - np.repeat(first, np.diff(first, append=len(bucket)))
            at = np.flatnonzero(place % FAN == 0)
            shared = np.bitwise_and.reduceat(mask & ~(bits ^ np.repeat(bits[at], np.diff(at, append=len(bits)))), at)
            self.levels.append((shared, bits[at] & shared, np.append(at, len(bits))))
            bucket = bucket[at]

    def links(self, most: int) -> tuple[np.ndarray, np.ndarray]:
        """Pairs of places that connect all in one bucket that differ in at most ``most`` bits. Pairs of nodes go down together, some at a time."""
        found = [(np.zeros(0, np.int64), np.zeros(0, np.int64))]
        top = len(self.levels) - 1
        mine = np.arange(len(self.levels[top][0]))
        waiting = [(top, *x) for x in self._split(mine, mine, np.zeros(len(mine), np.int64), np.zeros(len(mine), np.uint64))]
        while waiting:
            level, a, b, differences, known = waiting.pop()
            mask, bits, first = self.levels[level]
            both = mask[a] & mask[b]
            differences = differences + np.bitwise_count((bits[a] ^ bits[b]) & both & ~known)
            near = differences <= most
            a, b, differences, known = a[near], b[near], differences[near], both[near]
            if not level:
                other = a != b
                found.append((a[other], b[other]))
                continue
            n, m = first[a + 1] - first[a], first[b + 1] - first[b]
            pair = np.repeat(np.arange(len(a)), n * m)
            k = np.arange(len(pair)) - np.repeat(np.cumsum(n * m) - n * m, n * m)
            down, across = first[a][pair] + k // m[pair], first[b][pair] + k % m[pair]
            once = down <= across
            waiting += [(level - 1, *x) for x in self._split(down[once], across[once], differences[pair][once], known[pair][once])]
        a, b = (np.concatenate(v) for v in zip(*found, strict=True))
        return self.order[a], self.order[b]

    @staticmethod
    def _split(*columns: np.ndarray) -> Iterator[tuple[np.ndarray, ...]]:
        for i in range(0, len(columns[0]), PAIRS):
            yield tuple(c[i : i + PAIRS] for c in columns)


def forest(names: np.ndarray, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(name, smallest name of its component) of those that aren't the smallest; a, b: places of linked names, which may repeat."""
    kinds, number = np.unique(names, return_inverse=True)
    a, b = number[a], number[b]
    label = np.arange(len(kinds))
    while True:
        least = np.minimum(label[a], label[b])
        if (label[a] == least).all() and (label[b] == least).all():
            break
        for side in (a, b):
            np.minimum.at(label, label[side], least)
            np.minimum.at(label, side, least)
        while (label[label] != label).any():
            label = label[label]
    moved = np.flatnonzero(label != np.arange(len(kinds)))
    return kinds[moved], kinds[label[moved]]


def _parts(mask: int, parts: int) -> list[int]:
    """``mask``, and one of ``parts`` runs of the bits outside it, each."""
    free = [i for i in range(64) if not mask >> i & 1]
    edge = [len(free) * i // parts for i in range(parts + 1)]
    return [mask | sum(1 << k for k in free[i:j]) for i, j in zip(edge, edge[1:], strict=False)]


def _masks(n: int) -> list[int]:
    """Choices of bits to agree in: more and smaller buckets for more rows."""
    blocks = BITS + 1 if n < 1 << 21 else BITS + 2 if n < 1 << 28 else BITS + 3
    ones = _parts(0, blocks)
    return [sum(c) for c in combinations(ones, blocks - BITS)]


def _signed(mask: int) -> int:
    return mask - (1 << 64) if mask >> 63 else mask


def _linked(pdf: pd.DataFrame) -> pd.DataFrame:
    keys = pdf[["mask", "value"]].to_numpy()
    order = np.lexsort((keys[:, 1], keys[:, 0]))
    new = (keys[order][1:] != keys[order][:-1]).any(1)
    bucket = np.empty(len(order), np.int64)
    bucket[order] = np.concatenate(([0], np.cumsum(new)))
    names = pdf["fp"].to_numpy()
    u, v = forest(names, *GrayIndex(names.view(np.uint64), bucket).links(BITS))
    return pd.DataFrame({"u": u, "v": v})


def _bucketed(kinds: DataFrame, n: int) -> DataFrame:
    """mask, value, fp of every bucket of two rows or more. Two that differ in at most ``BITS`` bits share one. A bucket beyond ``PART`` is
    split by further bits, in which the same holds: of the others, four runs, one of which the two agree in. So a row of it comes four
    times in smaller buckets, down to those that no more than ``PART`` different fingerprints can share."""

    def agreeing(rows: DataFrame, masks: Column) -> DataFrame:
        rows = rows.select("fp", F.explode(masks).alias("mask")).withColumn("value", F.col("fp").bitwiseAND(F.col("mask")))
        size = rows.groupBy("mask", "value").agg(F.count("*").alias("n")).where("n > 1")
        return rows.join(size, ["mask", "value"])

    masks = _masks(n)
    out, rows = None, agreeing(kinds, F.array(*[F.lit(_signed(m)).cast("long") for m in masks]))
    while True:
        fit = rows.where(F.col("n") <= PART).select("mask", "value", "fp")
        out = fit if out is None else out.union(fit)
        masks = [m for m in masks if 1 << 64 - m.bit_count() > PART]
        if not masks:
            return out
        large = cut(rows.where(F.col("n") > PART).select("mask", "fp"))
        if large.isEmpty():
            return out
        finer = {m: _parts(m, BITS + 1) for m in masks}
        told = F.create_map(*[x for m, p in finer.items() for x in (F.lit(_signed(m)).cast("long"), F.array(*[F.lit(_signed(q)).cast("long") for q in p]))])
        masks = sorted({q for p in finer.values() for q in p})
        rows = agreeing(large.select("fp", F.explode(F.element_at(told, F.col("mask"))).alias("mask")).distinct(), F.array("mask"))


def components(edges: DataFrame) -> DataFrame:
    """id, root of every id that isn't the smallest of its component. edges: u, v longs.

    Alternating star contractions: a node's neighbours move to the smallest of them, first the larger ones, then the smaller, until nothing moves; the number
    of rounds grows with the logarithm of the longest path."""
    edges = cut(edges.where("u != v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())

    def mark(e: DataFrame) -> tuple:
        return tuple(e.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())

    before = mark(edges)
    while before[0]:
        both = edges.union(edges.select("v", "u"))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.join(least, "u").where(F.col("v") > F.col("u")).select(F.col("v").alias("u"), F.col("m").alias("v")).where("u != v").distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").where("v != m").select(F.col("v").alias("u"), F.col("m").alias("v")).union(least.select("u", F.col("m").alias("v")))
        edges = cut(small.distinct())
        after = mark(edges)
        if after == before:
            break
        before = after
    return edges.select(F.col("u").alias("id"), F.col("v").alias("root"))


def _rooted(own: DataFrame, first: Column) -> DataFrame:
    """fp, first (the smallest one of its rows), root (smallest fingerprint of its component), of every fingerprint in own."""
    spark = own.sparkSession
    kinds = cut(own.groupBy("fp").agg(F.min(first).alias("first")))
    n = kinds.count()
    shards = max(int(spark.conf.get("spark.sql.shuffle.partitions")), n // 20_000) * 4
    rows = _bucketed(kinds, n).withColumn("shard", F.pmod(F.xxhash64("mask", "value"), F.lit(shards)).cast("int"))
    if shards > 4 * int(spark.conf.get("spark.sql.shuffle.partitions")):
        rows = rows.repartition(shards, "shard")
    roots = components(rows.groupBy("shard").applyInPandas(_linked, "u long, v long")).select(F.col("id").alias("fp"), "root")
    return cut(kinds.join(roots, "fp", "left").select("fp", "first", F.coalesce("root", "fp").alias("root")))


def near_duplicates(docs: DataFrame) -> DataFrame:
    """doc_id, fp, component_id (smallest doc_id that links of at most ``BITS`` differing bits reach).

    Only fingerprints link: rows with the same doc_id, or without one, are in one component only if their fingerprints are. Components whose smallest
    doc_id is the same bear the same component_id. Rows that repeat a doc_id with different texts keep a fingerprint each. A null text is an empty one, with fingerprint 0; a null doc_id counts as the smallest; an
    empty table gives an empty result; other columns are ignored."""
    own = cut(fingerprints(docs).select("doc_id", "fp"))
    rooted = _rooted(own, F.col("doc_id"))
    named = rooted.join(rooted.groupBy("root").agg(F.min("first").alias("component_id")), "root").select("fp", "component_id")
    out = own.join(named, "fp")
    known = F.col("doc_id") != NO_ID
    return out.select(F.when(known, F.col("doc_id")).alias("doc_id"), "fp", F.when(F.col("component_id") != NO_ID, F.col("component_id")).alias("component_id"))


def one_of_each(docs: DataFrame) -> DataFrame:
    """Rows of ``docs``, all columns: one of each component, with its smallest doc_id (null first), and of those the first by a hash of the text.

    Null and repeated doc_ids are told apart by their texts; a null text is an empty one; of rows that agree in doc_id and text
    one stays. Columns of any name return untouched; an empty table gives an empty result."""
    rooted = _rooted(cut(fingerprints(docs)), F.struct(*ROW))
    keep = rooted.groupBy("root").agg(F.min("first").alias("k")).select("k.*")
    rows = docs.select(packed(docs).alias("row")).select("row", *_row_key("row.doc_id", "row.text"))
    # repeated rows have one key: one of them stays
    rows = rows.join(keep, list(ROW), "left_semi").withColumn("nth", F.row_number().over(Window.partitionBy(*ROW).orderBy(F.lit(0)))).where("nth = 1")
    return unpacked(rows, docs.columns)
