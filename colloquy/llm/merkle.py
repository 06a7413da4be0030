"""Merkle manifest of a dataset: a hash tree over its rows, by supersteps in the manner of Pregel.

A vertex is a node of a tree: (tree, level, place). In an upward superstep children send their hashes to their parents; a parent
that has all its children hashes them and forwards. In a downward superstep a node hands each child the hashes of its siblings
and what it got from above, until each leaf has all that leads to the root.

``BLOCK`` levels of a subtree live in one group of vertices, so that messages inside it need no shuffle: a superstep passes
that many levels at once, and no group has more than ``arity ** BLOCK`` leaves, however large a tree is. Rows are hashed by
Spark's own functions; only hashes travel."""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

from pyspark import RDD, SparkContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import column, cut, prepare

#: Columns of ``documents`` in the order in which they enter a leaf.
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
#: Levels in a group of vertices, for two children a node; rows of a task at least, where cores allow, and at most.
BLOCK, LEAST, MOST = 8, 2_000, 500_000

#: (tree, place at the level).
Key = tuple[str, int]


def digest(*parts: str) -> str:
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def leaf(fields: Iterable[Column]) -> Column:
    """The hash of a row: of each field its bytes' count, a colon and its value; a dash for null."""
    texts = [f.cast("string") for f in fields]
    return F.sha2(F.concat(*[F.coalesce(F.concat(F.octet_length(t).cast("string"), F.lit(":"), t), F.lit("-")) for t in texts]), 256)


def parents(hashes: list[str], arity: int) -> list[str]:
    return [digest(*hashes[i : i + arity]) for i in range(0, len(hashes), arity)]


def levels(hashes: list[str], n: int, arity: int, most: int) -> list[list[str]]:
    """A group's nodes level by level, from the given ones up ``most`` levels or to the tree's top. n: how many nodes the whole tree has at the
    given level."""
    out = [hashes]
    while n > 1 and len(out) <= most:
        out.append(parents(out[-1], arity))
        n = -(-n // arity)
    return out


@dataclass(frozen=True)
class Above:
    """What a node hears from above: of its level and those above it, each from the node's place on up, the siblings (left, right) of it; and the root of its tree."""

    steps: tuple[tuple[tuple[str, ...], tuple[str, ...]], ...] = ()
    subroot: str = ""

    def siblings(self) -> list[str]:
        return [h for left, right in self.steps for h in (*left, *right)]

    def root(self, own: str) -> str:
        """What a node with the hash ``own`` in that place makes of the root."""
        for left, right in self.steps:
            own = digest(*left, own, *right)
        return own

    def below(self, up: list[list[str]], place: int, arity: int) -> Above:
        """What a node of the group below hears."""
        steps = []
        for row in up[:-1]:
            first = place - place % arity
            steps.append((tuple(row[first:place]), tuple(row[place + 1 : first + arity])))
            place //= arity
        return Above((*steps, *self.steps), self.subroot)


def tasks_for(sc: SparkContext, n: int) -> int:
    return max(1, -(-n // MOST), min(-(-n // LEAST), 4 * sc.defaultParallelism))


def _deal(key: Key) -> int:
    """Groups of one tree go to many tasks. Python's hash of strings may differ between workers, so keys are hashed by their text."""
    return int.from_bytes(hashlib.blake2b(repr(key).encode(), digest_size=7).digest())


def _meet(left: RDD, right: RDD, tasks: int) -> RDD:
    """key, (left value, right value) of keys in both; each side has a key once. A side that is dealt by ``_deal`` already stays where it is."""

    def both(values: Iterable[tuple[bool, object]]) -> Iterator[tuple]:
        found = dict(values)
        if len(found) == 2:
            yield found[False], found[True]

    sides = [side.partitionBy(tasks, _deal).mapValues(lambda v, i=i: (i, v)) for i, side in ((False, left), (True, right))]
    return sides[0].union(sides[1]).groupByKey(tasks, _deal).flatMapValues(both)


def _group(messages: Iterable[tuple]) -> tuple[list[str], int, list]:
    found = sorted(messages, key=lambda m: m[0])
    return [m[1] for m in found], found[0][2], [m[3] for m in found]


@dataclass
class Forest:
    """The upward supersteps' outcome. groups: of each superstep ((tree, group), (hashes, nodes of the tree at that level, notes)); tops: (tree, hash)."""

    groups: list[RDD]
    tops: RDD
    arity: int
    block: int


def climb(leaves: RDD, n_leaves: int, arity: int = 2, block: int = BLOCK) -> Forest:
    """leaves: ((tree, place), (hash, leaves of the tree, note)); notes stay with their leaf. Supersteps until every tree has one node left."""
    width, groups, tops, most = arity**block, [], [], n_leaves

    def send(x: tuple[Key, tuple]) -> tuple[Key, tuple]:
        (tree, place), message = x
        return (tree, place // width), (place, *message)

    def forward(x: tuple[Key, tuple]) -> tuple[Key, tuple]:
        (tree, at), (hashes, n, _) = x
        return (tree, at), (levels(hashes, n, arity, block)[-1][0], -(-n // width), None)

    sent = leaves.map(send)
    while True:
        # a group has all its messages: its size is bounded
        group = sent.groupByKey(tasks_for(leaves.context, most), _deal).mapValues(_group)
        groups.append(group)
        done = group.map(forward)
        tops.append(done.filter(lambda x: x[1][1] == 1).map(lambda x: (x[0][0], x[1][0])))
        if most <= width:  # no tree can have more than one group
            return Forest(groups, leaves.context.union(tops), arity, block)
        sent = done.filter(lambda x: x[1][1] > 1).map(send)
        most = -(-most // width)


def descend(forest: Forest, above: RDD) -> RDD:
    """((tree, group), ((hashes, n, notes), Above)) of the groups of leaves. above: (tree, Above) of each tree's top.

    Each superstep hands a group's message to the groups below it; a path is sent once a group, not once a leaf."""
    arity, block = forest.arity, forest.block
    width = arity**block

    def hand(x: tuple[Key, tuple]) -> Iterator[tuple[Key, Above]]:
        (tree, at), ((hashes, n, _), heard) = x
        up = levels(hashes, n, arity, block)
        for i in range(len(hashes)):
            yield (tree, at * width + i), heard.below(up, i, arity)

    met = None
    for group in reversed(forest.groups):
        # a tree whose top is in this superstep hears from outside, others from the superstep above
        top = group.filter(lambda x: x[1][1] <= width).map(lambda x: (x[0][0], x[0]))
        told = _meet(top, above, above.getNumPartitions()).map(lambda x: x[1])
        met = _meet(group, told if met is None else told.union(met.flatMap(hand)), group.getNumPartitions())
    return met


def numbered(rows: DataFrame, tree: str, order: list[str], tasks: int) -> DataFrame:
    """Adds place (from 0, by ``order`` inside the tree) and n (rows of the tree). Rows move once, by ranges of (tree, order); a tree's places follow from
    how many of its rows each range holds."""
    spread = cut(rows.repartitionByRange(tasks, tree, *order).sortWithinPartitions(tree, *order))
    row = F.monotonically_increasing_id()
    part, at = F.shiftright(row, 33), row.bitwiseAND((1 << 33) - 1)
    spread = spread.withColumns({"part": part, "at": at})
    runs = spread.groupBy(tree, "part").agg(F.count("*").alias("here"), F.min("at").alias("first"))
    by = Window.partitionBy(tree)  # of a tree no more rows than ranges
    runs = runs.select(tree, "part", "first", (F.sum("here").over(by.orderBy("part")) - F.col("here")).alias("before"), F.sum("here").over(by).alias("n"))
    return spread.join(runs, [tree, "part"]).withColumn("place", F.col("at") - F.col("first") + F.col("before")).drop("part", "at", "first", "before")


_FOUND = "doc_id long, leaf string, subroot string, root string, proof_sha256 string, folded_root string, verified boolean"


def tampered(docs: DataFrame) -> Column:
    """Whether a row counts as tampered with: 7 divides the checksum of its doc_id."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 7 == 0, F.lit(False))


def manifest(docs: DataFrame, suspect: Column | None = None, arity: int = 2, block: int = BLOCK) -> DataFrame:
    """doc_id, leaf, subroot, root, proof_sha256, folded_root, verified.

    docs: ``FIELDS``. A tree per lang over its rows by doc_id, and a tree over those trees' roots by lang, nulls first in both. suspect: the leaf hash of the
    row as it is found now; it is folded with the siblings of the manifest, and verified says if that gives the root (default: the row's
    own hash). Rows with equal doc_id stand in order of their hashes, so repeated rows change places only with their equals; null doc_ids come
    first; a lone row's hash is its tree's root; an empty table gives an empty manifest; very long texts are hashed where they lie; other columns are
    ignored."""
    spark = docs.sparkSession
    prepare(spark)
    sc, width = spark.sparkContext, arity**block
    own = leaf(map(column, FIELDS))
    tree = F.coalesce(F.concat(F.lit("+"), F.col("lang")), F.lit(""))
    rows = cut(docs.select(tree.alias("tree"), F.col("doc_id").cast("long").alias("doc_id"), own.alias("leaf"), F.nullif(own if suspect is None else suspect, own).alias("suspect")))
    n = rows.count()
    if not n:
        return spark.createDataFrame([], _FOUND)
    placed = numbered(rows, "tree", ["doc_id", "leaf"], tasks_for(sc, n)).rdd
    forest = climb(placed.map(lambda r: ((r.tree, r.place), (r.leaf, r.n, (r.doc_id, r.suspect)))), n, arity, block)
    trees = cut(spark.createDataFrame(forest.tops, "tree string, top string"))
    n_trees = trees.count()
    tops = numbered(trees.withColumn("all", F.lit("")), "all", ["tree"], tasks_for(sc, n_trees)).rdd
    crown = climb(tops.map(lambda r: (("", r.place), (r.top, r.n, r.tree))), n_trees, arity, block)
    root = crown.tops.first()[1]

    def outer(x: tuple[Key, tuple]) -> Iterator[tuple[str, Above]]:
        (hashes, n, names), heard = x[1]
        up = levels(hashes, n, arity, block)
        for i, name in enumerate(names):
            yield name, Above(heard.below(up, i, arity).steps, hashes[i])

    def verify(x: tuple[Key, tuple]) -> Iterator[tuple]:
        (hashes, n, notes), heard = x[1]
        up = levels(hashes, n, arity, block)
        for i, (doc_id, found) in enumerate(notes):
            path = heard.below(up, i, arity)
            folded = path.root(hashes[i] if found is None else found)
            yield doc_id, hashes[i], path.subroot, root, digest(*path.siblings()), folded, folded == root

    paths = descend(crown, sc.parallelize([("", Above())], 1)).flatMap(outer)
    return spark.createDataFrame(descend(forest, paths).flatMap(verify), _FOUND, verifySchema=False)


def sealed(docs: DataFrame) -> DataFrame:
    """The manifest of ``docs``, checked against the same rows with one added to n_chars where :func:`tampered` says so."""
    fields = [column(c) + F.when(tampered(docs), 1).otherwise(0) if c == "n_chars" else column(c) for c in FIELDS]
    return manifest(docs, F.when(tampered(docs), leaf(fields)).otherwise(leaf(map(column, FIELDS))))
