"""Exact top-k search by inner product over vector-approximation files.

The rows are dealt to shards of bounded size. A shard keeps, beside its exact vectors, an approximation of ``bits`` bits a component:
the cell of a uniform grid. A query scans the cells for upper bounds of the score (lower bounds of the distance): with a
uniform grid these are one product of the codes and the query's steps, plus a number of the query. It then reads exact vectors
in the order of those bounds until the next bound is below the k-th score found. The shards' results are merged; a query's
true top k are among them.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import prepare

#: Rows in a shard and queries in a block at most, and shards at least.
SHARD, BLOCK, LEAST = 32768, 16384, 24
#: Queries whose bounds are held at once.
SCAN = 128
#: Sums of products below this are exact in a long.
EXACT = 1 << 62
LONG = np.iinfo(np.int64)


def inner(rows: np.ndarray, query: np.ndarray) -> np.ndarray:
    """Exact integer scores; beyond a long they stand at its end."""
    if not rows.size:
        return np.zeros(len(rows), np.int64)
    reach = max(abs(int(rows.max())), abs(int(rows.min()))) * max(abs(int(query.max())), abs(int(query.min()))) * rows.shape[1]
    if reach < EXACT:
        return rows @ query
    exact = (rows.astype(object) * query.astype(object)).sum(1)
    return np.array([min(max(int(s), LONG.min), LONG.max) for s in exact], np.int64)


class VAFile:
    """Approximations and exact vectors of one shard. vectors: integers, one row each."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray, bits: int = 5):
        self.ids, self.vectors = ids, vectors
        self.cells = 1 << bits
        x = vectors.astype(float)
        least, most = x.min(0), x.max(0)
        # wide enough that rounding puts no component outside its cell
        slack = 1e-9 * (np.abs(least) + np.abs(most)) + 1e-9
        self.step = (most - least) / self.cells + slack
        self.least, self.slack = least, slack
        self.codes = np.clip((x - least) / self.step, 0, self.cells - 1).astype(np.uint8)

    def scan(self, queries: np.ndarray) -> np.ndarray:
        """An upper bound of each query's score with each row, from the cells alone."""
        q = queries.astype(float)
        steps = q * self.step
        codes = self.codes.astype(np.float32 if np.abs(steps).max(initial=0) < 1e30 else float)
        bound = (steps.astype(codes.dtype) @ codes.T).astype(float)
        # the far side of each cell, and what rounding may have taken from the sums
        far = q @ self.least + np.maximum(steps, 0).sum(1) + np.abs(q) @ (2 * self.slack)
        lost = (np.abs(steps).sum(1) * self.cells + np.abs(q) @ np.abs(self.least)) * (q.shape[1] + 4) * float(np.finfo(codes.dtype).eps)
        return bound + (far + lost)[:, None]

    def best(self, query: np.ndarray, own: int, bound: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
        """Ids and scores of the k best rows with another id, ties to the smaller id: exact vectors are read by falling bound, some
        at a time, until no unread bound reaches the k-th score."""
        n, seen = len(bound), np.zeros(len(bound), bool)
        ids, scores = np.zeros(0, np.int64), np.zeros(0, np.int64)
        read = min(n, 2 * k)
        while True:
            if read < n:
                order = np.argpartition(-bound, read)
                order, following = order[:read], bound[order[read]]
            else:
                order, following = np.arange(n), -np.inf
            new = order[~seen[order]]
            seen[new] = True
            new = new[self.ids[new] != own]
            ids, scores = np.concatenate((ids, self.ids[new])), np.concatenate((scores, inner(self.vectors[new], query)))
            top = np.lexsort((ids, -scores))[:k]
            ids, scores = ids[top], scores[top]
            if read == n or len(scores) == k and following < scores[-1]:
                return ids, scores
            read = min(n, 2 * read)

    def search(self, queries: np.ndarray, own: np.ndarray, k: int) -> list[tuple[int, int, int]]:
        """(query, vec_id, score) of each query's k best rows."""
        out = []
        for at in range(0, len(queries), SCAN):
            bounds = self.scan(queries[at : at + SCAN])
            for i, bound in enumerate(bounds, at):
                ids, scores = self.best(queries[i], int(own[i]), bound, k)
                out += zip([i] * len(ids), ids.tolist(), scores.tolist(), strict=True)
        return out


def integer_components(vector: Column, scale: int = 64) -> Column:
    return F.transform(vector, lambda x: F.floor(F.lit(float(scale)) * x.cast("double")))


def usable(vector: Column) -> Column:
    """Not null, and without null or non-finite components."""
    return F.coalesce(vector.isNotNull() & F.forall(vector, lambda x: F.coalesce(F.abs(x.cast("double")) < float("inf"), F.lit(False))), F.lit(False))


def top_k(vectors: DataFrame, is_query: Column, k: int = 20, bits: int = 5) -> DataFrame:
    """query_id, rank (from 1), vec_id, score (integer inner product of floor(64 * x)).

    vectors: vec_id, embedding; ``is_query`` picks the queries among its rows. A query's candidates are all rows with another vec_id.
    Rows whose vec_id or vector is null, or whose vector has null, NaN or infinite components, take no part. All other
    components count exactly, however large; a component or score that no long can hold stands at the end of the longs. Vectors of
    another length are not compared. A repeated row counts once as a query and every time as a candidate; equal scores go to the
    smaller vec_id. Other columns are ignored; an empty table gives an empty result."""
    prepare(vectors.sparkSession)
    rows = vectors.where(F.col("vec_id").isNotNull() & usable(F.col("embedding"))).select(F.col("vec_id").cast("long").alias("vec_id"), integer_components(F.col("embedding")).alias("v"), is_query.alias("asks"))
    rows = rows.withColumn("d", F.size("v"))
    n, asked = rows.agg(F.count("*"), F.count_if("asks")).first()
    shards, blocks = max(LEAST, -(-n // SHARD)), max(1, -(-asked // BLOCK))
    # a shard's rows are dealt by the whole row: a repeated vec_id fills none
    files = rows.select(F.pmod(F.xxhash64("vec_id", "v"), F.lit(shards)).cast("int").alias("shard"), F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("block"), "d", "vec_id", "v")
    asks = rows.where("asks").select("vec_id", "v", "d").distinct()
    asks = asks.select(F.explode(F.sequence(F.lit(0), F.lit(shards - 1))).alias("shard"), F.pmod(F.xxhash64("vec_id", "v"), F.lit(blocks)).cast("int").alias("block"), "d", "vec_id", "v", F.xxhash64("v").alias("vector"))

    def run(key: tuple, rows: pd.DataFrame, asks: pd.DataFrame) -> pd.DataFrame:
        found: list = []
        if len(rows) and len(asks) and key[2]:
            file = VAFile(rows["vec_id"].to_numpy(), np.stack(rows["v"].to_numpy()), bits)
            found = file.search(np.stack(asks["v"].to_numpy()), asks["vec_id"].to_numpy(), k)
        elif len(rows) and len(asks):  # vectors without components: every score is 0
            ids = np.sort(rows["vec_id"].to_numpy())
            found = [(i, int(v), 0) for i, a in enumerate(asks["vec_id"]) for v in ids[ids != a][:k]]
        q, ids, scores = (np.array(x, np.int64) for x in (zip(*found, strict=True) if found else ((), (), ())))
        return pd.DataFrame({"query_id": asks["vec_id"].to_numpy()[q], "vector": asks["vector"].to_numpy()[q], "vec_id": ids, "score": scores})

    by, wide = ("shard", "block", "d"), max(int(vectors.sparkSession.conf.get("spark.sql.shuffle.partitions")), shards)
    found = files.repartition(wide, *by).groupBy(*by).cogroup(asks.repartition(wide, *by).groupBy(*by)).applyInPandas(run, "query_id long, vector long, vec_id long, score long")
    order = Window.partitionBy("query_id", "vector").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
