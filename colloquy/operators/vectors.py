"""Nearest profiles, centroids, clusters, non-maximum suppression."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.columns import dot, whole
from ..sources.tables import scratch


def centroids(rows: DataFrame, label: str = "label") -> DataFrame:
    """label, n, sums (whole components) of each label's embeddings."""
    return centroids_of(rows.select(label, whole(F.col("embedding")).alias("v")), label)


def centroids_of(rows: DataFrame, label: str) -> DataFrame:
    """label, n, sums of v (whole components): by component, so that a large label is no single row's work."""
    parts = rows.select(label, F.posexplode("v").alias("i", "x")).groupBy(label, "i").agg(F.sum("x").alias("x"), F.count("*").alias("n"))
    ordered = F.transform(F.array_sort(F.collect_list(F.struct("i", "x"))), lambda s: s["x"])
    return parts.groupBy(label).agg(F.max("n").alias("n"), ordered.alias("sums"))


def blocks(profiles: DataFrame, most: int, by_angle: bool) -> list[tuple[DataFrame, float]]:
    """Parts of the profiles (profile, mean) of about ``most`` rows, the longest vectors first, each with its largest length. By angle
    all lengths count as one. Only numbers of parts reach the driver, none of a profile."""
    n = profiles.count()
    if n <= most:
        return [(profiles, float("inf"))]
    scratch(profiles.sparkSession)
    p = profiles.withColumn("__size", F.sqrt(dot(F.col("mean"), F.col("mean")).cast("double"))).checkpoint()
    cuts = [] if by_angle else sorted(set(p.approxQuantile("__size", [i * most / n for i in range(1, -(-n // most))], 0.001)))
    p = p.withColumn("__cell", sum((F.when(F.col("__size") < c, 1).otherwise(0) for c in cuts), F.lit(0)))
    out = []
    for cell, rows, size in sorted(map(tuple, p.groupBy("__cell").agg(F.count("*"), F.max("__size")).collect())):
        parts = -(-rows // most) if rows > 2 * most else 1  # equal lengths can't be cut apart, so a full cell is dealt
        each = p.where(F.col("__cell") == cell)
        out += [(each.where(F.pmod(F.hash("profile"), F.lit(parts)) == i).select("profile", "mean"), float("inf") if by_angle else size) for i in range(parts)]
    return out


def top_two(rows: DataFrame, profiles: DataFrame, by_angle: bool = False, most: int = 16_384) -> DataFrame:
    """rows without v, with best, score, second: of each row (v: whole components) the profile (profile, mean: whole components) with
    the largest product, or the largest cosine, and the next largest score; ties go to the smaller profile, a vector without length has
    cosine 0. second is null where there is one profile only. Rows and profiles whose vector is null, holds a null or has another
    length than most profiles' take no part, nor do profiles without a name.

    Profiles meet the rows block by block, as a matrix of about ``most`` rows, so neither a shuffle nor a product of tables is made. Blocks
    come by falling length: a row whose second score no later length can reach is done. Products below 2**53 are exact, as doubles;
    others must fit a long."""
    spark = rows.sparkSession
    kind, held = ("double" if by_angle else "long"), [c for c in rows.columns if c != "v"]
    name = profiles.schema["profile"].dataType.simpleString()
    p = profiles.where(F.col("profile").isNotNull() & F.col("mean").isNotNull() & ~F.exists("mean", F.isnull)).select("profile", "mean")
    width = p.groupBy(F.size("mean").alias("width")).count().orderBy(F.desc("count"), "width").limit(1).collect()
    width = width[0]["width"] if width else -1
    out = rows.where(F.col("v").isNotNull() & ~F.exists("v", F.isnull) & (F.size("v") == width))
    out = out.select(*held, "v", F.lit(None).cast(name).alias("best"), F.lit(None).cast(kind).alias("score"), F.lit(None).cast(kind).alias("second"))
    if width < 0:
        return out.drop("v")
    for i, (block, size) in enumerate(blocks(p.where(F.size("mean") == width), most, by_angle)):
        found = sorted(block.collect(), key=lambda r: r["profile"])
        if found:
            if i and i % 8 == 0:  # each block keeps a worker; cut the chain
                scratch(spark)
                out = out.checkpoint()
            out = out.mapInArrow(_meet([r["profile"] for r in found], np.array([r["mean"] for r in found], np.int64), size, by_angle), out.schema)
    return out.drop("v")


def _meet(names: list, means: np.ndarray, size: float, by_angle: bool) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """A function for mapInArrow that lets rows meet one block of profiles (names in order)."""

    def products(v: np.ndarray) -> np.ndarray:
        exact = int(np.abs(v).max(initial=0)) * int(np.abs(means).max(initial=0)) * v.shape[1] < 2**53
        d = (v.astype(float) @ means.T.astype(float)) if exact else v @ means.T
        if not by_angle:
            return d.astype(np.int64)
        both = np.sqrt((v.astype(float) ** 2).sum(1)[:, None] * (means.astype(float) ** 2).sum(1)[None])
        return np.divide(d, both, out=np.zeros(d.shape), where=both > 0)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole_batch in batches:
            for at in range(0, len(whole_batch), 512):
                batch = whole_batch.slice(at, 512)
                v = batch.column("v").flatten().to_numpy(zero_copy_only=False).reshape(len(batch), -1).astype(np.int64)
                best, score, second = (batch.column(c).to_pylist() for c in ("best", "score", "second"))
                reach = np.sqrt((v.astype(float) ** 2).sum(1)) * size * (1 + 1e-9) if np.isfinite(size) else np.full(len(v), np.inf)
                still = [i for i, s in enumerate(second) if s is None or not reach[i] < s]
                d = products(v[still])
                top = d.argmax(1) if still else []
                for i, row, k in zip(still, d, top, strict=True):
                    new = row[k].item()
                    rest = max(filter(lambda x: x is not None, (row[:k].max().item() if k else None, row[k + 1 :].max().item() if k + 1 < len(row) else None)), default=None)
                    if score[i] is None or new > score[i] or (new == score[i] and names[k] < best[i]):
                        best[i], score[i], other = names[k], new, score[i]
                    else:
                        other = new
                    second[i] = max((x for x in (second[i], other, rest) if x is not None), default=None)
                for c, values in (("best", best), ("score", score), ("second", second)):
                    k = batch.schema.get_field_index(c)
                    batch = batch.set_column(k, batch.schema.field(k), pa.array(values, batch.schema.field(k).type))
                yield batch

    return run


def nearest(rows: DataFrame, profiles: DataFrame, label: str = "label", most: int = 16_384) -> DataFrame:
    """vec_id, best, score, margin: of each row the profile with the largest product with the profile's mean, and the lead over the next."""
    p = profiles.select(F.col(label).alias("profile"), F.transform("sums", lambda s: F.floor(s / F.col("n"))).alias("mean"))
    t = top_two(rows.select("vec_id", whole(F.col("embedding")).alias("v")), p, most=most)
    return t.select("vec_id", "best", "score", (F.col("score") - F.col("second")).alias("margin"))


def kmeans(vectors: np.ndarray, k: int, rounds: int = 60) -> np.ndarray:
    """Cluster of each row: the first row and then the farthest from all chosen are the seeds; ties go to the lowest."""
    k = min(k, len(vectors))
    centres = [vectors[0]]
    while len(centres) < k:
        centres.append(vectors[int(np.min([((vectors - c) ** 2).sum(1) for c in centres], axis=0).argmax())])
    centres, found = np.array(centres, float), None
    for _ in range(rounds):
        now = np.argmin(((vectors[:, None, :] - centres[None]) ** 2).sum(2), axis=1)
        if found is not None and (now == found).all():
            break
        found = now
        for c in range(k):
            if (found == c).any():  # an empty one keeps its centre
                centres[c] = vectors[found == c].mean(0)
    return found


def cosine_kmeans(vectors: np.ndarray, k: int, rounds: int = 60) -> np.ndarray:
    """Cluster of each row by direction: the first row and then the one least like all chosen are the seeds; ties go to the lowest.
    A row of zeros is like nothing and joins the first cluster."""

    def unit(m: np.ndarray) -> np.ndarray:
        size = np.linalg.norm(m, axis=1, keepdims=True)
        return m / np.where(size > 0, size, 1)

    rows, k = unit(vectors.astype(float)), min(k, len(vectors))
    seeds, like = [0], rows @ rows[0]
    while len(seeds) < k:
        seeds.append(int(like.argmin()))
        like = np.maximum(like, rows @ rows[seeds[-1]])
    centres, found = rows[seeds], np.full(len(rows), -1)
    for _ in range(rounds):
        now = (rows @ centres.T).argmax(1)
        if (found == now).all():
            break
        found, sums = now, np.zeros_like(centres)
        np.add.at(sums, now, rows)
        filled = np.bincount(now, minlength=k) > 0  # an empty one keeps its centre
        centres = unit(np.where(filled[:, None], sums, centres))
    return found


def clusters(rows: DataFrame, by: str, k: int, method: Callable[[np.ndarray, int], np.ndarray] = kmeans) -> DataFrame:
    """by, vec_id, cluster: k-means, or its like by direction, in each group (a recording's windows; a group must fit a task)."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("vec_id")
        found = method(np.stack(pdf["embedding"].to_numpy()).astype(float), k)
        return pd.DataFrame({by: pdf[by].to_numpy(), "vec_id": pdf["vec_id"].to_numpy(), "cluster": found.astype(np.int64)})

    return rows.select(by, "vec_id", "embedding").groupBy(by).applyInPandas(run, f"{by} long, vec_id long, cluster long")


def suppressed(rows: DataFrame, by: str, most: float = 0.82) -> DataFrame:
    """Boxes (x0, y0, x1, y1, score) that no better one of their frame covers: best first, those kept that overlap none kept by ``most`` of their union."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["score", "id"], ascending=[False, True])
        kept: list[int] = []
        box = pdf[["x0", "y0", "x1", "y1"]].to_numpy()
        area = np.maximum(0, box[:, 2] - box[:, 0]) * np.maximum(0, box[:, 3] - box[:, 1])
        for i in range(len(box)):
            both = [max(0.0, min(box[i, 2], box[j, 2]) - max(box[i, 0], box[j, 0])) * max(0.0, min(box[i, 3], box[j, 3]) - max(box[i, 1], box[j, 1])) for j in kept]
            if all(b < most * (area[i] + area[j] - b) for b, j in zip(both, kept, strict=True)):
                kept.append(i)
        return pdf.iloc[kept]

    return rows.groupBy(by).applyInPandas(run, rows.schema)


def colliding(profiles: DataFrame, least: float, label: str = "label") -> DataFrame:
    """label of profiles whose cosine with another reaches ``least`` (above 0). Profiles meet profiles in blocks, of which each keeps its two nearest."""
    p = profiles.select(F.col(label).alias("profile"), F.col("sums").alias("mean"))
    t = top_two(p.select("profile", F.col("mean").alias("v")), p, by_angle=True)
    return t.where(F.when(F.col("best") == F.col("profile"), F.col("second")).otherwise(F.col("score")) >= least).select(F.col("profile").alias(label)).distinct()
