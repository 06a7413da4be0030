"""Quality rules and robust multivariate outliers.

Four statistics of each document, transformed to a vector, are judged against its language and source: a document is rejected
when its Mahalanobis distance, by the minimum-covariance-determinant estimate of its group, is beyond a chi-square quantile.

The estimate is the mean and covariance of the three quarters of a group whose covariance has the smallest determinant. Many
starts, each from D + 1 rows of a bounded number of the group's vectors, go through concentration steps on these; the ``BEST``
of them then go through concentration steps over all documents, for all groups at once and with sums by group only (the rows
with the smallest distances, by a histogram of distances, give the next mean and covariance), until no determinant falls. The
one with the smallest determinant is the group's. A group's estimate is drawn towards its language's by ``DRAWN`` rows' weight,
so a small group rests mostly on its language, a large one on itself, and none is switched from one to the other.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import cut, prepare

BLANK, SYMBOLS = " \t\n\x0b\x0c\r", "#*$%&|<>"
#: The base rules: fewest words, and percent of the words that may lie in repeated 3-word windows.
LEAST_WORDS, MOST_REPEATED = 50, 50
#: Part of a group that the estimate rests on; starts, and the vectors of a group that they see; starts that go on over all rows.
CORE, STARTS, SEEN, BEST = 0.75, 24, 1024, 2
#: Rows of its language that stand beside a group's own.
DRAWN = 20
#: A determinant has stopped falling when it falls by less than this part.
STILL = 1e-3
#: Standard deviations that are added (squared) to each transformed statistic's. Most groups' core is at exactly zero in three of the four, so
#: a floor must let one symbol, repeated line or repeated window in the shortest document (0.18, 0.18, 0.12) be within two of them.
FLOORS = (0.1, 0.15, 0.1, 0.06)
#: Probability that a normal vector lies beyond the limit: one good document in a thousand is rejected.
TAIL = 1e-3
D = len(FLOORS)
SALTS = 32


def statistics(text: str) -> tuple[int, int, int, int, int]:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words."""
    words = text.encode().split()
    chars = len(text) - sum(map(text.count, BLANK))
    lines = [x for x in text.split("\n") if x.strip(BLANK)] if "\n" in text else []
    n = len(words)
    repeated = 0
    if n > 3:
        number: dict[bytes, int] = {}
        x = np.fromiter((number.setdefault(w, len(number)) for w in words), np.int64, n)
        if len(number) < n:
            k = len(number)
            pair = np.unique(x[:-1] * k + x[1:], return_inverse=True)[1]
            _, window, count = np.unique(pair[:-1].astype(np.int64) * k + x[2:], return_inverse=True, return_counts=True)
            twice = count[window] > 1
            if twice.any():
                mark = np.zeros(n, bool)
                mark[:-2] |= twice
                mark[1:-1] |= twice
                mark[2:] |= twice
                repeated = int(mark.sum())
    return n, chars, sum(map(text.count, SYMBOLS)), len(lines) - len(set(lines)), repeated


_NAMES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def document_statistics(docs: DataFrame) -> DataFrame:
    """doc_id, lang, source and the statistics of every whole text."""
    prepare(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [statistics(t or "") for t in batch.column("text").to_pylist()]
            found = np.array(rows, np.int64).reshape(-1, len(_NAMES)).T
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), batch.column(2), *map(pa.array, found)], ["doc_id", "lang", "source", *_NAMES])

    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("lang").cast("string").alias("lang"), F.col("source").cast("string").alias("source"), "text")
    return docs.mapInArrow(run, "doc_id long, lang string, source string, " + ", ".join(f"{n} long" for n in _NAMES))


def transformed() -> list[Column]:
    words = F.greatest(F.col("n_words"), F.lit(1)).cast("double")
    return [F.log1p(10 * F.col("n_symbols") / words), F.col("word_chars") / words, F.log1p(10 * F.col("n_dup_lines") / words), F.col("n_repeat_words") / words]


def _chi2_cdf(x: float, even: int) -> float:
    return 1 - math.exp(-x / 2) * sum((x / 2) ** k / math.factorial(k) for k in range(even // 2))


def _chi2_quantile(tail: float, even: int) -> float:
    low, high = 0.0, 1000.0
    for _ in range(200):
        mid = (low + high) / 2
        low, high = (mid, high) if 1 - _chi2_cdf(mid, even) > tail else (low, mid)
    return high


#: Makes the covariance of the core that of the whole, for normal vectors.
CONSISTENCY = CORE / _chi2_cdf(_chi2_quantile(1 - CORE, D), D + 2)


def shape(n: float, mean: np.ndarray, square: np.ndarray) -> tuple[np.ndarray, float]:
    """Covariance of n core rows with the floors, from their means and mean products; and its log determinant."""
    # what a core of few rows leaves uncertain: expected squared distance of a further row, over that of many rows
    few = (n * n - 1) / (n * max(n - D - 2, 1))
    cov = few * CONSISTENCY * (square - np.outer(mean, mean)) + np.diag(np.square(FLOORS))
    return cov, float(np.linalg.slogdet(cov)[1])


def _core(x: np.ndarray, far: np.ndarray) -> tuple[np.ndarray, np.ndarray, float]:
    """Centre, covariance and log determinant of the CORE part of x with the smallest values of ``far``, ties in order."""
    h = max(1, math.ceil(CORE * len(x)))
    own = x[np.argsort(far, kind="stable")[:h]]
    mean = own.mean(0)
    return mean, *shape(h, mean, own.T @ own / h)


def concentrated(x: np.ndarray, starts: np.ndarray, best: int = BEST) -> list[tuple[float, np.ndarray, np.ndarray]]:
    """(log determinant, centre, covariance) of the ``best`` distinct ends, from the least on. starts: rows of x, one start each."""
    ends: dict[tuple, tuple[float, np.ndarray, np.ndarray]] = {}
    for rows in starts:
        own = x[rows]
        centre = own.mean(0)
        cov = np.cov(own.T, bias=True) + np.diag(np.square(FLOORS)) if len(own) > 1 else np.diag(np.square(FLOORS))
        least = math.inf
        while True:
            off = x - centre
            new_centre, new_cov, det = _core(x, np.einsum("ni,ij,nj->n", off, np.linalg.inv(cov), off))
            if det >= least - STILL:
                break
            centre, cov, least = new_centre, new_cov, det
        ends.setdefault((round(least, 6), *np.round(centre, 6)), (least, centre, cov))
    return [ends[k] for k in sorted(ends)[:best]]


def _starts(pdf: pd.DataFrame) -> pd.DataFrame:
    """The best starts of one group, from its seen vectors."""
    x = np.array(pdf.sort_values(["turn", *[f"y{i}" for i in range(D)]])[[f"y{i}" for i in range(D)]], float)
    rng = np.random.default_rng(0)
    some = [rng.choice(len(x), min(D + 1, len(x)), replace=False) for _ in range(STARTS)]
    middle = np.argsort(np.abs(x - np.median(x, 0)).sum(1), kind="stable")[: max(1, len(x) // 2)]
    found = concentrated(x, [middle, *some])
    rows = [(pdf["g"].iloc[0], s, centre.tolist(), np.linalg.inv(cov).ravel().tolist(), det) for s, (det, centre, cov) in enumerate(found)]
    return pd.DataFrame(rows, columns=["g", "s", "centre", "inverse", "det"])


_ESTIMATE = "g string, s int, centre array<double>, inverse array<double>, det double"


def _estimates(pdfs: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Sums by group and start → centre, inverse covariance, log determinant."""
    for pdf in pdfs:
        rows = []
        for r in pdf.itertuples(index=False):
            mean = np.array(r.first, float) / r.n
            cov, det = shape(r.n, mean, np.array(r.second, float).reshape(D, D) / r.n)
            rows.append((r.g, r.s, mean.tolist(), np.linalg.inv(cov).ravel().tolist(), det))
        yield pd.DataFrame(rows, columns=["g", "s", "centre", "inverse", "det"])


def _drawn(pdfs: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Each group's estimate, drawn towards its language's by DRAWN rows."""
    for pdf in pdfs:
        rows = []
        for r in pdf.itertuples(index=False):
            part = r.n / (r.n + DRAWN)
            own, theirs = np.array(r.centre, float), np.array(r.their_centre, float)
            cov, their_cov = (np.linalg.inv(np.array(v, float).reshape(D, D)) for v in (r.inverse, r.their_inverse))
            # of the two together: where they lie apart, the drawn one is as wide as that
            cov = part * cov + (1 - part) * their_cov + part * (1 - part) * np.outer(own - theirs, own - theirs)
            rows.append((r.g, (part * own + (1 - part) * theirs).tolist(), np.linalg.inv((cov + cov.T) / 2).ravel().tolist()))
        yield pd.DataFrame(rows, columns=["g", "centre", "inverse"])


def _distance() -> Column:
    off = [F.col(f"y{i}") - F.col("centre")[i] for i in range(D)]
    return sum((off[i] * off[j] * F.col("inverse")[D * i + j] for i in range(D) for j in range(D)), F.lit(0.0))


def _beside(rows: DataFrame, estimates: DataFrame) -> DataFrame:
    """Each row with its group's estimate; a large group's rows go to SALTS tasks."""
    estimates = estimates.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    return rows.withColumn("salt", F.pmod(F.xxhash64(*[f"y{i}" for i in range(D)]), F.lit(SALTS)).cast("int")).join(estimates, ["g", "salt"])


def _quantile_bin(bins: DataFrame, part: float, *by: str) -> DataFrame:
    """The bin that a part of each group's rows reach. bins: the group's columns, bin, n."""
    up = Window.partitionBy(*by).orderBy("bin")
    bins = bins.withColumn("up", F.sum("n").over(up)).withColumn("all", F.sum("n").over(Window.partitionBy(*by)))
    return bins.where(F.col("up") >= F.col("all") * part).groupBy(*by).agg(F.min("bin").alias("edge"))


def robust_estimates(rows: DataFrame) -> DataFrame:
    """g, centre, inverse, det. rows: g, y0 ... of every document."""
    y = [f"y{i}" for i in range(D)]
    # the first few by a hash of each of many parts of a group: no task meets a whole group
    turn = F.xxhash64(*y, F.monotonically_increasing_id())
    parts = Window.partitionBy("g", "part").orderBy("turn", *y)
    seen = rows.select("g", *y, turn.alias("turn")).withColumn("part", F.pmod("turn", F.lit(SALTS)))
    seen = seen.withColumn("nth", F.row_number().over(parts)).where(F.col("nth") <= SEEN // SALTS).drop("part", "nth")
    now = cut(seen.groupBy("g").applyInPandas(_starts, _ESTIMATE))
    done = None
    while True:
        far = _beside(rows, now.select("g", "s", "centre", "inverse")).withColumn("bin", F.least(F.floor(F.log1p(_distance()) * 128), F.lit(100_000)))
        # sums by bin, then of the bins that make the core: no row moves but as part of a sum
        sums = [F.sum(F.col(f"y{i}")).alias(f"s{i}") for i in range(D)] + [F.sum(F.col(f"y{i}") * F.col(f"y{j}")).alias(f"q{i}{j}") for i in range(D) for j in range(i, D)]
        bins = cut(far.groupBy("g", "s", "bin").agg(F.count("*").alias("n"), *sums))
        core = bins.join(_quantile_bin(bins.select("g", "s", "bin", "n"), CORE, "g", "s"), ["g", "s"]).where(F.col("bin") <= F.col("edge"))
        total = core.groupBy("g", "s").agg(F.sum("n").alias("n"), F.array(*[F.sum(f"s{i}") for i in range(D)]).alias("first"), F.array(*[F.sum(f"q{min(i, j)}{max(i, j)}") for i in range(D) for j in range(D)]).alias("second"))
        new = total.select("g", "s", "n", "first", "second").mapInPandas(_estimates, _ESTIMATE)
        if done is None:  # the starts' determinants are of the seen rows only
            now = cut(new.withColumn("falls", F.lit(True)))
            done = now.where("false")
        else:
            old = now.select("g", "s", *[F.col(c).alias(f"old_{c}") for c in ("centre", "inverse", "det")])
            both = new.join(old, ["g", "s"]).withColumn("falls", F.col("det") < F.col("old_det") - STILL)
            now = cut(both.select("g", "s", *[F.when(F.col("falls"), F.col(c)).otherwise(F.col(f"old_{c}")).alias(c) for c in ("centre", "inverse", "det")], "falls"))
            done = done.unionByName(now.where("not falls"))
        now = now.where("falls")
        if now.isEmpty():
            break
    return done.groupBy("g").agg(F.min_by(F.struct("centre", "inverse", "det"), F.struct("det", "s")).alias("e")).select("g", "e.*")


def judged(docs: DataFrame, tail: float = TAIL) -> DataFrame:
    """doc_id, the statistics, base_failed, distance (squared; null where the base rules failed), kept.

    The base rules reject fewer than LEAST_WORDS words, or more than MOST_REPEATED percent of them in repeated windows; the estimates rest on
    the other documents. Null languages and sources are groups like others; every group has its own estimate, drawn towards that of all
    documents of its language (never another's) the more, the fewer rows it has. A null text has no words; repeated rows count and
    return as often as they come; a very long text is one row like others; an empty table gives an empty result; other columns are ignored."""
    rows = document_statistics(docs)
    failed = (F.col("n_words") < LEAST_WORDS) | (100 * F.col("n_repeat_words") > MOST_REPEATED * F.col("n_words"))
    tongue = F.concat(F.lit("\x02"), F.coalesce("lang", F.lit("\x00")))
    name = F.concat(F.coalesce("lang", F.lit("\x00")), F.lit("\x01"), F.coalesce("source", F.lit("\x00")))
    y = [f"y{i}" for i in range(D)]
    rows = cut(rows.withColumns({"base_failed": failed, "g": name, "tongue": tongue}).withColumns(dict(zip(y, transformed(), strict=True))).drop("lang", "source"))
    vectors = rows.where("not base_failed")
    estimates = robust_estimates(vectors.select("g", *y).unionByName(vectors.select(F.col("tongue").alias("g"), *y)))
    estimates = cut(estimates.select("g", "centre", "inverse"))
    groups = vectors.groupBy("g", "tongue").agg(F.count("*").alias("n")).join(estimates, "g")
    theirs = estimates.select(F.col("g").alias("tongue"), F.col("centre").alias("their_centre"), F.col("inverse").alias("their_inverse"))
    drawn = cut(groups.join(theirs, "tongue").drop("tongue").mapInPandas(_drawn, "g string, centre array<double>, inverse array<double>"))
    limit = _chi2_quantile(tail, D)
    far = _beside(vectors, drawn).withColumn("distance", _distance())
    columns = ["doc_id", *_NAMES]
    passed = far.select(*columns, F.lit(False).alias("base_failed"), "distance", (F.col("distance") <= limit).alias("kept"))
    return passed.unionByName(rows.where("base_failed").select(*columns, "base_failed", F.lit(None).cast("double").alias("distance"), F.lit(False).alias("kept")))
