"""Greedy choice and packing by doubling, against a plain fold."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from colloquy.operators import sequences as S


def chosen(times, apart, inclusive):
    kept = []
    for t in sorted(times):
        if not kept or (t - kept[-1] >= apart if inclusive else t - kept[-1] > apart):
            kept.append(t)
    return kept


def filled(sizes, most):
    used = chunk = 0
    out = []
    for n in sizes:
        if used == 0 or used + n <= most:
            used += n
        else:
            chunk, used = chunk + 1, n
        out.append(chunk)
    return out


@pytest.mark.parametrize(("apart", "inclusive"), [(10, True), (10, False), (0, False), (0, True)])
def test_greedy(spark, apart, inclusive):
    rng = random.Random(apart)
    data = {g: [rng.randrange(300) for _ in range(rng.choice([1, 2, 40, 120]))] for g in range(20)}
    rows = spark.createDataFrame([(g, t) for g, v in data.items() for t in v], "g int, t long")
    assert {r.g: list(r.kept) for r in S.greedy(rows, ["g"], "t", apart, inclusive).collect()} == {g: chosen(v, apart, inclusive) for g, v in data.items()}


@pytest.mark.parametrize("most", [1, 10, 1000])
def test_packed(spark, most):
    rng = random.Random(most)
    data = {g: [rng.choice([0, 0, 1, 3, 7, 50]) for _ in range(rng.choice([1, 2, 40, 120]))] for g in range(30)}
    rows = spark.createDataFrame([(g, 2 * i, n) for g, v in data.items() for i, n in enumerate(v)], "g int, o long, n long").repartition(5)
    got: dict[int, list] = {}
    for r in S.packed(rows, ["g"], "o", F.col("n"), most).orderBy("g", "o").collect():
        got.setdefault(r.g, []).append(r.chunk)
    assert got == {g: filled(v, most) for g, v in data.items()}


def test_nothing_to_choose(spark):
    empty = spark.createDataFrame([], "g int, t long")
    assert S.greedy(empty, ["g"], "t", 5).collect() == S.packed(empty, ["g"], "t", F.col("t"), 5).collect() == []
    assert S.greedy(spark.createDataFrame([(1, None)], "g int, t long"), ["g"], "t", 5).first().kept == []


def test_a_long_recording_takes_few_rounds(spark):
    rows = spark.range(20_000).select(F.lit(1).alias("g"), F.col("id").alias("t"))
    kept = S.greedy(rows, ["g"], "t", 3).first().kept
    assert list(kept) == list(range(0, 20_000, 3))
