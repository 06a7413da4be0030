"""Nearest and containing intervals by sorted passes, against all pairs; ties, touching ends, nulls, empty sides, clashing columns."""

from __future__ import annotations

import numpy as np

from colloquy.operators import intervals

LEFT, RIGHT = "rec long, id long, start_ms long, end_ms long, gap string", "rec long, start_ms long, end_ms long, id string"


def sides(g, n, m):
    left = [(int(r), i, int(s), int(s + k), "own") for i, (r, s, k) in enumerate(zip(g.integers(0, 4, n), g.integers(0, 60, n), g.integers(0, 6, n), strict=True))]
    right = [(int(r), int(s), int(s + k), "x") for r, s, k in zip(g.integers(1, 5, m), g.integers(0, 60, m), g.integers(0, 9, m), strict=True)]
    return left, right


def test_against_all_pairs(spark):
    g = np.random.default_rng(7)
    for n, m in ((80, 12), (80, 60), (10, 1), (5, 0), (0, 5)):
        left, right = sides(g, n, m)
        odd = [(None, 900, 1, 2, ""), (1, 901, None, 2, ""), (1, 902, 3, None, "")]
        a = spark.createDataFrame([*left, *odd], LEFT)
        b = spark.createDataFrame([*right, (None, 0, 99, ""), (1, None, 99, ""), (1, 0, None, "")], RIGHT)
        want = {i: min(max(0, p - e, s - q) for k, p, q, _ in right if k == r) for r, i, s, e, _ in left if any(k == r for k, *_ in right)}
        assert {r.id: r[-1] for r in intervals.nearest_gap(a.drop("gap"), b, ["rec"]).collect()} == want
        inside = sorted(i for r, i, s, *_ in [*left, odd[2]] if any(k == r and p <= s <= q for k, p, q, _ in right))
        got = intervals.starting_inside(a, b, ["rec"])
        assert sorted(r.id for r in got.collect()) == inside and got.columns == a.columns


def test_touching_and_repeated(spark):
    a = spark.createDataFrame([(1, 1, 10, 20, ""), (1, 1, 10, 20, ""), (1, 2, 31, 40, "")], LEFT).drop("gap")
    b = spark.createDataFrame([(1, 0, 10, ""), (1, 20, 30, "")], RIGHT)
    assert sorted((r.id, r.gap) for r in intervals.nearest_gap(a, b, ["rec"]).collect()) == [(1, 0), (1, 0), (2, 1)]
    assert sorted(r.id for r in intervals.starting_inside(a, b, ["rec"]).collect()) == [1, 1]
