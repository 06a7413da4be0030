"""Nearest profiles in blocks and the gate of precision, against plain loops; empty tables, nulls, ties, lone profiles, values at thresholds."""

from __future__ import annotations

import math

import numpy as np
import pytest

from colloquy.operators import precision, vectors


def plain(rows, profiles, by_angle):
    out = {}
    for i, v in rows:
        def score(m, v=v):
            d = sum(x * y for x, y in zip(v, m, strict=True))
            both = math.sqrt(float(sum(x * x for x in v)) * float(sum(y * y for y in m)))
            return d if not by_angle else d / both if both > 0 else 0.0
        order = sorted(((score(m), p) for p, m in profiles), key=lambda s: (-s[0], s[1]))
        out[i] = (order[0][1], order[0][0], order[1][0] if len(order) > 1 else None)
    return out


@pytest.mark.parametrize("by_angle", [False, True])
@pytest.mark.parametrize("most", [15, 1000])
def test_top_two(spark, by_angle, most):
    g = np.random.default_rng(5)
    profiles = [(f"p{k:02}", [int(x) * (1 + k % 9) for x in g.integers(-3, 4, 5)]) for k in range(40)] + [("q", [0] * 5), ("a", [9, 9, 9, 9, 9]), ("b", [9, 9, 9, 9, 9])]
    rows = [(i, [int(x) for x in g.integers(-4, 5, 5)]) for i in range(60)] + [(60, [0] * 5), (61, [1] * 5), (62, [2**30, 1, 0, 0, -(2**30)])]
    odd = spark.createDataFrame([(90, None), (91, [1, None, 1, 1, 1]), (92, [1, 2])], "id long, v array<long>")
    p = spark.createDataFrame([*profiles, (None, [99] * 5), ("n", None), ("m", [1, None, 1, 1, 1]), ("short", [99])], "profile string, mean array<long>")
    got = vectors.top_two(spark.createDataFrame(rows, "id long, v array<long>").union(odd), p, by_angle, most)
    assert got.columns == ["id", "best", "score", "second"]
    assert {r.id: tuple(r)[1:] for r in got.collect()} == plain(rows, profiles, by_angle)


def test_top_two_of_few(spark):
    rows = spark.createDataFrame([(1, [1, 2], "x")], "id long, v array<long>, best_name string")
    none = spark.createDataFrame([], "profile string, mean array<long>")
    assert vectors.top_two(rows, none).where("best IS NOT NULL").count() == 0
    one = spark.createDataFrame([("a", [3, 4])], "profile string, mean array<long>")
    assert [tuple(r) for r in vectors.top_two(rows, one).collect()] == [(1, "x", "a", 11, None)]
    assert vectors.top_two(rows.limit(0), one).count() == 0


def test_long_profiles_end_the_search(spark):
    """Blocks come by falling length, and a row meets no block that can't reach its second score."""
    p = spark.createDataFrame([(k, [k, 0]) for k in range(1, 101)], "profile long, mean array<long>")
    sizes = [size for _, size in vectors.blocks(p, 10, False)]
    assert sizes == sorted(sizes, reverse=True) and 8 <= len(sizes) <= 12
    meet = vectors._meet([1], np.array([[10**6, 0]]), 5.0, False)  # the block claims length 5: not asked where 6 is second
    import pyarrow as pa

    batch = pa.RecordBatch.from_pylist([{"v": [1, 0], "best": 9, "score": 7, "second": 6}, {"v": [1, 0], "best": 9, "score": 7, "second": 5}])
    assert [r["score"] for b in meet([batch]) for r in b.to_pylist()] == [7, 10**6]


def windows(spark, rows):
    return spark.createDataFrame(rows, "t long, name string, v array<long>")


def voices(n, names=("a", "b", "c")):
    return [(10 * i + k, name, [100 if j == k else (i * 7 + j) % 5 for j in range(len(names))]) for i in range(n) for k, name in enumerate(names)]


def test_gate_of_clear_voices(spark):
    out = {r.name: r for r in precision.gate(windows(spark, voices(60)), ["t"]).collect()}
    assert {r.status for r in out.values()} == {precision.CALIBRATED}
    assert [tuple(out["a"][c] for c in ("training", "calibration", "held_out", "accepted", "false_accepts", "impostors", "eligible"))] == [(36, 12, 12, 12, 0, 24, True)]
    assert out["a"].threshold == 0.5  # no wrong match in the calibration


def test_gate_reasons(spark):
    rows = voices(60)
    rows = [(t, "b" if name == "a" and t == 0 else name, v) for t, name, v in rows]  # the first of all, held out, bears b's name
    out = {r.name: r for r in precision.gate(windows(spark, rows), ["t"]).collect()}
    assert out["a"].reasons == ["held_out_false_accept"] and not out["a"].eligible
    assert {r.status for r in out.values()} == {precision.PARTIAL}
    few = {r.name: r for r in precision.gate(windows(spark, voices(10)), ["t"]).collect()}
    assert few["a"].reasons == ["insufficient_held_out_accepts", "insufficient_impostor_trials"] and {r.status for r in few.values()} == {precision.INSUFFICIENT}


def test_threshold_lies_above_the_worst_wrong_match(spark):
    rows = voices(60)
    rows = [(t, "b" if t == 10 else name, v) for t, name, v in rows]  # a's second window: in b's order a calibration window
    tried = precision.trials(windows(spark, rows), ["t"])
    wrong = [r.score for r in tried.where("part = 'calibration' AND NOT hit").collect()]
    assert wrong and {r.threshold for r in precision.gate(windows(spark, rows), ["t"]).collect()} == {max(wrong) + 0.02}
    assert {r.accepted for r in precision.gate(windows(spark, rows), ["t"]).collect()} == {0}  # as nothing passes above it


def test_gate_of_too_little(spark):
    out = precision.gate(windows(spark, [*voices(60), (1, "d", [1, 1, 1])]), ["t"]).collect()
    assert {(r.status, r.eligible, r.threshold, r.accepted, tuple(r.reasons)) for r in out} == {(precision.INSUFFICIENT, False, None, None, ())}
    assert precision.gate(windows(spark, []), ["t"]).count() == 0
    odd = [(1, None, [1, 1, 1]), (2, "e", None), (3, "e", [1, None, 1])]  # no name, no vector: as if absent
    assert {r.name for r in precision.gate(windows(spark, [*voices(60), *odd]), ["t"]).collect()} == {"a", "b", "c"}


def test_registry(spark):
    r = {r.name: r for r in precision.registry(windows(spark, [*voices(10), (7, "d", [1, 2, 3])]), ["t"], "t").collect()}
    assert (r["a"].samples, r["a"].span, r["d"].samples, r["d"].sums) == (6, 90, 1, [1, 2, 3])  # d has no training window: all it has
