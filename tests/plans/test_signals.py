"""Windows of samples and their band energies, against direct sums; gaps, nulls, short and empty sounds, extra columns."""

from __future__ import annotations

import math

import numpy as np
import pytest

from colloquy.operators import signals

SAMPLES = "rec long, i long, x double"


@pytest.mark.parametrize(("width", "hop"), [(4, 2), (5, 3), (3, 3), (2, 5), (4, 1)])
def test_framed(spark, width, hop):
    rows = [(r, i, float(i * r)) for r in (1, 2) for i in range(17) if (r, i) != (2, 6)] + [(1, 17, None)]
    got = {(r.rec, r.window): r.x for r in signals.framed(spark.createDataFrame(rows, SAMPLES).repartition(7), ["rec"], width, hop).collect()}
    want = {(r, w): [x for q, i, x in rows if q == r and w * hop <= i < w * hop + width and x is not None] for r in (1, 2) for w in range(20)}
    assert got == {k: v for k, v in want.items() if v}


def direct(x, rate):
    """The features by the transform's definition."""
    n, out, band = len(x), [], signals.edges(rate)
    h = [v * (0.5 - 0.5 * math.cos(2 * math.pi * j / (n - 1))) for j, v in enumerate(x)]
    power = [abs(sum(v * complex(math.cos(2 * math.pi * j * k / n), -math.sin(2 * math.pi * j * k / n)) for j, v in enumerate(h))) ** 2 for k in range(n // 2 + 1)]
    for low, high in zip(band[:-1], band[1:], strict=True):
        p = [q for k, q in enumerate(power) if low <= k * rate / n < high]
        out.append(math.log(sum(p) / len(p) + 1e-10) if p else -23.0)
    rms = math.sqrt(sum(v * v for v in x) / n + 1e-12)
    return [*out, math.log(rms + 1e-10), sum((a < 0) != (b < 0) for a, b in zip(x, x[1:], strict=False)) / (n - 1)]


def test_band_energies(spark):
    g, rate = np.random.default_rng(1), 1000
    rows = [(k, [float(v) for v in g.normal(size=n)], "kept") for k, n in enumerate([200, 199, 200, 333, 1, 0, 250, 200])] + [(8, None, None), (9, [0.0] * 200, "still"), (10, [math.sin(2 * math.pi * 125 * t / rate) for t in range(400)], "tone")]
    for at_once in (1, 500, 1 << 20):
        got = {r.id: r for r in signals.band_energies(spark.createDataFrame(rows, "id long, x array<double>, features_of string"), rate, at_once=at_once).collect()}
        assert {k for k, r in got.items() if r.features is None} == {1, 4, 5, 8} and got[0].features_of == "kept"
        for k, x, _ in rows:
            if got[k].features is not None:
                assert got[k].features == pytest.approx(direct(x, rate), abs=1e-6)
    band = signals.edges(rate)
    top = int(np.argmax(got[10].features[: signals.BANDS]))
    assert band[top] <= 125 < band[top + 1]  # the tone stands in its own band
    assert got[9].features[signals.BANDS + 1] == 0


def test_nothing(spark):
    none = signals.framed(spark.createDataFrame([], SAMPLES), ["rec"], 4, 2)
    assert signals.band_energies(none, 1000).count() == 0
    one = signals.framed(spark.createDataFrame([(1, 0, 1.0)], SAMPLES), ["rec"], 4, 2)
    assert [r.features for r in signals.band_energies(one, 1000, least=0.0).collect()] == [None]
