"""Sounds as rows of samples: overlapping windows and the energies of their bands."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Bands of a window, their ends (hertz), the shortest window (seconds), what an empty band gets and what is added to a power and to a root before the logarithm.
BANDS, LOW, HIGH, LEAST, EMPTY, POWER_FLOOR, SQUARE_FLOOR = 24, 80, 7600, 0.2, -23.0, 1e-10, 1e-12


def framed(samples: DataFrame, by: list[str], width: int, hop: int) -> DataFrame:
    """by, window, x: the samples (i from 0, x) of each window in order; window w holds places w * hop to w * hop + width, its end excluded.

    Each sample goes to the windows that it lies in, width / hop of them, so a recording's parts meet nobody but their neighbours and
    no recording is one task's. Places without a sample, or with a null, are left out; the last windows are shorter."""
    first, last = F.greatest(F.lit(0).cast("long"), F.floor((F.col("i") - width) / hop) + 1), F.floor(F.col("i") / hop)
    each = samples.where("x IS NOT NULL").select(*by, "i", F.col("x").cast("double").alias("x"), F.explode(F.when(first <= last, F.sequence(first, last))).alias("window"))
    return each.groupBy(*by, "window").agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "x"))), lambda s: s["x"]).alias("x"))


def edges(rate: int, bands: int = BANDS) -> np.ndarray:
    """Ends of the bands, in equal ratios."""
    return np.geomspace(LOW, min(HIGH, rate / 2 - 1), bands + 1)


def energies(x: np.ndarray, rate: int, bands: int = BANDS) -> np.ndarray:
    """Of windows of one length (a row each): the logarithm of each band's mean power, of the root mean square, and the share of changes of sign."""
    n = x.shape[1]
    power = np.abs(np.fft.rfft(x * np.hanning(n), axis=1)) ** 2
    at = np.searchsorted(edges(rate, bands), np.fft.rfftfreq(n, 1 / rate), side="right") - 1  # the band that each frequency lies in
    out = np.full((len(x), bands + 2), EMPTY)
    for b in range(bands):
        if (at == b).any():
            out[:, b] = np.log(power[:, at == b].mean(1) + POWER_FLOOR)
    out[:, bands] = np.log(np.sqrt((x**2).mean(1) + SQUARE_FLOOR) + POWER_FLOOR)
    out[:, bands + 1] = (np.diff(np.signbit(x), axis=1) != 0).mean(1)
    return out


def band_energies(windows: DataFrame, rate: int, least: float = LEAST, bands: int = BANDS, at_once: int = 1 << 20) -> DataFrame:
    """windows (x: samples) with features in place of x: ``energies``, null for windows under ``least`` seconds or two samples.

    Windows of one length are transformed together, about ``at_once`` samples at a time, so a worker's memory hangs on that and on Arrow's batch."""
    held = [c for c in windows.columns if c != "x"]
    out = windows.select(*held, F.lit(None).cast("array<double>").alias("features")).schema
    shortest = max(2, int(rate * least))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = batch.column("x")
            sizes = x.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
            found: list[np.ndarray | None] = [None] * len(batch)
            for n in np.unique(sizes[sizes >= shortest]):
                same, step = np.flatnonzero(sizes == n), max(1, at_once // int(n))
                for k in range(0, len(same), step):
                    some = same[k : k + step]
                    block = x.take(pa.array(some)).flatten().to_numpy(zero_copy_only=False).reshape(len(some), n)
                    for i, row in zip(some, energies(block, rate, bands), strict=True):
                        found[i] = row
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in held), pa.array(found, pa.list_(pa.float64()))], names=[*held, "features"])

    return windows.select(*held, "x").mapInArrow(run, out)
