"""Quality classifier: naive Bayes support vectors.

The features are indicators of n-grams over a text's character classes (runs are one symbol, so words are shapes), of
n-grams that are frequent, of words that repeat the word before them, and of the lower-cased text's words, word pairs and
character trigrams, of all scripts. Each is scaled by the log ratio of its smoothed counts in the two
classes; on these a linear hinge-loss model is fitted by dual coordinate descent. A held-out part of the
training rows turns margins into probabilities.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import give_back, packed, prepare, unpacked

#: Labelled rows that a fit takes at most, in order of a hash: enough for some hundred thousand weights.
SAMPLE = 12_000
#: Orders of shape n-grams, their hash space, and the rates from which a frequent n-gram has a further indicator.
ORDERS, SPACE, RATES = 4, 1 << 16, (1 / 64, 1 / 16, 1 / 6, 1 / 3)
#: Hash space of words, word pairs and character trigrams, and where it begins.
WORDS, SHAPES = 1 << 19, SPACE * (1 + len(RATES)) + 8
WIDTH = SHAPES + WORDS
#: Smoothing of counts; bound of the dual variables; passes; every how many-th training row calibrates.
ALPHA, C, PASSES, CALIBRATES = 1.0, 1.0, 15, 5
CUT = 0.7


def _classes() -> np.ndarray:
    """Byte → class: digits, lower and upper case are one each; bytes of other letters none (0); the rest themselves."""
    table = np.arange(256, dtype=np.uint8)
    table[128:] = 0
    table[ord("0") : ord("9") + 1] = ord("9")
    table[ord("a") : ord("z") + 1] = ord("a")
    table[ord("A") : ord("Z") + 1] = ord("A")
    table[[9, 11, 12, 13]] = ord(" ")
    return table


_TABLE = _classes()


def features(text: str) -> np.ndarray:
    """Distinct feature numbers below WIDTH, in order; none for an empty text."""
    return np.concatenate([_shapes(text.encode()), _wordings(text)]).astype(np.int32)


def _wordings(text: str) -> np.ndarray:
    """Of the words, word pairs and character trigrams of the whole lower-cased text; spaces are alike, and stand at both ends."""
    words = text.lower().encode("utf-8", "replace").split()
    if not words:
        return np.zeros(0, np.int64)
    prime, mix = np.uint64(0x100000001B3), np.uint64(0x9E3779B97F4A7C15)
    h = np.fromiter(map(xxhash.xxh64_intdigest, words), np.uint64, len(words))
    c = np.frombuffer((b" " + b" ".join(words) + b" ").decode().encode("utf-32-le"), np.uint32).astype(np.uint64)
    t = ((c[:-2] * prime ^ c[1:-1]) * mix * prime ^ c[2:]) * mix
    keys = np.concatenate([h, (h[:-1] * prime ^ h[1:]) * mix, t]) >> np.uint64(45)
    return np.unique(keys).astype(np.int64) + SHAPES


def _shapes(data: bytes) -> np.ndarray:
    x = _TABLE[np.frombuffer(data, np.uint8)]
    x = x[x > 0]
    if not len(x):
        return np.zeros(0, np.int64)
    x = x[np.concatenate(([True], x[1:] != x[:-1]))].astype(np.uint64)
    grams, h = [], np.zeros(len(x), np.uint64)
    for k in range(min(ORDERS, len(x))):
        h = (h[: len(x) - k] * np.uint64(0x100000001B3) ^ x[k:]) * np.uint64(0x9E3779B97F4A7C15)
        grams.append(h >> np.uint64(48))
    count = np.bincount(np.concatenate(grams).astype(np.int64), minlength=SPACE)
    found = np.flatnonzero(count)
    rate = count[found] / len(x)
    out = [found] + [found[rate >= r] + SPACE * (i + 1) for i, r in enumerate(RATES)]
    words = data.split()
    again = sum(a == b for a, b in zip(words, words[1:], strict=False)) / max(1, len(words))
    out.append(np.array([SPACE * (1 + len(RATES)) + i for i, r in enumerate(RATES) if again >= r], np.int64))
    return np.concatenate(out)


@dataclass(frozen=True)
class Model:
    """Score: logistic of slope * margin + shift; margin: sum of the weights of a text's features over the root of the sum of squared ratios."""

    weights: np.ndarray
    ratios: np.ndarray
    bias: float
    slope: float
    shift: float

    def score(self, found: np.ndarray) -> float:
        norm = float(np.sqrt(self.squares[found].sum())) if len(found) else 0.0
        margin = (float(self.products[found].sum()) / norm if norm else 0.0) + self.bias
        return float(1 / (1 + np.exp(-np.clip(self.slope * margin + self.shift, -30, 30))))

    def __reduce__(self) -> tuple:
        return Model, (self.weights, self.ratios, self.bias, self.slope, self.shift)

    def __post_init__(self) -> None:
        object.__setattr__(self, "products", self.weights * self.ratios)
        object.__setattr__(self, "squares", np.square(self.ratios))


def fit_rows(rows: list[np.ndarray], labels: np.ndarray) -> Model:
    """rows: the features of each; labels: 0 or 1. Without both classes, the score is the part of label 1 (0.5 without rows)."""
    n = len(rows)
    zero = np.zeros(WIDTH)
    if not n or labels.min() == labels.max():
        part = (labels.sum() + 0.5) / (n + 1)
        return Model(zero, zero, 0.0, 1.0, float(np.log(part / (1 - part))))
    y = np.where(labels > 0, 1.0, -1.0)
    held = np.arange(n) % CALIBRATES == 0
    if min(held.sum(), (y[~held] > 0).sum(), (y[~held] < 0).sum()) == 0:
        held = np.zeros(n, bool)
    use = np.flatnonzero(~held)
    counts = {s: np.full(WIDTH, ALPHA) for s in (1.0, -1.0)}
    for i in use:
        counts[y[i]][rows[i]] += 1
    ratios = np.log((counts[1.0] / counts[1.0].sum()) / (counts[-1.0] / counts[-1.0].sum()))
    w, bias, dual = np.zeros(WIDTH), 0.0, np.zeros(n)
    # rows' values are taken from the ratios when needed: kept for all rows they would take twice the features' memory
    norm = np.array([np.sqrt(np.square(ratios[r]).sum()) or 1.0 for r in rows])
    size = np.array([np.square(ratios[r] / d).sum() + 1 for r, d in zip(rows, norm, strict=True)])  # the bias is a feature that all have
    most = {1.0: C, -1.0: C * max(1.0, (y[use] > 0).sum() / (y[use] < 0).sum()) ** 0.5}
    rng = np.random.default_rng(1)
    for _ in range(PASSES):
        worst = 0.0
        for i in rng.permutation(use):
            x = ratios[rows[i]] / norm[i]
            gradient = y[i] * (w[rows[i]] @ x + bias) - 1
            new = min(max(dual[i] - gradient / size[i], 0.0), most[y[i]])
            step = (new - dual[i]) * y[i]
            if step:
                w[rows[i]] += step * x
                bias += step
                dual[i] = new
                worst = max(worst, abs(step))
        if worst < 1e-3:
            break
    margins = np.array([w[r] @ ratios[r] / d + bias for r, d in zip(rows, norm, strict=True)])
    on = held if held.any() else np.ones(n, bool)
    m, t = margins[on], labels[on].astype(float)
    good, bad = t.sum(), len(t) - t.sum()
    t = np.where(t > 0, (good + 1) / (good + 2), 1 / (bad + 2))
    slope, shift = 1.0, 0.0
    for _ in range(100):  # Newton steps on the regularised log loss
        p = 1 / (1 + np.exp(-np.clip(slope * m + shift, -30, 30)))
        q = p * (1 - p) + 1e-9
        g = np.array([((p - t) * m).sum() + 1e-3 * slope, (p - t).sum()])
        h = np.array([[(q * m * m).sum() + 1e-3, (q * m).sum()], [(q * m).sum(), q.sum() + 1e-6]])
        step = np.linalg.solve(h, g)
        size_ = np.abs(step).max()
        step *= min(1.0, 2.0 / size_) if size_ else 1.0
        slope, shift = slope - step[0], shift - step[1]
        if size_ < 1e-8:
            break
    return Model(w, ratios, float(bias), float(max(slope, 1e-3)), float(shift))


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(4)) == 2, F.lit(False))


def fit(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Model:
    """Model of labels.quality from the rows that aren't held out.

    At most ``sample`` labelled ids take part (a bounded broadcast). Null ids, labels and texts (empty) are no
    obstacle: rows with a null id or label are left out; of rows that repeat an id the first text counts. One task fits the model; a fixed number of weights comes back."""
    prepare(docs.sparkSession)
    known = labels.where(F.col("doc_id").isNotNull() & F.col("quality").isNotNull() & ~held_out(F.col("doc_id")))
    known = known.groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.min("quality").alias("quality"))
    known = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").join(F.broadcast(known), "doc_id")
    # rows that repeat an id are one before they meet in the fitting task
    rows = rows.groupBy("doc_id").agg(F.min(F.coalesce("text", F.lit(""))).alias("text"), F.min("quality").alias("quality"))

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [features(t or "").tobytes() for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("quality").cast(pa.int32()), pa.array(found, pa.binary())], ["doc_id", "quality", "found"])

    def train(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("doc_id")
        pdf = pdf.iloc[np.random.default_rng(0).permutation(len(pdf))]
        m = fit_rows([np.frombuffer(x, np.int32) for x in pdf["found"]], (pdf["quality"].to_numpy() > 0).astype(int))
        out = pd.DataFrame({"weights": [m.weights.tobytes()], "ratios": [m.ratios.tobytes()], "numbers": [[m.bias, m.slope, m.shift]]})
        del pdf
        give_back()
        return out

    one = rows.mapInArrow(read, "doc_id long, quality int, found binary").withColumn("fit", F.lit(1)).groupBy("fit").applyInPandas(train, "weights binary, ratios binary, numbers array<double>").first()
    if one is None:
        return fit_rows([], np.zeros(0))
    return Model(np.frombuffer(bytes(one.weights)), np.frombuffer(bytes(one.ratios)), *one.numbers)


def _scores(model: Model, texts: list[str | None]) -> np.ndarray:
    return np.array([model.score(features(t or "")) for t in texts], float)


def score(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, score of every whole text (0 to 1, higher: label 1 is likelier; a null text scores as an empty one).

    Nothing but the text bears on the score. Repeated rows and null ids return as they come; an empty table gives an empty
    result; other columns are ignored."""
    prepare(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(_scores(model, batch.column("text").to_pylist()))], ["doc_id", "score"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, score double")


def good_documents(docs: DataFrame, model: Model, cut: float = CUT) -> DataFrame:
    """Rows of ``docs``, all columns of any names, whose score is ``cut`` or more.

    A null text scores as an empty one; null ids and repeated rows are judged row by row; an empty table gives an empty result."""
    prepare(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column("row").field(at).to_pylist()
            yield batch.filter(pa.array(_scores(model, texts) >= cut))
        give_back()

    at, rows = docs.columns.index("text"), docs.select(packed(docs).alias("row"))
    return unpacked(rows.mapInArrow(run, rows.schema), docs.columns)
