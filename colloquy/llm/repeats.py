"""Repeated strings of a fixed length over a whole corpus, found shard by shard.

A *symbol* is a byte or a word, a *window* a run of ``window`` consecutive symbols of one document. A window must go
when the same symbols also start earlier: in a smaller doc_id, or in the same document at an earlier start.

Documents are in order of (doc_id, hash of the text). Dealing. Each window has an anchor, the smallest hash of the ``gram``-symbol strings in it; equal windows have equal
anchors, so all occurrences of a repeat meet in the shard of their anchor. Consecutive windows on one anchor form a
*segment*, the unit that is shipped. Passes over documents grouped into batches of bounded size (one exchange of the
texts, reused):

A. Each batch sends its distinct anchors, with how many occurrences and different segments they have; a shard returns
   those seen twice or more. Text on other anchors holds no repeat and never moves again.
B. Each batch sends the distinct segments on repeated anchors, each with all its places in the batch.
C. A shard's index (a suffix array or an FM-index) holds each different segment once, with all its occurrences. What
   its matches cover and is not the first occurrence is marked.
D. The marks return to their batch, where the documents are cut.

A batch sends any key or segment once, so no group grows with the copies of a text. An anchor on which more than ``CROWD``
segments differ would still fill its shard: its windows are dealt by their context instead, one by one: by a 128-bit digest of the
whole window, once per batch, with their places. Equality rests on the digest there, and on the symbols elsewhere.

Edge cases: a null text is an empty one; a null doc_id sorts before all others; rows that repeat a doc_id are
documents of their own, ordered by a hash of their text; documents shorter than a window come back unchanged; an empty table gives an
empty result; columns other than doc_id and text are not read.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import prepare

#: Different segments of an anchor, counted batch by batch, beyond which its windows are dealt one by one.
CROWD = 8192
#: Bytes of text in a batch, and in the share of a shard.
BATCH_BYTES, SHARD_BYTES = 4 << 20, 8 << 20
#: Both are at least so many, for even tasks.
LEAST = 64
#: The smallest long stands for a null doc_id.
NO_ID = np.iinfo(np.int64).min
#: Bits of a label that hold the place in the document; the rest is the document's number in its batch.
PLACE = 40

_ODD = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9)]


def _mixed(h: np.ndarray) -> np.ndarray:
    h = h ^ (h >> np.uint64(31))
    h *= _ODD[0]
    h ^= h >> np.uint64(29)
    return h


def rolled(symbols: np.ndarray, width: int, seed: int = 0) -> np.ndarray:
    """A 64-bit hash of every ``width`` consecutive symbols, by doubling."""
    n = len(symbols)
    if n < width:
        return np.zeros(0, np.uint64)
    power = _mixed((symbols + np.uint64(2 * seed + 1)) * _ODD[1])
    size, out, have, left = 1, None, 0, width
    while left:
        if left & 1:
            if out is None:
                out, have = power, size
            else:
                m = n - have - size + 1
                out, have = _mixed(out[:m] * _ODD[2] + power[have : have + m]), have + size
        left >>= 1
        if left:
            m = n - 2 * size + 1
            power, size = _mixed(power[:m] * _ODD[2] + power[size : size + m]), 2 * size
    return out


def segments(symbols: np.ndarray, bounds: np.ndarray, window: int, gram: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """First and last window start, anchor, and a hash of the symbols of each segment. bounds: where documents start, and the end."""
    n = len(symbols) - window + 1
    if n <= 0:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.uint64), np.zeros(0, np.uint64)
    edge = np.zeros(n + 1, np.int32)
    start, stop = bounds[:-1], bounds[1:] - window + 1
    long = stop > start
    np.add.at(edge, start[long], 1)
    np.add.at(edge, stop[long], -1)
    valid = np.cumsum(edge[:-1]) > 0
    grams = rolled(symbols, gram)
    least, size, span = grams, 1, window - gram + 1
    while size * 2 <= span:
        least, size = np.minimum(least[:-size], least[size:]), size * 2
    if size < span:
        least = np.minimum(least[: size - span], least[span - size :])
    fresh = np.ones(n, bool)
    # the anchor is the leftmost smallest gram; it changes also where that one leaves the window
    fresh[1:] = ~valid[:-1] | (least[1:] != least[:-1]) | (grams[: n - 1] == least[:-1])
    first = np.flatnonzero(valid & fresh)
    last = np.flatnonzero(valid & np.append(fresh[1:] | ~valid[1:], True))
    end = last + window - gram
    whole = (last - first).astype(np.uint64)
    for k in range(0, 2 * window, gram):  # grams side by side, and the last one
        whole = _mixed(whole * _ODD[2] + grams[np.minimum(first + k, end)])
    return first, last, least[first], whole


#: Number, segment, offset, length of each place of each match.
Matches = tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]


@dataclass
class Batch:
    """Documents in order of (doc_id, hash of the text, text), and their symbols end to end."""

    ids: np.ndarray
    ties: np.ndarray
    bounds: np.ndarray
    symbols: np.ndarray
    pieces: bytes | list[bytes]

    def place(self, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """doc_id, tie and label of places in ``symbols``."""
        k = np.searchsorted(self.bounds, at, side="right") - 1
        return self.ids[k], self.ties[k], (k << PLACE) + at - self.bounds[k]

    def found(self, labels: np.ndarray) -> np.ndarray:
        return self.bounds[labels >> PLACE] + (labels & ((1 << PLACE) - 1))


@dataclass(frozen=True)
class Kind:
    """What a symbol is. read: texts → symbols, their pieces and each document's count. piece: the bytes that are shipped for
    a stretch of pieces; size: the symbols in them. index: different segments → matches: number, segment, offset and length of all
    places of each string that is found at several places among them. Every window at several places lies in one."""

    window: int
    gram: int
    read: Callable[[list[str]], tuple[np.ndarray, bytes | list[bytes], np.ndarray]]
    piece: Callable[[bytes | list[bytes], int, int], bytes]
    size: Callable[[bytes], int]
    index: Callable[[list[bytes]], Matches]
    #: Segments that are indexed in one go, about.
    indexed: int


def batch_of(pdf: pd.DataFrame, kind: Kind) -> Batch:
    ids, ties = pdf["doc_id"].to_numpy(), pdf["tie"].to_numpy()
    texts = pdf["text"].tolist()
    order = sorted(range(len(ids)), key=lambda i: (ids[i], ties[i], texts[i]))
    symbols, pieces, counts = kind.read([texts[i] for i in order])
    bounds = np.zeros(len(ids) + 1, np.int64)
    np.cumsum(counts, out=bounds[1:])
    return Batch(ids[order], ties[order], bounds, symbols, pieces)


def _by(values: np.ndarray, n: int) -> Iterator[tuple[int, np.ndarray]]:
    """Shard of each value, and where the shard's values are."""
    shard = ((values >> np.uint64(13)) % np.uint64(n)).astype(np.int64)
    order = np.argsort(shard, kind="stable")
    cuts = np.flatnonzero(np.diff(shard[order])) + 1
    for part in np.split(order, cuts):
        if len(part):
            yield int(shard[part[0]]), part


def _join(values: pd.Series, kind: type) -> np.ndarray:
    return np.frombuffer(b"".join(values), kind)


def _anchors(kind: Kind, shards: int):
    def run(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        x = batch_of(pdf, kind)
        _, _, anchors, whole = segments(x.symbols, x.bounds, kind.window, kind.gram)
        order = np.lexsort((whole, anchors))
        a, w = anchors[order], whole[order]
        new = np.concatenate((np.ones(min(1, len(a)), bool), a[1:] != a[:-1]))
        differs = new | np.concatenate((np.ones(min(1, len(a)), bool), w[1:] != w[:-1]))
        at = np.flatnonzero(new)
        anchors = a[at]
        counts = np.diff(at, append=len(a)).astype(np.uint32)
        kinds = np.add.reduceat(differs, at).astype(np.uint32) if len(at) else counts
        rows = [(s, key[0], anchors[i].tobytes(), counts[i].tobytes(), kinds[i].tobytes()) for s, i in _by(anchors, shards)]
        return pd.DataFrame(rows, columns=["shard", "b", "anchors", "counts", "kinds"])

    return run


def _repeated(most: int):
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        anchors, counts, kinds = _join(pdf["anchors"], np.uint64), _join(pdf["counts"], np.uint32), _join(pdf["kinds"], np.uint32)
        source = np.repeat(np.arange(len(pdf)), [len(x) // 8 for x in pdf["anchors"]])
        _, inverse = np.unique(anchors, return_inverse=True)
        keep = np.bincount(inverse, weights=counts)[inverse] >= 2
        crowded = (np.bincount(inverse, weights=kinds)[inverse] > most)[keep]
        anchors, source = anchors[keep], source[keep]
        cuts = np.searchsorted(source, np.arange(len(pdf) + 1))
        rows = [(b, anchors[i:j].tobytes(), crowded[i:j].tobytes()) for b, i, j in zip(pdf["b"], cuts, cuts[1:], strict=False) if j > i]
        return pd.DataFrame(rows, columns=["b", "anchors", "crowded"])

    return run


SEGMENT, DIGEST = 1, 2
#: counts: places of each key; ids, ties, labels: of the places, key by key; data: the keys.
_SHIPPED = "shard int, b int, what int, counts binary, ids binary, ties binary, labels binary, lengths binary, data binary"


def _gathered(cuts: np.ndarray, keys: np.ndarray) -> np.ndarray:
    """Places of the values of several keys, key by key; those of key k lie from cuts[k] to cuts[k + 1]."""
    count = cuts[keys + 1] - cuts[keys]
    return np.arange(count.sum()) + np.repeat(cuts[keys] - np.cumsum(count) + count, count)


def _row(x: Batch, shard: int, b: int, what: int, starts: np.ndarray, cuts: np.ndarray, keys: np.ndarray, lengths: np.ndarray, data: bytes) -> tuple:
    """starts: places of all keys of a batch, key by key between ``cuts``; keys: those of this shard."""
    counts = (cuts[keys + 1] - cuts[keys]).astype(np.int32)
    ids, ties, labels = x.place(starts[_gathered(cuts, keys)])
    return shard, b, what, counts.tobytes(), ids.tobytes(), ties.tobytes(), labels.tobytes(), lengths.astype(np.int32).tobytes(), data


def _crowded_windows(symbols: np.ndarray, first: np.ndarray, last: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Window starts of segments, and two hashes of each window. Only the segments' symbols are hashed."""
    new = np.concatenate(([True], first[1:] != last[:-1] + 1))  # neighbours are one stretch
    start, count = first[new], np.append(last[:-1][new[1:]], last[-1]) - first[new] + 1
    size = count + window - 1
    base = np.cumsum(size) - size
    own = symbols[np.arange(size.sum()) + np.repeat(start - base, size)]
    at = np.arange(count.sum()) + np.repeat(base - np.cumsum(count) + count, count)
    return at + np.repeat(start - base, count), rolled(own, window, 11)[at], rolled(own, window, 12)[at]


def _ship(kind: Kind, shards: int):
    window = kind.window

    def run(key: tuple, docs: pd.DataFrame, told: pd.DataFrame) -> pd.DataFrame:
        columns = [c.split()[0] for c in _SHIPPED.split(", ")]
        if not len(docs) or not len(told):
            return pd.DataFrame([], columns=columns)
        b, x = key[0], batch_of(docs, kind)
        first, last, anchors, _ = segments(x.symbols, x.bounds, window, kind.gram)
        known, crowded = _join(told["anchors"], np.uint64), _join(told["crowded"], np.bool_)
        order = np.argsort(known)
        known, crowded = known[order], crowded[order]
        at = np.minimum(np.searchsorted(known, anchors), len(known) - 1)
        repeated = known[at] == anchors
        is_crowded = repeated & crowded[at]
        rows = []

        plain = np.flatnonzero(repeated & ~is_crowded)
        number: dict[bytes, int] = {}
        of = np.array([number.setdefault(kind.piece(x.pieces, s, e + window), len(number)) for s, e in zip(first[plain].tolist(), last[plain].tolist(), strict=True)], np.int64)
        if len(of):
            pieces = list(number)
            order = np.argsort(of, kind="stable")
            starts, cuts = first[plain][order], np.searchsorted(of[order], np.arange(len(pieces) + 1))
            own = anchors[plain[order[cuts[:-1]]]]
            lengths = np.array([len(p) for p in pieces])
            for shard, i in _by(own, shards):
                data = own[i].tobytes() + b"".join([pieces[j] for j in i.tolist()])
                rows.append(_row(x, shard, b, SEGMENT, starts, cuts, i, lengths[i], data))

        if is_crowded.any():
            windows, one, two = _crowded_windows(x.symbols, first[is_crowded], last[is_crowded], window)
            order = np.lexsort((windows, two, one))
            one, two, windows = one[order], two[order], windows[order]
            new = np.concatenate(([True], (one[1:] != one[:-1]) | (two[1:] != two[:-1])))
            cuts = np.append(np.flatnonzero(new), len(new))
            one, two = one[new], two[new]
            for shard, i in _by(one, shards):
                rows.append(_row(x, shard, b, DIGEST, windows, cuts, i, np.zeros(0), one[i].tobytes() + two[i].tobytes()))
        return pd.DataFrame(rows, columns=columns)

    return run


@dataclass
class Places:
    """Occurrences of numbered keys, key by key and in order of documents inside each."""

    b: np.ndarray
    ids: np.ndarray
    labels: np.ndarray
    cuts: np.ndarray
    rank: np.ndarray

    @classmethod
    def of(cls, rows: pd.DataFrame, keys: np.ndarray) -> Places:
        """keys: the number of each key in ``rows``, in their order."""
        counts = _join(rows["counts"], np.int32)
        own = np.repeat(keys, counts)
        ids, ties, labels = (_join(rows[c], np.int64) for c in ("ids", "ties", "labels"))
        b = np.repeat(rows["b"].to_numpy(), [len(x) // 8 for x in rows["ids"]])
        order = np.lexsort((labels, b, ties, ids))
        rank = np.empty(len(order), np.int64)
        rank[order] = np.arange(len(order))
        order = order[np.argsort(own[order], kind="stable")]
        cuts = np.searchsorted(own[order], np.arange(int(keys.max(initial=-1)) + 2))
        return cls(b[order], ids[order], labels[order], cuts, rank[order])

    def all_of(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Places of several keys, and which of the keys each is of."""
        return _gathered(self.cuts, keys), np.repeat(np.arange(len(keys)), self.cuts[keys + 1] - self.cuts[keys])


def _indexed(kind: Kind, rows: pd.DataFrame) -> Iterator[tuple[list[bytes], Places, np.ndarray, Matches]]:
    """Parts of a shard's different segments: all of them, their places, the part's segments, and the index's matches among these."""
    anchors, pieces, number = [], [], {}
    for data, lengths in zip(rows["data"], rows["lengths"], strict=True):
        n = len(lengths) // 4
        anchors.append(np.frombuffer(data, np.uint64, n))
        ends = np.cumsum(np.frombuffer(lengths, np.int32)) + 8 * n
        pieces += [number.setdefault(data[i:j], len(number)) for i, j in zip([8 * n, *ends.tolist()], ends.tolist(), strict=False)]
    keys = np.array(pieces, np.int64)
    places, pieces = Places.of(rows, keys), list(number)
    del number
    own = np.empty(len(pieces), np.uint64)
    own[keys] = np.concatenate(anchors)
    order = np.argsort(own, kind="stable")
    group = np.split(order, np.flatnonzero(np.diff(own[order])) + 1)
    part, size = [], 0
    for k, g in enumerate(group):
        part.append(g)
        size += len(g)
        if size >= kind.indexed or k == len(group) - 1:
            i = np.concatenate(part)
            yield pieces, places, i, kind.index([pieces[j] for j in i.tolist()])
            part, size = [], 0


def _settle(kind: Kind):
    window = kind.window

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        out: list[tuple] = []

        def mark(b: np.ndarray, labels: np.ndarray, lengths: np.ndarray, indexed: bool) -> None:
            order = np.argsort(b, kind="stable")
            for part in np.split(order, np.flatnonzero(np.diff(b[order])) + 1):
                if len(part):
                    out.append((int(b[part[0]]), labels[part].tobytes(), lengths[part].astype(np.int32).tobytes(), indexed))

        rows = pdf[pdf["what"] == DIGEST]
        if len(rows):
            one = np.concatenate([np.frombuffer(x, np.uint64)[: len(x) // 16] for x in rows["data"]])
            two = np.concatenate([np.frombuffer(x, np.uint64)[len(x) // 16 :] for x in rows["data"]])
            order = np.lexsort((two, one))
            new = np.concatenate(([True], (one[order][1:] != one[order][:-1]) | (two[order][1:] != two[order][:-1])))
            keys = np.empty(len(one), np.int64)
            keys[order] = np.cumsum(new) - 1
            places = Places.of(rows, keys)
            old = np.ones(len(places.b), bool)
            old[places.cuts[:-1]] = False
            mark(places.b[old], places.labels[old], np.full(int(old.sum()), window), False)

        rows = pdf[pdf["what"] == SEGMENT]
        for pieces, places, part, (group, which, offset, long) in _indexed(kind, rows) if len(rows) else ():
            # in each segment's first occurrence, how long the longest string from an offset is that also comes earlier
            size = np.array([kind.size(pieces[j]) for j in part.tolist()])
            first = places.rank[places.cuts[part]]
            base = np.cumsum(size) - size
            length = np.zeros(int(size.sum()), np.int64)
            order = np.lexsort((offset, first[which], group))
            old = order[1:][group[order[1:]] == group[order[:-1]]]  # all but each match's earliest place
            np.maximum.at(length, base[which[old]] + offset[old], long[old])
            hit = np.flatnonzero(length)
            which = np.searchsorted(base, hit, side="right") - 1
            place = places.cuts[part[which]]
            # all other occurrences of a segment are repeats from end to end
            others, of = places.all_of(part)
            again = others != places.cuts[part][of]
            place, offset, long = np.concatenate((place, others[again])), np.concatenate((hit - base[which], np.zeros(int(again.sum()), np.int64))), np.concatenate((length[hit], size[of[again]]))
            mark(places.b[place], places.labels[place] + offset, long, True)
        return pd.DataFrame(out, columns=["b", "labels", "lengths", "indexed"])

    return run


def _groups(kind: Kind):
    """Matches with all their occurrences, one row each."""

    def run(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        found, before = [], 0
        rows = pdf[pdf["what"] == SEGMENT]
        for pieces, places, part, (group, which, offset, long) in _indexed(kind, rows) if len(rows) else ():
            several = np.flatnonzero(places.cuts[part + 1] - places.cuts[part] > 1)
            size = np.array([kind.size(pieces[part[k]]) for k in several.tolist()], np.int64)
            group = np.concatenate((np.arange(len(several)), group + len(several)))
            which, offset, long = np.concatenate((several, which)), np.concatenate((np.zeros(len(several), np.int64), offset)), np.concatenate((size, long))
            at, of = places.all_of(part[which])
            found.append((before + group[of], long[of], places.ids[at], (places.labels[at] & ((1 << PLACE) - 1)) + offset[of]))
            before += int(group.max(initial=-1)) + 1
        g, n, ids, start = (np.concatenate(v) for v in zip(*found, strict=True)) if found else [np.zeros(0, np.int64)] * 4
        return pd.DataFrame({"shard": np.full(len(g), key[0]), "match": g, "length": n, "doc_id": ids, "start": start})

    return run


def removed_mask(x: Batch, marks: pd.DataFrame) -> np.ndarray:
    edge = np.zeros(len(x.symbols) + 1, np.int64)
    if len(marks):
        at = x.found(_join(marks["labels"], np.int64))
        np.add.at(edge, at, 1)
        np.add.at(edge, at + _join(marks["lengths"], np.int32), -1)
    return np.cumsum(edge[:-1]) > 0


def spans(mask: np.ndarray) -> list[tuple[int, int]]:
    edge = np.flatnonzero(np.diff(np.concatenate(([0], mask.view(np.int8), [0]))))
    return list(zip(edge[::2].tolist(), edge[1::2].tolist(), strict=True))


@dataclass
class Dealt:
    """Documents by batch, and what the batches ship to the shards."""

    docs: DataFrame
    shipped: DataFrame
    batches: int
    shards: int


def dealt(docs: DataFrame, kind: Kind, crowd: int = CROWD) -> Dealt:
    spark = docs.sparkSession
    prepare(spark)
    docs = docs.select(F.coalesce("doc_id", F.lit(int(NO_ID))).cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    batches, shards = max(LEAST, -(-size // BATCH_BYTES)), max(LEAST, -(-size // SHARD_BYTES))
    # by row: rows that share a doc_id, or have none, are spread like others
    docs = docs.select(F.pmod(F.xxhash64("doc_id", "text"), F.lit(batches)).cast("int").alias("b"), "doc_id", F.xxhash64("text").alias("tie"), "text").repartition(batches, "b")
    told = docs.groupBy("b").applyInPandas(_anchors(kind, shards), "shard int, b int, anchors binary, counts binary, kinds binary")
    told = told.repartition(shards, "shard").groupBy("shard").applyInPandas(_repeated(crowd), "b int, anchors binary, crowded binary")
    shipped = docs.groupBy("b").cogroup(told.repartition(batches, "b").groupBy("b")).applyInPandas(_ship(kind, shards), _SHIPPED)
    return Dealt(docs, shipped.repartition(shards, "shard"), batches, shards)


def matches(docs: DataFrame, kind: Kind, crowd: int = CROWD) -> DataFrame:
    """shard, match, length, doc_id, start: all occurrences of each match of the shards' indexes, a row each, in symbols."""
    found = dealt(docs, kind, crowd).shipped.groupBy("shard").applyInPandas(_groups(kind), "shard int, match long, length long, doc_id long, start long")
    return found.withColumn("doc_id", F.when(F.col("doc_id") != int(NO_ID), F.col("doc_id")))


def marked(d: Dealt, kind: Kind) -> DataFrame:
    """b, labels, lengths, indexed: what is to go, by batch; indexed: told by an index, not by digests."""
    return d.shipped.groupBy("shard").applyInPandas(_settle(kind), "b int, labels binary, lengths binary, indexed boolean")


def without_repeats(docs: DataFrame, kind: Kind, kept: Callable[[Batch, int, np.ndarray], bytes], crowd: int = CROWD) -> DataFrame:
    """doc_id, n (symbols), kept (binary: what stays), spans (start and end of each removed run, in symbols), indexed (removed symbols that an index told)."""
    d = dealt(docs, kind, crowd)
    marks = marked(d, kind).repartition(d.batches, "b")

    def finish(key: tuple, docs: pd.DataFrame, marks: pd.DataFrame) -> pd.DataFrame:
        rows = []
        if len(docs):
            x = batch_of(docs, kind)
            mask = removed_mask(x, marks)
            told = mask if marks["indexed"].all() else removed_mask(x, marks[marks["indexed"]])
            for k, (i, j) in enumerate(zip(x.bounds.tolist(), x.bounds[1:].tolist(), strict=False)):
                own = mask[i:j]
                rows.append((int(x.ids[k]), j - i, kept(x, k, own), [{"start": s, "end": e} for s, e in spans(own)], int(told[i:j].sum())))
        return pd.DataFrame(rows, columns=["doc_id", "n", "kept", "spans", "indexed"])

    out = d.docs.groupBy("b").cogroup(marks.groupBy("b")).applyInPandas(finish, "doc_id long, n long, kept binary, spans array<struct<start: long, end: long>>, indexed long")
    return out.withColumn("doc_id", F.when(F.col("doc_id") != int(NO_ID), F.col("doc_id")))
