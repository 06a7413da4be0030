"""Repeated word windows by compressed FM-indexes.

The shards of :mod:`repeats` hold segments of words that share an anchor, each different one once, with all its occurrences.
A shard's segments become one text over a local alphabet; its Burrows-Wheeler transform, as a Huffman-shaped wavelet matrix of
about its entropy, is the index. The segments are streamed against it, all in step: one backward-search step prepends a
word to every match that is still alive, equal matches are searched once, and a match of a single occurrence (itself) ends. So
each word's matching statistic is known: how long the longest match is that ends there. Matches from the threshold on are
reported with their interval of the suffix array, and so with all their occurrences.
"""

from __future__ import annotations

import numpy as np
import xxhash
from pyspark.sql import DataFrame

from .repeats import CROWD, Batch, Kind, Matches, matches, without_repeats
from .wavelet import HuffmanWavelet

#: Words in the windows that may not repeat, and in the hashed strings that deal them out.
WORDS, GRAM = 20, 4


class FMIndex:
    """Over sequences of positive integers, each of which ends with a 0; a match never runs from one into the next. Suffixes are
    told apart by ``depth`` symbols at least, so matches up to that length are exact."""

    def __init__(self, text: np.ndarray, depth: int):
        n, rank, size = len(text), text.astype(np.int64), 1
        while size < depth:
            ahead = np.zeros(n, np.int64)
            ahead[: max(0, n - size)] = rank[size:] + 1
            rank = np.unique(rank * (int(rank.max(initial=0)) + 2 + int(ahead.max(initial=0))) + ahead, return_inverse=True)[1]
            size *= 2
        self.sa = np.argsort(rank, kind="stable")
        self.n, self.bwt = n, HuffmanWavelet(text[self.sa - 1])
        self.first = np.concatenate(([0], np.cumsum(np.bincount(text))))

    def step(self, symbol: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Intervals of the suffixes that start with symbol and go on as those in [lo, hi)."""
        a, b = self.bwt.rank(symbol, lo, hi)
        return self.first[symbol] + a, self.first[symbol] + b

    def statistics(self, text: np.ndarray, ends: np.ndarray, room: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Of each place in ``ends``: the length of the longest string that ends there and occurs twice or more in the index, in at most ``room``
        symbols; and the interval of the last ``least`` symbols (empty if the length is less)."""
        lo, hi, length = (np.zeros(len(ends), np.int64) for _ in range(3))
        alive = np.arange(len(ends))
        a, b = np.zeros(len(ends), np.int64), np.full(len(ends), self.n)
        k = 0
        while len(alive):
            symbol = text[ends[alive] - k]
            _, one, back = np.unique((a * (self.n + 1) + b) * len(self.first) + symbol, return_index=True, return_inverse=True)
            a, b = (v[back] for v in self.step(symbol[one], a[one], b[one]))
            k += 1
            more = b - a > 1
            length[alive[more]] = k
            if k == least:
                lo[alive[more]], hi[alive[more]] = a[more], b[more]
            more &= room[alive] > k
            alive, a, b = alive[more], a[more], b[more]
        return length, lo, hi


def _coded(pieces: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Words of all pieces as numbers, each piece ended by a 0, which no window holds; where pieces begin, their sizes."""
    words = [p.split(b" ") for p in pieces]
    number: dict[bytes, int] = {}
    coded = [[number.setdefault(w, len(number) + 1) for w in ws] for ws in words]
    size = np.array([len(ws) for ws in coded])
    text = np.zeros(size.sum() + len(size), np.int64)
    base = np.cumsum(size + 1) - size - 1
    text[np.arange(size.sum()) + np.repeat(np.arange(len(size)), size)] = np.concatenate([np.array(c) for c in coded])
    return text, base, size


def intervals(pieces: list[bytes], window: int = WORDS) -> Matches:
    """The strings of ``window`` words that occur twice or more among different pieces, with all their places."""
    text, base, size = _coded(pieces)
    index = FMIndex(text, int(size.max()))
    count = size - window + 1
    piece = np.repeat(np.arange(len(size)), count)
    offset = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
    length, lo, hi = index.statistics(text, base[piece] + offset + window - 1, offset + window, window)
    start, one = np.unique(lo[length >= window], return_index=True)
    count = hi[length >= window][one] - start
    group = np.repeat(np.arange(len(start)), count)
    at = index.sa[np.arange(len(group)) - (np.cumsum(count) - count)[group] + start[group]]  # the suffix array tells all occurrences of an interval
    which = np.searchsorted(base, at, side="right") - 1
    return group, which, at - base[which], np.full(len(at), window)


def matching_statistics(pieces: list[bytes], window: int = WORDS) -> list[np.ndarray]:
    """Of each word of each piece: the length of the longest match that ends there and occurs elsewhere among the pieces."""
    text, base, size = _coded(pieces)
    index = FMIndex(text, int(size.max()))
    piece = np.repeat(np.arange(len(size)), size)
    offset = np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size)
    return np.split(index.statistics(text, base[piece] + offset, offset + 1, window)[0], np.cumsum(size)[:-1])


def _read(texts: list[str]) -> tuple[np.ndarray, list[bytes], np.ndarray]:
    split = [t.encode().split() for t in texts]  # bytes are split at exactly \x20 and \x09-\x0D
    words = [w for ws in split for w in ws]
    return np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words)), words, np.array([len(ws) for ws in split], np.int64)


def _kept(x: Batch, k: int, mask: np.ndarray) -> bytes:
    words = x.pieces[x.bounds[k] : x.bounds[k + 1]]
    return b" ".join(w for w, gone in zip(words, mask.tolist(), strict=True) if not gone) if mask.any() else b" ".join(words)


def word_kind(words: int = WORDS, gram: int = GRAM) -> Kind:
    return Kind(words, gram, _read, lambda ws, i, j: b" ".join(ws[i:j]), lambda p: p.count(b" ") + 1, lambda pieces: intervals(pieces, words), 8000)


def repeated_passages(docs: DataFrame, words: int = WORDS, gram: int = GRAM) -> DataFrame:
    """shard, match, length, doc_id, start: every occurrence (in words) of each reported interval, a row each: strings of ``words`` words, and
    whole segments that come again. Anchors with more than ``CROWD`` different segments give none (their repeats are removed all the
    same). Edge cases as in :mod:`repeats`."""
    return matches(docs, word_kind(words, gram))


def remove_passages(docs: DataFrame, words: int = WORDS, gram: int = GRAM, crowd: int = CROWD) -> DataFrame:
    """Remove each word covered by a window of ``words`` words that also starts earlier; windows are judged on the input.

    Returns doc_id, n (words), kept (UTF-8, the remaining words joined by one space), spans (start and end of each
    removed run, in words), indexed (words whose removal the FM-indexes told). Edge cases as in :mod:`repeats`."""
    return without_repeats(docs, word_kind(words, gram), _kept, crowd)
