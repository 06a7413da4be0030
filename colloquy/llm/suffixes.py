"""Substring removal by suffix arrays and their common-prefix interval trees.

The shards of :mod:`repeats` hold segments whose 100-byte windows share an anchor, each different one once, with all its
occurrences. Their window starts are sorted into a suffix array (each suffix ends with its segment), the common prefixes of
neighbours make it an enhanced one, and one scan with a stack walks the tree of common-prefix intervals. An interval whose
members have different bytes before them can't be extended to the left: with its depth it is a maximal repeat group, and a
segment with several occurrences is one from end to end. :func:`repeat_groups` returns the groups with all occurrences;
what :func:`remove_substrings` removes follows from them.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame

from .repeats import CROWD, Batch, Kind, Matches, matches, without_repeats

#: Length in bytes of the strings that may not repeat, and of the hashed strings that deal them out.
LENGTH, GRAM = 100, 24


def suffix_array(pieces: list[bytes], window: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Order of the suffixes with at least ``window`` bytes, their pieces, offsets, common prefixes and left bytes."""
    size = np.array([len(p) for p in pieces])
    count, base = size - window + 1, np.cumsum(size) - size
    piece = np.repeat(np.arange(len(pieces)), count)
    offset = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
    width = int(size.max())
    text = np.frombuffer(b"".join(pieces) + bytes(width), np.uint8)
    at, left_over = base[piece] + offset, size[piece] - offset
    rows = np.lib.stride_tricks.sliding_window_view(text, width)[at]
    rows[np.arange(width)[None, :] >= left_over[:, None]] = 0
    order = np.argsort(rows.view(f"S{width}").ravel(), kind="stable")
    rows, left_over = rows[order], left_over[order]
    differs = rows[1:] != rows[:-1]
    common = np.where(differs.any(1), differs.argmax(1), width)
    lcp = np.concatenate(([0], np.minimum(common, np.minimum(left_over[1:], left_over[:-1]))))
    # a piece's first window has an unknown byte before it, unlike any other
    left = np.where(offset > 0, text[np.maximum(at - 1, 0)].astype(np.int64), -1 - np.arange(len(at)))
    return order, piece[order], offset[order], lcp, left[order]


def maximal_repeats(lcp: np.ndarray, left: np.ndarray, least: int) -> Iterator[tuple[int, int, int]]:
    """Intervals (first, last, depth) of the tree with depth >= least whose members have different left symbols."""
    change = np.concatenate(([0], np.cumsum(left[1:] != left[:-1]))).tolist()
    stack: list[tuple[int, int]] = []
    active = np.flatnonzero(np.maximum(lcp, np.append(lcp[1:], 0)) >= least).tolist()
    values = lcp.tolist()
    last = -2
    for i in [*active, len(values) + 1]:
        depth = values[i] if i == last + 1 and i < len(values) else 0
        first, end = i - 1, last
        while stack and stack[-1][0] > depth:
            d, first = stack.pop()
            if change[end] > change[first]:
                yield first, end, d
        if depth >= least and (not stack or stack[-1][0] < depth):
            stack.append((depth, first))
        last = i


def groups(pieces: list[bytes], window: int = LENGTH) -> Matches:
    """The maximal repeats of at least ``window`` bytes among different pieces, with all their places."""
    _, piece, offset, lcp, left = suffix_array(pieces, window)
    found = np.array(list(maximal_repeats(lcp, left, window)), np.int64).reshape(-1, 3)
    count = found[:, 1] - found[:, 0] + 1
    group = np.repeat(np.arange(len(found)), count)
    at = np.arange(len(group)) - (np.cumsum(count) - count)[group] + found[group, 0]
    return group, piece[at], offset[at], found[group, 2]


def _read(texts: list[str]) -> tuple[np.ndarray, bytes, np.ndarray]:
    encoded = [t.encode() for t in texts]
    data = b"".join(encoded)
    return np.frombuffer(data, np.uint8).astype(np.uint64), data, np.array([len(x) for x in encoded], np.int64)


def _kept(x: Batch, k: int, mask: np.ndarray) -> bytes:
    data = x.pieces[x.bounds[k] : x.bounds[k + 1]]
    return np.frombuffer(data, np.uint8)[~mask].tobytes() if mask.any() else data


def byte_kind(length: int = LENGTH, gram: int = GRAM) -> Kind:
    return Kind(length, gram, _read, lambda data, i, j: data[i:j], len, lambda pieces: groups(pieces, length), 1500)


def repeat_groups(docs: DataFrame, length: int = LENGTH, gram: int = GRAM) -> DataFrame:
    """shard, match, length, doc_id, start: every occurrence (in bytes) of each maximal repeat of at least ``length`` bytes, a row each.

    A repeat is maximal inside a segment; a longer one comes as groups that overlap. Anchors with more than ``CROWD`` different
    segments give no groups (their repeats are removed all the same). Edge cases as in :mod:`repeats`."""
    return matches(docs, byte_kind(length, gram))


def remove_substrings(docs: DataFrame, length: int = LENGTH, gram: int = GRAM, crowd: int = CROWD) -> DataFrame:
    """Remove each byte covered by a ``length``-byte string that also starts earlier; strings are judged on the input.

    Returns doc_id, n (bytes), kept (the remaining bytes), spans (start and end of each maximal removed run), indexed (bytes whose
    removal the suffix arrays told). Edge cases as in :mod:`repeats`."""
    return without_repeats(docs, byte_kind(length, gram), _kept, crowd)
