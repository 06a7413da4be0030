"""Wavelet matrices: sequences of integers as bit-planes with rank and select."""

from __future__ import annotations

import struct

import numpy as np
import zstandard

#: Bits in a block of the rank directory; ones (or zeros) between entries of the select directory.
BLOCK, SAMPLE = 512, 1024


class Plane:
    """Bits with directories: the ones before each block (rank), and the block of every ``SAMPLE``-th one and zero (select)."""

    def __init__(self, packed: np.ndarray, n: int, block: int = BLOCK, ranks: np.ndarray | None = None, samples: tuple[np.ndarray, np.ndarray] | None = None):
        self.packed, self.n, self.block, self._samples = packed, n, block, samples
        raw = packed.tobytes()
        self.words = np.frombuffer(raw + bytes(-len(raw) % (block // 8) + block // 8), np.uint64)
        if ranks is None:
            counts = np.bitwise_count(self.words).reshape(-1, block // 64).sum(1, dtype=np.int64)
            ranks = np.concatenate(([0], np.cumsum(counts))).astype(np.uint32 if n < 1 << 32 else np.uint64)
        self.ranks = ranks
        self.ones = int(ranks[-1])

    @property
    def samples(self) -> tuple[np.ndarray, np.ndarray]:
        if self._samples is None:
            before = np.arange(len(self.ranks), dtype=np.int64) * self.block - self.ranks  # zeros, those after the end too
            self._samples = tuple((np.searchsorted(x, np.arange(0, most, SAMPLE), side="right") - 1).astype(np.uint32) for x, most in ((before, self.n - self.ones), (self.ranks, self.ones)))
        return self._samples

    def rank(self, at: np.ndarray) -> np.ndarray:
        """Ones before position ``at``."""
        block, word, rest = at // self.block, at >> 6, (at & 63).astype(np.uint64)
        out = self.ranks[block].astype(np.int64) + np.bitwise_count(self.words[word] & ((np.uint64(1) << rest) - np.uint64(1)))
        first = block * (self.block // 64)
        for k in range(self.block // 64 - 1):
            out += np.where(first + k < word, np.bitwise_count(self.words[first + k]), 0)
        return out

    def select(self, bit: int, k: np.ndarray) -> np.ndarray:
        """Position of the k-th such bit, from 0; k in range."""
        sample = self.samples[bit].astype(np.int64)
        lo, hi = sample[k // SAMPLE], np.append(sample, len(self.ranks) - 2)[k // SAMPLE + 1]
        while (lo < hi).any():  # the last block with at most k such bits before it
            mid = (lo + hi + 1) // 2
            ones = self.ranks[mid].astype(np.int64)
            fits = (ones if bit else mid * self.block - ones) <= k
            lo, hi = np.where(fits, mid, lo), np.where(fits, hi, np.maximum(mid - 1, lo))
        ones = self.ranks[lo].astype(np.int64)
        left = k - (ones if bit else lo * self.block - ones)
        word = lo * (self.block // 64)
        for _ in range(self.block // 64 - 1):
            own = np.bitwise_count(self.words[word]).astype(np.int64)
            own = own if bit else 64 - own
            on = left >= own
            # once a word holds it, those after it do not count
            left, word = np.where(on, left - own, left), np.where(on, word + 1, word)
        bits = np.unpackbits(self.words[word].astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little") == bit
        return word * 64 + ((np.cumsum(bits, axis=1) == left[:, None] + 1) & bits).argmax(1)

    def to_bytes(self, packer: zstandard.ZstdCompressor) -> bytes:
        """Bits, compressed where that makes them smaller, and the directories."""
        raw = self.packed.tobytes()
        small = packer.compress(raw)
        kept = small if len(small) < len(raw) else raw
        tables = [self.ranks.astype("<u8").tobytes() if self.n >= 1 << 32 else self.ranks.astype("<u4").tobytes(), *[s.astype("<u4").tobytes() for s in self.samples]]
        packed = packer.compress(b"".join(tables))
        return struct.pack("<BIIII", kept is small, len(kept), len(packed), len(self.samples[0]), len(self.samples[1])) + kept + packed

    @classmethod
    def from_bytes(cls, data: memoryview, at: int, n: int, unpacker: zstandard.ZstdDecompressor) -> tuple[Plane, int]:
        small, size, tables, zeros, ones = struct.unpack_from("<BIIII", data, at)
        at += struct.calcsize("<BIIII")
        raw = bytes(data[at : at + size])
        packed = np.frombuffer(unpacker.decompress(raw) if small else raw, np.uint8)
        told = unpacker.decompress(bytes(data[at + size : at + size + tables]))
        cut = len(told) - 4 * (zeros + ones)
        samples = np.frombuffer(told[cut:], "<u4")
        return cls(packed, n, BLOCK, np.frombuffer(told[:cut], "<u4" if n < 1 << 32 else "<u8"), (samples[:zeros], samples[zeros:])), at + size + tables


class WaveletMatrix:
    """Planes go from the highest bit down; each is the current order's bit, and sends zeros before ones for the next.

    Positions may be arrays; rank and access take O(bits) steps whatever the length, select a short search more in each."""

    def __init__(self, planes: list[Plane], n: int):
        self.n, self.planes = n, planes
        self.zeros = [n - p.ones for p in planes]

    @classmethod
    def of(cls, values: np.ndarray, bits: int | None = None) -> WaveletMatrix:
        n = len(values)
        bits = max(1, int(values.max()).bit_length() if n else 1) if bits is None else bits
        planes, x = [], values
        for level in range(bits - 1, -1, -1):
            bit = x & x.dtype.type(1 << level) != 0
            planes.append(Plane(np.packbits(bit, bitorder="little"), n))
            if level:
                x = np.concatenate((x.compress(~bit), x.compress(bit)))
        return cls(planes, n)

    def values(self, kind: type = np.uint16) -> np.ndarray:
        """The whole sequence, by undoing the planes from the lowest up."""
        x = np.zeros(self.n, kind)
        for level, plane in enumerate(reversed(self.planes)):
            bit = np.unpackbits(plane.packed, count=self.n, bitorder="little").view(bool)
            zeros = self.zeros[len(self.planes) - 1 - level]
            y = np.empty_like(x)
            y[np.flatnonzero(~bit)] = x[:zeros]
            y[np.flatnonzero(bit)] = x[zeros:] | kind(1 << level)
            x = y
        return x

    def access(self, at) -> np.ndarray:
        at, out = np.asarray(at, np.int64), np.zeros(np.shape(at), np.int64)
        for plane, zeros in zip(self.planes, self.zeros, strict=True):
            ones = plane.rank(at)
            bit = plane.rank(at + 1) - ones
            out = out * 2 + bit
            at = np.where(bit, zeros + ones, at - ones)
        return out

    def _range(self, value, at) -> tuple[np.ndarray, np.ndarray]:
        """Where the copies of value before position ``at`` lie in the last order."""
        value, hi = np.asarray(value, np.int64), np.asarray(at, np.int64)
        lo, bits = np.zeros_like(hi), len(self.planes)
        for level, (plane, zeros) in enumerate(zip(self.planes, self.zeros, strict=True)):
            bit = (value >> (bits - 1 - level)) & 1
            a, b = plane.rank(lo), plane.rank(hi)
            lo, hi = np.where(bit, zeros + a, lo - a), np.where(bit, zeros + b, hi - b)
        return lo, hi

    def rank(self, value, at) -> np.ndarray:
        """How often value occurs before position ``at``."""
        lo, hi = self._range(value, at)
        return np.where(np.asarray(value) >> len(self.planes), 0, hi - lo)

    def count(self, value: int) -> int:
        return int(self.rank(value, self.n))

    def select(self, value: int, k) -> np.ndarray:
        """Positions of the k-th occurrences, from 0; k: a number or several."""
        k = np.asarray(k, np.int64)
        if k.size and not (0 <= int(k.min()) and int(k.max()) < self.count(value)):
            raise IndexError(k)
        at, bits = np.atleast_1d(self._range(value, 0)[0] + k), len(self.planes)
        for level in range(bits - 1, -1, -1):
            one = value >> (bits - 1 - level) & 1
            at = self.planes[level].select(one, at - self.zeros[level] if one else at)
        return at.reshape(k.shape)

    def occurrences(self, value: int) -> np.ndarray:
        """All positions of value, in order."""
        return self.select(value, np.arange(self.count(value)))

    def to_bytes(self) -> bytes:
        packer = zstandard.ZstdCompressor(level=1)
        return struct.pack("<4sQB", b"WVM2", self.n, len(self.planes)) + b"".join(p.to_bytes(packer) for p in self.planes)

    @classmethod
    def from_bytes(cls, data: bytes) -> WaveletMatrix:
        magic, n, bits = struct.unpack_from("<4sQB", data)
        if magic != b"WVM2":
            raise ValueError("not a wavelet matrix")
        at, planes, unpacker = 13, [], zstandard.ZstdDecompressor()
        for _ in range(bits):
            plane, at = Plane.from_bytes(memoryview(data), at, n, unpacker)
            planes.append(plane)
        return cls(planes, n)


def code_lengths(counts: np.ndarray) -> np.ndarray:
    """Bits of each symbol in a Huffman code; 0 for symbols that do not occur."""
    out = np.zeros(len(counts), np.int64)
    found = np.flatnonzero(counts)
    if len(found) == 1:
        out[found] = 1
        return out
    found = found[np.argsort(counts[found], kind="stable")]
    # leaves and inner nodes both come by rising weight: the two lightest are at the heads of two queues
    weight, leaves = counts[found].tolist(), len(found)
    parent, nodes, leaf, inner = [0] * (2 * leaves - 1), leaves, 0, leaves
    while nodes < 2 * leaves - 1:
        sum_ = 0
        for _ in (0, 1):
            if leaf < leaves and (inner >= nodes or weight[leaf] <= weight[inner]):
                parent[leaf], sum_, leaf = nodes, sum_ + weight[leaf], leaf + 1
            else:
                parent[inner], sum_, inner = nodes, sum_ + weight[inner], inner + 1
        weight.append(sum_)
        nodes += 1
    depth = [0] * nodes
    for i in range(nodes - 2, -1, -1):
        depth[i] = depth[parent[i]] + 1
    out[found] = depth[:leaves]
    return out


class HuffmanWavelet:
    """A wavelet matrix whose symbols have Huffman codes, so that it takes about the sequence's entropy: a symbol is in as many planes as its
    code has bits. Codes are dealt so that in each plane the symbols that end there come last and drop out. Rank only."""

    def __init__(self, text: np.ndarray):
        counts = np.bincount(text)
        self.lengths = code_lengths(counts)
        self.codes = np.zeros(len(counts), np.int64)
        nodes, by = [0], np.argsort(self.lengths, kind="stable")
        deep = int(self.lengths.max(initial=0))
        for level in range(1, deep + 1):
            nodes = [2 * c for c in nodes] + [2 * c + 1 for c in nodes]
            ends = by[self.lengths[by] == level]
            keep = len(nodes) - len(ends)
            if len(ends) and deep > 1 or len(counts) and level == deep:
                self.codes[ends] = nodes[keep : keep + len(ends)] if len(np.flatnonzero(counts)) > 1 else [0] * len(ends)
            nodes = nodes[:keep]
        self.planes: list[Plane] = []
        self.zeros: list[int] = []
        x, size = self.codes[text], self.lengths[text]
        for level in range(1, deep + 1):
            bit = (x >> (size - level)) & 1 != 0
            plane = Plane(np.packbits(bit, bitorder="little"), len(x), 64)
            self.planes.append(plane)
            self.zeros.append(len(x) - plane.ones)
            goes = size > level
            first, then = ~bit & goes, bit & goes
            x, size = np.concatenate((x[first], x[then])), np.concatenate((size[first], size[then]))

        # where each symbol's copies begin in its last plane
        self.begins = np.zeros(len(counts), np.int64)
        self.begins = self._down(np.arange(len(counts)), [np.zeros(len(counts), np.int64)])[0]

    @property
    def bits(self) -> int:
        return sum(p.n for p in self.planes)

    def _down(self, symbol: np.ndarray, at: list[np.ndarray]) -> list[np.ndarray]:
        """Where each symbol's copies before each position end in its last plane."""
        code, length, out = self.codes[symbol], self.lengths[symbol], [np.zeros(len(symbol), np.int64) for _ in at]
        left = np.flatnonzero(length)
        code, length, k = code[left], length[left], len(at)
        x = np.stack([a[left] for a in at]) if k else np.zeros((0, len(left)), np.int64)
        for level, (plane, zeros) in enumerate(zip(self.planes, self.zeros, strict=True), 1):
            if not len(left):
                break
            ranks = plane.rank(x.ravel()).reshape(x.shape)
            x = np.where((code >> (length - level)) & 1 != 0, zeros + ranks, x - ranks)
            ends = length == level
            if ends.any():
                for o, v in zip(out, x, strict=True):
                    o[left[ends]] = v[ends]
                go = ~ends
                left, code, length, x = left[go], code[go], length[go], x[:, go]
        return out

    def rank(self, symbol: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """How often each symbol occurs before position lo, and before hi."""
        a, b = self._down(symbol, [lo, hi])
        return a - self.begins[symbol], b - self.begins[symbol]
