"""Byte-level BPE by a finite-state transducer, and streaming decoding.

A sequence of tokens is the encoding of its bytes exactly if each token encodes to itself and each pair of neighbours encodes to
itself. So every prefix of a word has one encoding: that of a shorter prefix and one last token that may follow. The transducer
reads bytes; its state is the last token that is settled and the bytes since. A place among these is *live* while some
token could still start there and reach beyond the last byte; what all live places' encodings share is settled and
leaves the state. No place is live for longer than the longest token, which bounds the lookahead. States and steps
are made when they have been asked for again and again. What is left of a word at a step not made yet, from the last settled place on, is simulated:
for many words in step, each live place a path in the trie of tokens.
"""

from __future__ import annotations

import base64
from array import array
from collections.abc import Callable, Iterator
from functools import cached_property
from itertools import islice

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import give_back, prepare
from .pieces import Coded, Pieces

#: Steps, judged pairs, words and pieces that a worker keeps at most. Beyond, the steps (or pairs, or words) are forgotten and made anew as they come.
STEPS, PAIRS, WORDS, PIECES = 200_000, 300_000, 80_000, 250_000
#: Times a step is asked for before it is made; bytes simulated in one go, and the longest rest among them and the fewest for which going in step pays.
AGAIN, BLOCK, LONGEST, FEWEST = 6, 1 << 20, 256, 32


class Sides:
    """Which tokens may stand side by side, many pairs at once. Verdicts are remembered in a table of fixed size."""

    #: A merge that never comes.
    NEVER = np.int64(1) << 40

    def __init__(self, ranks: dict[bytes, int], merge: Callable[[bytes], tuple[list[int], tuple[int, int]]], slots: int):
        self.n, self.merge, self.bytes = max(ranks.values()) + 1, merge, {v: k for k, v in ranks.items()}
        self.left, self.right = np.zeros(self.n, np.int64), np.zeros(self.n, np.int64)
        self.made = np.full(self.n, -1, np.int64)  # when: the token's rank, -1 for bytes
        self.whole = np.zeros(self.n, bool)  # the token's bytes encode to itself
        keys, to = [], []
        for token, rank in ranks.items():
            ids, last = merge(token)
            self.whole[rank] = ids == [rank]
            if len(token) > 1:
                self.left[rank], self.right[rank] = last
                self.made[rank] = rank
            for i in range(1, len(token)):
                x, y = ranks.get(token[:i]), ranks.get(token[i:])
                if x is not None and y is not None:
                    keys.append(x * self.n + y)
                    to.append(rank)
        order = np.argsort(np.array(keys, np.int64))
        self.keys, self.to = np.array(keys, np.int64)[order], np.array(to, np.int64)[order]
        # if every token is made after its parts, merges come by rank on both sides of a border
        t = np.flatnonzero(self.whole & (self.made >= 0))
        self.by_rank = bool((self.made[self.left[t]] < t).all() and (self.made[self.right[t]] < t).all())
        self.known, self.verdict = np.full(1 << slots, -1, np.int64), np.zeros(1 << slots, bool)

    def _merged(self, x: np.ndarray, y: np.ndarray) -> np.ndarray:
        """The token that x and y make."""
        if not len(self.keys):
            return np.full(len(x), self.NEVER)
        key = x * self.n + y
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where(self.keys[at] == key, self.to[at], self.NEVER)

    def judged(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Whether nothing merges across the border of two whole tokens. x and y are what lies at the border; going back in time, the later made
        comes apart. They merge if that comes before what swallows x or y; of equal merges the left one is first."""
        if not self.by_rank:
            return np.array([self.merge(self.bytes[x] + self.bytes[y])[0] == [x, y] for x, y in zip(a.tolist(), b.tolist(), strict=True)], bool)
        fit = np.ones(len(a), bool)
        open_, x, y = np.arange(len(a)), a, b
        over_x = over_y = np.full(len(a), self.NEVER - 1)
        while len(open_):
            m = self._merged(x, y)
            crossed = (m < over_x) & (m <= over_y)
            fit[open_[crossed]] = False
            go = ~crossed & (np.maximum(self.made[x], self.made[y]) >= 0)
            open_, x, y, over_x, over_y = open_[go], x[go], y[go], over_x[go], over_y[go]
            later = self.made[x] > self.made[y]
            over_x, over_y = np.where(later, x, over_x), np.where(later, over_y, y)
            x, y = np.where(later, self.right[x], x), np.where(later, y, self.left[y])
        return fit

    def fit(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Whether b may stand after a (-1: the start of a word), for whole tokens."""
        key = a * self.n + b
        slot = (key * np.int64(0x9E3779B1) >> 13) & (len(self.known) - 1)
        found = self.verdict[slot] | (a < 0)
        new = np.flatnonzero((self.known[slot] != key) & (a >= 0))
        if len(new):
            found[new] = self.judged(a[new], b[new])
            self.known[slot[new]], self.verdict[slot[new]] = key[new], found[new]
        return found


class InStep:
    """Simulates the rests of many words together, byte by byte: a live place is a path from the trie's root, and where a path has come to a token that
    may stand there, a place begins."""

    def __init__(self, ranks: dict[bytes, int], sides: Sides):
        self.sides = sides
        nodes = {b"": 0}
        for token, rank in ranks.items():
            if sides.whole[rank]:
                for i in range(1, len(token) + 1):
                    nodes.setdefault(token[:i], len(nodes))
        step = sorted((nodes[s[:-1]] << 8 | s[-1], node) for s, node in nodes.items() if node)
        self.keys, self.to = np.array([k for k, _ in step], np.int32), np.array([q for _, q in step], np.int32)
        self.first = np.full(256, -1, np.int32)
        self.first[self.keys[self.keys < 256]] = self.to[self.keys < 256]
        self.token = np.array([rank if (rank := ranks.get(s)) is not None and sides.whole[rank] else -1 for s in nodes], np.int32)
        self.inner = np.zeros(len(nodes), bool)
        self.inner[self.keys >> 8] = True

    def run(self, context: np.ndarray, rests: list[bytes]) -> Coded:
        """Ids of rests that each begin after a settled token (-1: none), end to end, and how many each has."""
        ids, counts, i = [np.zeros(0, np.uint32)], [np.zeros(0, np.int64)], 0
        while i < len(rests):
            j, bulk = i, 0
            while j < len(rests) and (j == i or bulk + len(rests[j]) <= BLOCK):
                bulk += len(rests[j])
                j += 1
            for into, x in zip((ids, counts), self._block(context[i:j], rests[i:j]), strict=True):
                into.append(x)
            i = j
        return np.concatenate(ids), np.concatenate(counts)

    def _block(self, context: np.ndarray, rests: list[bytes]) -> Coded:
        data = np.frombuffer(b"".join(rests), np.uint8)
        length = np.array([len(r) for r in rests], np.int64)
        begins = np.cumsum(length + 1) - length - 1  # the place before each rest holds the settled token
        last = np.full(len(data) + len(rests), -1, np.int64)
        last[begins] = context
        order = np.argsort(-length, kind="stable")
        size, begin = length[order], begins[order]
        first = begin - order  # of its bytes
        beyond = np.searchsorted(-size, -np.arange(1, int(size[0]) + 1), side="right")  # rests longer than each place
        word, place, node = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int32)
        new, top = np.arange(len(rests)), len(self.keys) - 1
        for j, k in enumerate(beyond.tolist()):
            byte = data[first[:k] + j]
            on = word < k
            word, place, node = word[on], place[on], node[on]
            key = node << 8 | byte[word]
            at = np.searchsorted(self.keys, key)
            np.minimum(at, top, out=at)
            on = self.keys[at] == key
            new = new[new < k]
            word, place = np.concatenate((word[on], new)), np.concatenate((place[on], begin[new] + j))
            node = np.concatenate((self.to[at[on]], self.first[byte[new]]))
            token = self.token[node]
            ends = np.flatnonzero(token >= 0)
            ends = ends[self.sides.fit(last[place[ends]], token[ends].astype(np.int64))]
            new = word[ends]
            last[begin[new] + j + 1] = token[ends]
            on = self.inner[node]
            word, place, node = word[on], place[on], node[on]
        part = np.zeros(len(last), bool)
        at, begin = (begins + length)[length > 0], begins[length > 0]
        while len(at):  # back from each end
            part[at] = True
            at = at - self.lengths[last[at]]
            on = at > begin
            at, begin = at[on], begin[on]
        up = np.concatenate(([0], np.cumsum(part)))
        return last[part].astype(np.uint32), up[begins + length + 1] - up[begins]

    @cached_property
    def lengths(self) -> np.ndarray:
        """Bytes of each token."""
        out = np.zeros(self.sides.n, np.int64)
        for rank, token in self.sides.bytes.items():
            out[rank] = len(token)
        return out


class Transducer:
    """States are numbers. Of each: the settled token before it (-1: none), the bytes since, where the last token up to each of these
    ends starts and which it is (None: its encoding goes round the settled place, so it is never live), and the live places."""

    def __init__(self, ranks: dict[bytes, int], share: float = 1.0):
        self.most_steps, self.most_pairs = int(STEPS * share), int(PAIRS * share)
        self.ranks, self.bytes = ranks, {v: k for k, v in ranks.items()}
        self.starts = {t[:i] for t in ranks for i in range(1, len(t))}
        self.pairs: dict[int, bool] = {}
        self.steps: dict[int, tuple[int, tuple[int, ...]]] = {}
        self.asked: dict[int, int] = {}
        self._empty()
        self.in_step = InStep(ranks, Sides(ranks, self.merging, self.most_pairs.bit_length()))

    def _empty(self) -> None:
        """The machine with its first state only."""
        self.steps.clear()
        self.asked.clear()
        self.numbers: dict[tuple[int, bytes], int] = {(-1, b""): 0}
        self.states: list[tuple[bytes, list[tuple[int, int] | None], list[int]]] = [(b"", [(-1, -1)], [0])]

    def merging(self, data: bytes) -> tuple[list[int], tuple[int, int]]:
        """Merge the pair of lowest rank, leftmost first, until none is left; for strings of two tokens. Also the two parts that were merged last."""
        ranks, parts = self.ranks, [data[i : i + 1] for i in range(len(data))]
        last = b"", b""
        while len(parts) > 1:
            found = [ranks.get(a + b, 1 << 62) for a, b in zip(parts, parts[1:])]  # noqa: B905
            rank = min(found)
            if rank == 1 << 62:
                break
            i = found.index(rank)
            last = parts[i], parts[i + 1]
            parts[i : i + 2] = [parts[i] + parts[i + 1]]
        return [ranks[p] for p in parts], (ranks.get(last[0], 0), ranks.get(last[1], 0))

    def follows(self, a: int, b: int) -> bool:
        """Whether b may stand after a; a is -1 at the start of a word."""
        key = (a + 1) << 32 | b
        known = self.pairs.get(key)
        if known is None:
            if len(self.pairs) > self.most_pairs:
                self.pairs.clear()
            pair = [b] if a < 0 else [a, b]
            known = self.pairs[key] = self.merging(b"".join([self.bytes[t] for t in pair]))[0] == pair
        return known

    @staticmethod
    def _path(last: list[tuple[int, int] | None], at: int) -> list[int]:
        """Tokens from the settled place up to ``at``."""
        out = []
        while at > 0:
            at, token = last[at]
            out.append(token)
        return out[::-1]

    def step(self, number: int, byte: int) -> tuple[int, tuple[int, ...]]:
        pending, last, live = self.states[number]
        data = pending + bytes((byte,))
        n, ranks, starts = len(data), self.ranks, self.starts
        # a token that ends here starts at a live place, and just one of those that could may stand there
        last = [*last, next((at, t) for at in live if (t := ranks.get(data[at:])) is not None and self.follows(last[at][1], t) and self.follows(-1, t))]
        live = [p for p in live if data[p:] in starts]
        live.append(n)
        common = set(live)
        while len(common) > 1:
            p = max(common)
            common.remove(p)
            common.add(last[p][0])
        settled = common.pop()
        emitted = ()
        context = last[0][1]
        if settled:
            emitted, context = tuple(self._path(last, settled)), last[settled][1]
            data, live = data[settled:], [p - settled for p in live]
            last = [(-1, context), *[x and (x[0] - settled, x[1]) if x and x[0] >= settled else None for x in last[settled + 1 :]]]
        target = self.numbers.get((context, data))
        if target is None:
            target = self.numbers[context, data] = len(self.states)
            self.states.append((data, last, live))
        known = self.steps[number << 8 | byte] = target, emitted
        return known

    def words(self, words: list[bytes]) -> Coded:
        """Ids of words, which are encoded each by itself, end to end, and how many each has. A step that isn't known is noted, and the rest of the word from
        the last settled place on is simulated with those of the others; asked for ``AGAIN`` times, the machine grows by it, so that only what comes
        again and again is determinised. A full machine starts anew before the next word."""
        ranks, steps, asked = self.ranks, self.steps, self.asked
        heads, n_heads = array("I"), array("q")
        context, rests, of, far, far_of = array("q"), [], array("q"), [], []
        for k, data in enumerate(words):
            whole, before = ranks.get(data), len(heads)
            if whole is not None:
                heads.append(whole)
                n_heads.append(1)
                continue
            state = i = 0
            for byte in data:
                key = state << 8 | byte
                known = steps.get(key)
                if known is None:
                    n = asked.get(key, 0) + 1
                    if n < AGAIN:
                        if len(asked) > 2 * self.most_steps:
                            asked.clear()
                        asked[key] = n
                        break
                    known = self.step(state, byte)
                state, emitted = known
                i += 1
                if emitted:
                    heads.extend(emitted)
            pending, last, _ = self.states[state]
            if i == len(data):
                heads.extend(self._path(last, len(pending)))
            elif len(pending) + len(data) - i > LONGEST:
                far.append(self._simulated(last[0][1], pending + data[i:]))
                far_of.append(k)
            else:
                context.append(last[0][1])
                rests.append(pending + data[i:])
                of.append(k)
            n_heads.append(len(heads) - before)
            if len(steps) > self.most_steps:
                self._empty()
        if len(rests) < FEWEST:
            far += [self._simulated(c, r) for c, r in zip(context, rests, strict=True)]
            far_of += of
            context, rests, of = array("q"), [], array("q")
        ids, counts = self.in_step.run(np.array(context, np.int64), rests)
        ids = np.concatenate((ids, np.array([x for f in far for x in f], np.uint32)))
        counts = np.concatenate((counts, np.array([len(f) for f in far], np.int64)))
        # each word's settled tokens, then its rest
        n_settled, n_rest, of = np.array(n_heads, np.int64), np.zeros(len(words), np.int64), np.array([*of, *far_of], np.int64)
        n_rest[of] = counts
        total = n_settled + n_rest
        begin = np.cumsum(total) - total
        out = np.empty(int(total.sum()), np.uint32)
        for x, at, n in ((np.array(heads, np.uint32), begin, n_settled), (ids, (begin + n_settled)[of], counts)):
            out[np.repeat(at - (np.cumsum(n) - n), n) + np.arange(len(x))] = x
        return out, total

    def _simulated(self, context: int, data: bytes) -> list[int]:
        """Ids of bytes that begin after a settled token."""
        ranks, starts, pairs = self.ranks, self.starts, self.pairs
        last, live = [(-1, context)], [0]
        for n in range(1, len(data) + 1):
            still = []
            found = None
            for at in live:
                piece = data[at:n]
                if found is None:
                    token = ranks.get(piece)
                    if token is not None:
                        before = last[at][1]
                        fits = pairs.get((before + 1) << 32 | token)
                        if fits is None:
                            fits = self.follows(before, token)
                        if fits and (before < 0 or self.follows(-1, token)):
                            found = at, token
                if piece in starts:
                    still.append(at)
            last.append(found)
            if found:  # else the encoding up to here goes round the settled place
                still.append(n)
            live = still
        return self._path(last, len(data))


class Utf8:
    """Incremental UTF-8: bytes in chunks of any cut → text; a character that a chunk cuts waits for the next."""

    #: Lead bytes: the first and last of each range, the bytes that must follow, and the range of the first of those.
    LEADS = ((0x00, 0x7F, 0, 0, 0), (0xC2, 0xDF, 1, 0x80, 0xBF), (0xE0, 0xE0, 2, 0xA0, 0xBF), (0xE1, 0xEC, 2, 0x80, 0xBF), (0xED, 0xED, 2, 0x80, 0x9F), (0xEE, 0xEF, 2, 0x80, 0xBF), (0xF0, 0xF0, 3, 0x90, 0xBF), (0xF1, 0xF3, 3, 0x80, 0xBF), (0xF4, 0xF4, 3, 0x80, 0x8F))

    def __init__(self) -> None:
        self.waiting = b""

    @classmethod
    def open_end(cls, data: bytes) -> int:
        """How many bytes at the end begin a character that isn't complete."""
        for back in range(1, min(3, len(data)) + 1):
            lead = data[-back]
            if 0x80 <= lead < 0xC0:
                continue
            for first, last, more, low, high in cls.LEADS:
                if first <= lead <= last:
                    whole = back > more or back > 1 and not low <= data[1 - back] <= high
                    return 0 if whole else back
            return 0
        return 0

    def feed(self, data: bytes) -> str:
        data = self.waiting + data
        cut = len(data) - self.open_end(data)
        self.waiting = data[cut:]
        return data[:cut].decode("utf-8", "replace")

    def close(self) -> str:
        out, self.waiting = self.waiting.decode("utf-8", "replace"), b""
        return out


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f) if a}


class Codec:
    """ids of whole texts as little-endian unsigned 32-bit integers, and back."""

    def __init__(self, ranks: dict[bytes, int], pattern: str, share: float = 1.0):
        self.transducer, self.pattern, self.most_words = Transducer(ranks, share), regex.compile(pattern), int(WORDS * share)
        self.tokens = [self.transducer.bytes.get(i, b"") for i in range(max(ranks.values()) + 1)]
        self.words: dict[str, int] = {}
        self.ids, self.sizes = np.zeros(0, np.uint32), np.zeros(0, np.int64)  # of the words, by number
        self.pieces = Pieces(self.coded, int(PIECES * share))

    def coded(self, texts: list[str], spaced: bool) -> Coded:
        if len(self.words) > self.most_words or len(self.ids) > 64 * self.most_words:
            self.words.clear()
            self.ids, self.sizes = np.zeros(0, np.uint32), np.zeros(0, np.int64)
        words, find, at, up = self.words, self.pattern.findall, array("q"), array("q", [0])
        old = len(words)
        for text in texts:
            at.extend([words.setdefault(w, len(words)) for w in find(text)])
            up.append(len(at))
        ids, sizes = self.transducer.words([w.encode() for w in islice(words, old, None)])
        self.ids, self.sizes = np.concatenate((self.ids, ids)), np.concatenate((self.sizes, sizes))
        begin = np.cumsum(self.sizes) - self.sizes
        chosen = np.array(at, np.int64)
        count = self.sizes[chosen]
        ends = np.cumsum(count)
        total = int(ends[-1]) if len(ends) else 0
        out = self.ids[np.repeat(begin[chosen] - (ends - count), count) + np.arange(total)]
        return out, np.diff(np.concatenate(([0], ends))[np.array(up, np.int64)])

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """All ids, and where each text's begin, with the end."""
        return self.pieces.texts(texts)

    def decode(self, ids: np.ndarray, chunk: int = 1 << 16) -> Iterator[str]:
        """Text in chunks, as the ids come."""
        stream, tokens = Utf8(), self.tokens
        for i in range(0, len(ids), chunk):
            yield stream.feed(b"".join([tokens[t] for t in ids[i : i + chunk].tolist()]))
        yield stream.close()


_loaded: dict[tuple[str, str, float], Codec] = {}


def codec(path: str, pattern: str, share: float = 1.0) -> Codec:
    if (path, pattern, share) not in _loaded:
        _loaded[path, pattern, share] = Codec(read_ranks(path), pattern, share)
    return _loaded[path, pattern, share]


def encode_and_decode(docs: DataFrame, ranks_path: str, pattern: str, share: float = 1.0) -> DataFrame:
    """doc_id, ids (array of int), decoded (string: the ids, decoded again).

    Every whole text, each match of ``pattern`` by itself, without special tokens. A null text is an empty one and has no ids; very long
    texts are one row like others; repeated rows and null doc_ids stay as they are; an empty table gives an empty result;
    other columns are ignored. ``share`` scales what a worker keeps (for jobs whose workers serve other stages too); results don't
    depend on it. The rank file must be readable at ``ranks_path`` on every executor."""
    prepare(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(ranks_path, pattern, share)
        for batch in batches:
            for i in range(0, batch.num_rows, 2000):
                part = batch.slice(i, 2000)
                ids, cuts = own.encode(part.column("text"))
                lists = pa.ListArray.from_arrays(pa.array(cuts, pa.int32()), pa.array(ids.view(np.int32)))
                decoded = ["".join(own.decode(ids[j:k])) for j, k in zip(cuts.tolist(), cuts[1:].tolist(), strict=False)]
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), lists, pa.array(decoded, pa.string())], ["doc_id", "ids", "decoded"])
        give_back()

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text")).mapInArrow(run, "doc_id long, ids array<int>, decoded string")
