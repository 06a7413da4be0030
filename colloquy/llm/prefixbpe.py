"""BPE encoding by dynamic programming over prefixes, and decoding.

Every prefix of a word has one encoding, so it has one last token. Of the tokens that end at a prefix's end, which a suffix automaton
of the vocabulary reports, it is the one that may stand after the last token of the prefix before it. Two tokens may stand side by
side if no merge across their border comes before the merges that made the tokens around it. The last tokens lead back from
the end of a word to its ids.

Words go in step: one pass over the places of a block of words, whatever their number."""

from __future__ import annotations

import json
import os
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import regex
from pyspark import Broadcast
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .bpe import Utf8
from .common import give_back, prepare
from .pieces import Coded, Pieces

#: Merges that no token waits for.
NEVER = np.int64(1) << 40
#: Words encoded in one go, in bytes; remembered verdicts on pairs (a power of 2); texts and pieces that a worker remembers.
BLOCK, VERDICTS, PIECES = 1 << 20, 1 << 19, 300_000
#: Fixed value: how a byte-level vocabulary cuts a text into words.
WORDS = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


def byte_alphabet() -> list[str]:
    """The character that stands for each byte in a byte-level vocabulary: itself where it is printable, else the next from U+0100 on."""
    shown = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    others = iter(range(0x100, 0x200))
    return [chr(b if b in shown else next(others)) for b in range(256)]


def suffix_automaton(words: list[bytes]) -> tuple[list[dict[int, int]], list[int], list[int], list[int]]:
    """Steps by byte, suffix link and longest length of each state, and the state of each word. State 0 is the empty string; the factors of all
    words are the paths from it."""
    step: list[dict[int, int]] = [{}]
    link, length = [-1], [0]

    def copied(p: int, c: int, q: int) -> int:
        """q's strings no longer than p's with c, as a state of their own."""
        new = len(step)
        step.append(dict(step[q]))
        link.append(link[q])
        length.append(length[p] + 1)
        link[q] = new
        while p >= 0 and step[p].get(c) == q:
            step[p][c] = new
            p = link[p]
        return new

    ends = []
    for word in words:
        last = 0
        for c in word:
            q = step[last].get(c)
            if q is not None:
                last = q if length[q] == length[last] + 1 else copied(last, c, q)
                continue
            new, p = len(step), last
            step.append({})
            length.append(length[last] + 1)
            link.append(0)
            while p >= 0 and c not in step[p]:
                step[p][c] = new
                p = link[p]
            if p >= 0:
                q = step[p][c]
                link[new] = q if length[q] == length[p] + 1 else copied(p, c, q)
            last = new
        ends.append(last)
    # a word's state may have been copied since: the state that has it as its longest string is found from the start
    for i, word in enumerate(words):
        s = 0
        for c in word:
            s = step[s][c]
        ends[i] = s
    return step, link, length, ends


@dataclass
class Vocabulary:
    """What workers need, as arrays; its size is that of the vocabulary. Tokens are numbered: bytes first, then by merge."""

    ids: np.ndarray  # number → id
    left: np.ndarray  # number → the two it is made of (itself for bytes)
    right: np.ndarray
    pairs: np.ndarray  # left * n + right of all merges, sorted
    made: np.ndarray  # the token that each makes
    keys: np.ndarray  # state * 256 + byte of all steps, sorted
    to: np.ndarray
    link: np.ndarray
    length: np.ndarray
    token: np.ndarray  # state → number of the token that is its longest string, -1: none
    near: np.ndarray  # state → itself if it has a token, else the nearest suffix state that has one; 0: none
    added: list[tuple[str, int]]
    texts: list[bytes]  # id → bytes

    @property
    def n(self) -> int:
        return len(self.ids)


def read_vocabulary(path: str) -> Vocabulary:
    """A byte-level BPE file of the tokenizers library: no normalizer, a token for each byte, each merge the only one that makes its token and
    after the merges of its parts. Raises ValueError on others."""
    with open(path, encoding="utf-8") as f:
        data = json.load(f)
    model, alphabet = data["model"], byte_alphabet()
    byte_of = {c: b for b, c in enumerate(alphabet)}
    pre = data["pre_tokenizer"] or {}
    odd = [k for k in ("dropout", "unk_token", "continuing_subword_prefix", "end_of_word_suffix") if model.get(k)]
    odd += [k for k in ("fuse_unk", "byte_fallback", "ignore_merges") if model.get(k)]
    if data["normalizer"] or odd or pre.get("type") != "ByteLevel" or pre.get("add_prefix_space") or not pre.get("use_regex", True):
        raise ValueError(f"not a plain byte-level vocabulary: {path}")
    if any(t[k] for t in data["added_tokens"] for k in ("single_word", "lstrip", "rstrip", "normalized")):
        raise ValueError(f"added tokens must be taken as they stand: {path}")
    vocabulary = model["vocab"]
    merges = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
    number = {c: b for b, c in enumerate(alphabet)}
    left, right = list(range(256)), list(range(256))
    for a, b in merges:
        if a not in number or b not in number or a + b in number:
            raise ValueError(f"merges out of order, or two that make one token: {path}")
        number[a + b] = len(left)
        left.append(number[a])
        right.append(number[b])
    left, right, n = np.array(left, np.int64), np.array(right, np.int64), len(left)
    keys = left[256:] * n + right[256:]
    order = np.argsort(keys)
    names = list(number)
    strings = [bytes(byte_of[c] for c in t) for t in names]
    step, link, length, ends = suffix_automaton(strings)
    steps = sorted((s << 8 | c, q) for s, row in enumerate(step) for c, q in row.items())
    ids = {i: t for t, i in vocabulary.items()} | {t["id"]: t["content"] for t in data["added_tokens"]}
    texts = [b""] * (max(ids) + 1)
    for i, t in ids.items():
        texts[i] = bytes(byte_of[c] for c in t) if all(c in byte_of for c in t) else t.encode()
    added = [(t["content"], t["id"]) for t in data["added_tokens"]]
    token = np.full(len(step), -1, np.int64)
    own = Vocabulary(np.array([vocabulary[t] for t in names], np.uint32), left, right, keys[order], order + 256, np.array([k for k, _ in steps], np.int64), np.array([q for _, q in steps], np.int64), np.array(link, np.int64), np.array(length, np.int64), token, token, added, texts)
    # a token whose own bytes are encoded otherwise never occurs: its parts may not stand side by side until it is made
    whole = np.ones(n, bool)
    whole[256:] = Fits(own).between(left[256:], right[256:], np.arange(256, n))
    for t in range(256, n):  # nor does one made of such
        whole[t] &= whole[left[t]] and whole[right[t]]
    token[np.array(ends)[whole]] = np.flatnonzero(whole)
    near = np.where(token >= 0, np.arange(len(step)), 0)
    for s in np.argsort(own.length, kind="stable").tolist()[1:]:
        if token[s] < 0:
            near[s] = near[link[s]]
    own.near = near
    return own


class Fits:
    """Which tokens may stand side by side; verdicts are remembered in a table of fixed size."""

    def __init__(self, v: Vocabulary):
        self.v = v
        self.known = np.full(VERDICTS, -1, np.int64)
        self.verdict = np.zeros(VERDICTS, bool)

    def _merge(self, x: np.ndarray, y: np.ndarray) -> np.ndarray:
        """The token that x and y make, NEVER: none."""
        pairs = self.v.pairs
        if not len(pairs):
            return np.full(len(x), NEVER)
        key = x * self.v.n + y
        at = np.minimum(np.searchsorted(pairs, key), len(pairs) - 1)
        return np.where(pairs[at] == key, self.v.made[at], NEVER)

    def between(self, a: np.ndarray, b: np.ndarray, until: np.ndarray | None = None) -> np.ndarray:
        """By merges alone: whether nothing merges across the border of a and b (before the merge ``until``).

        x and y are what lies left and right of the border; going back in time, the later made of them comes apart. A merge of both
        takes place if it comes before those that swallow x or y; of equal merges the left one is first."""
        fit = np.ones(len(a), bool)
        open_ = np.arange(len(a))
        x, y = a.astype(np.int64), b.astype(np.int64)
        over_x = np.full(len(a), NEVER) if until is None else until.astype(np.int64)
        over_y = over_x - 1  # compared with <=
        while len(open_):
            m = self._merge(x, y)
            crossed = (m < over_x) & (m <= over_y)
            fit[open_[crossed]] = False
            go = ~crossed & (np.maximum(x, y) >= 256)
            open_, x, y, over_x, over_y = open_[go], x[go], y[go], over_x[go], over_y[go]
            later = x > y
            over_x, over_y = np.where(later, x, over_x), np.where(later, over_y, y)
            x, y = np.where(later, self.v.right[x], x), np.where(later, y, self.v.left[y])
        return fit

    def side_by_side(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        key = a * self.v.n + b
        slot = (key * np.int64(0x9E3779B1) >> 13) & (VERDICTS - 1)
        found = self.verdict[slot]
        new = np.flatnonzero(self.known[slot] != key)
        if len(new):
            verdict = self.between(a[new], b[new])
            found[new] = verdict
            self.known[slot[new]] = key[new]
            self.verdict[slot[new]] = verdict
        return found


class Codec:
    """Texts → ids as unsigned 32-bit integers, and back."""

    def __init__(self, v: Vocabulary, share: float = 1.0):
        self.v, self.fits, self.words = v, Fits(v), regex.compile(WORDS)
        self.added = {t: np.array([i], np.uint32) for t, i in v.added}
        # of added tokens that begin at one place the longest stands
        self.split = regex.compile("(" + "|".join(map(regex.escape, sorted(self.added, key=len, reverse=True))) + ")") if self.added else None
        self.pieces = Pieces(self.coded, int(PIECES * share), whole=list(self.added))

    def _last_tokens(self, data: np.ndarray, start: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The last token of every prefix, at its last byte, for words in ``data`` of falling size; and whether it is part of its word's ids."""
        v, top = self.v, len(self.v.keys) - 1
        last = np.full(len(data), -1, np.int64)
        state, depth = np.zeros(len(start), np.int64), np.zeros(len(start), np.int64)
        active = np.searchsorted(-size, -np.arange(1, (size[0] if len(size) else 0) + 1), side="right")  # words longer than each place
        for j, k in enumerate(active.tolist()):
            at = start[:k] + j
            byte = data[at].astype(np.int64)
            s, d = state[:k], depth[:k]
            todo = np.arange(k)
            while len(todo):  # on to the longest factor that ends here
                key = s[todo] << 8 | byte[todo]
                i = np.minimum(np.searchsorted(v.keys, key), top)
                ok = v.keys[i] == key
                done = todo[ok]
                s[done] = v.to[i[ok]]
                d[done] += 1
                todo = todo[~ok]  # each byte is a token, so the first state has all steps
                s[todo] = v.link[s[todo]]
                d[todo] = v.length[s[todo]]
            # tokens that end here, from the longest: the state's own only if all of it has been matched
            cur = np.where(d < v.length[s], v.near[v.link[s]], v.near[s])
            todo = np.arange(k)
            while len(todo):
                t = v.token[cur]
                before = j + 1 - v.length[cur]
                first = before == 0
                ok = first.copy()
                inner = np.flatnonzero(~first)
                ok[inner] = self.fits.side_by_side(last[start[todo[inner]] + before[inner] - 1], t[inner])
                last[at[todo[ok]]] = t[ok]
                todo, cur = todo[~ok], v.near[v.link[cur[~ok]]]
        # back from each word's end
        part = np.zeros(len(data), bool)
        words, end = np.arange(len(start)), size.copy()
        while len(words):
            at = start[words] + end - 1
            part[at] = True
            end = end - self.sizes[last[at]]
            words, end = words[end > 0], end[end > 0]
        return last, part

    @property
    def sizes(self) -> np.ndarray:
        """Bytes of each token."""
        if not hasattr(self, "_sizes"):
            self._sizes = np.array([len(self.v.texts[i]) for i in self.v.ids.tolist()], np.int64)
        return self._sizes

    def encoded(self, words: list[bytes]) -> Coded:
        """Ids of words, which are encoded each by itself, end to end, and how many each has."""
        ids, counts = [np.zeros(0, np.uint32)], [np.zeros(0, np.int64)]
        i = 0
        while i < len(words):
            j, bulk = i, 0
            while j < len(words) and (j == i or bulk + len(words[j]) <= BLOCK):
                bulk += len(words[j])
                j += 1
            data = np.frombuffer(b"".join(words[i:j]), np.uint8)
            size = np.array([len(w) for w in words[i:j]], np.int64)
            start = np.cumsum(size) - size
            order = np.argsort(-size, kind="stable")
            order = order[: np.count_nonzero(size)]  # an empty word has no ids
            last, part = self._last_tokens(data, start[order], size[order])
            ids.append(self.v.ids[last[part]])
            up = np.concatenate(([0], np.cumsum(part)))
            counts.append(up[start + size] - up[start])
            i = j
        return np.concatenate(ids), np.concatenate(counts)

    def coded(self, texts: list[str], spaced: bool) -> Coded:
        """Ids of texts: cut at added tokens, then into words, each different word encoded once."""
        find, number, of_text = self.words.findall, {}, []
        at: list[int] = []
        for text in texts:
            before = len(at)
            for k, part in enumerate(self.split.split(text) if self.split and not spaced else [text]):
                at += [number.setdefault(part, len(number))] if k % 2 else [number.setdefault(w.encode(), len(number)) for w in find(part)]
            of_text.append(len(at) - before)
        words = [b"" if isinstance(w, str) else w for w in number]
        ids, counts = self.encoded(words)
        begin = np.cumsum(counts) - counts
        special = [(k, self.added[w]) for k, w in enumerate(number) if isinstance(w, str)]
        if special:  # their ids follow those of the words
            begin[[k for k, _ in special]] = len(ids) + np.arange(len(special))
            counts[[k for k, _ in special]] = 1
            ids = np.concatenate([ids, *[x for _, x in special]])
        chosen = np.array(at, np.int64)
        count = counts[chosen]
        ends = np.cumsum(count)
        total = int(ends[-1]) if len(ends) else 0
        out = ids[np.repeat(begin[chosen] - (ends - count), count) + np.arange(total)]
        up = np.concatenate(([0], ends))[np.concatenate(([0], np.cumsum(of_text))).astype(np.int64)]
        return out, np.diff(up)

    def decode(self, ids: np.ndarray, chunk: int = 1 << 16) -> Iterator[str]:
        """Text in chunks; bytes that are no UTF-8 become U+FFFD, as the library has it."""
        stream, texts = Utf8(), self.v.texts
        for i in range(0, len(ids), chunk):
            yield stream.feed(b"".join([texts[t] for t in ids[i : i + chunk].tolist()]))
        yield stream.close()


_shared: dict[tuple[str, str, float], Broadcast] = {}
_codecs: dict[tuple[str, float], Codec] = {}


def shared(spark: SparkSession, path: str) -> Broadcast:
    """The vocabulary, read once on the driver and sent to all executors: its size is the vocabulary's, whatever the corpus."""
    key = (spark.sparkContext.applicationId, path, os.path.getmtime(path))
    if key not in _shared:
        _shared[key] = spark.sparkContext.broadcast(read_vocabulary(path))
    return _shared[key]


def encode_and_decode(docs: DataFrame, path: str, share: float = 1.0) -> DataFrame:
    """doc_id, ids (binary, little-endian unsigned 32-bit), decoded (string: the ids, decoded again with special tokens).

    ``path`` (on the driver) is a byte-level BPE file of the tokenizers library; the ids are the library's without special tokens
    at the ends, truncation and padding. An added token that a text holds is one id. A null text is an empty one and has no ids; very
    long texts are one row like others; repeated rows and null doc_ids stay as they are; an empty table gives an empty result; other
    columns are ignored. ``share`` scales what a worker remembers; results don't depend on it."""
    spark = docs.sparkSession
    prepare(spark)
    vocabulary = shared(spark, path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key = (path, share)
        if key not in _codecs:
            _codecs[key] = Codec(vocabulary.value, share)
        own = _codecs[key]
        for batch in batches:
            for i in range(0, batch.num_rows, 2000):
                part = batch.slice(i, 2000)
                ids, cuts = own.pieces.texts(part.column("text"))
                data = pa.Array.from_buffers(pa.binary(), part.num_rows, [None, pa.py_buffer((cuts * 4).astype(np.int32)), pa.py_buffer(ids.astype("<u4"))])
                decoded = ["".join(own.decode(ids[j:k])) for j, k in zip(cuts.tolist(), cuts[1:].tolist(), strict=False)]
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), data, pa.array(decoded, pa.string())], ["doc_id", "ids", "decoded"])
        give_back()

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text")).mapInArrow(run, "doc_id long, ids binary, decoded string")
