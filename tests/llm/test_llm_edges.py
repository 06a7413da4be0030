"""Nulls, empty and long texts, ties, repeated rows, empty tables and clashing extra columns, for every operator and stage."""

from __future__ import annotations

import hashlib
import math
import zlib
from itertools import combinations, product

import numpy as np
import pytest

pytest.importorskip("colloquy.llm")
public_tokenizers = pytest.importorskip("public_tokenizers")

from colloquy.llm import bpe, lines, matching, mixing, quality, rules, simhash, suffixes, tokenfile, topk, wavelet  # noqa: E402

LONG = "alpha beta gamma delta epsilon zeta eta theta iota kappa " * 3000
PASSAGE = " ".join(f"w{i}x{i * 7}" for i in range(60))
ROWS = [
    (1, "Hello there, this is a fine line of text.\nshort", "en", "a", 1, "k", 0, 0.5),
    (2, None, None, None, None, None, None, None),
    (3, "", "en", "a", 0, "k", 0, 0.5),
    (None, "no id here but this text is long enough to count as a line", "de", None, 1, "k", 0, 0.5),
    (4, PASSAGE + " tail one", "en", "b", 1, "k", 0, 0.5),
    (5, "head two " + PASSAGE, "en", "b", 1, "k", 0, 0.5),
    (5, "head two " + PASSAGE, "en", "b", 1, "k", 0, 0.5),
    (6, LONG, "en", "a", 1, "k", 0, 0.5),
    (7, " \t\n\x0b ", "fr", "c", 1, "k", 0, 0.5),
    (8, "naïve café　日本 🎉\x00 nul  double  space\n\nx ", "fr", "c", 1, "k", 0, 0.5),
    (5, "another text of a repeated id\nthis very line stands in three documents", "en", "b", 1, "k", 0, 0.5),
    (None, "and one more without any id\nthis very line stands in three documents", None, "b", 1, "k", 0, 0.5),
    (9, "this very line stands in three documents\nand a last one", "en", "a", 1, "k", 0, 0.5),
]
# the extra columns bear names that the operators use themselves
EXTRA = ("copies", "__n", "__doc", "__id", "__row", "__hash", "__copy", "row", "hash", "nth", "times", "lines", "h1", "a.b")
ROWS = [(*r, *[f"{c} {i}" for c in EXTRA]) for i, r in enumerate(ROWS)]
ROWS[6] = ROWS[5]  # a row that comes twice
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, kept string, size int, score double, " + ", ".join(f"`{c}` string" for c in EXTRA)


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(ROWS, SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


def sha(b):
    return hashlib.sha256(b).hexdigest()


@pytest.fixture(scope="module")
def order(docs):
    """Rows by doc_id, those that share one by the hash of their text."""
    from pyspark.sql import functions as F

    hashes = {r.text: r.h for r in docs.select("text", F.xxhash64(F.coalesce("text", F.lit(""))).alias("h")).collect()}
    return sorted(ROWS, key=lambda r: (r[0] is not None, r[0] or 0, hashes[r[1]]))


def brute(order, split, window, join):
    seen, out = set(), []
    for r in order:
        items = split((r[1] or "").encode())
        gone = [False] * len(items)
        for i in range(len(items) - window + 1):
            key = tuple(items[i : i + window])
            if key in seen:
                gone[i : i + window] = [True] * window
            seen.add(key)
        out.append((r[0] is not None, r[0] or 0, len(items), sum(gone), join([x for x, g in zip(items, gone, strict=True) if not g])))
    return sorted(out)


@pytest.mark.parametrize("crowd", [0, 8192])
@pytest.mark.parametrize(("operator", "split", "window", "join"), [(suffixes.remove_substrings, list, 100, bytes), (matching.remove_passages, bytes.split, 20, b" ".join)])
def test_repeats(docs, none, order, crowd, operator, split, window, join):
    got = sorted((r.doc_id is not None, r.doc_id or 0, r.n, sum(s.end - s.start for s in r.spans), bytes(r.kept)) for r in operator(docs, crowd=crowd).collect())
    assert got == brute(order, split, window, join)
    assert operator(none).count() == 0


def test_removals_are_told_by_shards(spark, sf_dir):
    """All that is removed is told by a shard that compares contents, none by digests. Equal segments count too: this doesn't say what a suffix array or
    FM-index found."""
    d = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for operator in (suffixes.remove_substrings, matching.remove_passages):
        rows = operator(d).collect()
        assert sum(r.indexed for r in rows) == sum(s.end - s.start for r in rows for s in r.spans) > 0


def test_groups_have_all_occurrences(spark):
    rng = np.random.default_rng(4)
    word = lambda: "".join(map(chr, rng.integers(97, 123, 6)))
    shared = [" ".join(word() for _ in range(40)) for _ in range(3)]
    texts = {i: " ".join([word(), shared[i % 3], word(), shared[(i * i) % 3][: 200 + i]]) for i in range(12)}
    d = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    for found, split, least in ((suffixes.repeat_groups(d), lambda t: list(t.encode()), 100), (matching.repeated_passages(d), lambda t: t.split(), 20)):
        items = {i: split(t) for i, t in texts.items()}
        at = {}
        for i, x in items.items():
            for k in range(len(x) - least + 1):
                at.setdefault(tuple(x[k : k + least]), set()).add((i, k))
        groups = {}
        for r in found.collect():
            groups.setdefault((r.shard, r.match, r.length), set()).add((r.doc_id, r.start))
        covered = {}
        for (_, _, n), places in groups.items():
            strings = {tuple(items[i][k : k + n]) for i, k in places}
            assert len(strings) == 1 and len(places) > 1 and n >= least  # one string, at all these places
            for k in range(n - least + 1):
                key = next(iter(strings))[k : k + least]
                covered.setdefault(key, set()).update((i, j + k) for i, j in places)
        assert covered == {k: v for k, v in at.items() if len(v) > 1}


def test_matching_statistics():
    rng = np.random.default_rng(2)
    pieces = list(dict.fromkeys(" ".join(f"w{k}" for k in rng.integers(0, 3, rng.integers(5, 14))).encode() for _ in range(12)))
    words = [p.split() for p in pieces]
    for i, got in enumerate(matching.matching_statistics(pieces, 4)):
        for e in range(len(words[i])):
            best = 0
            for n in range(1, e + 2):
                x = words[i][e + 1 - n : e + 1]
                if sum(w[k : k + n] == x for w in words for k in range(len(w))) > 1:
                    best = n
            assert got[e] == best


def test_huffman_wavelet():
    rng = np.random.default_rng(0)
    for n in (1, 2, 50, 3000):
        x = np.minimum(rng.zipf(1.4, n), 300)
        h = wavelet.HuffmanWavelet(x)
        symbol, lo, hi = rng.integers(0, x.max() + 1, 100), rng.integers(0, n + 1, 100), rng.integers(0, n + 1, 100)
        a, b = h.rank(symbol, lo, hi)
        assert a.tolist() == [int((x[:i] == v).sum()) for v, i in zip(symbol, lo, strict=True)]
        assert b.tolist() == [int((x[:i] == v).sum()) for v, i in zip(symbol, hi, strict=True)]
        p = np.bincount(x)[np.bincount(x) > 0] / n
        assert h.bits <= n * (1 - (p * np.log2(p)).sum())  # within a bit a symbol of the entropy


def test_token_files(spark, docs, none, order):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    path = tokenfile.new_path(spark, "edge")
    tokenfile.write_tokens(docs, path, public_tokenizers.path("byte_bpe_50k.json"), shard_tokens=50)
    got = sorted(tokenfile.read_tokens(spark, path).collect(), key=lambda r: r.start)
    start, want = 0, []
    for r in order:
        ids = np.array(t.encode(r[1] or "", add_special_tokens=False).ids + [0], "<u4")
        want.append((r[0], start, ids.tobytes()))
        start += len(ids)
    assert [(r.doc_id, r.start, bytes(r.ids)) for r in got] == want
    every = np.concatenate([np.frombuffer(x[2], "<u4") for x in want])
    asked = spark.createDataFrame([(i,) for i in [0, 7, 7, len(every) - 1, len(every), -1, None, *range(100, 400)]], "position long")
    told = {r.position: r.token for r in tokenfile.tokens_at(spark, path, asked).collect()}
    assert told == {i: int(every[i]) for i in [0, 7, len(every) - 1, *range(100, 400)]}
    some = [0, int(every[3]), 49999, 70000]
    assert {r.token: r.n for r in tokenfile.token_counts(spark, path, some).collect()} == {t: int((every == t).sum()) for t in some}
    for token in some:
        places = sorted((str(d), k) for d, _, ids in want for k in np.flatnonzero(np.frombuffer(ids, "<u4") == token).tolist())
        assert sorted((str(r.doc_id), r["at"]) for r in tokenfile.token_occurrences(spark, path, token).collect()) == places
    path = tokenfile.new_path(spark, "edge")
    tokenfile.write_tokens(none, path, public_tokenizers.path("byte_bpe_50k.json"))
    assert tokenfile.read_tokens(spark, path).count() == 0


def test_added_tokens_are_the_librarys(spark):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    end = "<|endoftext|>"
    texts = [end, f"{end} start", f"hello {end} world", f"hello{end}world  x", f"a  {end}  b", f"the end {end}", f"{end}{end} \n{end}", "<|endoftext", f" {end}"]
    path = tokenfile.new_path(spark, "added")
    tokenfile.write_tokens(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), path, public_tokenizers.path("byte_bpe_50k.json"))
    got = {r.doc_id: np.frombuffer(bytes(r.ids), "<u4").tolist() for r in tokenfile.read_tokens(spark, path).collect()}
    assert got == {i: t.encode(x, add_special_tokens=False).ids + [0] for i, x in enumerate(texts)}


def test_wavelet_matrix():
    rng = np.random.default_rng(0)
    for n, top in ((0, 1), (1, 1), (63, 3), (64, 60000), (1000, 17), (4000, 2)):
        x = rng.integers(0, top, n).astype(np.uint16)
        w = wavelet.WaveletMatrix.from_bytes(wavelet.WaveletMatrix.of(x).to_bytes())
        assert (w.values() == x).all()
        if n:
            assert (w.access(np.arange(n)) == x).all()
        for v in {0, int(x[0]) if n else 0, 65535}:
            assert w.occurrences(v).tolist() == np.flatnonzero(x == v).tolist()
            assert [int(w.rank(v, i)) for i in range(n + 1)] == [int((x[:i] == v).sum()) for i in range(n + 1)]


def test_planes_of_every_size_survive():
    rng = np.random.default_rng(3)
    for n in range(1, 400):
        x = rng.integers(0, 50_000, n).astype(np.uint16)
        assert (wavelet.WaveletMatrix.from_bytes(wavelet.WaveletMatrix.of(x).to_bytes()).values() == x).all()


def test_bpe(docs, none):
    tiktoken = pytest.importorskip("tiktoken")
    path = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    t = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=bpe.read_ranks(path), special_tokens={})
    got = sorted(((r.doc_id is not None, r.doc_id or 0), r.ids, r.decoded) for r in bpe.encode_and_decode(docs, path, public_tokenizers.PATTERN).collect())
    assert got == sorted(((r[0] is not None, r[0] or 0), t.encode_ordinary(r[1] or ""), r[1] or "") for r in ROWS)
    few = bpe.encode_and_decode(docs, path, public_tokenizers.PATTERN, 0.0001)  # nearly nothing is kept
    assert sorted(((r.doc_id is not None, r.doc_id or 0), r.ids, r.decoded) for r in few.collect()) == got
    assert bpe.encode_and_decode(none, path, public_tokenizers.PATTERN).count() == 0


def test_utf8_in_any_cuts():
    data = "aé日🎉z".encode() + b"\xff\xe6\x97" + "é".encode() + b"\xf0\x9f"
    for cut in range(1, 6):
        u = bpe.Utf8()
        assert "".join(u.feed(data[i : i + cut]) for i in range(0, len(data), cut)) + u.close() == data.decode("utf-8", "replace")


def test_transducer_against_merging():
    hypothesis = pytest.importorskip("hypothesis")
    tiktoken = pytest.importorskip("tiktoken")
    path = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    c = bpe.codec(path, public_tokenizers.PATTERN)
    t = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=bpe.read_ranks(path), special_tokens={})
    import pyarrow as pa

    @hypothesis.settings(max_examples=300, deadline=None, database=None)
    @hypothesis.given(hypothesis.strategies.lists(hypothesis.strategies.text(hypothesis.strategies.characters(exclude_categories=("Cs",)), max_size=30), max_size=4))
    def same(texts):
        ids, cuts = c.encode(pa.array(texts, pa.string()))
        assert [ids[i:j].tolist() for i, j in zip(cuts, cuts[1:], strict=False)] == [t.encode_ordinary(x) for x in texts]

    same()


def test_new_words_are_simulated_together(monkeypatch):
    tiktoken = pytest.importorskip("tiktoken")
    path = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    t = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=bpe.read_ranks(path), special_tokens={})
    one_by_one = []
    simulated = bpe.Transducer._simulated
    monkeypatch.setattr(bpe.Transducer, "_simulated", lambda *a: one_by_one.append(1) or simulated(*a))
    rng = np.random.default_rng(5)
    parts = ["th", "er", "eau", "ción", "zü", "q", "日", "ing", "x", "é", "ent", "🎉"]
    words = ["".join(rng.choice(parts, rng.integers(1, 9))) for _ in range(3000)]
    long = ["".join(rng.choice(parts, 400)), "ab" * 700, "日" * 500, "=" * 999]
    c = bpe.Codec(bpe.read_ranks(path), public_tokenizers.PATTERN)
    for texts, most in ((words, 0), ([w + v for w, v in zip(words, words[::-1], strict=True)], 0), (words[:5] + long + [""], 64)):
        one_by_one.clear()
        ids, sizes = c.coded(texts, False)
        cuts = np.concatenate(([0], np.cumsum(sizes))).tolist()
        assert [ids[i:j].tolist() for i, j in zip(cuts, cuts[1:], strict=False)] == [t.encode_ordinary(x) for x in texts]
        assert len(one_by_one) <= most


def test_pairs_in_bulk():
    ranks = bpe.read_ranks(public_tokenizers.path("byte_bpe_multi_50k.tiktoken"))
    m = bpe.Transducer(ranks)
    sides = m.in_step.sides
    rng = np.random.default_rng(6)
    whole = np.flatnonzero(sides.whole)
    a, b = rng.choice(whole, 20_000), rng.choice(whole, 20_000)
    a[:10_000], b[:10_000] = rng.choice(sides.left[whole], 10_000), rng.choice(sides.right[whole], 10_000)
    a, b = a[sides.whole[a] & sides.whole[b]], b[sides.whole[a] & sides.whole[b]]
    want = [m.merging(m.bytes[x] + m.bytes[y])[0] == [x, y] for x, y in zip(a.tolist(), b.tolist(), strict=True)]
    assert sides.by_rank and sides.fit(a, b).tolist() == want and sides.fit(a, b).tolist() == want


@pytest.mark.parametrize("tokens", [["abc", "ab", "ca"], ["bc", "abc", "ab", "aa", "aaa", "bca"], ["aa", "aaaa", "ab"]])
def test_tokens_out_of_order(tokens):
    """Tokens may come before those that they are made of."""
    ranks = {bytes([i]): i for i in range(256)} | {t.encode(): 256 + i for i, t in enumerate(tokens)}
    words = ["".join(w).encode() for n in range(1, 8) for w in product("abc", repeat=n)]
    m = bpe.Transducer(ranks)
    ids, sizes = m.words(words)
    cuts = np.concatenate(([0], np.cumsum(sizes))).tolist()
    assert [ids[i:j].tolist() for i, j in zip(cuts, cuts[1:], strict=False)] == [[ranks[w]] if w in ranks else m.merging(w)[0] for w in words]


def test_quality(spark, docs, none):
    labels = spark.createDataFrame([(i, i % 2) for i in range(1, 9)] + [(None, 1), (3, None)], "doc_id long, quality int")
    model = quality.fit(docs, labels)
    got = quality.score(docs, model).collect()
    assert len(got) == len(ROWS) and all(0 <= r.score <= 1 for r in got)
    assert quality.good_documents(docs, model, 0.0).count() == len(ROWS)
    assert quality.good_documents(docs, model, 0.0).columns == docs.columns
    for d, l in ((none, labels), (docs, labels.limit(0)), (none, labels.limit(0))):
        assert quality.score(d, quality.fit(d, l)).count() == d.count()
    held = {r.doc_id: r.h for r in docs.select("doc_id", quality.held_out(docs.doc_id).alias("h")).collect()}
    assert all(h == (d is not None and zlib.crc32(str(d).encode()) % 4 == 2) for d, h in held.items())


def test_dual_descent_solves_the_hinge_loss():
    """The model's weights against a plain dense solver of the same primal, by subgradient steps."""
    rng = np.random.default_rng(1)
    labels = rng.integers(0, 2, 60)
    rows = [np.unique(np.where(rng.random(12) < 0.7, rng.integers(0, 15, 12) + 15 * q, rng.integers(0, 30, 12))) for q in labels]
    held = np.arange(60) % quality.CALIBRATES == 0
    x = np.zeros((60, 30))
    for i, r in enumerate(rows):
        x[i, r] = 1
    count = {q: quality.ALPHA + x[~held & (labels == q)].sum(0) for q in (0, 1)}
    full = {q: count[q].sum() + quality.ALPHA * (quality.WIDTH - 30) for q in (0, 1)}
    ratio = np.log((count[1] / full[1]) / (count[0] / full[0]))
    x = x * ratio
    x = np.hstack([x / np.sqrt(np.square(x).sum(1, keepdims=True)), np.ones((60, 1))])
    y, use = np.where(labels > 0, 1.0, -1.0), ~held
    cost = np.where(y > 0, quality.C, quality.C * max(1.0, (y[use] > 0).sum() / (y[use] < 0).sum()) ** 0.5)
    goal = lambda w: 0.5 * w @ w + (cost * np.maximum(0, 1 - y * (x @ w)))[use].sum()
    w, best = np.zeros(31), np.inf
    for k in range(20000):
        on = use & (y * (x @ w) < 1)
        w = w - (w - (cost * y * on) @ x) / (k + 2)
        best = min(best, goal(w))
    model = quality.fit_rows(rows, labels)
    assert np.allclose(model.ratios[:30], ratio)
    own = goal(np.append(model.weights[:30], model.bias))
    assert own <= best * 1.01


def test_quality_takes_repeated_ids_once(spark):
    rows = [(i, f"word{i % 2} " * 30) for i in range(1, 60)]
    labels = spark.createDataFrame([(i, i % 2) for i in range(1, 60)], "doc_id long, quality int")
    once, often = (quality.fit(spark.createDataFrame(r, "doc_id long, text string"), labels) for r in (rows, rows + rows[:5] * 50))
    assert np.array_equal(once.weights, often.weights) and once.bias == often.bias


@pytest.mark.parametrize("kind", ["han", "cyrillic", "salad"])
def test_quality_tells_texts_of_one_shape_apart(kind):
    rng = np.random.default_rng(5)

    def text(good):
        if kind == "salad":
            sentence = "the old cat sat near one big mat and the red dog ran off".split()
            return " ".join(sentence * 4 if good else rng.permutation(sentence * 4))
        first = (0x4E00 if kind == "han" else 0x430) + (0 if good else 16)
        words = ["".join(chr(first + k) for k in rng.integers(0, 16, 5)) for _ in range(40)]
        return ("" if kind == "han" else " ").join(words)

    labels = np.arange(120) % 2
    model = quality.fit_rows([quality.features(text(q)) for q in labels], labels)
    assert all((model.score(quality.features(text(q))) >= quality.CUT) == q for q in (True, False) * 20)


def test_mixing(docs, none):
    got = mixing.mix(docs).collect()
    assert len(got) == len(ROWS)
    assert all(0 <= r.taken <= 2 * r.size for r in got)
    by = {}
    for r in got:
        by.setdefault(r.source_size, [r.target, 0])[1] += r.taken
    total = sum(len((r[1] or "").encode().split()) for r in ROWS)
    assert sum(r.taken for r in got) == int(1.5 * total)
    assert mixing.mix(none).count() == 0
    assert mixing.mixed_documents(none).count() == 0
    out = mixing.mixed_documents(docs)
    assert out.columns == docs.columns
    assert {tuple(r) for r in out.collect()} <= {tuple(r) for r in docs.collect()}
    assert sorted(map(str, out.collect())) == sorted(map(str, mixing.mixed_documents(docs).collect()))


def test_rules(docs, none):
    got = rules.judged(docs).collect()
    assert len(got) == len(ROWS)
    assert rules.judged(none).count() == 0
    assert {r.doc_id for r in got if r.base_failed and r.n_words < 50} >= {1, 2, 3, 7, 8}


def plain(first, n=100, width=5):
    return [f"{first + i:0{width}d}" for i in range(n)]


def test_rules_reject_a_lone_outlier_in_each_statistic(spark):
    texts = {i: " ".join(plain(200 * i)) for i in range(40)}
    symbols = plain(9000)
    symbols[:70:10] = [w[:4] + "#" for w in symbols[:70:10]]
    texts[100] = " ".join(symbols)
    texts[101] = " ".join(plain(100000, 80, 6) + plain(9200, 20))
    texts[102] = " ".join(plain(9400, 84)) + "".join(f"\n09999\n{w}" for w in plain(9500, 8))
    passage = plain(9600, 18)
    texts[103] = " ".join(passage + plain(9700, 64) + passage)
    got = {r.doc_id: r for r in rules.judged(spark.createDataFrame([(d, t, "en", "a") for d, t in texts.items()], "doc_id long, text string, lang string, source string")).collect()}
    assert (got[100].n_symbols, got[101].word_chars, got[102].n_dup_lines, got[103].n_repeat_words) == (7, 580, 7, 36)
    assert got[102].n_repeat_words == 0 and not any(r.base_failed for r in got.values())
    assert {d for d, r in got.items() if not r.kept} == {100, 101, 102, 103}


def test_rules_judge_small_groups_by_their_language(spark):
    rows = [(i, 5, "en", "large") for i in range(100)] + [(100 + i, 5, "en", f"s{i // 5}") for i in range(100)]
    rows += [(300 + i, 7, "de", f"s{i // 5}") for i in range(30)] + [(400, 5, "de", "s0")]  # the mean of another language
    rows += [(500 + i, 8, "en", "of 29") for i in range(29)] + [(600, 7, "fr", "alone"), (601, 9, None, None)]
    rows = [(d, " ".join(plain(200 * k, 100, w)), lang, source) for k, (d, w, lang, source) in enumerate(rows)]
    got = rules.judged(spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")).collect()
    assert len(got) == len(rows) and not any(r.base_failed for r in got)
    assert {r.doc_id for r in got if not r.kept} == {400}


def test_smallest_determinant_of_all_subsets():
    rng = np.random.default_rng(6)
    for n in (7, 9, 10):
        x = rng.normal(size=(n, rules.D)) * [1, 2, 0.5, 0.2]
        x[: n // 5] += 10
        h = math.ceil(rules.CORE * n)
        least = min(rules.shape(h, x[list(c)].mean(0), x[list(c)].T @ x[list(c)] / h)[1] for c in combinations(range(n), h))
        starts = [list(c) for c in combinations(range(n), rules.D + 1)]
        assert rules.concentrated(x, starts)[0][0] == pytest.approx(least, abs=0.01)


def test_the_estimate_over_all_rows_is_that_of_the_best_core(spark):
    rng = np.random.default_rng(7)
    x = np.concatenate([rng.normal(size=(300, 4)) * 0.3, rng.normal(size=(60, 4)) * 0.1 + 4])
    d = spark.createDataFrame([("g", *map(float, r)) for r in x], "g string, y0 double, y1 double, y2 double, y3 double")
    got = rules.robust_estimates(d).collect()[0]
    best = rules.concentrated(x, [rng.choice(len(x), 5, replace=False) for _ in range(60)])[0]
    assert np.abs(np.array(got.centre) - best[1]).max() < 0.05 and abs(got.det - best[0]) < 0.1


def test_simhash(docs, none):
    found = simhash.near_duplicates(docs).collect()
    assert sorted((str(r.doc_id), r.fp) for r in found) == sorted((str(r[0]), int(np.uint64(simhash.fingerprint(r[1] or "")).view(np.int64))) for r in ROWS)
    got = {r.doc_id: r for r in found}
    assert got[2].component_id == got[3].component_id == got[7].component_id == 2
    assert simhash.near_duplicates(none).count() == 0
    kept = simhash.one_of_each(docs).collect()
    assert {tuple(r) for r in kept} <= set(ROWS)
    assert sorted(str(r.doc_id) for r in kept) == ["1", "2", "4", "5", "5", "6", "8", "9", "None", "None"]
    assert simhash.one_of_each(none).count() == 0


def test_simhash_links_by_fingerprint_only(spark):
    texts = [" ".join(plain(1000 * i)) for i in range(6)]
    rows = [(None, texts[0]), (None, texts[1]), (None, texts[1]), (7, texts[2]), (7, texts[3]), (5, texts[3]), (8, texts[4]), (None, texts[4]), (9, texts[5])]
    fps = {simhash.fingerprint(t) for t in texts}
    assert min((a ^ b).bit_count() for a in fps for b in fps if a != b) > 3
    d = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted((str(r.doc_id), r.fp, str(r.component_id)) for r in simhash.near_duplicates(d).collect())
    root = {texts[0]: None, texts[1]: None, texts[2]: 7, texts[3]: 5, texts[4]: None, texts[5]: 9}
    assert got == sorted((str(i), int(np.uint64(simhash.fingerprint(t)).view(np.int64)), str(root[t])) for i, t in rows)
    kept = sorted((texts.index(r.text), r.doc_id) for r in simhash.one_of_each(d).collect())
    assert kept == [(0, None), (1, None), (2, 7), (3, 5), (4, None), (5, 9)]


@pytest.mark.parametrize("n", [3, 40, 900])
def test_gray_index_links_all_in_a_bucket(n):
    rng = np.random.default_rng(n)
    base = rng.integers(0, 1 << 62, 5).astype(np.uint64)
    x = np.unique(base[rng.integers(0, 5, n)] ^ (np.uint64(1) << rng.integers(0, 64, n).astype(np.uint64)) ^ (np.uint64(1) << rng.integers(0, 64, n).astype(np.uint64)))
    for bucket in (np.zeros(len(x), np.int64), rng.integers(0, 3, len(x))):
        near = (np.bitwise_count(x[:, None] ^ x[None, :]) <= 3) & (bucket[:, None] == bucket[None, :])
        a, b = simhash.GrayIndex(x, bucket).links(3)
        assert {tuple(sorted(p)) for p in zip(a.tolist(), b.tolist(), strict=True)} == {(i, j) for i, j in np.argwhere(np.triu(near, 1)).tolist()}


def test_large_buckets_are_split_without_losing_links(spark, monkeypatch):
    monkeypatch.setattr(simhash, "PART", 8)
    rng = np.random.default_rng(3)
    low = np.unique(rng.integers(0, 1 << 20, 400).astype(np.int64))
    low = np.unique(np.concatenate([low, low ^ (1 << 3) ^ (1 << 17), low ^ 7 << 40]))
    kinds = spark.createDataFrame([(int(v),) for v in low], "fp long")
    rows = simhash._bucketed(kinds, len(low)).collect()
    buckets = {}
    for r in rows:
        buckets.setdefault((r.mask, r.value), []).append(r.fp)
    assert max(map(len, buckets.values())) <= 8
    found = {tuple(sorted((a, b))) for v in buckets.values() for a in v for b in v if a != b and (a ^ b).bit_count() <= 3}
    assert found == {tuple(sorted((int(low[i]), int(low[j])))) for i, j in np.argwhere(np.triu(np.bitwise_count(low[:, None] ^ low[None, :]) <= 3, 1)).tolist()}


def test_components_of_a_long_chain(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(100)] + [(200, 201), (7, 7)], "u long, v long")
    assert {tuple(r) for r in simhash.components(edges).collect()} == {(i, 0) for i in range(1, 101)} | {(201, 200)}


def test_lines(spark, docs, none):
    got = lines.drop_repeated_lines(docs)
    assert got.columns == ["row", "kept", "n_lines", "n_dropped"]
    assert sorted(map(str, (tuple(r.row) for r in got.collect()))) == sorted(map(str, ROWS))
    # the null ids are one document, which holds the line twice over; the largest id keeps it
    assert sorted((str(r.row.doc_id), r.n_dropped) for r in got.collect() if "this very line" in (r.row.text or "")) == [("5", 1), ("9", 0), ("None", 1)]
    assert lines.drop_repeated_lines(none).count() == 0
    line = "This very line is repeated."
    rows = [(i, f"own {i}\n {line.upper()}\t\n{line}", "x") for i in range(5)] + [(4, line, "x"), (9, "", None), (10, None, None)]
    small = lines.drop_repeated_lines(spark.createDataFrame(rows, "doc_id long, text string, h1 string"))
    kept = sorted((r.row.doc_id, r.kept, r.n_lines, r.n_dropped) for r in small.collect())
    assert kept == [*[(i, f"own {i}", 3, 2) for i in range(4)], (4, line, 1, 0), (4, f"own 4\n {line.upper()}\t\n{line}", 3, 0), (9, "", 1, 0), (10, "", 1, 0)]
    assert set(small.select("row.h1").distinct().collect()) == {("x",), (None,)}
    two = spark.createDataFrame([(1, line), (1, line), (2, line)], "doc_id long, text string")
    assert all(r.n_dropped == 0 for r in lines.drop_repeated_lines(two).collect())


def test_runs_go_on_in_another_session(spark, tmp_path):
    def batch(keys, holder):
        return spark.createDataFrame([(k, -k, 1, holder) for k in keys], "h1 long, h2 long, n long, holder long")

    runs = lines.Runs(spark, str(tmp_path), 4)
    seen = {}
    for step in range(11):
        keys, holder = range(step, 60, step % 4 + 1), 100 - step
        for k in keys:
            n, first = seen.get(k, (0, holder))
            seen[k] = n + 1, first
        runs.add(batch(keys, holder))
        assert all(len(names) < lines.FAN for names in runs.levels)
        if step % 3 == 0:
            runs = lines.Runs(spark, str(tmp_path), 4, runs.told)
        assert {r.h1: (r.n, r.holder) for r in runs.merged().collect()} == seen
    two = runs.both(*(runs.read(name) for _, name in runs.told[:2]))._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in two and "Exchange" not in two and "Sort [" not in two


def test_large_components_are_exact(spark):
    rows = [(i, [2e6 + i, -1e6]) for i in range(15)] + [(20, [2e6, 3.5]), (40, [0.25, 2e6]), (60, [1e15, 1e3]), (80, [3e38, -3e38]), (100, [0.5, 0.5])]
    v = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    low, high = -(1 << 63), (1 << 63) - 1
    clip = lambda x: min(max(x, low), high)
    whole = {i: [clip(math.floor(64 * x)) for x in e] for i, e in rows}
    want = set()
    for q in (0, 20, 40, 60, 80, 100):
        scores = sorted((-clip(sum(a * b for a, b in zip(whole[q], whole[i], strict=True))), i) for i in whole if i != q)[:20]
        want |= {(q, k + 1, i, -s) for k, (s, i) in enumerate(scores)}
    assert {tuple(r) for r in topk.top_k(v, v.vec_id % 20 == 0).collect()} == want


def test_top_k(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(i, [0.5, -0.25]) for i in range(30)] + [(40, None), (60, [nan, 1.0]), (80, [inf, 1.0]), (100, [None, 1.0]), (120, [1.0]), (140, []), (160, []), (None, [1.0, 1.0]), (20, [0.5, -0.25])]
    v = spark.createDataFrame([(*r, 1) for r in rows], "vec_id long, embedding array<float>, score int")
    got = sorted(tuple(r) for r in topk.top_k(v, v.vec_id % 20 == 0).collect())
    q0 = [r for r in got if r[0] == 0]
    assert [r[2] for r in q0] == [*range(1, 20), 20] and {r[3] for r in q0} == {32 * 32 + 16 * 16}
    assert [r[2] for r in got if r[0] == 20] == list(range(20))
    assert [r for r in got if r[0] in (120, 140, 160)] == [(140, 1, 160, 0), (160, 1, 140, 0)]
    assert not {40, 60, 80, 100} & {r[0] for r in got}
    assert topk.top_k(v.limit(0), v.vec_id % 20 == 0).count() == 0
