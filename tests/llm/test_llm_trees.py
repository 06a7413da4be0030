"""Prefix BPE, Merkle manifest and whitening: brute force on the smallest tables, and every edge case that the docstrings name."""

from __future__ import annotations

import hashlib
import json
import random
import zlib

import numpy as np
import pytest

pytest.importorskip("colloquy.llm")
public_tokenizers = pytest.importorskip("public_tokenizers")
tokenizers = pytest.importorskip("tokenizers")

from pyspark.sql import functions as F  # noqa: E402

from colloquy.llm import merkle, prefixbpe, whitening  # noqa: E402
from colloquy.llm import queries as Q  # noqa: E402

from .test_llm_edges import docs, none  # noqa: E402, F401  (fixtures)

FILE = public_tokenizers.path("byte_bpe_50k.json")


def sha(b):
    return hashlib.sha256(b).hexdigest()


@pytest.fixture(scope="module")
def library():
    return tokenizers.Tokenizer.from_file(FILE)


@pytest.fixture(scope="module")
def codec():
    return prefixbpe.Codec(prefixbpe.read_vocabulary(FILE))


# prefix BPE


def encoded(codec, text):
    ids, _ = codec.coded([text], False)
    return ids.tolist()


def test_op11(spark, sf_dir, library):
    want = set()
    for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect():
        ids = library.encode(r.text or "", add_special_tokens=False).ids
        want.add((r.doc_id, len(ids), sha(np.array(ids, "<u4").tobytes()), sha(library.decode(ids, skip_special_tokens=False).encode())))
    assert {tuple(r) for r in Q.op11_prefix_dp_bpe(spark, sf_dir).collect()} == want


def test_prefix_bpe_on_random_texts(codec, library):
    rng = random.Random(3)
    parts = ["'s", "'re", " ", "  ", "\n", "<|endoftext|>", "the", " of", "tion", "aaaa", "....", "1234", "ß", "日", "🎉", "\x00", "\x85", "\x1f", " "]
    texts = ["".join(rng.choice(parts) for _ in range(rng.randrange(25))) for _ in range(400)]
    texts += ["".join(codec.v.texts[rng.randrange(50256)].decode("utf8", "ignore") for _ in range(12)) for _ in range(400)]
    texts += ["".join(rng.choice("ab") for _ in range(60)) for _ in range(200)]
    for text in texts:
        assert encoded(codec, text) == library.encode(text, add_special_tokens=False).ids, repr(text)


def test_last_tokens_of_all_prefixes(codec, library):
    word = b"internationalisationalism"
    last, _ = codec._last_tokens(np.frombuffer(word, np.uint8), np.array([0]), np.array([len(word)]))
    for n in range(1, len(word) + 1):
        assert codec.v.ids[last[n - 1]] == library.encode(word[:n].decode(), add_special_tokens=False).ids[-1]


def test_pairs_fit_as_merges_have_it(codec, library):
    rng = np.random.default_rng(0)
    fine = np.flatnonzero([len(t) > 1 and t.isascii() and t.isalpha() for t in codec.v.texts[:50256]])
    number = {int(i): k for k, i in enumerate(codec.v.ids)}
    a, b = rng.choice(fine, 800), rng.choice(fine, 800)
    got = codec.fits.side_by_side(np.array([number[i] for i in a]), np.array([number[i] for i in b]))
    for i, j, fits in zip(a.tolist(), b.tolist(), got.tolist(), strict=True):
        ids = library.encode((codec.v.texts[i] + codec.v.texts[j]).decode(), add_special_tokens=False).ids
        assert fits == (ids == [i, j])


def test_prefix_bpe_of_very_long_words(codec, library):
    for text in ("ab" * 20_000, "x" * 30_001, " " * 5_000, "é" * 3_000):
        assert encoded(codec, text) == library.encode(text, add_special_tokens=False).ids


def test_prefix_bpe_edges(spark, docs, none, library):  # noqa: F811
    rows = prefixbpe.encode_and_decode(docs, FILE).collect()
    given = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).collect()
    want = sorted((str(r.doc_id), np.array(library.encode(r.text, add_special_tokens=False).ids, "<u4").tobytes(), r.text) for r in given)
    assert sorted((str(r.doc_id), bytes(r.ids), r.decoded) for r in rows) == want
    assert prefixbpe.encode_and_decode(none, FILE).collect() == []


def test_small_tables_give_the_same(spark, sf_dir):
    some = spark.read.parquet(f"{sf_dir}/documents.parquet").limit(40)
    key = lambda df: {(r.doc_id, bytes(r.ids)) for r in df.collect()}
    assert key(prefixbpe.encode_and_decode(some, FILE)) == key(prefixbpe.encode_and_decode(some, FILE, share=0.00001))


def test_ids_that_are_no_utf8_decode_as_the_library_does(codec, library):
    for ids in ([127, 128, 129], [64, 160, 64], [221, 222], [50256, 64], []):
        assert "".join(codec.decode(np.array(ids, np.uint32))) == library.decode(ids, skip_special_tokens=False)


def changed(tmp_path, change):
    with open(FILE, encoding="utf-8") as f:
        data = json.load(f)
    data["model"]["merges"] = data["model"]["merges"][:300]
    change(data)
    path = tmp_path / "v.json"
    path.write_text(json.dumps(data), encoding="utf-8")
    return str(path)


@pytest.mark.parametrize("change", [lambda d: d["model"].update(dropout=0.1), lambda d: d["model"].update(byte_fallback=True), lambda d: d["model"]["merges"].reverse(), lambda d: d.update(normalizer={"type": "NFC"}), lambda d: d["pre_tokenizer"].update(add_prefix_space=True)])
def test_other_vocabularies_are_refused(tmp_path, change):
    with pytest.raises(ValueError):
        prefixbpe.read_vocabulary(changed(tmp_path, change))


def test_vocabulary_without_merges(tmp_path):
    path = changed(tmp_path, lambda d: d["model"].update(merges=[]))
    assert encoded(prefixbpe.Codec(prefixbpe.read_vocabulary(path)), "abc d") == [64, 65, 66, 220, 67]


def test_suffix_automaton_has_all_factors():
    words = [b"abcbc", b"bcab", b"aaa", b"b"]
    step, link, length, ends = prefixbpe.suffix_automaton(words)

    def state(s):
        at = 0
        for c in s:
            if c not in step[at]:
                return None
            at = step[at][c]
        return at

    factors = {w[i:j] for w in words for i in range(len(w)) for j in range(i + 1, len(w) + 1)}
    for a in b"abc":
        for b in b"abc":
            for c in b"abc":
                for s in (bytes([a]), bytes([a, b]), bytes([a, b, c])):
                    assert (state(s) is not None) == (s in factors)
    assert [length[e] for e in ends] == [len(w) for w in words] and link[0] == -1


# Merkle manifest


def h(*parts):
    return sha("".join(parts).encode())


def leaf(r, more=0):
    n = None if r.n_chars is None else r.n_chars + more
    return h(*["-" if v is None else f"{len(str(v).encode())}:{v}" for v in (r.doc_id, r.source, r.lang, n, r.text)])


def slow_tree(hashes, arity):
    rows = [hashes]
    while len(rows[-1]) > 1:
        rows.append([h(*rows[-1][i : i + arity]) for i in range(0, len(rows[-1]), arity)])
    return rows


def slow_path(rows, i, arity):
    out = []
    for row in rows[:-1]:
        first = i - i % arity
        out.append((row[first:i], row[i + 1 : first + arity]))
        i //= arity
    return out


def slow_manifest(rows, arity=2, tamper=lambda r: r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % 7 == 0):
    langs = sorted({r.lang for r in rows}, key=lambda v: (v is not None, (v or "").encode()))
    own = {v: sorted((r for r in rows if r.lang == v), key=lambda r: (r.doc_id is not None, r.doc_id or 0, leaf(r))) for v in langs}
    trees = {v: slow_tree([leaf(r) for r in own[v]], arity) for v in langs}
    crown = slow_tree([trees[v][-1][0] for v in langs], arity)
    root, out = crown[-1][0], []
    for k, v in enumerate(langs):
        for i, r in enumerate(own[v]):
            path = slow_path(trees[v], i, arity) + slow_path(crown, k, arity)
            folded = leaf(r, 1 if tamper(r) else 0)
            for left, right in path:
                folded = h(*left, folded, *right)
            out.append((r.doc_id, leaf(r), trees[v][-1][0], root, h(*[s for left, right in path for s in (*left, *right)]), folded, folded == root))
    return sorted(out, key=str)


def test_op12(spark, sf_dir):
    rows = spark.read.parquet(f"{sf_dir}/documents.parquet").collect()
    got = sorted(map(tuple, Q.op12_pregel_merkle_manifest(spark, sf_dir).collect()), key=str)
    assert got == slow_manifest(rows) and 0 < sum(r[-1] for r in got) < len(got)


@pytest.mark.parametrize(("arity", "block"), [(2, 1), (2, 3), (3, 2), (5, 8)])
def test_manifest_edges(spark, docs, arity, block):  # noqa: F811
    suspect = merkle.leaf([F.col(c) + F.when(merkle.tampered(docs), 1).otherwise(0) if c == "n_chars" else F.col(c) for c in merkle.FIELDS])
    got = sorted(map(tuple, merkle.manifest(docs, suspect, arity, block).collect()), key=str)
    assert got == slow_manifest(docs.collect(), arity)


def test_manifest_of_many_trees_and_sizes(spark):
    """Trees of 0 to 40 leaves, so that tops lie in different supersteps."""
    rows = [(i * 50 + j, f"t{i}", f"l{i:02}", j, "x" * j) for i in range(1, 20) for j in range(i * 2 + i % 3)] + [(9999, None, None, None, None)]
    data = spark.createDataFrame(rows, "doc_id long, source string, lang string, n_chars long, text string").repartition(7)
    got = sorted(map(tuple, merkle.manifest(data, block=2).collect()), key=str)
    assert got == slow_manifest(data.collect(), tamper=lambda r: False) and all(r[-1] for r in got)


def test_manifest_of_one_row_and_of_none(spark, docs, none):  # noqa: F811
    one = docs.where("doc_id = 8")
    (r,) = merkle.manifest(one).collect()
    assert r.leaf == r.subroot == r.root == r.folded_root == leaf(one.first()) and r.verified and r.proof_sha256 == h()
    assert merkle.manifest(none).collect() == []


def test_any_changed_field_is_found(spark, docs):  # noqa: F811
    for field, value in (("text", F.lit("other")), ("lang", F.lit("xx")), ("source", F.lit(None).cast("string")), ("doc_id", F.col("doc_id") + 100)):
        suspect = merkle.leaf([F.when(F.col("doc_id") == 4, value).otherwise(F.col(c)) if c == field else F.col(c) for c in merkle.FIELDS])
        assert {r.doc_id for r in merkle.manifest(docs, suspect).collect() if not r.verified} == {4}, field


# whitening


def slow_whitening(rows, k=32):
    fine = [(r.vec_id, r.embedding) for r in rows if r.embedding is not None and all(c is not None and np.isfinite(c) for c in r.embedding)]
    x = np.floor(64 * np.array([v for _, v in fine], np.float64)).astype(np.int64) + 1_000_000
    n, s = len(x), x.sum(0)
    off = x - s / n
    e, u = np.linalg.eigh(off.T @ off / n)
    e, u = e[::-1], u[:, ::-1]
    return [i for i, _ in fine], n, ((n * x - s) ** 2).sum(1), off @ u[:, :k] / np.sqrt(e[:k]), e / e.sum()


def check(got, rows, k=32):
    ids, n, deviation, white, explained = slow_whitening(rows, k)
    assert len(got) == len(ids) * k and {r.n for r in got} == {n}
    assert max(r.identity_error for r in got) <= 1e-4
    deviations, table = dict(zip(ids, deviation.tolist(), strict=True)), {(r.vec_id, r.component): r for r in got}
    assert all(r.deviation == deviations[r.vec_id] and abs(r.explained - explained[r.component - 1]) <= 1e-10 * explained[r.component - 1] for r in got)
    ours = np.array([[table[i, c].whitened for c in range(1, k + 1)] for i in ids])
    assert np.abs(ours * np.sign((ours * white).sum(0)) - white).max() < 1e-8


def test_op13(spark, sf_dir):
    check(Q.op13_lobpcg_whitening(spark, sf_dir).collect(), spark.read.parquet(f"{sf_dir}/embeddings.parquet").collect())


def test_whitening_edges(spark):
    rng = np.random.default_rng(5)
    rows = [(i, [float(c) for c in v], "x") for i, v in enumerate(rng.normal(size=(60, 5)) * [9, 5, 3, 2, 1])]
    bad = [(100, None, "x"), (101, [1.0, None, 1.0, 1.0, 1.0], "x"), (102, [float("nan")] * 5, "x"), (103, [float("-inf"), 1.0, 1.0, 1.0, 1.0], "x"), (104, [1.0, 2.0], "x"), (105, [], "x")]
    data = spark.createDataFrame(rows + rows[:1] + bad, "vec_id long, embedding array<double>, x string")
    got = whitening.whiten(data)
    assert got.columns == ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"]
    got = got.collect()
    assert len(got) == 61 * 5 and {r.vec_id for r in got} == set(range(60)) and {r.n for r in got} == {61}
    assert got[0].identity_error < 1e-12 and abs(sum({r.component: r.explained for r in got}.values()) - 1) < 1e-12
    nobody = data.withColumn("vec_id", F.lit(None).cast("long"))
    assert len(whitening.whiten(nobody).collect()) == 61 * 5


def test_whitening_without_variance(spark):
    of = lambda rows: whitening.whiten(spark.createDataFrame(rows, "vec_id long, embedding array<float>")).collect()
    assert of([]) == of([(1, [1.0, 2.0])]) == of([(1, [1.0, 2.0]), (2, [1.0, 2.0])]) == of([(1, [])]) == []
    line = of([(i, [float(i), 2.0 * i, 1.0]) for i in range(6)])
    assert {r.component for r in line} == {1} and abs(line[0].explained - 1) < 1e-12


def test_huge_entries_stand_at_the_limit(spark):
    rows = [(1, [1e300, 0.0]), (2, [-1e300, 1.0]), (3, [0.0, 0.5])]
    got = whitening.whiten(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect()
    x = [(1 << 61) + 1_000_000, -(1 << 61) + 1_000_000, 1_000_000]
    assert all(np.isfinite(r.whitened) for r in got)
    for r in got:
        exact = (3 * x[r.vec_id - 1] - sum(x)) ** 2
        assert r.deviation == (1 << 63) - 1 if exact > 1 << 63 else r.deviation - exact >= 0


def test_lobpcg_without_spark():
    rng = np.random.default_rng(1)
    q, _ = np.linalg.qr(rng.normal(size=(300, 300)))
    e = np.concatenate(([50.0, 50.0, 49.999], np.linspace(20, 0.01, 297)))
    v = (q * e) @ q.T
    u, values, residuals, iterations = whitening.lobpcg(lambda b: v @ b, 300, 8)
    assert np.abs(values - e[:8]).max() < 1e-11 and residuals.max() <= 1e-10 * 50 and iterations > 3
    assert np.abs(u.T @ u - np.eye(8)).max() < 1e-12
    assert np.abs(np.abs(u[:, 3:].T @ q[:, 3:8]) - np.eye(5)).max() < 1e-9
    with pytest.raises(ArithmeticError):
        whitening.lobpcg(lambda b: v @ b, 300, 8, most=2)
