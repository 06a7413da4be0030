"""Each query against a brute-force version on the smallest tables."""

from __future__ import annotations

import hashlib
import zlib
from collections import defaultdict

import numpy as np
import pytest

pytest.importorskip("colloquy.llm")
public_tokenizers = pytest.importorskip("public_tokenizers")
xxhash = pytest.importorskip("xxhash")

from colloquy.llm import queries as Q  # noqa: E402


def sha(data: bytes) -> str:
    return hashlib.sha256(data).hexdigest()


@pytest.fixture(scope="module")
def docs(spark, sf_dir):
    rows = spark.read.parquet(f"{sf_dir}/documents.parquet").collect()
    return {r.doc_id: r.text or "" for r in rows}


def covered(items, window, seen):
    mask = [False] * len(items)
    for i in range(len(items) - window + 1):
        key = items[i : i + window]
        if key in seen:
            mask[i : i + window] = [True] * window
        seen.add(key)
    return mask


def runs(mask):
    return sum(m and not (i and mask[i - 1]) for i, m in enumerate(mask))


def test_op1(spark, sf_dir):
    rows = spark.read.parquet(f"{sf_dir}/embeddings.parquet").collect()
    ids = np.array([r.vec_id for r in rows])
    v = np.floor(64 * np.array([r.embedding for r in rows], float)).astype(int)
    want = set()
    for i in np.flatnonzero(ids % 20 == 0):
        s = v @ v[i]
        others = np.flatnonzero(ids != ids[i])
        best = others[np.lexsort((ids[others], -s[others]))][:20]
        want |= {(int(ids[i]), k + 1, int(ids[j]), int(s[j])) for k, j in enumerate(best)}
    assert {tuple(r) for r in Q.op1_vector_approximation_top_k(spark, sf_dir).collect()} == want


def test_op2(spark, sf_dir, docs):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    want, start = set(), 0
    for d in sorted(docs):
        ids = t.encode(docs[d], add_special_tokens=False).ids + [0]
        want.add((d, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    assert {tuple(r) for r in Q.op2_wavelet_token_files(spark, sf_dir).collect()} == want


def test_op3(spark, sf_dir):
    sf_dir = sf_dir.replace("sf0.001", "sf0.01")  # the smallest tables label too few rows to learn from
    rows = {r.doc_id: r for r in Q.op3_naive_bayes_svm_quality(spark, sf_dir).collect()}
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{sf_dir}/labels.parquet").collect()}
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.7) for r in rows.values())
    assert all(r.held_out == (zlib.crc32(str(d).encode()) % 4 == 2) for d, r in rows.items())
    held = [(rows[d].predicted, q) for d, q in labels.items() if rows[d].held_out]
    assert sum(p == q for p, q in held) >= 0.9 * len(held)


def test_op5(spark, sf_dir, docs):
    seen, want = set(), set()
    for d in sorted(docs):
        data = docs[d].encode()
        mask = covered(data, 100, seen)
        want.add((d, len(data), sum(mask), runs(mask), sha(bytes(b for b, m in zip(data, mask, strict=True) if not m))))
    assert {tuple(r) for r in Q.op5_suffix_interval_dedup(spark, sf_dir).collect()} == want


def test_op6(spark, sf_dir, docs):
    got = {r.doc_id: r for r in Q.op6_robust_outlier_rules(spark, sf_dir).collect()}
    assert got.keys() == docs.keys()
    for d, text in docs.items():
        words = text.encode().split()
        at = defaultdict(list)
        for i in range(len(words) - 2):
            at[tuple(words[i : i + 3])].append(i)
        repeated = {i + k for v in at.values() if len(v) > 1 for i in v for k in range(3)}
        rows = [x for x in text.split("\n") if x.encode().split()]
        chars = sum(len(w.decode()) for w in words)
        symbols = sum(c in "#*$%&|<>" for c in text)
        base = len(words) < 50 or 100 * len(repeated) > 50 * len(words)
        r = got[d]
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) == (len(words), chars, symbols, len(rows) - len(set(rows)), len(repeated), base)
        assert not (r.base_failed and r.kept)


def test_op7(spark, sf_dir, docs):
    seen, want = set(), set()
    for d in sorted(docs):
        words = tuple(docs[d].encode().split())
        mask = covered(words, 20, seen)
        want.add((d, len(words), sum(mask), sha(b" ".join(w for w, m in zip(words, mask, strict=True) if not m))))
    assert {tuple(r) for r in Q.op7_fm_index_dedup(spark, sf_dir).collect()} == want


def test_op8(spark, sf_dir, docs):
    tiktoken = pytest.importorskip("tiktoken")
    from colloquy.llm.bpe import read_ranks

    t = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=read_ranks(public_tokenizers.path("byte_bpe_multi_50k.tiktoken")), special_tokens={})
    want = set()
    for d, text in docs.items():
        ids = t.encode_ordinary(text)
        want.add((d, len(ids), sha(",".join(map(str, ids)).encode()), sha(t.decode_bytes(ids))))
    assert {tuple(r) for r in Q.op8_transducer_bpe(spark, sf_dir).collect()} == want


def slow_fingerprint(text: str) -> int:
    words = text.encode().lower().split()
    if not words:
        return 0
    k = min(3, len(words))
    h = [xxhash.xxh64_intdigest(b" ".join(words[i : i + k]), 42) for i in range(len(words) - k + 1)]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def slow_components(fps: dict[int, int]) -> dict[int, int]:
    ids = sorted(fps)
    root = {d: d for d in ids}

    def find(d):
        while root[d] != d:
            d = root[d]
        return d

    x = np.array([fps[d] for d in ids], np.uint64)
    for i, d in enumerate(ids):
        for j in np.flatnonzero(np.bitwise_count(x[i] ^ x[i + 1 :]) <= 3) + i + 1:
            a, b = sorted((find(d), find(ids[j])))
            root[b] = a
    return {d: find(d) for d in ids}


def test_op9(spark, sf_dir, docs):
    fps = {d: slow_fingerprint(t) for d, t in docs.items()}
    root = slow_components(fps)
    assert {tuple(r) for r in Q.op9_gray_simhash(spark, sf_dir).collect()} == {(d, f"{fps[d]:016x}", root[d]) for d in docs}


def test_queries_match_oracle_sql(spark, sf_dir, duck):
    for name, sql in Q_ORACLE.items():
        got = Q.queries()[name](spark, sf_dir).toPandas()
        want = duck.execute(sql).df()
        columns = sorted(want.columns)
        assert columns == sorted(got.columns)
        a, b = (sorted(map(tuple, x[columns].astype(str).to_numpy())) for x in (got, want))
        assert a == b, name


from colloquy.llm.oracle import oracle_sql  # noqa: E402

Q_ORACLE = oracle_sql()
