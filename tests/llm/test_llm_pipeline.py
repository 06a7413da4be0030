"""The pipeline's stages against plain versions, each on its own input."""

from __future__ import annotations

import hashlib
from collections import Counter, defaultdict

import pytest

pytest.importorskip("colloquy.llm")
pipeline = pytest.importorskip("corpus_pipeline")
tiktoken = pytest.importorskip("tiktoken")

import public_tokenizers  # noqa: E402

from colloquy.llm import bpe, quality  # noqa: E402

from .test_llm_queries import slow_components, slow_fingerprint  # noqa: E402


@pytest.fixture(scope="module")
def stages(spark, sf_dir, tmp_path_factory):
    docs, out = spark.read.parquet(f"{sf_dir}/documents.parquet"), []
    for k, (_, f) in enumerate(pipeline.STAGES):
        path = str(tmp_path_factory.mktemp("stages") / str(k))
        f(spark, docs, sf_dir).write.parquet(path)
        after = spark.read.parquet(path)
        out.append((docs, after))
        docs = after
    return out


def test_columns(stages):
    for before, after in stages[:-1]:
        assert after.dtypes == before.dtypes


def test_classifier(spark, sf_dir, stages):
    before, after = stages[0]
    model = quality.fit(before, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    assert {r.doc_id for r in after.collect()} == {r.doc_id for r in before.collect() if model.score(quality.features(r.text)) >= 0.7}


def test_line_dedup(stages):
    before, after = stages[1]
    blank, lower = " \t\n\x0b\x0c\r", str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    key = lambda x: x.strip(blank).translate(lower)
    rows = {r.doc_id: r.text for r in before.collect()}
    holders = defaultdict(set)
    for d, t in rows.items():
        for x in t.split("\n"):
            holders[key(x)].add(d)
    want = {d: "\n".join(x for x in t.split("\n") if len(key(x)) < 20 or len(holders[key(x)]) < 3 or d == max(holders[key(x)])) for d, t in rows.items()}
    assert {r.doc_id: (r.text, r.n_chars) for r in after.collect()} == {d: (t, len(t)) for d, t in want.items()}


def test_near_dedup(stages):
    before, after = stages[2]
    root = slow_components({r.doc_id: slow_fingerprint(r.text) for r in before.collect()})
    assert sorted(r.doc_id for r in after.collect()) == sorted(set(root.values()))


def test_mix(stages):
    before, after = stages[3]
    size = {r.doc_id: (r.source, len(r.text.encode().split())) for r in before.collect()}
    copies = Counter(r.doc_id for r in after.collect())
    assert max(copies.values()) <= 2 and set(copies) <= set(size)
    assert abs(sum(size[d][1] * n for d, n in copies.items()) - 1.5 * sum(n for _, n in size.values())) <= max(n for _, n in size.values())


def test_encoding(stages):
    before, after = stages[4]
    t = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=bpe.read_ranks(public_tokenizers.path("byte_bpe_multi_50k.tiktoken")), special_tokens={})
    want = sorted((r.doc_id, len(t.encode_ordinary(r.text)), hashlib.sha256(r.text.encode()).hexdigest()) for r in before.collect())
    assert sorted((r.doc_id, r.n_tokens, r.decoded_sha256) for r in after.collect()) == want


def test_run_is_the_stages(spark, sf_dir, stages):
    assert sorted(map(tuple, pipeline.run(spark, sf_dir).collect())) == sorted(map(tuple, stages[-1][1].collect()))


def test_stages_keep_rows_of_any_kind(spark, tmp_path):
    """Null and repeated ids, null texts and columns with the stages' own names, through line dedup, near-dedup and mixing; and no rows."""
    schema = "doc_id long, text string, lang string, source string, n_chars long, copies int, __n int, __doc int, __id int, __row int, __hash int, __copy int, kept int, `row` int, nth int"
    texts = [" ".join(f"{k:03d}x{i}" for k in range(60)) for i in range(6)]
    ids = [None, None, None, 7, 7, 7]
    rows = [(d, t, "en", "s", len(t), *range(10)) for d, t in zip(ids, texts, strict=True)] + [(None, None, None, None, None, *range(10)), (1, "", "en", "s", 0, *range(10))]
    docs = spark.createDataFrame(rows, schema)
    for name, f in pipeline.STAGES[1:4]:
        out = f(spark, docs, "")
        assert out.dtypes == docs.dtypes, name
        got = {tuple(r) for r in out.collect()}
        assert got <= set(rows) and {r[1] for r in got} >= set(texts), name
        assert f(spark, docs.limit(0), "").count() == 0
    kept = sorted(map(str, pipeline.one_of_copies(spark, docs, "").collect()))
    assert len(kept) == 7  # the null and the empty text are copies
    assert pipeline.encode(spark, docs, "").count() == len(rows)
    labels = "doc_id long, quality int, toxic int"
    docs.limit(0).select("doc_id", "text", "lang", "source", "n_chars").write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([], labels).write.parquet(str(tmp_path / "labels.parquet"))
    assert pipeline.run(spark, str(tmp_path)).count() == 0
