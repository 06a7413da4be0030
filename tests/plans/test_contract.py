"""Minutes against their contract, tokens against their evidence, clusters by direction: whole cases and edges."""

from __future__ import annotations

import difflib
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from colloquy.operators import claims, contract, vectors
from colloquy.plans import text_queries

W = contract.CHINESE
GOOD = "\n".join([W.headings[0], W.headings[1], "### 1. a（00:00-10:00）", "- 现状：x", "- 讨论结果：y", W.headings[2], W.updates[0], W.updates[1], "| 00:00-00:10 | Ana | P | u |", W.headings[3], "- d", W.headings[4], W.actions[2]])


def breaches(spark, *docs):
    rows = spark.createDataFrame([(k, t, d, "kept") for k, (t, d) in enumerate(docs)], "k int, t string, d double, reason string")
    return sorted((r.k, r.reason, r.place, r.detail) for r in contract.breaches(rows, "k", "t", "d").collect())


def test_whole_minutes_break_nothing(spark):
    crlf = GOOD.replace("\n", "\r\n") + "\r\n\r\n"
    assert breaches(spark, (GOOD, 600.0), (crlf, 600.0), (GOOD, None), (GOOD, 0.0), (GOOD.replace("\n", "  \n　"), 599.5)) == []
    assert contract.breaches(spark.createDataFrame([], "k int, t string, d double"), "k", "t", "d").count() == 0


@pytest.mark.parametrize("text", [None, "", "\n\n", "x" * 200_000])
def test_no_headings(spark, text):
    got = [(r, d) for _, r, _, d in breaches(spark, (text, 9.0))]
    assert got == [("contract_version_mismatch", "project_updates_v4_required"), *sorted(("required_heading_count", f"{h}:0") for h in W.headings)]


@pytest.mark.parametrize(("old", "new", "duration", "want"), [
    ("10:00）", "10:60）", 600.0, [("topic_timestamp_invalid", 1)]),
    ("00:00-10:00）", "10:00-10:00）", 0.0, [("topic_invalid_range", 1)]),
    ("10:00）", "10:01）", 600.5, []),
    ("10:00）", "10:01）", 600.0, [("topic_range_out_of_bounds", 1)]),
    ("- 现状：x\n", "", 600.0, [("topic_missing_current_state", 1)]),
    ("- 讨论结果：y\n", "- 讨论结果：y\n### 2. b（55:00-56:00）\n- 现状：- 讨论结果：\n", 0.0, []),
    ("- 讨论结果：y\n", "- 讨论结果：y\n### 2. b（55:01-56:00）\n- 现状：- 讨论结果：\n", 0.0, [("topic_gap_too_large", 2)]),
    ("- d\n", " \n", 600.0, [("decisions_section_empty", None)]),
    ("| Ana |", "| Speaker_3 |", 600.0, [("project_updates_participant_unresolved", 1)]),
    ("| u |", "| u |\n|", 600.0, [("project_updates_row_column_count", 2)]),
    (W.actions[2], f"{W.actions[0]}\n{W.actions[1]}\n| 00:01-00:02 | i | {W.unassigned} |\n| 00:01-00:02 | i | Ana (today) |", 600.0, [("action_items_owner_contains_schedule", 2)]),
    (W.headings[4], "## Source\n" + W.headings[4], 600.0, [("forbidden_heading", None), ("unexpected_top_level_heading", None)]),
])
def test_one_rule(spark, old, new, duration, want):
    assert old in GOOD
    assert [(r, p) for _, r, p, _ in breaches(spark, (GOOD.replace(old, new), duration))] == want


def test_order_of_headings(spark):
    lines = GOOD.split("\n")
    moved = "\n".join(lines[:1] + lines[9:11] + lines[1:9] + lines[11:])
    assert breaches(spark, (moved, 600.0)) == [(0, "required_headings_out_of_order", None, None)]


def plain_grounded(token, evidence):
    token, evidence = (token or "").lower(), (evidence or "").lower()
    t, e = (re.sub(r"[^a-z0-9一-鿿]+", "", x) for x in (token, evidence))
    if t in e:
        return True
    if not re.fullmatch("[a-z0-9]{7,}", t):
        return False
    return any(len(w) >= 7 and abs(len(w) - len(t)) <= 2 and w[:4] == t[:4] and difflib.SequenceMatcher(None, t, w).ratio() >= 0.84 for w in re.findall("[a-z0-9]+", evidence))


def test_grounded(spark, sf_dir):
    cases = [("Kubernetes", "we run kubernetis now"), ("Kubernetes", "we run kubern"), ("Kubernetes", "k u b e r n e t e s"), ("api", "apo"), (None, None), ("", "x"), ("x", None), ("会议", "这次会议"), ("会议纪要的", "会议纪要"), ("postgres", "Postgress postgres1 posters"), ("a.b.c.d.e.f.g", "abcdefh abcdefgh")]
    got = spark.createDataFrame([(i, *c) for i, c in enumerate(cases)], "i int, t string, e string").select("i", claims.grounded(F.col("t"), F.col("e")).alias("g")).collect()
    assert {r.i: r.g for r in got} == {i: plain_grounded(*c) for i, c in enumerate(cases)}
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    got = text_queries.d17_grounded_tokens(spark, sf_dir).collect()
    assert len(got) == len(docs) and {r.grounded for r in got} == {True, False}
    assert all(r.grounded == plain_grounded(r.token, docs[r.doc_id]) for r in got)


def plain_cosine(x, k):
    x = [v / (np.linalg.norm(v) or 1) for v in x]
    k = min(k, len(x))
    c = [x[0]]
    while len(c) < k:
        c.append(x[min(range(len(x)), key=lambda i: (max(float(x[i] @ y) for y in c), i))])
    found = None
    for _ in range(60):
        now = [max(range(k), key=lambda j: (float(v @ c[j]), -j)) for v in x]
        if now == found:
            break
        found = now
        for j in range(k):
            own = [v for v, f in zip(x, found, strict=True) if f == j]
            if own:
                m = np.mean(own, axis=0)
                c[j] = m / (np.linalg.norm(m) or 1)
    return found


@pytest.mark.parametrize("seed", range(6))
def test_cosine_kmeans(seed):
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(rng.integers(1, 60), 5)) * rng.uniform(0.1, 50, size=(1, 1))
    if seed % 2:
        x[:: 3] = x[0]
    k = int(rng.integers(1, 6))
    assert vectors.cosine_kmeans(x, k).tolist() == plain_cosine(x, k)


def test_cosine_kmeans_of_zeros_and_scale():
    x = np.array([[1.0, 0], [5, 0], [0, 2], [0, 0], [0, 9]])
    assert vectors.cosine_kmeans(x, 2).tolist() == [0, 0, 1, 0, 1]
