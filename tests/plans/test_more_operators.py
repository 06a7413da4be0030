"""Literal rows for authority, boxes, sampling, claims and ranges: empty input, nulls, ties, values at thresholds."""

from __future__ import annotations

import itertools

import pytest
from pyspark.sql import functions as F

from colloquy.functions import columns as C
from colloquy.operators import authority, boxes, claims, intervals, ledger, sampling, sequences, vectors, votes

PEOPLE = "id int, name string, name_source string, confidence long, confirmed boolean"


def test_authority(spark):
    rows = spark.createDataFrame([
        (1, "Ana", "manual_review", 600, None), (2, "Ana", "visual_active_speaker_highlight", 999, None), (3, "Ana", "visual_active_speaker_highlight", 999, True),
        (4, "Speaker 2", "manual_review", 999, None), (5, None, "participant_map", None, None), (6, "Bo", None, 599, None), (7, "Bo", "reviewed_by_x", 600, None), (8, "Bo", "participant_map", 600, None)], PEOPLE)
    got = {r.id: tuple(r)[1:] for r in rows.select("id", authority.trusted(), authority.human_reviewed(), authority.locked(), authority.protected()).collect()}
    assert got == {1: (True, True, True, True), 2: (False, False, False, True), 3: (True, False, False, True), 4: (False, True, True, True), 5: (False,) * 4, 6: (False,) * 4, 7: (True, True, True, True), 8: (True, True, False, True)}
    assert {r.id for r in authority.retracted(rows, ["participant_map"]).where("name IS NULL").collect()} == {5, 8}
    names = spark.createDataFrame([(1, "ana ", 700), (2, "Cy", 700), (6, "Cy", 700)], "id int, to string, sure long")
    out = {r.id: (r.name, r.conflict) for r in authority.proposed(rows, names, ["id"], "ocr", authority.protected()).collect()}
    assert (out[1], out[2], out[6], out[8]) == (("Ana", None), ("Ana", "Cy"), ("Cy", None), ("Bo", None))
    assert authority.proposed(rows.limit(0), names, ["id"], "ocr", authority.protected()).count() == 0


def test_boxes(spark):
    box = lambda *v: tuple(map(F.lit, v))
    a, b, none = box(0, 0, 10, 10), box(0, 0, 10, 5), box(3, 3, 3, 3)
    r = spark.range(1).select(boxes.union_share(a, b), boxes.share_of_smaller(a, b), boxes.inside(b, a), boxes.union_share(a, none), boxes.share_of_smaller(a, none), boxes.flipped(b, F.lit(10))[1]).first()
    assert tuple(r) == (0.5, 1.0, True, 0.0, 0.0, 5)


@pytest.mark.parametrize(("n", "want"), [(0, []), (449, []), (450, [(0, 450)]), (1600, [(0, 1600)]), (1601, [(0, 1600), (1, 1601)]), (2400, [(0, 1600), (800, 2400)]), (2500, [(0, 1600), (800, 2400), (900, 2500)])])
def test_sliding_ends_with_the_interval(spark, n, want):
    rows = spark.createDataFrame([(0, n)], "start_ms long, end_ms long")
    assert sorted((r.a, r.b) for r in sampling.sliding(rows).collect()) == want


def test_samples_and_windows_stay_inside(spark):
    rows = spark.createDataFrame([(1, 0, 0), (2, 0, 8), (3, 0, 16), (4, 0, 17)], "id int, start_ms long, end_ms long")
    got = {k: [r.at for r in g] for k, g in itertools.groupby(sampling.requests(rows, 8).orderBy("id", "at").collect(), lambda r: r.id)}
    assert got == {1: [0], 2: [4], 3: [4, 11], 4: [3, 8, 13]}
    assert sampling.requests(rows, 8, 2).where("id = 4").count() == 2
    long = spark.createDataFrame([(1, 0, 100), (2, 0, 600), (3, 0, 9000)], "id int, start_ms long, end_ms long")
    w = sampling.in_segments(long).collect()
    assert sorted(r.id for r in w) == [2, 3, 3]
    assert all(r.start_ms <= r.a < r.b <= r.end_ms for r in w)


def test_claims(spark):
    texts = spark.createDataFrame([(1, ""), (2, None), (3, "see www.x {y}"), (4, "x" * 11)], "id int, text string")
    assert {r.id: r.r for r in texts.select("id", claims.text_errors(F.col("text"), 10).alias("r")).collect()} == {1: ["empty"], 2: [], 3: ["too_long", "web_address", "markup"], 4: ["too_long"]}
    rows = spark.createDataFrame([("a", "x", 1), ("a", "x", 2), ("a", "z", 3)], "rec string, section string, i int")
    assert {(r.i, r.place, r.reason) for r in claims.capped(rows, ["rec"], "section", ["i"], {"x": 1}).collect()} == {(1, 1, None), (2, 2, "section_full"), (3, 1, "section_unknown")}
    k = lambda *v: spark.createDataFrame([(x,) for x in v], "k int")
    assert {tuple(r) for r in claims.exact_cover(k(1, 2, 2, 3), k(2, 2, 3, 4), "k").collect()} == {(1, "missing"), (2, "repeated"), (4, "unknown")}
    assert claims.exact_cover(k().limit(0), k().limit(0), "k").count() == 0
    r = spark.createDataFrame([(1, 0, 10), (1, 9, 20), (1, 51, 52)], "rec int, start_ms long, end_ms long")
    assert {(x.start_ms, x.reason) for x in claims.partition_errors(r, ["rec"], 30, 2).collect()} == {(9, "overlap"), (51, "gap"), (51, "short")}
    c = spark.createDataFrame([("e:3",), ("e:4:v:w",), ("f:5",), ("e:x",), (None,)], "code string")
    assert {tuple(x) for x in claims.coded(c, "e").collect()} == {(3, None), (4, "v:w")}
    said = spark.createDataFrame([(1, "7 of 9"), (2, "none"), (3, None)], "k int, text string")
    assert [tuple(x) for x in claims.ungrounded_numbers(said, spark.createDataFrame([(1, "9")], "k int, text string"), "k").collect()] == [(1, ["7"])]


def test_runs_and_ranges(spark):
    rows = spark.createDataFrame([(1, i, v) for i, v in enumerate([1, 1, 0, 1, 1, 1, None])], "rec int, i int, v int")
    assert [(r.first, r.last, r.n) for r in sequences.runs(rows, ["rec"], ["i"], F.col("v") == 1, 3).collect()] == [(3, 5, 3)]
    r = spark.createDataFrame([(1, 0, 5), (1, 4, 8), (1, 6, 7)], "rec int, first long, last long")
    assert sorted((x.first, x.last) for x in sequences.without_overlap(r, ["rec"]).collect()) == [(0, 5), (6, 7), (6, 8)]
    s = spark.createDataFrame([(1, 0, 0), (1, 1, 0), (1, 2, 1)], "rec int, ord long, chunk long")
    assert sorted(tuple(x) for x in sequences.supplied(s, ["rec"], "ord", 1).collect()) == [(1, 0, 0, 1, 0, 2), (1, 1, 2, 2, 1, 2)]


def test_long_parts_against_all_partitions(spark):
    cases = [[(0, 2), (1, 3), (2, 4), (3, 5), (4, 6), (5, 7)], [(0, 2), (3, 5), (3, 5), (9, 11), (10, 12), (11, 13)], [(0, 2)], [(0, 9)], [(0, 9), (20, 19)]]
    rows = spark.createDataFrame([(c, a, b) for c, ranges in enumerate(cases) for a, b in ranges], "c int, start_ms long, end_ms long")
    got = {r.c: r.parts for r in sequences.long_parts(rows, "c", 4.0).collect()}
    for c, ranges in enumerate(cases):
        n, best = len(ranges), 0
        for cuts in itertools.product([0, 1], repeat=n - 1):
            edges = [0, *[i + 1 for i, x in enumerate(cuts) if x], n]
            if all(b >= a for a, b in ranges) and all(ranges[b - 1][1] - ranges[a][0] >= 4 for a, b in itertools.pairwise(edges)):
                best = max(best, len(edges) - 1)
        assert got[c] == best


def test_sampled_votes(spark):
    f = spark.createDataFrame([(1, "a", 500), (1, "b", 500), (1, None, 0), (2, None, 0), (3, "c", 900), (3, "c", 700)], "rec int, name string, score long")
    got = {r.rec: (r.name, r.votes, r.of, r.outcome) for r in votes.sampled(f, ["rec"], False, 1, 60, F.lit(1)).collect()}
    assert got == {1: ("a", 1, 2, "mixed"), 3: ("c", 2, 2, "named")}
    assert {r.rec: r.of for r in votes.sampled(f, ["rec"], True, 1, 60, F.lit(1)).collect()} == {1: 3, 3: 2}


def test_contained_takes_the_first(spark):
    a = spark.createDataFrame([(1, 5, 8), (1, 5, 50)], "rec int, start_ms long, end_ms long")
    b = spark.createDataFrame([(1, 4, 9), (1, 0, 8)], "rec int, start_ms long, end_ms long")
    assert [(r.end_ms, r.in_a, r.in_b) for r in intervals.contained(a, b, ["rec"]).collect()] == [(8, 0, 8)]


def test_colliding_profiles(spark):
    p = spark.createDataFrame([(1, [3, 4]), (2, [6, 8]), (3, [-4, 3]), (4, [0, 0])], "label int, sums array<bigint>")
    assert sorted(r.label for r in vectors.colliding(p, 0.985).collect()) == [1, 2]


def test_top_char_share(spark):
    t = spark.createDataFrame([("a b\na",), ("",), (None,), (" \n",), ("😀😀é",)], "t string")
    assert [tuple(r) for r in t.select(*C.top_char_share(F.col("t"))).collect()] == [(2, 3), (0, 0), (0, 0), (0, 0), (2, 3)]


def test_published_items_with_an_unknown_candidate(spark):
    known = spark.createDataFrame([("x", "Do it", ["a"], [5])], "id string, quote string, topics array<string>, durations array<long>")
    items = spark.createDataFrame([("i", "x", "do  it", ["a"], []), ("j", "y", "do it", ["b"], [9])], "item string, id string, text string, topics array<string>, minutes array<long>")
    assert {r.item: r.reasons for r in ledger.published_errors(items, known).collect()} == {"i": [], "j": ["candidate_unknown"]}


def test_conditional_cues_of_whole_texts(spark):
    from colloquy.operators.actions import conditional_cues

    far = "x" * 200 + ". If it rains we will stay. They shall go. "
    text = far + "if " + "y" * 100 + " must"
    rows = [(0, 0, text), (0, 1, "will"), (0, 2, ""), (0, 3, None), (0, 4, "If goodwill counts, you must")]
    got = {(r.ord, r.cue_at, r.conditional) for r in conditional_cues(spark.createDataFrame(rows, "rec long, ord long, text string"), r"(?i)\b(?:will|must|shall)\b").collect()}
    at = lambda w, t=text: t.index(w) + 1
    assert got == {(0, at("will"), True), (0, at("shall"), False), (0, at("must"), False), (1, 1, False), (4, at("must", rows[4][2]), True)}
