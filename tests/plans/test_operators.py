"""Literal rows: empty input, ties, touching intervals, values at thresholds."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from colloquy.functions import columns as C
from colloquy.operators import gates, intervals, ledger, sequences, vectors, votes
from colloquy.streaming import windows


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first().x


@pytest.mark.parametrize(("s", "want"), [(0.5, "00:00"), (1.5, "00:02"), (59.6, "01:00"), (3599.5, "01:00:00"), (3661.0, "01:01:01")])
def test_clock(spark, s, want):
    assert one(spark, C.clock(F.lit(s))) == want


@pytest.mark.parametrize(("s", "want"), [("01:02", 62), ("1:00:00", 3600), ("00:60", None), ("x", None), (None, None)])
def test_seconds(spark, s, want):
    assert one(spark, C.seconds(F.lit(s).cast("string"))) == want


@pytest.mark.parametrize(("name", "want"), [("Ana", True), ("Speaker 1", False), ("unknown", False), (" ", False), (None, False)])
def test_is_named(spark, name, want):
    assert one(spark, C.is_named(F.lit(name).cast("string"))) is want


def test_wilson_and_cosine(spark):
    assert one(spark, C.wilson(F.lit(0), F.lit(0))) == 0
    assert one(spark, C.wilson(F.lit(9), F.lit(10))) == pytest.approx(0.5958, abs=1e-4)
    assert one(spark, C.cosine(F.array(F.lit(0.0)), F.array(F.lit(1.0)))) == -1


def test_touching_intervals_do_not_overlap(spark):
    a = spark.createDataFrame([(1, 0, 10), (1, 10, 10), (1, 5, 200_000)], "rec int, start_ms long, end_ms long")
    b = spark.createDataFrame([(1, 10, 20), (1, 150_000, 150_001), (2, 0, 9)], "rec int, start_ms long, end_ms long")
    got = {tuple(r) for r in intervals.overlap_join(a, b, ["rec"]).select("start_ms", "r_start_ms", "shared").collect()}
    assert got == {(5, 10, 10), (5, 150_000, 1)}


def test_speaker_tie_goes_to_the_first_turn(spark):
    s = spark.createDataFrame([(1, 0, "x", "t", 0, 10)], "rec int, ord int, speaker string, text string, start_ms long, end_ms long")
    t = spark.createDataFrame([(1, 1, "b", 5, 10, 1), (1, 0, "c", 0, 5, 1)], "rec int, turn int, speaker string, start_ms long, end_ms long, conf int")
    assert intervals.attach_speakers(s, t).first().speaker == "c"
    assert intervals.attach_speakers(s.limit(0), t).count() == 0


def test_merged_touching(spark):
    r = spark.createDataFrame([(1, 0, 5), (1, 5, 8), (1, 9, 10)], "rec int, start_ms long, end_ms long")
    assert sorted((x.start_ms, x.end_ms, x.n) for x in intervals.merged(r, ["rec"]).collect()) == [(0, 8, 2), (9, 10, 1)]


def test_greedy_is_independent_of_input_order(spark):
    for ts in ([0, 19, 20, 41], [41, 20, 0, 19]):
        r = spark.createDataFrame([(1, t) for t in ts], "rec int, t long")
        assert sequences.greedy(r, ["rec"], "t", 20).first().kept == [0, 20, 41]
        assert sequences.greedy(r, ["rec"], "t", 20, inclusive=False).first().kept == [0, 41]


def test_packing_lets_one_large_row_stand_alone(spark):
    r = spark.createDataFrame([(1, 0, 9), (1, 1, 30), (1, 2, 1)], "rec int, ord long, n long")
    assert [x.chunk for x in sequences.packed(r, ["rec"], "ord", F.col("n"), 10).orderBy("ord").collect()] == [0, 1, 2]


def test_spread_keeps_ends(spark):
    r = spark.createDataFrame([(1, i) for i in range(10)], "rec int, i int")
    assert sorted(x.i for x in sequences.spread(r, ["rec"], ["i"], 4).collect()) == [0, 3, 6, 9]


def test_consensus_at_threshold(spark):
    r = spark.createDataFrame([("a", "x", 8), ("a", "y", 2), ("b", "x", 7), ("b", "y", 3)], "c string, n string, w long")
    assert {x.c: x.accepted for x in votes.consensus(r, "c", "n", "w", 8, 80).collect()} == {"a": True, "b": False}


def test_gates(spark):
    a = spark.createDataFrame([(1,), (1,), (3,)], "k int")
    b = spark.createDataFrame([(1,), (2,)], "k int")
    assert {tuple(r) for r in gates.set_difference(a, b, ["k"]).collect()} == {(2, "missing"), (3, "unexpected")}
    assert {tuple(r) for r in gates.ordered_cover(a.withColumn("g", F.lit(0)), ["g"], "k").collect()} == {(0, 1, "duplicated"), (0, 3, "gap")}
    known = spark.createDataFrame([("s1",)], "id string")
    rows = spark.createDataFrame([(1, ["s1", "s2"])], "row int, ids array<string>")
    assert [r.id for r in gates.unknown_references(rows, "ids", known, "id").collect()] == ["s2"]


def test_ledger_attributes(spark):
    rows = spark.createDataFrame([(1, 0, "Ana", "I will restart it for 2 hours, 30 minutes and 120 minutes with no downtime."), (1, 1, None, None)], "rec int, ord int, name string, text string")
    r = ledger.candidates(rows).collect()
    assert len(r) == 1
    assert (r[0].topics, r[0].durations, r[0].downtime, r[0].status) == (["maintenance"], [30, 120], False, "accepted")


def test_kmeans_is_deterministic():
    x = np.array([[0.0, 0], [0, 1], [9, 9], [9, 8], [0, 0]])
    assert vectors.kmeans(x, 2).tolist() == [0, 0, 1, 1, 0]
    assert vectors.kmeans(x[:1], 5).tolist() == [0]


def test_suppression(spark):
    r = spark.createDataFrame([(1, 1, 0.0, 0.0, 10.0, 10.0, 0.9), (1, 2, 0.0, 0.0, 10.0, 9.0, 0.8), (1, 3, 20.0, 20.0, 30.0, 30.0, 0.1)], "rec long, id long, x0 double, y0 double, x1 double, y1 double, score double")
    assert sorted(x.id for x in vectors.suppressed(r, "rec").collect()) == [1, 3]


def test_stream_agrees_with_batch(spark, sf_dir, tmp_path):
    batch = spark.read.parquet(f"{sf_dir}/events.parquet")
    batch.repartition(2).write.parquet(str(tmp_path / "in"))
    stream = windows.window_totals(windows.event_stream(spark, str(tmp_path / "in"), batch.schema), "1 day", "400 days")
    q = stream.writeStream.format("memory").queryName("totals").outputMode("complete").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    day = F.window(F.col("ts").cast("timestamp"), "1 day")
    want = {(r[0], r[1], r[2]) for r in batch.groupBy(day.alias("w"), "event_type").count().select("w.start", "event_type", "count").collect()}
    assert {(r.start, r.event_type, r.n) for r in spark.table("totals").collect()} == want


def test_whitelist_and_relabel(spark):
    from colloquy.operators import identity

    names = spark.createDataFrame([("Johann",), ("Maria",)], "name string")
    seen = spark.createDataFrame([(1, "johann"), (2, "Joham"), (3, "zzz"), (4, None)], "id int, name string")
    assert {r.id: r.resolved for r in identity.resolved(seen, names).collect()} == {1: "Johann", 2: None, 3: None, 4: None}
    assert {r.id: r.resolved for r in identity.resolved(seen, names, 0.7).collect()}[2] == "Johann"
    rows = spark.createDataFrame([("s1", None), ("s2", "old"), ("s3", "old")], "speaker string, name string")
    wanted = spark.createDataFrame([("s1", "Ana"), ("s2", "unknown"), ("s3", "Bo"), ("s4", "bo")], "speaker string, name string")
    assert {r.speaker: r.name for r in identity.relabelled(rows, wanted).collect()} == {"s1": "Ana", "s2": "old", "s3": "old"}


def test_missing_audit_clears_direct_names(spark):
    from colloquy.operators import identity

    rows = spark.createDataFrame([(1, "a", True), (2, "b", True), (3, "c", False)], "id int, name string, direct boolean")
    audit = spark.createDataFrame([(1, True), (2, False)], "id int, confirmed boolean")
    assert {r.id: r.name for r in identity.confirmed_only(rows, audit, ["id"]).collect()} == {1: "a", 2: None, 3: "c"}
    assert {r.id: r.name for r in identity.confirmed_only(rows, audit.limit(0), ["id"]).collect()} == {1: None, 2: None, 3: "c"}


def test_documents(spark):
    from colloquy.operators import documents

    cells = spark.createDataFrame([("| a | b |",), ("|---|---|",), ("x",)], "line string").select(documents.table_cells(F.col("line")).alias("c"))
    assert [r.c for r in cells.collect()] == [["a", "b"], None, None]
    a = spark.createDataFrame([(1, 0, "in 2 days, 3 times"), (1, 1, "x")], "k int, i int, t string")
    b = spark.createDataFrame([(1, 0, "3 mal in 2 Tagen"), (1, 2, "x")], "k int, i int, t string")
    assert {tuple(r) for r in documents.misaligned(a, b, "k", "i", "t").collect()} == {(1, 1, "row_missing"), (1, 2, "row_missing")}


def test_normal_form(spark):
    from colloquy.operators import identity

    df = spark.createDataFrame([("Ｆｕｌｌ-width’s  X!",), (None,)], "t string").select(identity.normal_form("t").alias("x"))
    assert [r.x for r in df.collect()] == ["full width s x", None]
