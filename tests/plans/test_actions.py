"""Cues, lengths and topics of single texts."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from colloquy.operators import actions as A
from colloquy.operators import cues, identity, ledger

#: text: minutes, mentions without a value.
LENGTHS = {
    "2 hours and 30 min": ([30, 120], []),
    "it takes two hours": ([120], []),
    "twenty five minutes": ([25], []),
    "a hundred and five minutes": ([105], []),
    "two hundred min": ([200], []),
    "hundred minutes": ([100], []),
    "half an hour": ([30], []),
    "half a minute": ([0], []),
    "an hour": ([60], []),
    "two and half hours": ([], ["two and half hours"]),
    "zero hours": ([], ["zero hours"]),
    "a couple of hours": ([], ["a couple of hours"]),
    "several minutes": ([], ["several minutes"]),
    "0 minutes": ([], ["0 minutes"]),
    "eighth": ([480], []),
    "1.5 hours": ([300], []),  # signs are spaces in the normal form
    "in 3 days": ([], []),
    "半个小时": ([30], []),
    "两个小时，十五分钟": ([15, 120], []),
    "一百零五分钟": ([105], []),
    "二十分": ([20], []),
    "万分钟": ([10000], []),
    "3十分钟": ([], ["3十分钟"]),
    "30分钟": ([30], []),
    "两个多小时": ([], []),
    "": ([], []),
    None: ([], []),
}


def test_lengths(spark):
    rows = spark.createDataFrame([(t,) for t in LENGTHS], "text string")
    got = {r.text: (list(r.x.minutes or []), list(r.x.unparsed or [])) if r.x else ([], []) for r in rows.select("text", identity.normal_form("text").alias("plain")).select("text", A.durations(F.col("plain")).alias("x")).collect()}
    assert got == LENGTHS


@pytest.mark.parametrize(("text", "topics"), [("MPC keys", ["mpc"]), ("mpcs", []), ("BPS", ["bps"]), ("bps encryption", ["private_key_encryption"]), ("git-lab invoice", ["source_control_migration", "invoice_review"]), ("five minutes", ["meeting_notes"]), ("our kpi", ["team_metrics"]), ("kpi", []), ("合同", ["contract"]), ("", [])])
def test_topics(spark, text, topics):
    assert spark.createDataFrame([(text,)], "t string").select(A.topics(identity.normal_form("t")).alias("x")).first().x == topics


@pytest.mark.parametrize(("text", "want"), [("no downtime", False), ("It doesn't require a downtime", False), ("it requires downtime", True), ("needs a downtime, no downtime", False), ("downtime", None), ("需要停机", True), ("不需要停机", False)])
def test_downtime(spark, text, want):
    assert spark.createDataFrame([(text,)], "t string").select(A.downtime(identity.normal_form("t")).alias("x")).first().x is want


#: text: cues that stay, as (start, cue).
COMMITMENTS = {
    "I will test it": [(0, "I will")],
    "I’ll do it, I'll do it": [(0, "I’ll")],
    "I'll do it and much later I’ll do it": [(0, "I'll"), (26, "I’ll")],
    "I'm gonna go": [(0, "I'm gonna")],
    "I plan to go": [(0, "I plan to")],
    "I won't go": [],
    "I will never go": [],
    "I’m not going to": [],
    "Let me explain": [],
    "Let me see": [],
    "Let me test": [(0, "Let me")],
    "Let me continue my idea was": [],
    "我会测试": [(0, "我会")],
    "我将 不 去": [],
    "sigh I willing": [],
}


def test_commitments(spark):
    rows = spark.createDataFrame([(t,) for t in COMMITMENTS], "text string")
    assert {r.text: [tuple(x) for x in r.x] for r in rows.select("text", cues.commitments(F.col("text")).alias("x")).collect()} == COMMITMENTS


def specs(spark, text, trusted=True, owners=("Ben", "Ana Lopez", "ana lopez", "A.B", "Will")):
    row = spark.createDataFrame([(text, "Sam", trusted, list(owners) if owners is not None else None)], "t string, s string, k boolean, o array<string>")
    return [(x.start, x.cue, x.owner, x.evidence, x.kind, x.reasons) for x in row.select(A.specs(F.col("t"), F.col("s"), F.col("k"), F.col("o")).alias("x")).first().x]


def test_families_stand_side_by_side_by_place(spark):
    got = specs(spark, "Ben will go. I will test. We need to deploy it; I would like to review it.")
    assert [(s, e, k) for s, _, _, e, k, _ in got] == [(0, "explicit_name_assignment", "direct_assignment"), (13, "speaker_self_commitment", "self"), (26, "unresolved_weak_intent", "weak_intent"), (48, "speaker_weak_intent", "weak_intent")]
    assert [o for _, _, o, *_ in got] == ["Ben", "Sam", None, "Sam"]
    assert [r for *_, r in got] == [["owner_acceptance_unverified"], [], ["weak_intent_cue", "owner_unresolved"], ["weak_intent_cue"]]


def test_overlapping_cues_all_stay(spark):
    assert [k for *_, k, _ in specs(spark, "I plan to, I'd like us to test")] == ["self", "weak_intent"]


def test_untrusted_speakers_own_nothing(spark):
    assert [(o, e) for _, _, o, e, *_ in specs(spark, "I will test. I intend to test.", trusted=False)] == [(None, "unresolved_speaker"), (None, "unresolved_weak_intent")]


def test_conditions_and_questions(spark):
    assert specs(spark, "If it fails I need to fix it")[0][5] == ["conditional_or_hypothetical"]
    assert specs(spark, "If it fails. I need to fix it")[0][5] == []
    assert specs(spark, "Do you think I will go")[0][5] == ["questioned_or_reported_commitment"]
    assert specs(spark, "if " + "x" * 97 + " I will go")[0][5] == []


def test_owners(spark):
    assert [o for _, _, o, *_ in specs(spark, "ana lopez should go")] == ["ana lopez"]  # of names with one plain form the last
    assert [o for _, _, o, *_ in specs(spark, "A.B needs to go, AxB needs to go")] == ["A.B"]
    assert [(c, o) for _, c, o, *_ in specs(spark, "Will will go")] == [("Will will", "Will")]
    assert specs(spark, "Ben will go", owners=[]) == specs(spark, "Ben will go", owners=None) == specs(spark, None) == []


def test_no_quote_is_lost(spark):
    text = "I will go " * 10_050
    rows = spark.createDataFrame([(text,), ("nothing",)], "t string").select(F.size(ledger.quotes(F.col("t"), ledger.SELF_CUES)).alias("n")).collect()
    assert [r.n for r in rows] == [10_050, 0]
