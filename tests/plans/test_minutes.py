"""Contract of proposed minutes: one breach a case, all in one job."""

from __future__ import annotations

import copy
import json
import random

import pytest
from pyspark.sql import functions as F

from colloquy.functions.columns import one_decimal
from colloquy.operators import minutes as M

RECORDS = [("a", 0.0, 30.0, "Ana", "I will test it."), ("b", 40.0, 70.0, "Ben", "Fine, agreed."), ("c", 100.0, 130.0, "Speaker 3", "I need your help here to test it."), ("d", 400.0, 430.0, "Ana", "Later on."), ("e", 1700.0, 1790.0, "Speaker 3", "End.")]
BASE = {
    "themes": [{"title_zh": "发布", "title_en": "Release", "current_state_zh": "进行中", "current_state_en": "Under way", "outcome_zh": "继续", "outcome_en": "Go on", "evidence_segment_ids": ["a", "b"], "key_points": [{"speaker": "Ana", "text_zh": "看", "text_en": "See", "segment_ids": ["a"]}]}],
    "project_updates": [{"participant": "Ana", "project_zh": "项目", "project_en": "P", "update_zh": "好", "update_en": "Good", "segment_ids": ["a"]}],
    "decisions": [{"text_zh": "定", "text_en": "So", "segment_ids": ["b"]}],
    "actions": [{"owner": "Ana", "item_zh": "测试系统接口", "item_en": "Test it", "segment_ids": ["a"]}],
}


def changed(*path_and_value):
    *path, key, value = path_and_value
    p = copy.deepcopy(BASE)
    at = p
    for k in path:
        at = at[k]
    if value is None:
        del at[key]
    else:
        at[key] = value
    return p


def more(section, **change):
    p = copy.deepcopy(BASE)
    p[section].append(BASE[section][0] | change)
    return p


T, P, U, D, A = ("themes", 0), ("themes", 0, "key_points", 0), ("project_updates", 0), ("decisions", 0), ("actions", 0)
#: payload (or its text): breaches.
CASES = [
    (BASE, []),
    ("[1]", ["payload_not_object"]),
    ("no json", ["payload_not_object"]),
    (None, ["payload_not_object"]),
    ({"themes": []}, ["top_level_keys_invalid"]),
    (BASE | {"more": 1}, ["top_level_keys_invalid"]),
    (BASE | {"themes": []}, ["themes_missing"]),
    (BASE | {"themes": {}}, ["themes_missing"]),
    (BASE | {"project_updates": 3}, ["project_updates_invalid", "project_update_missing:Ana"]),
    (BASE | {"decisions": "x"}, ["decisions_invalid"]),
    (BASE | {"actions": None}, ["actions_invalid"]),
    (BASE | {"themes": BASE["themes"] * 11}, ["themes_too_many:11>10"]),
    (BASE | {"decisions": BASE["decisions"] * 5}, ["decisions_too_many"]),
    (BASE | {"themes": [3]}, ["theme:1:not_object"]),
    (changed(*T, "title_zh", None), ["theme:1:keys_invalid"]),
    (changed(*T, "title_zh", " "), ["theme:1:title_zh_missing"]),
    (changed(*T, "current_state_en", ""), ["theme:1:current_state_en_missing"]),
    (changed(*T, "title_zh", "长" * 57), ["theme:1:title_zh_too_long"]),
    (changed(*T, "title_en", "x" * 89), ["theme:1:title_en_too_long"]),
    (changed(*T, "title_en", "a / b"), ["theme:1:title_en_combined_topic"]),
    (changed(*T, "title_zh", "一般讨论"), ["theme:1:title_zh_generic"]),
    (changed(*T, "outcome_en", "Speaker_2 goes on"), ["theme:1:outcome_anonymous_speaker_reference"]),
    (changed(*T, "evidence_segment_ids", []), ["theme:1:evidence_missing"]),
    (changed(*T, "evidence_segment_ids", "a"), ["theme:1:evidence_missing"]),
    (changed(*T, "evidence_segment_ids", ["a", "z", "z"]), ["theme:1:evidence_unknown:z"]),
    (changed(*T, "evidence_segment_ids", ["z"]), ["theme:1:evidence_unknown", "theme:1:evidence_unknown:z"]),
    (changed(*T, "key_points", "x"), ["theme:1:key_points_missing"]),
    (changed(*T, "key_points", []), ["theme:1:key_points_missing"]),
    (changed(*T, "key_points", BASE["themes"][0]["key_points"] * 4), ["theme:1:key_points_too_many"]),
    (changed(*P, "speaker", None), ["theme:1:point:1:invalid"]),
    (changed(*P, "text_en", ""), ["theme:1:point:1:text_en_missing"]),
    (changed(*P, "text_zh", "speaker 4 看"), ["theme:1:point:1:text_anonymous_speaker_reference"]),
    (changed(*P, "segment_ids", []), ["theme:1:point:1:evidence_missing"]),
    (changed(*P, "speaker", "Eve"), ["theme:1:point:1:speaker_unknown"]),
    (changed(*P, "speaker", "Speaker 3"), ["theme:1:point:1:speaker_anonymous"]),
    (changed(*P, "speaker", "Ben"), ["theme:1:point:1:speaker_evidence_mismatch"]),
    (changed(*U, "participant", None), ["project_update:1:invalid", "project_update_missing:Ana"]),
    (changed(*U, "project_zh", ""), ["project_update:1:project_zh_missing"]),
    (changed(*U, "update_en", "speaker unknown did"), ["project_update:1:update_anonymous_speaker_reference"]),
    (changed(*U, "participant", "Speaker 3"), ["project_update:1:participant_unknown", "project_update_missing:Ana"]),
    (changed(*U, "segment_ids", ["b"]), ["project_update:1:participant_evidence_mismatch"]),
    (changed(*U, "segment_ids", ["a", "d"]), ["project_update:1:evidence_span_too_wide:430.0>120.0"]),
    (more("project_updates"), ["project_update:2:participant_duplicate"]),
    (BASE | {"project_updates": []}, ["project_update_missing:Ana"]),
    (changed(*D, "text_en", None), ["decision:1:invalid"]),
    (changed(*D, "text_zh", ""), ["decision:1:text_zh_missing"]),
    (changed(*D, "segment_ids", ["y"]), ["decision:1:evidence_unknown", "decision:1:evidence_unknown:y"]),
    (changed(*A, "extra", 1), ["action:1:invalid"]),
    (changed(*A, "item_zh", "Speaker 2 测试"), ["action:1:item_anonymous_speaker_reference"]),
    (changed(*A, "item_zh", "看，并 发送"), ["action:1:atomicity_review_required"]),
    (changed(*A, "owner", "Eve"), ["action:1:owner_unknown"]),
    (changed(*A, "segment_ids", ["b"]), ["action:1:owner_evidence_mismatch"]),
    (changed(*A, "segment_ids", ["a", "c", "d"]), ["action:1:evidence_span_too_wide:430.0>120.0"]),
    (changed(*A, "owner", "待确认"), ["action:1:requested_follow_up_not_grounded"]),
    (changed("actions", 0, BASE["actions"][0] | {"owner": "待确认", "segment_ids": ["c"]}), []),
    (more("actions", item_zh="完全不同的事情"), ["action:2:duplicate"]),
    (more("actions", item_en="other", item_zh="测试系统接口吧"), ["action:2:semantic_duplicate:1"]),
    (more("actions", item_en="other", owner="Ben", segment_ids=["b"]), []),
    (changed(*T, "outcome_zh", "Ben 负责测试"), ["theme:1:future_owner_without_action:Ben"]),
    (changed(*T, "outcome_zh", "Ana 负责测试"), []),
    (changed(*T, "outcome_zh", "系统将上线"), ["theme:1:future_fact_unqualified"]),
    (changed(*T, "outcome_zh", "系统计划将上线"), []),
    (changed("themes", 0, BASE["themes"][0] | {"outcome_zh": "将实施", "evidence_segment_ids": ["a"]}), ["theme:1:outcome_unconfirmed_commitment"]),
    (changed(*T, "outcome_zh", "将实施"), []),
    (changed("themes", 0, BASE["themes"][0] | {"outcome_zh": "形成共识", "evidence_segment_ids": ["a"]}), ["theme:1:outcome_ungrounded_consensus"]),
    (changed(*T, "outcome_zh", "形成共识"), []),
]
LONG = [(i, s * 10, e * 10, w, t) for i, s, e, w, t in RECORDS[:4]] + [("e", 17000.0, 17900.0, "Speaker 3", "End.")]
#: The same in a long recording.
LONG_CASES = [
    (BASE | {"themes": [BASE["themes"][0] | {"evidence_segment_ids": ["a", "c"]}] * 10}, []),
    (changed(*T, "evidence_segment_ids", ["a", "c"]), ["themes_too_sparse:1<10"]),
    (BASE | {"themes": [BASE["themes"][0] | {"evidence_segment_ids": ["e", "d"], "key_points": [BASE["themes"][0]["key_points"][0] | {"speaker": "Ana", "segment_ids": ["d"]}]}] * 10}, [f"theme:{i}:evidence_gap_too_wide:12700.0>1500.0" for i in range(1, 11)]),
    (BASE | {"themes": [BASE["themes"][0] | {"evidence_segment_ids": ["b"], "key_points": [BASE["themes"][0]["key_points"][0] | {"speaker": "Ben", "segment_ids": ["b"]}]}] * 10}, None),
]


@pytest.fixture(scope="module")
def found(spark):
    every = [(c, RECORDS) for c in CASES] + [(c, LONG) for c in LONG_CASES]
    payloads = [(i, p if p is None or isinstance(p, str) else json.dumps(p, ensure_ascii=False)) for i, ((p, _), _) in enumerate(every)]
    records = [(i, *r) for i, (_, rs) in enumerate(every) for r in rs]
    got: dict[int, list] = {i: [] for i in range(len(every))}
    args = spark.createDataFrame(payloads, "doc long, payload string"), spark.createDataFrame(records, "doc long, id string, start double, end double, speaker string, text string"), spark.createDataFrame([(i, "Ana") for i in range(len(every))], "doc long, participant string")
    for r in M.breaches(*args).collect():
        got[r.doc].append(r.code)
    return got


@pytest.mark.parametrize("i", range(len(CASES)))
def test_breach(found, i):
    assert sorted(found[i]) == sorted(CASES[i][1])


def test_too_many_actions(spark):
    p = BASE | {"actions": [BASE["actions"][0] | {"item_zh": chr(0x5000 + i) * 9, "item_en": str(i)} for i in range(25)]}
    args = spark.createDataFrame([(1, json.dumps(p))], "doc long, payload string"), spark.createDataFrame([(1, *r) for r in RECORDS], "doc long, id string, start double, end double, speaker string, text string"), spark.createDataFrame([], "doc long, participant string")
    assert [r.code for r in M.breaches(*args).collect()] == ["actions_too_many"]


def test_long_recordings(found):
    n = len(CASES)
    for i, (_, want) in enumerate(LONG_CASES[:3]):
        # updates and actions of the base case lie within a row of 300 seconds here
        got = sorted(c for c in found[n + i] if not c.endswith(":evidence_span_too_wide:300.0>120.0"))
        assert got == sorted(want)
    last = found[n + 3]  # 300 seconds are long enough
    assert not any("span_too_short" in c for c in last)


def test_short_themes_of_long_recordings(spark):
    records = [(1, "a", 0.0, 30.0, "Ana", "x"), (1, "b", 30.0, 60.0, "Ben", "agreed"), (1, "e", 3590.0, 3600.0, "Speaker 3", "End.")]
    args = spark.createDataFrame([(1, json.dumps(BASE | {"themes": BASE["themes"] * 2}))], "doc long, payload string"), spark.createDataFrame(records, "doc long, id string, start double, end double, speaker string, text string"), spark.createDataFrame([], "doc long, participant string")
    assert sorted(r.code for r in M.breaches(*args).collect()) == ["theme:1:span_too_short:60.0<180.0", "theme:2:span_too_short:60.0<180.0"]


def test_spans_round_as_their_exact_values(spark):
    records = [(1, "a", 0.0, 30.0, "Ana", "x"), (1, "d", 500.0, 549.15, "Ana", "y")]  # 549.15 is a little less than it says
    args = spark.createDataFrame([(1, json.dumps(changed(*A, "segment_ids", ["a", "d"]) | {"themes": [BASE["themes"][0] | {"evidence_segment_ids": ["a"]}], "decisions": []}))], "doc long, payload string"), spark.createDataFrame(records, "doc long, id string, start double, end double, speaker string, text string"), spark.createDataFrame([], "doc long, participant string")
    assert [r.code for r in M.breaches(*args).collect()] == [f"action:1:evidence_span_too_wide:{549.15:.1f}>120.0"]


def test_one_decimal(spark):
    rng = random.Random(1)
    values = [i / 20 for i in range(-60, 300)] + [i / 1000 for i in range(549000, 549999)] + [rng.randrange(10**8) / 1000 - rng.randrange(10**8) / 1000 for _ in range(2000)]
    values += [0.05, 0.049999999999999996, 0.25000000000000006, 0.24999999999999997, 1e-300, 0.95, 0.9500000000000001, 9.95, 99.95, 2.0**52 + 0.5, 2.0**53 - 1]
    got = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i long, v double").select("i", one_decimal(F.col("v")).alias("t")).collect()
    assert {r.i: r.t for r in got} == {i: f"{v:.1f}" for i, v in enumerate(values)}
    assert spark.range(1).select(one_decimal(F.lit(None).cast("double"))).first()[0] is None


def test_no_payloads(spark):
    empty = lambda s: spark.createDataFrame([], s)
    assert M.breaches(empty("doc long, payload string"), empty("doc long, id string, start double, end double, speaker string, text string"), empty("doc long, participant string")).collect() == []
