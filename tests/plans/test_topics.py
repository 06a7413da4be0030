"""Repair of topics: case by case, and against a plain fold over each chunk."""

from __future__ import annotations

import copy

import pytest

from colloquy.operators import topics as M
from colloquy.plans import topic_queries as Q

TOPICS = "rec long, chunk long, k long, title string, summary string, importance string, start_id string, end_id string, anchors array<string>"
RECORDS = "rec long, pos long, id string, start double, end double, text string"
CHUNKS = "rec long, chunk long, core_from long, core_to long"


def fold(topics, records, core_from, core_to):
    """The repair as one walk after the other over a list of topics."""
    place = {r["id"]: i for i, r in enumerate(records)}
    given, log = copy.deepcopy(topics), []
    if any(t[0] not in place or t[1] not in place or place[t[0]] > place[t[1]] for t in ((t["start_id"], t["end_id"]) for t in topics)):
        return given, []
    ts = [dict(t, s=place[t["start_id"]], e=place[t["end_id"]], anchors=list(t["anchors"] or [])) for t in topics]
    for i in range(1, len(ts)):
        a, b = ts[i - 1], ts[i]
        if b["s"] <= a["e"]:
            shared, crosses = records[a["e"]]["end"] - records[b["s"]]["start"], a["e"] < b["e"]
            if b["s"] - 1 >= a["s"] and (shared <= 30 or crosses):
                a["e"] = b["s"] - 1
                a["end_id"] = records[a["e"]]["id"]
                log.append(f"{'partitioned_crossing' if crosses and shared > 30 else 'trimmed'}_overlap_before:{i + 1}")
    for i, t in enumerate(ts):
        for x in t["anchors"]:
            p = place.get(x)
            if p is None or t["s"] <= p <= t["e"] or not core_from <= p <= core_to:
                continue
            low = ts[i - 1]["e"] if i else core_from - 1
            high = ts[i + 1]["s"] if i + 1 < len(ts) else core_to + 1
            if low < p < t["s"]:
                t["s"], t["start_id"] = p, x
                log.append(f"topic:{i + 1}:expanded_start_for_anchor:{x}")
            elif t["e"] < p < high:
                t["e"], t["end_id"] = p, x
                log.append(f"topic:{i + 1}:expanded_end_for_anchor:{x}")
    for i, t in enumerate(ts):
        keep = []
        for x in t["anchors"]:
            p = place.get(x)
            others = p is not None and any(j != i and o["s"] <= p <= o["e"] for j, o in enumerate(ts))
            if p is None or t["s"] <= p <= t["e"] or core_from <= p <= core_to and not others:
                keep.append(x)
            else:
                log.append(f"topic:{i + 1}:dropped_misplaced_anchor:{x}")
        t["anchors"] = keep
    merged, i = [], 0
    while i < len(ts):
        a = ts[i]
        if i + 1 < len(ts):
            b = ts[i + 1]
            title, summary = f"{a['title']} / {b['title']}", f"[{a['title']}] {a['summary']}\n[{b['title']}] {b['summary']}"
            long = records[b["e"]]["end"] - records[b["s"]]["start"] >= 30
            if a["s"] <= b["s"] and b["e"] <= a["e"] and a["importance"] == b["importance"] == "substantive" and long and len(title) <= 120 and len(summary) <= 800 and all(x in place for x in a["anchors"] + b["anchors"]):
                merged.append(dict(a, title=title, summary=summary, anchors=sorted({*a["anchors"], *b["anchors"]}, key=place.get)))
                log.append(f"merged_nested_topics:{i + 1}:{i + 2}")
                i += 2
                continue
        merged.append(a)
        i += 1
    out = []

    def fill(a, b):
        best = max(range(a, b + 1), key=lambda p: (len(records[p]["text"]), -records[p]["start"]))
        out.append({"title": M.FILLER_TITLE, "summary": M.FILLER_SUMMARY, "importance": "transitional", "start_id": records[a]["id"], "end_id": records[b]["id"], "anchors": [records[best]["id"]]})

    for i, t in enumerate(merged):
        if i == 0 and t["s"] > core_from:
            fill(core_from, t["s"] - 1)
            log.append("inserted_start_coverage_topic")
        if i and t["s"] > merged[i - 1]["e"] + 1 and records[t["s"]]["start"] - records[merged[i - 1]["e"]]["end"] > 30:
            fill(merged[i - 1]["e"] + 1, t["s"] - 1)
            log.append(f"inserted_gap_topic_before:{i + 1}")
        out.append(t)
    if merged and merged[-1]["e"] < core_to:
        fill(merged[-1]["e"] + 1, core_to)
        log.append("inserted_end_coverage_topic")
    if len(out) > 8:
        kept, waiting = [], None
        for t in out:
            if (t["title"], t["summary"]) == (M.FILLER_TITLE, M.FILLER_SUMMARY):
                waiting = t
                continue
            if waiting:
                t = dict(t, start_id=waiting["start_id"], anchors=list(dict.fromkeys(waiting["anchors"] + t["anchors"]))[:4])
                log.append("folded_gap_into_following_topic")
                waiting = None
            kept.append(t)
        if waiting and kept:
            kept[-1] = dict(kept[-1], end_id=waiting["end_id"], anchors=list(dict.fromkeys(kept[-1]["anchors"] + waiting["anchors"]))[:4])
            log.append("folded_end_gap_into_previous_topic")
        out = kept
    if len(out) > 8:
        return given, [*log, "coverage_normalization_topic_limit"]
    return out, log


FIELDS = ("title", "summary", "importance", "start_id", "end_id", "anchors")


def rows(n, apart, size, text=lambda i: f"row {i}"):
    return [(1, i, f"s{i}", float(i * apart), float(i * apart + size), text(i)) for i in range(n)]


def topic(k, a, b, anchors=None, title=None, importance="substantive"):
    return (1, 1, k, title or f"Topic {k}", "Something.", importance, f"s{a}", f"s{b}", [f"s{x}" for x in (anchors if anchors is not None else [a])])


def bad(*topics):
    return [topic(1, 0, 4), *topics], rows(6, 20, 15), None


#: topics, records, first and last position of the chunk's own rows (None: all).
CASES = {
    "long gap": ([topic(1, 0, 1), topic(2, 6, 7)], rows(8, 20, 10), None),
    "short gap": ([topic(1, 0, 1), topic(2, 3, 7)], rows(8, 20, 10), None),
    "short overlap": ([topic(1, 0, 3, [0, 6]), topic(2, 3, 7)], rows(8, 20, 10), None),
    "crossing": ([topic(1, 0, 3), topic(2, 2, 5)], rows(6, 40, 30), None),
    "partial": ([topic(1, 0, 5), topic(2, 3, 7)], rows(8, 20, 10), None),
    "limit": ([topic(k, a, b) for k, (a, b) in enumerate([(0, 0), *[(i, i + 1) for i in range(2, 16, 2)]], 1)], rows(16, 25, 10), None),
    "end": ([topic(k, 2 * k - 2, 2 * k - 1) for k in range(1, 9)], rows(20, 25, 10), None),
    "too many": ([topic(k, 2 * k - 2, 2 * k - 1) for k in range(1, 10)], rows(20, 25, 10), None),
    "nested": ([topic(1, 0, 9, [0, 9]), topic(2, 2, 7, [3]), topic(3, 3, 6, [5]), topic(4, 4, 6, [6])], rows(10, 20, 15), None),
    "nested transition": ([topic(1, 0, 9), topic(2, 2, 7, [3], importance="transitional")], rows(10, 20, 15), None),
    "nested long title": ([topic(1, 0, 9), topic(2, 2, 7, [3], title="x" * 118)], rows(10, 20, 15), None),
    "nested unknown": ([topic(1, 0, 9), topic(2, 2, 7, [3, 99])], rows(10, 20, 15), None),
    "nested short": ([topic(1, 0, 9), topic(2, 2, 2)], rows(10, 20, 15), None),
    "anchors": ([topic(1, 2, 3, [5, 4, 1, 0, 11]), topic(2, 8, 9, [6, 4, 10, 12])], rows(12, 20, 15), (1, 10)),
    "unknown row": bad(topic(2, 4, 99)),
    "reversed": bad(topic(2, 5, 4)),
    "null row": bad((1, 1, 2, "t", "s", "substantive", None, "s4", None)),
    "null text": ([(1, 1, 1, None, None, None, "s0", "s3", None), topic(2, 1, 2)], rows(6, 20, 15), None),
    "fillers": ([(1, 1, k, M.FILLER_TITLE, M.FILLER_SUMMARY, "transitional", f"s{k}", f"s{k}", None) for k in range(9)], rows(9, 20, 15), None),
    "longest": ([topic(1, 5, 5)], rows(6, 20, 15, lambda i: "x" * (3 if i in (2, 3) else 1)), None),
    "repeated anchors": ([topic(1, 2, 3, [4, 4, 2, 2, 0, 0])], rows(6, 20, 15), None),
}


@pytest.fixture(scope="module")
def cases(spark):
    """The repair of all cases, each a recording of its own, in one job."""
    ts, rs, cs = [], [], []
    for rec, (topics, records, core) in enumerate(CASES.values()):
        ts += [(rec, *t[1:]) for t in topics]
        rs += [(rec, *r[1:]) for r in records]
        cs.append((rec, 1, *(core or (0, len(records) - 1))))
    found = M.normalized(spark.createDataFrame(ts, TOPICS).repartition(5), spark.createDataFrame(rs, RECORDS).repartition(5), spark.createDataFrame(cs, CHUNKS)).collect()
    return {list(CASES)[r.rec]: r for r in found}


@pytest.mark.parametrize("name", CASES)
def test_repair_is_the_fold(cases, name):
    topics, records, core = CASES[name]
    want = fold([dict(zip(FIELDS, t[3:], strict=True)) for t in topics], [dict(zip(("id", "start", "end", "text"), r[2:], strict=True)) for r in records], *(core or (0, len(records) - 1)))
    got = [[t[f] for f in FIELDS] for t in cases[name].topics], list(cases[name].changes)
    assert got == ([[list(t[f] or []) if f == "anchors" else t[f] for f in FIELDS] for t in want[0]], want[1])


@pytest.mark.parametrize(
    ("name", "spans", "changes"),
    [
        ("long gap", [("s0", "s1"), ("s2", "s5"), ("s6", "s7")], ["inserted_gap_topic_before:2"]),
        ("short gap", [("s0", "s1"), ("s3", "s7")], []),
        ("short overlap", [("s0", "s2"), ("s3", "s7")], ["trimmed_overlap_before:2", "topic:1:dropped_misplaced_anchor:s6"]),
        ("crossing", [("s0", "s1"), ("s2", "s5")], ["partitioned_crossing_overlap_before:2"]),
        ("partial", [("s0", "s2"), ("s3", "s7")], ["partitioned_crossing_overlap_before:2"]),
        ("limit", [("s0", "s0"), ("s1", "s3"), *[(f"s{i}", f"s{i + 1}") for i in range(4, 16, 2)]], ["inserted_gap_topic_before:2", "folded_gap_into_following_topic"]),
        ("end", [*[(f"s{i}", f"s{i + 1}") for i in range(0, 14, 2)], ("s14", "s19")], ["inserted_end_coverage_topic", "folded_end_gap_into_previous_topic"]),
        ("nested", [("s0", "s9"), ("s3", "s6"), ("s7", "s9")], ["merged_nested_topics:1:2", "merged_nested_topics:3:4", "inserted_end_coverage_topic"]),
        ("anchors", [("s1", "s5"), ("s6", "s10")], ["topic:1:expanded_end_for_anchor:s5", "topic:1:expanded_start_for_anchor:s1", "topic:2:expanded_start_for_anchor:s6", "topic:2:expanded_end_for_anchor:s10", "topic:1:dropped_misplaced_anchor:s0", "topic:1:dropped_misplaced_anchor:s11", "topic:2:dropped_misplaced_anchor:s4"]),
        ("fillers", [], []),
        ("unknown row", [("s0", "s4"), ("s4", "s99")], []),
    ],
)
def test_what_a_case_gives(cases, name, spans, changes):
    r = cases[name]
    assert ([(t.start_id, t.end_id) for t in r.topics], list(r.changes)) == (spans, changes)


def test_contents_of_repaired_topics(cases):
    assert cases["long gap"].topics[1].importance == "transitional"
    assert [t.title for t in cases["nested"].topics][:2] == ["Topic 1 / Topic 2", "Topic 3 / Topic 4"] and cases["nested"].topics[0].anchors == ["s0", "s3", "s9"]
    assert cases["longest"].topics[0].anchors == ["s2"]
    assert len(cases["too many"].topics) == 9 and cases["too many"].changes[-1] == "coverage_normalization_topic_limit"


def test_no_topics_no_rows(spark):
    empty = M.normalized(spark.createDataFrame([], TOPICS), spark.createDataFrame(rows(3, 1, 1), RECORDS), spark.createDataFrame([(1, 1, 0, 2)], CHUNKS))
    assert empty.collect() == []


def test_all_proposals_of_the_query(spark, sf_dir):
    records = Q.records(spark, sf_dir)
    chunks = Q.chunks(records)
    got = {(r.rec, r.chunk): ([[t[f] for f in FIELDS] for t in r.topics], list(r.changes)) for r in M.normalized(Q.proposals(chunks), records, chunks).collect()}
    of: dict[int, list] = {}
    for r in sorted(records.collect(), key=lambda r: r.pos):
        of.setdefault(r.rec, []).append(r.asDict())
    given: dict[tuple, list] = {}
    for t in sorted(Q.proposals(chunks).collect(), key=lambda t: t.k):
        given.setdefault((t.rec, t.chunk), []).append(t.asDict())
    core = {(c.rec, c.chunk): (c.core_from, c.core_to) for c in chunks.collect()}
    want = {}
    for key, ts in given.items():
        out, log = fold(ts, of[key[0]], *core[key])
        want[key] = [[list(t[f] or []) if f == "anchors" else t[f] for f in FIELDS] for t in out], log
    assert got == want
