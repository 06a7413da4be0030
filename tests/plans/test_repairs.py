"""Repair of reviews: one review a case, all in one job."""

from __future__ import annotations

import pytest

from colloquy.operators import repairs as M

#: id: start, end, speaker, text.
RECORDS = {
    "b0": (0, 10, "Billy", "I will review the latest invoice."),
    "b1": (11, 21, "Billy", "The build is green."),
    "x0": (22, 30, "Xin", "I'll send the notes."),
    "b2": (300, 310, "Billy", "I need to test the gateway."),
    "b3": (320, 330, "Billy", "We selected the single deployment path."),
    "b4": (340, 350, "Billy", "Agreed, sounds good."),
}
RECORD = "doc long, id string, start double, end double, speaker string, text string"


def act(owner="Billy", item="review the invoice", ids=("b0",), basis="self_commitment"):
    return (owner, item, list(ids), basis)


def cand(owner="Billy", item="review the invoice", ids=("b0",), basis="self_commitment", must=True):
    return (owner, item, list(ids), basis, must)


def disp(c, k, kept=True, code="supported", reason="fine"):
    return (c, kept, k, code, reason)


def upd(text="done", project="P", who="Billy", ids=("b0",)):
    return (who, project, text, list(ids))


def review(actions=(), candidates=(), dispositions=(), updates=(), decisions=(), supports=(), given=None):
    return (list(actions), list(candidates), list(dispositions), list(updates), list(decisions), list(supports), given)


CASES = {
    "clean": review([act()], [cand()], [disp(1, 1)], [upd()]),
    "empty": review(),
    # an action without a ground goes, and the update that told of it is made from another
    "unsupported": review([act(item="复核最近一张发票。"), act(item="向 Xin 发送后续报告。", ids=["b1"])], [cand(item="复核最近一张发票。")], [disp(1, 1)], [upd("向 Xin 发送后续报告。", ids=["b1"])], given=["project_update:1:named_entity_ungrounded:Xin"]),
    "entities": review([act(item="继续推进集成工作，处理 GitLab 配置。")], [cand(must=False)], [disp(1, 1)], [upd("继续推进 GitLab 集成。", "GitLab 集成"), upd("重复的更新。", "重复", ids=["b1"])], given=["action:1:named_entity_ungrounded:GitLab", "project_update:1:named_entity_ungrounded:GitLab"]),
    "decision": review([act()], [cand()], [disp(1, 1, reason="x" * 121)], [], [("BPS will be the core.", ["b1"])], [(1, ["b1"], "explicit_agreement")], ["decision:1:named_entity_ungrounded:BPS"]),
    "decisions": review([], [], [], [], [("BPS is approved.", ["b1"]), ("The single path was selected.", ["b3"])], [(1, ["b1"], "explicit_agreement"), (2, ["b3"], "selected_direction")]),
    "other basis": review([], [], [], [], [("Single path.", ["b3"]), ("Fine.", ["b4"])], [(1, ["b3"], "explicit_agreement"), (2, ["b4"], "selected_direction")]),
    "restored": review([act(item="something else", ids=["b1"])], [cand()], [disp(1, 1)]),
    "atomic": review([act(item="review the invoice and send it")], [cand(item="看发票，并 发送发票")], [disp(1, 1)]),
    "atomic free": review([act(item="review the invoice and send it")], [cand(must=False)], [disp(1, 1)]),
    "split": review([act(ids=["b0", "b2"]), act("Xin", "send the notes", ["x0"])], [cand(), cand(item="test the gateway", ids=["b2"]), cand("Xin", "send the notes", ["x0"])], [disp(1, 1), disp(2, 1), disp(3, 2)]),
    "wide": review([act(ids=["b2", "b0", "b1"])], [], []),
    "external": review([act(), act("Xin", "send the notes", ["x0"])], [cand(), cand("Xin", "send the notes", ["x0"])], [disp(1, 1), disp(2, 2)], given=["publication_gate_action_support:1:external_delivery_status_not_action"]),
    "rejected, met": review([act()], [cand()], [disp(1, None, False, "unsupported_item", "no")]),
    "rejected, new": review([act()], [cand(item="test the gateway", ids=["b2"]), cand("Xin", "send the notes", ["x0"])], [disp(1, None, False), disp(2, None, False)]),
    "rejected, near": review([act(item="review the invoices", ids=["b0"])], [cand(item="review the invoice", ids=["b1"])], [disp(1, None, False)]),
    "rejected, twice": review([], [cand(), cand(item="look at the invoice", ids=["b0"]), cand(item="test it", ids=["b2"])], [disp(1, None, False), disp(2, None, False), disp(3, None, False)]),
    "numbers": review([act(item="review the invoice, in 5 days")], given=["action:1:number_ungrounded:5"]),
    "numbers only": review([act(item="5 days")], given=["action:1:number_ungrounded:5"]),
    "number inside": review([act(item="review v15")], given=["action:1:number_ungrounded:5"]),
    "update elsewhere": review([act("Xin", "send the notes", ["x0"])], [], [], [upd(who="Xin", ids=["b0"])]),
    "update stuck": review([act(item="no ground", ids=["b1"])], [], [], [upd(who="Xin", ids=["b0"])]),
    "update wide": review([], [], [], [upd(ids=["b0", "b1", "b2"])]),
    "follow-up moves": review([act(item="note it", ids=["b0"]), act(item="test the gateway", ids=["b2"])], [], [], [upd("old", M.FOLLOW_UP)]),
    "wrong owner": review([], [cand(must=False)], [disp(1, None, False, "unsupported_owner", "no")], given=["publication_gate_candidate_disposition:1:unsupported_owner_conflicts_with_evidence"]),
    "long reason, rejected": review([], [cand(must=False)], [disp(1, None, False, "unsupported_item", "x" * 200)]),
    "unknown rows": review([act(ids=["zz"])], [], [], [upd(ids=["zz"])]),
    "no basis": review([act(basis=None), act(ids=["b1"])]),
}


@pytest.fixture(scope="module")
def done(spark):
    names = list(CASES)
    reviews = spark.createDataFrame([(i, *CASES[n]) for i, n in enumerate(names)], M.SCHEMA + ", given array<string>")
    records = spark.createDataFrame([(i, k, float(a), float(b), w, t) for i in range(len(names)) for k, (a, b, w, t) in RECORDS.items()], RECORD)
    s = M.settled(reviews, records)
    rounds: dict[str, list] = {n: [] for n in names}
    for r in s.rounds.orderBy("round").collect():
        rounds[names[r.doc]].append(list(r.changes))
    left = {names[r.doc]: list(r.errors) for r in s.left.collect()}
    rows = s.reviews.collect()
    assert sorted(r.doc for r in rows) == list(range(len(names)))
    return {names[r.doc]: (r, rounds[names[r.doc]], left.get(names[r.doc], [])) for r in rows}


def items(r):
    return [(a.owner, a.item, a.ids) for a in r.actions]


def places(r):
    return [(d.c, d.kept, d.k) for d in r.dispositions]


def updates(r):
    return [(u.project, u.text, u.ids) for u in r.updates]


def test_clean_reviews_stay(done):
    for name in ("clean", "empty"):
        r, rounds, left = done[name]
        assert rounds == [] and left == [] and tuple(list(map(tuple, r[c])) for c in M.COLUMNS) == tuple(CASES[name][:6])


def test_unsupported_action_goes_and_its_update_is_rebuilt(done):
    r, rounds, left = done["unsupported"]
    assert rounds == [["dropped_unsupported_action:2", "rebuilt_project_update:1"]] and left == []
    assert len(r.actions) == 1 and updates(r) == [(M.FOLLOW_UP, "复核最近一张发票。", ["b0"])]


def test_entities_go_with_their_clauses_and_repeated_updates(done):
    r, rounds, left = done["entities"]
    assert rounds == [["dropped_ungrounded_action_entity_clause:1", "rebuilt_project_update:1", "dropped_duplicate_project_update:2"]] and left == []
    assert items(r) == [("Billy", "继续推进集成工作", ["b0"])] and updates(r) == [(M.FOLLOW_UP, "继续推进集成工作", ["b0"])]


def test_decision_without_ground_goes_and_a_long_reason_is_cut(done):
    r, rounds, left = done["decision"]
    assert rounds == [["dropped_ungrounded_decision:1", "shortened_candidate_disposition_reason:1"]] and left == []
    assert r.decisions == [] and r.decision_supports == [] and r.dispositions[0].reason == M.SHORT["kept"]


def test_supports_of_the_decisions_left_are_numbered_anew(done):
    r, rounds, _ = done["decisions"]
    assert rounds == [["dropped_ungrounded_decision:1"]] and [tuple(x) for x in r.decision_supports] == [(1, ["b3"], "selected_direction")] and [d.text for d in r.decisions] == ["The single path was selected."]


def test_other_basis_where_the_rows_tell_it(done):
    r, rounds, left = done["other basis"]
    assert rounds == [["repaired_decision_support_basis:1", "repaired_decision_support_basis:2"]] and [s.basis for s in r.decision_supports] == ["selected_direction", "explicit_agreement"] and left == []


def test_candidates_that_must_be_kept_come_back(done):
    r, rounds, left = done["restored"]
    assert rounds == [["restored_must_keep_action:1"]] and items(r) == [("Billy", "review the invoice", ["b0"])] and places(r) == [(1, True, 1)] and left == []
    r, rounds, left = done["atomic"]
    assert rounds == [["restored_must_keep_action:1"]] and items(r)[0][1] == "发送发票" and left == []
    r, rounds, left = done["atomic free"]  # nothing to take its place: the reason stays
    assert rounds == [] and left == ["action:1:atomicity_review_required"]


def test_shared_action_is_split_and_all_follow(done):
    r, rounds, left = done["split"]
    assert rounds == [["split_must_keep_action:1:2"]] and left == []
    assert items(r) == [("Billy", "review the invoice", ["b0"]), ("Billy", "test the gateway", ["b2"]), ("Xin", "send the notes", ["x0"])] and places(r) == [(1, True, 1), (2, True, 2), (3, True, 3)]


def test_wide_evidence_is_narrowed_to_its_beginning(done):
    r, rounds, left = done["wide"]
    assert rounds == [["narrowed_action_evidence:1"]] and items(r)[0][2] == ["b0", "b1"] and left == []


def test_reports_of_others_go_even_if_they_must_be_kept(done):
    r, rounds, left = done["external"]
    # the candidate is then rejected, though it must be kept, and comes back as an action of its own in the next round
    assert rounds[0] == ["dropped_external_delivery_status_action:1"] and rounds[1] == ["restored_supported_candidate:1"] and left == []
    assert items(r) == [("Xin", "send the notes", ["x0"]), ("Billy", "review the invoice", ["b0"])] and places(r) == [(1, True, 2), (2, True, 1)]


def test_rejected_candidates_join_what_is_there(done):
    for name in ("rejected, met", "rejected, near"):
        r, rounds, left = done[name]
        assert len(r.actions) == 1 and places(r) == [(1, True, 1)] and left == [] and r.dispositions[0].reason == M.RETAINED, name


def test_rejected_candidates_become_actions(done):
    r, rounds, left = done["rejected, new"]
    assert rounds == [["restored_supported_candidate:1", "restored_supported_candidate:2"]] and places(r) == [(1, True, 2), (2, True, 3)] and left == []
    # one of an owner a round: the second joins the first, which they then may not share, so that it is split
    r, rounds, left = done["rejected, twice"]
    assert rounds[0] == ["restored_supported_candidate:1"] and [a[2] for a in items(r)] == [["b0"], ["b0"], ["b2"]] and places(r) == [(1, True, 1), (2, True, 2), (3, True, 3)] and left == []


def test_numbers_without_ground(done):
    assert items(done["numbers"][0])[0][1] == "review the invoice" and done["numbers"][1] == [["neutralized_ungrounded_action_literals:1"]]
    assert items(done["numbers only"][0])[0][1] == M.OPEN_EN
    assert items(done["number inside"][0])[0][1] == "review v15" and done["number inside"][1] == []


def test_updates(done):
    assert updates(done["update elsewhere"][0]) == [(M.FOLLOW_UP, "send the notes", ["x0"])]
    r, rounds, left = done["update stuck"]  # nothing at all is changed
    assert rounds == [] and items(r) == [("Billy", "no ground", ["b1"])] and left == ["project_update:1:participant_evidence_mismatch", "publication_gate_action_support:1:self_commitment_not_grounded"]
    assert updates(done["update wide"][0]) == [("P", "done", ["b0", "b1"])]
    r, rounds, _ = done["follow-up moves"]
    assert updates(r) == [(M.FOLLOW_UP, "test the gateway", ["b2"])] and "upgraded_project_update:1" in rounds[-1]


def test_dispositions(done):
    d = done["wrong owner"][0].dispositions[0]
    assert (d.kept, d.code, d.reason) == (False, "unsupported_commitment", M.NOT_CONCRETE)
    assert done["long reason, rejected"][0].dispositions[0].reason == M.SHORT["unsupported_item"]


def test_unknown_rows_and_missing_bases(done):
    r, rounds, left = done["unknown rows"]
    assert rounds == [["dropped_unsupported_action:1"]] and left == []
    r, rounds, left = done["no basis"]
    assert rounds == [] and len(r.actions) == 2


def test_rounds_end_where_a_state_comes_again(done):
    assert all(len(rounds) <= 12 for _, rounds, _ in done.values())


def test_no_reviews(spark):
    s = M.settled(spark.createDataFrame([], M.SCHEMA), spark.createDataFrame([], RECORD))
    assert s.reviews.collect() == s.rounds.collect() == s.left.collect() == []
