"""Names of voice clusters against a plain fold; nulls, ties, empty tables, borders, collisions."""

from __future__ import annotations

import math
from collections import Counter, defaultdict

import numpy as np

from colloquy.operators import clusters

FRAMES, TURNS = "rec long, t long, name string", "rec long, turn long, speaker string, start_ms long, end_ms long"
SEGMENTS = "rec long, ord long, speaker string, start_ms long, end_ms long, refs array<string>"


def of(spark, frames, turns):
    return clusters.turn_votes(spark.createDataFrame(frames, FRAMES), spark.createDataFrame(turns, TURNS))


def talk(voices, turns=120, size=8000, rec=1):
    """Turns of the voices in rotation, ten seconds each, with frames (offset, name) by the voice's function of (turn of the voice, of all)."""
    t = [(rec, i, list(voices)[i % len(voices)], 10_000 * i, 10_000 * i + size) for i in range(turns)]
    f = [(rec, start + at, name) for _, i, who, start, _ in t for at, name in voices[who](i // len(voices), turns // len(voices))]
    return f, t


def steady(name):
    return lambda k, n: [(2000, name), (4000, name), (5000, name)]


def test_turn_votes(spark):
    turns = [(1, 0, "a", 0, 10_000), (1, 1, None, 10_000, 20_000), (1, 2, "b", 20_000, 30_000)]
    frames = [(1, 600, "X"), (1, 800, "X"), (1, 5000, "X"), (1, 9200, "X"), (1, 9400, "X"), (1, 12_000, "Y"), (1, 13_000, "Y"), (1, 14_000, None),
              (1, 22_000, "Z"), (1, 23_000, "W"), (1, 40_000, "Z"), (2, 1000, "Z"), (1, -5, "X")]
    got = {(r.erosion, r.turn): (r.speaker, r.name, r.of, r.votes, r.time) for r in of(spark, frames, turns).collect()}
    assert got == {(600, 0): ("a", "X", 5, 5, 5000), (800, 0): ("a", "X", 3, 3, 5000)} | {(e, 1): (clusters.UNKNOWN, "Y", 2, 2, 15_000) for e in (600, 800, 1000)}


def plain(records):
    """name or None, and reasons, of one cluster's votes (erosion, time, turn, name), before collisions."""
    near = lambda x: math.floor(x * 1000 + 0.5)

    def wilson(k, n, z=1.96):
        p = k / n
        return (p + z * z / (2 * n) - z * math.sqrt((p * (1 - p) + z * z / (4 * n)) / n)) / (1 + z * z / n)

    def passes(names, who, turns, share, bound):
        k, n = names.count(who), len(names)
        return n >= turns and n > 0 and near(k / n) >= share and near(wilson(k, n)) >= bound

    def winner(names):
        return min(((-k, n) for n, k in Counter(names).items()), default=(0, None))[1]

    main = sorted(r[1:] for r in records if r[0] == 800)
    names = [r[2] for r in main]
    cut = math.ceil(len(names) * 0.6)
    early, late = names[:cut], names[cut:]
    who = winner(early) if winner(early) == winner(late) else None
    if who is None:
        return None, ["directional_candidates_disagree", "early_to_late_validation_failed", "late_to_early_validation_failed", "no_candidate"]
    why = []
    for a, b, reason in ((early, late, "early_to_late_validation_failed"), (late, early, "late_to_early_validation_failed")):
        if not (passes(a, who, 12, 900, 750) and passes(b, who, 8, 850, 750)):
            why.append(reason)
    n = len(names)
    if not all(passes(names[q * n // 4 : (q + 1) * n // 4], who, 2, 850, 0) for q in range(4)):
        why.append("quartile_stability_failed")
    times = [r[0] for r in main if r[2] == who]
    if max(times) - min(times) < 120_000:
        why.append("insufficient_time_span")
    for e in (600, 800, 1000):
        at = [r[3] for r in records if r[0] == e]
        if not (passes(at, who, 12, 900, 750) and winner(at) == who):
            why.append(f"erosion_{e}_unstable")
    return who, sorted(why)


def test_named_against_a_fold(spark):
    g = np.random.default_rng(3)
    rows = []
    for cluster in range(40):
        n, wrong, turn = int(g.integers(1, 60)), g.choice([0, 0.03, 0.12, 0.5]), g.choice([0, 0.7])
        for i in range(n):
            name = f"P{cluster}" if not (turn and i > n * turn) else f"Q{cluster}"
            for e in (600, 800, 1000):
                if g.random() < 0.95:
                    rows.append((1, e, cluster * 100 + i, f"s{cluster}", int(i * g.choice([1000, 9000])), "other" if g.random() < wrong else name, 3, 3))
    votes = spark.createDataFrame(rows, "rec long, erosion int, turn long, speaker string, time long, name string, of long, votes long")
    by = defaultdict(list)
    for _, e, turn, who, time, name, *_ in rows:
        by[who].append((e, time, turn, name))
    want = {who: plain(r) for who, r in by.items() if any(x[0] == 800 for x in r)}
    got = {r.speaker: (r.candidate, r.reasons) for r in clusters.named(votes).collect()}
    assert got == want
    assert sum(not why for _, why in want.values()) >= 3 and len({x for _, why in want.values() for x in why}) >= 7


def test_collisions_are_within_a_recording(spark):
    f, t = talk({"a": steady("Ana"), "b": steady("Ana"), "c": steady("Cy")})
    g, u = talk({"a": steady("Ana"), "b": steady("Bo"), "c": steady("Cy")}, rec=2)
    got = {(r.rec, r.speaker): (r.candidate, r.accepted, r.reasons) for r in clusters.named(of(spark, f + g, t + u)).collect()}
    assert got[1, "a"] == got[1, "b"] == ("Ana", False, ["name_collision"]) and got[1, "c"] == ("Cy", True, [])
    assert got[2, "a"] == ("Ana", True, [])


def test_names_at_the_borders(spark):
    """Frames near the turns' ends that show someone else: a name that holds only with more taken off isn't stable."""
    edge = lambda k, n: [(700, "Bo"), (7300, "Bo"), (4000, "Ana"), (5000, "Ana")]
    f, t = talk({"a": edge, "b": steady("Cy"), "c": steady("Di")})
    got = {r.speaker: r for r in clusters.named(of(spark, f, t)).collect()}
    assert got["a"].reasons == ["erosion_600_unstable"] and got["a"].candidate == "Ana" and got["b"].accepted


def test_named_of_nothing(spark):
    assert clusters.named(of(spark, [], [])).count() == 0
    f, t = talk({None: steady("Ana")})
    assert clusters.named(of(spark, f, t)).count() == 0  # nobody's turns


def test_applied(spark):
    s = spark.createDataFrame([(1, 0, "a", 1000, 2000, ["z"]), (1, 1, "a", 5000, 6000, None), (1, 2, "b", 9000, 9500, None), (1, 3, None, 20_000, 21_000, None), (1, 4, "a", 30_000, 31_000, ["k"])], SEGMENTS)
    f = spark.createDataFrame([(1, 250, 1, "Ana", 300), (1, 2750, 2, "Ana", 900), (1, 2751, 3, "Bo", 1), (1, 249, 4, "Bo", 1), (1, 1500, 5, "Bo", 9),
                               (1, 5500, 6, "Ana", 10), (1, 5600, 7, "Bo", 10), (1, 9000, 8, None, 10), (1, 30_500, 9, "Di", 100)], "rec long, t long, id long, name string, score long")
    back = spark.createDataFrame([(1, "a", "Eve")], "rec long, speaker string, name string")
    got = {r.ord: (r.name, r.name_source, r.confidence, r.seen, r.refs) for r in clusters.applied(s, f, back).collect()}
    assert got == {0: ("Ana", clusters.SEEN, 750, 3, ["1", "2", "5", "z"]), 1: ("Eve", clusters.FALLBACK, 720, 0, []), 2: (None, clusters.UNRESOLVED, 0, 0, []), 3: (None, clusters.UNRESOLVED, 0, 0, []), 4: ("Di", clusters.SEEN, 550, 1, ["9", "k"])}
    total = {tuple(r) for r in clusters.summary(clusters.applied(s, f, back)).collect()}
    assert total == {("source", clusters.SEEN, 1), ("source", clusters.FALLBACK, 1), ("person", "Ana", 1), ("person", "Eve", 1), ("unresolved", "b", 1), ("unresolved", clusters.UNKNOWN, 1), ("unresolved", "a", 1)}
