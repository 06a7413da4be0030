"""Names of voice clusters from what is seen while they speak: votes of turns, checks over time, collisions, names for segments."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.columns import wilson
from .intervals import as_of, overlap_join

#: Milliseconds, turns and thousandths that a cluster's name needs.
EROSION, EROSIONS = 800, (600, 800, 1000)
TURN = {"frames": 2, "share": 800}
TRAINING, VALIDATION = {"turns": 12, "share": 900, "bound": 750}, {"turns": 8, "share": 850, "bound": 750}
QUARTER = {"turns": 2, "share": 850, "bound": 0}
SPAN, EARLY, UNKNOWN = 120_000, 0.6, "Speaker Unknown"
#: Around a segment, least share of the frames' person, sources and confidences of the names given.
AROUND, PERSON_SHARE = 750, 600
SEEN, FALLBACK, UNRESOLVED = "visual_active_speaker_highlight", "visual_confirmed_cluster_fallback", "needs_review_visual_or_voice_enrollment"
FALLBACK_CONFIDENCE, LEAST_CONFIDENCE = 720, 600


def turn_votes(frames: DataFrame, turns: DataFrame, erosions: tuple[int, ...] = EROSIONS) -> DataFrame:
    """rec, erosion, turn, speaker, time, name, of, votes: what the frames (rec, t, name) inside a turn (rec, turn, speaker, start_ms,
    end_ms) say, its borders taken off, where two frames and four fifths of them agree.

    Frames are read once: each meets the turn that started last, then every erosion. Frames without a name don't vote; a tie goes to
    the smaller name; a turn without a speaker is nobody's (``UNKNOWN``)."""
    t = turns.select("rec", F.col("start_ms").alias("t"), "turn", F.coalesce("speaker", F.lit(UNKNOWN)).alias("speaker"), "start_ms", "end_ms")
    f = as_of(frames.where("name IS NOT NULL").select("rec", "t", "name"), t, ["rec"], ["turn", "speaker", "start_ms", "end_ms"]).where("r_turn IS NOT NULL")
    f = f.withColumn("erosion", F.explode(F.array(*map(F.lit, sorted({EROSION, *erosions}))))).where("t >= r_start_ms + erosion AND t <= r_end_ms - erosion")
    by = f.groupBy("rec", "erosion", F.col("r_turn").alias("turn"), F.col("r_speaker").alias("speaker"), F.floor((F.col("r_start_ms") + F.col("r_end_ms")) / 2).alias("time"), "name").agg(F.count("*").alias("k"))
    out = by.groupBy("rec", "erosion", "turn", "speaker", "time").agg(F.sum("k").alias("of"), F.min(F.struct((-F.col("k")).alias("k"), "name")).alias("top"))
    out = out.select("rec", "erosion", "turn", "speaker", "time", "top.name", "of", (-F.col("top.k")).alias("votes"))
    return out.where((F.col("of") >= TURN["frames"]) & (F.col("votes") * 1000 >= F.col("of") * TURN["share"]))


def passes(k: Column, n: Column, turns: int, share: int, bound: int) -> Column:
    """Enough turns, and the share and its lower bound, to the thousandth."""
    near = lambda x: F.floor(x * 1000 + 0.5)
    return F.coalesce((n >= turns) & (near(k / n) >= share) & (near(wilson(k, n)) >= bound), F.lit(False))


def named(votes: DataFrame, erosions: tuple[int, ...] = EROSIONS) -> DataFrame:
    """rec, speaker, candidate, turns, good, reasons, accepted: a row a cluster with votes at the main erosion (votes: ``turn_votes``).

    Its first three fifths and the rest must name the same and bear it out both ways; all four quarters, all erosions and two minutes
    must hold; a name that two accepted clusters of a recording claim is neither's. Counts by name go before counts by cluster."""
    key = ["rec", "speaker"]
    w = Window.partitionBy(*key)
    p = votes.where((F.col("erosion") == EROSION) & (F.col("speaker") != UNKNOWN))
    p = p.withColumn("i", F.row_number().over(w.orderBy("time", "turn")) - 1).withColumn("n", F.count("*").over(w))
    early = F.col("i") < F.ceil(F.col("n") * EARLY)
    quarter = [(F.col("i") >= F.floor(F.col("n") * q / 4)) & (F.col("i") < F.floor(F.col("n") * (q + 1) / 4)) for q in range(4)]
    counts = {"all": F.lit(True), "early": early, "late": ~early} | {f"q{q}": c for q, c in enumerate(quarter)}
    by = p.groupBy(*key, "name").agg(*(F.count_if(c).alias(k) for k, c in counts.items()), (F.max("time") - F.min("time")).alias("span"))
    first = lambda part: F.min(F.when(F.col(part) > 0, F.struct((-F.col(part)).alias("k"), "name")))["name"]
    c = by.groupBy(*key).agg(*(F.sum(k).alias(f"{k}_n") for k in counts), first("early").alias("forward"), first("late").alias("reverse"))
    c = c.withColumn("candidate", F.when(F.col("forward") == F.col("reverse"), F.col("forward")))
    c = c.join(by.withColumnRenamed("name", "candidate"), [*key, "candidate"], "left")

    each = votes.groupBy(*key, "erosion", "name").agg(F.count("*").alias("k"))
    top = each.groupBy(*key, "erosion").agg(F.sum("k").alias("n"), F.min(F.struct((-F.col("k")).alias("m"), "name")).alias("top"))
    at = c.where("candidate IS NOT NULL").select(*key, "candidate", F.explode(F.array(*map(F.lit, sorted({EROSION, *erosions})))).alias("erosion")).join(top, [*key, "erosion"], "left")
    holds = passes(-F.col("top.m"), F.col("n"), **TRAINING) & F.coalesce(F.col("top.name") == F.col("candidate"), F.lit(False))
    at = at.groupBy(*key).agg(F.collect_set(F.when(~holds, F.concat(F.lit("erosion_"), F.col("erosion").cast("string"), F.lit("_unstable")))).alias("unstable"))
    c = c.join(at, key, "left")

    def both(a: str, b: str) -> Column:
        return passes(F.col(a), F.col(f"{a}_n"), **TRAINING) & passes(F.col(b), F.col(f"{b}_n"), **VALIDATION)

    has = F.col("candidate").isNotNull()
    steady = reduce(Column.__and__, (passes(F.col(f"q{q}"), F.col(f"q{q}_n"), **QUARTER) for q in range(4)))
    found = F.filter(F.array(
        F.when(~has | ~both("early", "late"), "early_to_late_validation_failed"), F.when(~has | ~both("late", "early"), "late_to_early_validation_failed"),
        F.when(~has, "directional_candidates_disagree"), F.when(~has, "no_candidate"), F.when(has & ~steady, "quartile_stability_failed"),
        F.when(has & (F.col("span") < SPAN), "insufficient_time_span")), F.isnotnull)
    c = c.withColumn("reasons", F.concat(found, F.coalesce("unstable", F.array().cast("array<string>"))))
    fine = F.size("reasons") == 0
    rivals = F.count_if(fine).over(Window.partitionBy("rec", "candidate"))
    c = c.withColumn("reasons", F.array_sort(F.when(fine & (rivals > 1), F.array(F.lit("name_collision"))).otherwise(F.col("reasons"))))
    return c.select(*key, "candidate", F.col("all_n").alias("turns"), F.coalesce("all", F.lit(0).cast("long")).alias("good"), "reasons", fine.alias("accepted"))


def applied(segments: DataFrame, frames: DataFrame, fallback: DataFrame) -> DataFrame:
    """segments (rec, ord, speaker, start_ms, end_ms, refs and others) with name, name_source, confidence (thousandths), refs and seen.

    Of the frames (rec, t, id, name, score in thousandths) within three quarters of a second of a segment, the person of three fifths
    of them; else the name that fallback (rec, speaker, name; one a cluster) has for its speaker; else none. A tie at a lower share
    can't win. refs grows by the frames' ids where a person was seen, four at most, in order; seen is the frames that took part."""
    near = segments.select("rec", "ord", (F.col("start_ms") - AROUND).alias("start_ms"), (F.col("end_ms") + AROUND + 1).alias("end_ms"))
    f = frames.where("name IS NOT NULL").select("rec", F.col("t").alias("start_ms"), (F.col("t") + 1).alias("end_ms"), F.col("id").cast("string").alias("id"), "name", "score")
    by = overlap_join(near, f, ["rec"]).groupBy("rec", "ord", "r_name").agg(F.count("*").alias("k"), F.max("r_score").alias("score"), F.slice(F.array_sort(F.collect_set("r_id")), 1, 4).alias("ids"))
    top = F.min(F.struct((-F.col("k")).alias("k"), "r_name", "score"))
    v = by.groupBy("rec", "ord").agg(F.sum("k").alias("seen"), top.alias("top"), F.flatten(F.collect_list("ids")).alias("ids"))
    v = v.where(-F.col("top.k") * 1000 >= F.greatest(F.lit(1000), F.col("seen") * PERSON_SHARE))
    v = v.select("rec", "ord", "seen", F.col("top.r_name").alias("__name"), F.least(F.lit(750), 500 + F.floor(F.col("top.score") / 2)).alias("__sure"), "ids")
    out = segments.drop("name", "name_source", "confidence", "seen").join(v, ["rec", "ord"], "left").join(fallback.select("rec", "speaker", F.col("name").alias("__fall")), ["rec", "speaker"], "left")
    seen, fall = F.col("__name").isNotNull(), F.col("__fall").isNotNull()
    old = F.coalesce("refs", F.array().cast("array<string>"))
    return out.withColumns({
        "name": F.coalesce("__name", "__fall"), "name_source": F.when(seen, SEEN).when(fall, FALLBACK).otherwise(UNRESOLVED),
        "confidence": F.when(seen, F.col("__sure")).when(fall, FALLBACK_CONFIDENCE).otherwise(0).cast("long"), "seen": F.coalesce("seen", F.lit(0).cast("long")),
        "refs": F.when(seen, F.slice(F.array_sort(F.array_distinct(F.concat(old, "ids"))), 1, 4)).otherwise(old)}).drop("__name", "__fall", "__sure", "ids")


def summary(named: DataFrame) -> DataFrame:
    """what (source, person, unresolved), key, n: segments by source and by person whose name is sure enough, and the others by speaker."""
    sure = F.col("name").isNotNull() & (F.col("confidence") >= LEAST_CONFIDENCE)
    one = lambda what, key: F.struct(F.lit(what).alias("what"), key.alias("key"))
    rows = F.when(sure, F.array(one("source", F.col("name_source")), one("person", F.col("name")))).otherwise(F.array(one("unresolved", F.coalesce("speaker", F.lit(UNKNOWN)))))
    return named.select(F.explode(rows).alias("x")).groupBy("x.what", "x.key").agg(F.count("*").alias("n"))
