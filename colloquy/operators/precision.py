"""A gate of precision for a session's voices: thresholds fitted on one split, judged on another, reported profile by profile."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.columns import dot
from ..sources.tables import scratch
from .sequences import splits
from .vectors import centroids_of, top_two

#: The least cosine, the least lead, what the worst wrong match of the calibration adds to, held-out accepts and trials of others that a profile needs.
SETTINGS = {"score": 0.5, "margin": 0.12, "buffer": 0.02, "accepts": 3, "impostors": 20}
INSUFFICIENT, PARTIAL, CALIBRATED = "insufficient_for_precision_calibration", "partial_precision_calibrated", "precision_calibrated"


def counted(rows: DataFrame) -> DataFrame:
    """name, training, calibration, held_out: windows of each name (rows: name, part)."""
    return rows.groupBy("name").agg(*(F.count_if(F.col("part") == p).alias(p) for p in ("training", "calibration", "held_out")))


def enough(counts: DataFrame) -> Column:
    """Whether there are two names and each has three windows to train on and one in each other part: a scalar."""
    fine = (F.col("training") >= 3) & (F.col("calibration") >= 1) & (F.col("held_out") >= 1)
    return counts.agg((F.count("*") >= 2) & F.coalesce(F.min(fine), F.lit(False))).scalar()


def trials(windows: DataFrame, order: list[str]) -> DataFrame:
    """Calibration and held-out windows with best, score, second (cosines), actual (with their own name's profile), hit, lead.

    windows: name, v (whole components) and what orders them. Windows without a name or a whole vector take no part. A profile is the
    sum of its name's training windows; sums meet component by component, profiles meet windows in blocks. second is -1 for a lone
    profile, actual null where the own name has none."""
    parts = splits(usable(windows), ["name"], order)
    profiles = centroids_of(parts.where("part = 'training'"), "name")
    t = top_two(parts.where("part <> 'training'").withColumn("own_v", F.col("v")), profiles.select(F.col("name").alias("profile"), F.col("sums").alias("mean")), by_angle=True)
    size = F.sqrt(dot(F.col("own_v"), F.col("own_v")).cast("double") * dot(F.col("sums"), F.col("sums")).cast("double"))
    t = t.join(profiles.select("name", "sums"), "name", "left").withColumn("actual", F.when(F.col("sums").isNotNull(), F.when(size > 0, dot(F.col("own_v"), F.col("sums")).cast("double") / size).otherwise(0.0)))
    second = F.coalesce("second", F.lit(-1.0))
    return t.drop("own_v", "sums").withColumns({"second": second, "hit": F.col("best") == F.col("name"), "lead": F.col("score") - second})


def usable(windows: DataFrame) -> DataFrame:
    return windows.where(F.col("name").isNotNull() & F.col("v").isNotNull() & ~F.exists("v", F.isnull))


def threshold(tried: DataFrame, least: float = SETTINGS["score"], buffer: float = SETTINGS["buffer"]) -> Column:
    """The least cosine, or the best one of a wrong match of the calibration and a buffer, if that is more: a scalar."""
    wrong = F.max(F.when((F.col("part") == "calibration") & ~F.col("hit"), F.col("score")))
    return tried.agg(F.greatest(F.lit(least), F.coalesce(wrong, F.lit(-1.0)) + F.lit(buffer))).scalar()


def gate(windows: DataFrame, order: list[str], settings: dict[str, float] = SETTINGS) -> DataFrame:
    """name, training, calibration, held_out, threshold, accepted, false_accepts, impostors, reasons, eligible, status; a row a name.

    Where the windows don't suffice, threshold and the counts of trials are null, no name is eligible and no reason is given.
    A held-out window is accepted if its own profile is nearest, reaches the threshold and leads enough; one of another name that
    does so counts as a false accept against the profile that took it. No windows: no rows."""
    scratch(windows.sparkSession)
    counts = counted(splits(usable(windows), ["name"], order)).checkpoint()
    tried = trials(windows, order).select("name", "part", "best", "score", "hit", "lead").checkpoint()
    held = tried.where("part = 'held_out'").withColumn("taken", (F.col("score") >= threshold(tried, settings["score"], settings["buffer"])) & (F.col("lead") >= settings["margin"]))
    by = held.groupBy(F.col("best").alias("name")).agg(F.count_if(F.col("taken") & F.col("hit")).alias("accepted"), F.count_if(F.col("taken") & ~F.col("hit")).alias("false_accepts"))
    out = counts.join(by, "name", "left").withColumn("__fine", enough(counts))
    when = lambda c: F.when(F.col("__fine"), c)
    zero = F.lit(0).cast("long")
    out = out.withColumns({"threshold": when(threshold(tried, settings["score"], settings["buffer"])), "accepted": when(F.coalesce("accepted", zero)), "false_accepts": when(F.coalesce("false_accepts", zero)), "impostors": when(counts.agg(F.sum("held_out")).scalar() - F.col("held_out"))})
    reasons = F.filter(F.array(
        F.when(F.col("accepted") < settings["accepts"], "insufficient_held_out_accepts"),
        F.when(F.col("false_accepts") > 0, "held_out_false_accept"),
        F.when(F.col("impostors") < settings["impostors"], "insufficient_impostor_trials")), F.isnotnull)
    out = out.withColumn("reasons", reasons).withColumn("eligible", F.col("__fine") & (F.size("reasons") == 0))
    good, every = out.agg(F.count_if("eligible")).scalar(), out.agg(F.count("*")).scalar()
    return out.withColumn("status", F.when(good == 0, INSUFFICIENT).when(good == every, CALIBRATED).otherwise(PARTIAL)).drop("__fine")


def registry(windows: DataFrame, order: list[str], time: str, settings: dict[str, float] = SETTINGS) -> DataFrame:
    """name, samples, span (of all its windows' times), sums, eligible, status: the profiles of a session, from training windows where a name has any, else from all."""
    parts = splits(usable(windows), ["name"], order)
    stats = parts.groupBy("name").agg((F.max(time) - F.min(time)).alias("span"), F.max(F.col("part") == "training").alias("trained"))
    used = parts.join(stats.select("name", "trained"), "name").where("part = 'training' OR NOT trained")
    judged = gate(windows, order, settings).select("name", "eligible", "status")
    return centroids_of(used, "name").withColumnRenamed("n", "samples").join(stats.drop("trained"), "name").join(judged, "name")
