"""Votes with thresholds that may abstain."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def consensus(rows: DataFrame, cluster: str, name: str, weight: str, least: int, share: int) -> DataFrame:
    """cluster, winner, weight, all, accepted: the name of most weight; accepted with ``least`` weight and ``share`` percent of it.

    A tie goes to the smaller name. Names are summed before clusters, so that neither is gathered in one place."""
    by = rows.groupBy(cluster, name).agg(F.sum(weight).alias("weight"))
    total = by.groupBy(cluster).agg(F.sum("weight").alias("all"), F.max(F.struct("weight", F.lit(0))).alias("top"))
    best = by.groupBy(cluster).agg(F.max("weight").alias("weight"))
    winner = by.join(best, [cluster, "weight"]).groupBy(cluster, "weight").agg(F.min(name).alias("winner"))
    out = winner.join(total.drop("top"), cluster)
    return out.withColumn("accepted", (F.col("weight") >= least) & (F.col("weight") * 100 >= F.col("all") * share))


def ranked(rows: DataFrame, cluster: str, name: str) -> DataFrame:
    """cluster, name, votes, runner_up, all, of the name with most votes."""
    by = rows.groupBy(cluster, name).agg(F.count("*").alias("votes"))
    w = Window.partitionBy(cluster)
    order = w.orderBy(F.desc("votes"), name)
    out = by.withColumn("rn", F.row_number().over(order)).withColumn("runner_up", F.coalesce(F.lead("votes").over(order), F.lit(0).cast("long"))).withColumn("all", F.sum("votes").over(w))
    return out.where("rn = 1").drop("rn")


def quartiles(rows: DataFrame, by: str, order: list[str], value: str) -> DataFrame:
    """by, quarter, n, total: contiguous quarters from floor(i * n / 4) to floor((i + 1) * n / 4)."""
    w = Window.partitionBy(by)
    rows = rows.withColumn("__i", F.row_number().over(w.orderBy(*order)) - 1).withColumn("__n", F.count("*").over(w))
    quarter = F.when(F.col("__i") < F.floor(F.col("__n") / 4), 0).when(F.col("__i") < F.floor(F.col("__n") / 2), 1).when(F.col("__i") < F.floor(3 * F.col("__n") / 4), 2).otherwise(3)
    return rows.groupBy(by, quarter.cast("long").alias("quarter")).agg(F.count("*").alias("n"), F.sum(value).alias("total"))


def threshold_sweep(scores: DataFrame, most_false: float) -> DataFrame:
    """threshold, accepted, false_accepted: the threshold among the scores with the most true accepts at a rate of false ones no
    higher than ``most_false``, the lowest of equals. scores: score, right."""
    at = scores.groupBy("score").agg(F.count_if("right").alias("good"), F.count_if(~F.col("right")).alias("bad"))
    up = Window.orderBy(F.desc("score"))
    at = at.withColumn("accepted", F.sum("good").over(up)).withColumn("false_accepted", F.sum("bad").over(up))
    total = Window.partitionBy()
    at = at.withColumn("__bad", F.sum("bad").over(total)).where(F.col("false_accepted") <= F.col("__bad") * most_false)
    return at.orderBy(F.desc("accepted"), "score").limit(1).select(F.col("score").alias("threshold"), "accepted", "false_accepted")


def sampled(frames: DataFrame, by: list[str], of_all: bool, least: int, share: int, confidence: Column) -> DataFrame:
    """by, name, votes, of, confidence, outcome: votes of the sampled frames that have a name, as a share (percent) of those or of
    all frames. confidence is computed from share_k and score_k (thousandths: share and mean score of the winner).
    A tie goes to the smaller name."""
    each = frames.groupBy(*by, "name").agg(F.count("*").alias("votes"), F.sum("score").alias("__s"))
    w = Window.partitionBy(*by)
    each = each.withColumn("of", F.sum("votes").over(w) if of_all else F.sum(F.when(F.col("name").isNotNull(), F.col("votes"))).over(w))
    each = each.where("name IS NOT NULL").withColumn("__r", F.row_number().over(w.orderBy(F.desc("votes"), "name"))).where("__r = 1")
    each = each.withColumns({"share_k": F.floor(F.col("votes") * 1000 / F.col("of")), "score_k": F.floor(F.col("__s") / F.col("votes"))})
    fine = (F.col("votes") >= least) & (F.col("share_k") >= share * 10)
    return each.select(*by, "name", "votes", "of", F.when(fine, confidence).otherwise(0).alias("confidence"), F.when(fine, "named").when(F.col("votes") < least, "few").otherwise("mixed").alias("outcome"))
