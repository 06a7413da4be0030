"""Names of speakers: overlays, conflicts, agreement over time, open-set decisions."""

from __future__ import annotations

import difflib

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StringType

from ..functions.columns import is_named, wilson


def relabelled(rows: DataFrame, names: DataFrame) -> DataFrame:
    """rows with name from names (speaker, name): known speakers with one real name that no other speaker has; else unchanged."""
    w = Window.partitionBy("speaker")
    good = names.where(is_named(F.col("name"))).withColumn("a", F.count("*").over(w)).withColumn("b", F.count("*").over(Window.partitionBy(F.lower("name")))).where("a = 1 AND b = 1")
    return rows.join(good.select("speaker", F.col("name").alias("__to")), "speaker", "left").withColumn("name", F.coalesce("__to", "name")).drop("__to")


def confirmed_only(rows: DataFrame, audit: DataFrame, on: list[str]) -> DataFrame:
    """rows whose direct name stays only with a confirmed audit; a missing one clears it."""
    ok = audit.where("confirmed").select(*on).distinct().withColumn("__ok", F.lit(True))
    return rows.join(ok, on, "left").withColumn("name", F.when(F.col("__ok") | ~F.col("direct"), F.col("name"))).drop("__ok")


def gated_clusters(rows: DataFrame, cluster: str, least: int = 12, coverage: float = 0.75, share: float = 0.9) -> DataFrame:
    """cluster, winner, votes, named, all, accepted: of named rows the winner's votes, share of them, and their share of all rows."""
    by = rows.where(is_named(F.col("name"))).groupBy(cluster, "name").agg(F.count("*").alias("votes"))
    order = Window.partitionBy(cluster).orderBy(F.desc("votes"), "name")
    best = by.withColumn("named", F.sum("votes").over(Window.partitionBy(cluster))).withColumn("rn", F.row_number().over(order)).where("rn = 1")
    total = rows.groupBy(cluster).agg(F.count("*").alias("all"))
    out = best.join(total, cluster).select(cluster, F.col("name").alias("winner"), "votes", "named", "all")
    return out.withColumn("accepted", (F.col("votes") >= least) & (F.col("votes") >= share * F.col("named")) & (F.col("named") >= coverage * F.col("all")))


def agreement_over_time(votes: DataFrame, cluster: str, order: list[str], early: float = 0.6) -> DataFrame:
    """cluster, candidate, n, early_good, early_n, late_good, late_n, collides: the first ceil(early * n) votes name the candidate,
    the others check it; a candidate of several clusters is a collision that rejects them all."""
    w = Window.partitionBy(cluster)
    rows = votes.withColumn("i", F.row_number().over(w.orderBy(*order))).withColumn("n", F.count("*").over(w))
    rows = rows.withColumn("is_early", F.col("i") <= F.ceil(early * F.col("n")))
    first = rows.where("is_early").groupBy(cluster, "name").agg(F.count("*").alias("k"))
    top = Window.partitionBy(cluster).orderBy(F.desc("k"), "name")
    first = first.withColumn("rn", F.row_number().over(top)).where("rn = 1").select(cluster, F.col("name").alias("candidate"))
    good = F.col("name") == F.col("candidate")
    out = rows.join(first, cluster).groupBy(cluster, "candidate").agg(F.max("n").alias("n"), F.count_if(F.col("is_early") & good).alias("early_good"), F.count_if("is_early").alias("early_n"), F.count_if(~F.col("is_early") & good).alias("late_good"), F.count_if(~F.col("is_early")).alias("late_n"))
    return out.withColumn("collides", F.count("*").over(Window.partitionBy("candidate")) > 1)


def stable(rows: DataFrame, least: float = 0.75) -> Column:
    """Wilson bounds of both halves reach ``least`` and no other cluster has the name."""
    return (wilson(F.col("early_good"), F.col("early_n")) >= least) & (wilson(F.col("late_good"), F.col("late_n")) >= least) & ~F.col("collides")


def quorum(answers: DataFrame, samples: DataFrame, agents: DataFrame) -> DataFrame:
    """sample, complete, agreed: every agent's first answer is there, and all say yes. agents: a short list."""
    first = answers.groupBy("sample", "agent").agg(F.min_by("yes", "ord").alias("yes"))
    wanted = samples.select("sample").join(F.broadcast(agents.select("agent")))
    joined = wanted.join(first, ["sample", "agent"], "left")
    return joined.groupBy("sample").agg(F.bool_and(F.col("yes").isNotNull()).alias("complete"), F.bool_and(F.coalesce("yes", F.lit(False))).alias("agreed"))


@F.pandas_udf(StringType())
def compatible(text: pd.Series) -> pd.Series:
    """Compatibility composition (NFKC), which Spark lacks, a batch at a time."""
    return text.str.normalize("NFKC")


def normal_form(text: Column | str) -> Column:
    """Composed, in lower case, each run of other characters than letters, digits and _ one space, none at the ends."""
    return F.trim(F.regexp_replace(F.lower(compatible(text)), r"(?U)[^\w]+", " "))


@F.pandas_udf(DoubleType())
def likeness(a: pd.Series, b: pd.Series) -> pd.Series:
    """Share of matching blocks of two short strings."""
    return pd.Series([difflib.SequenceMatcher(None, x or "", y or "").ratio() for x, y in zip(a, b, strict=True)])


def resolved(rows: DataFrame, whitelist: DataFrame, least: float = 0.82) -> DataFrame:
    """rows with resolved: the whitelist's name that equals name, case aside, or else the most alike one at ``least`` (a tie: the larger
    name). whitelist: a short list of names, which is broadcast; rows are told apart by id."""
    listed = F.broadcast(whitelist.select(F.col("name").alias("listed")))
    pairs = rows.join(listed).withColumn("score", F.when(F.lower("name") == F.lower("listed"), 2.0).otherwise(likeness(F.lower("name"), F.lower("listed"))))
    best = pairs.where(F.col("score") >= least).groupBy("id").agg(F.max(F.struct("score", "listed"))["listed"].alias("resolved"))
    return rows.join(best, "id", "left")
