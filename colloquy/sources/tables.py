"""Sources: tables, and relations in the shape of a recording derived from them. Times are whole milliseconds."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..session import ship

#: Of a transcript: pass it when reading JSON, so that no file is read twice to guess it.
SEGMENT_SCHEMA = "id string, start double, end double, text string, speaker string, speaker_confidence double, name string, name_source string, name_confidence double, words array<struct<word: string, start: double, end: double>>, frame_refs array<string>"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    ship(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def transcript(spark: SparkSession, path: str) -> DataFrame:
    """A JSON array of segments."""
    return spark.read.schema(SEGMENT_SCHEMA).json(path, multiLine=True)


def clipped(segments: DataFrame, start: int, duration: int) -> DataFrame:
    return segments.where((F.col("start_ms") >= start) & (F.col("start_ms") < start + duration))


def segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """rec, ord, speaker, text, start_ms, end_ms: a conversation's turns, 60 ms a character, end to end."""
    c = table(spark, sf_dir, "conversations")
    before = Window.partitionBy("conv_id").orderBy("turn").rowsBetween(Window.unboundedPreceding, -1)
    size = (60 * F.length("text")).cast("long")
    c = c.withColumn("size", size).withColumn("start_ms", F.coalesce(F.sum("size").over(before), F.lit(0).cast("long")))
    return c.select(F.col("conv_id").alias("rec"), F.col("turn").alias("ord"), F.col("role").alias("speaker"), "text", "start_ms", (F.col("start_ms") + F.col("size")).alias("end_ms"))


def turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """rec, turn, speaker, conf (thousandths), start_ms, end_ms: the same conversations cut in another way."""
    s = segments(spark, sf_dir).withColumn("turn", F.floor(F.col("ord") / 2))
    t = s.groupBy("rec", "turn").agg(F.min_by("speaker", "ord").alias("speaker"), (F.min("start_ms") + 700).alias("start_ms"), (F.max("end_ms") + 700).alias("end_ms"))
    return t.withColumn("conf", 500 + (F.col("rec") * 7 + F.col("turn") * 13) % 500)


def frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    """rec, id, t (ms), name, score (thousandths): events as observations of a recording."""
    e = table(spark, sf_dir, "events")
    t = F.unix_micros(F.col("ts").cast("timestamp")) / 1000
    return e.select(F.col("user_id").alias("rec"), F.col("event_id").alias("id"), F.floor(t).alias("t"), F.col("event_type").alias("name"), F.floor(F.col("value") * 1000).alias("score"))


#: Sources of names, dealt to segments by place.
SOURCES = ("participant_map", "manual_review", "reviewed_notes", "voice_registry", "visual_roster_avatar_match", "visual_active_speaker_highlight", "ocr_candidates_only", "")


def named_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Segments with name, name_source, confidence (thousandths) and confirmed."""
    k = F.col("rec") + F.col("ord")
    name = F.when(F.col("speaker") == "user", F.concat(F.lit("Person "), (F.col("rec") % 5).cast("string"))).when(F.col("speaker") == "assistant", F.concat(F.lit("Guest "), (F.col("ord") % 3).cast("string"))).otherwise("Speaker 1")
    source = F.element_at(F.array(*map(F.lit, SOURCES)), (k % 8 + 1).cast("int"))
    return segments(spark, sf_dir).withColumns({"name": name, "name_source": source, "confidence": 400 + (F.col("rec") * 7 + F.col("ord") * 13) % 600, "confirmed": k % 2 == 0})


#: Sentences with the cues of commitments, intents, states and lengths, dealt to segments by place.
SAID = (
    "I will deploy the release in 2 hours.", "I'll test the build, I'll test it again.", "Let me explain the plan first.", "I will not move the server.",
    "We need to review the contract with Ana.", "Please make sure that the invoice", "Make sure that the backup is running.", "I would like to schedule the maintenance, no downtime.",
    "Ana will send the report tomorrow.", "Ben plans to migrate the database in 90 minutes.", "The retest is already completed.", "We need to retest it, the retest was not done.",
    "The service was deployed and it is done.", "Please deploy it, it should be deployed soon.", "I'm going to fix it in 3 hours, then verify the restart.", "我会测试半小时。",
    "If it works, I need to update the docs in 1 hour.", "I want to create a ticket for the API.", "Nothing to add, Ana asked. Ben will see.", "Let me restart it, I need to verify 30 minutes of downtime.",
)


def spoken(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Named segments whose text is one of ``SAID``: the given conversations hold invented words only."""
    k = (F.col("rec") * 3 + F.col("ord") * 7) % len(SAID)
    return named_segments(spark, sf_dir).withColumn("text", F.element_at(F.array(*map(F.lit, SAID)), (k + 1).cast("int")))


def scratch(spark: SparkSession) -> str:
    """A folder that all executors share: the one set in spark.checkpoint.dir; a local one only where none is set."""
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if folder is None and not sc.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        sc.setCheckpointDir(folder or tempfile.mkdtemp(prefix="colloquy-"))
    return sc.getCheckpointDir()
