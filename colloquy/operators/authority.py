"""Who may overwrite whose name: predicates over name, source, confidence; retraction; conflicts. Confidence is in thousandths."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.columns import is_named, normal_space

#: Sources of names, by authority.
HUMAN = ("voice_enrollment", "participant_map", "user_confirmed_speaker_volume_mapping", "manual_review", "human_review")
HUMAN_PREFIXES = ("reviewed_", "manual_", "user_confirmed_")
VISUAL = ("visual_profile_reviewed_slot", "dynamic_visual_in_tile_nameplate_ocr", "visual_active_speaker_highlight", "visual_avatar_template_match", "direct_visual_voice_cluster_consensus", "same_session_visual_voiceprint")
HIGHLIGHT, ROSTER, REGISTRY, MAP = "visual_active_speaker_highlight", "visual_roster_avatar_match", "voice_registry", "participant_map"


def _source() -> Column:
    return F.coalesce("name_source", F.lit(""))


def _has_name() -> Column:
    return F.coalesce(F.col("name") != "", F.lit(False))


def trusted(least: int = 600) -> Column:
    """A person's name of enough confidence; a highlight's name only where an audit confirmed it."""
    sure = F.coalesce(F.col("confidence") >= least, F.lit(False))
    return is_named(F.col("name")) & sure & ((_source() != HIGHLIGHT) | F.coalesce("confirmed", F.lit(False)))


def human_reviewed() -> Column:
    marked = F.exists(F.array(*map(F.lit, HUMAN_PREFIXES)), lambda p: F.startswith(_source(), p))
    return _has_name() & (_source().isin(*HUMAN) | marked)


def locked() -> Column:
    """Not even a participant map replaces it."""
    return human_reviewed() & (_source() != MAP)


def protected() -> Column:
    """Neither text seen nearby nor a voice of another recording replaces it."""
    return _has_name() & (human_reviewed() | _source().isin(REGISTRY, ROSTER, *VISUAL))


def retracted(rows: DataFrame, sources: list[str]) -> DataFrame:
    """rows without the names that the given sources wrote; others stay."""
    own = _source().isin(*sources)
    return rows.withColumns({"name": F.when(~own, F.col("name")), "confidence": F.when(own, 0).otherwise(F.col("confidence")), "name_source": F.when(~own, F.col("name_source"))})


def proposed(rows: DataFrame, names: DataFrame, on: list[str], source: str, keep: Column) -> DataFrame:
    """rows with names' ``to`` (confidence ``sure``) where ``keep`` is false; where it is true and the names differ, conflict says what was proposed."""
    known = rows.withColumn("__keep", keep).join(names.select(*on, "to", "sure"), on, "left")
    take = F.col("to").isNotNull() & ~F.col("__keep")
    conflict = F.when(F.col("to").isNotNull() & F.col("__keep") & (normal_space(F.lower("to")) != normal_space(F.lower("name"))), F.col("to"))
    out = known.withColumn("conflict", conflict)
    return out.withColumns({"name": F.when(take, F.col("to")).otherwise(F.col("name")), "name_source": F.when(take, F.lit(source)).otherwise(F.col("name_source")), "confidence": F.when(take, F.col("sure")).otherwise(F.col("confidence"))}).drop("to", "sure", "__keep")
