"""Composed plans: who says what and how good the track is; turns from raw diarization."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracklake.operators import intervals as I
from tracklake.operators.joins import align, overlap_join
from tracklake.operators.quality import distinct_turns, quality_rules, quality_score


def speaker_dialogue(segments: DataFrame, turns: DataFrame, media: DataFrame) -> DataFrame:
    """Flagship: each aligned segment with its speaker, and its medium's score and level.

    segments: media_id, segment_index, start_ms, end_ms, text, conf_pct; turns: media_id, speaker_label, start_ms, end_ms,
    conf_pct; media: media_id, duration_ms. Voice is the union of turns.
    """
    dialogue = align(segments.drop("speaker_label"), turns)
    rules = track_rules(segments, turns, media, dialogue)
    score = quality_score(rules, media.join(turns.select("media_id").distinct(), "media_id", "left_anti"))
    return dialogue.join(score.select("media_id", "score", "level"), "media_id").select(
        "media_id", "segment_index", "asr_segment_index", "speaker_label", F.round("alignment_conf", 6).alias("alignment_conf"), "start_ms", "end_ms", "score", "level")


def track_rules(segments: DataFrame, turns: DataFrame, media: DataFrame, dialogue: DataFrame | None = None, voice: DataFrame | None = None, words: DataFrame | None = None) -> DataFrame:
    """All quality rules. Voice is the union of the turns unless given; words (media_id, confidence) may be missing."""
    dialogue = dialogue if dialogue is not None else align(segments.drop("speaker_label"), turns)
    voice = voice if voice is not None else I.interval_union(turns.select("media_id", "start_ms", "end_ms"))
    scored = segments.select("media_id", (F.col("conf_pct") / 100.0).alias("confidence"), F.lit(None).cast("double").alias("avg_logprob"))
    return quality_rules(media, dialogue, scored, turns, voice, I.complement(voice, media), words)


def diarization_rules(turns: DataFrame, voice: DataFrame, media: DataFrame, tolerance_ms: int = 100, gap_ms: int = 50, min_ms: int = 200) -> DataFrame:
    """Raw turns (media_id, label, start_ms, end_ms, conf_pct) made disjoint, kept to voice, merged by label, none too short."""
    inside = turns.join(media.select("media_id", "duration_ms"), "media_id")
    clamped = inside.withColumns({"start_ms": F.greatest(F.lit(0).cast("long"), "start_ms"), "end_ms": F.least("end_ms", "duration_ms")}).where("end_ms > start_ms").drop("duration_ms")
    apart = I.trim_to_previous(clamped, order=("start_ms", "end_ms", "label", "conf_pct"))
    allowed = I.pad_clip(voice, media, tolerance_ms)
    met = overlap_join(apart, allowed.select("media_id", "start_ms", "end_ms"))
    cut = met.select("media_id", "label", F.greatest("start_ms", "r_start_ms").alias("start_ms"), F.least("end_ms", "r_end_ms").alias("end_ms"), "conf_pct")
    merged = I.drop_short(I.merge_same_label(cut, gap_ms), min_ms)
    return distinct_turns(merged.withColumnRenamed("label", "speaker_label"))
