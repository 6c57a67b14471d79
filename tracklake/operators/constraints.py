"""Declared constraints over the tables of a medium, checked together: one aggregate a table and one report.

A constraint holds for each row, between a row and the one before it, or for the whole medium, where sums and counts of its
tables meet what its own row says. Breaking one is a row of the report, not an exception.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tracklake.functions.text import LANGUAGES

RATES, CHANNELS, DEPTHS = (8000, 96_000), (1, 2), (8, 16, 24, 32)


@dataclass(frozen=True)
class Table:
    """Rows by media_id and what must hold for them. A condition that is null is broken.

    each: by name, a condition on a row; after: by name, a condition given a function for columns of the row before in
    `order`, for all rows but the first; sums: by name, an aggregate that conditions on the medium may use as <table>_<name>
    (0 where the table has no rows).
    """

    rows: DataFrame
    order: tuple[str, ...] = ()
    each: dict[str, Column] = field(default_factory=dict)
    after: dict[str, Callable[[Callable[[str], Column]], Column]] = field(default_factory=dict)
    sums: dict[str, Column] = field(default_factory=dict)


def broken(ok: Column) -> Column:
    return ~F.coalesce(ok, F.lit(False))


def counted(name: str, table: Table) -> DataFrame:
    """One row a medium: how often each constraint of the table is broken, and its sums. Window and aggregate share one exchange."""
    rows, checks = table.rows, {c: broken(ok) for c, ok in table.each.items()}
    if table.after:
        w = Window.partitionBy("media_id").orderBy(*table.order)
        rows = rows.withColumns({f"_before_{c}": F.lag(c).over(w) for c in rows.columns if c != "media_id"} | {"_nth": F.row_number().over(w)})
        checks |= {c: (F.col("_nth") > 1) & broken(make(lambda x: F.col(f"_before_{x}"))) for c, make in table.after.items()}
    counts = [F.struct(F.lit(name).alias("source"), F.lit(c).alias("violation"), F.count_if(bad).alias("n")) for c, bad in checks.items()]
    found = F.array(*counts) if counts else F.array().cast("array<struct<source:string,violation:string,n:bigint>>")
    return rows.groupBy("media_id").agg(found.alias(f"_{name}"), *[v.alias(f"{name}_{c}") for c, v in table.sums.items()])


def report(media: DataFrame, tables: dict[str, Table], whole: dict[str, Column], each: dict[str, Column] | None = None) -> DataFrame:
    """(media_id, source, violation, n): constraints that a medium breaks, and how often.

    media has one row a medium; each holds for its columns, whole for them together with the tables' sums. A medium that only
    a table knows is reported as unknown_medium, with what its rows break. Nothing is reported for what holds.
    """
    parts = [counted(name, t) for name, t in tables.items()]
    wide = reduce(lambda a, b: a.join(b, "media_id", "full"), parts, media.withColumn("_listed", F.lit(True)))
    wide = wide.withColumns({f"{name}_{c}": F.coalesce(F.col(f"{name}_{c}"), F.lit(0)) for name, t in tables.items() for c in t.sums})
    listed = F.coalesce(F.col("_listed"), F.lit(False))
    own = [F.struct(F.lit("media").alias("source"), F.lit(c).alias("violation"), (listed & broken(ok)).cast("long").alias("n")) for c, ok in ((each or {}) | whole).items()]
    own.append(F.struct(F.lit("media").alias("source"), F.lit("unknown_medium").alias("violation"), (~listed).cast("long").alias("n")))
    found = F.concat(F.array(*own), *[F.coalesce(F.col(f"_{name}"), F.array().cast("array<struct<source:string,violation:string,n:bigint>>")) for name in tables])
    return wide.select("media_id", F.explode(F.filter(found, lambda x: x["n"] > 0)).alias("x")).select("media_id", "x.*")


# conditions that several tables share
def is_sha256(c: str) -> Column:
    return F.col(c).rlike("^[0-9a-fA-F]{64}$")


def is_language(c: str) -> Column:
    """A code of the library's languages, undetermined, or any three letters."""
    code = F.lower(F.trim(c))
    return code.isin(*LANGUAGES, "und") | code.rlike("^[a-z]{3}$")


def audio_constraints() -> dict[str, Column]:
    """sample_rate, channels, bit_depth, size_bytes and duration_ms of a decoded file."""
    return {
        "rate": F.col("sample_rate").between(*RATES), "channels": F.col("channels").isin(*CHANNELS), "depth": F.col("bit_depth").isin(*DEPTHS), "size": F.col("size_bytes") >= 0,
        "duration": F.col("duration_ms") >= 0,
    }


def interval_rows(total: bool = True) -> dict[str, Column]:
    """start_ms, end_ms and, if given, duration_ms of an interval, and the medium's total_ms."""
    inside = {"within_total": (F.col("total_ms") <= 0) | (F.col("end_ms") <= F.col("total_ms"))} if total else {}
    return {"start_not_negative": F.col("start_ms") >= 0, "end_after_start": F.col("end_ms") > F.col("start_ms")} | inside


def in_turn() -> dict[str, Callable[[Callable[[str], Column]], Column]]:
    return {"no_overlap": lambda before: F.col("start_ms") >= before("end_ms")}


def track_constraints(media: DataFrame, voice: DataFrame, silence: DataFrame, turns: DataFrame, segments: DataFrame, tolerance_ms: int = 2, ratio: float = 0.02) -> DataFrame:
    """The invariants of a medium's tables as a report.

    media: media_id, duration_ms, sha256, vad_sha256, language, sample_rate, channels, bit_depth, size_bytes, speech_ms,
    silence_ms, speech_ratio, n_voice, n_silence, n_turns, n_speakers, wall_s and rtf; voice and silence: start_ms, end_ms;
    turns: also speaker_label; segments: segment_index, start_ms, end_ms, duration_ms. Nothing but rows is judged of a medium
    of duration 0 where the duration is divided by.
    """
    total = media.select("media_id", F.col("duration_ms").alias("total_ms"))
    timed = lambda df: df.join(total, "media_id", "left")
    length = F.sum(F.col("end_ms") - F.col("start_ms"))
    none = F.col("duration_ms") <= 0
    tables = {
        "voice": Table(timed(voice), ("start_ms", "end_ms"), interval_rows(), in_turn(), {"sum": length, "rows": F.count("*")}),
        "silence": Table(timed(silence), ("start_ms", "end_ms"), interval_rows(), in_turn(), {"sum": length, "rows": F.count("*")}),
        "turns": Table(timed(turns), ("start_ms", "end_ms"), interval_rows() | {"label": F.col("speaker_label").rlike("^SPEAKER_[0-9]{2,}$")}, in_turn(), {"rows": F.count("*"), "speakers": F.size(F.collect_set("speaker_label"))}),
        "segments": Table(timed(segments), ("segment_index",), interval_rows() | {"duration": F.col("duration_ms") == F.col("end_ms") - F.col("start_ms"), "index": F.col("segment_index") >= 0},
            in_turn() | {"contiguous": lambda before: F.col("segment_index") == before("segment_index") + 1}, {"first": F.min("segment_index")}),
    }
    each = {"hash": is_sha256("sha256"), "language": is_language("language")} | audio_constraints()
    whole = {
        "same_hash": F.lower("sha256") == F.lower("vad_sha256"), "parts_make_total": none | (F.abs(F.col("speech_ms") + F.col("silence_ms") - F.col("duration_ms")) <= tolerance_ms),
        "speech_sum": F.col("speech_ms") == F.col("voice_sum"), "silence_sum": F.col("silence_ms") == F.col("silence_sum"),
        "ratio": none | (F.abs(F.round(F.col("voice_sum") / F.col("duration_ms"), 6) - F.round("speech_ratio", 6)) <= ratio), "voice_count": F.col("n_voice") == F.col("voice_rows"),
        "silence_count": F.col("n_silence") == F.col("silence_rows"), "turn_count": F.col("n_turns") == F.col("turns_rows"), "speaker_count": F.col("n_speakers") == F.col("turns_speakers"), "index_from_0": F.col("segments_first") == 0,
        "rtf": none | F.col("rtf").isNull() | (F.abs(F.round(1000 * F.col("wall_s") / F.col("duration_ms"), 6) - F.round("rtf", 6)) <= 1e-6),
    }
    return report(media, tables, whole, each)
