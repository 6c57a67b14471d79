"""Jobs, projects and stored tracks: latest-wins tables, progress, storage plans."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tracklake.functions.text import stage_of, stage_percent, stage_status

TERMINAL = ("COMPLETED", "FAILED", "CANCELLED")
STALE_S = 30


def latest_wins(rows: DataFrame, keys: list[str], version: str) -> DataFrame:
    """One row a key: that of the greatest version."""
    rest = [c for c in rows.columns if c not in keys]
    newest = rows.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.struct(version, *[c for c in rest if c != version])).alias("_r"))
    return newest.select(*keys, *[F.col(f"_r.{c}").alias(c) for c in rest])


def upsert_tracks(old: DataFrame, new: DataFrame, keys: list[str] | None = None, version: str = "updated_at") -> DataFrame:
    """Stored tracks after new ones: the latest write of each (project_id, language) stays."""
    return latest_wins(old.unionByName(new), keys or ["project_id", "language"], version)


def top_jobs(jobs: DataFrame, by: str, k: int) -> DataFrame:
    """The k newest jobs of each `by`, with their rank from 1."""
    w = Window.partitionBy(by).orderBy(F.col("created_at").desc(), F.col("job_id").desc())
    return jobs.withColumn("rank", F.row_number().over(w).cast("long")).where(F.col("rank") <= k)


def next_queued(jobs: DataFrame) -> DataFrame:
    """The oldest queued job that nobody has claimed."""
    free = jobs.where((F.col("status") == "QUEUED") & (F.coalesce("claimed_by", F.lit("")) == ""))
    return free.orderBy("created_at", "job_id").limit(1)


def stale_owners(jobs: DataFrame, most_s: int = STALE_S) -> DataFrame:
    """Claimed, unfinished jobs whose heartbeat is too old, by owner: their number and the oldest job."""
    orphans = jobs.where((F.coalesce("claimed_by", F.lit("")) != "") & ~F.col("status").isin(*TERMINAL) & (F.col("heartbeat_age_s") > most_s))
    return orphans.groupBy("claimed_by").agg(F.count("*").alias("n_jobs"), F.min("job_id").alias("first_job"), F.max("heartbeat_age_s").alias("oldest_s"))


def last_n(events: DataFrame, key: str, order: list[str], n: int = 500) -> DataFrame:
    """The last n events of each key."""
    w = Window.partitionBy(key).orderBy(*[F.col(c).desc() for c in order])
    return events.withColumn("_r", F.row_number().over(w)).where(F.col("_r") <= n).drop("_r")


def job_status(events: DataFrame) -> DataFrame:
    """Current status of each job from (job_id, seq, status): the first terminal one, else the latest."""
    done = F.col("status").isin(*TERMINAL)
    out = events.groupBy("job_id").agg(F.min_by("status", F.when(done, F.col("seq"))).alias("_t"), F.max_by("status", "seq").alias("_l"), F.max("seq").alias("last_seq"), F.max(done).alias("_d"))
    return out.select("job_id", F.when(F.col("_d"), F.col("_t")).otherwise(F.col("_l")).alias("status"), "last_seq")


def monotone_progress(events: DataFrame) -> DataFrame:
    """Stage, status and never-falling percent of each step event (job_id, seq, step); repeats of the row before go."""
    w = Window.partitionBy("job_id").orderBy("seq")
    rows = events.withColumn("stage", stage_of(F.col("step")))
    rows = rows.withColumns({"status": stage_status(F.col("stage")), "percent": F.max(stage_percent(F.col("stage"))).over(w.rowsBetween(Window.unboundedPreceding, 0))})
    same = (F.lag("stage").over(w) == F.col("stage")) & (F.lag("percent").over(w) == F.col("percent"))
    return rows.withColumn("_same", F.coalesce(same, F.lit(False))).where(~F.col("_same")).select("job_id", "seq", "stage", "status", F.col("percent").cast("long"))


def render_state(projects: DataFrame, renders: DataFrame, most_s: int = STALE_S) -> DataFrame:
    """(project_id, language, view): idle, queued, running, failed, done or stale.

    projects: project_id, language, stamp; renders: project_id, language, state, heartbeat_age_s, stamp, storage_key.
    """
    r = renders.select("project_id", "language", "state", "heartbeat_age_s", F.col("stamp").alias("_stamp"), "storage_key")
    active = F.col("state").isin("queued", "running")
    stored = (F.col("state") == "done") & (F.coalesce("storage_key", F.lit("")) != "")
    view = (
        F.when(active & (F.col("heartbeat_age_s") > most_s), "failed").when(active | (F.col("state") == "failed"), F.col("state"))
        .when(stored & (F.col("_stamp") == F.col("stamp")), "done").when(stored, "stale").otherwise("idle")
    )
    return projects.join(r, ["project_id", "language"], "left").select("project_id", "language", view.alias("view"))


def storage_fit_plan(media: DataFrame, limit_bytes: int, max_minutes: int = 25, safety: float = 0.95, audio: int = 128, least_video: int = 150) -> DataFrame:
    """Encoding plan to fit a byte limit: total, audio and video kbps, height, needs_fit and too_long. media: media_id, size_bytes, duration_ms."""
    seconds = F.greatest(F.col("duration_ms") / 1000.0, F.lit(1.0))
    total = F.lit(limit_bytes * 8 * safety) / seconds / 1000
    sound = F.when(total >= 900, audio).when(total >= 500, 96).otherwise(64)
    rows = media.withColumns({"total_kbps": F.round(total, 6), "audio_kbps": sound}).withColumn("video_kbps", (total - F.col("audio_kbps")).cast("long"))
    height = F.when(F.col("video_kbps") < 450, 480).when(F.col("video_kbps") < 2500, 720).otherwise(1080)
    over = F.lit(limit_bytes > 0) & (F.col("size_bytes") > limit_bytes)
    long = over & ((F.col("duration_ms") <= 0) | (F.col("duration_ms") >= (max_minutes + 1) * 60_000) | (F.col("video_kbps") < least_video))
    return rows.select("media_id", "total_kbps", "audio_kbps", "video_kbps", height.alias("height"), (over & ~long).alias("needs_fit"), long.alias("too_long"))


def track_complete(coverage: DataFrame, media: DataFrame, languages: list[str]) -> DataFrame:
    """(media_id, complete): whether in all languages the first range starts at 0 and reaches the duration. Ranges are disjoint."""
    of = lambda lang, c: F.when(F.col("language") == lang, F.col(c))
    each = [x for i, lang in enumerate(languages) for x in (F.min(of(lang, "start_ms")).alias(f"s{i}"), F.min_by(of(lang, "end_ms"), of(lang, "start_ms")).alias(f"e{i}"))]
    out = media.select("media_id", "duration_ms").join(coverage.where(F.col("language").isin(languages)).groupBy("media_id").agg(*each), "media_id", "left")
    ok = [F.coalesce((F.col(f"s{i}") <= 0) & (F.col(f"e{i}") >= F.col("duration_ms")), F.lit(False)) for i in range(len(languages))]
    return out.select("media_id", reduce(lambda a, b: a & b, ok).alias("complete"))


def reindex(rows: DataFrame, order: list[str], key: str = "media_id", name: str = "idx") -> DataFrame:
    """rows with a contiguous index from 0."""
    return rows.withColumn(name, F.row_number().over(Window.partitionBy(key).orderBy(*order)).cast("long") - 1)


def first_appearance(rows: DataFrame, label: str, order: list[str], key: str = "media_id") -> Column:
    return F.min(F.struct(*order, label)).over(Window.partitionBy(key, label))


def speaker_name(n: Column) -> Column:
    """SPEAKER_NN of a number from 0."""
    s = n.cast("string")
    return F.concat(F.lit("SPEAKER_"), F.when(F.length(s) < 2, F.lpad(s, 2, "0")).otherwise(s))


def labels_by_first_appearance(rows: DataFrame, label: str, order: list[str], key: str = "media_id", out: str = "speaker_label") -> DataFrame:
    """Cluster ids as SPEAKER_00, SPEAKER_01, ... in order of first appearance."""
    rows = rows.withColumn("_f", first_appearance(rows, label, order, key))
    return rows.withColumn(out, speaker_name(F.dense_rank().over(Window.partitionBy(key).orderBy("_f")) - 1)).drop("_f")


def normalise_labels(rows: DataFrame, order: list[str], label: str = "label", key: str = "media_id", out: str = "speaker_label") -> DataFrame:
    """Upper-cased, trimmed labels; valid ones stay, the others are numbered from SPEAKER_00 by first appearance."""
    rows = rows.withColumn("_l", F.upper(F.trim(F.coalesce(label, F.lit("")))))
    rows = rows.withColumn("_ok", F.col("_l").rlike("^SPEAKER_[0-9]{2,}$")).withColumn("_f", first_appearance(rows, "_l", order, key))
    numbered = speaker_name(F.dense_rank().over(Window.partitionBy(key, "_ok").orderBy("_f")) - 1)
    return rows.withColumn(out, F.when(F.col("_ok"), F.col("_l")).otherwise(numbered)).drop("_l", "_ok", "_f")


def segment_context(segments: DataFrame) -> DataFrame:
    """Segments with previous_text and next_text."""
    w = Window.partitionBy("media_id").orderBy("segment_index")
    return segments.withColumns({"previous_text": F.lag("text").over(w), "next_text": F.lead("text").over(w)})


def speech_ratio(windows: DataFrame, blocks: DataFrame, block_ms: int = 100, floor: float = 0.01, silent: float = 0.001) -> DataFrame:
    """Share of each window's whole blocks with rms >= floor, and whether the window is skipped (share below `silent`).

    windows: media_id, window_index, start_ms, end_ms; blocks: media_id, block_index, rms. Windows are spread over their blocks'
    indexes, so the join is on equal keys.
    """
    spread = windows.select("media_id", "window_index", F.explode(F.sequence(F.ceil(F.col("start_ms") / block_ms).cast("long"), F.greatest(F.ceil(F.col("start_ms") / block_ms), F.floor(F.col("end_ms") / block_ms) - 1).cast("long"))).alias("block_index"))
    share = spread.join(blocks, ["media_id", "block_index"]).groupBy("media_id", "window_index").agg(F.round(F.avg((F.col("rms") >= floor).cast("double")), 6).alias("r"))
    out = windows.join(share, ["media_id", "window_index"], "left").withColumn("speech_ratio", F.coalesce("r", F.lit(0.0)))
    return out.select("media_id", "window_index", "speech_ratio", (F.col("speech_ratio") < silent).alias("skipped"))
