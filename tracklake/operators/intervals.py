"""Interval algebra on media timelines: half-open [start_ms, end_ms) in integer milliseconds, keyed by media.

Every function takes and gives DataFrames. They share one window, partitioned by the keys and ordered by time, so that a
chain of them needs one exchange and one sort. No function compares a null lag or lead: `least` and `greatest` skip nulls.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

KEYS = ("media_id",)


def by_time(keys: tuple[str, ...] = KEYS, *order: str) -> WindowSpec:
    return Window.partitionBy(*keys).orderBy(*(order or ("start_ms", "end_ms")))


def before(w: WindowSpec) -> WindowSpec:
    """All rows before the current one."""
    return w.rowsBetween(Window.unboundedPreceding, -1)


def as_long(*columns: str) -> list[Column]:
    return [F.col(c).cast("long").alias(c) for c in columns]


def islands(df: DataFrame, breaks: Column, w: WindowSpec) -> DataFrame:
    """df with _island, the number of breaks so far."""
    return df.withColumn("_break", breaks.cast("int")).withColumn("_island", F.sum("_break").over(w.rowsBetween(Window.unboundedPreceding, 0)))


def of_islands(df: DataFrame, breaks: Column, first: tuple[str, ...], w: WindowSpec) -> DataFrame:
    """The last row of every island, with _first, the given columns of its first row. The windows' own sort serves; no row is hashed."""
    so_far = w.rowsBetween(Window.unboundedPreceding, 0)
    rows = df.withColumn("_break", breaks)
    rows = rows.withColumns({"_first": F.last(F.when(F.col("_break"), F.struct(*first)), ignorenulls=True).over(so_far), "_last": F.coalesce(F.lead("_break").over(w), F.lit(True))})
    return rows.where("_last")


def speech_runs(frames: DataFrame, totals: DataFrame | None = None, threshold: float = 0.5, frame: int = 512, rate: int = 16000) -> DataFrame:
    """Runs of consecutive frames with prob >= threshold: (media_id, start_ms, end_ms, max_conf, sample_count).

    totals (media_id, total_samples) cuts the last run at the true sample count.
    """
    hot = frames.where(F.col("prob") >= threshold)
    hot = hot.withColumn("_island", F.col("frame_index") - F.row_number().over(Window.partitionBy("media_id").orderBy("frame_index")))
    runs = hot.groupBy("media_id", "_island").agg(F.min("frame_index").alias("a"), F.max("frame_index").alias("b"), F.max("prob").alias("max_conf"))
    end = (F.col("b") + 1) * frame
    if totals is not None:
        runs, end = runs.join(totals.select("media_id", "total_samples"), "media_id", "left"), F.least(end, F.col("total_samples"))
    ms = lambda samples: F.bround(samples * F.lit(1000.0) / rate).cast("long")
    start = F.col("a") * frame
    conf = F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.col("max_conf")))
    return runs.select("media_id", ms(start).alias("start_ms"), ms(end).alias("end_ms"), conf.alias("max_conf"), F.greatest(F.lit(0), end - start).cast("long").alias("sample_count"))


def drop_short(df: DataFrame, min_ms: int = 200) -> DataFrame:
    return df.where(F.col("end_ms") - F.col("start_ms") >= min_ms)


def merge_proximal(df: DataFrame, gap_ms: int = 200, keys: tuple[str, ...] = KEYS, conf: str = "max_conf", samples: str = "sample_count", order: tuple[str, ...] = ()) -> DataFrame:
    """Merge a row with the one before if it starts 0 to gap_ms after that one's end; an overlap does not merge.

    gap_ms <= 0 leaves the rows as they are. Largest confidence, sum of samples.
    """
    keep = [*keys, "start_ms", "end_ms", conf, samples]
    if gap_ms <= 0:
        return df.select(*keep)
    w = by_time(keys, *order)
    gap = F.col("start_ms") - F.lag("end_ms").over(w)
    parts = islands(df, ~F.coalesce(gap.between(0, gap_ms), F.lit(False)), w).groupBy(*keys, "_island")
    out = parts.agg(F.min("start_ms").alias("start_ms"), F.max("end_ms").alias("end_ms"), F.max(conf).alias(conf), F.sum(samples).cast("long").alias(samples))
    return out.select(*keep)


def complement(df: DataFrame, totals: DataFrame) -> DataFrame:
    """Silences between intervals and at both ends, with the index of the interval before and after (-1: none).

    totals: (media_id, duration_ms); a medium without intervals is one silence.
    """
    rows = df.select("media_id", "start_ms", "end_ms", F.lit(0).alias("_tail"))
    tails = totals.select("media_id", F.col("duration_ms").alias("start_ms"), F.col("duration_ms").alias("end_ms"), F.lit(1).alias("_tail"))
    w = by_time(KEYS, "_tail", "start_ms", "end_ms")
    at = F.coalesce(F.max("end_ms").over(before(w)), F.lit(0).cast("long"))
    n = F.row_number().over(w).cast("long") - 1
    out = rows.unionByName(tails).select("media_id", at.alias("_at"), "start_ms", (n - 1).alias("before_index"), F.when(F.col("_tail") == 1, F.lit(-1)).otherwise(n).cast("long").alias("after_index"))
    return out.where("start_ms > _at").select("media_id", F.col("_at").alias("start_ms"), F.col("start_ms").alias("end_ms"), "before_index", "after_index")


def vad_totals(voice: DataFrame, totals: DataFrame) -> DataFrame:
    """speech_ms, silence_ms, n_intervals and speech_ratio (0 to 1, 6 places) of each medium, silent ones too."""
    sums = voice.groupBy("media_id").agg(F.sum(F.col("end_ms") - F.col("start_ms")).alias("s"), F.count("*").alias("n"))
    speech = F.coalesce("s", F.lit(0)).cast("long")
    ratio = F.when(F.col("duration_ms") > 0, speech / F.col("duration_ms")).otherwise(F.lit(0.0))
    return totals.join(sums, "media_id", "left").select(
        "media_id", speech.alias("speech_ms"), F.greatest(F.lit(0), F.col("duration_ms") - speech).cast("long").alias("silence_ms"),
        F.coalesce("n", F.lit(0)).cast("long").alias("n_intervals"), F.round(F.greatest(F.lit(0.0), F.least(F.lit(1.0), ratio)), 6).alias("speech_ratio"),
    )


def interval_union(df: DataFrame, keys: tuple[str, ...] = KEYS, bin_ms: int | None = None) -> DataFrame:
    """Disjoint cover of the intervals; ranges that touch merge.

    For keys that hold a large share of all rows, bin_ms unites within bins of the start first, in many tasks, so that
    only the bins' covers meet in the key's task. The result is the same.
    """
    if bin_ms:
        bins = df.select(*keys, F.floor(F.col("start_ms") / bin_ms).alias("_bin"), "start_ms", "end_ms")
        df = interval_union(bins, (*keys, "_bin")).drop("_bin")
    w = by_time(keys)
    rows = df.select(*keys, "start_ms", "end_ms").withColumns({"_seen": F.max("end_ms").over(before(w)), "_end": F.max("end_ms").over(w.rowsBetween(Window.unboundedPreceding, 0))})
    parts = of_islands(rows, F.coalesce(F.col("start_ms") > F.col("_seen"), F.lit(True)), ("start_ms",), w)
    return parts.select(*keys, F.col("_first.start_ms").alias("start_ms"), F.col("_end").alias("end_ms"))


def pad_clip(df: DataFrame, totals: DataFrame, tolerance_ms: int = 100) -> DataFrame:
    """Widen by the tolerance, clip to [0, duration], unite."""
    wide = df.join(totals.select("media_id", "duration_ms"), "media_id").select(
        "media_id", F.greatest(F.lit(0).cast("long"), F.col("start_ms") - tolerance_ms).alias("start_ms"), F.least("duration_ms", F.col("end_ms") + tolerance_ms).alias("end_ms"))
    return interval_union(wide.where("end_ms > start_ms"))


def trim_to_previous(df: DataFrame, keys: tuple[str, ...] = KEYS, order: tuple[str, ...] = ("start_ms", "end_ms"), raw: str | None = None) -> DataFrame:
    """Each row starts no earlier than the largest end before it; empty rows go. Of equal intervals the first in order stays.

    raw names a column for the untrimmed start: what is left is in the same order by it, so the next step needs no other sort.
    """
    if raw:
        df, order = df.withColumn(raw, F.col("start_ms")), tuple(raw if c == "start_ms" else c for c in order)
    seen = F.max("end_ms").over(before(by_time(keys, *order)))
    return df.withColumn("start_ms", F.greatest("start_ms", F.coalesce(seen, F.col("start_ms")))).where("end_ms > start_ms")


def trim_to_next(df: DataFrame, totals: DataFrame, order: tuple[str, ...] = ("start_ms", "end_ms", "idx"), min_ms: int = 10) -> DataFrame:
    """Rows in order, those from the total on dropped, ends cut to the next start and to the total.

    Adds overlap_normalized, end_clamped, segment_index (0 up), duration_ms (1 at least), valid (end > start) and too_short.
    """
    rows = df.join(totals.select("media_id", "duration_ms"), "media_id").where(F.col("start_ms") < F.col("duration_ms")).withColumnRenamed("duration_ms", "_total")
    w = by_time(KEYS, *order)
    following = F.lead("start_ms").over(w)
    rows = rows.withColumns({"segment_index": F.row_number().over(w).cast("long") - 1, "overlap_normalized": F.coalesce(F.col("end_ms") > following, F.lit(False)), "_cut": F.least("end_ms", F.coalesce(following, F.col("end_ms")))})
    rows = rows.withColumns({"end_clamped": F.col("_cut") > F.col("_total"), "end_ms": F.least("_cut", "_total")})
    length = F.col("end_ms") - F.col("start_ms")
    return rows.withColumns({"duration_ms": F.greatest(F.lit(1), length).cast("long"), "valid": length > 0, "too_short": F.greatest(F.lit(0), length) < min_ms}).drop("_cut", "_total")


def merge_same_label(df: DataFrame, gap_ms: int = 50, label: str = "label", conf: str = "conf_pct", keys: tuple[str, ...] = KEYS, order: tuple[str, ...] = ()) -> DataFrame:
    """Merge neighbours of one label whose gap is at most gap_ms; the first confidence stays. Rows must be disjoint."""
    w = by_time(keys, *order)
    same = (F.lag(label).over(w) == F.col(label)) & (F.col("start_ms") - F.lag("end_ms").over(w) <= gap_ms)
    parts = of_islands(df, ~F.coalesce(same, F.lit(False)), ("start_ms", conf), w)
    return parts.select(*keys, label, F.col("_first.start_ms").alias("start_ms"), "end_ms", F.col("_first")[conf].alias(conf))


def coverage_summary(coverage: DataFrame, at_ms: int, keys: tuple[str, ...] = ("media_id", "language")) -> DataFrame:
    """Of disjoint ranges: whether at_ms is covered, the last end up to it, the end of the range from 0, the total."""
    return coverage.groupBy(*keys).agg(
        F.bool_or((F.col("start_ms") <= at_ms) & (F.col("end_ms") > at_ms)).alias("contains"),
        F.coalesce(F.max(F.when(F.col("end_ms") <= at_ms, F.col("end_ms"))), F.lit(0)).cast("long").alias("last_end_ms"),
        F.coalesce(F.max(F.when(F.col("start_ms") <= 0, F.col("end_ms"))), F.lit(0)).cast("long").alias("prefix_end_ms"),
        F.sum(F.col("end_ms") - F.col("start_ms")).cast("long").alias("total_ms"),
    )


def gaps_within(coverage: DataFrame, bounds: DataFrame, keys: tuple[str, ...]) -> DataFrame:
    """Uncovered [start_ms, end_ms) inside each row of bounds (keys, lo, hi, each pair once a key); coverage is disjoint."""
    tail = bounds.select(*keys, "lo", "hi", F.col("hi").alias("start_ms"), F.col("hi").alias("end_ms"), F.lit(1).alias("_tail"))
    inside = bounds.join(coverage.select(*keys, "start_ms", "end_ms"), list(keys)).where((F.col("end_ms") > F.col("lo")) & (F.col("start_ms") < F.col("hi")))
    rows = inside.select(*keys, "lo", "hi", "start_ms", "end_ms", F.lit(0).alias("_tail")).unionByName(tail)
    w = Window.partitionBy(*keys, "lo", "hi").orderBy("_tail", "start_ms", "end_ms")
    at = F.greatest(F.col("lo"), F.coalesce(F.max("end_ms").over(before(w)), F.col("lo")))
    return rows.withColumn("_at", at).where("start_ms > _at").select(*keys, "lo", "hi", F.col("_at").alias("start_ms"), F.least("start_ms", "hi").alias("end_ms"))


def first_gap(coverage: DataFrame, bounds: DataFrame, keys: tuple[str, ...] = ("media_id", "language")) -> DataFrame:
    """First uncovered range inside [lo, hi) of each key; keys wholly covered have no row."""
    gaps = gaps_within(coverage, bounds, keys)
    return gaps.groupBy(*keys).agg(F.min("start_ms").alias("start_ms"), F.min_by("end_ms", "start_ms").alias("end_ms"))


def coverage_difference(source: DataFrame, target: DataFrame, keys: tuple[str, ...] = KEYS) -> DataFrame:
    """Source-covered ranges that target does not cover; both disjoint."""
    bounds = source.select(*keys, F.col("start_ms").alias("lo"), F.col("end_ms").alias("hi"))
    return gaps_within(target, bounds, keys).select(*keys, "start_ms", "end_ms")


def overlapping_windows(totals: DataFrame, window_ms: int = 30_000, overlap_ms: int = 1000, first_ms: int | None = None, min_tail_ms: int = 500) -> DataFrame:
    """Windows over each medium, each overlapping the one before; the first may be shorter; a short tail is dropped.

    Window k > 0 starts at size0 - overlap + (k - 1)(window - overlap). The last is the first that reaches the end.
    """
    first = min(max(first_ms, min_tail_ms), window_ms) if first_ms else window_ms
    if not 0 <= overlap_ms < window_ms or first <= overlap_ms:
        raise ValueError("windows must be longer than their overlap")
    step, base = window_ms - overlap_ms, first - overlap_ms
    total = F.col("duration_ms")
    last = F.when(total <= first, F.lit(0)).otherwise(F.ceil((total - first) / step)).cast("long")
    k = F.col("window_index")
    rows = totals.where(total > 0).select("media_id", "duration_ms", F.explode(F.sequence(F.lit(0).cast("long"), last)).alias("window_index"))
    start = F.when(k == 0, 0).otherwise(base + (k - 1) * step).cast("long")
    end = F.least(total, F.when(k == 0, first).otherwise(start + window_ms)).cast("long")
    return rows.select("media_id", "window_index", start.alias("start_ms"), end.alias("end_ms")).where(F.col("end_ms") - F.col("start_ms") >= min_tail_ms)


def pivot_split(df: DataFrame, label: str = "label", keys: tuple[str, ...] = KEYS) -> DataFrame:
    """Label runs over overlapping spans in order: one label extends, a gap cuts, a change of label cuts halfway (float ms)."""
    w = by_time(keys, "start_ms", "end_ms")
    prev_end, prev_label = F.lag("end_ms").over(w), F.lag(label).over(w)
    same = F.coalesce((F.col("start_ms") <= prev_end) & (prev_label == F.col(label)), F.lit(False))
    rows = islands(df.withColumns({"_pe": prev_end, "_same": same}), ~same, w)
    start = F.when(F.col("start_ms") <= F.col("_pe"), (F.col("start_ms") + F.col("_pe")) / 2).otherwise(F.col("start_ms").cast("double"))
    runs = rows.groupBy(*keys, "_island").agg(F.min_by(start, F.struct("start_ms", "end_ms")).alias("run_start"), F.max_by("end_ms", F.struct("start_ms", "end_ms")).cast("double").alias("run_end"), F.first(label).alias(label))
    following = F.lead("run_start").over(Window.partitionBy(*keys).orderBy("_island"))
    return runs.select(*keys, label, F.col("run_start").alias("start_ms"), F.least("run_end", F.coalesce(following, F.col("run_end"))).alias("end_ms"))


def sliding_subsegments(voice: DataFrame, window_ms: int = 1500, step_ms: int = 750, min_ms: int = 255) -> DataFrame:
    """Spans of window_ms every step_ms inside each voice interval of min_ms or more; ends clipped."""
    length = F.col("end_ms") - F.col("start_ms")
    n = F.greatest(F.lit(1), F.floor((length - window_ms) / step_ms) + 1).cast("long")
    rows = voice.where(length >= min_ms).select("media_id", F.col("start_ms").alias("voice_start_ms"), F.col("end_ms").alias("_e"), F.explode(F.sequence(F.lit(0).cast("long"), n - 1)).alias("k"))
    start = F.col("voice_start_ms") + F.col("k") * step_ms
    return rows.select("media_id", "voice_start_ms", "k", start.alias("start_ms"), F.least("_e", start + window_ms).alias("end_ms"))


def pad_asr_windows(voice: DataFrame, totals: DataFrame, pad_ms: int = 120) -> DataFrame:
    """Voice intervals padded and clipped; offset_ms is the padded start."""
    start = F.greatest(F.lit(0).cast("long"), F.col("start_ms") - pad_ms)
    rows = voice.join(totals.select("media_id", "duration_ms"), "media_id")
    return rows.select("media_id", start.alias("start_ms"), F.least("duration_ms", F.col("end_ms") + pad_ms).alias("end_ms"), start.alias("offset_ms")).where("end_ms > start_ms")


def voice_only_length(voice: DataFrame, totals: DataFrame, rate: int = 16000) -> DataFrame:
    """Used intervals and analysed ms of each medium, intervals clipped to its samples."""
    to = lambda c: F.expr(f"{c} * {rate} div 1000")
    rows = voice.join(totals.select("media_id", "duration_ms"), "media_id")
    n = F.greatest(F.lit(0), F.least(to("end_ms"), to("duration_ms")) - F.greatest(F.lit(0).cast("long"), to("start_ms")))
    sums = rows.groupBy("media_id").agg(F.count_if(n > 0).alias("used_intervals"), F.sum(n).cast("long").alias("samples"))
    return sums.select("media_id", "used_intervals", F.expr(f"samples * 1000 div {rate}").alias("analysed_ms"))


def even_parts(totals: DataFrame, most: int = 4, least_ms: int = 20_000) -> DataFrame:
    """At most `most` parts of least_ms or more; the last is open-ended (null end)."""
    n = F.greatest(F.lit(1), F.least(F.lit(most), F.expr(f"duration_ms div {least_ms}"))).cast("long")
    rows = totals.select("media_id", "duration_ms", n.alias("n"), F.explode(F.sequence(F.lit(0).cast("long"), n - 1)).alias("part"))
    return rows.select("media_id", "part", F.expr("duration_ms * part div n").alias("start_ms"), F.expr("case when part < n - 1 then duration_ms * (part + 1) div n end").alias("end_ms"))


def sample_instants(totals: DataFrame, every_ms: int = 30_000, least: int = 4, most: int = 24) -> DataFrame:
    """Middles of n equal bins of each medium, n from its length within [least, most]."""
    n = F.greatest(F.lit(least), F.least(F.lit(most), F.expr(f"duration_ms div {every_ms}"))).cast("long")
    rows = totals.select("media_id", "duration_ms", n.alias("n"), F.explode(F.sequence(F.lit(0).cast("long"), n - 1)).alias("k"))
    return rows.select("media_id", "k", F.expr("duration_ms * (2 * k + 1) div (2 * n)").alias("time_ms"))


def clip_to_window(rows: DataFrame, lo: str = "window_start_ms", hi: str = "window_end_ms") -> DataFrame:
    """Transcribed rows clipped to their window; blank or empty ones go."""
    out = rows.withColumns({"start_ms": F.greatest("start_ms", lo), "end_ms": F.least("end_ms", hi)})
    return out.where((F.col("end_ms") > F.col("start_ms")) & (F.trim("text") != ""))


def soft_edge_trim(rows: DataFrame, keys: tuple[str, ...], edge_ms: int = 400, final: str = "is_final") -> DataFrame:
    """Drop a window's last segment if it ends within edge_ms of a non-final window's end and is not alone.

    Adds covered_to_ms: the dropped segment's start, else the window's end.
    """
    last = Window.partitionBy(*keys).orderBy(F.col("start_ms").desc(), F.col("end_ms").desc())
    every = Window.partitionBy(*keys)
    soft = (F.row_number().over(last) == 1) & (F.count("*").over(every) > 1) & ~F.col(final) & (F.col("end_ms") >= F.col("window_end_ms") - edge_ms)
    rows = rows.withColumn("_soft", soft)
    edge = F.min(F.when(F.col("_soft"), F.col("start_ms"))).over(every)
    return rows.withColumn("covered_to_ms", F.coalesce(edge, F.col("window_end_ms"))).where(~F.col("_soft")).drop("_soft")


def translate_batches(cues: DataFrame, gap_start_ms: int = 0, span_ms: int = 30_000, keys: tuple[str, ...] = ("media_id",)) -> DataFrame:
    """Batch number of each cue by its start, and the batch's start, moved back to a cue that crosses its edge."""
    batch = F.floor((F.col("start_ms") - gap_start_ms) / span_ms).cast("long")
    rows = cues.where(F.col("start_ms") >= gap_start_ms).withColumn("batch", batch)
    edge = (gap_start_ms + (F.col("batch") + 1) * span_ms).alias("edge")
    crossing = rows.where(F.col("end_ms") > gap_start_ms + (F.col("batch") + 1) * span_ms).groupBy(*keys, (F.col("batch") + 1).alias("batch"), edge).agg(F.min("start_ms").alias("_cross"))
    out = rows.join(crossing.drop("edge"), [*keys, "batch"], "left")
    return out.withColumn("batch_start_ms", F.coalesce("_cross", gap_start_ms + F.col("batch") * span_ms)).drop("_cross")
