"""Queries of interval algebra."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracklake.operators import intervals as I
from tracklake.operators.joins import overlap_join
from tracklake.operators.tracks import labels_by_first_appearance, normalise_labels, reindex, speech_ratio
from tracklake.plans.dialogue import diarization_rules
from tracklake.queries.book import Book, Inputs

book = Book()
PREV = "rows between unbounded preceding and 1 preceding"
SO_FAR = "rows between unbounded preceding and current row"
TOTALS = "tot as (select media_id, cast(max(end_ms) + 500 as bigint) as duration_ms from fx_intervals group by media_id)"


def totals(x: Inputs) -> DataFrame:
    return x.fx_intervals.groupBy("media_id").agg((F.max("end_ms") + 500).cast("long").alias("duration_ms"))


def voice(x: Inputs) -> DataFrame:
    """Disjoint voice with gaps: the union of the first third of every interval."""
    return I.interval_union(x.fx_intervals.select("media_id", "start_ms", F.expr("start_ms + (end_ms - start_ms) div 3").alias("end_ms")).where("end_ms > start_ms"))


def union_sql(rows: str, keys: str = "media_id") -> str:
    return (
        f"select {keys}, min(start_ms) as start_ms, max(end_ms) as end_ms from (select *, sum(brk) over (partition by {keys} order by start_ms, end_ms {SO_FAR}) as isl from "
        f"(select *, case when start_ms > max(end_ms) over (partition by {keys} order by start_ms, end_ms {PREV}) then 1 else 0 end as brk from ({rows}) r) b) i group by {keys}, isl"
    )


VOICE = f"voice as ({union_sql('select media_id, start_ms, start_ms + (end_ms - start_ms) // 3 as end_ms from fx_intervals where (end_ms - start_ms) // 3 > 0')})"
COVER = f"cov as ({union_sql('select media_id, language, start_ms, end_ms from fx_coverage', 'media_id, language')})"


def coverage(x: Inputs) -> DataFrame:
    return I.interval_union(x.fx_coverage, ("media_id", "language"))


def sampled(x: Inputs) -> DataFrame:
    return x.fx_intervals.withColumnRenamed("conf_pct", "max_conf").withColumn("sample_count", (F.col("end_ms") - F.col("start_ms")).cast("long") * 16)


book.add("speech_runs", lambda x: I.speech_runs(x.fx_frames), f"""
select media_id, min(frame_index) * 32 as start_ms, (max(frame_index) + 1) * 32 as end_ms, max(prob) as max_conf, (max(frame_index) - min(frame_index) + 1) * 512 as sample_count
from (select *, frame_index - row_number() over (partition by media_id order by frame_index) as g from fx_frames where prob >= 0.5) f group by media_id, g""")

book.add("drop_short", lambda x: I.drop_short(x.fx_intervals, 1000), "select * from fx_intervals where end_ms - start_ms >= 1000")

book.add("merge_proximal", lambda x: I.merge_proximal(sampled(x), 200, order=("start_ms", "end_ms", "idx")), f"""
select media_id, min(start_ms) as start_ms, max(end_ms) as end_ms, max(conf_pct) as max_conf, cast(sum((end_ms - start_ms) * 16) as bigint) as sample_count from (
  select *, sum(case when start_ms - pe between 0 and 200 then 0 else 1 end) over (partition by media_id order by idx {SO_FAR}) as isl
  from (select *, lag(end_ms) over (partition by media_id order by idx) as pe from fx_intervals) a) b group by media_id, isl""")

book.add("complement", lambda x: I.complement(x.fx_intervals, totals(x)), f"""
with {TOTALS}, r as (select media_id, start_ms, end_ms, 0 as k from fx_intervals union all select media_id, duration_ms, duration_ms, 1 from tot),
 s as (select *, coalesce(max(end_ms) over (partition by media_id order by k, start_ms, end_ms {PREV}), 0) as seen, row_number() over (partition by media_id order by k, start_ms, end_ms) - 1 as n from r)
select media_id, seen as start_ms, start_ms as end_ms, n - 1 as before_index, case when k = 1 then -1 else n end as after_index from s where start_ms > seen""")

book.add("vad_totals", lambda x: I.vad_totals(voice(x), totals(x)), f"""
with {TOTALS}, {VOICE}, v as (select media_id, sum(end_ms - start_ms) as s, count(*) as n from voice group by media_id)
select media_id, cast(coalesce(s, 0) as bigint) as speech_ms, cast(greatest(0, duration_ms - coalesce(s, 0)) as bigint) as silence_ms, coalesce(n, 0) as n_intervals,
 round(least(1.0e0, cast(coalesce(s, 0) as double) / duration_ms), 6) as speech_ratio from tot left join v using (media_id)""")

book.add("pad_clip", lambda x: I.pad_clip(voice(x), totals(x), 100), f"""
with {TOTALS}, {VOICE}, w as (select media_id, greatest(0, start_ms - 100) as start_ms, least(duration_ms, end_ms + 100) as end_ms from voice join tot using (media_id)) {union_sql("select * from w")}""")

book.add("intersect_intervals", lambda x: overlap_join(x.fx_turns, x.fx_segments.select("media_id", "start_ms", "end_ms"))
    .select("media_id", "turn_index", "speaker_label", F.greatest("start_ms", "r_start_ms").alias("start_ms"), F.least("end_ms", "r_end_ms").alias("end_ms")), """
select t.media_id, turn_index, t.speaker_label, greatest(t.start_ms, s.start_ms) as start_ms, least(t.end_ms, s.end_ms) as end_ms
from fx_turns t join fx_segments s on t.media_id = s.media_id and t.start_ms < s.end_ms and s.start_ms < t.end_ms""")

book.add("trim_to_previous", lambda x: I.trim_to_previous(x.fx_intervals.drop("idx", "label", "conf_pct")), f"""
select media_id, start_ms, end_ms from (select media_id, greatest(start_ms, coalesce(max(end_ms) over (partition by media_id order by start_ms, end_ms {PREV}), start_ms)) as start_ms, end_ms from fx_intervals) t where end_ms > start_ms""")

book.add("trim_to_next", lambda x: I.trim_to_next(x.fx_intervals, totals(x).withColumn("duration_ms", F.col("duration_ms") - 900)).drop("label", "conf_pct"), f"""
with {TOTALS}, r as (select i.*, duration_ms - 900 as t from fx_intervals i join tot using (media_id) where start_ms < duration_ms - 900),
 n as (select *, lead(start_ms) over (partition by media_id order by start_ms, end_ms, idx) as ns, row_number() over (partition by media_id order by start_ms, end_ms, idx) - 1 as segment_index from r),
 c as (select *, case when ns < end_ms then ns else end_ms end as cut from n)
select media_id, idx, start_ms, least(cut, t) as end_ms, segment_index, coalesce(end_ms > ns, false) as overlap_normalized, cut > t as end_clamped, cast(greatest(1, least(cut, t) - start_ms) as bigint) as duration_ms,
 least(cut, t) > start_ms as valid, greatest(0, least(cut, t) - start_ms) < 10 as too_short from c""")

APART = f"apart as (select * from (select media_id, label, conf_pct, end_ms, greatest(start_ms, coalesce(max(end_ms) over (partition by media_id order by start_ms, end_ms, label, conf_pct {PREV}), start_ms)) as start_ms from fx_intervals) t where end_ms > start_ms)"
book.add("merge_same_label", lambda x: I.merge_same_label(I.trim_to_previous(x.fx_intervals, order=("start_ms", "end_ms", "label", "conf_pct"), raw="raw_ms").drop("idx"), 50, order=("raw_ms", "end_ms", "label", "conf_pct")), f"""
with {APART} select media_id, label, min(start_ms) as start_ms, max(end_ms) as end_ms, arg_min(conf_pct, start_ms) as conf_pct from (
 select *, sum(case when pl = label and start_ms - pe <= 50 then 0 else 1 end) over (partition by media_id order by start_ms {SO_FAR}) as isl from (
  select *, lag(label) over (partition by media_id order by start_ms) as pl, lag(end_ms) over (partition by media_id order by start_ms) as pe from apart) a) b group by media_id, label, isl""")

book.add("interval_union", lambda x: I.interval_union(x.fx_intervals), union_sql("select media_id, start_ms, end_ms from fx_intervals"))

book.add("coverage_contains", lambda x: I.coverage_summary(coverage(x), 2000), f"""
with {COVER} select media_id, language, bool_or(start_ms <= 2000 and end_ms > 2000) as contains, coalesce(max(case when end_ms <= 2000 then end_ms end), 0) as last_end_ms,
 coalesce(max(case when start_ms <= 0 then end_ms end), 0) as prefix_end_ms, cast(sum(end_ms - start_ms) as bigint) as total_ms from cov group by media_id, language""")


def bounds(x: Inputs) -> DataFrame:
    return x.fx_coverage.select("media_id", "language").distinct().select("*", F.lit(1000).cast("long").alias("lo"), F.lit(5000).cast("long").alias("hi"))


GAPS = f"""r as (select media_id, language, start_ms, end_ms, 0 as k from cov where end_ms > 1000 and start_ms < 5000 union all select distinct media_id, language, 5000, 5000, 1 from cov),
 g as (select media_id, language, greatest(1000, coalesce(max(end_ms) over (partition by media_id, language order by k, start_ms, end_ms {PREV}), 1000)) as a, least(5000, start_ms) as b from r)"""
book.add("first_gap", lambda x: I.first_gap(coverage(x), bounds(x)), f"with {COVER}, {GAPS} select media_id, language, cast(min(a) as bigint) as start_ms, cast(arg_min(b, a) as bigint) as end_ms from g where b > a group by media_id, language")


def by_language(x: Inputs, language: str) -> DataFrame:
    return coverage(x).where(F.col("language") == language).drop("language")


book.add("coverage_difference", lambda x: I.coverage_difference(by_language(x, "en"), by_language(x, "es")), f"""
with {COVER}, r as (
  select a.media_id, a.start_ms as lo, a.end_ms as hi, b.start_ms, b.end_ms, 0 as k from cov a join cov b on a.media_id = b.media_id and b.end_ms > a.start_ms and b.start_ms < a.end_ms where a.language = 'en' and b.language = 'es'
  union all select media_id, start_ms, end_ms, end_ms, end_ms, 1 from cov where language = 'en'),
 g as (select media_id, greatest(lo, coalesce(max(end_ms) over (partition by media_id, lo, hi order by k, start_ms {PREV}), lo)) as a, least(start_ms, hi) as b from r)
select media_id, a as start_ms, b as end_ms from g where b > a""")

book.add("overlapping_windows", lambda x: I.overlapping_windows(totals(x), 3000, 500, 1000), f"""
with {TOTALS}, k as (select media_id, duration_ms, unnest(range(0, cast(case when duration_ms <= 1000 then 0 else ceil((duration_ms - 1000) / 2500.0e0) end as bigint) + 1)) as window_index from tot),
 s as (select *, case when window_index = 0 then 0 else 500 + (window_index - 1) * 2500 end as start_ms from k),
 e as (select media_id, window_index, cast(start_ms as bigint) as start_ms, cast(least(duration_ms, case when window_index = 0 then 1000 else start_ms + 3000 end) as bigint) as end_ms from s)
select * from e where end_ms - start_ms >= 500""")

book.add("pivot_split", lambda x: I.pivot_split(x.fx_subsegments.select("media_id", "start_ms", "end_ms", F.col("seed_label").alias("label"))), f"""
with p as (select *, lag(end_ms) over w as pe, lag(seed_label) over w as pl from (select media_id, start_ms, end_ms, seed_label from fx_subsegments) q window w as (partition by media_id order by start_ms, end_ms)),
 i as (select *, sum(case when start_ms <= pe and pl = seed_label then 0 else 1 end) over (partition by media_id order by start_ms, end_ms {SO_FAR}) as isl from p),
 g as (select media_id, isl, arg_min(case when start_ms <= pe then (start_ms + pe) / 2.0e0 else cast(start_ms as double) end, start_ms) as s, cast(max(end_ms) as double) as e, any_value(seed_label) as label from i group by media_id, isl)
select media_id, label, s as start_ms, least(e, coalesce(lead(s) over (partition by media_id order by isl), e)) as end_ms from g""")

book.add("sliding_subsegments", lambda x: I.sliding_subsegments(voice(x)), f"""
with {VOICE}, k as (select *, unnest(range(0, cast(greatest(1, floor((end_ms - start_ms - 1500) / 750.0e0) + 1) as bigint))) as k from voice where end_ms - start_ms >= 255)
select media_id, start_ms as voice_start_ms, k, start_ms + k * 750 as start_ms, least(end_ms, start_ms + k * 750 + 1500) as end_ms from k""")

book.add("pad_asr_windows", lambda x: I.pad_asr_windows(voice(x), totals(x)), f"""
with {TOTALS}, {VOICE} select media_id, greatest(0, start_ms - 120) as start_ms, least(duration_ms, end_ms + 120) as end_ms, greatest(0, start_ms - 120) as offset_ms from voice join tot using (media_id)""")

book.add("voice_only_length", lambda x: I.voice_only_length(voice(x), totals(x)), f"""
with {TOTALS}, {VOICE}, n as (select media_id, greatest(0, least(end_ms * 16000 // 1000, duration_ms * 16000 // 1000) - greatest(0, start_ms * 16000 // 1000)) as n from voice join tot using (media_id))
select media_id, count(*) filter (where n > 0) as used_intervals, cast(sum(n) * 1000 // 16000 as bigint) as analysed_ms from n group by media_id""")

book.add("even_parts", lambda x: I.even_parts(x.fx_media.withColumn("duration_ms", F.col("duration_ms") * 20)), """
with p as (select media_id, duration_ms * 20 as d, greatest(1, least(4, duration_ms * 20 // 20000)) as n from fx_media), k as (select *, unnest(range(0, n)) as part from p)
select media_id, part, d * part // n as start_ms, case when part < n - 1 then d * (part + 1) // n end as end_ms from k""")

book.add("sample_instants", lambda x: I.sample_instants(x.fx_media.withColumn("duration_ms", F.col("duration_ms") * 50)), """
with p as (select media_id, duration_ms * 50 as d, greatest(4, least(24, duration_ms * 50 // 30000)) as n from fx_media), k as (select *, unnest(range(0, n)) as k from p)
select media_id, k, d * (2 * k + 1) // (2 * n) as time_ms from k""")

WINDOWED = "win as (select media_id, segment_index, text, start_ms, end_ms, start_ms // 5000 as window_index, (start_ms // 5000) * 5000 as window_start_ms, (start_ms // 5000) * 5000 + 5000 as window_end_ms from fx_segments)"


def windowed(x: Inputs) -> DataFrame:
    k = F.expr("start_ms div 5000")
    return x.fx_segments.select("media_id", "segment_index", "text", "start_ms", "end_ms", k.alias("window_index"), (k * 5000).alias("window_start_ms"), (k * 5000 + 5000).alias("window_end_ms"))


book.add("window_segment_clip", lambda x: I.clip_to_window(windowed(x)), f"""
with {WINDOWED}, c as (select * replace (greatest(start_ms, window_start_ms) as start_ms, least(end_ms, window_end_ms) as end_ms) from win) select * from c where end_ms > start_ms and trim(text) <> ''""")

book.add("soft_edge_trim", lambda x: I.soft_edge_trim(windowed(x).withColumn("is_final", F.col("window_index") >= 2), ("media_id", "window_index")).drop("text"), f"""
with {WINDOWED}, m as (select *, window_index >= 2 as is_final, row_number() over (partition by media_id, window_index order by start_ms desc, end_ms desc) = 1 and count(*) over (partition by media_id, window_index) > 1
  and not window_index >= 2 and end_ms >= window_end_ms - 400 as soft from win),
 n as (select *, coalesce(min(case when soft then start_ms end) over (partition by media_id, window_index), window_end_ms) as covered_to_ms from m)
select media_id, segment_index, start_ms, end_ms, window_index, window_start_ms, window_end_ms, is_final, covered_to_ms from n where not soft""")

book.add("translate_batches", lambda x: I.translate_batches(x.fx_segments.drop("text", "conf_pct", "speaker_label"), 1000, 10_000), """
with b as (select media_id, segment_index, start_ms, end_ms, cast(floor((start_ms - 1000) / 10000.0e0) as bigint) as batch from fx_segments where start_ms >= 1000),
 c as (select media_id, batch + 1 as batch, min(start_ms) as s from b where end_ms > 1000 + (batch + 1) * 10000 group by media_id, batch)
select media_id, batch, segment_index, start_ms, end_ms, coalesce(s, 1000 + batch * 10000) as batch_start_ms from b left join c using (media_id, batch)""")

book.add("reindex", lambda x: reindex(x.fx_turns.where("conf_pct >= 70").select("media_id", "turn_index"), ["turn_index"]), """
select media_id, turn_index, row_number() over (partition by media_id order by turn_index) - 1 as idx from fx_turns where conf_pct >= 70""")

book.add("labels_by_first_appearance", lambda x: labels_by_first_appearance(x.fx_subsegments.select("media_id", "seq", "seed_label"), "seed_label", ["seq"]), """
with f as (select media_id, seq, seed_label, min(seq) over (partition by media_id, seed_label) as f from fx_subsegments)
select media_id, seq, seed_label, 'SPEAKER_' || lpad(cast(dense_rank() over (partition by media_id order by f) - 1 as varchar), 2, '0') as speaker_label from f""")

book.add("normalise_labels", lambda x: normalise_labels(x.fx_intervals.select("media_id", "idx", F.when(F.col("idx") % 2 == 0, F.lower("label")).otherwise(F.concat(F.lit(" who"), F.col("conf_pct").cast("string"))).alias("label")), ["idx"]), """
with l as (select media_id, idx, case when idx % 2 = 0 then lower(label) else ' who' || cast(conf_pct as varchar) end as label from fx_intervals), u as (select *, upper(trim(label)) as l from l),
 f as (select *, regexp_matches(l, '^SPEAKER_[0-9]{2,}$') as ok, min(idx) over (partition by media_id, l) as f from u)
select media_id, idx, label, case when ok then l else 'SPEAKER_' || lpad(cast(dense_rank() over (partition by media_id, ok order by f) - 1 as varchar), 2, '0') end as speaker_label from f""")

book.add("diarization_rules", lambda x: diarization_rules(x.fx_intervals.drop("idx"), voice(x), totals(x)), f"""
with {TOTALS}, {VOICE}, w as (select media_id, greatest(0, start_ms - 100) as start_ms, least(duration_ms, end_ms + 100) as end_ms from voice join tot using (media_id)), allowed as ({union_sql("select * from w")}), {APART},
 met as (select a.media_id, label, conf_pct, greatest(a.start_ms, b.start_ms) as start_ms, least(a.end_ms, b.end_ms) as end_ms from apart a join allowed b on a.media_id = b.media_id and a.start_ms < b.end_ms and b.start_ms < a.end_ms),
 isl as (select *, sum(case when pl = label and start_ms - pe <= 50 then 0 else 1 end) over (partition by media_id order by start_ms {SO_FAR}) as isl from (
  select *, lag(label) over (partition by media_id order by start_ms) as pl, lag(end_ms) over (partition by media_id order by start_ms) as pe from met) a)
select media_id, label as speaker_label, min(start_ms) as start_ms, max(end_ms) as end_ms, arg_min(conf_pct, start_ms) as conf_pct from isl group by media_id, label, isl having max(end_ms) - min(start_ms) >= 200""")

book.add("speech_ratio", lambda x: speech_ratio(I.overlapping_windows(x.fx_frames.groupBy("media_id").agg((F.count("*") * 100).alias("duration_ms")), 3000, 500), x.fx_frames.select("media_id", F.col("frame_index").alias("block_index"), (F.col("prob") / 50).alias("rms"))), """
with tot as (select media_id, count(*) * 100 as duration_ms from fx_frames group by media_id),
 k as (select media_id, duration_ms, unnest(range(0, cast(case when duration_ms <= 3000 then 0 else ceil((duration_ms - 3000) / 2500.0e0) end as bigint) + 1)) as window_index from tot),
 w as (select media_id, window_index, window_index * 2500 as s, least(duration_ms, window_index * 2500 + 3000) as e from k where least(duration_ms, window_index * 2500 + 3000) - window_index * 2500 >= 500),
 r as (select w.media_id, window_index, round(coalesce(avg(case when prob / 50 >= 0.01 then 1.0e0 else 0.0e0 end), 0), 6) as speech_ratio from w left join fx_frames f on f.media_id = w.media_id and frame_index * 100 >= s and (frame_index + 1) * 100 <= e group by 1, 2)
select *, speech_ratio < 0.001 as skipped from r""")
