"""Queries of jobs, stored tracks and documents, clustering, streaming twins and plugged models."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracklake import udfs
from tracklake.operators import clustering as K
from tracklake.operators import tracks as T
from tracklake.operators.intervals import overlapping_windows
from tracklake.queries.book import Book, Inputs
from tracklake.queries.cues import cues as all_cues
from tracklake.queries.intervals import COVER, coverage
from tracklake.queries.quality import RULES, dialogue, score
from tracklake.sources import documents as S
from tracklake.sources import media as M
from tracklake.sources import track_store
from tracklake.storage import new_path
from tracklake.streaming import live, progressive

book = Book()


def jobs(x: Inputs) -> DataFrame:
    return x.fx_jobs


# stored tables and documents
book.add("translation_cache_scan", lambda x: S.latest_cache(x.events.select(F.col("event_type").alias("cache_key"), F.when(F.col("event_id") % 3 != 0, F.col("props")).alias("value"), F.col("event_id").alias("written_at"))), """
select event_type as cache_key, arg_max(props, event_id) as value from events where event_id % 3 <> 0 and props is not null group by 1""")


def stored_jobs(x: Inputs) -> DataFrame:
    """The jobs as the application stores them: a folder of Parquet files, read under the table's schema."""
    path = new_path(x.spark)
    jobs(x).withColumn("created_at", F.col("created_at").cast("timestamp")).write.parquet(path)
    return S.read_table(x.spark, "jobs", path)


book.add("read_tables", lambda x: stored_jobs(x).groupBy("status").agg(F.count("*").alias("n_jobs"), F.count_distinct("project_id").alias("n_projects")), "select status, count(*) as n_jobs, count(distinct project_id) as n_projects from fx_jobs group by 1")


def documents_json(x: Inputs) -> DataFrame:
    seg = F.to_json(F.array_sort(F.collect_list(F.struct("segment_index", "start_ms", "end_ms", "speaker_label", "text"))))
    return x.fx_segments.groupBy("media_id").agg(seg.alias("j"))


book.add("read_transcripts", lambda x: S.transcript_segments(documents_json(x).select("media_id", F.when(F.col("media_id") % 4 != 0, "en").alias("language"), F.from_json("j", "array<struct<segment_index:bigint,start_ms:bigint,end_ms:bigint,speaker_label:string,text:string>>").alias("segments"))), """
select media_id, case when media_id % 4 <> 0 then 'en' end as source_lang, segment_index, start_ms, end_ms, speaker_label, text, case when media_id % 4 = 0 then 'no_source_language' end as error_code from fx_segments""")


def stored(x: Inputs) -> DataFrame:
    item = F.struct(F.when(F.col("segment_index") % 2 == 0, F.col("segment_index") + 10).alias("index"), "start_ms", "end_ms", F.when(F.col("segment_index") % 3 != 0, F.col("text")).alias("text"))
    tracks = x.fx_segments.groupBy(F.col("media_id").alias("project_id")).agg(F.to_json(F.transform(F.array_sort(F.collect_list(F.struct(F.col("segment_index").alias("o"), item.alias("x")))), lambda s: s["x"])).alias("cues"))
    return tracks.select("project_id", F.lit("en").alias("language"), F.when(F.col("project_id") % 9 == 0, F.lit("not json")).otherwise(F.col("cues")).alias("cues"))


book.add("read_tracks", lambda x: S.read_tracks(stored(x)), """
select media_id as project_id, 'en' as language, 'en:' || start_ms || ':' || end_ms as cue_id, case when segment_index % 2 = 0 then segment_index + 10 else row_number() over (partition by media_id order by segment_index) end as cue_index,
 start_ms, end_ms, case when segment_index % 3 <> 0 then text else '' end as text, '' as speaker, 'final' as state from fx_segments where media_id % 9 <> 0""")

book.add("read_glossary", lambda x: S.read_glossary(x.nation.select(F.when(F.col("n_nationkey") % 5 == 0, F.lit("[1]")).otherwise(F.to_json(F.create_map(F.lit("es"), F.create_map(F.col("n_name"), F.lower("n_name"))))).alias("glossary"))), """
select case when n_nationkey % 5 <> 0 then 'es' end as lang, case when n_nationkey % 5 <> 0 then n_name end as term, case when n_nationkey % 5 <> 0 then lower(n_name) end as replacement, case when n_nationkey % 5 = 0 then 'not_an_object' end as error_code from nation""")


def docs(x: Inputs) -> DataFrame:
    return S.track_documents(dialogue(x), score(x), x.fx_media)


QUOTED = "replace(replace(replace(replace(text, chr(92), chr(92) || chr(92)), '\"', chr(92) || '\"'), chr(10), chr(92) || 'n'), chr(9), chr(92) || 't')"
book.add("write_documents", lambda x: docs(x).select("media_id", "doc", "content"), f"""
with {RULES}, talk as (select media_id, speaker_label, count(*) as n, cast(sum(end_ms - start_ms) as bigint) as ms from dlg group by 1, 2),
 sp2 as (select media_id, '[' || string_agg('{{"speaker_label":"' || speaker_label || '","n_segments":' || n || ',"talk_ms":' || ms || '}}', ',' order by speaker_label) || ']' as c from talk group by 1),
 sg as (select media_id, '[' || string_agg('{{"segment_index":' || segment_index || ',"speaker_label":"' || speaker_label || '","start_ms":' || start_ms || ',"end_ms":' || end_ms || ',"text":"' || {QUOTED} || '"}}', ',' order by segment_index) || ']' as c,
  string_agg({QUOTED}, ' ' order by segment_index) as t from dlg group by 1)
select m.media_id, unnest(['analysis', 'transcript', 'speakers', 'segments', 'metadata']) as doc, unnest([
  '{{"media_id":' || m.media_id || ',"score":' || cast(score as varchar) || ',"level":"' || level || '"}}', '{{"media_id":' || m.media_id || ',"text":"' || coalesce(t, '') || '"}}', coalesce(sp2.c, '[]'), coalesce(sg.c, '[]'),
  '{{"media_id":' || m.media_id || ',"duration_ms":' || duration_ms || '}}']) as content from fx_media m left join lvl using (media_id) left join sp2 using (media_id) left join sg using (media_id)""")
book.add("output_manifest_check", lambda x: S.manifest_check(docs(x).where("not (doc = 'speakers' and media_id % 6 = 0)"), docs(x).select("media_id", "doc")), """
select media_id, case when media_id % 6 = 0 then 4 else 5 end as n_files, case when media_id % 6 = 0 then 4 else 5 end as n_names, case when media_id % 6 = 0 then 4 else 5 end as n_hashes, case when media_id % 6 = 0 then 1 else 0 end as missing, media_id % 6 <> 0 as ok from fx_media""")


def writes(x: Inputs, new: bool) -> DataFrame:
    part = F.col("o_orderkey") % 2 == int(new)
    return x.orders.where(part).select((F.col("o_custkey") % 200).alias("project_id"), F.when(F.col("o_orderkey") % 3 == 0, "es").otherwise("en").alias("language"), F.col("o_orderkey").alias("cues"), F.col("o_orderkey").alias("updated_at"))


book.add("upsert_tracks", lambda x: T.upsert_tracks(T.latest_wins(writes(x, False), ["project_id", "language"], "updated_at"), writes(x, True)), """
select o_custkey % 200 as project_id, case when o_orderkey % 3 = 0 then 'es' else 'en' end as language, max(o_orderkey) as cues, max(o_orderkey) as updated_at from orders group by 1, 2""")



def stored_writes(x: Inputs) -> DataFrame:
    """A track of each document, several of a project and language, put into a store in three batches, the second of them twice."""
    tracks = x.documents.select(F.floor(F.col("doc_id") / 8).alias("project_id"), F.coalesce("lang", F.lit("und")).alias("language"), F.concat_ws(":", "source", "n_chars").alias("cues"), F.col("doc_id").alias("updated_at"))
    store = new_path(x.spark)
    for batch in (0, 1, 1, 2):
        track_store.write_batch(tracks.where(F.col("updated_at") % 3 == batch), store, batch)
    return track_store.read_store(x.spark, store, tracks.schema)


book.add("track_sink", stored_writes, """
select doc_id // 8 as project_id, coalesce(lang, 'und') as language, arg_max(concat_ws(':', source, n_chars), doc_id) as cues, max(doc_id) as updated_at from documents group by 1, 2""")

# jobs
book.add("recent_jobs", lambda x: T.top_jobs(jobs(x), "user_id", 20).select("user_id", "job_id", "rank"), "select * from (select user_id, job_id, row_number() over (partition by user_id order by created_at desc, job_id desc) as rank from fx_jobs) r where rank <= 20")
book.add("newest_project_job", lambda x: T.top_jobs(jobs(x), "project_id", 1).select("project_id", "job_id"), "select project_id, arg_max(job_id, (created_at, job_id)) as job_id from fx_jobs group by 1")
book.add("next_queued", lambda x: T.next_queued(jobs(x)).select("job_id", "project_id"), "select job_id, project_id from fx_jobs where status = 'QUEUED' and claimed_by = '' order by created_at, job_id limit 1")
book.add("stale_owners", lambda x: T.stale_owners(jobs(x)), """
select claimed_by, count(*) as n_jobs, min(job_id) as first_job, max(heartbeat_age_s) as oldest_s from fx_jobs where claimed_by <> '' and status <> 'COMPLETED' and heartbeat_age_s > 30 group by 1""")
book.add("last_n_events", lambda x: T.last_n(x.events.select("user_id", "event_id", "ts"), "user_id", ["ts", "event_id"], 5).select("user_id", "event_id"), "select user_id, event_id from (select *, row_number() over (partition by user_id order by ts desc, event_id desc) as r from events) e where r <= 5")


def job_events(x: Inputs) -> DataFrame:
    status = F.when(F.col("event_type") == "purchase", "COMPLETED").when(F.col("event_type") == "error", "FAILED").when(F.col("event_type") == "view", "TRANSCRIBING").otherwise("PROCESSING")
    return x.events.select(F.col("user_id").alias("job_id"), F.col("event_id").alias("seq"), status.alias("status"))


EVENTS = "ev as (select user_id as job_id, event_id as seq, case event_type when 'purchase' then 'COMPLETED' when 'error' then 'FAILED' when 'view' then 'TRANSCRIBING' else 'PROCESSING' end as status from events)"
book.add("job_stage_stream", lambda x: T.job_status(job_events(x)), f"""
with {EVENTS} select job_id, coalesce(arg_min(status, seq) filter (where status in ('COMPLETED', 'FAILED', 'CANCELLED')), arg_max(status, seq)) as status, max(seq) as last_seq from ev group by 1""")
book.add("monotone_progress", lambda x: T.monotone_progress(x.events.select(F.col("user_id").alias("job_id"), F.col("event_id").alias("seq"), F.when(F.col("event_type") == "purchase", "T06_ASR").when(F.col("event_type") == "view", "T04_VAD").otherwise("T15_es").alias("step"))), """
with e as (select user_id as job_id, event_id as seq, case event_type when 'purchase' then 'ASR' when 'view' then 'VAD' else 'TRANSLATING' end as stage from events),
 s as (select *, case stage when 'ASR' then 'TRANSCRIBING' when 'VAD' then 'PROCESSING' else 'TRANSLATING' end as status, max(case stage when 'ASR' then 32 when 'VAD' then 16 else 88 end) over (partition by job_id order by seq rows between unbounded preceding and current row) as percent from e),
 p as (select *, lag(stage) over w as ps, lag(percent) over w as pp from s window w as (partition by job_id order by seq))
select job_id, seq, stage, status, cast(percent as bigint) as percent from p where not coalesce(ps = stage and pp = percent, false)""")


def renders(x: Inputs) -> DataFrame:
    k = F.col("o_orderkey")
    state = F.element_at(F.array(*map(F.lit, ("queued", "running", "failed", "done"))), (k % 4 + 1).cast("int"))
    return x.orders.where(k % 5 != 0).select(k.alias("project_id"), F.lit("en").alias("language"), state.alias("state"), (k % 60).alias("heartbeat_age_s"), (k % 3).cast("string").alias("stamp"), F.when(k % 7 == 0, "").otherwise("key").alias("storage_key"))


book.add("render_state", lambda x: T.render_state(x.orders.select(F.col("o_orderkey").alias("project_id"), F.lit("en").alias("language"), F.lit("1").alias("stamp")), renders(x)), """
select o_orderkey as project_id, 'en' as language, case when k % 5 = 0 then 'idle' when k % 4 < 2 and k % 60 > 30 then 'failed' when k % 4 = 0 then 'queued' when k % 4 = 1 then 'running' when k % 4 = 2 then 'failed'
 when k % 7 = 0 then 'idle' when k % 3 = 1 then 'done' else 'stale' end as view from (select o_orderkey, o_orderkey as k from orders) o""")
book.add("storage_fit_plan", lambda x: T.storage_fit_plan(x.orders.select(F.col("o_orderkey").alias("media_id"), (F.col("o_orderkey") % 100 * 1_000_000).alias("size_bytes"), (F.col("o_orderkey") % 1800 * 1000).alias("duration_ms")), 50 * 1024 * 1024), """
with m as (select o_orderkey as media_id, o_orderkey % 100 * 1000000 as b, o_orderkey % 1800 * 1000 as d from orders), t as (select *, 50 * 1024 * 1024 * 8 * 0.95e0 / greatest(d / 1000.0e0, 1.0e0) / 1000 as total from m),
 a as (select *, case when total >= 900 then 128 when total >= 500 then 96 else 64 end as audio_kbps from t), v as (select *, cast(trunc(total - audio_kbps) as bigint) as video_kbps, b > 50 * 1024 * 1024 as over from a),
 l as (select *, over and (d <= 0 or d >= 26 * 60000 or video_kbps < 150) as too_long from v)
select media_id, round(total, 6) as total_kbps, audio_kbps, video_kbps, case when video_kbps < 450 then 480 when video_kbps < 2500 then 720 else 1080 end as height, over and not too_long as needs_fit, too_long from l""")
book.add("track_complete", lambda x: T.track_complete(coverage(x).withColumn("start_ms", F.col("start_ms") - 700), coverage(x).groupBy("media_id").agg((F.max("end_ms") - 800).alias("duration_ms")), ["en", "es"]), f"""
with {COVER}, m as (select media_id, max(end_ms) - 800 as d from cov group by 1), g as (select media_id, d, unnest(['en', 'es']) as language from m), f as (select media_id, language, arg_min(end_ms, start_ms) as e, min(start_ms) - 700 as s from cov group by 1, 2)
select media_id, bool_and(coalesce(s <= 0 and e >= d, false)) as complete from g left join f using (media_id, language) group by 1""")


# media files, their bytes made of the given tables
def page_files(x: Inputs) -> DataFrame:
    ext = F.element_at(F.array(*map(F.lit, ("mp4", "WAV", "txt", "mp3", "mkv"))), (F.col("page_id") % 5 + 1).cast("int"))
    content = F.when(F.col("page_id") % 11 == 0, F.lit("")).otherwise(F.col("html")).cast("binary")
    return x.pages.select(F.concat(F.lit("file:/media/page "), F.col("page_id"), F.lit("."), ext).alias("path"), content.alias("content")).withColumn("length", F.octet_length("content").cast("long"))


book.add("media_manifest", lambda x: M.manifest(page_files(x), 3000), """
with f as (select 'file:/media/page ' || page_id || '.' || e as path, 'page_' || page_id || '.' || e as safe_name, lower(e) as ext, case when page_id % 11 = 0 then '' else html end as html
  from (select page_id, html, ['mp4', 'WAV', 'txt', 'mp3', 'mkv'][page_id % 5 + 1] as e from pages) p),
 g as (select *, cast(strlen(html) as bigint) as size_bytes, case when html = '' then 'empty' when strlen(html) > 3000 then 'too_large' when ext = 'txt' then 'unsupported' end as error_code from f)
select sha256(path) as media_id, path, safe_name, ext, size_bytes, case when error_code is null then sha256(html) end as sha256, error_code from g""")


def wav_files(x: Inputs) -> DataFrame:
    """One WAV file a user: each event is a block of 160 samples, one value; some files have another rate, some are cut."""
    le = lambda c, n: F.concat(*[F.lpad(F.hex(F.shiftright(c, 8 * i).bitwiseAND(255)), 2, "0") for i in range(n)])
    block = F.repeat(le((F.col("event_id") % 20_000).cast("int"), 2), F.lit(160))
    data = x.events.groupBy("user_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("event_id", block.alias("b")))), lambda e: e["b"]), "").alias("d"))
    size, rate = (F.length("d") / 2).cast("int"), F.when(F.col("user_id") % 7 == 0, 8000).otherwise(16000)
    text = lambda s: F.lit(s.encode().hex())
    head = F.concat(text("RIFF"), le(size + 36, 4), text("WAVEfmt "), le(F.lit(16), 4), le(F.lit(1), 2), le(F.lit(1), 2), le(rate, 4), le(rate * 2, 4), le(F.lit(2), 2), le(F.lit(16), 2), text("data"), le(size, 4))
    return data.select(F.concat(F.lit("file:/media/"), F.col("user_id"), F.lit(".wav")).alias("path"), F.unhex(F.when(F.col("user_id") % 11 == 0, F.lit("00")).otherwise(F.concat(head, "d"))).alias("content"))


book.add("wav_blocks", lambda x: M.decoded(wav_files(x), 160).withColumn("rms", F.round("rms", 9)), """
select 'file:/media/' || user_id || '.wav' as path, row_number() over (partition by user_id order by event_id) - 1 as block_index, round(event_id % 20000 / 32768.0e0, 9) as rms, 160 as n, cast(null as varchar) as error_code from events where user_id % 7 <> 0 and user_id % 11 <> 0
union all select distinct 'file:/media/' || user_id || '.wav', null, null, null, case when user_id % 11 = 0 then 'unreadable' else 'format' end from events where user_id % 7 = 0 or user_id % 11 = 0""")

# clustering
book.add("cosine_pairs", lambda x: K.cosine_pairs(x.fx_subsegments), """
with u as (select media_id, seed_label, vec_id, i, x / sqrt(sum(x * x) over (partition by vec_id)) as x from (select cast(floor(vec_id / 100) as bigint) as media_id, case when label >= 7 then -1 else label end as seed_label, vec_id, unnest(range(1, 65)) as i, cast(unnest(embedding) as double) as x from embeddings) e),
 s as (select media_id, seed_label, i, sum(x) as x from u group by 1, 2, 3), n as (select media_id, seed_label, count(distinct vec_id) as n from u group by 1, 2)
select a.media_id, a.seed_label as cluster_a, b.seed_label as cluster_b, round(sum(a.x * b.x) / (any_value(na.n) * any_value(nb.n)), 6) as mean_cosine from s a join s b on a.media_id = b.media_id and a.i = b.i and a.seed_label < b.seed_label
 join n na on na.media_id = a.media_id and na.seed_label = a.seed_label join n nb on nb.media_id = b.media_id and nb.seed_label = b.seed_label group by 1, 2, 3""")
book.add("agglomerate_clusters", lambda x: K.agglomerate_clusters(x.fx_subsegments))
book.add("seed_labels", lambda x: K.seed_labels(x.fx_subsegments.drop("seed_label")).select("media_id", "seq", "seed_label"))
book.add("diarize_from_embeddings", lambda x: K.diarize(x.fx_subsegments))

# streaming: batch twins; the streams are held against them in tests
book.add("utterance_endpointing", lambda x: live.utterances(x.fx_chunks))
book.add("control_reset", lambda x: live.utterances(x.fx_chunks).where("event = 'cleared'"))
book.add("late_drop", lambda x: live.utterances(live.queued(x.fx_chunks.withColumn("batch", F.floor(F.col("seq") / 60)))).groupBy("session_id").agg(F.count_if(F.col("event") == "dropped").alias("n_dropped"), F.count_if(F.col("event") == "final").alias("n_final")))
book.add("epoch_filter", lambda x: live.epoch_filter(x.fx_chunks.withColumn("epoch", F.when(F.col("seq") % 4 != 0, (F.col("seq") * 7) % 11))).select("session_id", "seq"), """
with e as (select session_id, seq, case when seq % 4 <> 0 then seq * 7 % 11 end as epoch from fx_chunks), m as (select *, max(epoch) over (partition by session_id order by seq rows between unbounded preceding and current row) as m from e)
select session_id, seq from m where epoch is null or epoch >= m""")


def windows(x: Inputs) -> DataFrame:
    """Each segment as every overlapping window that holds it would give it."""
    segs = x.fx_segments.select("media_id", "start_ms", "end_ms", "text")
    wins = overlapping_windows(x.fx_media, 6000, 1000).select("media_id", "window_index", F.col("start_ms").alias("ws"), F.col("end_ms").alias("we"))
    return segs.join(wins, "media_id").where("start_ms < we and end_ms > ws").select("media_id", "window_index", F.greatest("start_ms", "ws").alias("start_ms"), F.least("end_ms", "we").alias("end_ms"), "text")


book.add("progressive_dedup", lambda x: live.progressive_dedup(windows(x), 6000, 1000))
book.add("progressive_cues", lambda x: progressive.progressive_cues(progressive.by_window(windows(x).withColumn("speaker", F.lit(None).cast("string"))), 6000, 1000))
book.add("rate_limit_events", lambda x: live.rate_limit(x.events.select(F.col("user_id").alias("key"), F.unix_timestamp("ts").alias("at"), "event_id"), 3, 86_400))
book.add("snapshot_then_deltas", lambda x: live.deltas_since(x.events.where("event_id % 2 = 0").select(F.col("user_id").alias("topic"), F.col("event_id").alias("item_seq")), x.events.where("event_id % 2 = 1").select(F.col("user_id").alias("topic"), F.col("event_id").alias("item_seq")), x.customer.select(F.col("c_custkey").alias("consumer_id"), (F.col("c_custkey") % 100).alias("topic"), (F.col("c_custkey") * 5).alias("seq"))), """
with j as (select c_custkey as consumer_id, c_custkey % 100 as topic, c_custkey * 5 as seq from customer)
select consumer_id, topic, event_id as item_seq, case when event_id % 2 = 0 then 'snapshot' else 'delta' end as kind from events join j on user_id = topic where (event_id % 2 = 0 and event_id <= seq) or (event_id % 2 = 1 and event_id > seq)""")
book.add("cue_event_stream", lambda x: live.coverage_after(live.published_cues(all_cues(x).where("end_ms > start_ms").withColumn("batch_id", F.col("cue_index") % 3))), """
with c as (select media_id, 'en' as language, start_ms - 1200 as start_ms, end_ms - 1200 as end_ms from fx_segments where conf_pct % 9 <> 0 and end_ms > start_ms),
 b as (select *, case when start_ms > max(end_ms) over (partition by media_id order by start_ms, end_ms rows between unbounded preceding and 1 preceding) then 1 else 0 end as brk from c),
 i as (select *, sum(brk) over (partition by media_id order by start_ms, end_ms rows between unbounded preceding and current row) as isl from b) select media_id, language, min(start_ms) as start_ms, max(end_ms) as end_ms from i group by media_id, language, isl""")


# plugged models: deterministic stand-ins
def transcriber(pdf: pd.DataFrame) -> pd.DataFrame:
    return pd.DataFrame({"media_id": pdf["media_id"], "window_index": pdf["window_index"], "start_ms": pdf["start_ms"], "end_ms": pdf["end_ms"], "text": "window " + pdf["window_index"].astype(str), "avg_logprob": -1.0})


def frame_scorer(pdf: pd.DataFrame) -> pd.DataFrame:
    return pd.DataFrame({"media_id": pdf["media_id"], "frame_index": pdf["frame_index"], "prob": pdf["prob"] / 2})


book.add("transcribe_windows", lambda x: udfs.transcribe_windows(overlapping_windows(x.fx_media, 6000, 1000), transcriber), """
with k as (select media_id, duration_ms, unnest(range(0, cast(case when duration_ms <= 6000 then 0 else ceil((duration_ms - 6000) / 5000.0e0) end as bigint) + 1)) as window_index from fx_media),
 w as (select media_id, window_index, window_index * 5000 as start_ms, least(duration_ms, window_index * 5000 + 6000) as end_ms from k) select *, 'window ' || window_index as text, -1.0e0 as avg_logprob from w where end_ms - start_ms >= 500""")
book.add("score_frames", lambda x: udfs.score_frames(x.fx_frames, frame_scorer), "select media_id, frame_index, prob / 2 as prob from fx_frames")
book.add("score_language", lambda x: udfs.score_language(x.documents.select("doc_id", "n_chars"), lambda pdf: [[float(n % 7), float(n % 5)] for n in pdf["n_chars"]]).select("doc_id", F.array_max("logits").alias("best")), "select doc_id, cast(greatest(n_chars % 7, n_chars % 5) as double) as best from documents")
book.add("embed_subsegments", lambda x: udfs.embed_subsegments(x.fx_turns.select("media_id", "turn_index", "start_ms", "end_ms"), lambda pdf: [[float(e - s), 1.0] for s, e in zip(pdf["start_ms"], pdf["end_ms"], strict=True)]).select("media_id", "turn_index", F.get("embedding", F.lit(0)).cast("double").alias("length")), "select media_id, turn_index, cast(end_ms - start_ms as double) as length from fx_turns")
book.add("translate_batch", lambda x: udfs.translate_batch(x.fx_segments.select(F.lit("en").alias("source_lang"), F.when(F.col("media_id") % 2 == 0, "es").otherwise("fr").alias("target_lang"), "text"), lambda texts, s, t: [f"[{t}] {x}" for x in texts]), """
select distinct 'en' as source_lang, case when media_id % 2 = 0 then 'es' else 'fr' end as target_lang, text, '[' || case when media_id % 2 = 0 then 'es' else 'fr' end || '] ' || text as translated, 'ok' as status from fx_segments""")


def sql_functions(x: Inputs) -> DataFrame:
    udfs.register_sql(x.spark)
    x.fx_media.createOrReplaceTempView("sql_media")
    return x.spark.sql("select m.media_id, timecode(m.duration_ms) as shown, w.window_index, w.start_ms, w.end_ms from sql_media m, lateral overlapping_windows(m.duration_ms, 6000, 1000) w")


book.add("sql_registration", sql_functions, """
with k as (select media_id, duration_ms, unnest(range(0, cast(case when duration_ms <= 6000 then 0 else ceil((duration_ms - 6000) / 5000.0e0) end as bigint) + 1)) as window_index from fx_media),
 w as (select media_id, duration_ms, window_index, window_index * 5000 as start_ms, least(duration_ms, window_index * 5000 + 6000) as end_ms from k)
select media_id, '00:' || lpad(cast(duration_ms // 60000 % 60 as varchar), 2, '0') || ':' || lpad(cast(duration_ms // 1000 % 60 as varchar), 2, '0') || ',' || lpad(cast(duration_ms % 1000 as varchar), 3, '0') as shown, window_index, start_ms, end_ms from w where end_ms - start_ms >= 500""")
