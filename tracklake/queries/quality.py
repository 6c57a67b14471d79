"""Queries of joins, quality rules, validation and metrics."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracklake.operators import constraints as C
from tracklake.operators import intervals as I
from tracklake.operators import joins as J
from tracklake.operators import quality as Q
from tracklake.operators.language import lid_decision, lid_topk
from tracklake.plans import dialogue as plans
from tracklake.queries.book import Book, Inputs
from tracklake.queries.intervals import COVER, coverage, union_sql

book = Book()

SEG = "seg as (select media_id, segment_index, start_ms, end_ms, text, conf_pct from fx_segments)"
VOTE = f"""{SEG}, pairs as (select s.media_id, segment_index, t.speaker_label, t.start_ms as ts, t.conf_pct as tc, least(s.end_ms, t.end_ms) - greatest(s.start_ms, t.start_ms) as o
  from seg s join fx_turns t on s.media_id = t.media_id and t.start_ms < s.end_ms and s.start_ms < t.end_ms),
 votes as (select media_id, segment_index, speaker_label, cast(sum(o * tc) as bigint) as weight, max(tc) as best, min(ts) as first from pairs group by 1, 2, 3),
 won as (select * from (select *, row_number() over (partition by media_id, segment_index order by weight desc, best desc, first, speaker_label) as r from votes) v where r = 1),
 dlg as (select s.media_id, s.segment_index as asr_segment_index, row_number() over (partition by s.media_id order by s.segment_index) - 1 as segment_index, w.speaker_label, s.start_ms, s.end_ms, s.text,
  least(1.0e0, weight / (100.0e0 * greatest(1, s.end_ms - s.start_ms))) as alignment_conf from seg s join won w on s.media_id = w.media_id and s.segment_index = w.segment_index)"""
VOICE = f"voice as ({union_sql('select media_id, start_ms, end_ms from fx_turns')})"


def segments(x: Inputs) -> DataFrame:
    return x.fx_segments.drop("speaker_label")


def dialogue(x: Inputs) -> DataFrame:
    return J.align(segments(x), x.fx_turns)


def silence(x: Inputs) -> DataFrame:
    return I.complement(I.interval_union(x.fx_turns.select("media_id", "start_ms", "end_ms")), x.fx_media)


SILENCE = f"""{VOICE}, sil0 as (select media_id, start_ms, end_ms, 0 as k from voice union all select media_id, duration_ms, duration_ms, 1 from fx_media),
 sil as (select media_id, s as start_ms, start_ms as end_ms from (select *, coalesce(max(end_ms) over (partition by media_id order by k, start_ms rows between unbounded preceding and 1 preceding), 0) as s from sil0) q where start_ms > s)"""

book.add("overlap_join", lambda x: J.overlap_join(segments(x).drop("text"), x.fx_turns.drop("turn_index"), min_overlap_ms=100), f"""
with {SEG} select s.media_id, segment_index, s.start_ms, s.end_ms, s.conf_pct, t.speaker_label as r_speaker_label, t.start_ms as r_start_ms, t.end_ms as r_end_ms, t.conf_pct as r_conf_pct,
 least(s.end_ms, t.end_ms) - greatest(s.start_ms, t.start_ms) as overlap_ms from seg s join fx_turns t on s.media_id = t.media_id where least(s.end_ms, t.end_ms) - greatest(s.start_ms, t.start_ms) >= 100""")



def long_turns(x: Inputs) -> DataFrame:
    """Turns, of which every eighth lasts for the whole medium and beyond."""
    whole = F.when(F.col("turn_index") % 8 == 0, F.col("end_ms") + 400_000).otherwise(F.col("end_ms"))
    return x.fx_turns.select("media_id", "speaker_label", "start_ms", whole.alias("end_ms"))


book.add("overlap_join_dyadic", lambda x: J.overlap_join(segments(x).select("media_id", "segment_index", "start_ms", "end_ms"), long_turns(x), long_ms=16_000), """
with t as (select media_id, speaker_label, start_ms, case when turn_index % 8 = 0 then end_ms + 400000 else end_ms end as end_ms from fx_turns)
select s.media_id, segment_index, s.start_ms, s.end_ms, t.speaker_label as r_speaker_label, t.start_ms as r_start_ms, t.end_ms as r_end_ms, least(s.end_ms, t.end_ms) - greatest(s.start_ms, t.start_ms) as overlap_ms
from fx_segments s join t on s.media_id = t.media_id and s.start_ms < t.end_ms and t.start_ms < s.end_ms""")

book.add("speaker_vote", lambda x: J.speaker_vote(segments(x), x.fx_turns).drop("text", "conf_pct").withColumn("alignment_conf", F.round("alignment_conf", 6)), f"""
with {VOTE} select s.media_id, s.segment_index, s.start_ms, s.end_ms, speaker_label, round(case when speaker_label is not null then least(1.0e0, weight / (100.0e0 * greatest(1, s.end_ms - s.start_ms))) end, 6) as alignment_conf
from seg s left join won w on s.media_id = w.media_id and s.segment_index = w.segment_index""")

book.add("attach_text", lambda x: J.attach_text(x.fx_segments.select("media_id", "segment_index", "start_ms"), x.fx_segments.where("segment_index % 3 <> 2").select("media_id", "segment_index", "text")), """
select a.media_id, a.segment_index, a.start_ms, b.text, b.media_id is null as missing_text from fx_segments a left join (select * from fx_segments where segment_index % 3 <> 2) b on a.media_id = b.media_id and a.segment_index = b.segment_index""")

book.add("voice_anti_join", lambda x: J.voice_anti_join(x.fx_segments.select("media_id", "segment_index", "start_ms", "end_ms"), x.fx_turns), """
select media_id, segment_index, start_ms, end_ms from fx_segments s where not exists (select 1 from fx_turns t where t.media_id = s.media_id and t.start_ms < s.end_ms and s.start_ms < t.end_ms)""")

book.add("unknown_speaker_anti", lambda x: J.unknown_speakers(x.fx_segments.select("media_id", "segment_index", "speaker_label"), x.fx_turns.where("turn_index > 1")), """
select media_id, segment_index, speaker_label from fx_segments s where not exists (select 1 from fx_turns t where t.media_id = s.media_id and t.speaker_label = s.speaker_label and turn_index > 1)""")

book.add("interpolate_from_vad", lambda x: J.interpolate_from_voice(x.fx_segments.select("media_id", "segment_index", F.when(F.col("conf_pct") % 4 != 0, F.col("start_ms")).alias("start_ms"), F.when(F.col("conf_pct") % 4 != 0, F.col("end_ms")).alias("end_ms")), I.interval_union(x.fx_turns.select("media_id", "start_ms", "end_ms"))), f"""
with {VOICE}, v as (select *, row_number() over (partition by media_id order by start_ms, end_ms) - 1 as n, row_number() over (partition by media_id order by start_ms desc, end_ms desc) as back from voice),
 s as (select media_id, segment_index, conf_pct % 4 = 0 as m, start_ms, end_ms from fx_segments)
select s.media_id, s.segment_index, m as vad_interpolated, m and coalesce(a.start_ms, l.start_ms) is null as missing_voice, case when m then 0.7e0 else 1.0e0 end as ts_confidence,
 case when m then coalesce(a.start_ms, l.start_ms) else s.start_ms end as start_ms, case when m then coalesce(a.end_ms, l.end_ms) else s.end_ms end as end_ms
from s left join v a on a.media_id = s.media_id and a.n = s.segment_index left join v l on l.media_id = s.media_id and l.back = 1""")

book.add("translated_cues", lambda x: J.translated_cues(x.fx_segments.select("media_id", "segment_index", "text"), x.fx_segments.where("segment_index % 2 = 0").select("media_id", "segment_index", F.concat(F.lit("[es] "), "text").alias("adapted_text"))), """
select media_id, segment_index, text, case when segment_index % 2 = 0 then concat('[es] ', text) else text end as cue_text from fx_segments""")

book.add("active_cue_asof", lambda x: J.active_cue(x.fx_media.select("media_id", F.explode(F.sequence(F.lit(0).cast("long"), F.col("duration_ms"), F.lit(700).cast("long"))).alias("time_ms")), x.fx_segments.select("media_id", F.col("segment_index").alias("cue_index"), "start_ms", "end_ms")), """
with p as (select media_id, unnest(range(0, duration_ms + 1, 700)) as time_ms from fx_media)
select p.media_id, time_ms, arg_min(segment_index, (start_ms, end_ms, segment_index)) as cue_index from p left join fx_segments s on s.media_id = p.media_id and start_ms <= time_ms and time_ms < end_ms group by 1, 2""")

book.add("last_cue_asof", lambda x: J.active_cue_asof(x.fx_frames.select("media_id", (F.col("frame_index") * 700).alias("time_ms")), x.fx_segments.select("media_id", F.col("segment_index").alias("cue_index"), "start_ms", "end_ms")), """
with c as (select media_id, start_ms, max((end_ms, segment_index)) as m from fx_segments group by 1, 2), p as (select media_id, frame_index * 700 as time_ms from fx_frames)
select p.media_id, time_ms, case when m[1] > time_ms then m[2] end as cue_index from p asof left join c on p.media_id = c.media_id and p.time_ms >= c.start_ms""")


def steps(x: Inputs) -> dict[str, DataFrame]:
    sha = F.sha2(F.col("media_id").cast("string"), 256)
    return {
        "alignment": x.fx_media.select("media_id", sha.alias("sha256")), "asr": x.fx_media.select("media_id", F.upper(sha).alias("sha256")),
        "vad": x.fx_media.select("media_id", F.when(F.col("media_id") % 5 == 0, F.lit("x")).otherwise(sha).alias("sha256")), "diarization": x.fx_turns.select("media_id").distinct().where("media_id % 7 <> 0").select("media_id", sha.alias("sha256")),
    }


book.add("lineage_check", lambda x: J.lineage_check(steps(x), "alignment"), """
with d as (select distinct media_id from fx_turns where media_id % 7 <> 0), m as (select f.media_id, list_filter([null, case when d.media_id is null then 'diarization' end, case when f.media_id % 5 = 0 then 'vad' end], lambda x: x is not null) as mismatches
 from fx_media f left join d using (media_id)) select media_id, mismatches, len(mismatches) = 0 as ok from m""")


def requests(x: Inputs) -> DataFrame:
    rows = x.conversations.select("conv_id", "turn", F.lit("en").alias("s"), F.when(F.col("conv_id") % 3 == 0, "fr").when(F.col("conv_id") % 3 == 1, "es").otherwise("it").alias("target"), "text", F.lit("").alias("p"))
    return rows.withColumn("cache_key", J.cache_key("s", "target", "text", "p")).drop("s", "p")


REQ = "req as (select conv_id, turn, case conv_id % 3 when 0 then 'fr' when 1 then 'es' else 'it' end as target, text from conversations), reqk as (select *, sha256('en|' || target || '|' || text || '|') as cache_key from req)"
book.add("cache_lookup", lambda x: J.cache_lookup(requests(x), requests(x).where("turn % 2 = 0").groupBy("cache_key").agg(F.min(F.concat(F.lit("t:"), "text")).alias("value"))).select("conv_id", "turn", "cache_key", "cached_text", "hit"), f"""
with {REQ}, c as (select cache_key, min('t:' || text) as value from reqk where turn % 2 = 0 group by 1) select conv_id, turn, cache_key, value as cached_text, value is not null as hit from reqk left join c using (cache_key)""")


def glossary(x: Inputs) -> DataFrame:
    return x.nation.select(F.when(F.col("n_regionkey") == 0, "fr").when(F.col("n_regionkey") == 1, "es").otherwise("*").alias("lang"), F.col("n_name").alias("term"), F.lower("n_name").alias("replacement"))


book.add("glossary_join", lambda x: J.glossary_join(requests(x).select("conv_id", "turn", "target"), glossary(x)), f"""
with {REQ}, g as (select case n_regionkey when 0 then 'fr' when 1 then 'es' else '*' end as lang, n_name as term, lower(n_name) as replacement from nation)
select conv_id, turn, target, term, replacement from req join g on g.lang = case when exists (select 1 from g h where h.lang = req.target) then req.target else '*' end""")

book.add("latest_job_join", lambda x: J.latest_job(x.customer.select(F.col("c_custkey").alias("project_id")), x.fx_jobs), """
with j as (select *, row_number() over (partition by project_id order by created_at desc, job_id desc) as r from fx_jobs) select c_custkey as project_id, job_id, status as job_status from customer left join j on project_id = c_custkey and r = 1""")

RULES = f"""{VOTE}, {SILENCE}, nx as (select d.*, duration_ms, lead(d.start_ms) over w as ns, lead(d.end_ms) over w as ne from dlg d join fx_media m using (media_id) window w as (partition by d.media_id order by segment_index)),
 c as (select media_id, count(*) filter (where start_ms >= end_ms) as q1, count(*) filter (where trim(text) = '') as q2, count(*) filter (where start_ms < 0 or end_ms > duration_ms) as q3,
  count(*) filter (where ns is not null and least(end_ms, ne) - greatest(start_ms, ns) > 100) as q4, count(*) filter (where end_ms - start_ms > 60000) as q9, count(*) as nd from nx group by 1),
 n as (select media_id, count(*) as ns, count(*) filter (where conf_pct / 100.0e0 < 0.4) as q7 from seg group by 1), sp as (select media_id, count(distinct speaker_label) as nsp from fx_turns group by 1),
 s10 as (select media_id, count(*) filter (where end_ms - start_ms > 15000) as q10 from sil group by 1),
 a11 as (select media_id, count(*) as q11 from dlg d where not exists (select 1 from voice v where v.media_id = d.media_id and v.start_ms < d.end_ms and d.start_ms < v.end_ms) group by 1),
 wide as (select m.media_id, coalesce(q1, 0) as q1, coalesce(q2, 0) as q2, coalesce(q3, 0) as q3, coalesce(q4, 0) as q4, greatest(0, coalesce(ns, 0) - coalesce(nd, 0)) as q5,
  case when coalesce(nsp, 0) > 0 and coalesce(ns, 0) > 0 and coalesce(nd, 0) = 0 then 1 else 0 end as q6, coalesce(q7, 0) as q7, coalesce(q9, 0) as q9, coalesce(q10, 0) as q10, coalesce(q11, 0) as q11
  from fx_media m left join c using (media_id) left join n using (media_id) left join sp using (media_id) left join s10 using (media_id) left join a11 using (media_id)),
 rules as (
  select media_id, rule_code, severity, applicable, cast(occurrences as bigint) as occurrences, case when not applicable then 0.0e0 when severity = 'ERROR' then case when occurrences > 0 then 1.0e0 else 0.0e0 end else round(least(1.0e0, occurrences * each), 6) end as penalty, not applicable or occurrences = 0 as passed from (
   select media_id, 'QR01' as rule_code, 'ERROR' as severity, true as applicable, q1 as occurrences, 1.0e0 as each from wide union all select media_id, 'QR02', 'ERROR', true, q2, 1.0e0 from wide union all select media_id, 'QR03', 'ERROR', true, q3, 1.0e0 from wide
   union all select media_id, 'QR04', 'ERROR', true, q4, 1.0e0 from wide union all select media_id, 'QR05', 'WARNING', true, q5, 0.03e0 from wide union all select media_id, 'QR06', 'WARNING', true, q6, 0.02e0 from wide
   union all select media_id, 'QR07', 'WARNING', true, q7, 0.04e0 from wide union all select media_id, 'QR08', 'WARNING', false, 0, 0.005e0 from wide union all select media_id, 'QR09', 'WARNING', true, q9, 0.02e0 from wide
   union all select media_id, 'QR10', 'WARNING', true, q10, 0.015e0 from wide union all select media_id, 'QR11', 'WARNING', true, q11, 0.03e0 from wide) u),
 score as (select media_id, case when exists (select 1 from fx_turns t where t.media_id = rules.media_id) then round(greatest(0.0e0, 1.0e0 - sum(penalty)), 6) else 1.0e0 end as score, count(*) filter (where passed) as n_passed,
  count(*) filter (where severity = 'ERROR' and not passed) as n_failed, count(*) filter (where severity = 'WARNING' and not passed) as n_warning from rules group by 1),
 lvl as (select *, case when score >= 0.8 then 'passed' when score >= 0.3 then 'warning' else 'failed' end as level from score)"""


def rules(x: Inputs) -> DataFrame:
    return plans.track_rules(x.fx_segments, x.fx_turns, x.fx_media)


def score(x: Inputs) -> DataFrame:
    return Q.quality_score(rules(x), x.fx_media.join(x.fx_turns.select("media_id").distinct(), "media_id", "left_anti"))


def faulty(x: Inputs) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """Aligned segments with a fault of each kind in some media, the media's durations, voice apart from turns, and words."""
    m, i = F.col("media_id"), F.col("segment_index")
    end = F.when((m % 7 == 1) & (i == 0), F.col("start_ms")).when((m % 7 == 5) & (i == 1), F.col("start_ms") + 70_000).otherwise(F.col("end_ms"))
    rows = x.fx_segments.select("media_id", "segment_index", "speaker_label", "start_ms", end.alias("end_ms"), F.when((m % 7 == 2) & (i == 0), " ").otherwise(F.col("text")).alias("text"), "conf_pct")
    media = x.fx_media.select("media_id", (F.col("duration_ms") + F.when(m % 7 == 3, -600).when(m % 7 == 4, 40_000).otherwise(0)).alias("duration_ms"))
    voice = I.interval_union(x.fx_segments.select("media_id", "start_ms", (F.col("start_ms") + F.when(F.col("conf_pct") % 3 == 0, 0).otherwise(300)).alias("end_ms")).where("end_ms > start_ms"))
    words = x.fx_segments.where(m % 5 != 0).select("media_id", "segment_index", F.posexplode(F.split(F.trim("text"), " ")).alias("pos", "word")).select("media_id", (((i * 7 + F.col("pos") * 13) % 100) / 100.0).alias("confidence"))
    return rows, media, voice, words


def faulty_rules(x: Inputs) -> DataFrame:
    rows, media, voice, words = faulty(x)
    # media without an aligned segment have speakers and segments but no dialogue
    turns, dialogue = x.fx_turns, rows.where("media_id % 7 <> 6 and conf_pct % 4 <> 0")
    scored = rows.select("media_id", (F.col("conf_pct") / 100.0).alias("confidence"), F.lit(None).cast("double").alias("avg_logprob"))
    return Q.quality_rules(media, dialogue, scored, turns, voice, I.complement(voice, media), words)


FAULTY = f"""fr as (select media_id, segment_index, speaker_label, start_ms, case when media_id % 7 = 1 and segment_index = 0 then start_ms when media_id % 7 = 5 and segment_index = 1 then start_ms + 70000 else end_ms end as end_ms,
  case when media_id % 7 = 2 and segment_index = 0 then ' ' else text end as text, conf_pct from fx_segments),
 fm as (select media_id, duration_ms + case media_id % 7 when 3 then -600 when 4 then 40000 else 0 end as d from fx_media),
 fv as ({union_sql("select media_id, start_ms, start_ms + case when conf_pct % 3 = 0 then 0 else 300 end as end_ms from fx_segments where conf_pct % 3 <> 0")}),
 fw as (select media_id, segment_index, unnest(range(0, len(string_split(trim(text, ' '), ' ')))) as pos from fx_segments where media_id % 5 <> 0),
 w8 as (select media_id, count(*) as n, count(*) filter (where (segment_index * 7 + pos * 13) % 100 / 100.0e0 < 0.3e0) as q8 from fw group by 1),
 fd as (select f.*, d, lead(start_ms) over w as ns, lead(end_ms) over w as ne from fr f join fm using (media_id) where media_id % 7 <> 6 and conf_pct % 4 <> 0 window w as (partition by f.media_id order by segment_index)),
 c as (select media_id, count(*) filter (where start_ms >= end_ms) as q1, count(*) filter (where trim(text) = '') as q2, count(*) filter (where start_ms < 0 or end_ms > d) as q3,
  count(*) filter (where ns is not null and least(end_ms, ne) - greatest(start_ms, ns) > 100) as q4, count(*) filter (where end_ms - start_ms > 60000) as q9, count(*) as nd,
  count(*) filter (where not exists (select 1 from fv where fv.media_id = fd.media_id and fv.start_ms < fd.end_ms and fd.start_ms < fv.end_ms)) as q11 from fd group by 1),
 n as (select media_id, count(*) as ns, count(*) filter (where conf_pct / 100.0e0 < 0.4) as q7 from fr group by 1), sp as (select media_id, count(distinct speaker_label) as nsp from fx_turns group by 1),
 g0 as (select media_id, start_ms, end_ms, 0 as k from fv union all select media_id, d, d, 1 from fm), g as (select media_id, start_ms - coalesce(max(end_ms) over (partition by media_id order by k, start_ms rows between unbounded preceding and 1 preceding), 0) as gap from g0),
 s10 as (select media_id, count(*) filter (where gap > 15000) as q10 from g group by 1),
 fwide as (select m.media_id, coalesce(q1, 0) as q1, coalesce(q2, 0) as q2, coalesce(q3, 0) as q3, coalesce(q4, 0) as q4, greatest(0, coalesce(ns, 0) - coalesce(nd, 0)) as q5, case when coalesce(nsp, 0) > 0 and coalesce(ns, 0) > 0 and coalesce(nd, 0) = 0 then 1 else 0 end as q6,
  coalesce(q7, 0) as q7, coalesce(q8, 0) as q8, w8.n is not null as a8, coalesce(q9, 0) as q9, coalesce(q10, 0) as q10, coalesce(q11, 0) as q11
  from fm m left join c using (media_id) left join n using (media_id) left join sp using (media_id) left join w8 using (media_id) left join s10 using (media_id)),
 frules as (select media_id, rule_code, severity, applicable, cast(occurrences as bigint) as occurrences, case when not applicable then 0.0e0 when severity = 'ERROR' then case when occurrences > 0 then 1.0e0 else 0.0e0 end else round(least(1.0e0, occurrences * each), 6) end as penalty,
  not applicable or occurrences = 0 as passed from (select media_id, unnest(['QR01', 'QR02', 'QR03', 'QR04', 'QR05', 'QR06', 'QR07', 'QR08', 'QR09', 'QR10', 'QR11']) as rule_code,
   unnest(['ERROR', 'ERROR', 'ERROR', 'ERROR', 'WARNING', 'WARNING', 'WARNING', 'WARNING', 'WARNING', 'WARNING', 'WARNING']) as severity, unnest([true, true, true, true, true, true, true, a8, true, true, true]) as applicable,
   unnest([q1, q2, q3, q4, q5, q6, q7, q8, q9, q10, q11]) as occurrences, unnest([1.0e0, 1.0e0, 1.0e0, 1.0e0, 0.03e0, 0.02e0, 0.04e0, 0.005e0, 0.02e0, 0.015e0, 0.03e0]) as each from fwide) u)"""


book.add("speaker_dialogue", lambda x: plans.speaker_dialogue(x.fx_segments, x.fx_turns, x.fx_media), f"""
with {RULES} select d.media_id, segment_index, asr_segment_index, speaker_label, round(alignment_conf, 6) as alignment_conf, start_ms, end_ms, score, level from dlg d join lvl using (media_id)""")
book.add("quality_rules", rules, f"with {RULES} select * from rules")
for name, codes in {"qr01_qr03": ("QR01", "QR02", "QR03"), "qr04": ("QR04",), "qr05_qr06": ("QR05", "QR06"), "qr07": ("QR07",), "qr08": ("QR08",), "qr09_qr10": ("QR09", "QR10"), "qr11": ("QR11",)}.items():
    book.add(name, lambda x, codes=codes: faulty_rules(x).where(F.col("rule_code").isin(*codes)), f"with {FAULTY} select * from frules where rule_code in ({', '.join(repr(c) for c in codes)})")
book.add("quality_score", score, f"with {RULES} select * from lvl")


def checks(x: Inputs) -> DataFrame:
    """Validation inputs with a fault for each check in some media."""
    sha = F.sha2(F.col("media_id").cast("string"), 256)
    r, s, m = rules(x), score(x), F.col("media_id")
    d = dialogue(x).withColumn("duration_ms", F.col("end_ms") - F.col("start_ms") + (m % 19 == 0).cast("int"))
    d = d.withColumn("speaker_label", F.when((m % 29 == 0) & (F.col("segment_index") == 0), "SPEAKER_99").otherwise(F.col("speaker_label")))
    counts = segments(x).groupBy("media_id").agg(F.count("*").alias("n_segments"))
    aligned = d.groupBy("media_id").agg(F.count("*").alias("n_aligned"))
    media = x.fx_media.select("media_id", sha.alias("sha256"), "duration_ms", F.when(m % 11 == 0, F.lit("x")).otherwise(sha).alias("vad_sha256"), F.col("duration_ms").alias("vad_duration_ms"), sha.alias("diarization_sha256"), F.lit("job").alias("job_id"))
    alignment = x.fx_media.join(counts, "media_id").join(aligned, "media_id", "left").select(
        "media_id", sha.alias("sha256"), "duration_ms", "n_segments", F.coalesce("n_aligned", F.lit(0)).alias("n_aligned"), (F.col("n_segments") - F.coalesce("n_aligned", F.lit(0)) + (m % 23 == 0).cast("int")).alias("n_unassigned"), F.lit("en").alias("language"), F.when(m % 8 == 0, "other").otherwise("job").alias("job_id"))
    quality = s.join(x.fx_media, "media_id").select(
        "media_id", F.when(m % 31 == 0, "y").otherwise(F.upper(sha)).alias("sha256"), (F.col("duration_ms") + (m % 13 == 0).cast("int")).alias("duration_ms"), "score", F.when(m % 14 == 0, "none").otherwise(F.col("level")).alias("level"),
        "n_passed", "n_failed", (F.col("n_warning") + (m % 9 == 0).cast("int")).alias("n_warning"), F.lit(None).cast("string").alias("job_id"))
    asr = counts.select("media_id", sha.alias("sha256"), "n_segments", (F.col("n_segments") + (m % 6 == 0).cast("int")).alias("n_rows"), F.when(m % 17 == 0, "es").otherwise("en").alias("language"), F.lit("job").alias("job_id"))
    return Q.validation_checks(media, alignment, quality, asr, d, x.fx_turns, r)


CHECKS = f"""{RULES}, chk as (select media_id, code as check_code, case when bad then 'error' else 'passed' end as outcome from (
 select media_id, unnest(['VC01', 'VC02', 'VC03', 'VC04', 'VC05', 'VC06', 'VC07', 'VC08', 'VC09', 'VC10', 'VC11']) as code,
  unnest([media_id % 11 = 0 or media_id % 31 = 0, media_id % 8 = 0, media_id % 13 = 0, media_id % 23 = 0,
   exists (select 1 from dlg d where d.media_id = m.media_id and (m.media_id % 19 = 0 or d.start_ms < 0 or d.end_ms <= d.start_ms or d.end_ms > m.duration_ms)),
   media_id % 29 = 0 and exists (select 1 from dlg d where d.media_id = m.media_id), media_id % 6 = 0, media_id % 17 = 0, media_id % 14 = 0, media_id % 9 = 0, media_id % 31 = 0]) as bad from fx_media m) q)"""
book.add("validation_checks", checks, f"with {CHECKS} select * from chk")
book.add("validation_status", lambda x: Q.validation_status(checks(x)), f"""
with {CHECKS} select media_id, coalesce(list(check_code order by check_code) filter (where outcome = 'error'), []) as errors, cast([] as varchar[]) as warnings,
 case when count(*) filter (where outcome = 'error') > 0 then 'failed' else 'passed' end as status from chk group by 1""")


def timings(x: Inputs) -> DataFrame:
    return x.fx_turns.select("media_id", F.concat(F.lit("step"), (F.col("turn_index") % 3).cast("string")).alias("step"), (F.col("conf_pct") / 64.0).alias("seconds"))


TIMINGS = "tim as (select media_id, 'step' || cast(turn_index % 3 as varchar) as step, conf_pct / 64.0e0 as seconds from fx_turns)"
book.add("media_metrics", lambda x: Q.media_metrics(x.fx_media, dialogue(x), x.fx_turns, silence(x), timings(x)), f"""
with {VOTE}, {SILENCE}, {TIMINGS}, t as (select media_id, count(*) as n_segments, cast(sum(len(string_split(trim(regexp_replace(text, '\\s+', ' ', 'g')), ' '))) as bigint) as n_words, round(avg(alignment_conf), 6) as avg_alignment_conf from dlg group by 1),
 w as (select media_id, count(distinct speaker_label) as n_speakers, count(*) as n_turns from fx_turns group by 1), q as (select media_id, count(*) as n_silences from sil group by 1), p as (select media_id, sum(seconds) as s from tim group by 1)
select m.media_id, coalesce(n_segments, 0) as n_segments, coalesce(n_words, 0) as n_words, coalesce(n_speakers, 0) as n_speakers, coalesce(n_turns, 0) as n_turns, coalesce(n_silences, 0) as n_silences, avg_alignment_conf,
 round(coalesce(s, 0) / (duration_ms / 1000.0e0), 6) as rtf from fx_media m left join t using (media_id) left join w using (media_id) left join q using (media_id) left join p using (media_id)""")

book.add("step_timings", lambda x: Q.step_timings(timings(x)).select("media_id", "wall_s", F.to_json("by_step").alias("by_step")), f"""
with {TIMINGS}, e as (select media_id, step, sum(seconds) as s from tim group by 1, 2) select media_id, round(sum(s), 6) as wall_s, '{{' || string_agg('"' || step || '":' || cast(s as varchar), ',' order by step) || '}}' as by_step from e group by 1""")

book.add("transcript_text", lambda x: Q.transcript_text(x.fx_segments.withColumn("avg_logprob", -F.col("conf_pct") / 64.0)).withColumn("confidence", F.round("confidence", 6)), """
select media_id, trim(string_agg(trim(text), ' ' order by segment_index)) as text, round(greatest(0.0e0, least(1.0e0, (avg(-conf_pct / 64.0e0) + 6) / 6)), 6) as confidence from fx_segments group by 1""")

book.add("speaker_summary", lambda x: Q.speaker_summary(x.fx_turns), """
select media_id, speaker_label, count(*) as n_turns, round(avg(conf_pct), 6) as avg_conf_pct, cast(sum(end_ms - start_ms) as bigint) as talk_ms from fx_turns group by 1, 2""")

book.add("live_progress", lambda x: Q.live_progress(coverage(x), coverage(x).groupBy("media_id").agg(F.max("end_ms").alias("duration_ms")), ["en", "es"], ("es",)), f"""
with {COVER}, m as (select media_id, max(end_ms) as d from cov group by 1), g as (select media_id, d, unnest(['en', 'es']) as language from m),
 t as (select media_id, language, sum(end_ms - start_ms) as c, max(case when start_ms <= 0 then end_ms end) as p from cov group by 1, 2)
select media_id, round(sum(least(d, coalesce(c, 0))) / (d * 2.0e0), 6) as progress, cast(coalesce(min(case when language <> 'es' then least(d, coalesce(p, 0)) end), 0) as bigint) as buffered_ms from g left join t using (media_id, language) group by media_id, d""")

book.add("distinct_turns", lambda x: Q.distinct_turns(x.fx_intervals.withColumnRenamed("label", "speaker_label")), """
select media_id, label as speaker_label, start_ms, end_ms, max(conf_pct) as conf_pct from fx_intervals group by all""")

book.add("row_constraints", lambda x: Q.row_violations(x.fx_intervals.withColumn("conf", F.col("conf_pct") / 64.0), Q.interval_expectations("label") | {"duration": F.col("end_ms") - F.col("start_ms") <= 1900}, ["media_id", "idx"]), """
select media_id, idx, 'conf_in_range' as violation from fx_intervals where conf_pct > 64 union all select media_id, idx, 'duration' from fx_intervals where end_ms - start_ms > 1900""")

book.add("text_constraints", lambda x: Q.row_violations(x.documents, Q.text_expectations(most=8000), ["doc_id"]), """
select doc_id, 'text_length' as violation from documents where length(text) > 8000 union all select doc_id, 'no_control_chars' from documents where regexp_matches(text, '[\\x00-\\x08\\x0B\\x0C\\x0E-\\x1F]')""")

book.add("media_constraints", lambda x: Q.media_violations(x.fx_segments, x.fx_media.withColumn("duration_ms", F.col("duration_ms") - F.when(F.col("media_id") % 10 == 1, 900).otherwise(0))), """
with s as (select f.*, row_number() over w - 1 as n, lag(end_ms) over w as pe, duration_ms - case when media_id % 10 = 1 then 900 else 0 end as d from fx_segments f join fx_media using (media_id) window w as (partition by media_id order by segment_index)),
 b as (select media_id, bool_or(segment_index <> n) as a, bool_or(coalesce(start_ms < pe, false)) as b, bool_or(end_ms > d) as c from s group by 1)
select media_id, 'indexes_contiguous' as violation from b where a union all select media_id, 'no_overlap' from b where b union all select media_id, 'within_total' from b where c""")


def measured_media(x: Inputs) -> DataFrame:
    """Media with what their tables add up to, and a fault of each kind in some."""
    m, sha = F.col("media_id"), F.sha2(F.col("media_id").cast("string"), 256)
    spoken = sound(x).groupBy("media_id").agg(F.sum(F.col("end_ms") - F.col("start_ms")).alias("speech_ms"), F.count("*").alias("n_voice"))
    quiet = silence(x).groupBy("media_id").agg(F.sum(F.col("end_ms") - F.col("start_ms")).alias("silence_ms"), F.count("*").alias("n_silence"))
    said = x.fx_turns.groupBy("media_id").agg(F.count("*").alias("n_turns"), F.count_distinct("speaker_label").alias("n_speakers"))
    rows = x.fx_media.join(spoken, "media_id", "left").join(quiet, "media_id", "left").join(said, "media_id", "left").na.fill(0)
    off = lambda c, k, by=1: (F.col(c) + F.when(m % k == 0, by).otherwise(0)).alias(c)
    return rows.select(
        "media_id", "duration_ms", F.when(m % 5 == 0, "none").otherwise(sha).alias("sha256"), F.when(m % 7 == 0, "f" * 64).otherwise(F.upper(sha)).alias("vad_sha256"), F.when(m % 8 == 0, "xx").when(m % 9 == 0, "und").otherwise("en").alias("language"),
        F.when(m % 10 == 0, 100).otherwise(16_000).alias("sample_rate"), F.when(m % 11 == 0, 3).otherwise(1).alias("channels"), F.when(m % 12 == 0, 12).otherwise(16).alias("bit_depth"), F.when(m % 13 == 0, -1).otherwise(9).alias("size_bytes"),
        off("speech_ms", 14), off("silence_ms", 15), (F.col("speech_ms") / F.col("duration_ms") + F.when(m % 16 == 0, 0.1).otherwise(0.0)).alias("speech_ratio"), off("n_voice", 17), off("n_silence", 18), off("n_turns", 19), off("n_speakers", 20),
        (F.col("duration_ms") / 4000.0).alias("wall_s"), F.when(m % 21 == 0, 0.26).otherwise(0.25).alias("rtf"),
    )


def sound(x: Inputs) -> DataFrame:
    return I.interval_union(x.fx_turns.select("media_id", "start_ms", "end_ms"))


book.add("track_constraints", lambda x: C.track_constraints(measured_media(x), sound(x), silence(x), x.fx_turns, x.fx_segments.withColumn("duration_ms", F.col("end_ms") - F.col("start_ms") + F.when(F.col("conf_pct") % 50 == 7, 1).otherwise(0))), f"""
with {SILENCE}, m as (select media_id, media_id as k, duration_ms, (select cast(sum(end_ms - start_ms) as bigint) from voice v where v.media_id = f.media_id) as sp, (select cast(sum(end_ms - start_ms) as bigint) from sil s where s.media_id = f.media_id) as si from fx_media f),
 t as (select *, lag(end_ms) over (partition by media_id order by start_ms, end_ms) as pe from fx_turns), g as (select *, lag(end_ms) over (partition by media_id order by segment_index) as pe, lag(segment_index) over (partition by media_id order by segment_index) as pi from fx_segments),
 r as (select media_id, 'media' as source, unnest(['hash', 'same_hash', 'language', 'rate', 'channels', 'depth', 'size', 'parts_make_total', 'speech_sum', 'silence_sum', 'ratio', 'voice_count', 'silence_count', 'turn_count', 'speaker_count', 'index_from_0', 'rtf']) as violation,
   unnest([k % 5 = 0, k % 7 = 0 or k % 5 = 0, k % 8 = 0, k % 10 = 0, k % 11 = 0, k % 12 = 0, k % 13 = 0, false, k % 14 = 0, k % 15 = 0, k % 16 = 0, k % 17 = 0, k % 18 = 0, k % 19 = 0, k % 20 = 0, not exists (select 1 from fx_segments s where s.media_id = k and segment_index = 0), k % 21 = 0]) as bad, 1 as n from m)
select media_id, source, violation, cast(n as bigint) as n from r where bad
union all select media_id, 'turns', 'no_overlap', count(*) from t where start_ms < pe group by 1 union all select t.media_id, 'turns', 'within_total', count(*) from t join fx_media m using (media_id) where end_ms > duration_ms group by 1
union all select media_id, 'segments', 'no_overlap', count(*) from g where start_ms < pe group by 1 union all select media_id, 'segments', 'contiguous', count(*) from g where segment_index <> pi + 1 group by 1
union all select media_id, 'segments', 'duration', count(*) from g where conf_pct % 50 = 7 group by 1""")


def audio(x: Inputs) -> DataFrame:
    return x.orders.select(F.col("o_orderkey").alias("media_id"), F.when(F.col("o_orderkey") % 7 == 0, 44100).otherwise(16000).alias("sample_rate"), F.when(F.col("o_orderkey") % 5 == 0, 2).otherwise(1).alias("channels"), F.lit(16).alias("bit_depth"), (F.col("o_orderkey") % 9).alias("size_bytes"))


book.add("audio_contract_filter", lambda x: Q.row_violations(audio(x), Q.audio_expectations(), ["media_id"]), """
select o_orderkey as media_id, 'rate' as violation from orders where o_orderkey % 7 = 0 union all select o_orderkey, 'mono' from orders where o_orderkey % 5 = 0 union all select o_orderkey, 'not_empty' from orders where o_orderkey % 9 = 0""")

book.add("duration_sanity", lambda x: x.fx_media.select("media_id", F.col("duration_ms").alias("p"), (F.col("duration_ms") + F.col("media_id") % 7 * 100).alias("d")).select("media_id", Q.duration_sane("p", "d").alias("sane")), """
select media_id, (media_id % 7 * 100) / cast(duration_ms + media_id % 7 * 100 as double) <= 0.05 as sane from fx_media""")


def logits(x: Inputs) -> DataFrame:
    return x.fx_logits.select("doc_id", F.array("l0", "l1", "l2").alias("logits"))


TOPK = """l as (select doc_id, unnest(['en', 'de', 'fr']) as code, unnest([0, 1, 2]) as i, unnest([l0, l1, l2]) as l from fx_logits), e as (select *, exp(l - max(l) over (partition by doc_id)) as w from l),
 p as (select *, w / sum(w) over (partition by doc_id) as c, row_number() over (partition by doc_id order by w desc, i) - 1 as rank from e)"""
book.add("lid_topk", lambda x: lid_topk(logits(x), ["en", "de", "fr"], 2), f"with {TOPK} select doc_id, rank, code, round(c, 6) as confidence from p where rank < 2")
book.add("lid_decision", lambda x: lid_decision(lid_topk(logits(x), ["en", "de", "fr"], 1).withColumn("silent", F.col("doc_id") % 10 == 0), 0.6, "es"), f"""
with {TOPK}, q as (select doc_id, doc_id % 10 = 0 as silent, code, round(c, 6) as c from p where rank = 0) select doc_id, case when silent then 'und' when c < 0.6 then 'es' else code end as language,
 case when silent or c < 0.6 then 0.0e0 else c end as confidence, case when silent then 'silent' when c < 0.6 then 'override' else 'detected' end as strategy from q""")
