"""Queries of text functions, cues, exports and translation."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracklake.functions import text as T
from tracklake.operators import cues as C
from tracklake.operators.quality import translation_summary
from tracklake.operators.tracks import segment_context
from tracklake.operators.translation import checked
from tracklake.queries.book import Book, Inputs
from tracklake.sources import documents as S

book = Book()


def cues(x: Inputs) -> DataFrame:
    """Cues with line breaks, markup and some faults, one track a medium, from the whole conversation turns."""
    text = F.when(F.col("segment_index") % 5 == 0, F.concat(F.lit(" <b>{x}</b>\r\n\r\n & "), "text")).otherwise(F.concat(F.substring("text", 1, 30), F.lit("\n"), F.substring(F.col("text"), F.lit(31), F.length("text"))))
    end = F.when(F.col("conf_pct") % 9 == 0, F.col("start_ms")).otherwise(F.col("end_ms"))
    return x.fx_segments.select("media_id", F.lit("en").alias("language"), F.col("segment_index").alias("cue_index"), (F.col("start_ms") - 1200).alias("start_ms"), (end - 1200).alias("end_ms"), text.alias("text"))


CUES = """cue as (select media_id, 'en' as language, segment_index as cue_index, start_ms - 1200 as start_ms, case when conf_pct % 9 = 0 then start_ms else end_ms end - 1200 as end_ms,
 case when segment_index % 5 = 0 then ' <b>{x}</b>' || chr(13) || chr(10) || chr(13) || chr(10) || ' & ' || text else substr(text, 1, 30) || chr(10) || substr(text, 31) end as text from fx_segments)"""
CLEAN = f"""{CUES}, cl0 as (select media_id, language, cue_index, greatest(0, start_ms) as start_ms, end_ms, trim(regexp_replace(regexp_replace(text, '\\r\\n?', chr(10), 'g'), '\\n\\s*\\n+', chr(10), 'g'), E' \\n\\t') as text from cue where end_ms > start_ms),
 cl as (select *, row_number() over (partition by media_id order by start_ms, end_ms, cue_index) as number from cl0 where text <> '')"""


def hms(c: str, sep: str) -> str:
    return f"(lpad(cast(greatest(0, {c}) // 3600000 as varchar), 2, '0') || ':' || lpad(cast(greatest(0, {c}) // 60000 % 60 as varchar), 2, '0') || ':' || lpad(cast(greatest(0, {c}) // 1000 % 60 as varchar), 2, '0') || '{sep}' || lpad(cast(greatest(0, {c}) % 1000 as varchar), 3, '0'))"


def hmc(c: str) -> str:
    return f"(cast({c} // 3600000 as varchar) || ':' || lpad(cast({c} // 60000 % 60 as varchar), 2, '0') || ':' || lpad(cast({c} // 1000 % 60 as varchar), 2, '0') || '.' || lpad(cast({c} % 1000 // 10 as varchar), 2, '0'))"


SRT = f"string_agg(cast(number as varchar) || chr(10) || {hms('start_ms', ',')} || ' --> ' || {hms('end_ms', ',')} || chr(10) || text || chr(10), chr(10) order by number)"
VTT = f"'WEBVTT' || chr(10) || string_agg(chr(10) || {hms('start_ms', '.')} || ' --> ' || {hms('end_ms', '.')} || chr(10) || replace(replace(replace(replace(text, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '--&gt;', '→') || chr(10), '' order by number)"


def ass(width: str, height: str, style: str) -> str:
    rows = f"string_agg('Dialogue: 0,' || {hmc('start_ms')} || ',' || {hmc('end_ms')} || ',Default,,0,0,0,,' || replace(replace(replace(text, '{{', '('), '}}', ')'), chr(10), '\\N') || chr(10), '' order by number)"
    head = f"'[Script Info]' || chr(10) || 'ScriptType: v4.00+' || chr(10) || 'Language: ' || language || chr(10) || 'PlayResX: ' || {width} || chr(10) || 'PlayResY: ' || {height} || chr(10) || 'WrapStyle: 0' || chr(10) || 'ScaledBorderAndShadow: yes' || chr(10) || chr(10) || '[V4+ Styles]' || chr(10) || '{C.ASS_STYLE_FORMAT}' || chr(10) || {style} || chr(10) || chr(10) || '[Events]' || chr(10) || '{C.ASS_EVENT_FORMAT}' || chr(10)"
    return f"{head} || {rows}"


def all_of(x: Inputs) -> DataFrame:
    return C.export_all(cues(x))


EMPTY = "not exists (select 1 from cl where cl.media_id = cue.media_id)"
book.add("export_srt", lambda x: C.export_srt(cues(x)), f"with {CLEAN} select media_id, language, {SRT} as content from cl group by 1, 2 union all select distinct media_id, language, '' from cue where {EMPTY}")
book.add("export_vtt", lambda x: C.export_vtt(cues(x)), f"with {CLEAN} select media_id, language, {VTT} as content from cl group by 1, 2 union all select distinct media_id, language, 'WEBVTT' || chr(10) from cue where {EMPTY}")
ASS = ass("'1920'", "'1080'", f"'{C.ASS_STYLE}'")
book.add("export_ass", lambda x: C.export_ass(cues(x)), f"with {CLEAN} select media_id, language, {ASS} as content from cl group by 1, 2")
SIZED = "'Style: Default,Arial,37,&H00FFFFFF,&H000000FF,&H70000000,&H70000000,0,0,0,0,100,100,0,0,3,12,0,2,102,102,50,1'"
book.add("export_ass_sized", lambda x: C.export_ass_sized(cues(x), cues(x).select("media_id", "language").distinct().select("*", F.lit(1280).alias("width"), F.lit(720).alias("height"))), f"with {CLEAN} select media_id, language, {ass(repr('1280'), repr('720'), SIZED)} as content from cl group by 1, 2")
book.add("export_all_languages", all_of, f"""
with {CLEAN}, e as (select media_id, language, 'srt' as format, {SRT} as content from cl group by 1, 2 union all select media_id, language, 'vtt', {VTT} from cl group by 1, 2 union all select media_id, language, 'ass', {ASS} from cl group by 1, 2)
select media_id, language, format, cast(media_id as varchar) || '.' || language || '.' || format as file_name, content from e""")
book.add("cue_range_filter", lambda x: C.cue_range(cues(x).drop("text"), 1, 2000, 9000), f"""
with {CUES}, m as (select *, cue_index > 1 and end_ms > 2000 and start_ms < 9000 as i, count(*) over (partition by media_id) as total from cue), n as (select *, count(*) filter (where i) over (partition by media_id) = total as complete from m)
select media_id, language, cue_index, start_ms, end_ms, total, complete from n where i""")
book.add("sorted_cues", lambda x: C.sorted_cues(cues(x).drop("text")), f"""
with {CUES} select media_id, language, cue_index, start_ms, end_ms, concat_ws(':', language, start_ms, end_ms) as cue_key, row_number() over (partition by media_id order by start_ms, end_ms, cue_index) as place from cue""")
book.add("publish_new_cues", lambda x: C.publish_new(cues(x).where("cue_index % 2 = 0"), cues(x)), f"""
with {CUES} select * from cue where cue_index % 2 = 0 union all select distinct on (media_id, start_ms, end_ms) * from cue a where not exists (select 1 from cue b where b.cue_index % 2 = 0 and a.media_id = b.media_id and a.start_ms = b.start_ms and a.end_ms = b.end_ms)""")


def two_tracks(x: Inputs) -> DataFrame:
    return x.fx_coverage.select("media_id", F.when(F.col("media_id") % 3 == 1, "en").otherwise(F.col("language")).alias("language"))


book.add("missing_translations", lambda x: C.missing_translations(two_tracks(x), "en", ["es", "fr"]), """
with t as (select distinct media_id, case when media_id % 3 = 1 then 'en' else language end as language from fx_coverage) select media_id, l as language from (select media_id, unnest(['es', 'fr']) as l from t where language = 'en') w where not exists (select 1 from t where t.media_id = w.media_id and t.language = l)""")

# folds: no SQL; tests hold them against a plain loop
track = lambda x: x.fx_segments.select("media_id", F.lit("en").alias("language"), "segment_index", "start_ms", "end_ms", "text", F.col("speaker_label").alias("speaker"))
book.add("wrap_blocks", lambda x: x.documents.select("doc_id", F.to_json(C.wrap_blocks(F.col("text"))).alias("blocks")))
# The folds in SQL: one step of the recursion adds a word to its text's lines, or a cue to its track.
SP = "trim(regexp_replace(text, '[\\s\\x0B\\x1C-\\x1F\\x{85}\\x{A0}\\x{2000}-\\x{200A}\\x{2028}\\x{2029}]+', ' ', 'g'))"
SPLIT = f"""sg as (select media_id, segment_index, start_ms, case when end_ms <= start_ms then start_ms + {C.MIN_MS} else end_ms end as end_ms, speaker_label, list_filter(string_split({SP}, ' '), lambda x: x <> '') as ws from fx_segments),
 ln as (select media_id, segment_index, 0 as i, cast([] as varchar[]) as lines, '' as cur from sg union all
  select media_id, segment_index, i + 1, case when cur <> '' and length(cur) + 1 + length(t) > {C.MAX_CHARS} then list_append(lines, cur) else lines end, case when cur = '' or length(cur) + 1 + length(t) > {C.MAX_CHARS} then t else cur || ' ' || t end
  from (select ln.*, substr(ws[i + 1], 1, {C.MAX_CHARS}) as t from ln join sg using (media_id, segment_index) where i < len(ws)) x),
 wr as (select sg.*, list_append(lines, cur) as lines from ln join sg using (media_id, segment_index) where i = len(ws) and len(ws) > 0),
 bl as (select * exclude (ws, lines), array_to_string(lines[2 * part + 1:2 * part + 2], chr(10)) as text, list_sum(list_transform(lines[2 * part + 1:2 * part + 2], lambda x: length(x))) as w from (select *, unnest(range(0, (len(lines) + 1) // 2)) as part from wr) x),
 pc as (select *, least({C.MAX_MS}, greatest({C.MIN_MS}, cast(greatest({C.MIN_MS}, end_ms - start_ms) * w // sum(w) over (partition by media_id, segment_index) as bigint))) as piece from bl),
 rawc as (select media_id, 'en' as language, segment_index, start_ms as segment_start_ms, end_ms as segment_end_ms, part, speaker_label as speaker, text,
  cast(start_ms + sum(piece) over (partition by media_id, segment_index order by part) - piece as bigint) as start_ms, cast(start_ms + sum(piece) over (partition by media_id, segment_index order by part) as bigint) as end_ms from pc)"""


def timed(source: str, order: str) -> str:
    """numc and tm: the cues of `source` in order, and the times that they get."""
    return f"""numc as (select *, row_number() over (partition by media_id order by {order}) as n, lead(start_ms) over (partition by media_id order by {order}) - {C.GAP_MS} as bound from {source}),
 tm as (select media_id, cast(0 as bigint) as n, cast(null as bigint) as s, cast(null as bigint) as e from (select distinct media_id from numc) m union all
  select media_id, n, s, cast(case when bound is null then e else least(e, greatest(s + 1, bound)) end as bigint) from (
   select media_id, n, s, bound, greatest(end_ms, s + case when bound is null then {C.MIN_MS} else greatest({C.MIN_MS}, cast(trunc(length(replace(text, chr(10), '')) / {C.MAX_CPS}e0 * 1000) as bigint)) end) as e
   from (select c.*, greatest(c.start_ms, coalesce(tm.e + {C.GAP_MS}, c.start_ms)) as s from tm join numc c on c.media_id = tm.media_id and c.n = tm.n + 1) y) z)"""


book.add("resolve_cue_timing", lambda x: cues(x).groupBy("media_id").agg(F.array_sort(F.collect_list(F.struct("start_ms", "end_ms", "text"))).alias("c")).select("media_id", F.explode(C.resolve_timing(F.col("c"))).alias("t")).select("media_id", "t.*"), f"""
with recursive {CUES}, {timed("cue", "start_ms, end_ms, text")} select media_id, s as start_ms, e as end_ms from tm where n > 0""")
book.add("build_cues", lambda x: C.build_cues(track(x)), f"""
with recursive {SPLIT}, {timed("rawc", "segment_start_ms, segment_end_ms, segment_index, part")} select media_id, language, n as cue_index, s as start_ms, e as end_ms, text, speaker, 'final' as state from tm join numc using (media_id, n)""")
book.add("protect_glossary", lambda x: x.conversations.select("conv_id", "turn", T.protect_glossary(F.col("text"), F.array(*[F.struct(F.lit(a).alias("term"), F.lit(b).alias("replacement")) for a, b in (("the", "el"), ("then", "luego"), ("of", "de"))])).alias("p")).select("conv_id", "turn", F.col("p.text").alias("protected"), T.restore_glossary(F.col("p.text"), F.col("p.tokens")).alias("restored")))
book.add("proportional_split", lambda x: C.split_segments(track(x)).drop("text"), f"with recursive {SPLIT} select * exclude (text) from rawc")

d = lambda x: x.documents.select("doc_id", "text", "lang")
book.add("normalise_space", lambda x: d(x).select("doc_id", T.normalise_space(F.col("text")).alias("text"), T.folded(F.col("text")).alias("folded")), f"select doc_id, {SP} as text, replace(lower({SP}), 'ß', 'ss') as folded from documents")
book.add("timecode", lambda x: x.lineitem.select("l_orderkey", (F.col("l_extendedprice") * 100 - 500000).cast("long").alias("ms")).distinct().select("l_orderkey", "ms", T.timecode(F.col("ms")).alias("srt"), T.timecode(F.col("ms"), ".").alias("vtt"), T.timecode(F.col("ms"), centis=True).alias("ass")), f"""
with m as (select distinct l_orderkey, cast(trunc(l_extendedprice * 100 - 500000) as bigint) as ms from lineitem) select l_orderkey, ms, {hms('ms', ',')} as srt, {hms('ms', '.')} as vtt, {hmc('greatest(0, ms)')} as ass from m""")
book.add("clean_cue_text", lambda x: cues(x).select("media_id", "cue_index", T.clean_cue_text(F.col("text")).alias("text")), f"""
with {CUES} select media_id, cue_index, trim(regexp_replace(regexp_replace(text, '\\r\\n?', chr(10), 'g'), '\\n\\s*\\n+', chr(10), 'g'), E' \\n\\t') as text from cue""")
book.add("escape_vtt", lambda x: cues(x).select("media_id", "cue_index", T.escape_vtt(F.col("text")).alias("text")), f"with {CUES} select media_id, cue_index, replace(replace(replace(text, '&', '&amp;'), '<', '&lt;'), '>', '&gt;') as text from cue")
book.add("escape_ass", lambda x: cues(x).select("media_id", "cue_index", T.escape_ass(F.col("text")).alias("text")), f"with {CUES} select media_id, cue_index, replace(replace(replace(text, '{{', '('), '}}', ')'), chr(10), '\\N') as text from cue")
curly = lambda: F.concat(F.lit("“Well” –  "), "text", F.lit(" , ‘ok’ !"))
CURLY = "('“Well” –  ' || text || ' , ‘ok’ !')"
TYPO = f"trim(regexp_replace(regexp_replace(translate({CURLY}, '‘’‚‛′‵“”„‟″‶–—', '''''''''''''\"\"\"\"\"\"--'), ' {{2,}}', ' ', 'g'), '\\s+([,.;:!?])', '\\1', 'g'))"
book.add("typography_normalise", lambda x: d(x).select("doc_id", T.typography_normalise(curly()).alias("text")), f"select doc_id, {TYPO} as text from documents")
fill = lambda: F.concat(F.lit("Well, actually, Also, bueno, en fait, "), F.trim("text"))
FILL = "('Well, actually, Also, bueno, en fait, ' || trim(text, ' '))"
strip = lambda x: F.when(F.col("lang") == "en", F.col("f")).otherwise(F.regexp_replace("f", "^Well, actually, ", ""))
STRIPPED = f"case when lang = 'en' then {FILL} else regexp_replace({FILL}, '^Well, actually, ', '') end"
book.add("strip_fillers", lambda x: d(x).withColumn("f", F.trim(fill())).withColumn("f", strip(x)).select("doc_id", T.strip_fillers(F.col("f"), F.col("lang")).alias("text")), f"""
with f as (select doc_id, lang, trim({STRIPPED}, ' ') as f from documents) select doc_id, case lang when 'en' then regexp_replace(f, '(?i)^((well,|you know,|i mean,|actually,|like,)\\s+)+', '') when 'de' then regexp_replace(f, '(?i)^((also,|na ja,|weißt du,|eigentlich,)\\s+)+', '')
 when 'es' then regexp_replace(f, '(?i)^((bueno,|pues,|o sea,|digamos,|en plan,)\\s+)+', '') when 'fr' then regexp_replace(f, '(?i)^((eh bien,|ben,|en fait,|tu vois,)\\s+)+', '') else f end as text from f""")
book.add("collapse_intensifiers", lambda x: d(x).select("doc_id", T.collapse_intensifiers(F.concat(F.lit("muy muy, really  really and also sehr "), "text")).alias("text")), """
select doc_id, regexp_replace(regexp_replace(regexp_replace('muy muy, really  really and also sehr ' || text, '\\bmuy\\s+muy\\b', 'muy', 'g'), '\\breally\\s+really\\b', 'really', 'g'), '\\band also\\b', 'and', 'g') as text from documents""")
book.add("adaptation_fit", lambda x: x.fx_segments.select("media_id", "segment_index", T.adaptation_fit(F.concat(F.lit("[es] "), "text"), F.col("text"), F.col("end_ms") - F.col("start_ms")).alias("f")).select("media_id", "segment_index", "f.cps", "f.ratio", "f.max_chars", "f.fits", F.size("f.warnings").cast("long").alias("n_warnings")), """
with a as (select media_id, segment_index, length(text) + 5 as n, length(trim(text, ' ')) as m, (end_ms - start_ms) / 1000.0e0 as s from fx_segments)
select media_id, segment_index, round(n / s, 3) as cps, round(n / cast(m as double), 3) as ratio, cast(trunc(18 * s) as bigint) as max_chars, n <= trunc(18 * s) as fits, cast((n > trunc(18 * s)) as bigint) + cast(n / cast(m as double) > 1.35e0 as bigint) as n_warnings from a""")
book.add("degenerate_text", lambda x: d(x).select("doc_id", T.degenerate(F.when(F.col("doc_id") % 5 == 0, F.concat("text", F.lit("...."))).when(F.col("doc_id") % 5 == 1, F.regexp_replace("text", "[A-Za-zÀ-ſ]+", "7")).otherwise(F.col("text"))).alias("degenerate")), """
select doc_id, t = '' or len(list_filter(list_distinct(string_split(t, '')), lambda c: c <> chr(10) and contains(t, repeat(c, 4)))) > 0 or (length(t) > 3 and not regexp_matches(t, '[A-Za-zÀ-ſ]')) as degenerate
from (select doc_id, trim(case doc_id % 5 when 0 then text || '....' when 1 then regexp_replace(text, '[A-Za-zÀ-ſ]+', '7', 'g') else text end, ' ') as t from documents) d""")


def translated(x: Inputs) -> DataFrame:
    got = F.when(F.col("segment_index") % 4 == 3, " ").otherwise(F.concat(F.lit("[es] "), "text"))
    return checked(x.fx_segments.select("media_id", "segment_index", "start_ms", F.when(F.col("conf_pct") % 7 == 0, F.col("start_ms")).otherwise(F.col("end_ms")).alias("end_ms"), F.lit("en").alias("source_lang"), F.when(F.col("media_id") % 2 == 0, "es").otherwise("en").alias("target_lang"), "text", got.alias("translated")))


CHECKED = """ck as (select media_id, segment_index, case when media_id % 2 = 0 then 'es' else 'en' end as target_lang, case when media_id % 2 = 0 and segment_index % 4 = 3 and trim(text) <> '' then 2 else 0 end + case when conf_pct % 7 = 0 then 1 else 0 end as n_errors from fx_segments)"""
book.add("translation_checks", lambda x: translated(x).select("media_id", "segment_index", "target_lang", F.size("errors").cast("long").alias("n_errors"), "ok"), f"with {CHECKED} select media_id, segment_index, target_lang, cast(n_errors as bigint) as n_errors, n_errors = 0 as ok from ck")
book.add("translation_summary", lambda x: translation_summary(translated(x)).drop("n_warnings"), f"""
with {CHECKED} select media_id, 'en' as source_lang, target_lang, count(*) as n_in, count(*) filter (where n_errors = 0) as n_ok, cast(sum(n_errors) as bigint) as n_errors, sum(n_errors) = 0 as success, target_lang <> 'en' as performed from ck group by media_id, target_lang""")
book.add("write_translation_doc", lambda x: S.translation_documents(translated(x)))
book.add("language_route", lambda x: d(x).select("doc_id", T.language_route(F.when(F.col("doc_id") % 7 == 0, "und").otherwise(F.upper("lang")), F.lit("fr")).alias("route")), """
select doc_id, case when doc_id % 7 = 0 then 'error_undetermined' when lang = 'fr' then 'passthrough' when lang not in ('es', 'en', 'fr', 'it', 'pt') then 'error_unsupported' else 'translate' end as route from documents""")
book.add("logprob_confidence", lambda x: x.events.select("event_id", T.logprob_confidence(F.when(F.col("event_id") % 10 == 0, float("nan")).otherwise(F.col("value") / 10 - 7)).alias("confidence")), """
select event_id, case when event_id % 10 <> 0 then greatest(0.0e0, least(1.0e0, (value / 10 - 7 + 6) / 6)) end as confidence from events""")
book.add("seconds_to_ms", lambda x: x.events.select("event_id", T.seconds_to_ms(F.round(F.col("value") * 8) / 8 - 1, F.lit(100)).alias("ms")), "select event_id, greatest(0, cast(round_even((round(value * 8) / 8 - 1) * 1000, 0) as bigint) + 100) as ms from events")
book.add("word_count", lambda x: d(x).select("doc_id", T.word_count(F.col("text")).cast("long").alias("n")), f"select doc_id, case when {SP} = '' then 0 else len(string_split({SP}, ' ')) end as n from documents")
book.add("segment_key", lambda x: x.fx_coverage.select("media_id", T.segment_key(F.col("language"), F.col("start_ms"), F.col("end_ms")).alias("key")), "select media_id, language || ':' || start_ms || ':' || end_ms as key from fx_coverage")
book.add("safe_filename", lambda x: x.pages.select("page_id", T.safe_filename(F.col("url")).alias("name"), T.safe_filename(F.concat(F.lit("con."), F.col("page_id").cast("string"), F.lit(" ?.. "))).alias("reserved")), """
with n as (select page_id, regexp_replace(regexp_replace(trim(url, ' '), '[<>:"/\\\\|?*\\x00-\\x1f ]', '_', 'g'), '\\.+$', '') as n from pages)
select page_id, case when length(n) > 200 then substr(n, 1, 200 - length(regexp_extract(n, '[^.](\\.[^.]*)$', 1))) || regexp_extract(n, '[^.](\\.[^.]*)$', 1) else n end as name, '_con.' || page_id || '__' as reserved from n""")
book.add("mime_by_extension", lambda x: d(x).select("doc_id", T.mime_by_extension(F.concat(F.lit("a.b."), F.element_at(F.array(*map(F.lit, ("MP4", "wav", "mkv", "txt"))), (F.col("doc_id") % 4 + 1).cast("int")))).alias("mime")), "select doc_id, ['video/mp4', 'audio/wav', 'video/x-matroska', 'application/octet-stream'][doc_id % 4 + 1] as mime from documents")
STEPS = ("T04_VAD", "T15_es", "T02_x", "COMPLETED", "unknown", "T10_QUALITY", "T14_CLEANUP", "")
book.add("stage_canonical", lambda x: d(x).withColumn("s", T.stage_of(F.element_at(F.array(*map(F.lit, STEPS)), (F.col("doc_id") % 8 + 1).cast("int")))).select("doc_id", F.col("s").alias("stage"), T.stage_percent(F.col("s")).cast("long").alias("percent"), T.stage_status(F.col("s")).alias("status")), """
select doc_id, ['VAD', 'TRANSLATING', 'MEDIA_PREP', 'COMPLETED', 'PROCESSING', 'QUALITY', 'COMPLETED', 'PROCESSING'][doc_id % 8 + 1] as stage, cast([16, 88, 8, 100, 50, 72, 100, 50][doc_id % 8 + 1] as bigint) as percent,
 ['PROCESSING', 'TRANSLATING', 'PROCESSING', 'COMPLETED', 'PROCESSING', 'PROCESSING', 'COMPLETED', 'PROCESSING'][doc_id % 8 + 1] as status from documents""")
secret = lambda: F.create_map(F.lit("api-Key"), F.col("lang"), F.lit("name"), F.col("source"), F.lit("HF_TOKEN"), F.lit("x"))
book.add("redact_secrets", lambda x: x.documents.select("doc_id", F.to_json(T.redact_map(secret())).alias("fields")), """select doc_id, '{"api-Key":"***REDACTED***","name":"' || source || '","HF_TOKEN":"***REDACTED***"}' as fields from documents""")
book.add("language_name", lambda x: d(x).select("doc_id", T.language_name(F.when(F.col("doc_id") % 9 == 0, "xx").when(F.col("doc_id") % 9 == 1, "nn").otherwise(F.upper("lang"))).alias("name")), """
select doc_id, case when doc_id % 9 = 0 then 'Xx' when doc_id % 9 = 1 then 'Norwegian Nynorsk' else case lang when 'en' then 'English' when 'de' then 'German' when 'fr' then 'French' when 'es' then 'Spanish' end end as name from documents""")
book.add("target_languages", lambda x: d(x).select("doc_id", T.target_languages(F.lit(" ES, fr,xx,es ,en"), F.col("lang")).alias("targets")), "select doc_id, case lang when 'es' then ['fr', 'en'] when 'fr' then ['es', 'en'] when 'en' then ['es', 'fr'] else ['es', 'fr', 'en'] end as targets from documents")
book.add("segment_context", lambda x: segment_context(x.fx_segments.select("media_id", "segment_index", "text")), "select media_id, segment_index, text, lag(text) over w as previous_text, lead(text) over w as next_text from fx_segments window w as (partition by media_id order by segment_index)")
