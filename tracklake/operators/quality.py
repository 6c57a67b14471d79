"""Quality rules, score, validation checks and metrics of media, as long tables keyed by media and rule."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tracklake.functions.text import logprob_confidence, word_count

#: (rule, severity, penalty for each occurrence, most occurrences counted as a penalty of 1)
RULES = (
    ("QR01", "ERROR", 1.0), ("QR02", "ERROR", 1.0), ("QR03", "ERROR", 1.0), ("QR04", "ERROR", 1.0), ("QR05", "WARNING", 0.03), ("QR06", "WARNING", 0.02),
    ("QR07", "WARNING", 0.04), ("QR08", "WARNING", 0.005), ("QR09", "WARNING", 0.02), ("QR10", "WARNING", 0.015), ("QR11", "WARNING", 0.03),
)
PASS, WARN = 0.80, 0.30


def tagged(media: DataFrame, dialogue: DataFrame, segments: DataFrame, turns: DataFrame, voice: DataFrame, silence: DataFrame, words: DataFrame | None) -> DataFrame:
    """All inputs of the rules as rows of one table: media_id, role, idx, start_ms, end_ms, flag, value, label."""
    columns = {"idx": "long", "start_ms": "long", "end_ms": "long", "flag": "boolean", "value": "double", "label": "string"}

    def rows(df: DataFrame, role: str, **given: str | Column) -> DataFrame:
        filled = [(F.col(given[c]) if isinstance(given[c], str) else given[c]).cast(t).alias(c) if c in given else F.lit(None).cast(t).alias(c) for c, t in columns.items()]
        return df.select("media_id", F.lit(role).alias("role"), *filled)

    times = {"start_ms": "start_ms", "end_ms": "end_ms"}
    confidence = F.coalesce(F.col("confidence"), logprob_confidence(F.col("avg_logprob")))
    parts = [
        rows(media, "media", end_ms="duration_ms"), rows(dialogue, "dialogue", idx="segment_index", flag=F.trim(F.coalesce("text", F.lit(""))) == "", **times), rows(segments, "segment", value=confidence),
        rows(turns, "turn", label="speaker_label"), rows(voice, "voice", **times), rows(silence, "silence", **times),
    ]
    return reduce(DataFrame.unionByName, parts + ([rows(words, "word", value="confidence")] if words is not None else []))


def quality_rules(
    media: DataFrame, dialogue: DataFrame, segments: DataFrame, turns: DataFrame, voice: DataFrame, silence: DataFrame, words: DataFrame | None = None,
    min_conf: float = 0.4, min_word_conf: float = 0.3, long_silence_ms: int = 15_000, overlap_ms: int = 100, long_ms: int = 60_000,
) -> DataFrame:
    """(media_id, rule_code, severity, applicable, occurrences, penalty, passed) for all eleven rules of every medium.

    segments are the transcript's, with confidence or avg_logprob; words (media_id, confidence) may be missing. A rule that
    is not applicable passes. Media without any row still get all rules; rows of media that are not listed count nowhere.

    All inputs are one table of tagged rows, dealt by medium once: two windows and the one aggregate that counts for every
    rule need no exchange of their own. Whether voice lies under a dialogue row is read from a sweep: of the voice that
    starts before the row ends, the latest end must come after the row's start.
    """
    rows = tagged(media, dialogue, segments, turns, voice, silence, words).repartition("media_id")
    is_role = lambda name: F.col("role") == name
    beside = Window.partitionBy("media_id", "role").orderBy("idx")
    # A medium's own row, without a place, comes first; a row of dialogue lies at its end, before voice that starts there.
    place = F.when(is_role("voice"), F.col("start_ms")).when(is_role("dialogue"), F.col("end_ms"))
    sweep = Window.partitionBy("media_id").orderBy(F.col("_place").asc_nulls_first(), F.col("_late")).rowsBetween(Window.unboundedPreceding, 0)
    sounds = is_role("voice") & (F.col("end_ms") > F.col("start_ms"))
    rows = rows.withColumns({"_ns": F.lead("start_ms").over(beside), "_ne": F.lead("end_ms").over(beside), "_place": place, "_late": is_role("voice").cast("int")})
    rows = rows.withColumns({"_heard": F.max(F.when(sounds, F.col("end_ms"))).over(sweep), "_total": F.max(F.when(is_role("media"), F.col("end_ms"))).over(sweep)})
    shared = F.least("end_ms", "_ne") - F.greatest("start_ms", "_ns")
    voiced = (F.col("end_ms") > F.col("start_ms")) & (F.col("_heard") > F.col("start_ms"))
    outside = (F.col("start_ms") < 0) | (F.col("end_ms") > F.col("_total"))
    said = lambda on: F.count_if(is_role("dialogue") & F.coalesce(on, F.lit(False)))
    of = lambda role, on: F.count_if(is_role(role) & F.coalesce(on, F.lit(False)))
    length = F.col("end_ms") - F.col("start_ms")
    known = F.col("value").isNotNull()
    wide = rows.groupBy("media_id").agg(
        F.max(is_role("media")).alias("_listed"), said(F.col("start_ms") >= F.col("end_ms")).alias("QR01"), said(F.col("flag")).alias("QR02"), said(outside).alias("QR03"),
        said(F.col("_ns").isNotNull() & (shared > overlap_ms)).alias("QR04"), of("segment", F.col("value") < min_conf).alias("QR07"), of("word", F.col("value") < min_word_conf).alias("QR08"),
        said(length > long_ms).alias("QR09"), of("silence", length > long_silence_ms).alias("QR10"), F.count_if(is_role("dialogue") & ~F.coalesce(voiced, F.lit(False))).alias("QR11"),
        said(F.lit(True)).alias("n_dialogue"), of("segment", F.lit(True)).alias("n_segments"), of("turn", F.col("label").isNotNull()).alias("n_turns"), of("segment", known).alias("n_conf"), of("word", known).alias("n_words"),
    ).where("_listed")
    occurrences = {r: F.col(r) for r, _, _ in RULES if r not in ("QR05", "QR06")}
    occurrences["QR05"] = F.greatest(F.lit(0), F.col("n_segments") - F.col("n_dialogue")).cast("long")
    occurrences["QR06"] = ((F.col("n_turns") > 0) & (F.col("n_segments") > 0) & (F.col("n_dialogue") == 0)).cast("long")
    applicable = {r: F.lit(True) for r, _, _ in RULES} | {"QR07": F.col("n_conf") > 0, "QR08": F.col("n_words") > 0}
    each = [F.struct(F.lit(r).alias("rule_code"), F.lit(s).alias("severity"), applicable[r].alias("applicable"), occurrences[r].alias("occurrences"), F.lit(p).alias("each")) for r, s, p in RULES]
    out = wide.select("media_id", F.explode(F.array(*each)).alias("r")).select("media_id", "r.*")
    charged = F.when(F.col("severity") == "ERROR", (F.col("occurrences") > 0).cast("double")).otherwise(F.least(F.lit(1.0), F.col("occurrences") * F.col("each")))
    penalty = F.when(F.col("applicable"), F.round(charged, 6)).otherwise(F.lit(0.0))
    return out.select("media_id", "rule_code", "severity", "applicable", "occurrences", penalty.alias("penalty"), (~F.col("applicable") | (F.col("occurrences") == 0)).alias("passed"))


def quality_score(rules: DataFrame, silent: DataFrame | None = None) -> DataFrame:
    """Score 1 - sum of penalties in [0, 1], level and counters of each medium; silent media (media_id) score 1."""
    failed = lambda s: F.count_if((F.col("severity") == s) & ~F.col("passed"))
    out = rules.groupBy("media_id").agg(
        F.round(F.greatest(F.lit(0.0), F.lit(1.0) - F.sum("penalty")), 6).alias("score"), F.count_if("passed").alias("n_passed"), failed("ERROR").alias("n_failed"), failed("WARNING").alias("n_warning"))
    if silent is not None:
        quiet = silent.select("media_id").distinct().withColumn("_quiet", F.lit(True))
        out = out.join(quiet, "media_id", "left").withColumn("score", F.when(F.col("_quiet"), F.lit(1.0)).otherwise(F.col("score"))).drop("_quiet")
    return out.withColumn("level", level_of(F.col("score")))


def level_of(score: Column, pass_at: float = PASS, warn_at: float = WARN) -> Column:
    return F.when(score >= pass_at, "passed").when(score >= warn_at, "warning").otherwise("failed")


def validation_checks(
    media: DataFrame, alignment: DataFrame, quality: DataFrame, asr: DataFrame, dialogue: DataFrame, turns: DataFrame, rules: DataFrame,
    pass_at: float = PASS, warn_at: float = WARN,
) -> DataFrame:
    """(media_id, check_code, outcome) of the eleven checks of every medium; outcome is passed or error.

    One-row-a-medium inputs: media (sha256, duration_ms, vad_sha256, vad_duration_ms, diarization_sha256, job_id), alignment
    (sha256, duration_ms, n_segments, n_aligned, n_unassigned, language, job_id), quality (sha256, duration_ms, score, level,
    n_passed, n_failed, n_warning, job_id), asr (sha256, n_segments, n_rows, language, job_id). All inputs are rows of one table
    and meet in one aggregate by medium, which counts in tasks first.
    """
    whole = lambda df, role: df.select("media_id", F.struct(*[c for c in df.columns if c != "media_id"]).alias(role))
    judged = rules.select("media_id", F.struct("severity", "passed").alias("r"))
    said = dialogue.select("media_id", F.struct("segment_index", "start_ms", "end_ms", "duration_ms", "speaker_label").alias("d"))
    heard = turns.select("media_id", F.struct("speaker_label").alias("t"))
    rows = reduce(lambda x, y: x.unionByName(y, allowMissingColumns=True), [whole(media, "m"), whole(alignment, "a"), whole(quality, "q"), whole(asr, "s"), said, heard, judged])
    d, start, end, failed = F.col("d"), F.col("d.start_ms"), F.col("d.end_ms"), ~F.col("r.passed")
    wrong = (start < 0) | (end <= start) | (F.col("d.duration_ms") != end - start) | (F.col("d.segment_index") < 0)
    nameless = F.count_if(d.isNotNull() & F.col("d.speaker_label").isNull()) > 0
    unknown = F.size(F.array_except(F.collect_set("d.speaker_label"), F.collect_set("t.speaker_label"))) > 0
    wide = rows.groupBy("media_id").agg(
        *[F.any_value(c, F.lit(True)).alias(c) for c in "maqs"], F.bool_or(wrong).alias("_wrong"), F.max(end).alias("_end"), (unknown | nameless).alias("_unknown"), F.count("r").alias("_n"), F.count_if("r.passed").alias("_p"),
        F.count_if((F.col("r.severity") == "ERROR") & failed).alias("_f"), F.count_if((F.col("r.severity") == "WARNING") & failed).alias("_w"),
    ).where(F.col("m").isNotNull())
    named = [F.col(f"{role}.{c}").alias(f"{role}_{c}") for role, df in (("a", alignment), ("q", quality), ("s", asr)) for c in df.columns if c != "media_id"]
    one = wide.select("media_id", "m.*", "a", "_wrong", "_end", "_unknown", "_n", "_p", "_f", "_w", *named)
    one = one.withColumn("_bad", F.col("a").isNotNull() & (F.coalesce("_wrong", F.lit(False)) | F.coalesce(F.col("_end") > F.col("a_duration_ms"), F.lit(False))))
    sha = lambda c: F.lower(F.coalesce(F.col(c), F.lit("")))
    jobs = F.array_distinct(F.array_compact(F.array("job_id", "a_job_id", "q_job_id", "s_job_id")))
    durations = F.array_compact(F.array("a_duration_ms", "q_duration_ms", F.when(F.col("vad_duration_ms") > 0, F.col("vad_duration_ms"))))
    checks = {
        "VC01": (sha("q_sha256") == sha("a_sha256")) & (sha("vad_sha256") == sha("a_sha256")) & (sha("s_sha256") == sha("a_sha256")) & (sha("diarization_sha256") == sha("a_sha256")),
        "VC02": F.size(jobs) <= 1,
        "VC03": ~F.exists(durations, lambda d: d < 0) & (F.size(F.array_distinct(durations)) <= 1),
        "VC04": (F.least("a_n_segments", "a_n_aligned", "a_n_unassigned") >= 0) & (F.col("a_n_aligned") + F.col("a_n_unassigned") <= F.col("a_n_segments")),
        "VC05": ~F.col("_bad"),
        "VC06": ~F.col("_unknown"),
        "VC07": F.col("s_n_segments") == F.col("s_n_rows"),
        "VC08": F.col("a_language").eqNullSafe(F.col("s_language")),
        "VC09": F.col("q_score").between(0, 1) & (F.col("q_level") == level_of(F.col("q_score"), pass_at, warn_at)),
        "VC10": (F.col("_n") == len(RULES)) & (F.col("_p") == F.col("q_n_passed")) & (F.col("_f") == F.col("q_n_failed")) & (F.col("_w") == F.col("q_n_warning")),
        "VC11": sha("q_sha256") == sha("a_sha256"),
    }
    rows = [F.struct(F.lit(c).alias("check_code"), F.when(F.coalesce(ok, F.lit(False)), "passed").otherwise("error").alias("outcome")) for c, ok in checks.items()]
    return one.select("media_id", F.explode(F.array(*rows)).alias("c")).select("media_id", "c.*")


def validation_status(checks: DataFrame) -> DataFrame:
    """failed, warning or passed, with the sorted codes of errors and warnings."""
    codes = lambda o: F.array_sort(F.collect_list(F.when(F.col("outcome") == o, F.col("check_code"))))
    out = checks.groupBy("media_id").agg(codes("error").alias("errors"), codes("warning").alias("warnings"))
    return out.withColumn("status", F.when(F.size("errors") > 0, "failed").when(F.size("warnings") > 0, "warning").otherwise("passed"))


def media_metrics(media: DataFrame, dialogue: DataFrame, turns: DataFrame, silence: DataFrame, timings: DataFrame) -> DataFrame:
    """Counts, mean confidences (6 places) and real-time factor (null for duration 0) of each medium.

    dialogue has text, alignment_conf; turns have conf_pct; timings (media_id, step, seconds).
    """
    talk = dialogue.groupBy("media_id").agg(F.count("*").alias("n_segments"), F.sum(word_count(F.col("text"))).cast("long").alias("n_words"), F.round(F.avg("alignment_conf"), 6).alias("avg_alignment_conf"))
    who = speaker_summary(turns).groupBy("media_id").agg(F.count("*").alias("n_speakers"), F.sum("n_turns").cast("long").alias("n_turns"))
    quiet = silence.groupBy("media_id").agg(F.count("*").alias("n_silences"))
    spent = timings.groupBy("media_id").agg(F.sum("seconds").alias("_s"))
    out = reduce(lambda a, b: a.join(b, "media_id", "left"), [talk, who, quiet, spent], media.select("media_id", "duration_ms"))
    zero = lambda c: F.coalesce(c, F.lit(0)).cast("long").alias(c)
    rtf = F.when(F.col("duration_ms") > 0, F.round(F.coalesce("_s", F.lit(0.0)) / (F.col("duration_ms") / 1000.0), 6))
    return out.select("media_id", *[zero(c) for c in ("n_segments", "n_words", "n_speakers", "n_turns", "n_silences")], "avg_alignment_conf", rtf.alias("rtf"))


def step_timings(timings: DataFrame) -> DataFrame:
    """Total seconds (6 places) and seconds by step of each medium; repeated steps add up."""
    each = timings.groupBy("media_id", "step").agg(F.sum("seconds").alias("s"))
    return each.groupBy("media_id").agg(F.round(F.sum("s"), 6).alias("wall_s"), F.map_from_entries(F.array_sort(F.collect_list(F.struct("step", "s")))).alias("by_step"))


def transcript_text(segments: DataFrame) -> DataFrame:
    """Texts of each medium in order, trimmed and joined by a space; confidence from the mean log probability."""
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("segment_index", "text"))), lambda s: F.trim(s["text"])), " ")
    return segments.groupBy("media_id").agg(F.trim(text).alias("text"), logprob_confidence(F.avg("avg_logprob")).alias("confidence"))


def speaker_summary(turns: DataFrame) -> DataFrame:
    """Turns, mean confidence (percent, 6 places) and talk time of each speaker of each medium."""
    return turns.groupBy("media_id", "speaker_label").agg(F.count("*").alias("n_turns"), F.round(F.avg("conf_pct"), 6).alias("avg_conf_pct"), F.sum(F.col("end_ms") - F.col("start_ms")).cast("long").alias("talk_ms"))


def live_progress(coverage: DataFrame, media: DataFrame, languages: list[str], failed: tuple[str, ...] = ()) -> DataFrame:
    """Covered share over all languages (6 places), and the shortest covered prefix of those that did not fail.

    coverage: disjoint ranges by media_id and language; one aggregate a medium, whatever the number of languages.
    """
    zero = lambda c: F.coalesce(c, F.lit(0))
    of = lambda lang, c: F.when(F.col("language") == lang, c)
    each = [x for i, lang in enumerate(languages) for x in (
        F.sum(of(lang, F.col("end_ms") - F.col("start_ms"))).alias(f"c{i}"), F.max(of(lang, F.when(F.col("start_ms") <= 0, F.col("end_ms")))).alias(f"p{i}"))]
    out = media.select("media_id", "duration_ms").join(coverage.where(F.col("language").isin(languages)).groupBy("media_id").agg(*each), "media_id", "left")
    capped = lambda c: F.least("duration_ms", zero(c))
    kept = [capped(f"p{i}") for i, lang in enumerate(languages) if lang not in failed]
    out = out.select("media_id", "duration_ms", sum((capped(f"c{i}") for i in range(len(languages))), F.lit(0)).alias("c"), (F.array_min(F.array(*kept)) if kept else F.lit(None).cast("long")).alias("p"))
    share = F.when(F.col("duration_ms") > 0, F.col("c") / (F.col("duration_ms") * len(languages))).otherwise(F.lit(0.0))
    return out.select("media_id", F.round(share, 6).alias("progress"), zero("p").cast("long").alias("buffered_ms"))


def translation_summary(translations: DataFrame) -> DataFrame:
    """Counts in and out, success (no errors), performed (languages differ) of each (media, target)."""
    return translations.groupBy("media_id", "source_lang", "target_lang").agg(
        F.count("*").alias("n_in"), F.count_if("ok").alias("n_ok"), F.sum(F.size("errors")).cast("long").alias("n_errors"), F.sum(F.size("warnings")).cast("long").alias("n_warnings"),
    ).withColumns({"success": F.col("n_errors") == 0, "performed": F.col("source_lang") != F.col("target_lang")})


def distinct_turns(turns: DataFrame) -> DataFrame:
    """One row for each (media_id, speaker_label, start_ms, end_ms): the one of greatest confidence."""
    return turns.groupBy("media_id", "speaker_label", "start_ms", "end_ms").agg(F.max("conf_pct").alias("conf_pct"))


def row_violations(df: DataFrame, rules: dict[str, Column], key: list[str]) -> DataFrame:
    """(key columns, violation): one row for each expectation that a row breaks; a null outcome breaks it too."""
    broken = F.array_compact(F.array(*[F.when(~F.coalesce(ok, F.lit(False)), F.lit(name)) for name, ok in rules.items()]))
    return df.select(*key, F.explode(broken).alias("violation"))


def interval_expectations(label: str = "speaker_label", conf: str = "conf") -> dict[str, Column]:
    """What every labelled interval must satisfy."""
    c = F.col(conf)
    return {
        "start_not_negative": F.col("start_ms") >= 0, "end_after_start": F.col("end_ms") > F.col("start_ms"), "conf_in_range": ~F.isnan(c) & c.between(0, 1),
        "label_form": F.col(label).rlike(r"^SPEAKER_[0-9]{2,}$"),
    }


def text_expectations(text: str = "text", most: int = 1_000_000) -> dict[str, Column]:
    return {"text_length": F.length(text) <= most, "no_control_chars": ~F.col(text).rlike(r"[\x00-\x08\x0B\x0C\x0E-\x1F]")}


def audio_expectations() -> dict[str, Column]:
    """16 kHz, mono, 16 bit, not empty."""
    return {"rate": F.col("sample_rate") == 16000, "mono": F.col("channels") == 1, "depth": F.col("bit_depth") == 16, "not_empty": F.col("size_bytes") > 0}


def media_violations(rows: DataFrame, media: DataFrame, order: str = "segment_index") -> DataFrame:
    """(media_id, violation): indexes from 0 without holes, no overlap with the row before, ends within the total."""
    w = Window.partitionBy("media_id").orderBy(order)
    seen = rows.withColumns({"_n": F.row_number().over(w) - 1, "_pe": F.lag("end_ms").over(w)}).join(media.select("media_id", "duration_ms"), "media_id")
    bad = seen.groupBy("media_id").agg(
        F.bool_or(F.col(order) != F.col("_n")).alias("indexes_contiguous"), F.bool_or(F.coalesce(F.col("start_ms") < F.col("_pe"), F.lit(False))).alias("no_overlap"), F.bool_or(F.col("end_ms") > F.col("duration_ms")).alias("within_total"))
    names = ("indexes_contiguous", "no_overlap", "within_total")
    return bad.select("media_id", F.explode(F.array_compact(F.array(*[F.when(F.col(n), F.lit(n)) for n in names]))).alias("violation"))


def totals_violations(totals: DataFrame) -> DataFrame:
    """(media_id, violation) of VAD totals: speech + silence = duration within 2 ms, ratio within 0.02."""
    ratio = F.when(F.col("duration_ms") > 0, F.col("speech_ms") / F.col("duration_ms")).otherwise(F.lit(0.0))
    return row_violations(totals, {"sum_matches": F.abs(F.col("speech_ms") + F.col("silence_ms") - F.col("duration_ms")) <= 2, "ratio_matches": F.abs(F.col("speech_ratio") - ratio) <= 0.02}, ["media_id"])


def duration_sane(probe: str, decoded: str, most: float = 0.05) -> Column:
    """Whether two durations differ by at most a share of the larger."""
    larger = F.greatest(probe, decoded)
    return F.when(larger > 0, F.abs(F.col(probe) - F.col(decoded)) / larger <= most).otherwise(F.lit(True))
