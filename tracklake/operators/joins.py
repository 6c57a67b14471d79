"""Joins on media timelines: overlap joins in time bins or a dyadic index, speaker voting, point lookups, lineage."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

BIN_MS = 8000
#: The dyadic index: leaves of LEAF_MS, doubled LEVELS times (some twelve days).
LEAF_MS, LEVELS = 1000, 20


def bins(start: Column, end: Column, bin_ms: int) -> Column:
    """Bins that [start, end) touches; an empty interval has its start's."""
    at = lambda c: F.floor(c / bin_ms).cast("long")
    return F.sequence(at(start), F.greatest(at(start), at(end - 1)))


def leaf_of(time: Column) -> Column:
    return F.floor(time / LEAF_MS).cast("long")


def node(level: Column, place: Column) -> Column:
    """One number for a node of the dyadic index; LEVELS is below 32."""
    return F.shiftleft(place, 5).bitwiseOR(level.cast("long"))


def covering_nodes(start: Column, end: Column) -> Column:
    """The fewest nodes whose leaves are those that [start, end) touches: two a level at most, but for the last level."""
    def at(lo: Column, hi: Column) -> Column:
        def of_level(level: Column) -> Column:
            first = F.call_function("shiftright", lo + F.call_function("shiftleft", F.lit(1).cast("long"), level) - 1, level)
            last = F.call_function("shiftright", hi, level)
            odd = lambda x: x.bitwiseAND(1) == 1
            return F.array_compact(F.array(F.when((first < last) & odd(first), node_at(level, first)), F.when((first < last) & odd(last), node_at(level, last - 1))))

        top = F.lit(LEVELS)
        first, last = F.call_function("shiftright", lo + (1 << LEVELS) - 1, top), F.call_function("shiftright", hi, top)
        whole = F.when(first < last, F.transform(F.sequence(first, last - 1), lambda p: node_at(top, p))).otherwise(F.array().cast("array<bigint>"))
        return F.concat(F.flatten(F.transform(F.sequence(F.lit(0), F.lit(LEVELS - 1)), of_level)), whole)

    node_at = node
    bounds = F.array(F.struct(leaf_of(start).alias("lo"), (F.greatest(leaf_of(start), leaf_of(end - 1)) + 1).alias("hi")))
    return F.element_at(F.transform(bounds, lambda b: at(b["lo"], b["hi"])), 1)


def holding_nodes(time: Column) -> Column:
    """The nodes above a point's leaf, one a level: just one of them is among the nodes that cover an interval with the leaf."""
    leaf = leaf_of(time)
    return F.transform(F.sequence(F.lit(0), F.lit(LEVELS)), lambda level: node(level, F.call_function("shiftright", leaf, level)))


def dyadic_pairs(left: DataFrame, right: DataFrame, keys: tuple[str, ...]) -> DataFrame:
    """Pairs that overlap, right's times named r_start_ms and r_end_ms.

    Of two intervals that overlap one holds the other's start, both if they start together. Each is covered by O(log length)
    nodes, each start goes to the nodes above it, and a start meets an interval at one node alone: an equi-join without
    distinct, and an hour's interval is some twenty rows instead of one for each bin.
    """
    covers = lambda df, s, e: df.withColumn("_node", F.explode(covering_nodes(F.col(s), F.col(e))))
    points = lambda df, s: df.withColumn("_node", F.explode(holding_nodes(F.col(s))))
    on = [*keys, "_node"]
    later = covers(left, "start_ms", "end_ms").join(points(right, "r_start_ms"), on).where((F.col("r_start_ms") >= F.col("start_ms")) & (F.col("r_start_ms") < F.col("end_ms")))
    sooner = points(left, "start_ms").join(covers(right, "r_start_ms", "r_end_ms"), on).where((F.col("start_ms") > F.col("r_start_ms")) & (F.col("start_ms") < F.col("r_end_ms")))
    return later.unionByName(sooner).drop("_node")


def overlap_join(left: DataFrame, right: DataFrame, keys: tuple[str, ...] = ("media_id",), min_overlap_ms: int = 1, bin_ms: int = BIN_MS, how: str = "inner", long_ms: int | None = None) -> DataFrame:
    """Pairs with an overlap of min_overlap_ms or more, plus overlap_ms. Right columns other than keys are prefixed `r_`.

    Both sides are spread over time bins and joined on key and bin, so one long medium is many small groups; a pair that
    shares bins is kept in the bin of the later start alone, which needs no distinct. An interval is a row for each of its
    bins: where some are long, give long_ms, and pairs with an interval over it are found by a dyadic index instead (which
    takes min_overlap_ms of 1 or more). how: inner, left_semi or left_anti (the two judge left rows by their keys, start and
    end, and need min_overlap_ms of 1 or more).
    """
    right = right.select(*keys, *[F.col(c).alias(f"r_{c}") for c in right.columns if c not in keys])
    if how in ("left_semi", "left_anti"):
        # Rows of equal keys and times overlap the same: the join is on these alone, no other column is carried along.
        times = [*keys, "start_ms", "end_ms"]
        spans = left.select(*times).distinct()
        hits = overlap_join(spans, right.select(*keys, F.col("r_start_ms").alias("start_ms"), F.col("r_end_ms").alias("end_ms")), keys, min_overlap_ms, bin_ms, long_ms=long_ms)
        found = hits.select(*[F.col(c).alias(f"_{c}") for c in times]).distinct()
        on = F.lit(True)
        for c in times:
            on = on & (F.col(c) == F.col(f"_{c}"))
        return left.join(found, on, how)
    overlap = F.least("end_ms", "r_end_ms") - F.greatest("start_ms", "r_start_ms")
    if long_ms is not None:
        if min_overlap_ms < 1:
            raise ValueError("the dyadic index finds overlaps of 1 ms or more")
        is_long = lambda s, e: F.coalesce(F.col(e) - F.col(s) > long_ms, F.lit(False))
        short_left, short_right = left.where(~is_long("start_ms", "end_ms")), right.where(~is_long("r_start_ms", "r_end_ms"))
        pairs = dyadic_pairs(left.where(is_long("start_ms", "end_ms")), right, keys).unionByName(dyadic_pairs(short_left, right.where(is_long("r_start_ms", "r_end_ms")), keys))
        both = pairs.where(overlap >= min_overlap_ms).withColumn("overlap_ms", overlap)
        return both.unionByName(binned_pairs(short_left, short_right, keys, bin_ms).where(overlap >= min_overlap_ms).withColumn("overlap_ms", overlap))
    return binned_pairs(left, right, keys, bin_ms).where(overlap >= min_overlap_ms).withColumn("overlap_ms", overlap)


def binned_pairs(left: DataFrame, right: DataFrame, keys: tuple[str, ...], bin_ms: int) -> DataFrame:
    """Pairs that share time bins, each once: in the bin of the later start."""
    a = left.withColumn("_bin", F.explode(bins(F.col("start_ms"), F.col("end_ms"), bin_ms)))
    b = right.withColumn("_bin", F.explode(bins(F.col("r_start_ms"), F.col("r_end_ms"), bin_ms)))
    met = F.floor(F.greatest("start_ms", "r_start_ms") / bin_ms) == F.col("_bin")
    return a.join(b, [*keys, "_bin"]).where(met).drop("_bin")


def speaker_vote(segments: DataFrame, turns: DataFrame, min_overlap_ms: int = 1) -> DataFrame:
    """The speaker of each segment by overlap x confidence.

    segments: media_id, segment_index, start_ms, end_ms; turns: media_id, speaker_label, start_ms, end_ms, conf_pct
    (percent, so that weights stay integers). Greatest weight, then greatest confidence, then earliest turn wins.
    Gives all segments with speaker_label and alignment_conf (min(1, weight / duration)), null where no turn overlaps.
    """
    pairs = overlap_join(segments.select("media_id", "segment_index", "start_ms", "end_ms"), turns.select("media_id", "speaker_label", "start_ms", "end_ms", "conf_pct"), min_overlap_ms=min_overlap_ms)
    votes = pairs.groupBy("media_id", "segment_index", F.col("r_speaker_label").alias("speaker_label")).agg(
        F.sum(F.col("overlap_ms") * F.col("r_conf_pct")).alias("weight"), F.max("r_conf_pct").alias("best"), F.min("r_start_ms").alias("first"))
    rank = F.struct((-F.col("weight")).alias("w"), (-F.col("best")).alias("b"), F.col("first").alias("f"), F.col("speaker_label").alias("l"))
    won = votes.groupBy("media_id", "segment_index").agg(F.min_by(F.struct("speaker_label", "weight"), rank).alias("v"))
    out = segments.join(won.select("media_id", "segment_index", "v.speaker_label", "v.weight"), ["media_id", "segment_index"], "left")
    length = F.col("end_ms") - F.col("start_ms")
    conf = F.when(F.col("speaker_label").isNotNull(), F.least(F.lit(1.0), F.col("weight") / (100.0 * F.greatest(F.lit(1), length))))
    return out.withColumn("alignment_conf", conf).drop("weight")


def align(segments: DataFrame, turns: DataFrame, min_overlap_ms: int = 1) -> DataFrame:
    """Dialogue: segments that got a speaker, renumbered from 0 in order; asr_segment_index keeps the old number."""
    voted = speaker_vote(segments, turns, min_overlap_ms).where(F.col("speaker_label").isNotNull())
    w = Window.partitionBy("media_id").orderBy("segment_index")
    return voted.withColumns({"asr_segment_index": F.col("segment_index"), "segment_index": F.row_number().over(w).cast("long") - 1})


def attach_text(segments: DataFrame, texts: DataFrame) -> DataFrame:
    """Segments with their text by index; missing_text marks those without a row of text."""
    t = texts.select("media_id", "segment_index", "text", F.lit(True).alias("_has"))
    return segments.join(t, ["media_id", "segment_index"], "left").withColumn("missing_text", F.col("_has").isNull()).drop("_has")


def voice_anti_join(segments: DataFrame, voice: DataFrame, bin_ms: int = BIN_MS) -> DataFrame:
    """Segments that overlap no voice interval."""
    return overlap_join(segments, voice.select("media_id", "start_ms", "end_ms"), bin_ms=bin_ms, how="left_anti")


def unknown_speakers(dialogue: DataFrame, turns: DataFrame) -> DataFrame:
    """Dialogue rows whose label no turn of the medium has."""
    return dialogue.join(turns.select("media_id", "speaker_label").distinct(), ["media_id", "speaker_label"], "left_anti")


def interpolate_from_voice(segments: DataFrame, voice: DataFrame, ordinal: str = "segment_index") -> DataFrame:
    """Null times from the voice interval of the same ordinal, else the medium's last; ts_confidence 0.7 where filled.

    Adds vad_interpolated and missing_voice (times were null and the medium has no voice).
    """
    w = Window.partitionBy("media_id").orderBy("start_ms", "end_ms")
    nth = voice.select("media_id", (F.row_number().over(w).cast("long") - 1).alias(ordinal), F.col("start_ms").alias("_s"), F.col("end_ms").alias("_e"))
    last = voice.groupBy("media_id").agg(F.max_by(F.struct("start_ms", "end_ms"), F.struct("start_ms", "end_ms")).alias("_last"))
    rows = segments.join(nth, ["media_id", ordinal], "left").join(last, "media_id", "left")
    missing = F.col("start_ms").isNull() | F.col("end_ms").isNull()
    start, end = F.coalesce("_s", "_last.start_ms"), F.coalesce("_e", "_last.end_ms")
    return rows.withColumns({
        "vad_interpolated": missing, "missing_voice": missing & start.isNull(), "ts_confidence": F.when(missing, F.lit(0.7)).otherwise(F.lit(1.0)),
        "start_ms": F.when(missing, start).otherwise(F.col("start_ms")), "end_ms": F.when(missing, end).otherwise(F.col("end_ms")),
    }).drop("_s", "_e", "_last")


def translated_cues(dialogue: DataFrame, translations: DataFrame) -> DataFrame:
    """Dialogue with cue_text: the adapted text of the same index, else its own."""
    t = translations.select("media_id", "segment_index", "adapted_text")
    return dialogue.join(t, ["media_id", "segment_index"], "left").withColumn("cue_text", F.coalesce("adapted_text", "text")).drop("adapted_text")


def active_cue_asof(points: DataFrame, cues: DataFrame) -> DataFrame:
    """The last cue that starts by each point (media_id, time_ms), if it has not ended; else a null cue. One row a point's row.

    For tracks whose cues do not overlap this is active_cue without bins: points and starts lie in one sort by medium and
    time, and each point takes the start before it. Of cues that start together the one that ends last counts.
    """
    starts = cues.select("media_id", F.col("start_ms").alias("time_ms"), F.lit(0).alias("_kind"), F.struct("end_ms", "cue_index").alias("_cue"))
    both = points.select("media_id", "time_ms", F.lit(1).alias("_kind"), F.lit(None).cast(starts.schema["_cue"].dataType).alias("_cue")).unionByName(starts)
    w = Window.partitionBy("media_id").orderBy("time_ms", "_kind", "_cue").rowsBetween(Window.unboundedPreceding, 0)
    found = both.withColumn("_cue", F.last("_cue", ignorenulls=True).over(w)).where("_kind = 1")
    return found.select("media_id", "time_ms", F.when(F.col("_cue.end_ms") > F.col("time_ms"), F.col("_cue.cue_index")).alias("cue_index"))


def active_cue(points: DataFrame, cues: DataFrame, bin_ms: int = BIN_MS) -> DataFrame:
    """The first cue, by start and end, that holds each point (media_id, time_ms); points in no cue keep a null cue."""
    a = points.withColumn("_bin", F.floor(F.col("time_ms") / bin_ms).cast("long"))
    b = cues.select("media_id", F.struct("start_ms", "end_ms", "cue_index").alias("cue"), F.explode(bins(F.col("start_ms"), F.col("end_ms"), bin_ms)).alias("_bin"))
    on = (a["media_id"] == b["media_id"]) & (a["_bin"] == b["_bin"]) & (F.col("cue.start_ms") <= F.col("time_ms")) & (F.col("time_ms") < F.col("cue.end_ms"))
    return a.join(b.select("media_id", "_bin", "cue"), on, "left").groupBy(a["media_id"], "time_ms").agg(F.min("cue").alias("c")).select("media_id", "time_ms", F.col("c.cue_index").alias("cue_index"))


def lineage_check(steps: dict[str, DataFrame], base: str) -> DataFrame:
    """Steps whose hash differs from the base step's, or that lack the medium; hashes compare without case.

    steps: name -> (media_id, sha256). One row a medium with mismatches (sorted names) and ok.
    """
    rows = None
    for name, df in steps.items():
        one = df.select("media_id", F.lit(name).alias("step"), F.lower("sha256").alias("sha"))
        rows = one if rows is None else rows.unionByName(one)
    others = sorted(n for n in steps if n != base)
    by_step = rows.groupBy("media_id").agg(F.map_from_entries(F.collect_list(F.struct("step", "sha"))).alias("m"))
    bad = [F.when(F.coalesce(F.col("m")[n] != F.col("m")[base], F.lit(True)), F.lit(n)) for n in others]
    mismatches = F.array_compact(F.array(*bad))
    return by_step.select("media_id", mismatches.alias("mismatches"), (F.size(mismatches) == 0).alias("ok"))


def cache_key(source: str, target: str, text: str, previous: str) -> Column:
    return F.sha2(F.concat_ws("|", F.col(source), F.col(target), F.coalesce(F.col(text), F.lit("")), F.coalesce(F.col(previous), F.lit(""))), 256)


def cache_lookup(requests: DataFrame, cache: DataFrame) -> DataFrame:
    """requests (with cache_key) plus cached_text and hit; cache: latest value by key, as latest_cache gives it."""
    return requests.join(cache.select("cache_key", F.col("value").alias("cached_text")), "cache_key", "left").withColumn("hit", F.col("cached_text").isNotNull())


def glossary_join(requests: DataFrame, glossary: DataFrame, broadcast_terms: int = 100_000) -> DataFrame:
    """Terms that apply to each request: its target language's, or those of `*` if that language has none.

    requests: with target; glossary: lang, term, replacement. Languages are few and hot, so the glossary is gathered to a
    row a language, and no request is shuffled by it, while it has broadcast_terms terms or fewer; a larger one is joined.
    """
    n = glossary.limit(broadcast_terms + 1).count()
    terms = glossary.groupBy("lang").agg(F.array_sort(F.collect_list(F.struct("term", "replacement"))).alias("_terms"))
    if n > broadcast_terms:  # the terms of a language spread over 64 parts, each met by a copy of the request
        part = F.pmod(F.xxhash64("term"), F.lit(64)).cast("int").alias("_part")
        terms = glossary.groupBy("lang", part).agg(F.array_sort(F.collect_list(F.struct("term", "replacement"))).alias("_terms"))
        known = F.broadcast(glossary.select("lang").distinct())
        rows = requests.join(known, F.col("target") == F.col("lang"), "left").withColumn("_lang", F.coalesce("lang", F.lit("*"))).drop("lang")
        rows = rows.withColumn("_part", F.explode(F.sequence(F.lit(0), F.lit(63))))
        met = rows.join(terms.withColumnRenamed("lang", "_lang"), ["_lang", "_part"])
    else:
        own, anyone = (F.broadcast(x) for x in (terms.withColumnRenamed("_terms", "_own"), terms.where("lang = '*'").select(F.lit(1).alias("_one"), F.col("_terms").alias("_any"))))
        rows = requests.join(own, F.col("target") == F.col("lang"), "left").withColumn("_one", F.lit(1)).join(anyone, "_one", "left")
        met = rows.withColumn("_terms", F.coalesce("_own", "_any"))
    return met.select(*requests.columns, F.inline("_terms"))


def latest_job(projects: DataFrame, jobs: DataFrame) -> DataFrame:
    """Projects with their newest job (latest created_at, then greatest id), null where they have none."""
    newest = jobs.groupBy("project_id").agg(F.max_by(F.struct("job_id", "status"), F.struct("created_at", "job_id")).alias("j"))
    return projects.join(newest, "project_id", "left").select(*projects.columns, F.col("j.job_id").alias("job_id"), F.col("j.status").alias("job_status"))
