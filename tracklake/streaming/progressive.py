"""Cues of a medium that is transcribed window by window, the windows overlapping a little.

Built-in functions wrap the texts; one fold over a medium's windows places the cues in time and leaves out what earlier
windows said. It carries the end of the last cue and the texts of the last windows' cues, whatever the medium's length.
"""

from __future__ import annotations

import json
from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracklake.functions.text import folded, normalise_space
from tracklake.operators.cues import GAP_MS, MAX_CPS, MAX_MS, MIN_MS, wrap_blocks
from tracklake.streaming.event_time import HOUR_MS, fold_in_order
from tracklake.streaming.live import sorted_fold

CUES = "media_id long, window_index long, cue_index long, start_ms long, end_ms long, text string, speaker string"
NOTHING = {"n": 0, "until": 0, "texts": {}}


def by_window(segments: DataFrame) -> DataFrame:
    """(media_id, window_index, segments) of segments with media_id, window_index, start_ms, end_ms, text, speaker."""
    item = F.struct("start_ms", "end_ms", "text", "speaker")
    return segments.groupBy("media_id", "window_index").agg(F.array_sort(F.collect_list(item)).alias("segments"))


def prepared(windows: DataFrame) -> DataFrame:
    """windows with segments as JSON: start_ms, end_ms, speaker, key (folded text) and parts, the blocks of a wrapped text."""
    def part(block: Column) -> Column:
        text = F.array_join(block, "\n")
        return F.struct(text.alias("text"), F.greatest(F.lit(1), F.aggregate(block, F.lit(0), lambda a, line: a + F.length(line))).alias("size"), folded(text).alias("key"))

    def wrapped(s: Column) -> Column:
        text = normalise_space(F.coalesce(s["text"], F.lit("")))
        return F.struct(s["start_ms"].alias("start_ms"), s["end_ms"].alias("end_ms"), F.coalesce(s["speaker"], F.lit("")).alias("speaker"), folded(text).alias("key"), F.transform(wrap_blocks(text), part).alias("parts"))

    return windows.withColumn("segments", F.to_json(F.transform("segments", wrapped)))


def spread(segment: dict, start: int) -> Iterable[dict]:
    """Raw cues of a segment from start on: its time shared out by the size of its parts."""
    span, at = max(MIN_MS, segment["end_ms"] - start), start
    whole = sum(p["size"] for p in segment["parts"])
    for p in segment["parts"]:
        length = min(MAX_MS, max(MIN_MS, span * p["size"] // whole))
        yield {"start": at, "end": at + length, "speaker": segment["speaker"], **p}
        at += length


def timed(raw: list[dict]) -> list[tuple[int, int]]:
    """Start and end of raw cues in order: gaps between them, long enough to read, not into the next one's raw start."""
    out: list[tuple[int, int]] = []
    for i, cue in enumerate(raw):
        start = max(cue["start"], out[-1][1] + GAP_MS) if out else cue["start"]
        last = i + 1 == len(raw)
        end = max(cue["end"], start + (MIN_MS if last else max(MIN_MS, int(cue["size"] / MAX_CPS * 1000))))
        out.append((start, end if last else min(end, max(start + 1, raw[i + 1]["start"] - GAP_MS))))
    return out


def fold_windows(window_ms: int, overlap_ms: int):
    def fold(key: object, windows: list[dict], state: dict | None) -> tuple[list[tuple], dict]:
        state, out = state or NOTHING, []
        for w in windows:
            n, until, texts = state["n"], state["until"], state["texts"]
            least = until + 1 if n else 0
            raw: list[dict] = []
            fresh = []
            for s in json.loads(w["segments"] or "[]"):
                start = max(s["start_ms"], least)
                heard = s["key"] in texts and start <= until + overlap_ms
                if s["parts"] and s["end_ms"] > max(until, start) and not heard:
                    fresh.append((start, s["end_ms"], s))
            for start, _, s in sorted(fresh, key=lambda f: f[:2]):
                raw += spread(s, start)
            texts = dict(texts)
            for cue, (start, end) in zip(raw, timed(raw), strict=True):
                n, until = n + 1, max(until, end)
                texts[cue["key"]] = max(texts.get(cue["key"], 0), end)
                out.append((key, w["window_index"], n, start, end, cue["text"], cue["speaker"]))
            state = {"n": n, "until": until, "texts": {t: end for t, end in texts.items() if end >= until - (window_ms + 2 * overlap_ms)}}
        return out, state

    return fold


def progressive_cues(windows: DataFrame, window_ms: int = 30_000, overlap_ms: int = 1000) -> DataFrame:
    """Cues of each medium's windows (media_id, window_index, segments), in order of window_index.

    A segment that ends by the last cue's end goes; one that starts before it starts just after it; one whose text is that of
    a cue of the last windows goes if it starts by the last end and the overlap. What is left is wrapped and timed within its
    window. cue_index counts over the medium from 1. A null text or an empty window gives no cues.
    """
    fold = fold_windows(window_ms, overlap_ms)
    columns = [c.split(" ")[0] for c in CUES.split(", ")]
    return sorted_fold(prepared(windows.select("media_id", "window_index", "segments")), "media_id", ["window_index"], dict, lambda k, rows, s: fold(k, rows.to_dict("records"), s or None), columns, CUES)


def progressive_cue_stream(windows: DataFrame, at: str = "at", window_ms: int = 30_000, overlap_ms: int = 1000, delay: str = "1 minute", idle_ms: int = HOUR_MS) -> DataFrame:
    """progressive_cues of a stream of windows with an event time; windows that overtake each other by less than delay are put in order."""
    rows = prepared(windows.select("media_id", at, "window_index", "segments"))
    return fold_in_order(rows, "media_id", at, ["window_index"], fold_windows(window_ms, overlap_ms), CUES, delay, idle_ms)
