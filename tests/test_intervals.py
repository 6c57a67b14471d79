"""Closed forms of interval algebra against plain loops over random timelines."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from tracklake.operators import intervals as I
from tracklake.operators import joins as J

TOTAL = 300


def timelines(seed, n_media=60):
    rnd = random.Random(seed)
    rows = []
    for m in range(n_media):
        for _ in range(rnd.randrange(0, 9)):
            s = rnd.randrange(0, TOTAL)
            rows.append((m, s, s + rnd.randrange(1, 60), rnd.choice("ab"), rnd.randrange(100)))
    rows = sorted(set((m, s, e) for m, s, e, _, _ in rows))
    return [(m, s, e, random.Random(f"{m}{s}{e}").choice("ab"), (s * 7 + e) % 100, i) for i, (m, s, e) in enumerate(rows)]


@pytest.fixture(scope="module", params=[1, 2])
def rows(request):
    return timelines(request.param)


@pytest.fixture(scope="module")
def df(spark, rows):
    return spark.createDataFrame(rows, "media_id long, start_ms long, end_ms long, label string, conf_pct long, idx long")


@pytest.fixture(scope="module")
def totals(spark):
    return spark.createDataFrame([(m, TOTAL) for m in range(60)], "media_id long, duration_ms long")


def by_media(rows):
    out = {m: [] for m in range(60)}
    for r in rows:
        out[r[0]].append(r)
    return out


def got(df, *columns):
    return sorted(tuple(r[c] for c in ("media_id", *columns)) for r in df.collect())


def test_union(df, rows):
    want = []
    for m, rs in by_media(rows).items():
        cover = []
        for _, s, e, *_ in rs:
            if cover and s <= cover[-1][1]:
                cover[-1][1] = max(cover[-1][1], e)
            else:
                cover.append([s, e])
        want += [(m, s, e) for s, e in cover]
    for bin_ms in (None, 40, 1000):
        assert got(I.interval_union(df, bin_ms=bin_ms), "start_ms", "end_ms") == sorted(want)


def test_merge_proximal(df, rows):
    want = []
    for m, rs in by_media(rows).items():
        merged = []
        for _, s, e, _, c, _ in rs:
            if merged and 0 <= s - merged[-1][1] <= 20:
                merged[-1][1], merged[-1][2] = max(merged[-1][1], e), max(merged[-1][2], c)
            else:
                merged.append([s, e, c])
        want += [(m, *x) for x in merged]
    out = I.merge_proximal(df.withColumns({"max_conf": F.col("conf_pct"), "sample_count": F.lit(1)}), 20)
    assert got(out, "start_ms", "end_ms", "max_conf") == sorted(want)
    assert I.merge_proximal(df.withColumns({"max_conf": F.col("conf_pct"), "sample_count": F.lit(1)}), 0).count() == len(rows)


def test_complement(df, rows, totals):
    want = []
    for m, rs in by_media(rows).items():
        at = 0
        for i, (_, s, e, *_) in enumerate(rs):
            if s > at:
                want.append((m, at, s, i - 1, i))
            at = max(at, e)
        if at < TOTAL:
            want.append((m, at, TOTAL, len(rs) - 1, -1))
    assert got(I.complement(df, totals), "start_ms", "end_ms", "before_index", "after_index") == sorted(want)


def test_trims(df, rows, totals):
    previous, following = [], []
    for m, rs in by_media(rows).items():
        at = None
        for _, s, e, *_ in rs:
            s = max(s, at) if at is not None else s
            if e > s:
                previous.append((m, s, e))
            at = max(e, at or 0)
        inside = [[r[1], r[2]] for r in rs if r[1] < TOTAL]
        for i in range(len(inside)):
            end = inside[i][1]
            if i + 1 < len(inside) and end > inside[i + 1][0]:
                end = inside[i + 1][0]
            following.append((m, inside[i][0], min(end, TOTAL), i))
    assert got(I.trim_to_previous(df), "start_ms", "end_ms") == sorted(previous)
    assert got(I.trim_to_next(df, totals), "start_ms", "end_ms", "segment_index") == sorted(following)


def test_windows(spark):
    for total in (0, 499, 500, 900, 1000, 1001, 4000, 10_000, 10_400):
        for first in (None, 700, 100):
            size = min(max(first, 500), 3000) if first else 3000
            want, start, length = [], 0, size
            while total > 0:
                end = min(start + length, total)
                if end - start >= 500:
                    want.append((start, end))
                if start + length >= total:
                    break
                start, length = start + length - 400, 3000
            df = spark.createDataFrame([(1, total)], "media_id long, duration_ms long")
            assert [(r["start_ms"], r["end_ms"]) for r in I.overlapping_windows(df, 3000, 400, first).orderBy("window_index").collect()] == want, (total, first)
    with pytest.raises(ValueError):
        I.overlapping_windows(df, 1000, 1000)


def test_pivot_split(df, rows):
    want = []
    for m, rs in by_media(rows).items():
        if not rs:
            continue
        begin, end, label = rs[0][1], rs[0][2], rs[0][3]
        for _, s, e, la, *_ in rs[1:]:
            if s <= end and la == label:
                end = e
            elif s > end:
                want.append((m, float(begin), float(end), label))
                begin, end, label = s, e, la
            else:
                pivot = (s + end) / 2
                want.append((m, float(begin), pivot, label))
                begin, end, label = pivot, e, la
        want.append((m, float(begin), float(end), label))
    spans = [r for r in rows]
    # ends grow with starts in sub-segment tables
    if all(a[2] <= b[2] for rs in by_media(spans).values() for a, b in zip(rs, rs[1:], strict=False)):
        assert got(I.pivot_split(df), "start_ms", "end_ms", "label") == sorted(want)


def test_pivot_split_on_sliding_spans(spark):
    rnd = random.Random(4)
    rows, want = [], []
    for m in range(40):
        at, spans = 0, []
        for _ in range(rnd.randrange(1, 10)):
            at += rnd.choice([75, 75, 200])
            spans.append((m, at, at + 150, rnd.choice("ab")))
        rows += spans
        begin, end, label = spans[0][1:]
        for _, s, e, la in spans[1:]:
            if s <= end and la == label:
                end = e
                continue
            cut = (s + end) / 2 if s <= end else None
            want.append((m, float(begin), float(end if cut is None else cut), label))
            begin, end, label = (s if cut is None else cut), e, la
        want.append((m, float(begin), float(end), label))
    df = spark.createDataFrame(rows, "media_id long, start_ms long, end_ms long, label string")
    assert got(I.pivot_split(df), "start_ms", "end_ms", "label") == sorted(want)


@pytest.mark.parametrize("bin_ms", [7, 50, 1000])
def test_overlap_join(df, rows, bin_ms):
    want = sorted((a[0], a[5], b[5]) for rs in by_media(rows).values() for a in rs for b in rs if min(a[2], b[2]) - max(a[1], b[1]) >= 1)
    one = df.select("media_id", "idx", "start_ms", "end_ms")
    assert got(J.overlap_join(one, one, bin_ms=bin_ms), "idx", "r_idx") == want
    few = one.where("idx % 5 = 0")
    hit = {(m, i) for m, i, j in want if j % 5 == 0}
    assert set(got(J.overlap_join(one, few, bin_ms=bin_ms, how="left_semi"), "idx")) == hit
    assert set(got(J.overlap_join(one, few, bin_ms=bin_ms, how="left_anti"), "idx")) == {(r[0], r[5]) for r in rows} - hit


def test_vote_ties(spark):
    seg = spark.createDataFrame([(1, 0, 0, 1000), (1, 1, 1000, 2000), (1, 2, 5000, 6000)], "media_id long, segment_index long, start_ms long, end_ms long")
    turns = spark.createDataFrame(
        [(1, "SPEAKER_01", 0, 500, 50), (1, "SPEAKER_00", 500, 1000, 50), (1, "SPEAKER_00", 1000, 1500, 40), (1, "SPEAKER_02", 1500, 1700, 100)], "media_id long, speaker_label string, start_ms long, end_ms long, conf_pct long")
    rows = {r["asr_segment_index"]: (r["segment_index"], r["speaker_label"], r["alignment_conf"]) for r in J.align(seg, turns).collect()}
    assert rows == {0: (0, "SPEAKER_01", 0.25), 1: (1, "SPEAKER_02", 0.2)}


def test_plans_have_no_nested_loops(spark, df, capsys):
    for out in (J.overlap_join(df, df), J.voice_anti_join(df.select("media_id", "start_ms", "end_ms"), df), J.active_cue(df.select("media_id", F.col("start_ms").alias("time_ms")), df.withColumnRenamed("idx", "cue_index"))):
        out.explain()
        plan = capsys.readouterr().out
        assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan


def test_interval_chain_has_one_exchange(df, capsys):
    merged = I.merge_proximal(df.withColumns({"max_conf": F.col("conf_pct"), "sample_count": F.lit(1)}).repartition("media_id"), 20)
    I.trim_to_previous(I.interval_union(merged)).explain()
    assert capsys.readouterr().out.count("Exchange") == 1


def plan_of(df):
    return df._jdf.queryExecution().sparkPlan().toString(), df._jdf.queryExecution().executedPlan().toString()


def test_merging_sorts_once_and_hashes_no_rows(spark):
    rows = [(1, "A", 0, 10, 5), (1, "A", 5, 30, 6), (1, "B", 20, 40, 7), (1, "B", 95, 99, 8), (1, "B", 90, 91, 9), (2, "A", 0, 1, 1)]
    df = spark.createDataFrame(rows, "media_id long, label string, start_ms long, end_ms long, conf_pct long")
    order = ("start_ms", "end_ms", "label", "conf_pct")
    got = I.merge_same_label(I.trim_to_previous(df, order=order, raw="raw_ms"), 50, order=("raw_ms", *order[1:]))
    assert sorted(map(tuple, got.collect())) == [(1, "A", 0, 30, 5), (1, "B", 30, 99, 7), (2, "A", 0, 1, 1)]
    for out in (got, I.interval_union(df)):
        plan = plan_of(out.select("*"))[1]
        assert plan.count("Sort [") == 1 and "Aggregate" not in plan


def test_progress_of_languages_takes_one_aggregate_a_medium(spark):
    from tracklake.operators.quality import live_progress
    from tracklake.operators.tracks import track_complete

    coverage = spark.createDataFrame([(1, "en", 0, 50), (1, "en", 60, 200), (1, "es", 0, 100), (2, "es", 10, 100), (1, "fr", 0, 9)], "media_id long, language string, start_ms long, end_ms long")
    media = spark.createDataFrame([(1, 100), (2, 100), (3, 0)], "media_id long, duration_ms long")
    progress = live_progress(coverage, media, ["en", "es"], ("es",))
    assert sorted(map(tuple, progress.collect())) == [(1, 1.0, 50), (2, 0.45, 0), (3, 0.0, 0)]
    complete = track_complete(coverage, media, ["en", "es"])
    assert sorted(map(tuple, complete.collect())) == [(1, False), (2, False), (3, False)]
    assert track_complete(coverage, media, ["es"]).where("complete").collect() == [(1, True)]
    for out in (progress, complete):
        plan, _ = plan_of(out)
        assert "Generate" not in plan and "SortAggregate" not in plan
