"""Dyadic index, as-of join, bucketed tables, one-pass rules, constraints, JDBC: results against plain loops, and plans."""

import random
import uuid

import pytest
from pyspark.sql import functions as F
from tracklake.operators import constraints, intervals, joins, quality
from tracklake.sources import documents, media_tables

SPAN = "media_id long, idx long, start_ms long, end_ms long"


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def exchanges(df):
    return plan(df).count("Exchange hashpartitioning") + plan(df).count("Exchange rangepartitioning") + plan(df).count("Exchange SinglePartition") + plan(df).count("Exchange REPARTITION")


def mixed(n, seed):
    """Spans from nothing to half a day, at times before 0 too, with equal starts."""
    rnd = random.Random(seed)
    rows = []
    for i in range(n):
        start = rnd.choice([rnd.randrange(-5000, 60_000), rnd.randrange(0, 40_000_000), 8000, 1000 * rnd.randrange(50)])
        rows.append((rnd.choice([1, 1, 1, 2, None]), i, start, start + rnd.choice([0, 1, 500, 999, 1000, 30_000, 3_600_000, 36_000_000, -5])))
    return rows


def test_dyadic_pairs_equal_all_pairs(spark):
    a, b = mixed(150, 1), mixed(150, 2)
    left, right = spark.createDataFrame(a, SPAN), spark.createDataFrame(b, SPAN)
    want = sorted((x[1], y[1], min(x[3], y[3]) - max(x[2], y[2])) for x in a for y in b if x[0] is not None and x[0] == y[0] and min(x[3], y[3]) - max(x[2], y[2]) >= 1)
    for long_ms in (0, 5000, 10_000_000, 10**9):
        got = joins.overlap_join(left, right, bin_ms=500_000, long_ms=long_ms)
        assert sorted((r["idx"], r["r_idx"], r["overlap_ms"]) for r in got.collect()) == want
    hit = {x for x, _, _ in want}
    anti = joins.overlap_join(left, right, bin_ms=500_000, how="left_anti", long_ms=5000)
    assert sorted(r["idx"] for r in anti.collect()) == [x[1] for x in a if x[1] not in hit]
    assert anti.columns == left.columns
    with pytest.raises(ValueError, match="1 ms"):
        joins.overlap_join(left, right, min_overlap_ms=0, long_ms=1)


def test_a_long_interval_is_few_rows(spark):
    hours = spark.createDataFrame([(1, 0, 123_456, 123_456 + 36_000_000), (1, 1, 0, 3_600_000), (1, 2, 5, 6), (1, 3, -70_000, 10**10)], SPAN)
    rows = {r["idx"]: r for r in hours.select("idx", joins.covering_nodes(F.col("start_ms"), F.col("end_ms")).alias("c"), joins.holding_nodes(F.col("start_ms")).alias("h")).collect()}
    assert len(rows[0]["c"]) + len(rows[0]["h"]) < 60 and len(rows[1]["c"]) < 25 and len(rows[2]["c"]) == 1
    assert all(len(set(r["c"])) == len(r["c"]) for r in rows.values())
    leaves = lambda nodes: sorted(x for n in nodes for x in range((n >> 5) << (n & 31), ((n >> 5) + 1) << (n & 31)))
    assert leaves(rows[0]["c"]) == list(range(123, 36_124)) and leaves(rows[1]["c"]) == list(range(3600))


def test_last_cue_asof(spark):
    rnd = random.Random(5)
    cues = [(m, s, s + rnd.choice([0, 40, 200]), i) for i, (m, s) in enumerate((rnd.choice([1, 2]), rnd.randrange(0, 3000)) for _ in range(60))] + [(1, 500, 600, 900), (1, 500, 700, 901)]
    points = [(rnd.choice([1, 2, 3]), rnd.randrange(-50, 3300)) for _ in range(300)] + [(1, 500), (1, 500)]
    got = joins.active_cue_asof(spark.createDataFrame(points, "media_id long, time_ms long"), spark.createDataFrame(cues, "media_id long, start_ms long, end_ms long, cue_index long"))
    assert exchanges(got) == 1
    last = lambda m, t: max(((s, e, i) for k, s, e, i in cues if k == m and s <= t), default=None)
    want = [(m, t, c[2] if (c := last(m, t)) and c[1] > t else None) for m, t in points]
    assert sorted(map(str, ((r["media_id"], r["time_ms"], r["cue_index"]) for r in got.collect()))) == sorted(map(str, want))


@pytest.fixture
def stored(spark, tmp_path):
    rnd = random.Random(7)
    rows = [(m, i, s := rnd.randrange(0, 200_000), s + rnd.randrange(1, 9000), rnd.choice(["A", "B"]), rnd.randrange(100)) for m in range(40) for i in range(30)]
    df = spark.createDataFrame(rows, SPAN + ", label string, conf_pct long")
    names = [f"t{uuid.uuid4().hex[:8]}" for _ in range(2)]
    for n in names:
        media_tables.write_by_medium(df, n, 4, f"{tmp_path}/{n}")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    yield df, [spark.table(n) for n in names]
    spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    for n in names:
        spark.sql(f"drop table {n}")


def test_chains_and_joins_over_buckets_need_no_exchange(spark, stored):
    df, (a, b) = stored
    chain = lambda t: intervals.merge_same_label(intervals.trim_to_previous(t, order=("start_ms", "end_ms", "label", "conf_pct")).drop("idx"), 50)
    assert exchanges(chain(a)) == 0 and exchanges(chain(df)) == 1
    assert sorted(map(tuple, chain(a).collect())) == sorted(map(tuple, chain(df).collect()))
    pairs = lambda x, y: joins.overlap_join(x.select("media_id", "idx", "start_ms", "end_ms"), y.select("media_id", "idx", "start_ms", "end_ms"))
    assert exchanges(pairs(a, b)) == 2
    with media_tables.in_place(spark):
        assert exchanges(pairs(a, b)) == 0
        got = sorted(map(tuple, pairs(a, b).collect()))
    assert got == sorted(map(tuple, pairs(df, df).collect())) and len(got) > 1000


def test_rules_take_one_exchange(spark):
    rnd = random.Random(9)
    spans = lambda n: [(m, i, s := rnd.randrange(-50, 20_000), s + rnd.choice([-5, 0, 40, 900, 70_000])) for m in range(8) for i in range(n)]
    media = spark.createDataFrame([(m, 20_000) for m in range(7)] + [(50, 5)], "media_id long, duration_ms long")
    d, v = spans(12), spans(6)
    dialogue = spark.createDataFrame(d, SPAN).withColumnRenamed("idx", "segment_index").withColumn("text", F.lit("x"))
    voice = spark.createDataFrame(v, SPAN)
    segments = dialogue.select("media_id", F.lit(0.5).alias("confidence"), F.lit(None).cast("double").alias("avg_logprob"))
    out = quality.quality_rules(media, dialogue, segments, dialogue.select("media_id", F.lit("S").alias("speaker_label")), voice, voice)
    assert exchanges(out) == 1
    got = {(r["media_id"], r["rule_code"]): r["occurrences"] for r in out.collect()}
    assert {m for m, _ in got} == {*range(7), 50} and len(got) == 88
    for m in range(7):
        rows, heard = [x for x in d if x[0] == m], [x for x in v if x[0] == m]
        assert got[m, "QR11"] == sum(not any(min(x[3], y[3]) - max(x[2], y[2]) >= 1 for y in heard) for x in rows)
        assert got[m, "QR03"] == sum(x[2] < 0 or x[3] > 20_000 for x in rows)
        assert got[m, "QR04"] == sum(min(x[3], y[3]) - max(x[2], y[2]) > 100 for x, y in zip(rows, rows[1:], strict=False))


def test_checks_take_one_exchange(spark):
    one = lambda rows, kind: spark.createDataFrame(rows, kind)
    media = one([(m, "h", 100, "H", 100, "h", "j") for m in range(4)], "media_id long, sha256 string, duration_ms long, vad_sha256 string, vad_duration_ms long, diarization_sha256 string, job_id string")
    alignment = one([(m, "h", 100, 2, 2, 0, "en", "j") for m in range(3)], "media_id long, sha256 string, duration_ms long, n_segments long, n_aligned long, n_unassigned long, language string, job_id string")
    judged = one([(m, "h", 100, 1.0, "passed", 11, 0, 0, None) for m in range(4)], "media_id long, sha256 string, duration_ms long, score double, level string, n_passed long, n_failed long, n_warning long, job_id string")
    asr = one([(m, "h", 2, 2, "en", "j") for m in range(4)], "media_id long, sha256 string, n_segments long, n_rows long, language string, job_id string")
    said = one([(0, 0, 0, 50, 50, "S"), (1, 0, 0, 101, 101, "S"), (2, 0, 5, 9, 4, None), (3, 0, -1, 9, 10, "S"), (9, 0, -1, 9, 10, "S")], "media_id long, segment_index long, start_ms long, end_ms long, duration_ms long, speaker_label string")
    rules = media.select("media_id", F.explode(F.array(*[F.lit(f"QR{i:02d}") for i in range(1, 12)])).alias("rule_code")).withColumns({"severity": F.lit("ERROR"), "passed": F.lit(True)})
    out = quality.validation_checks(media, alignment, judged, asr, said, one([(m, "S") for m in range(4)], "media_id long, speaker_label string"), rules)
    assert exchanges(out) == 1
    found = {(r["media_id"], r["check_code"]) for r in out.collect() if r["outcome"] == "error"}
    assert {x for x in found if x[0] < 3} == {(1, "VC05"), (2, "VC06")}
    assert {c for m, c in found if m == 3} == {"VC01", "VC04", "VC08", "VC11"} and out.count() == 44


def sound_medium(m):
    """(media row, voice, silence, turns, segments) of a medium that breaks nothing."""
    sha = f"{m:064x}"
    row = {"media_id": m, "duration_ms": 10_000, "sha256": sha, "vad_sha256": sha.upper(), "language": "en", "sample_rate": 16_000, "channels": 1, "bit_depth": 16, "size_bytes": 5, "speech_ms": 7000, "silence_ms": 3000, "speech_ratio": 0.7, "n_voice": 2, "n_silence": 2, "n_turns": 2, "n_speakers": 2, "wall_s": 3.0, "rtf": 0.3}
    voice = [[m, 1000, 4000], [m, 5000, 9000]]
    return row, voice, [[m, 0, 1000], [m, 4000, 5000], [m, 9000, 10_000]][:2] + [], [[m, 0, 100, "SPEAKER_00"], [m, 100, 200, "SPEAKER_01"]], [[m, 0, 0, 100, 100], [m, 1, 100, 200, 100]]


FAULTS = {
    ("media", "hash"): lambda r, *_: r.update(sha256="x", vad_sha256="X"), ("media", "same_hash"): lambda r, *_: r.update(vad_sha256="f" * 64), ("media", "language"): lambda r, *_: r.update(language="xx"),
    ("media", "rate"): lambda r, *_: r.update(sample_rate=100), ("media", "channels"): lambda r, *_: r.update(channels=None), ("media", "depth"): lambda r, *_: r.update(bit_depth=12), ("media", "size"): lambda r, *_: r.update(size_bytes=-1),
    ("media", "parts_make_total"): lambda r, *_: r.update(duration_ms=10_003), ("media", "ratio"): lambda r, *_: r.update(speech_ratio=0.75), ("media", "speech_sum"): lambda r, *_: r.update(speech_ms=7001), ("media", "silence_sum"): lambda r, *_: r.update(silence_ms=2999),
    ("media", "voice_count"): lambda r, *_: r.update(n_voice=3), ("media", "silence_count"): lambda r, *_: r.update(n_silence=0), ("media", "turn_count"): lambda r, *_: r.update(n_turns=1), ("media", "speaker_count"): lambda r, *_: r.update(n_speakers=1),
    ("media", "rtf"): lambda r, *_: r.update(rtf=0.31), ("voice", "no_overlap"): lambda r, v, *_: v[0].__setitem__(2, 5500) or v[1].__setitem__(2, 7500) or r.update(speech_ratio=0.7),
    ("voice", "within_total"): lambda r, v, *_: v.__setitem__(1, [v[0][0], 8000, 12_000]), ("silence", "end_after_start"): lambda r, v, s, *_: s[0].__setitem__(2, 0) or s[1].__setitem__(2, 6000),
    ("turns", "label"): lambda r, v, s, t, g: t[0].__setitem__(3, "speaker"), ("turns", "start_not_negative"): lambda r, v, s, t, g: t[0].__setitem__(1, -1), ("segments", "duration"): lambda r, v, s, t, g: g[0].__setitem__(4, 99),
    ("segments", "contiguous"): lambda r, v, s, t, g: g[1].__setitem__(1, 5), ("media", "index_from_0"): lambda r, v, s, t, g: [x.__setitem__(1, x[1] + 1) for x in g],
}


def test_each_constraint_is_found_where_it_is_broken(spark):
    rows, parts, want = [], ([], [], [], []), set()
    for m, (fault, breaks) in enumerate([(None, None), *FAULTS.items()]):
        row, *tables = sound_medium(m)
        tables[1][1][2] = 6000  # two silences of 3 s in all
        if breaks:
            breaks(row, *tables)
            want.add((m, *fault))
        rows.append(row)
        for out, t in zip(parts, tables, strict=True):
            out += t
    kinds = ("media_id long, duration_ms long, sha256 string, vad_sha256 string, language string, sample_rate int, channels int, bit_depth int, size_bytes long, speech_ms long, silence_ms long, speech_ratio double, n_voice long, n_silence long, n_turns long, n_speakers long, wall_s double, rtf double")
    media = spark.createDataFrame([tuple(r.values()) for r in rows], kinds)
    span = "media_id long, start_ms long, end_ms long"
    parts[0].append([999, 0, 5])
    tables = [spark.createDataFrame(p, k) for p, k in zip(parts, (span, span, span + ", speaker_label string", "media_id long, segment_index long, start_ms long, end_ms long, duration_ms long"), strict=True)]
    got = {(r["media_id"], r["source"], r["violation"]) for r in constraints.track_constraints(media, *tables).collect()}
    assert (999, "media", "unknown_medium") in got
    found = {x for x in got if x[0] != 999}
    assert want <= found and not [x for x in found if x[0] == 0]
    assert {x[0] for x in found} == {x[0] for x in want}


def test_jdbc_reads_in_ranges_of_the_table(spark):
    url, driver = f"jdbc:derby:memory:{uuid.uuid4().hex};create=true", "org.apache.derby.jdbc.EmbeddedDriver"
    jobs = spark.range(1000).select(
        (F.col("id") * 3 + 50).alias("job_id"), (F.col("id") % 7).alias("project_id"), (F.col("id") % 3).alias("user_id"), F.lit("QUEUED").alias("status"), F.timestamp_seconds("id").alias("created_at"),
        F.lit("").alias("claimed_by"), F.when(F.col("id") % 2 == 0, F.col("id")).alias("heartbeat_age_s"),
    )
    jobs.write.format("jdbc").options(url=url, driver=driver, dbtable="jobs", createTableColumnTypes="status varchar(40), claimed_by varchar(40)").save()
    df = documents.read_table_jdbc(spark, "jobs", url, "job_id", rows_a_part=130, driver=driver)
    assert df.rdd.getNumPartitions() == 8
    sizes = df.groupBy(F.spark_partition_id()).count().collect()
    assert len(sizes) == 8 and max(r["count"] for r in sizes) < 140
    assert sorted(map(str, df.collect())) == sorted(map(str, jobs.collect()))
    assert df.schema.simpleString() == spark.createDataFrame([], documents.TABLES["jobs"]).schema.simpleString()
    assert "PushedFilters: [*IsNotNull(job_id), *GreaterThan(job_id,100)]" in plan(df.where("job_id > 100"))
    assert documents.read_table_jdbc(spark, "jobs", url, driver=driver).count() == 1000
    assert documents.read_table_jdbc(spark, "jobs", url, "heartbeat_age_s", rows_a_part=300, driver=driver).count() == 1000
