"""Event-time streams against their batch twins: disorder, restarts, late rows, expiry."""

import random
import time

import pytest
from pyspark.sql import functions as F
from tracklake.operators.tracks import job_status
from tracklake.streaming import event_time, live, progressive

CHUNK = "session_id long, seq long, kind string, epoch long, time_ms long, rms double, n_samples long"


@pytest.fixture(scope="module")
def rocks(spark):
    event_time.rocksdb(spark)
    spark.conf.set("spark.sql.shuffle.partitions", "2")
    yield spark
    spark.conf.set("spark.sql.shuffle.partitions", "4")
    spark.conf.unset("spark.sql.streaming.stateStore.providerClass")


class Feed:
    """A folder that a stream reads file by file; each run is a new query on the same checkpoint."""

    def __init__(self, spark, tmp_path, make, mode="append"):
        self.spark, self.root, self.make, self.mode, self.progress = spark, tmp_path, make, mode, []

    def add(self, df):
        df.coalesce(1).write.mode("append").parquet(f"{self.root}/in")
        self.schema = df.schema

    def run(self, rows=None):
        """Until all is read; with `rows`, until so many came in this run (timers of processing time go on for ever)."""
        source = self.spark.readStream.schema(self.schema).option("maxFilesPerTrigger", 1).parquet(f"{self.root}/in")
        query = self.make(source).writeStream.outputMode(self.mode).option("checkpointLocation", f"{self.root}/check")
        query = query.trigger(availableNow=True) if rows is None else query.trigger(processingTime="200 milliseconds")
        out = self.root / "out"
        query = query.foreachBatch(lambda df, i: df.withColumn("_batch", F.lit(i)).write.mode("overwrite").parquet(f"{out}/{i}")).start()
        if rows is None:
            query.awaitTermination(180)
        else:
            for _ in range(240):
                time.sleep(0.25)
                done = query.recentProgress
                if sum(p["numInputRows"] for p in done) >= rows and done[-1]["numInputRows"] == 0:
                    break
            query.stop()
        assert query.exception() is None
        self.progress += query.recentProgress

    def rows(self):
        return self.spark.read.option("recursiveFileLookup", "true").parquet(f"{self.root}/out").collect()

    def state(self, name):
        return self.spark.read.format("statestore").option("path", f"{self.root}/check").option("stateVarName", name).load()

    def dropped(self):
        return sum(s["numRowsDroppedByWatermark"] for p in self.progress for s in p["stateOperators"])


def at(seconds):
    return F.timestamp_seconds(F.lit(1_000_000) + seconds)


def test_utterances_in_any_order_over_a_restart(rocks, tmp_path):
    rnd = random.Random(2)
    rows = [(s, i, rnd.choice(["audio"] * 20 + ["seek"]), None, 200 * i, rnd.choice([0.0, 0.0, 0.3]), 3200) for s in range(3) for i in range(90)]
    df = rocks.createDataFrame(rows, CHUNK).withColumn("at", at(F.col("seq")))
    feed = Feed(rocks, tmp_path, lambda s: event_time.utterance_stream(s, delay="30 seconds", idle_ms=60_000))
    order = sorted(range(90), key=lambda i: i + rnd.uniform(0, 20))  # files overlap in time by less than the delay
    for k in range(2):
        feed.add(df.where(F.col("seq").isin(order[45 * k : 45 * k + 45])))
        feed.run()  # each run restarts from the checkpoint
    assert {r["value"]["state"] is not None for r in feed.state("folded").collect()} == {True}
    feed.add(df.limit(1).withColumns({"session_id": F.lit(99).cast("long"), "at": at(F.lit(10_000))}))
    feed.run()
    key = lambda r: (r["session_id"], r["seq"], r["event"], r["start_ms"], r["end_ms"], r["n_samples"])
    got = [key(r) for r in feed.rows() if r["session_id"] != 99]
    assert sorted(got) == sorted(key(r) for r in live.utterances(df.drop("at")).collect())
    assert feed.dropped() == 0
    assert feed.state("folded").where("key.session_id <> 99").count() == 0  # idle sessions are gone
    assert feed.state("waiting").where("key.session_id <> 99").count() == 0


def test_late_messages_are_dropped_and_counted(rocks, tmp_path):
    message = "session_id long, seq long, epoch long"
    feed = Feed(rocks, tmp_path, lambda s: event_time.epoch_filter_stream(s, delay="5 seconds", idle_ms=60_000))
    first = [(1, 0, 5), (1, 1, 4), (1, 2, None), (2, 0, 1), (1, 30, 6)]
    feed.add(rocks.createDataFrame(first, message).withColumn("at", at(F.col("seq"))))
    feed.run()
    late = [(1, 3, 5), (1, 4, 9), (1, 31, 5), (1, 32, 7)]
    feed.add(rocks.createDataFrame(late, message).withColumn("at", at(F.col("seq"))))
    feed.add(rocks.createDataFrame([(9, 900, 1)], message).withColumn("at", at(F.col("seq"))))
    feed.run()
    assert feed.dropped() == 2
    came = [r for r in first + late if r not in ((1, 3, 5), (1, 4, 9))]
    twin = live.epoch_filter(rocks.createDataFrame(came, message)).collect()
    assert sorted((r["session_id"], r["seq"]) for r in feed.rows()) == sorted((r["session_id"], r["seq"]) for r in twin)


def test_rate_limit_forgets_quiet_keys(rocks, tmp_path):
    rnd = random.Random(3)
    df = rocks.createDataFrame([(rnd.randrange(3), 1000 + t, t) for t in range(200)], "key long, at long, event_id long")
    feed = Feed(rocks, tmp_path, lambda s: event_time.rate_limit_stream(s, 3, 20, "2 seconds"))
    for lo in (1000, 1070, 1140):
        feed.add(df.where(F.col("at").between(lo, lo + 69)))
        feed.run()
    assert feed.state("folded").count() == 3
    feed.add(rocks.createDataFrame([(7, 10_000, 10_000)], df.schema))
    feed.run()
    got = {(r["event_id"], r["allowed"]) for r in feed.rows() if r["key"] != 7}
    twin = {(r["event_id"], r["allowed"]) for r in live.rate_limit(df, 3, 20).collect()}
    assert sorted(got) == sorted(twin) and {a for _, a in twin} == {True, False}
    assert feed.state("folded").where("key.key <> 7").count() == 0


def test_job_statuses_expire(rocks, tmp_path):
    rnd = random.Random(4)
    df = rocks.createDataFrame([(rnd.randrange(5), i, rnd.choice(["QUEUED", "PROCESSING", "PROCESSING", "COMPLETED"])) for i in range(60)], "job_id long, seq long, status string")
    feed = Feed(rocks, tmp_path, lambda s: event_time.job_status_stream(s, keep_ms=20_000), "update")
    for lo in (0, 30):
        feed.add(df.where(F.col("seq").between(lo, lo + 29)))
        feed.run(30)
    last = {}
    for r in sorted(feed.rows(), key=lambda r: (r["_batch"], r["last_seq"])):
        last[r["job_id"]] = (r["status"], r["last_seq"])
    assert last == {r["job_id"]: (r["status"], r["last_seq"]) for r in job_status(df).collect()}
    time.sleep(20)
    feed.add(rocks.createDataFrame([(50, 100, "QUEUED")], df.schema))
    feed.run(1)
    assert [r["key"]["job_id"] for r in feed.state("status").collect()] == [50]


SEGMENTS = "media_id long, window_index long, segments array<struct<start_ms:bigint,end_ms:bigint,text:string,speaker:string>>"


def told(windows, window_ms, overlap_ms):
    """Cues of one medium's windows by the rules, segment after segment."""
    cues, memory = [], {}
    for index, segments in windows:
        reached = max([c[2] for c in cues], default=0)
        floor = reached + 1 if cues else 0
        kept = []
        for start, end, text, speaker in sorted(segments, key=lambda s: (s[0], s[1], s[2] is not None, s[2] or "", s[3] or "")):
            text = " ".join((text or "").split())
            if end <= max(reached, floor) or end <= max(start, floor):
                continue
            start = max(start, floor)
            if text.lower() in memory and start <= reached + overlap_ms:
                continue
            if text:
                kept.append((start, end, text, speaker or ""))
        kept.sort(key=lambda s: s[:2])
        raw = []
        for start, end, text, speaker in kept:
            lines, line = [], ""
            for word in text.split(" "):
                word = word[:42]
                if line and len(line) + 1 + len(word) > 42:
                    lines.append(line)
                    line = word
                else:
                    line = f"{line} {word}" if line else word
            lines.append(line)
            blocks = [lines[i : i + 2] for i in range(0, len(lines), 2)]
            total, cursor = sum(map(len, lines)), start
            for block in blocks:
                size = sum(map(len, block))
                stop = cursor + min(7000, max(800, int(max(800, end - start) * size / total)))
                raw.append((cursor, stop, "\n".join(block), size, speaker))
                cursor = stop
        before = None
        new = []
        for i, (start, end, text, size, speaker) in enumerate(raw):
            if before is not None and start < before + 80:
                start = before + 80
            end = max(end, start + 800)
            following = raw[i + 1][0] if i + 1 < len(raw) else end + 80
            if end > following - 80:
                end = max(start + 1, following - 80)
            if size * 1000 > 17 * (end - start):
                end = min(max(end, start + int(size / 17.0 * 1000)), max(start + 1, following - 80))
            before = end
            new.append((index, start, end, text, speaker))
        for _, _, end, text, _ in new:
            memory[" ".join(text.split()).lower()] = max(end, memory.get(" ".join(text.split()).lower(), 0))
        cues += [(i, s, e, t, w) for i, s, e, t, w in new]
        if new:
            reached = max(c[2] for c in cues)
            memory = {t: end for t, end in memory.items() if end >= reached - window_ms - 2 * overlap_ms}
    return [(i, n, s, e, t, w) for n, (i, s, e, t, w) in enumerate(cues, 1)]


def media_windows(n, seed=7):
    """Windows of 3 s that overlap by half a second, with what both heard said twice."""
    rnd = random.Random(seed)
    out = {}
    for m in range(n):
        windows = []
        for w in range(rnd.randrange(0, 7)):
            lo = 2500 * w
            segments = [(s := lo + rnd.randrange(-200, 3000), s + rnd.randrange(-50, 2500), rnd.choice(["yes", "Yes", "no", "well then", "a " * rnd.randrange(1, 90), "word" * 20 + " x", "", None, f"talk {rnd.randrange(5)} of  it"]), rnd.choice(["A", "B", None])) for _ in range(rnd.randrange(0, 5))]
            windows.append((w, segments))
        out[m] = windows
    return out


def cue(r):
    return (r["window_index"], r["cue_index"], r["start_ms"], r["end_ms"], r["text"], r["speaker"])


def test_cues_across_windows_equal_a_plain_loop(spark):
    media = media_windows(500)
    rows = [(m, w, segments) for m, windows in media.items() for w, segments in windows]
    random.Random(1).shuffle(rows)
    flat = spark.createDataFrame([(m, w, *s) for m, w, segments in rows for s in segments], "media_id long, window_index long, start_ms long, end_ms long, text string, speaker string")
    out = {}
    for r in progressive.progressive_cues(progressive.by_window(flat), 3000, 500).orderBy("media_id", "cue_index").collect():
        out.setdefault(r["media_id"], []).append(cue(r))
    want = {m: told([w for w in windows if w[1]], 3000, 500) for m, windows in media.items()}
    assert out == {m: cues for m, cues in want.items() if cues}
    assert sum(map(len, out.values())) > 1500


def test_cue_stream_is_its_batch_twin(rocks, tmp_path):
    rows = [(m, w, segments) for m, windows in media_windows(12, 8).items() for w, segments in windows]
    df = rocks.createDataFrame(rows, SEGMENTS).withColumn("segments", F.array_sort("segments"))
    feed = Feed(rocks, tmp_path, lambda s: progressive.progressive_cue_stream(s, "at", 3000, 500, "20 seconds", 60_000))
    timed = df.withColumn("at", at(3 * F.col("window_index") + F.col("media_id") % 5))
    for part in (timed.where("(media_id + window_index) % 3 <> 0 and window_index < 4"), timed.where("(media_id + window_index) % 3 = 0 or window_index >= 4"), timed.limit(1).withColumns({"media_id": F.lit(99).cast("long"), "at": at(F.lit(9000))})):
        feed.add(part)
        feed.run()
    got = sorted((r["media_id"], *cue(r)) for r in feed.rows() if r["media_id"] != 99)
    assert got == sorted((r["media_id"], *cue(r)) for r in progressive.progressive_cues(df, 3000, 500).collect())
    assert feed.dropped() == 0 and feed.state("folded").where("key.media_id <> 99").count() == 0
