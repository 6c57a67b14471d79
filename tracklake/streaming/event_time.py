"""Streams in event time: keyed folds over rows in order, whatever order they come in, with state that goes away.

Rows wait in list state until the watermark has passed them; then timers give them to the fold by time, so a stream gives
what its batch twin gives over the same rows. Rows that come after the watermark are dropped and counted by Spark
(`numRowsDroppedByWatermark` of the query's progress). A key without rows for `idle_ms` of event time loses its state.
State is kept in RocksDB: set `rocksdb(spark)` before a query starts.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from tracklake.operators.tracks import TERMINAL
from tracklake.streaming import live

PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
HOUR_MS = 3_600_000
#: fold(key, rows as dicts in order, state or None) -> (output rows, state); state is made of numbers, texts, lists and dicts.
Fold = Callable[[object, list[dict], object], tuple[list[tuple], object]]


def rocksdb(spark: SparkSession) -> None:
    """Keep streaming state of this session in RocksDB, as processors with timers need."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", PROVIDER)


class InOrder(StatefulProcessor):
    """Holds a key's rows until the watermark has passed them and folds them in order."""

    def __init__(self, fold: Fold, order: list[str], columns: list[str], idle_ms: int) -> None:
        self.fold, self.order, self.columns, self.idle_ms = fold, order, columns, idle_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getListState("waiting", "at long, row string")
        self.folded = handle.getValueState("folded", "until long, state string")

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues: object) -> Iterator[pd.DataFrame]:
        new = [(int(at), row) for pdf in rows if len(pdf) for at, row in zip(pdf["due_ms"], pdf["packed"], strict=True)]
        if new:
            self.waiting.appendList(new)
            self.handle.registerTimer(min(at for at, _ in new))
        yield pd.DataFrame(columns=self.columns)

    def handleExpiredTimer(self, key: tuple, timerValues: object, expiredTimerInfo: object) -> Iterator[pd.DataFrame]:
        now = timerValues.getCurrentWatermarkInMs()
        rows = [(at, json.loads(row)) for at, row in (self.waiting.get() if self.waiting.exists() else ())]
        ready, later = [r for r in rows if r[0] <= now], [r for r in rows if r[0] > now]
        until, state = self.folded.get() if self.folded.exists() else (-1, None)
        out: list[tuple] = []
        if ready:
            ready.sort(key=lambda r: (r[0], *[(r[1].get(c) is not None, r[1].get(c)) for c in self.order]))
            out, after = self.fold(key[0], [row for _, row in ready], None if state is None else json.loads(state))
            until = max(until, ready[-1][0])
            self.folded.update((until, json.dumps(after)))
            self.waiting.put([(at, json.dumps(row)) for at, row in later]) if later else self.waiting.clear()
        if later:
            self.handle.registerTimer(min(at for at, _ in later))
        elif until + self.idle_ms > now:
            self.handle.registerTimer(until + self.idle_ms)
        elif self.folded.exists():
            self.folded.clear()
        yield pd.DataFrame(out, columns=self.columns)

    def close(self) -> None:
        pass


def fold_in_order(df: DataFrame, key: str, at: str, order: list[str], fold: Fold, schema: str, delay: str, idle_ms: int) -> DataFrame:
    """fold over each key's rows by (at, order), once the watermark, `delay` behind the newest `at`, has passed them.

    at is a timestamp; no column is named with a leading underscore, since rows travel as named tuples. Rows without a key are one key; rows without an event time never become due and are passed over.
    """
    columns = [c.strip().split(" ")[0] for c in schema.split(",")]
    rows = df.where(F.col(at).isNotNull()).withWatermark(at, delay)
    packed = F.to_json(F.struct(*[c for c in df.columns if c != at]), {"ignoreNullFields": "false"})
    rows = rows.select(key, at, F.unix_millis(at).alias("due_ms"), packed.alias("packed"))
    return rows.groupBy(key).transformWithStateInPandas(InOrder(fold, order, columns, idle_ms), schema, "append", "EventTime")


def utterance_stream(chunks: DataFrame, at: str = "at", delay: str = "10 seconds", idle_ms: int = HOUR_MS, **how: object) -> DataFrame:
    """Utterance events of a stream of chunks with an event time; equal to live.utterances where times follow seq."""
    names = ["seq", "kind", "epoch", "time_ms", "rms", "n_samples"]

    def fold(key: object, rows: list[dict], state: object) -> tuple[list[tuple], object]:
        session = live.Session(**state) if state else live.Session()
        events, after = live.endpoint(key, pd.DataFrame(rows, columns=names), session, **how)
        return [tuple(None if pd.isna(v) else v for v in e) for e in events], {k: int(v) for k, v in after._asdict().items()}

    return fold_in_order(chunks.select("session_id", at, *names), "session_id", at, ["seq"], fold, live.EVENTS, delay, idle_ms)


def epoch_filter_stream(messages: DataFrame, at: str = "at", delay: str = "10 seconds", idle_ms: int = HOUR_MS) -> DataFrame:
    """(session_id, seq, epoch) of messages whose epoch is no older than any before them; streaming form of live.epoch_filter."""
    def fold(key: object, rows: list[dict], newest: object) -> tuple[list[tuple], object]:
        out = []
        for r in rows:
            if r["epoch"] is None or newest is None or r["epoch"] >= newest:
                out.append((key, r["seq"], r["epoch"]))
                newest = r["epoch"] if newest is None else max(newest, newest if r["epoch"] is None else r["epoch"])
        return out, newest

    return fold_in_order(messages.select("session_id", at, "seq", "epoch"), "session_id", at, ["seq"], fold, "session_id long, seq long, epoch long", delay, idle_ms)


def rate_limit_stream(hits: DataFrame, limit: int = 5, window: int = 60, delay: str = "10 seconds") -> DataFrame:
    """hits (key, at in seconds, event_id) with `allowed`; a key is forgotten once a window has passed without hits."""
    def fold(key: object, rows: list[dict], state: object) -> tuple[list[tuple], object]:
        ok, allowed = live.limited([r["second"] for r in rows], state or [], limit, window)
        return [(key, r["second"], r["event_id"], a) for r, a in zip(rows, ok, strict=True)], allowed

    timed = hits.select("key", F.timestamp_seconds("at").alias("due"), F.col("at").alias("second"), "event_id")
    return fold_in_order(timed, "key", "due", ["event_id"], fold, "key long, at long, event_id long, allowed boolean", delay, window * 1000 + 1000)


class Statuses(StatefulProcessor):
    """The status of a job after each batch; RocksDB forgets it `keep_ms` after its last event."""

    def __init__(self, keep_ms: int) -> None:
        self.keep_ms = keep_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.status = handle.getValueState("status", "seq long, status string", ttlDurationMs=self.keep_ms)

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues: object) -> Iterator[pd.DataFrame]:
        seq, status = self.status.get() if self.status.exists() else (-1, "")
        for r in pd.concat(list(rows)).sort_values("seq").itertuples():
            if status not in TERMINAL:
                status = r.status
            seq = max(seq, r.seq)
        self.status.update((int(seq), status))
        yield pd.DataFrame({"job_id": [key[0]], "status": [status], "last_seq": [seq]})

    def close(self) -> None:
        pass


def job_status_stream(events: DataFrame, keep_ms: int = 24 * HOUR_MS) -> DataFrame:
    """Current status of each job as its events (job_id, seq, status) come; a terminal status stays until it is forgotten.

    keep_ms is processing time since the job's last event: finished jobs send no more, so their rows leave the state.
    """
    rows = events.select("job_id", "seq", "status").groupBy("job_id")
    return rows.transformWithStateInPandas(Statuses(keep_ms), "job_id long, status string, last_seq long", "update", "ProcessingTime")
