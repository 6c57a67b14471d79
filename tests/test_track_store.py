"""Stored tracks: newest write wins, only touched partitions change, a batch counts once."""

from pathlib import Path

import pytest
from tracklake.sources import track_store as S

TRACK = "project_id long, language string, cues string, updated_at long"


def frame(spark, rows):
    return spark.createDataFrame(rows, TRACK)


def files(store):
    return {str(p) for p in Path(store).rglob("*.parquet") if "_stage" not in str(p)}


def rows(spark, store):
    return sorted(tuple(r) for r in S.read_store(spark, store, frame(spark, []).schema).collect())


def test_only_touched_partitions_change(spark, tmp_path):
    store = f"{tmp_path}/store"
    first = [(i, lang, f"{lang}{i}", 10) for i in range(200) for lang in ("en", "es")]
    assert rows(spark, store) == []
    assert S.write_batch(frame(spark, first), store, 0, shards=8)
    before = files(store)
    assert len({Path(f).parent for f in before}) == 16 and rows(spark, store) == sorted(first)
    second = [(3, "es", "new", 11), (3, "es", "older", 9), (4, "es", "stale", 1), (500, "es", "added", 1)]
    assert S.write_batch(frame(spark, second), store, 1, shards=8)
    want = {(p, lang): (p, lang, cues, at) for p, lang, cues, at in first}
    want |= {(3, "es"): (3, "es", "new", 11), (500, "es"): (500, "es", "added", 1)}
    assert rows(spark, store) == sorted(want.values())
    touched = {r[0] for r in frame(spark, second).select(S.shard_of(shards=8)).collect()}
    moved = {Path(f).parent for f in before ^ files(store)}
    assert moved == {Path(f"{store}/language=es/shard={s}") for s in touched}


def test_a_batch_counts_once_and_a_failed_one_is_written_again(spark, tmp_path, monkeypatch):
    store = f"{tmp_path}/store"
    batch = frame(spark, [(1, "en", "a", 1), (2, "en", "b", 1)])
    assert S.write_batch(batch, store, 7)
    before = files(store)
    assert not S.write_batch(batch, store, 7) and files(store) == before
    Path(f"{store}/_batches/7").unlink()  # as if it had failed before its marker
    assert S.write_batch(batch, store, 7)
    assert rows(spark, store) == [(1, "en", "a", 1), (2, "en", "b", 1)]
    assert not list(Path(store).glob("_stage/*"))
    with pytest.raises(ValueError, match="project_id"):
        S.write_batch(frame(spark, [(None, "en", "a", 1)]), store, 8)


def test_sink_of_a_stream_over_a_restart(spark, tmp_path):
    store, want = f"{tmp_path}/store", {}
    for k in range(4):
        part = [(i % 7, "en" if i % 2 else "es", f"{k}:{i}", 100 * k + i) for i in range(k, 40, 3)]
        frame(spark, part).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        for p, lang, cues, at in part:
            want[p, lang] = max(want.get((p, lang), (p, lang, "", -1)), (p, lang, cues, at), key=lambda r: r[3])
        if k % 2:  # each start goes on from the checkpoint
            source = spark.readStream.schema(TRACK).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
            query = source.writeStream.foreachBatch(S.sink(store, shards=4)).option("checkpointLocation", f"{tmp_path}/check").trigger(availableNow=True).start()
            query.awaitTermination(120)
            assert query.exception() is None
    assert rows(spark, store) == sorted(want.values())
    assert len(list(Path(store).glob("_batches/*"))) >= 4


def test_languages_prune_folders(spark, tmp_path):
    store = f"{tmp_path}/store"
    S.write_batch(frame(spark, [(i, lang, "x", 1) for i in range(20) for lang in ("en", "es", "de")]), store, 0, shards=2)
    df = S.read_store(spark, store, frame(spark, []).schema).where("language = 'de'")
    assert df.count() == 20
    assert "PartitionFilters: [isnotnull(language" in df._jdf.queryExecution().toString()
