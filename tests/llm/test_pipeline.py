"""The pipeline, stage by stage, on a small folder of tables."""

from __future__ import annotations

import sys
from pathlib import Path

sys.path.insert(0, str(Path(__file__).parent))
import brute
import corpus_pipeline


def test_pipeline(spark, tmp_path):
    texts = brute.corpus(6, 80)
    rows = [(i, t, "en", ["hot", "hot", "a", "b"][i % 4], len(t or "")) for i, t in texts.items()]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, " ".join(brute.words(texts[0])[:20])), (2, None)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, str(tmp_path))
        assert out.columns == docs.columns, name
        before, after = {r["doc_id"]: r["text"] for r in docs.collect()}, {r["doc_id"] for r in out.collect()}
        if name == "quality_rules":
            assert not any(brute.base_counts(before[i])[5] for i in after) and after
        elif name == "simhash_near_dedup":
            assert after == set(brute.components(before).values())
        elif name == "benchmark_decontamination":
            assert after == {i for i, x in brute.contamination(before, {1: " ".join(brute.words(texts[0])[:20])}).items() if not x[1]}
        out.write.parquet(f"{tmp_path}/{name}")
        docs = spark.read.parquet(f"{tmp_path}/{name}")
    last = corpus_pipeline.STAGES[-1][1](spark, docs, str(tmp_path))
    assert {r["doc_id"] for r in last.collect()} == {r["doc_id"] for r in docs.collect()}
    whole = corpus_pipeline.run(spark, str(tmp_path))
    assert sorted(map(tuple, whole.collect())) == sorted(map(tuple, last.collect()))


def test_entry_lists_all():
    import __spark_entry__ as e

    names = set(e.queries())
    assert {f"op{n}_" for n in range(1, 14)} <= {x[: x.index("_") + 1] for x in names if x.startswith("op")} and "pipeline" in names
    assert set(e.oracle_sql()) <= names


def test_mix_stage_keeps_all_rows_of_a_hot_source(spark):
    docs = spark.createDataFrame([(i, "t", "en", "hot" if i % 4 else f"s{i % 3}", 1) for i in range(2000)], "doc_id long, text string, lang string, source string, n_chars long")
    assert {r["doc_id"] for r in corpus_pipeline.mix(spark, docs, "").collect()} == set(range(2000))


def test_token_files_keep_the_order_of_the_mix(spark, tmp_path):
    from tracklake.llm import mixing

    rows = [(i, f"a text {i}", "en", "hot" if i % 4 else f"s{i % 3}", 1) for i in range(2000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    corpus_pipeline.mix(spark, docs, "").write.parquet(f"{tmp_path}/mix")
    out = corpus_pipeline.token_output(spark, spark.read.parquet(f"{tmp_path}/mix"), "").orderBy("start").collect()
    slots = mixing.mix(docs).orderBy("_tl_slot", "_tl_rank").collect()
    assert [r["doc_id"] for r in out] == [r["doc_id"] for r in slots] != sorted(r["doc_id"] for r in slots)
    assert all(b["start"] == a["start"] + a["n_tokens"] for a, b in zip(out, out[1:]))
