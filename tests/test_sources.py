"""Sources and sinks on small files, plugged models, clustering, and the entry point without the corpus operators."""

from __future__ import annotations

import json
import math
import random
import struct
import subprocess
import sys
import wave
from pathlib import Path

import numpy as np
import pytest
from pyspark.sql import functions as F

from tracklake import udfs
from tracklake.operators import clustering as K
from tracklake.operators import joins as J
from tracklake.operators import quality as Q
from tracklake.operators.language import lid_decision, lid_topk
from tracklake.sources import documents as S
from tracklake.sources import media as M


def write_wav(path, samples, rate=16000, channels=1, width=2):
    with wave.open(str(path), "wb") as w:
        w.setnchannels(channels)
        w.setsampwidth(width)
        w.setframerate(rate)
        w.writeframes(b"".join(struct.pack("<h", int(x)) for x in samples) if width == 2 else bytes(len(samples)))


@pytest.fixture()
def folder(tmp_path):
    (tmp_path / "sub").mkdir()
    sine = [10_000 * math.sin(i / 5) for i in range(4000)]
    write_wav(tmp_path / "sine.wav", sine)
    write_wav(tmp_path / "sub" / "stereo.wav", [x for s in sine for x in (s, -s)], channels=2)
    write_wav(tmp_path / "slow.wav", sine, rate=8000)
    (tmp_path / "bad.wav").write_bytes(b"nothing")
    (tmp_path / "empty.mp3").write_bytes(b"")
    (tmp_path / "notes.txt").write_bytes(b"x")
    return tmp_path


def test_manifest(spark, folder):
    rows = {r["path"].rsplit("/", 1)[1]: r for r in M.media_manifest(spark, f"file://{folder}", limit=10_000).collect()}
    assert {k: r["error_code"] for k, r in rows.items()} == {"sine.wav": None, "stereo.wav": "too_large", "slow.wav": None, "bad.wav": None, "empty.mp3": "empty", "notes.txt": "unsupported"}
    import hashlib

    assert rows["bad.wav"]["sha256"] == hashlib.sha256(b"nothing").hexdigest() and rows["notes.txt"]["sha256"] is None


def test_manifest_of_nested_folders_is_that_of_the_reader(spark, folder):
    import hashlib

    deep = folder / "a b" / "ünder %41" / "c"
    deep.mkdir(parents=True)
    (folder / "none").mkdir()
    for size in (M.CHUNK - 1, M.CHUNK, M.CHUNK + 1):  # around the edge of a chunk
        (deep / f"{size}.mp4").write_bytes(b"x" * size)
    rows = {r["path"]: r for r in M.media_manifest(spark, f"file://{folder}").collect()}
    for size in (M.CHUNK - 1, M.CHUNK, M.CHUNK + 1):
        assert rows[f"file:{deep}/{size}.mp4"]["sha256"] == hashlib.sha256(b"x" * size).hexdigest()
    read = {r["path"]: r for r in M.read_manifest(spark, f"file://{folder}").collect()}
    assert len(rows) == len(read) == 9
    assert sorted(map(str, (tuple(r)[2:] for r in rows.values()))) == sorted(map(str, (tuple(r)[2:] for r in read.values())))
    files = spark.createDataFrame([(f"{deep}/gone.wav", 1)], "path string, length long")
    assert [tuple(r) for r in M.digested(files, f"file://{folder}").collect()] == [(f"{deep}/gone.wav", None)]
    assert M.walk(spark, f"file://{folder}/none").count() == 0


def test_wav_blocks(spark, folder):
    rows = {}
    for r in M.wav_blocks(spark, f"file://{folder}").collect():
        rows.setdefault(r["path"].rsplit("/", 1)[1], []).append(r)
    assert [r["error_code"] for r in rows["slow.wav"]] == ["format"] and [r["error_code"] for r in rows["bad.wav"]] == ["unreadable"]
    assert sorted(r["n"] for r in rows["sine.wav"]) == [800, 1600, 1600]
    assert all(abs(r["rms"] - 10_000 / 32768 / math.sqrt(2)) < 0.01 for r in rows["sine.wav"]) and all(r["rms"] < 1e-4 for r in rows["stereo.wav"])
    first = M.wav_blocks(spark, f"file://{folder}", channel_mode="first").where("path like '%stereo%'").collect()
    assert all(r["rms"] > 0.1 for r in first)


def test_read_transcripts(spark, tmp_path):
    seg = {"segment_index": 0, "start_ms": 0, "end_ms": 5, "speaker_label": "SPEAKER_00", "text": "hi"}
    for i, lang in ((1, "en"), (2, "")):
        (tmp_path / f"{i}.json").write_text(json.dumps({"media_id": i, "language": lang, "segments": [seg]}, indent=1))
    rows = {r["media_id"]: (r["source_lang"], r["error_code"]) for r in S.read_transcripts(spark, f"file://{tmp_path}").collect()}
    assert rows == {1: ("en", None), 2: (None, "no_source_language")}
    assert {r["source_lang"] for r in S.read_transcripts(spark, f"file://{tmp_path}", "fr").collect()} == {"fr"}


def test_read_tables(spark, tmp_path):
    spark.createDataFrame([("b", 1.0)], S.TABLES["rate_hits"]).write.parquet(f"file://{tmp_path}/r")
    assert S.read_table(spark, "rate_hits", f"file://{tmp_path}/r").first()["at"] == 1.0


def test_write_documents_and_exports(spark, tmp_path):
    dialogue = spark.createDataFrame([(1, 0, "SPEAKER_00", 0, 900, 'say "hi"'), (1, 1, "SPEAKER_01", 900, 1800, "yes")], "media_id long, segment_index long, speaker_label string, start_ms long, end_ms long, text string")
    media = spark.createDataFrame([(1, 2000), (2, 10)], "media_id long, duration_ms long")
    quality = spark.createDataFrame([(1, 1.0, "passed")], "media_id long, score double, level string")
    docs = S.track_documents(dialogue, quality, media)
    manifest = S.write_documents(docs, f"file://{tmp_path}/docs")
    assert manifest.count() == 10
    read = spark.read.text(f"file://{tmp_path}/docs").where("doc = 'segments'").collect()
    assert sorted(len(json.loads(r["value"])) for r in read) == [0, 2]
    check = {r["media_id"]: r["ok"] for r in S.manifest_check(manifest.where("not (media_id = 2 and doc = 'metadata')"), docs).collect()}
    assert check == {1: True, 2: False}
    cues = dialogue.withColumns({"language": F.lit("en"), "cue_index": F.col("segment_index")})
    assert S.write_exports(cues, f"file://{tmp_path}/subs").count() == 3
    assert {p.name for p in Path(f"{tmp_path}/subs").glob("format=*")} == {"format=srt", "format=vtt", "format=ass"}


def test_models(spark):
    def translate(texts, source, target):
        if target == "xx":
            raise RuntimeError
        return [t.upper() for t in texts]

    df = spark.createDataFrame([("en", "es", "a"), ("en", "es", "a"), ("en", "xx", "b"), ("en", "en", "c")], "source_lang string, target_lang string, text string")
    rows = sorted((r["target_lang"], r["text"], r["translated"], r["status"]) for r in udfs.translate_batch(df, translate).collect())
    assert rows == [("es", "a", "A", "ok"), ("xx", "b", None, "partial")]
    out = udfs.batched(df, lambda model, pdf: pdf.assign(text=model), "source_lang string, target_lang string, text string", load=lambda: "loaded")
    assert {r["text"] for r in out.collect()} == {"loaded"}


def test_agglomerate_joins_noise_but_no_two_seeds():
    v = np.array([[1, 0], [1, 0.1], [0.9, 0], [1, 0.05], [0, 1], [0.1, 1], [0, 1], [1, 0.02], [-1, -1]], float)
    assert K.agglomerate(np.array([0, 0, 0, 1, 2, 2, 2, -1, -1]), v).tolist() == [0, 0, 0, 1, 2, 2, 2, 1, 3]
    assert K.agglomerate(np.array([0, 0, 0, 1, 1, 1]), v[[0, 1, 2, 3, 7, 0]]).tolist() == [0, 0, 0, 1, 1, 1]
    rng = np.random.default_rng(1)
    labels, vectors = rng.integers(-1, 3, 40), rng.normal(size=(40, 6))
    assert K.agglomerate(labels, vectors)[0] == 0


def greedy(labels, v, merge_at):
    """The pair of greatest mean cosine merges, one at a time."""
    v = v / np.linalg.norm(v, axis=1, keepdims=True)
    groups = [np.flatnonzero(labels == s).tolist() for s in sorted({int(x) for x in labels if x >= 0})] + [[int(i)] for i in np.flatnonzero(labels < 0)]
    while True:
        pairs = [(np.mean([v[i] @ v[j] for i in a for j in b]), x, y) for x, a in enumerate(groups) for y, b in enumerate(groups) if x < y and not (max(labels[a]) >= 0 and max(labels[b]) >= 0)]
        if not pairs or max(pairs)[0] < merge_at:
            return {frozenset(g) for g in groups}
        _, x, y = max(pairs)
        groups[x] += groups.pop(y)


@pytest.mark.parametrize("seed", range(6))
def test_agglomerate_merges_as_the_greedy_way(seed):
    rng = np.random.default_rng(seed)
    labels, vectors = rng.integers(-3, 3, 26).clip(-1), rng.normal(size=(26, 3)) + 0.4
    got = K.agglomerate(labels, vectors, 0.3, 1)
    assert {frozenset(np.flatnonzero(got == c).tolist()) for c in set(got.tolist())} == greedy(labels, vectors, 0.3)


def test_seeds_are_made_in_each_medium(spark):
    axes = np.eye(8)
    rows = [(m, i, (axes[i % (3 + 4 * m)] + 0.01).tolist()) for m in range(2) for i in range(42)] + [(7, 0, [1.0] * 8), (7, 1, [-1.0] * 8)] + [(8, i, axes[i].tolist()) for i in range(3)]
    got = {}
    for r in K.seed_labels(spark.createDataFrame(rows, "media_id long, seq long, embedding array<double>")).collect():
        got.setdefault(r["media_id"], []).append(r["seed_label"])
    assert {m: len(set(x)) for m, x in got.items()} == {0: 3, 1: 7, 7: 1, 8: 1} and set(got[7]) == {0} and set(got[8]) == {-1}


def test_turns_are_disjoint(spark):
    rng = random.Random(1)
    rows = [(m, i, i * 750, i * 750 + 1500, rng.choice([0, 0, 1, -1]), [rng.random(), rng.random()]) for m in range(3) for i in range(30)]
    turns = K.diarize(spark.createDataFrame(rows, "media_id long, seq long, start_ms long, end_ms long, seed_label int, embedding array<float>"))
    by = {}
    for r in turns.orderBy("media_id", "start_ms").collect():
        by.setdefault(r["media_id"], []).append(r)
    assert all(rs[0]["speaker_label"] == "SPEAKER_00" and all(a["end_ms"] <= b["start_ms"] for a, b in zip(rs, rs[1:], strict=False)) for rs in by.values())


def test_language_ranking(spark):
    df = spark.createDataFrame([(1, [2.0, 2.0, 1.0]), (2, [float("nan"), 0.0, 1000.0])], "doc_id long, logits array<double>")
    rows = sorted((r["doc_id"], r["rank"], r["code"]) for r in lid_topk(df, ["aa", "bb", "cc"], 2).collect())
    assert rows == [(1, 0, "aa"), (1, 1, "bb"), (2, 0, "cc"), (2, 1, "aa")]
    one = spark.createDataFrame([(1, "aa", 0.2, False), (2, "aa", 0.9, True), (3, "aa", 0.9, False)], "doc_id long, code string, confidence double, silent boolean")
    got = lambda **k: {r["doc_id"]: (r["language"], r["strategy"]) for r in lid_decision(one, **k).collect()}
    assert got() == {1: ("und", "undetermined"), 2: ("und", "silent"), 3: ("aa", "detected")}
    assert got(override="ES")[1] == ("es", "override") and got(strict=True)[1] == (None, "error_low_confidence")


def test_rules_of_silent_and_overlapping_media(spark):
    none = lambda schema: spark.createDataFrame([], schema)
    media = spark.createDataFrame([(1, 9000), (2, 9000)], "media_id long, duration_ms long")
    dialogue = spark.createDataFrame([(1, 0, 0, 2000, "a"), (1, 1, 1000, 3000, " ")], "media_id long, segment_index long, start_ms long, end_ms long, text string")
    segments = spark.createDataFrame([(1, 0.2, None), (1, None, -6.0), (1, 0.9, None)], "media_id long, confidence double, avg_logprob double")
    turns = spark.createDataFrame([(1, "SPEAKER_00", 0, 2500)], "media_id long, speaker_label string, start_ms long, end_ms long")
    words = spark.createDataFrame([(1, 0.1), (1, 0.9)], "media_id long, confidence double")
    rules = Q.quality_rules(media, dialogue, segments, turns, turns.drop("speaker_label"), none("media_id long, start_ms long, end_ms long"), words)
    got = {(r["media_id"], r["rule_code"]): (r["occurrences"], r["penalty"], r["applicable"]) for r in rules.collect()}
    assert len(got) == 22 and got[1, "QR04"] == (1, 1.0, True) and got[1, "QR02"] == (1, 1.0, True) and got[1, "QR05"] == (1, 0.03, True) and got[1, "QR07"] == (2, 0.08, True) and got[1, "QR08"] == (1, 0.005, True)
    assert got[2, "QR07"] == (0, 0.0, False)
    score = {r["media_id"]: (r["score"], r["level"]) for r in Q.quality_score(rules, media.where("media_id = 2")).collect()}
    assert score == {1: (0.0, "failed"), 2: (1.0, "passed")}


def test_glossary_falls_back_as_a_whole(spark):
    glossary = spark.createDataFrame([("es", "a", "1"), ("*", "a", "2"), ("*", "b", "3")], "lang string, term string, replacement string")
    out = J.glossary_join(spark.createDataFrame([("es",), ("fr",)], "target string"), glossary).collect()
    assert sorted(map(tuple, ((r["target"], r["term"], r["replacement"]) for r in out))) == [("es", "a", "1"), ("fr", "a", "2"), ("fr", "b", "3")]


def test_entry_without_corpus_operators(tmp_path):
    """The entry point imports, and has its other queries, where the corpus operators are gone."""
    root = Path(__file__).parent.parent
    for p in root.iterdir():
        if p.name not in ("tracklake", "corpus_pipeline.py", ".git", "tests"):
            (tmp_path / p.name).symlink_to(p)
    (tmp_path / "tracklake").mkdir()
    for p in (root / "tracklake").iterdir():
        if p.name != "llm":
            (tmp_path / "tracklake" / p.name).symlink_to(p)
    code = "import __spark_entry__ as e; q = e.queries(); print(len(q), any(k.startswith('op') or k == 'pipeline' for k in q), set(e.oracle_sql()) <= set(q))"
    out = subprocess.run([sys.executable, "-c", code], cwd=tmp_path, env={"PYTHONPATH": str(tmp_path), "PATH": "/usr/bin:/bin", "PYTHONDONTWRITEBYTECODE": "1"}, capture_output=True, text=True)
    assert out.stdout.split()[1:] == ["False", "True"] and int(out.stdout.split()[0]) > 100, out.stderr
