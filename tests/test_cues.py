"""Cue folds against plain loops, and export formats."""

from __future__ import annotations

import random
import re

import pytest
from pyspark.sql import functions as F

from tracklake.functions import text as T
from tracklake.operators import cues as C


def wrap(text, width=42, lines=2):
    out, cur = [], ""
    for w in text.split():
        w = w[:width]
        longer = f"{cur} {w}" if cur else w
        if len(longer) <= width:
            cur = longer
        else:
            out, cur = out + [cur] * bool(cur), w
    out += [cur] * bool(cur)
    return [out[i : i + lines] for i in range(0, len(out), lines)]


def repaired(cues):
    out, last = [], None
    for i, (s, e, text) in enumerate(cues):
        s = max(s, last + 80) if last is not None else s
        e = max(e, s + 800)
        following = cues[i + 1][0] if i + 1 < len(cues) else e + 80
        if e > following - 80:
            e = max(s + 1, following - 80)
        chars = len(text.replace("\n", ""))
        if chars / max((e - s) / 1000, 0.001) > 17:
            e = min(max(e, s + int(chars / 17 * 1000)), max(s + 1, following - 80))
        last = max(e, s + 1)
        out.append((s, last))
    return out


def built(segments):
    rows = sorted(((s, e if e > s else s + 800, i, " ".join(t.split())) for i, (s, e, t) in enumerate(segments) if t.split()), key=lambda r: r[:3])
    raw = []
    for s, e, _, t in rows:
        blocks = wrap(t)
        weights = [max(1, sum(map(len, b))) for b in blocks]
        at = s
        for b, w in zip(blocks, weights, strict=True):
            piece = min(7000, max(800, max(800, e - s) * w // sum(weights)))
            raw.append((at, at + piece, "\n".join(b)))
            at += piece
    return [(*t, r[2]) for t, r in zip(repaired(raw), raw, strict=True)]


@pytest.fixture(scope="module")
def tracks():
    rnd = random.Random(3)
    word = lambda: rnd.choice(["a", "of", "speech", "x" * 50, "é" * 10, "word,", "end."])
    out = {}
    for m in range(25):
        at, segs = 0, []
        for _ in range(rnd.randrange(1, 9)):
            at += rnd.randrange(-300, 4000)
            segs.append((max(0, at), max(0, at) + rnd.choice([0, 300, 1500, 9000]), " ".join(word() for _ in range(rnd.randrange(0, 30)))))
        out[m] = segs
    return out


def test_build_cues(spark, tracks):
    rows = [(m, "en", i, s, e, t, "SPEAKER_00") for m, segs in tracks.items() for i, (s, e, t) in enumerate(segs)]
    df = spark.createDataFrame(rows, "media_id long, language string, segment_index long, start_ms long, end_ms long, text string, speaker string")
    got = {}
    for r in C.build_cues(df).orderBy("media_id", "cue_index").collect():
        got.setdefault(r["media_id"], []).append((r["start_ms"], r["end_ms"], r["text"]))
    assert got == {m: built(segs) for m, segs in tracks.items() if built(segs)}


def test_wrap(spark):
    texts = ["", "one", "x" * 100 + " y", "ab " * 60, " \t "]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    assert [r["b"] for r in df.select(C.wrap_blocks(F.col("t")).alias("b")).collect()] == [wrap(t) for t in texts]
    split = df.where("t like 'xxx%'").select(C.wrap_lines(F.col("t"), split_long_words=True).alias("l")).first()["l"]
    assert "".join(split).replace(" ", "") == "x" * 100 + "y"


def test_exports_parse(spark):
    rows = [(1, "en", 1, 3_600_500, 3_601_000, "a & <b>"), (1, "en", 0, -5, 900, " two\r\n\r\nlines "), (1, "en", 2, 50, 50, "empty"), (1, "en", 3, 60, 90, "  "), (2, "en", 0, 5, 5, "nothing")]
    df = spark.createDataFrame(rows, "media_id long, language string, cue_index long, start_ms long, end_ms long, text string")
    text = lambda out: {r["media_id"]: r["content"] for r in out.collect()}
    srt, vtt, ass = text(C.export_srt(df)), text(C.export_vtt(df)), text(C.export_ass(df))
    assert srt == {1: "1\n00:00:00,000 --> 00:00:00,900\ntwo\nlines\n\n2\n01:00:00,500 --> 01:00:01,000\na & <b>\n", 2: ""}
    assert vtt == {1: "WEBVTT\n\n00:00:00.000 --> 00:00:00.900\ntwo\nlines\n\n01:00:00.500 --> 01:00:01.000\na &amp; &lt;b&gt;\n", 2: "WEBVTT\n"}
    assert ass[1].endswith("Dialogue: 0,0:00:00.00,0:00:00.90,Default,,0,0,0,,two\\Nlines\nDialogue: 0,1:00:00.50,1:00:01.00,Default,,0,0,0,,a & <b>\n")
    assert re.search(r"PlayResX: 1920\nPlayResY: 1080\n", ass[2])


def test_fillers_stay_if_nothing_is_left(spark):
    texts = [("well, you know, Fine", "en"), ("well, well,", "en"), ("Also, also, gut", "de"), ("well, x", "fr"), ("wellness, x", "en")]

    def loop(s, g):
        changed = True
        while changed:
            changed = False
            for f in T.FILLERS[g]:
                if s.lower().startswith(f) and s[len(f) :].lstrip():
                    s, changed = s[len(f) :].lstrip(), True
        return s

    df = spark.createDataFrame(texts, "t string, g string")
    assert [r["x"] for r in df.select(T.strip_fillers(F.col("t"), F.col("g")).alias("x")).collect()] == [loop(*t) for t in texts]


def test_small_functions(spark):
    row = spark.sql("select 'x' as x, cast('NaN' as double) as nan, -3.0D as lp, 1.0005D as s, 1.5D as big").select(
        T.degenerate(F.lit("aaaab")).alias("a"), T.degenerate(F.lit("中文中文")).alias("b"), T.degenerate(F.lit("ok")).alias("c"), T.logprob_confidence(F.col("nan")).alias("d"), T.logprob_confidence(F.col("lp")).alias("e"),
        T.seconds_to_ms(F.col("s")).alias("f"), T.timecode(F.lit(-4)).alias("g"), T.timecode(F.lit(360_000_001), centis=True).alias("h"), T.safe_filename(F.lit("nul.txt")).alias("i"), T.safe_filename(F.lit(" . ")).alias("j"),
        T.language_name(F.lit(" EN ")).alias("k"), T.mime_by_extension(F.lit("noext")).alias("l"), T.word_count(F.lit(" a b ")).alias("m"), T.target_languages(F.lit("es,xx, EN,es"), F.lit("en")).alias("n"),
        F.length(T.safe_filename(F.lit("y" * 300 + ".mp4"))).alias("o"), T.stage_of(F.lit("T15_translate")).alias("p"),
    ).first()
    assert tuple(row) == (True, True, False, None, 0.5, 1000, "00:00:00,000", "100:00:00.00", "_nul.txt", "file", "English", "application/octet-stream", 2, ["es"], 200, "TRANSLATING")


def test_glossary_round_trip(spark):
    terms = F.array(*[F.struct(F.lit(a).alias("term"), F.lit(b).alias("replacement")) for a, b in (("cat", "gato"), ("cat flap", "gatera"), ("dog", "perro"))])
    p = T.protect_glossary(F.lit("a cat and a cat flap"), terms)
    row = spark.range(1).select(p.alias("p")).select("p.text", T.restore_glossary(F.col("p.text"), F.col("p.tokens")).alias("r")).first()
    assert tuple(row) == ("a __G1__ and a __G0__", "a gato and a gatera")


def test_resolve_cue_timing_reads_whole_turns(spark, tmp_path):
    from tracklake import registry

    texts = ["x" * 30, "y" * 800, "z" * 700, ""]
    spark.createDataFrame([(1, i, "user", t) for i, t in enumerate(texts)], "conv_id long, turn long, role string, text string").write.parquet(f"{tmp_path}/conversations.parquet")
    at, cues = 1000, []
    for i, t in enumerate(texts):
        end = at + 400 + len(t) * 4
        text = " <b>{x}</b>\r\n\r\n & " + t if i % 5 == 0 else t[:30] + "\n" + t[30:]
        cues.append((at - 1200, (at if (13 + i * 29) % 100 % 9 == 0 else end) - 1200, text))
        at = end + ((31 + i * 17) % 5 + 1) * 150
    got = registry.QUERIES["resolve_cue_timing"](spark, str(tmp_path)).collect()
    assert sorted((r["start_ms"], r["end_ms"]) for r in got) == repaired(cues)


def test_wrapping_is_one_pattern_over_a_text(spark):
    texts = ["x" * 41 + " a b", "x" * 42 + " a", "x" * 43 + " a", "😀" * 45 + " é\u2028z", "$1 \\n " * 30, "a\x85c", None]
    df = spark.createDataFrame([(t,) for t in texts], "t string").withColumn("b", C.wrap_blocks(F.col("t")))
    assert [r["b"] for r in df.collect()] == [wrap(t or "") for t in texts]
    assert "aggregate(" not in df._jdf.queryExecution().optimizedPlan().toString()


def test_all_formats_gather_the_cues_once(spark):
    rows = [(1, "en", 1, 50, 90, "b"), (1, "en", 0, 50, 90, "a"), (1, None, 0, 0, 5, "c"), (2, "en", 0, 5, 5, "nothing")]
    df = spark.createDataFrame(rows, "media_id long, language string, cue_index long, start_ms long, end_ms long, text string")
    out = C.export_all(df)
    plan = out._jdf.queryExecution().sparkPlan().toString()
    assert "Join" not in plan and "Window" not in plan and plan.count("Scan ExistingRDD") == 1
    got = {(r["media_id"], r["language"], r["format"]): r["content"] for r in out.collect()}
    assert len(got) == 9 and got[2, "en", "srt"] == "" and got[1, None, "srt"].endswith("\nc\n")
    assert got[1, "en", "srt"] == "1\n00:00:00,050 --> 00:00:00,090\na\n\n2\n00:00:00,050 --> 00:00:00,090\nb\n"
