"""Models as plugged batch functions, and helpers registered for SQL.

Each wrapper fixes the output schema; `load` makes the model once a Python worker's task, `fn` gets it with each batch.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SEGMENTS = "media_id long, window_index long, start_ms long, end_ms long, text string, avg_logprob double"
FRAMES = "media_id long, frame_index long, prob double"


def batched(df: DataFrame, fn: Callable, schema: str, load: Callable[[], object] | None = None) -> DataFrame:
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model = load() if load else None
        for pdf in batches:
            yield fn(model, pdf) if load else fn(pdf)

    return df.mapInPandas(run, schema)


def transcribe_windows(windows: DataFrame, fn: Callable, load: Callable[[], object] | None = None) -> DataFrame:
    """Windows to transcript segments; fn gives frames of SEGMENTS."""
    return batched(windows, fn, SEGMENTS, load)


def score_frames(blocks: DataFrame, fn: Callable, load: Callable[[], object] | None = None) -> DataFrame:
    """Audio blocks to frame probabilities; fn gives frames of FRAMES."""
    return batched(blocks, fn, FRAMES, load)


def score_language(df: DataFrame, fn: Callable[[pd.DataFrame], list], column: str = "logits") -> DataFrame:
    """df with an array of class scores; fn gives a list of them for a frame of rows."""
    schema = df.withColumn(column, F.array(F.lit(0.0))).schema
    return batched(df, lambda pdf: pdf.assign(**{column: fn(pdf)}), schema)


def embed_subsegments(spans: DataFrame, fn: Callable[[pd.DataFrame], list], column: str = "embedding") -> DataFrame:
    """Spans with an embedding; fn gives a list of vectors for a frame of rows."""
    schema = spans.withColumn(column, F.array(F.lit(0.0).cast("float"))).schema
    return batched(spans, lambda pdf: pdf.assign(**{column: fn(pdf)}), schema)


def translate_batch(misses: DataFrame, fn: Callable[[list[str], str, str], list[str]]) -> DataFrame:
    """Distinct (source_lang, target_lang, text) with `translated` and `status`.

    Give only cache misses; equal requests are translated once. A batch whose count of results differs, or that raises,
    has status partial for that language pair's rows and leaves the others alone.
    """
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for (source, target), g in pdf.groupby(["source_lang", "target_lang"]):
                try:
                    got = list(fn(g["text"].tolist(), source, target))
                    if len(got) != len(g):
                        raise ValueError("count")
                    yield g.assign(translated=got, status="ok")
                except Exception:  # noqa: BLE001  a model's failure is data here
                    yield g.assign(translated=None, status="partial")

    keys = misses.select("source_lang", "target_lang", "text").where("source_lang <> target_lang").distinct()
    return keys.mapInPandas(run, "source_lang string, target_lang string, text string, translated string, status string")


def register_sql(spark: SparkSession) -> None:
    """SQL functions: timecode(ms), logprob_confidence(x), and overlapping_windows(duration, window, overlap) as a table."""
    spark.sql("create or replace temporary function timecode(ms bigint) returns string return concat(lpad(cast(greatest(ms, 0L) div 3600000 as string), greatest(2, length(cast(greatest(ms, 0L) div 3600000 as string))), '0'), ':', lpad(cast(greatest(ms, 0L) div 60000 % 60 as string), 2, '0'), ':', lpad(cast(greatest(ms, 0L) div 1000 % 60 as string), 2, '0'), ',', lpad(cast(greatest(ms, 0L) % 1000 as string), 3, '0'))")
    spark.sql("create or replace temporary function logprob_confidence(x double) returns double return case when not isnan(x) and abs(x) < double('infinity') then greatest(0d, least(1d, (x + 6) / 6)) end")
    spark.sql("create or replace temporary function overlapping_windows(duration bigint, window bigint, overlap bigint) returns table(window_index bigint, start_ms bigint, end_ms bigint) return select k, k * (window - overlap), least(duration, k * (window - overlap) + window) from (select explode(sequence(0L, case when duration <= window then 0L else ceil((duration - window) / (window - overlap)) end)) as k) where least(duration, k * (window - overlap) + window) - k * (window - overlap) >= 500")
