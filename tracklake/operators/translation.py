"""Translation preparation and checks; the model itself is a plugged batch function (tracklake.udfs)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracklake.functions.text import adapt, adaptation_fit, text_of


def checked(segments: DataFrame) -> DataFrame:
    """segments (media_id, segment_index, start_ms, end_ms, source_lang, target_lang, text, translated) with adapted_text,
    fit, errors, warnings and ok. A blank translation of a text that is not blank, or bad times, are errors; the text falls
    back to the source."""
    same = F.col("source_lang") == F.col("target_lang")
    got = F.when(same, F.col("text")).otherwise(F.col("translated"))
    adapted = F.when(same, F.trim(text_of(F.col("text")))).otherwise(adapt(text_of(got), F.col("target_lang")))
    blank = lambda c: F.trim(text_of(c)) == ""
    rows = segments.withColumns({"_got": got, "_adapted": adapted}).withColumn("fit", adaptation_fit(F.col("_adapted"), F.col("text"), F.col("end_ms") - F.col("start_ms")))
    errors = F.array_compact(F.array(
        F.when(blank(F.col("_got")) & ~blank(F.col("text")), F.lit("blank_translation")), F.when(blank(F.col("_adapted")) & ~blank(F.col("text")), F.lit("blank_adaptation")),
        F.when(F.col("start_ms") < 0, F.lit("negative_start")), F.when(F.col("end_ms") <= F.col("start_ms"), F.lit("end_before_start")),
    ))
    out = rows.withColumns({"errors": errors, "warnings": F.col("fit.warnings"), "adapted_text": F.coalesce(F.nullif("_adapted", F.lit("")), text_of(F.col("text")))})
    return out.withColumn("ok", F.size("errors") == 0).drop("_got", "_adapted")
