"""Language ranking and decision from class scores."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def lid_topk(logits: DataFrame, codes: list[str], k: int = 3, key: str = "doc_id", column: str = "logits") -> DataFrame:
    """(key, rank from 0, code, confidence) of the k likeliest classes: stable softmax, ties to the lower class.

    Rank 0 is the primary language, the others its alternatives. NaN scores count as probability 0.
    """
    k = min(k, len(codes))
    clean = F.transform(column, lambda x: F.when(F.isnan(x) | x.isNull(), F.lit(float("-inf"))).otherwise(x.cast("double")))
    top = F.array_max("_l")
    weights = F.transform("_l", lambda x, i: F.struct((-F.exp(x - top)).alias("w"), i.alias("i")))
    rows = logits.select(key, clean.alias("_l")).withColumn("_e", weights)
    total = F.aggregate("_e", F.lit(0.0), lambda a, e: a - e["w"])
    rows = rows.select(key, total.alias("_t"), F.posexplode(F.slice(F.sort_array("_e"), 1, k)).alias("rank", "e"))
    name = F.element_at(F.array(*map(F.lit, codes)), F.col("e.i") + 1)
    return rows.select(key, F.col("rank").cast("long"), name.alias("code"), F.round(-F.col("e.w") / F.col("_t"), 6).alias("confidence"))


def lid_decision(primary: DataFrame, min_conf: float = 0.4, override: str | None = None, strict: bool = False, key: str = "doc_id") -> DataFrame:
    """(key, language, confidence, strategy) from (key, code, confidence, silent): silent media are `und`; below min_conf
    the override with confidence 0, else `und`, or an error if strict."""
    low = F.coalesce(F.col("confidence") < min_conf, F.lit(True))
    if override is not None:
        weak = (F.lit(override.strip().lower()), F.lit(0.0), F.lit("override"))
    elif strict:
        weak = (F.lit(None).cast("string"), F.col("confidence"), F.lit("error_low_confidence"))
    else:
        weak = (F.lit("und"), F.col("confidence"), F.lit("undetermined"))
    pick = lambda quiet, i, sure: F.when(F.col("silent"), quiet).when(low, weak[i]).otherwise(sure)
    return primary.select(
        key, pick(F.lit("und"), 0, F.col("code")).alias("language"), pick(F.lit(0.0), 1, F.col("confidence")).alias("confidence"),
        pick(F.lit("silent"), 2, F.lit("detected")).alias("strategy"))
