"""One query for each operator, over whole tables, and SQL where SQL can say the same."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tracklake.llm import conversation_repair, decontaminate, filter_audit, language_id, mixing, pii, quality_classifier, quality_rules, secret_scan, simhash, substring_dedup, tokens, url_filters
from tracklake.llm.common import held_out, table


def listed(spans: str) -> Column:
    """kind:start:end of an array of spans, comma-joined."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def counted(spans: str, kind: str) -> Column:
    return F.size(F.filter(spans, lambda s: s["kind"] == kind)).cast("long")


def op1_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = secret_scan.secret_spans(table(spark, sf_dir, "documents"))
    kinds = [counted("base", k).alias(f"n_{k}") for k in ("assign", "access", "hex")]
    return out.select("doc_id", *kinds, F.sha2(listed("base"), 256).alias("base_sha256"), listed("spans").alias("spans"))


def op2_token_output(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokens.digests(tokens.write_and_read(table(spark, sf_dir, "documents")))


def op3_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = mixing.mix(table(spark, sf_dir, "documents").select("doc_id", "source"))
    return out.select("doc_id", "source", *[F.col(f"_tl_{c}").alias(c) for c in ("rank", "block", "slot", "release", "deadline", "mixed")])


def op4_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = substring_dedup.remove_repeats(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


def op5_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang").withColumn("held_out", held_out())
    model = language_id.fit(docs.where(~F.col("held_out")))
    return language_id.predict(docs.select("doc_id", "text", "held_out"), model)


def op6_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = decontaminate.decontaminate(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return out.select(
        "doc_id", "n_words", "n_hit", F.size("item_ids").cast("long").alias("n_items"),
        F.sha2(F.array_join("item_ids", ","), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"),
    )


def op7_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = pii.pii_spans(table(spark, sf_dir, "documents"))
    kinds = [counted("base", k).alias(f"n_{k}") for k in pii.KINDS[:4]]
    return out.select("doc_id", *kinds, F.sha2(listed("base"), 256).alias("base_sha256"), listed("spans").alias("spans"))


def op8_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = simhash.near_duplicates(table(spark, sf_dir, "documents"))
    return out.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op9_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = quality_rules.quality_rules(table(spark, sf_dir, "documents").select("doc_id", "text", "lang"))
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def op10_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text").withColumn("held_out", held_out())
    trusted = table(spark, sf_dir, "labels").where("quality = 1").select(F.col("doc_id").alias("labelled_id")).distinct()
    train = docs.where(~F.col("held_out"))
    model = quality_classifier.fit(
        train.join(trusted, F.col("doc_id") == F.col("labelled_id"), "left_semi"), train.join(trusted, F.col("doc_id") == F.col("labelled_id"), "left_anti")
    )
    return quality_classifier.predict(docs, model)


def op11_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_audit.filter_audit(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


URL_RULES = [url_filters.Rule("block", "net", "/"), url_filters.Rule("allow", "example.net", "/en/"), url_filters.Rule("block", "example.com", "/de/"), url_filters.Rule("allow", "org", "/fr/")]


def op12_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filters.url_filter(table(spark, sf_dir, "pages").select("page_id", "url"), URL_RULES)


def op13_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    given = table(spark, sf_dir, "conversations")
    out = conversation_repair.repair(conversation_repair.damaged(given)).withColumnRenamed("conv_id", "_conv")
    every = given.select("conv_id").distinct().join(out, F.col("conv_id").eqNullSafe(F.col("_conv")), "left")
    counts = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")
    nothing = {"audit": F.lit(""), "repaired_sha256": F.sha2(F.lit(""), 256)} | {c: F.lit(0).cast("long") for c in counts}
    return every.select("conv_id", *[F.coalesce(c, nothing[c]).alias(c) for c in (*counts, "audit", "repaired_sha256")])


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f for f in (
        op1_secret_scan, op2_token_output, op3_source_mixing, op4_substring_dedup, op5_language_id, op6_benchmark_decontamination, op7_pii, op8_simhash_near_dedup, op9_quality_rules,
        op10_quality_classifier, op11_filter_audit, op12_url_filters, op13_conversation_repair,
    )
}
