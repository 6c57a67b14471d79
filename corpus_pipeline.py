"""From raw documents to token files: quality rules, near-duplicates, benchmark passages, mixing, tokens."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tracklake.llm import common, decontaminate, mixing, quality_rules, simhash, tokens

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the quality rules."""
    return quality_rules.keep_good(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate group."""
    return simhash.keep_one(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that share no span with the benchmark."""
    return decontaminate.drop_contaminated(docs, common.table(spark, sf_dir, "benchmark"))


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, in the order of the mix: each source's target is its own share of them, so every block gets a slot."""
    return mixing.keep_mixed(docs)


def token_output(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token files in the order of the mix, as its files have it, read back: one row for each document."""
    return tokens.digests(tokens.write_and_read(docs, order=common.written_order()))


STAGES = [
    ("quality_rules", quality),
    ("simhash_near_dedup", near_dedup),
    ("benchmark_decontamination", decontamination),
    ("mixing", mix),
    ("token_output", token_output),
]

#: Hashing, winnowing and tokenizing have no SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents; what a stage returns is written and read again before the next one.

    What a stage wrote on its way goes when its result is written.
    """
    docs = common.table(spark, sf_dir, "documents").select(*COLUMNS)
    for _, stage in STAGES[:-1]:
        path = common.new_path(spark)
        with common.scratch(spark):
            docs = common.cut(stage(spark, docs, sf_dir), path)
    return STAGES[-1][1](spark, docs, sf_dir)
