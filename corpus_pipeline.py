"""From raw documents to training tokens, in five stages.

Each stage takes what the one before kept. Rows are told apart by themselves, not by doc_id, which may be null or
repeated. Other columns than those of `documents` are left out at the start.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marlstone.llm import bpe, common, decontaminate, language, near_dup, substring_dedup

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]
#: A document stays if its main language has at least this share of it.
LEAST_SHARE = 0.5
#: Words of a passage that is removed wherever it repeats.
PASSAGE_WORDS = 50


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without letters or without a main language go; a missing lang is filled in."""
    common.short_batches(spark)
    docs = docs.select(*COLUMNS)
    langs, log_p = language.learn(docs, "lang", "text")
    keyed = docs.withColumn("_digest", substring_dedup.digest("text"))
    found = common.written(language.predict(keyed, langs, log_p, id_col="_digest").select("_digest", "lang_pred", "score").distinct(), "languages")
    rejected = found.filter((F.col("lang_pred") == "und") | (F.col("score") < LEAST_SHARE)).select("_digest")
    kept = common.without(keyed, rejected, "_digest")
    missing = keyed.filter("lang is null").select("_digest")
    if missing.isEmpty():
        return kept.select(*COLUMNS)
    named = found.join(missing.distinct(), "_digest", "left_semi").groupBy("_digest").agg(F.first("lang_pred").alias("_lang"))
    return kept.join(named, "_digest", "left").withColumn("lang", F.coalesce("lang", "_lang")).select(*COLUMNS)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of near-duplicates stays: that with the smallest id, then the smallest digest of the text."""
    common.short_batches(spark)
    # Written, so that a row has the same number whenever it is read.
    keyed = common.written(docs.select(*COLUMNS, F.monotonically_increasing_id().alias("_row")), "near-docs")
    surplus = near_dup.surplus_rows(keyed.withColumn("_digest", substring_dedup.digest("text")), "_digest", "_row")
    return common.without(keyed, surplus, "_row").select(*COLUMNS)


def substring_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Passages that repeat go from the texts; a document stays, with the text that is left."""
    common.short_batches(spark)
    cut = substring_dedup.remove_repeats(docs.select(*COLUMNS), window=PASSAGE_WORDS)
    return cut.withColumn("n_chars", F.when(F.col("n_removed") > 0, F.length("text").cast("long")).otherwise(F.col("n_chars"))).select(*COLUMNS)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item go."""
    common.short_batches(spark)
    keyed = docs.withColumn("_digest", substring_dedup.digest("text"))
    found = decontaminate.matches(keyed, common.table(spark, sf_dir, "benchmark"), id_col="_digest")
    return common.without(keyed, found.select("_digest"), "_digest").select(*COLUMNS)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, ids, and the digests of ids and decoded text."""
    common.short_batches(spark)
    return bpe.round_trip(docs, keep_ids=True)


STAGES = [
    ("language_id", language_id),
    ("near_dedup", near_dedup),
    ("substring_dedup", substring_dedup_stage),
    ("decontamination", decontamination),
    ("bpe", tokens),
]

#: SQL expresses neither the learned stage nor the vocabulary's merges.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages over documents; each one's result is written before the next one reads it."""
    docs = common.table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = common.written(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
