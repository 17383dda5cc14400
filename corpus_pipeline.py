"""The corpus pipeline: quality rules, exact dedup, near-duplicate removal, source
mixing and packing, each over all documents that the stage before kept.

A stage takes (spark, docs, sf_dir); its result is written as Parquet and read
again as the next stage's ``docs``.  All but the last return the columns of
``docs``.  Mixing returns a document as often as it is taken; packing returns a
row for each piece of a document with its bin."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from rollcall.llm import best_fit_packing, common, exact_dedup, ngram_join, quality_rules, source_mixing


def rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return quality_rules.keep_good(spark, docs)


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return exact_dedup.keep_first(spark, docs)


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return ngram_join.keep_one(spark, docs)


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return source_mixing.take_mix(spark, docs)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return best_fit_packing.best_fit_packing(spark, docs)


STAGES = [("quality_rules", rules), ("exact_dedup", exact), ("ngram_join", near), ("source_mixing", mixed), ("packing", packed)]

#: The quantile sketches, the random rounding and the order of placements cannot be put in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(common.table(sf_dir, "documents"))
    for name, stage in STAGES:
        docs = common.stage_table(spark, stage(spark, docs, sf_dir), f"pipeline-{name}")
    return docs
