"""A training-data pipeline over ``documents``: toxicity, line dedup, near-duplicates,
benchmark decontamination, mixing.  Every stage reads what the one before it has written."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from dealgrid.llm import decontaminate, jaccard_join, line_dedup, source_mix, toxicity
from dealgrid.llm.common import table, written

# The stages learn a model and join fuzzily: SQL cannot express them.
ORACLE_SQL = None


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the machine learned from the labels rejects go."""
    return toxicity.without_toxic(docs, toxicity.train(docs, table(spark, sf_dir, "labels")))


def drop_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines that five documents or more share stay in one of them; n_chars follows the text."""
    out = line_dedup.dedup_lines(docs)
    return out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else out


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of linked documents the one with the smallest doc_id stays.  Rows
    with a null doc_id stay; of rows that repeat a doc_id one stays."""
    classes = written(jaccard_join.jaccard_classes(docs).where("doc_id is not null").select("doc_id", "component_id"), "near-classes")
    gone = classes.where("doc_id <> component_id").select(F.col("doc_id").alias("__gone")).distinct()
    twice = classes.groupBy("doc_id").count().where("count > 1").select(F.col("doc_id").alias("__twice"))
    left = docs.join(gone, F.col("doc_id") == F.col("__gone"), "left_anti")
    if twice.isEmpty():
        return left
    one = left.join(twice, F.col("doc_id") == F.col("__twice"), "left_semi").dropDuplicates(["doc_id"])
    return left.join(twice, F.col("doc_id") == F.col("__twice"), "left_anti").unionByName(one)


def drop_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item go."""
    return decontaminate.without_leaks(docs, table(spark, sf_dir, "benchmark"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """How many words of each document the mix takes."""
    return source_mix.mix(docs, source_mix.label_weights(table(spark, sf_dir, "labels")))


STAGES = [("toxicity", drop_toxic), ("line_dedup", drop_repeated_lines), ("ngram_jaccard_join", drop_near_copies),
          ("benchmark_decontamination", drop_benchmark), ("source_mixing", mix_sources)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
