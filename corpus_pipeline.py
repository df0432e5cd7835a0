"""From raw documents to a training mix: toxic texts go, near-duplicates and benchmark leaks go, secrets are masked, sources are mixed.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; its rows are written as Parquet and read
again as the next stage's documents. All but the last return the columns of `documents`.
"""
from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from raregrain.llm import decontam, lsh_forest, mix_schedule, nb_toxicity, random_battery
from raregrain.llm.common import table
from raregrain.session import cut_lineage


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier, trained on the labelled ones, does not reject."""
    return nb_toxicity.without_toxic(docs, nb_toxicity.fit(docs, table(spark, sf_dir, "labels")))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates (five-word shingles, similarity of 0.8 or more)."""
    return lsh_forest.one_per_group(docs, percent=80, base=3)


def drop_benchmark_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a passage of a benchmark item."""
    return decontam.without_benchmark(docs, table(spark, sf_dir, "benchmark"))


def mask_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, secrets in their texts replaced by a mark."""
    return random_battery.without_secrets(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document's size and how many of its words the mix takes."""
    return mix_schedule.taken(docs)


STAGES = [
    ("toxicity", drop_toxic), ("near_duplicates", drop_near_duplicates), ("decontamination", drop_benchmark_leaks),
    ("secrets", mask_secrets), ("mixing", mix_sources),
]
#: Classifier and MinHash have no SQL form; tests compare the stages with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = cut_lineage(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
