"""Saving and re-reading trial results."""
from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from raregrain.functions.columns import bare_param_name


def leaderboard_table(board: DataFrame, scores: DataFrame, folds: list[int], metrics: list[str]) -> DataFrame:
    """One wide row per trial: split{i}_test_{m}, mean_test_{m}, std_test_{m}, rank_test_{m}."""
    splits = scores.select("trial", F.format_string("split%d_test_%s", "fold", "metric").alias("cell"), F.col("value"))
    kinds = [board.select("trial", F.concat(F.lit(f"{s}_test_"), "metric").alias("cell"), F.col(c).cast("double").alias("value"))
             for s, c in (("mean", "mean_score"), ("std", "std_score"), ("rank", "place"))]
    names = [f"split{i}_test_{m}" for m in metrics for i in folds]
    names += [f"{s}_test_{m}" for m in metrics for s in ("mean", "std", "rank")]
    cells = splits
    for k in kinds:
        cells = cells.unionByName(k)
    return cells.groupBy("trial").pivot("cell", names).agg(F.first("value"))


def write_leaderboard(wide: DataFrame, path: str, fmt: str = "csv") -> None:
    writer = wide.write.mode("overwrite")
    writer.option("header", True).csv(path) if fmt == "csv" else writer.parquet(path)


def best_params(trials: DataFrame, best: DataFrame, prefix: str = "model__") -> DataFrame:
    """Key,value rows of the best trial, the pipeline prefix stripped."""
    return trials.join(best.select("trial"), "trial").select(F.explode("params").alias("key", "value")).select(
        bare_param_name("key", prefix).alias("name"), "value")


def write_best_params(trials: DataFrame, best: DataFrame, path: str) -> None:
    best_params(trials, best).write.mode("overwrite").csv(path)


def read_results(spark: SparkSession, pattern: str, schema: str, exclude: str | None = None) -> DataFrame:
    """All result files of a glob with their path; names matching `exclude` (any case) are left out."""
    df = spark.read.schema(schema).option("header", True).csv(pattern).select("*", F.col("_metadata.file_path").alias("file"))
    return df.filter(~F.col("file").rlike(f"(?i){exclude}")) if exclude else df


def finite_only(df: DataFrame, col: str) -> DataFrame:
    """Rows whose value is neither NULL nor NaN."""
    return df.filter(F.col(col).isNotNull() & ~F.isnan(col))
