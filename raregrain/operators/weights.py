"""Class counts and class weights of a binary label."""
from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def class_counts(df: DataFrame, target: str = "target") -> DataFrame:
    """One row: majority and minority counts and the rarest label (ties go to the smaller label)."""
    y = F.col(target)
    return df.agg(F.count_if(y == 0).alias("n_neg"), F.count_if(y == 1).alias("n_pos")).withColumn(
        "rarest", F.when(F.col("n_pos") < F.col("n_neg"), F.lit(1)).otherwise(F.lit(0)))


def class_sizes(df: DataFrame, target: str = "target") -> tuple[int, int]:
    """(negatives, positives) as driver numbers, for code that sizes a draw from them."""
    row = class_counts(df, target).first()
    return row["n_neg"], row["n_pos"]


def with_class_counts(df: DataFrame, target: str = "target") -> DataFrame:
    """Attach the class counts to every row as scalar subqueries (no shuffle of the rows)."""
    totals = class_counts(df, target)
    return df.withColumns({"n_neg": totals.select("n_neg").scalar(), "n_pos": totals.select("n_pos").scalar()})


def class_weights(df: DataFrame, target: str = "target") -> DataFrame:
    """pos_weight, the pair total/count, and the 'balanced' pair n / (2 * count)."""
    neg, pos = F.col("n_neg").cast("double"), F.col("n_pos").cast("double")
    total = neg + pos
    return class_counts(df, target).select(
        "n_neg", "n_pos", "rarest", F.try_divide(neg, pos).alias("pos_weight"),
        F.try_divide(total, neg).alias("weight_neg"), F.try_divide(total, pos).alias("weight_pos"),
        F.try_divide(total, neg * 2).alias("balanced_neg"), F.try_divide(total, pos * 2).alias("balanced_pos"))


def with_weight(df: DataFrame, target: str = "target", scheme: str | dict = "balanced", name: str = "weight") -> DataFrame:
    """Row weight column: 'balanced' or an explicit {label: weight} map."""
    y = F.col(target)
    if isinstance(scheme, dict):
        return df.withColumn(name, F.when(y == 1, F.lit(float(scheme[1]))).otherwise(F.lit(float(scheme[0]))))
    w = class_weights(df, target)
    return df.withColumn(name, F.when(y == 1, w.select("balanced_pos").scalar()).otherwise(w.select("balanced_neg").scalar()))
