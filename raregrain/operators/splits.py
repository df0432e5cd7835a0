"""Hold-outs and folds that keep groups whole and classes balanced."""
from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from raregrain.functions.columns import hash32
from raregrain.operators.ranking import hash_bucket, hash_rank, take_hashed
from raregrain.session import cut_lineage, join_by_key


def group_labels(df: DataFrame, key: str, group: str, target: str) -> DataFrame:
    """Each group with the label of its first row in key order."""
    return _labels(df, key, group, target).drop("_n")


def _labels(df: DataFrame, key: str, group: str, target: str) -> DataFrame:
    return df.groupBy(group).agg(F.min_by(target, key).alias("group_label"), F.count(F.lit(1)).alias("_n"))


def _stratum_quota(groups: DataFrame, test_share: float) -> DataFrame:
    """Test groups per label: proportional, left-over places to the largest fractions."""
    sizes = groups.groupBy("group_label").agg(F.count(F.lit(1)).alias("n"))
    every = Window.partitionBy(F.lit(0))  # one row per label
    total = F.sum("n").over(every)
    sized = sizes.withColumn("_all", total).withColumn("_test", F.ceil(F.col("_all") * F.lit(test_share) - F.lit(1e-9)))
    sized = sized.withColumn("_exact", F.col("_test") * F.col("n") / F.col("_all"))
    sized = sized.withColumn("_floor", F.floor("_exact"))
    left = F.col("_test") - F.sum("_floor").over(every)
    place = F.row_number().over(Window.partitionBy(F.lit(0)).orderBy((F.col("_floor") - F.col("_exact")), "group_label"))
    return sized.withColumn("_left", left).withColumn("_place", place).select(
        "group_label", (F.col("_floor") + F.when(F.col("_place") <= F.col("_left"), 1).otherwise(0)).cast("bigint").alias("quota"))


def group_holdout(df: DataFrame, key: str, group: str, target: str, ratio: float = 0.8, seed=42) -> DataFrame:
    """Add `split` ('train' or 'val'): whole groups, stratified by the group label."""
    groups = cut_lineage(_labels(df, key, group, target))
    flagged = take_hashed(groups, group, seed, _stratum_quota(groups, 1 - ratio), ["group_label"], flag="_val")
    side = flagged.select(group, F.when(F.col("_val"), "val").otherwise("train").alias("split"), "_n")
    return join_by_key(df, side, [group], "_n").drop("_n")


def group_folds(df: DataFrame, group: str, target: str, k: int = 5, seed=42) -> DataFrame:
    """Add `fold`: whole groups dealt to folds like cards, back and forth, richest groups first.

    Order is (positives desc, rows desc, hash). The position of a group is counted level
    by level (positives, then rows, then hash bucket), so no window holds all groups.
    """
    groups = df.groupBy(group).agg(F.sum(F.col(target).cast("bigint")).alias("_p"), F.count(F.lit(1)).alias("_n"))
    groups = cut_lineage(groups.withColumn("_h", hash32(seed, group)).withColumn("_b", hash_bucket("_h")))
    counts = groups.groupBy("_p", "_n", "_b").agg(F.count(F.lit(1)).alias("_c"))
    by_rows = counts.groupBy("_p", "_n").agg(F.sum("_c").alias("_c"))
    by_pos = by_rows.groupBy("_p").agg(F.sum("_c").alias("_c"))

    def before(levels: list[str], order):
        w = Window.partitionBy(*levels).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
        return F.coalesce(F.sum("_c").over(w), F.lit(0))

    # distinct numbers of positives per group: a short list
    o1 = by_pos.select("_p", before([], F.col("_p").desc()).alias("_o1"))
    o2 = by_rows.select("_p", "_n", before(["_p"], F.col("_n").desc()).alias("_o2"))
    o3 = counts.select("_p", "_n", "_b", before(["_p", "_n"], F.col("_b")).alias("_o3"))
    offsets = o3.join(o2, ["_p", "_n"]).join(o1, "_p")
    inside = Window.partitionBy("_p", "_n", "_b").orderBy("_h", group)
    placed = groups.join(offsets, ["_p", "_n", "_b"]).withColumn(
        "_at", F.row_number().over(inside) - 1 + F.col("_o1") + F.col("_o2") + F.col("_o3"))
    turn = F.col("_at") % (2 * k)
    fold = F.when(turn < k, turn).otherwise(2 * k - 1 - turn).cast("int")
    return join_by_key(df, placed.select(group, fold.alias("fold"), "_n"), [group], "_n").drop("_n")


def row_folds(df: DataFrame, key: str, target: str, k: int = 5, seed=42) -> DataFrame:
    """Add `fold`: rows of each class dealt in hash order; class counts differ by at most one."""
    ranked = hash_rank(df, key, seed, [target], "_r")
    return ranked.withColumn("fold", ((F.col("_r") - 1) % k).cast("int")).drop("_r")


def fold_sides(folded: DataFrame, fold: int) -> tuple[DataFrame, DataFrame]:
    """(train, test) rows of one fold."""
    return folded.filter(F.col("fold") != fold), folded.filter(F.col("fold") == fold)


def holdout_size(n: int, ratio: float) -> int:
    return math.ceil(n * (1 - ratio) - 1e-9)
