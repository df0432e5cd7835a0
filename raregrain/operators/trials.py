"""Parameter trials: expanding grids, ranking scores, summarising results."""
from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from raregrain.functions.columns import hash32, mean_pm_std


def expand_lists(lists: DataFrame, names: list[str]) -> DataFrame:
    """One row of value arrays -> one row per combination: (trial_key, params map)."""
    out = lists
    for n in names:
        out = out.withColumn(n, F.explode(n))
    params = F.create_map(*[x for n in names for x in (F.lit(n), F.col(n).cast("string"))])
    return out.select(F.concat_ws("|", *[F.col(n).cast("string") for n in names]).alias("trial_key"), params.alias("params"))


def expand_grid(spark: SparkSession, grid: dict[str, list]) -> DataFrame:
    """Dict of lists -> trial rows."""
    names = list(grid)
    if not names:
        return spark.createDataFrame([("", {})], "trial_key string, params map<string,string>")
    one = spark.createDataFrame([tuple([str(v) for v in grid[n]] for n in names)], ", ".join(f"`{n}` array<string>" for n in names))
    return expand_lists(one, names)


def random_trials(trials: DataFrame, n: int, seed=1000, key: str = "trial_key") -> DataFrame:
    """n trials of the grid, by seeded hash order."""
    return trials.orderBy(hash32(seed, key), key).limit(n)


def with_folds(trials: DataFrame, k: int = 5) -> DataFrame:
    """Every trial on every fold."""
    return trials.withColumn("fold", F.explode(F.sequence(F.lit(0), F.lit(k - 1))))


def fold_summary(scores: DataFrame, keys: list[str]) -> DataFrame:
    """Mean and population std over folds."""
    return scores.groupBy(*keys, "metric").agg(F.avg("value").alias("mean_score"), F.stddev_pop("value").alias("std_score"))


def leaderboard(scores: DataFrame, trial: str = "trial") -> DataFrame:
    """Mean, population std and competition rank (1, 1, 3) of every trial per metric."""
    w = Window.partitionBy("metric").orderBy(F.col("mean_score").desc())
    return fold_summary(scores, [trial]).withColumn("place", F.rank().over(w).cast("int"))


def best_trial(board: DataFrame, metric: str, trial: str = "trial") -> DataFrame:
    """The trial with the best mean of one metric; the first trial wins a tie."""
    return board.filter(F.col("metric") == metric).orderBy(F.col("mean_score").desc(), trial).limit(1)


def best_per_group(board: DataFrame, groups: list[str], metric: str, trial: str = "trial") -> DataFrame:
    """Best trial per (classifier, data set)."""
    m = board.filter(F.col("metric") == metric)
    best = m.groupBy(*groups).agg(F.min(F.struct((-F.col("mean_score")).alias("s"), F.col(trial).alias("t"))).alias("b"))
    return best.select(*groups, F.col("b.t").alias(trial), (-F.col("b.s")).alias("best"))


def summarise(scores: DataFrame, groups: list[str], metric: str = "geometric_mean_score", related: str = "roc_auc_score",
              trial: str = "trial") -> DataFrame:
    """Best trial per group with its related score, miss rate and printable cells."""
    board = fold_summary(scores, [*groups, trial])
    wide = board.groupBy(*groups, trial).agg(
        *[F.max(F.when(F.col("metric") == m, F.col(c))).alias(f"{m}_{s}")
          for m in (metric, related, "sensitivity_score") for c, s in (("mean_score", "mean"), ("std_score", "std"))])
    best = best_per_group(board, groups, metric, trial).select(*groups, trial)
    return wide.join(best, [*groups, trial]).select(
        *groups, trial, F.col(f"{metric}_mean").alias("best"), F.col(f"{related}_mean").alias("related"),
        (F.lit(1.0) - F.col("sensitivity_score_mean")).alias("miss_rate"),
        mean_pm_std(f"{metric}_mean", f"{metric}_std").alias("best_text"),
        mean_pm_std(F.lit(1.0) - F.col("sensitivity_score_mean"), "sensitivity_score_std", 1).alias("miss_text"))
