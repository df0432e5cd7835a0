"""Losses over a scored table; `logit` and `target` are columns."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from raregrain.functions.columns import log_sum_exp, softplus
from raregrain.operators.weights import with_class_counts


def bce_per_row(logit: str = "logit", target: str = "target", pos_weight: float = 1.0) -> Column:
    """Binary cross entropy of a logit, positives weighted."""
    x, y = F.col(logit), F.col(target).cast("double")
    return F.lit(pos_weight) * y * softplus(-x) + (F.lit(1.0) - y) * softplus(x)


def bce(scored: DataFrame, pos_weight: float = 1.0, by: list[str] = ()) -> DataFrame:
    return scored.groupBy(*by).agg(F.avg(bce_per_row(pos_weight=pos_weight)).alias("loss"))


def focal_of_mean(scored: DataFrame, alpha: float = 1.0, gamma: float = 2.0, pos_weight: float = 1.0,
                  by: list[str] = ()) -> DataFrame:
    """alpha * (1 - exp(-B))^gamma * B where B is the mean cross entropy."""
    b = F.col("loss")
    return bce(scored, pos_weight, by).withColumn("loss", F.lit(alpha) * F.pow(F.lit(1.0) - F.exp(-b), F.lit(gamma)) * b)


def _two_logit_ce(l0: Column, l1: Column, y: Column) -> Column:
    return log_sum_exp(l0, l1) - F.when(y == 1, l1).otherwise(l0)


def focal_per_row(scored: DataFrame, gamma: float = 0.0, weights: tuple[float, float] = (1.0, 1.0),
                  by: list[str] = ()) -> DataFrame:
    """Mean of (1 - e^-c)^gamma * c, c being the class-weighted cross entropy of logits [1-x, x]."""
    x, y = F.col("logit"), F.col("target")
    c = F.when(y == 1, F.lit(weights[1])).otherwise(F.lit(weights[0])) * _two_logit_ce(F.lit(1.0) - x, x, y)
    return scored.groupBy(*by).agg(F.avg(F.pow(F.lit(1.0) - F.exp(-c), F.lit(gamma)) * c).alias("loss"))


def ldam(scored: DataFrame, max_m: float = 0.5, s: float = 30.0, weights: tuple[float, float] = (1.0, 1.0)) -> DataFrame:
    """Margin loss: class margins n_c^(-1/4), the largest scaled to max_m, taken off the true logit."""
    d = with_class_counts(scored, "target")
    x, y = F.col("logit"), F.col("target")
    rarest = F.pow(F.least("n_neg", "n_pos").cast("double"), F.lit(-0.25))
    own = F.pow(F.when(y == 1, F.col("n_pos")).otherwise(F.col("n_neg")).cast("double"), F.lit(-0.25))
    margin = own * F.lit(max_m) / rarest
    l0 = F.lit(s) * (F.lit(1.0) - x - F.when(y == 0, margin).otherwise(F.lit(0.0)))
    l1 = F.lit(s) * (x - F.when(y == 1, margin).otherwise(F.lit(0.0)))
    w = F.when(y == 1, F.lit(weights[1])).otherwise(F.lit(weights[0]))
    return d.agg((F.sum(w * _two_logit_ce(l0, l1, y)) / F.sum(w)).alias("loss"))
