"""Empirical-Bayes shrinkage of rates: beta priors by the method of moments, posterior bounds."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

MIN_STRENGTH, MAX_STRENGTH = 2.0, 1000.0
Z = 1.645


def grand_mean(units: DataFrame) -> float:
    """Smoothed mean of all outcomes; 0.5 without any. `units`: one row per unit with n and bad."""
    r = units.agg(F.sum("n").alias("n"), F.sum("bad").alias("bad")).first()
    return ((r["bad"] or 0) + 0.5) / ((r["n"] or 0) + 1.0)


def strength(units: DataFrame, mean: Column) -> float:
    """Prior strength (pseudo-outcomes) of units around their prior means.

    The weighted spread of the units' rates in excess of binomial noise gives the variance
    between units; none in excess, or fewer than two units with outcomes, gives the greatest strength.
    One row of sums reaches the driver.
    """
    seen = units.filter(F.col("n") > 0).select(F.col("n").cast("double").alias("n"), "bad", mean.alias("m"))
    gap = F.col("bad") / F.col("n") - F.col("m")
    noise = F.col("m") * (1 - F.col("m"))
    r = seen.agg(F.count(F.lit(1)).alias("k"), F.sum("n").alias("n"), F.sum(F.col("n") * F.col("n")).alias("nn"),
                 F.sum(F.col("n") * gap * gap).alias("ss"), F.sum(noise).alias("v")).first()
    if r["k"] < 2:
        return MAX_STRENGTH
    excess = (r["ss"] - r["v"] * (r["k"] - 1) / r["k"]) / max(r["n"] - r["nn"] / r["n"], 1.0)
    if excess <= 0:
        return MAX_STRENGTH
    return min(max(r["v"] / r["k"] / excess - 1.0, MIN_STRENGTH), MAX_STRENGTH)


def posterior(units: DataFrame, mean: Column, s: float, z: float = Z) -> DataFrame:
    """Adds the shrunk rate and the lower end of its posterior (normal approximation of the beta)."""
    a, b = F.col("bad") + F.lit(s) * mean, F.col("n") - F.col("bad") + F.lit(s) * (1 - mean)
    return units.withColumn("rate", a / (a + b)).withColumn(
        "low", a / (a + b) - F.lit(z) * F.sqrt(a * b / ((a + b) * (a + b) * (a + b + 1))))
