"""Random forests of few features from the counts of their bins.

A tree sees of a row only the bin of each feature, its label and how often the bootstrap draws it. Rows that share bins and label
are therefore counted once (`Binning.cells`), and a tree's draws of a cell with n rows, the sum of n Poisson(1) numbers, are one
Poisson(n) number. MLlib grows every tree from these weighted cells, whose number does not depend on the rows. A row's
score is its cell's, so the trees score cells too.
"""
from __future__ import annotations

import math
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass, field
from functools import reduce

import numpy as np
import pandas as pd
from pyspark import inheritable_thread_target
from pyspark.ml.classification import RandomForestClassifier
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from raregrain.session import cut_lineage, join_by_key

#: Bins of a feature, as in MLlib.
MAX_BINS = 32
#: Quantiles that tell a feature with few values from others.
GRID = 1024
#: Bin combinations that the features may have.
MOST_CELLS = 1 << 17
THREADS = 4
#: Spares MLlib a pass for the number of classes, which a tree's own draws may not show.
LABELS = {"ml_attr": {"type": "nominal", "name": "target", "vals": ["0", "1"]}}


def split_points(quantiles: list[float], max_bins: int = MAX_BINS) -> list[float]:
    """Thresholds of a feature from its evenly spaced quantiles: between all its values if they are few, else evenly by rows.

    A quarter of the bin at either end is cut off, as rare classes often lie there. MLlib's thresholds, from a sample, have such a cut
    at the upper end or not by chance.
    """
    values = sorted(set(quantiles))
    if len(values) <= max_bins:
        return [(a + b) / 2 for a, b in zip(values, values[1:])]
    last = len(quantiles) - 1
    return sorted({quantiles[round(i * last / max_bins)] for i in (0.25, *range(1, max_bins), max_bins - 0.25)} - {values[-1]})


@dataclass
class Binning:
    """Thresholds of every feature; a value's bin is the number of thresholds below it."""

    splits: list[list[float]]
    rows: int

    @property
    def most(self) -> int:
        return math.prod(len(s) + 1 for s in self.splits)

    def of(self, vec: str) -> Column:
        def place(i: int, splits: list[float]) -> Column:
            value = F.coalesce(F.get(F.col(vec), F.lit(i)).cast("double"), F.raise_error(F.lit("a feature is null")).cast("double"))
            return F.size(F.filter(F.array(*[F.lit(float(x)) for x in splits]).cast("array<double>"), lambda t: t < value))

        return F.array(*[place(i, s) for i, s in enumerate(self.splits)])

    def cells(self, df: DataFrame, vec: str, weight: str | None) -> DataFrame:
        """(bins, target, n, w): the rows of each cell and their weight, which depends on the label only."""
        w = F.col(weight).cast("double") if weight else F.lit(1.0)
        return df.select(self.of(vec).alias("bins"), F.col("target").cast("int").alias("target"), w.alias("w")).groupBy("bins", "target").agg(
            F.count(F.lit(1)).alias("n"), F.max("w").alias("w"))


def binning(df: DataFrame, vec: str = "vec") -> Binning | None:
    """Thresholds from all rows; None where a label or a value is missing or no finite number, or there are too many features."""
    first = df.select(vec).first()
    if first is None or first[0] is None or 2 ** len(first[0]) > MOST_CELLS:
        return None
    dims = len(first[0])
    at = F.array(*[F.lit(i / GRID) for i in range(GRID + 1)])
    x = [F.get(F.col(vec), F.lit(i)).cast("double") for i in range(dims)]
    odd = reduce(lambda a, b: a | b, [c.isNull() | F.isnan(c) | (F.abs(c) == float("inf")) for c in x]) | F.coalesce(F.size(vec) != dims, F.lit(True)) | F.col("target").isNull()
    row = df.agg(F.count(F.lit(1)).alias("n"), F.count_if(odd).alias("odd"), *[F.percentile_approx(c, at, 10 * GRID).alias(f"q{i}") for i, c in enumerate(x)]).first()
    return None if row["odd"] else Binning([split_points(row[f"q{i}"]) for i in range(dims)], row["n"])


def draws(cells: DataFrame, trees: int, seed: int) -> DataFrame:
    """Adds `drawn`, how often each tree draws the cell's n rows in all."""
    @F.pandas_udf("array<int>")
    def poisson(name: pd.Series, n: pd.Series) -> pd.Series:
        return pd.Series([np.random.default_rng([seed, h & (2 ** 64 - 1)]).poisson(k, trees).astype(np.int32) for h, k in zip(name, n)], dtype=object)

    return cells.withColumn("drawn", poisson(F.xxhash64("bins", "target"), F.col("n")))


@dataclass
class BinnedForest:
    """Trees over bin numbers; a row's probability is that of its bins."""

    binning: Binning
    models: list = field(default_factory=list)
    vec: str = "vec"

    def score(self, df: DataFrame, name: str = "prob") -> DataFrame:
        rows = df.withColumn("_bins", self.binning.of(self.vec))
        cells = cut_lineage(rows.groupBy("_bins").agg(F.count(F.lit(1)).alias("_n")).withColumn("_fv", array_to_vector(F.col("_bins").cast("array<double>"))).coalesce(1))
        # a branch for each tree reads the cells, of which there are at most MOST_CELLS
        each = [m.transform(cells).select("_bins", "_n", vector_to_array("probability")[1].alias("_p")) for m in self.models]
        voted = reduce(DataFrame.union, each).groupBy("_bins", "_n").agg(F.avg("_p").alias(name))
        return join_by_key(rows, voted, ["_bins"], "_n").select(*df.columns, name)


def fit(df: DataFrame, found: Binning, trees: int, depth: int, subset: str, criterion: str, bootstrap: bool, weight: str | None, seed: int, vec: str = "vec") -> BinnedForest:
    cells = found.cells(df, vec, weight)
    cells = draws(cells, trees, seed) if bootstrap else cells.withColumn("drawn", F.array_repeat(F.col("n").cast("int"), trees))
    cells = cut_lineage(cells.withColumn("_fv", array_to_vector(F.col("bins").cast("array<double>"))).repartition(1))
    # so many bins that MLlib looks at every cell for its thresholds
    bins = max(MAX_BINS, math.isqrt(2 * found.most) + 1)

    def one(t: int):
        part = cells.select("_fv", F.col("target").cast("double").alias("target", metadata=LABELS), (F.col("drawn")[t] * F.col("w")).alias("w")).filter("w > 0")
        return RandomForestClassifier(numTrees=1, bootstrap=False, maxDepth=depth, maxBins=bins, impurity=criterion, featureSubsetStrategy=subset, seed=seed + t,
                                      featuresCol="_fv", labelCol="target", weightCol="w").fit(part)

    wrap = inheritable_thread_target(SparkSession.active())
    with ThreadPoolExecutor(max_workers=min(THREADS, trees)) as pool:
        return BinnedForest(found, [f.result() for f in [pool.submit(wrap(lambda t=t: one(t))) for t in range(trees)]], vec)
