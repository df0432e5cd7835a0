"""Base classifiers. Rows are (key, vec array<double>, target 0/1, optional weight `w`).

A fitted model is anything with `score(df, name)`, which adds a probability column.
"""
from __future__ import annotations

import math
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.ml import PipelineModel
from pyspark.ml.classification import (DecisionTreeClassificationModel, DecisionTreeClassifier, GBTClassificationModel, GBTClassifier, LinearSVC,
                                       LogisticRegression, MultilayerPerceptronClassifier, RandomForestClassificationModel, RandomForestClassifier)
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from raregrain.functions.columns import sigmoid
from raregrain.operators import binned_forest
from raregrain.operators.packed import Group, pack
from raregrain.operators.trials import best_trial
from raregrain.operators.weights import with_weight

MAX_TREE_DEPTH = 30  # the deepest tree MLlib grows; larger requests are clipped
#: Draws (rows x trees) from which a forest is grown from counted bins, if there are so many rows to a bin combination; or else on rows spread evenly.
MANY_DRAWS = 20_000_000
ROWS_PER_CELL = 8


FEATURES = "_fv"


def with_features(df: DataFrame, vec: str = "vec") -> DataFrame:
    """Add the ML vector once; members of an ensemble share it."""
    return df if FEATURES in df.columns else df.withColumn(FEATURES, array_to_vector(F.col(vec).cast("array<double>")))


def fuse(vectors: DataFrame, meta: DataFrame, key: str, vec: str, cols: list[str]) -> DataFrame:
    """Vector and metadata columns of one row as one `features` array."""
    return vectors.join(meta, key).withColumn("features", F.concat(F.col(vec), F.array(*cols)))


def soft_vote(stacked: DataFrame, keys: list[str]) -> DataFrame:
    """Mean of the member probabilities of each row."""
    return stacked.groupBy(*keys).agg(F.avg("prob").alias("prob"))


@dataclass
class Fitted:
    """One MLlib model; margins become probabilities through the logistic link."""

    model: object
    vec: str = "vec"
    prepare: object = None
    trees: list | None = field(default=None, repr=False)

    def groups(self, cols: list | None = None) -> list[Group] | None:
        """What a packed ensemble takes from this member; None if it is no tree model. `cols`: the columns it was fitted on."""
        rule = {DecisionTreeClassificationModel: "mean", RandomForestClassificationModel: "mean", GBTClassificationModel: "margin"}.get(type(self.model))
        return [Group(rule, [(self, cols)], [1.0])] if rule and self.prepare is None else None

    def score(self, df: DataFrame, name: str = "prob") -> DataFrame:
        rows = self.prepare(df) if self.prepare is not None else with_features(df, self.vec)
        out = self.model.transform(rows)
        p = vector_to_array("probability")[1] if "probability" in out.columns else sigmoid(vector_to_array("rawPrediction")[1])
        return out.select(*df.columns, p.alias(name))


@dataclass
class Voted:
    """Mean of member probabilities. Tree members are packed and scored in one pass; with others among them, member by member."""

    members: list = field(default_factory=list)

    def groups(self, cols: list | None = None) -> list[Group] | None:
        parts = [m.groups(cols) if hasattr(m, "groups") else None for m in self.members]
        if any(p is None for p in parts):
            return None
        return [Group(g.rule, g.members, g.weights, g.share / sum(x.share for x in p)) for p in parts for g in p]

    def score(self, df: DataFrame, name: str = "prob") -> DataFrame:
        forest = pack(self.groups())
        return self.chained(df, name) if forest is None else forest.score(df, name)

    def chained(self, df: DataFrame, name: str = "prob") -> DataFrame:
        out = with_features(df)
        for i, m in enumerate(self.members):
            out = m.score(out, f"{name}_{i}")
        mean = sum((F.col(f"{name}_{i}") for i in range(len(self.members))), F.lit(0.0)) / len(self.members)
        return out.select(*df.columns, mean.alias(name))


def _fit(estimator, df: DataFrame, weight: str | None = None) -> Fitted:
    if weight:
        estimator = estimator.setWeightCol(weight)
    return Fitted(estimator.setFeaturesCol(FEATURES).setLabelCol("target").fit(with_features(df)))


def _subset(max_features) -> str:
    """Feature subset strategy: counts pass as text, 'auto' means the square root."""
    return {"auto": "sqrt", None: "all", "sqrt": "sqrt", "log2": "log2"}.get(max_features, str(max_features))


def tree(df: DataFrame, depth: int = 5, criterion: str = "gini", min_rows: int = 1, weight: str | None = None, seed: int = 1000) -> Fitted:
    return _fit(DecisionTreeClassifier(maxDepth=min(depth, MAX_TREE_DEPTH), impurity=criterion, minInstancesPerNode=min_rows, seed=seed), df, weight)


def random_forest(df: DataFrame, n_estimators: int = 100, max_depth: int | None = 10, max_features="auto", criterion: str = "gini",
                  min_rows: int = 1, class_weight=None, bootstrap: bool = True, seed: int = 1000) -> Fitted | binned_forest.BinnedForest:
    """Random forest; `class_weight` is 'balanced' or a {label: weight} map.

    MLlib looks at every row for every tree in each pass. Of many rows with few features it gets counted bins, which is the
    same forest by other random draws.
    """
    depth = min(max_depth or MAX_TREE_DEPTH, MAX_TREE_DEPTH)
    if class_weight is not None:
        df = with_weight(df, scheme=class_weight, name="w")
    weight = "w" if class_weight is not None else None
    if n_estimators > 1 and df.count() * n_estimators >= MANY_DRAWS:
        # a tree's least number of rows cannot be told from cells
        found = binned_forest.binning(df) if min_rows == 1 else None
        if found is not None and ROWS_PER_CELL * found.most <= min(found.rows, ROWS_PER_CELL * binned_forest.MOST_CELLS):
            return binned_forest.fit(df, found, n_estimators, depth, _subset(max_features), criterion, bootstrap, weight, seed)
        df = df.repartition(max(df.rdd.getNumPartitions(), df.sparkSession.sparkContext.defaultParallelism))
    est = RandomForestClassifier(numTrees=n_estimators, maxDepth=depth, impurity=criterion,
                                 featureSubsetStrategy=_subset(max_features), minInstancesPerNode=min_rows, bootstrap=bootstrap, seed=seed)
    return _fit(est, df, weight)


def boosted_trees(df: DataFrame, n_estimators: int = 20, learning_rate: float = 0.1, max_depth: int = 5, subsample: float = 1.0,
                  colsample_bytree: float = 1.0, gamma: float = 0.0, min_child_weight: float | None = None, min_rows: int = 1, scale_pos_weight: float = 1.0, seed: int = 1000) -> Fitted:
    """Gradient-boosted trees under the usual vendor parameter names.

    A child's weight is its number of rows here (`min_child_weight` rounds up to `min_rows`).
    """
    min_rows = max(min_rows, math.ceil(min_child_weight or 0))
    df = with_weight(df, scheme={0: 1.0, 1: scale_pos_weight}, name="w") if scale_pos_weight != 1.0 else df
    est = GBTClassifier(maxIter=n_estimators, stepSize=min(learning_rate, 1.0), maxDepth=min(max_depth, MAX_TREE_DEPTH), subsamplingRate=subsample,
                        featureSubsetStrategy="all" if colsample_bytree >= 1 else str(colsample_bytree), minInfoGain=gamma,
                        minInstancesPerNode=min_rows, seed=seed)
    return _fit(est, df, "w" if scale_pos_weight != 1.0 else None)


def fourier(dims: int, width: int, gamma: float, seed: int):
    """Random Fourier map whose dot products approximate exp(-gamma * d^2)."""
    rng = np.random.default_rng(seed)
    w = rng.standard_normal((dims, width)) * np.sqrt(2 * gamma)
    b = rng.uniform(0, 2 * np.pi, width)

    @F.pandas_udf("array<double>")
    def lift(v: pd.Series) -> pd.Series:
        return pd.Series(list(np.sqrt(2.0 / width) * np.cos(np.stack(v.to_numpy()) @ w + b))) if len(v) else v

    return lambda df: df.withColumn("_lifted", array_to_vector(lift("vec")))


def svc(df: DataFrame, C: float = 1.0, gamma: float | str = "scale", class_weight=None, width: int = 128, max_iter: int = 50, seed: int = 1000) -> Fitted:
    """RBF support vector classifier: random Fourier features, then a linear one. An approximation by design."""
    dims = len(df.select("vec").first()[0])
    rows = with_weight(df, scheme=class_weight if class_weight is not None else {0: 1.0, 1: 1.0}, name="w")
    if gamma == "scale":
        x = df.select(F.explode("vec").alias("x")).agg(F.var_pop("x").alias("v"), F.count(F.lit(1)).alias("n")).first()
        gamma, n = 1.0 / (dims * max(x["v"], 1e-12)), x["n"] / dims
    else:
        n = df.count()
    lift = fourier(dims, width, float(gamma), seed)
    model = LinearSVC(maxIter=max_iter, regParam=1.0 / (C * n), weightCol="w", labelCol="target", featuresCol="_lifted").fit(lift(rows))
    return Fitted(model, prepare=lift)


def late_fusion(df: DataFrame, hidden: list[int] | None = None, max_iter: int = 100, seed: int = 1000) -> Fitted:
    """Classifier over fused vectors: a small perceptron when `hidden` is given, else logistic regression."""
    if hidden:
        dims = len(df.select("vec").first()[0])
        est = MultilayerPerceptronClassifier(layers=[dims, *hidden, 2], maxIter=max_iter, seed=seed)
    else:
        est = LogisticRegression(maxIter=max_iter)
    return _fit(est, df)


def save_best_and_last(models: dict[int, Fitted], board: DataFrame, path: str, metric: str = "pauc_score") -> int:
    """Write the model of the best trial and of the last one as persisted pipelines; returns the best trial."""
    best = best_trial(board, metric).first()["trial"]
    for name, trial in (("best", best), ("last", max(models))):
        PipelineModel([models[trial].model]).write().overwrite().save(f"{path}/{name}")
    return best
