"""Presets by name: classifiers, detectors, and sampler + classifier pairs."""
from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from raregrain.operators import ensembles as E
from raregrain.operators import learners as L
from raregrain.operators import outliers as O
from raregrain.operators import resample as R
from raregrain.operators.newton import newton_trees
from raregrain.session import cut_lineage


@dataclass
class TransductiveDetector:
    """Scores new rows by running the detector over the training rows and the new rows together."""

    train: DataFrame
    detect: Callable[[DataFrame], DataFrame]

    def score(self, df: DataFrame, name: str = "prob") -> DataFrame:
        both = self.train.select("key", "vec").unionByName(df.select("key", "vec")).dropDuplicates(["key"])
        found = O.flagged(cut_lineage(self.detect(both)))
        return df.join(found.select("key", F.col("probability").alias(name)), "key")


def _near(k_default: int, run, with_vec: bool = False):
    def detect(df: DataFrame, k: int = k_default, **params) -> DataFrame:
        return run(df, O.neighbour_lists(df, "key", "vec", k, with_vec), **params)
    return detect


DETECTORS: dict[str, Callable[..., DataFrame]] = {
    "pyod_isolation_forest": O.isolation_forest, "isolation_forest": O.isolation_forest, "pyod_cblof": O.cblof, "pyod_copod": O.copod,
    "pyod_hbos": O.hbos, "pyod_lmdd": O.lmdd, "pyod_loda": O.loda, "pyod_loci": O.loci, "pyod_mcd": lambda df, **p: O.mcd(df, **{"reweighted": True, **p}), "pyod_pca": O.pca_score,
    "pyod_feature_bagging": O.feature_bagging,
    "pyod_knn": _near(5, lambda df, near, method="largest": O.knn_distance(near, "key", method)),
    "pyod_lof": _near(20, lambda df, near: O.lof(near)),
    "pyod_cof": _near(20, lambda df, near: O.cof(near), True),
    "pyod_sod": _near(20, lambda df, near, alpha=0.8: O.sod(df, near, alpha=alpha)),
    "pyod_sos": O.sos,
}

SAMPLERS: dict[str, Callable[[DataFrame, int], DataFrame]] = {
    "smote": lambda d, k: R.smote(d, "key", "vec", "target", k, seed=1000),
    "adasyn": lambda d, k: R.adasyn(d, "key", "vec", "target", k, seed=1000),
    "borderlinesmote": lambda d, k: R.borderline_smote(d, "key", "vec", "target", k, seed=1000),
    "smoten": lambda d, k: _smoten_of_vectors(d, k),
    "near_miss": lambda d, k: R.near_miss(d, "key", "vec", "target", k),
    "tomek_links": lambda d, k: R.tomek(d, "key", "vec", "target"),
    "cluster_centroids": lambda d, k: R.cluster_centroids(d, "key", "vec", "target"),
    "combine_smote_tomek": lambda d, k: R.smote_tomek(d, "key", "vec", "target", k, seed=1000),
    "combine_smote_enn": lambda d, k: R.smote_enn(d, "key", "vec", "target", k, seed=1000),
}


def _smoten_of_vectors(df: DataFrame, k: int) -> DataFrame:
    """Treat every vector element as one categorical column."""
    n = len(df.select("vec").first()[0])
    cols = [f"c{i}" for i in range(n)]
    wide = df.select("key", "target", *[F.col("vec")[i].cast("string").alias(c) for i, c in enumerate(cols)])
    out = R.smoten(wide, "key", cols, "target", k, seed=1000)
    return out.select("key", F.array(*[F.col(c).cast("double") for c in cols]).alias("vec"), "target")


def xgbod(df: DataFrame, k: int = 10, **params):
    """Detector scores appended to the features, then boosted trees."""
    def widen(rows: DataFrame) -> DataFrame:
        base = rows.select("key", "vec")
        near = O.neighbour_lists(base, "key", "vec", k)
        scores = [O.hbos(base), O.copod(base), O.knn_distance(near), O.lof(near)]
        out = rows
        for i, s in enumerate(scores):
            out = out.join(s.select("key", F.col("score").alias(f"_d{i}")), "key")
        return out.withColumn("vec", F.concat("vec", F.array(*[f"_d{i}" for i in range(len(scores))]))).drop(*[f"_d{i}" for i in range(len(scores))])
    train = df.select("key", "vec", "target")
    return _Widened(train.select("key", "vec"), widen, L.boosted_trees(cut_lineage(widen(train)), **params))


@dataclass
class _Widened:
    train: DataFrame
    widen: Callable
    inner: object

    def score(self, df: DataFrame, name: str = "prob") -> DataFrame:
        both = self.train.unionByName(df.select("key", "vec")).dropDuplicates(["key"])
        wide = cut_lineage(self.widen(both))
        return df.join(self.inner.score(wide, name).select("key", name), "key")


CLASSIFIERS: dict[str, Callable] = {
    "adaboost": E.adaboost, "random_forest": L.random_forest, "rusboost": E.rusboost, "easy_ensemble": E.easy_ensemble,
    "balanced_random_forest": E.balanced_random_forest, "balanced_bagging": E.balanced_bagging, "boosted_trees": L.boosted_trees,
    "newton_trees": newton_trees, "svc": L.svc, "weighted_svc": lambda d, **p: L.svc(d, **{"class_weight": "balanced", **p}),
    "weighted_random_forest": lambda d, **p: L.random_forest(d, **{"class_weight": "balanced", **p}),
    "pyod_xgbod": xgbod, "late_fusion": L.late_fusion,
    "imbalanced_ensemble_balanced_cascade": E.balance_cascade, "imbalanced_ensemble_self_paced": E.self_paced_ensemble,
    "imbalanced_ensemble_balanced_random_forest": E.balanced_random_forest, "imbalanced_ensemble_easy_ensemble": E.easy_ensemble,
    "imbalanced_ensemble_underbagging": E.under_bagging, "imbalanced_ensemble_overboost": E.overboost,
    "imbalanced_ensemble_smote_boost": E.smoteboost, "imbalanced_ensemble_kmeans_smote_boost": E.kmeans_smoteboost,
    "imbalanced_ensemble_smote_bagging": E.smote_bagging, "imbalanced_ensemble_adacost": E.adacost, "imbalanced_ensemble_adauboost": E.adauboost,
}


@dataclass
class Builder:
    """A named preset with its parameters; `fit(train)` gives something that scores."""

    name: str
    params: dict = field(default_factory=dict)
    k_neighbors: int = 5

    def fit(self, train: DataFrame):
        if self.name in DETECTORS:
            params = {k: v for k, v in self.params.items() if k != "contamination"}
            return TransductiveDetector(train, lambda d: DETECTORS[self.name](d, **params))
        if self.name in CLASSIFIERS:
            return CLASSIFIERS[self.name](train, **self.params)
        sampler, learner = split_sampled(self.name)
        resampled = cut_lineage(SAMPLERS[sampler](train.select("key", "vec", "target"), self.k_neighbors))
        return CLASSIFIERS[learner](resampled, **self.params)


def split_sampled(name: str) -> tuple[str, str]:
    """'sampling_<sampler>_<svc|xgboost>' -> (sampler, classifier); a bare sampler means svc."""
    body = name.removeprefix("sampling_")
    for suffix, learner in (("_xgboost", "boosted_trees"), ("_svc", "svc"), ("", "svc")):
        if suffix and not body.endswith(suffix):
            continue
        sampler = body[:-len(suffix)] if suffix else body
        if sampler in SAMPLERS:
            return sampler, learner
    raise ValueError(f"unknown preset {name}")


def build(name: str, params: dict | None = None, k_neighbors: int = 5) -> Builder:
    """Preset by name; an unknown name raises."""
    if name not in DETECTORS and name not in CLASSIFIERS:
        split_sampled(name)
    return Builder(name, {k.replace("model__", ""): v for k, v in (params or {}).items()}, k_neighbors)


def preset_names() -> list[str]:
    pairs = [f"sampling_{s}_{c}" for s in SAMPLERS for c in ("svc", "xgboost")]
    return sorted({*DETECTORS, *CLASSIFIERS, *pairs})
