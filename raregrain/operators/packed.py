"""Ensembles of trees as flat node arrays, scored in one vectorised pass over the rows.

Whatever the number of members, scoring is one Arrow stage. Nodes are read from the models' persisted form, all members
at once, and broadcast; their number is known before that and bounded by `MOST_NODES`.
"""
from __future__ import annotations

import uuid
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark import inheritable_thread_target
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from raregrain.session import ensure_checkpoint_dir

#: Nodes of an ensemble that are broadcast (28 bytes each); larger ensembles are scored member by member.
MOST_NODES = 8_000_000
#: Positions (rows x trees) followed at once.
STEP = 1 << 20
TINY = 2.220446049250313e-16


@dataclass
class Group:
    """Trees whose outputs are combined to one probability, and its share in the ensemble's mean.

    Rules: `mean` of class shares; `margin`, a sum of regression outputs; `votes`, weighted signs; `odds`, mean log odds.
    """

    rule: str
    members: list
    weights: list[float]
    share: float = 1.0


@dataclass
class Tree:
    feature: np.ndarray
    threshold: np.ndarray
    left: np.ndarray
    right: np.ndarray
    value: np.ndarray

    def on(self, cols: list | None) -> Tree:
        """The same tree for rows of which it was fitted on some columns only."""
        if cols is None:
            return self
        return Tree(np.where(self.feature < 0, -1, np.asarray(cols)[self.feature]), self.threshold, self.left, self.right, self.value)


def node_count(model) -> int:
    return model.totalNumNodes if hasattr(model, "totalNumNodes") else model.numNodes


def _tree(nodes: list, classify: bool) -> Tree:
    nodes = sorted(nodes, key=lambda n: n["id"])
    place = {n["id"]: i for i, n in enumerate(nodes)}
    if any(n["leftChild"] >= 0 and n["split"]["numCategories"] != -1 for n in nodes):
        raise ValueError("only splits of continuous features can be packed")
    inner = [n["leftChild"] >= 0 for n in nodes]
    share = (lambda n: n["impurityStats"][1] / sum(n["impurityStats"]) if len(n["impurityStats"]) > 1 and sum(n["impurityStats"]) else 0.0) if classify else (lambda n: n["prediction"])
    return Tree(np.array([n["split"]["featureIndex"] if x else -1 for n, x in zip(nodes, inner, strict=True)], np.int32),
                np.array([n["split"]["leftCategoriesOrThreshold"][0] if x else 0.0 for n, x in zip(nodes, inner, strict=True)]),
                np.array([place[n["leftChild"]] if x else 0 for n, x in zip(nodes, inner, strict=True)], np.int32),
                np.array([place[n["rightChild"]] if x else 0 for n, x in zip(nodes, inner, strict=True)], np.int32),
                np.array([share(n) for n in nodes]))


def read_trees(fitted: list, threads: int = 4) -> None:
    """Gives every fitted tree model its `trees`: models are persisted side by side and read back in one job."""
    fitted = [f for f in {id(f): f for f in fitted}.values() if f.trees is None]
    if not fitted:
        return
    spark = SparkSession.active()
    ensure_checkpoint_dir(spark)
    root = f"{spark.sparkContext.getCheckpointDir()}/trees-{uuid.uuid4().hex}"
    save = inheritable_thread_target(spark)(lambda i: fitted[i].model.write().save(f"{root}/{i}"))
    with ThreadPoolExecutor(max_workers=threads) as pool:
        list(pool.map(save, range(len(fitted))))
    alone = [i for i, f in enumerate(fitted) if not hasattr(f.model, "totalNumNodes")]
    many = [i for i in range(len(fitted)) if i not in set(alone)]
    rows: dict[int, dict[int, list]] = {}
    for members, nested in ((alone, False), (many, True)):
        if members:
            table = spark.read.parquet(*[f"{root}/{i}/data" for i in members])
            cols = "treeID as tree, nodeData.*" if nested else "0 as tree, *"
            for r in table.selectExpr(f"int(regexp_extract(_metadata.file_path, '/([0-9]+)/data/[^/]*$', 1)) as member", *cols.split(", ")).collect():
                rows.setdefault(r["member"], {}).setdefault(r["tree"], []).append(r)
    for i, f in enumerate(fitted):
        classify = "Regression" not in type(f.model).__name__ and "GBT" not in type(f.model).__name__
        f.trees = [_tree(rows[i][t], classify) for t in sorted(rows[i])]


@dataclass
class Forest:
    """All trees one after the other; a leaf has feature -1."""

    feature: np.ndarray
    threshold: np.ndarray
    left: np.ndarray
    right: np.ndarray
    value: np.ndarray
    root: np.ndarray
    groups: list[tuple[str, int, int, np.ndarray, float]] = field(default_factory=list)

    def probabilities(self, x: np.ndarray) -> np.ndarray:
        out = np.empty(len(x))
        step = max(1, STEP // len(self.root))
        for lo in range(0, len(x), step):
            out[lo:lo + step] = self._some(x[lo:lo + step])
        return out

    def _some(self, x: np.ndarray) -> np.ndarray:
        at = np.tile(self.root, len(x))
        row = np.repeat(np.arange(len(x)), len(self.root))
        live = np.flatnonzero(self.feature[at] >= 0)
        while len(live):
            a = at[live]
            a = np.where(x[row[live], self.feature[a]] <= self.threshold[a], self.left[a], self.right[a])
            at[live] = a
            live = live[self.feature[a] >= 0]
        v = self.value[at].reshape(len(x), len(self.root))
        total = np.zeros(len(x))
        for rule, lo, hi, w, share in self.groups:
            total += share * _combined(rule, v[:, lo:hi], w)
        return total / sum(g[4] for g in self.groups)

    def score(self, df: DataFrame, name: str = "prob", vec: str = "vec") -> DataFrame:
        held = df.sparkSession.sparkContext.broadcast((self.feature, self.threshold, self.left, self.right, self.value, self.root, self.groups))

        @F.pandas_udf("double")
        def probability(v: pd.Series) -> pd.Series:
            return pd.Series(Forest(*held.value).probabilities(np.stack(v.to_numpy()).astype(float)) if len(v) else np.zeros(0))
        return df.withColumn(name, probability(vec))


def _combined(rule: str, v: np.ndarray, w: np.ndarray) -> np.ndarray:
    if rule == "mean":
        return (v * w).sum(1) / w.sum()
    if rule == "margin":
        return 1 / (1 + np.exp(-2 * (v * w).sum(1)))
    if rule == "votes":
        margin = (np.where(v > 0.5, 1.0, -1.0) * w).sum(1) / max(w.sum(), TINY)
    else:
        p = np.clip(v, TINY, 1 - TINY)
        margin = (np.log(p) - np.log(1 - p)).mean(1)
    return 1 / (1 + np.exp(-margin))


def pack(groups: list[Group] | None) -> Forest | None:
    """The forest of an ensemble's groups; None if a member is no tree or there are too many nodes to broadcast."""
    if not groups:
        return None
    fitted = [f for g in groups for f, _ in g.members]
    if sum(node_count(f.model) for f in fitted) > MOST_NODES:
        return None
    read_trees(fitted)
    trees, laid = [], []
    for g in groups:
        lo, weights = len(trees), []
        for (f, cols), w in zip(g.members, g.weights, strict=True):
            own = [t.on(cols) for t in f.trees]
            if g.rule in ("votes", "odds") and len(own) != 1:
                return None
            inner = f.model.treeWeights if g.rule == "margin" else [1.0] * len(own)
            trees += own
            weights += [w * x for x in inner]
        laid.append((g.rule, lo, len(trees), np.array(weights), g.share))
    root = np.cumsum([0, *[len(t.feature) for t in trees[:-1]]])
    joined = [np.concatenate([getattr(t, c) for t in trees]) for c in ("feature", "threshold")]
    moved = [np.concatenate([getattr(t, c) + r for t, r in zip(trees, root, strict=True)]).astype(np.int32) for c in ("left", "right")]
    return Forest(*joined, *moved, np.concatenate([t.value for t in trees]), root, laid)
