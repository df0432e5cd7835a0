"""Gradient-boosted trees with second-order leaves and L1/L2 penalties, grown from histograms.

Columns are cut into bins once, at quantiles. A level of a tree is one aggregate over (node, feature, bin):
every task adds the gradients and Hessians of its rows into cells, Spark sums the cells, and running sums over the
bins of a feature (at most `max_bins` + 1 rows) give the gain of each cut. Only the best cut of each node
reaches the driver. Gradients are rounded to fixed point, so that sums are exact and reruns agree.

Defined cases: null vectors, null, NaN or absent components are missing and take the side that gains more at each split;
rows without a target are left out of the fit; without rows, or with no cut that gains, a tree is one leaf.
"""
from __future__ import annotations

import math
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from raregrain.functions.columns import hash_unit
from raregrain.session import cut_lineage

#: Cells (node x feature x bin) that a task adds up before it hands them on; with more it hands on every batch.
DENSE_CELLS = 1 << 21
#: Names of the same parameters elsewhere.
ALIASES = {"iterations": "n_estimators", "eta": "learning_rate", "alpha": "reg_alpha", "lambda": "reg_lambda", "l2_leaf_reg": "reg_lambda",
           "min_data_in_leaf": "min_rows", "depth": "max_depth"}


@dataclass
class Tree:
    """Node arrays; a row goes left where its bin is below `cut`, or where it is missing and `missing_left`."""

    feature: list = field(default_factory=lambda: [-1])
    cut: list = field(default_factory=lambda: [0])
    missing_left: list = field(default_factory=lambda: [False])
    left: list = field(default_factory=lambda: [-1])
    right: list = field(default_factory=lambda: [-1])
    value: list = field(default_factory=lambda: [0.0])

    def split(self, at: int, feature: int, cut: int, missing_left: bool, values: tuple[float, float]) -> tuple[int, int]:
        n = len(self.feature)
        self.feature[at], self.cut[at], self.missing_left[at], self.left[at], self.right[at] = feature, cut, missing_left, n, n + 1
        for v in values:
            for name, x in (("feature", -1), ("cut", 0), ("missing_left", False), ("left", -1), ("right", -1), ("value", v)):
                getattr(self, name).append(x)
        return n, n + 1

    def places(self, bins: np.ndarray) -> np.ndarray:
        """Node where each row of bins ends."""
        f, c, m, l, r = (np.asarray(getattr(self, n)) for n in ("feature", "cut", "missing_left", "left", "right"))
        at = np.zeros(len(bins), np.int64)
        while True:
            inner = np.flatnonzero(f[at] >= 0)
            if not len(inner):
                return at
            a = at[inner]
            b = bins[inner, f[a]]
            at[inner] = np.where(np.where(b < 0, m[a], b < c[a]), l[a], r[a])


def margins(trees: list[Tree], bins: np.ndarray) -> np.ndarray:
    total = np.zeros(len(bins))
    for t in trees:
        total += np.asarray(t.value)[t.places(bins)]
    return total


def quantile_edges(df: DataFrame, vec: str, dims: int, max_bins: int = 256) -> list[list[float]]:
    """Borders of each feature's bins: distinct values at evenly spaced quantiles. One aggregate, `dims` short arrays."""
    at = F.array(*[F.lit(i / max_bins) for i in range(max_bins)])
    parts = [F.percentile_approx(F.nanvl(F.get(F.col(vec), F.lit(i)), F.lit(None).cast("double")), at, 10 * max_bins).alias(f"q{i}") for i in range(dims)]
    row = df.agg(*parts).first()
    return [sorted(set(row[f"q{i}"] or [])) for i in range(dims)]


def binned(column: pd.Series, edges: list[np.ndarray]) -> np.ndarray:
    """Number of borders at or below each component; -1 where it is missing."""
    wide = np.full((len(column), len(edges)), np.nan)
    for i, v in enumerate(column):
        if v is not None:
            k = min(len(v), len(edges))
            wide[i, :k] = np.asarray(v[:k], dtype=float)
    out = np.full(wide.shape, -1, np.int32)
    for j, e in enumerate(edges):
        known = ~np.isnan(wide[:, j])
        out[known, j] = np.searchsorted(e, wide[known, j], side="right")
    return out


def penalised(g: Column, h: Column, alpha: float, lam: float) -> tuple[Column, Column]:
    """(score, weight) of a node with these sums: soft-thresholded gradient, squared over the penalised Hessian; and its leaf."""
    t = F.signum(g) * F.greatest(F.abs(g) - F.lit(float(alpha)), F.lit(0.0))
    return F.coalesce(F.try_divide(t * t, h + F.lit(float(lam))), F.lit(0.0)), F.coalesce(-F.try_divide(t, h + F.lit(float(lam))), F.lit(0.0))


def cut_gains(cells: DataFrame, reg_alpha: float = 0.0, reg_lambda: float = 1.0, gamma: float = 0.0, min_child_weight: float = 1.0,
              min_rows: int = 1, unit: float = 1.0) -> DataFrame:
    """Gain and leaves of every allowed cut. `cells`: node, f, bin (-1: missing), g, h, n, unique by the first three; g and h count `unit`s.

    Returns node, f, cut, missing_left, gain, left, right (leaf values), left_n, right_n. Cuts that gain nothing are left out.
    """
    whole = Window.partitionBy("node", "f")
    so_far = whole.orderBy("bin").rowsBetween(Window.unboundedPreceding, 0)
    known = F.col("bin") >= 0
    sums = cells.select("node", "f", "bin", *[e for c in ("g", "h", "n") for e in (
        F.sum(c).over(whole).alias(f"t{c}"), F.coalesce(F.sum(F.when(~known, F.col(c))).over(whole), F.lit(0)).alias(f"m{c}"),
        F.sum(F.when(known, F.col(c)).otherwise(0)).over(so_far).alias(f"k{c}"))]).filter(known)
    ways = sums.withColumn("missing_left", F.explode(F.when(F.col("mn") > 0, F.array(F.lit(True), F.lit(False))).otherwise(F.array(F.lit(True)))))
    lefts = {c: F.col(f"k{c}") + F.when(F.col("missing_left"), F.col(f"m{c}")).otherwise(0) for c in ("g", "h", "n")}
    ways = ways.select("node", "f", "bin", "missing_left", "tg", "th", *[e for c, left in lefts.items() for e in (left.alias(f"l{c}"), (F.col(f"t{c}") - left).alias(f"r{c}"))])
    real = {k: F.col(k).cast("double") * F.lit(unit) for k in ("tg", "th", "lg", "lh", "rg", "rh")}
    (left, left_leaf), (right, right_leaf), (both, _) = (penalised(real[f"{s}g"], real[f"{s}h"], reg_alpha, reg_lambda) for s in "lrt")
    allowed = (real["lh"] >= min_child_weight) & (real["rh"] >= min_child_weight) & (F.col("ln") >= min_rows) & (F.col("rn") >= min_rows) & (F.col("ln") > 0) & (F.col("rn") > 0)
    return ways.filter(allowed).select("node", "f", (F.col("bin") + 1).alias("cut"), "missing_left", (0.5 * (left + right - both) - F.lit(float(gamma))).alias("gain"),
                                       left_leaf.alias("left"), right_leaf.alias("right"), F.col("ln").alias("left_n"), F.col("rn").alias("right_n")).filter("gain > 0")


def best_cuts(cells: DataFrame, **penalties) -> DataFrame:
    """The cut of each node that gains most; ties go to the lowest feature, then the lowest cut, then missing to the left."""
    order = F.struct("gain", -F.col("f"), -F.col("cut"), "missing_left")
    picked = cut_gains(cells, **penalties).groupBy("node").agg(F.max_by(F.struct("f", "cut", "missing_left", "gain", "left", "right"), order).alias("s"))
    return picked.select("node", "s.*")


def _subset(rng, among: np.ndarray, share: float) -> np.ndarray:
    return among if share >= 1 else np.sort(rng.choice(among, max(1, int(share * len(among))), replace=False))


def level_cells(rows: DataFrame, pending: list[Tree], tree: Tree, open_nodes: dict[int, np.ndarray], bins: int, dims: int, scale: float, base: float) -> DataFrame:
    """(node, f, bin, g, h, n): fixed-point sums over the sampled rows of the open nodes, for the features each of them may use."""
    import pyarrow as pa

    order = np.array(sorted(open_nodes))
    may = np.zeros((len(order), dims), bool)
    for i, node in enumerate(order):
        may[i, open_nodes[node]] = True
    dense = len(order) * dims * (bins + 1) <= DENSE_CELLS
    names = ["node", "f", "bin", "g", "h", "n"]

    def pack(codes, sums):
        node, rest = np.divmod(codes, dims * (bins + 1))
        f, b = np.divmod(rest, bins + 1)
        return pa.RecordBatch.from_arrays([pa.array(order[node]), pa.array(f.astype(np.int32)), pa.array((b - 1).astype(np.int32)), *[pa.array(s) for s in sums]], names=names)

    def add(batches):
        total = np.zeros((3, len(order) * dims * (bins + 1)), np.int64) if dense else None
        for batch in batches:
            if not batch.num_rows:
                continue
            x = batch.column("bins").flatten().to_numpy().reshape(-1, dims)
            y, w = batch.column("y").to_numpy(), batch.column("w").to_numpy()
            p = 1.0 / (1.0 + np.exp(-(base + batch.column("margin").to_numpy() + margins(pending, x))))
            at = tree.places(x)
            place = np.minimum(np.searchsorted(order, at), len(order) - 1)
            row, f = np.nonzero(may[place] & (order[place] == at)[:, None])
            codes = (place[row] * dims + f) * (bins + 1) + x[row, f] + 1
            parts = [np.rint((p - y) * w * scale).astype(np.int64), np.rint(p * (1 - p) * w * scale).astype(np.int64), np.ones(len(x), np.int64)]
            if dense:
                for s, v in zip(total, parts, strict=True):
                    np.add.at(s, codes, v[row])
                continue
            some, inverse = np.unique(codes, return_inverse=True)
            sums = np.zeros((3, len(some)), np.int64)
            for s, v in zip(sums, parts, strict=True):
                np.add.at(s, inverse, v[row])
            yield pack(some, sums)
        if dense:
            held = np.flatnonzero(total[2])
            yield pack(held, total[:, held])

    cells = rows.select("bins", "y", "w", "margin").mapInArrow(add, "node bigint, f int, bin int, g bigint, h bigint, n bigint")
    # dealt by node and feature, so that the running sums over bins need no second shuffle
    return cells.repartition("node", "f").groupBy("node", "f", "bin").agg(*[F.sum(c).alias(c) for c in ("g", "h", "n")])


@dataclass
class NewtonModel:
    """Fitted trees; all of them score in one pass over the rows."""

    trees: list[Tree]
    edges: list[list[float]]
    base: float = 0.0
    vec: str = "vec"

    def margin(self, df: DataFrame, name: str = "margin") -> DataFrame:
        trees, edges, base = self.trees, [np.asarray(e) for e in self.edges], self.base

        @F.pandas_udf("double")
        def add(v: pd.Series) -> pd.Series:
            return pd.Series(base + margins(trees, binned(v, edges)), dtype=float)
        return df.withColumn(name, add(F.col(self.vec).cast("array<double>")))

    def score(self, df: DataFrame, name: str = "prob") -> DataFrame:
        return self.margin(df, "_margin").withColumn(name, 1 / (1 + F.exp(-F.col("_margin")))).drop("_margin")


def binned_rows(known: DataFrame, borders: list[np.ndarray], scale_pos_weight: float = 1.0) -> DataFrame:
    """key, bins, y, w, margin 0 for rows of key, vec and y."""
    @F.pandas_udf("array<int>")
    def cut(v: pd.Series) -> pd.Series:
        return pd.Series(list(binned(v, borders)), dtype=object)

    weight = F.when(F.col("y") > 0.5, F.lit(float(scale_pos_weight))).otherwise(F.lit(1.0))
    return known.select("key", cut("vec").alias("bins"), "y", weight.alias("w"), F.lit(0.0).alias("margin"))


def first_cuts(df: DataFrame, dims: int, max_bins: int = 256, scale_pos_weight: float = 1.0, **penalties) -> DataFrame:
    """Every cut that gains at the root of the first tree: f, threshold (left below it; null: left unless missing), missing_left, gain, left, right, left_n, right_n."""
    known = df.filter(F.col("target").isNotNull()).select("key", F.col("vec").cast("array<double>").alias("vec"), F.col("target").cast("double").alias("y"))
    edges = quantile_edges(known, "vec", dims, max_bins)
    rows = binned_rows(known, [np.asarray(e) for e in edges], scale_pos_weight)
    scale = 2.0 ** 20
    cells = level_cells(rows, [], Tree(), {0: np.arange(dims)}, max(len(e) for e in edges) + 1, dims, scale, 0.0)
    at = F.get(F.array(*[F.array(*[F.lit(float(v)) for v in e]) for e in edges]), F.col("f"))
    return cut_gains(cells, unit=1 / scale, **penalties).select("f", F.get(at, F.col("cut") - 1).alias("threshold"), "missing_left", "gain", "left", "right", "left_n", "right_n")


def newton_trees(df: DataFrame, n_estimators: int = 100, learning_rate: float = 0.3, max_depth: int = 6, reg_alpha: float = 0.0, reg_lambda: float = 1.0,
                 gamma: float = 0.0, min_child_weight: float = 1.0, min_rows: int = 1, subsample: float = 1.0, colsample_bytree: float = 1.0,
                 colsample_bylevel: float = 1.0, colsample_bynode: float = 1.0, scale_pos_weight: float = 1.0, base_score: float = 0.5, max_bins: int = 256,
                 max_nodes: int = 65_536, every: int = 10, seed: int = 1000, **named) -> NewtonModel:
    """Boosted trees for (key, vec, target) under the log loss. Parameters also pass under the names in `ALIASES`.

    A tree takes the rows whose hash of (seed, tree, key) falls below `subsample`. Margins are written every `every` trees, so a row
    passes through few trees a level and a lost executor re-reads files. More than `max_nodes` open nodes in one level raise.
    """
    if named:
        unknown = set(named) - set(ALIASES)
        if unknown:
            raise TypeError(f"unknown parameters {sorted(unknown)}")
        own = {"n_estimators": n_estimators, "learning_rate": learning_rate, "max_depth": max_depth, "reg_alpha": reg_alpha, "reg_lambda": reg_lambda, "gamma": gamma,
               "min_child_weight": min_child_weight, "min_rows": min_rows, "subsample": subsample, "colsample_bytree": colsample_bytree,
               "colsample_bylevel": colsample_bylevel, "colsample_bynode": colsample_bynode, "scale_pos_weight": scale_pos_weight, "base_score": base_score,
               "max_bins": max_bins, "max_nodes": max_nodes, "every": every, "seed": seed}
        return newton_trees(df, **{**own, **{ALIASES[k]: v for k, v in named.items()}})
    known = df.filter(F.col("target").isNotNull()).select("key", F.col("vec").cast("array<double>").alias("vec"), F.col("target").cast("double").alias("y"))
    facts = known.agg(F.count("*").alias("n"), F.max(F.size("vec")).alias("dims")).first()
    base = math.log(base_score / (1 - base_score))
    if not facts["n"] or (facts["dims"] or 0) <= 0:
        return NewtonModel([], [], base)
    dims = facts["dims"]
    edges = quantile_edges(known, "vec", dims, max_bins)
    borders, bins = [np.asarray(e) for e in edges], max(len(e) for e in edges) + 1
    scale = 2.0 ** min(40, 61 - math.ceil(math.log2(facts["n"] * max(scale_pos_weight, 1.0) + 1)))

    state = cut_lineage(binned_rows(known, borders, scale_pos_weight))
    trees: list[Tree] = []
    pending: list[Tree] = []
    for t in range(n_estimators):
        if len(pending) == every:
            state, pending = _with_margins(state, pending, dims), []
        rows = state if subsample >= 1 else state.filter(hash_unit(seed, F.lit(t), "key") < subsample)
        tree, rng = Tree(), np.random.default_rng([seed, t])
        usable = _subset(rng, np.arange(dims), colsample_bytree)
        open_nodes = [0]
        for _ in range(max_depth):
            if len(open_nodes) > max_nodes:
                raise ValueError(f"{len(open_nodes)} open nodes; lower max_depth or raise min_child_weight or max_nodes")
            level = _subset(rng, usable, colsample_bylevel)
            may = {node: _subset(rng, level, colsample_bynode) for node in open_nodes}
            cells = level_cells(rows, pending, tree, may, bins, dims, scale, base)
            found = best_cuts(cells, reg_alpha=reg_alpha, reg_lambda=reg_lambda, gamma=gamma, min_child_weight=min_child_weight, min_rows=min_rows, unit=1 / scale)
            open_nodes = []
            for r in sorted(found.collect(), key=lambda r: r["node"]):
                open_nodes += tree.split(r["node"], r["f"], r["cut"], r["missing_left"], (learning_rate * r["left"], learning_rate * r["right"]))
            if not open_nodes:
                break
        if len(tree.feature) == 1:
            tree.value[0] = learning_rate * _root_leaf(rows, pending, scale, base, dims, bins, reg_alpha, reg_lambda)
        pending.append(tree)
        trees.append(tree)
    return NewtonModel(trees, edges, base)


def _root_leaf(rows, pending, scale, base, dims, bins, alpha, lam) -> float:
    cells = level_cells(rows, pending, Tree(), {0: np.array([0])}, bins, dims, scale, base)
    sums = cells.agg((F.sum("g") / F.lit(scale)).alias("g"), (F.sum("h") / F.lit(scale)).alias("h"))
    return sums.select(penalised(F.col("g"), F.col("h"), alpha, lam)[1].alias("leaf")).first()["leaf"]


def _with_margins(state: DataFrame, pending: list[Tree], dims: int) -> DataFrame:
    @F.pandas_udf("double")
    def add(b: pd.Series) -> pd.Series:
        return pd.Series(margins(pending, np.stack(b.to_numpy()).reshape(-1, dims)) if len(b) else [], dtype=float)
    return cut_lineage(state.withColumn("margin", F.col("margin") + add("bins")))
