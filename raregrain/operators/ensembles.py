"""Boosting and bagging for rare classes.

Members are ordinary Spark fits. Bagging members are independent and run from a small
thread pool; boosting keeps one weight column, held by the executors for the passes of a
round and rewritten every few rounds.
"""
from __future__ import annotations

import math
import random
from collections.abc import Callable
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass, field

from pyspark import StorageLevel, inheritable_thread_target
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from raregrain.functions.columns import sigmoid
from raregrain.operators import resample as R
from raregrain.operators.learners import FEATURES, Voted, random_forest, tree, with_features
from raregrain.operators.neighbours import knn
from raregrain.operators.packed import TINY, Group, pack
from raregrain.operators.ranking import hash_rank
from raregrain.operators.weights import class_sizes
from raregrain.session import cut_lineage

THREADS = 4
REWRITE_EVERY = 5


def in_parallel(jobs: list[Callable], threads: int = THREADS) -> list:
    """Run independent Spark jobs side by side, results in order."""
    wrap = inheritable_thread_target(SparkSession.active())
    with ThreadPoolExecutor(max_workers=max(1, min(threads, len(jobs)))) as pool:
        return [f.result() for f in [pool.submit(wrap(j)) for j in jobs]]


# ---- boosting --------------------------------------------------------------------------

@dataclass
class Boosted:
    members: list = field(default_factory=list)
    alphas: list[float] = field(default_factory=list)
    real: bool = False

    def decision(self, df: DataFrame, name: str):
        """(rows with member probabilities, combined margin)."""
        out = with_features(df)
        for i, m in enumerate(self.members):
            out = m.score(out, f"{name}_{i}")
        total = F.lit(0.0)
        for i, a in enumerate(self.alphas):
            p = F.least(F.greatest(F.col(f"{name}_{i}"), F.lit(TINY)), F.lit(1 - TINY))
            total = total + (F.log(p) - F.log(F.lit(1.0) - p) if self.real else F.lit(a) * F.when(F.col(f"{name}_{i}") > 0.5, 1.0).otherwise(-1.0))
        return out, total / (len(self.members) if self.real else max(sum(self.alphas), TINY))

    def groups(self, cols: list | None = None) -> list[Group] | None:
        parts = [m.groups(cols) for m in self.members]
        if any(p is None or len(p) != 1 or p[0].rule != "mean" for p in parts):
            return None
        return [Group("odds" if self.real else "votes", [m for p in parts for m in p[0].members], self.alphas)]

    def score(self, df: DataFrame, name: str = "prob") -> DataFrame:
        forest = pack(self.groups())
        return self.chained(df, name) if forest is None else forest.score(df, name)

    def chained(self, df: DataFrame, name: str = "prob") -> DataFrame:
        out, margin = self.decision(df, name)
        return out.select(*df.columns, sigmoid(margin).alias(name))


def adaboost(df: DataFrame, n_estimators: int = 50, learning_rate: float = 1.0, algorithm: str = "SAMME", depth: int = 1,
             resample: Callable[[DataFrame, int], DataFrame] | None = None, cost: str | None = None, cost_factor: float = 2.0,
             seed: int = 1000) -> Boosted:
    """Adaptive boosting of trees.

    `resample(rows, round)` changes what each round is fitted on; errors and weights always
    refer to the original rows. `cost='adacost'` scales the exponent by the class cost,
    `cost='adauboost'` multiplies the weight of missed minority rows by `cost_factor`.
    """
    if algorithm not in ("SAMME", "SAMME.R"):
        raise ValueError(f"unknown algorithm {algorithm}")
    neg, pos = class_sizes(df)
    rare = 1 if pos <= neg else 0
    class_cost = min(neg, pos) / max(neg, pos, 1)
    fitted = Boosted(real=algorithm == "SAMME.R")
    rows = cut_lineage(df.select("key", "vec", F.col("target").cast("int").alias("target"), F.lit(1.0 / (neg + pos)).alias("w")))
    kept: list[DataFrame] = []
    try:
        for t in range(n_estimators):
            part = resample(rows, t) if resample else rows
            member = tree(part, depth, weight="w", seed=seed + t)
            y = F.col("target")
            scored = member.score(rows, "_p")
            miss = ((F.col("_p") > 0.5).cast("int") != y)
            # weight held by each (class, missed) cell: at most four numbers per round
            held = {(r["target"], r["m"]): r["s"] for r in scored.groupBy("target", miss.alias("m")).agg(F.sum("w").alias("s")).collect()}
            # these rows have been read whole, so nothing goes back to those of the round before
            while len(kept) > 1:
                kept.pop(0).unpersist()
            err = sum(v for (_, m), v in held.items() if m) / sum(held.values())
            if not fitted.real and err >= 0.5:
                if not fitted.members:
                    fitted.members, fitted.alphas = [member], [1.0]
                break
            alpha = 1.0 if fitted.real else learning_rate * math.log((1 - max(err, TINY)) / max(err, TINY))
            fitted.members.append(member)
            fitted.alphas.append(alpha)
            if err <= 0.0 or t == n_estimators - 1:
                break
            if fitted.real:
                p = F.least(F.greatest(F.col("_p"), F.lit(TINY)), F.lit(1 - TINY))
                right = F.when(y == 1, F.log(p) - F.log(F.lit(1.0) - p)).otherwise(F.log(F.lit(1.0) - p) - F.log(p))
                rows = cut_lineage(scored.withColumn("w", F.col("w") * F.exp(F.lit(-0.5 * learning_rate) * right)).drop("_p"))
                rows = rows.withColumn("w", F.col("w") / rows.agg(F.sum("w").alias("s")).scalar())
                continue
            factor = {cell: _boost_factor(alpha, *cell, rare, cost, cost_factor, class_cost) for cell in held}
            total = sum(factor[cell] * held[cell] for cell in held)
            f = F.lit(1.0)
            for (label, m), v in factor.items():
                f = F.when((y == label) & (miss == F.lit(m)), F.lit(v / total)).otherwise(f)
            rows = scored.withColumn("w", F.col("w") * f).drop("_p")
            if (t + 1) % REWRITE_EVERY == 0:
                rows = cut_lineage(rows)
            else:
                # a round reads its rows some five times: without this each pass scores the members since the last rewrite again
                kept.append(rows := rows.persist(StorageLevel.MEMORY_AND_DISK))
    finally:
        for old in kept:
            old.unpersist()
    return fitted


def _boost_factor(alpha: float, label: int, missed: bool, rare: int, cost: str | None, cost_factor: float, class_cost: float) -> float:
    """Factor on the weight of a (class, missed) cell after one round."""
    if cost == "adacost":
        c = 1.0 if label == rare else class_cost
        return math.exp(alpha * (0.5 + 0.5 * c)) if missed else math.exp(-alpha * (0.5 - 0.5 * c))
    grown = math.exp(alpha) if missed else 1.0
    return grown * cost_factor if cost == "adauboost" and missed and label == rare else grown


def _key_w(df: DataFrame) -> DataFrame:
    return df.select("key", "vec", "target", "w")


def rusboost(df: DataFrame, n_estimators: int = 50, learning_rate: float = 1.0, algorithm: str = "SAMME",
             sampling_strategy: str = "auto", seed: int = 1000) -> Boosted:
    """Each round is fitted on a fresh balanced under-sample. The strategies name the same class when there are two."""
    if sampling_strategy not in ("auto", "majority", "not minority"):
        raise ValueError(f"unknown strategy {sampling_strategy}")
    return adaboost(df, n_estimators, learning_rate, algorithm, seed=seed,
                    resample=lambda rows, t: R.random_under(rows, "key", "target", 1.0, f"{seed}/{t}"))


def overboost(df: DataFrame, n_estimators: int = 50, learning_rate: float = 1.0, algorithm: str = "SAMME", seed: int = 1000) -> Boosted:
    """Each round is fitted on a fresh balanced over-sample."""
    return adaboost(df, n_estimators, learning_rate, algorithm, seed=seed,
                    resample=lambda rows, t: _key_w(R.random_over(rows, "key", "target", 1.0, f"{seed}/{t}")))


def _with_made(rows: DataFrame, made: DataFrame, rare: int) -> DataFrame:
    """Synthetic rows enter with the average weight of the real ones."""
    mean = rows.agg(F.avg("w").alias("w")).scalar()
    return _key_w(rows).unionByName(made.select(F.lit(None).cast(dict(rows.dtypes)["key"]).alias("key"), "vec", F.lit(rare).alias("target"), mean.alias("w")))


def smoteboost(df: DataFrame, n_estimators: int = 50, learning_rate: float = 1.0, algorithm: str = "SAMME", k_neighbors: int = 5, seed: int = 1000) -> Boosted:
    """Each round adds fresh synthetic minority rows; the neighbour lists are found once."""
    neg, pos = class_sizes(df)
    rare, n = (1, neg - pos) if pos <= neg else (0, pos - neg)
    minority = df.filter(F.col("target") == rare).select("key", F.col("vec").cast("array<double>").alias("vec"))
    near = cut_lineage(knn(minority, None, k_neighbors, "key", "vec", ["vec"]))
    return adaboost(df, n_estimators, learning_rate, algorithm, seed=seed, resample=lambda rows, t: _with_made(
        rows, R._smote_rows(near, minority.select("key"), min(neg, pos), n, "key", "vec", f"{seed}/{t}"), rare))


def kmeans_smoteboost(df: DataFrame, n_estimators: int = 50, learning_rate: float = 1.0, algorithm: str = "SAMME", k_neighbors: int = 5,
                      cluster_balance_threshold="auto", clusters: int = 8, seed: int = 1000) -> Boosted:
    """As above with the synthetic rows made inside minority-rich clusters."""
    def again(rows, t):
        made = R.kmeans_smote(rows, "key", "vec", "target", k_neighbors, clusters, cluster_balance_threshold, seed + t).filter("synthetic")
        return _with_made(rows, made.select("vec"), made_label)
    neg, pos = class_sizes(df)
    made_label = 1 if pos <= neg else 0
    return adaboost(df, n_estimators, learning_rate, algorithm, seed=seed, resample=again)


def adacost(df: DataFrame, **params) -> Boosted:
    return adaboost(df, cost="adacost", **params)


def adauboost(df: DataFrame, **params) -> Boosted:
    return adaboost(df, cost="adauboost", **params)


# ---- bagging ---------------------------------------------------------------------------

def _bags(df: DataFrame, members: int, strategy: str, seed: int) -> DataFrame:
    """All member draws in one table, written once, one folder per member."""
    draws = R.balanced_bootstrap(df.select("key", "vec", F.col("target").cast("int").alias("target")), "key", "target", members, strategy, seed)
    return cut_lineage(draws, "member")


def _bagged(df: DataFrame, n: int, strategy: str, seed: int, fit: Callable[[DataFrame, int], object]) -> Voted:
    bags = _bags(df, n, strategy, seed)
    return Voted(in_parallel([lambda i=i: fit(bags.filter(F.col("member") == i), i) for i in range(n)]))


@dataclass
class Projected:
    """A member that was fitted on some of the vector's columns."""

    member: object
    cols: list

    def groups(self, cols: list | None = None) -> list[Group] | None:
        return self.member.groups(self.cols if cols is None else [cols[i] for i in self.cols])

    def score(self, df: DataFrame, name: str = "prob") -> DataFrame:
        out = self.member.score(_narrow(df, self.cols), name)
        return out.withColumn("vec", F.col("_whole")).select(*[c for c in df.columns if c != FEATURES], name)


def _narrow(df: DataFrame, cols: list) -> DataFrame:
    return df.drop(FEATURES).withColumn("_whole", F.col("vec")).withColumn("vec", F.array(*[F.get("_whole", F.lit(i)) for i in cols]))


def _width(max_features, dims: int) -> int:
    """Number of columns that a member sees: a count, a share, or a rule by name; None: all."""
    if max_features in ("auto", "sqrt", "log2"):
        return max(1, int(math.log2(dims) if max_features == "log2" else math.sqrt(dims)))
    return dims if max_features is None else max(1, min(dims, int(max_features * dims) if isinstance(max_features, float) else max_features))


def easy_ensemble(df: DataFrame, n_estimators: int = 10, rounds: int = 30, max_features=None, seed: int = 1000) -> Voted:
    """Bag of boosted trees, one per balanced draw; with `max_features`, each on its own random columns."""
    dims = len(df.select("vec").first()[0])
    width = _width(max_features, dims)

    def member(part, i):
        if width == dims:
            return adaboost(part, rounds, seed=seed + i)
        cols = sorted(random.Random(seed + i).sample(range(dims), width))
        return Projected(adaboost(_narrow(part, cols).drop("_whole"), rounds, seed=seed + i), cols)
    return _bagged(df, n_estimators, "auto", seed, member)


def balanced_random_forest(df: DataFrame, n_estimators: int = 100, max_depth: int | None = 10, max_features="auto", criterion: str = "gini",
                           sampling_strategy: str = "auto", min_rows: int = 1, seed: int = 1000) -> Voted:
    """One randomised tree per balanced draw."""
    return _bagged(df, n_estimators, sampling_strategy, seed, lambda part, i: random_forest(
        part, 1, max_depth, max_features, criterion, min_rows, bootstrap=False, seed=seed + i))


def balanced_bagging(df: DataFrame, n_estimators: int = 10, sampling_strategy: str = "auto", max_features=None, depth: int = 10, seed: int = 1000) -> Voted:
    """One tree per balanced draw; `max_features` columns per split when given."""
    return _bagged(df, n_estimators, sampling_strategy, seed, lambda part, i: random_forest(
        part, 1, depth, max_features, bootstrap=False, seed=seed + i))


def under_bagging(df: DataFrame, n_estimators: int = 50, max_features=None, depth: int = 10, seed: int = 1000) -> Voted:
    return balanced_bagging(df, n_estimators, "majority", max_features, depth, seed)


def smote_bagging(df: DataFrame, n_estimators: int = 10, k_neighbors: int = 5, depth: int = 10, max_features=None, seed: int = 1000) -> Voted:
    """Member b draws b/B of its minority rows with replacement and makes the rest synthetically."""
    neg, pos = class_sizes(df)
    rare, small, big = (1, pos, neg) if pos <= neg else (0, neg, pos)
    base = df.select("key", F.col("vec").cast("array<double>").alias("vec"), F.col("target").cast("int").alias("target"))
    minority = base.filter(F.col("target") == rare)
    near = cut_lineage(knn(minority.select("key", "vec"), None, k_neighbors, "key", "vec", ["vec"]))
    major = cut_lineage(hash_rank(base.filter(F.col("target") != rare), "key", seed, name="_rank"))
    ranked = cut_lineage(hash_rank(minority, "key", seed, name="_rank"))
    spark = df.sparkSession

    def draw(rows: DataFrame, n: int, size: int, tag: str) -> DataFrame:
        ids = spark.range(n).withColumn("_rank", R.hash32(seed, F.lit(tag), "id") % size + 1)
        return ids.join(rows, "_rank").select("vec", "target")

    def one(b: int):
        again = int(big * (b + 1) / n_estimators)
        made = R._smote_rows(near, minority.select("key"), small, big - again, "key", "vec", f"{seed}/{b}").select("vec", F.lit(rare).alias("target"))
        part = draw(major, big, big, f"maj{b}").unionByName(draw(ranked, again, small, f"min{b}")).unionByName(made)
        return random_forest(part, 1, depth, max_features, bootstrap=False, seed=seed + b)

    return Voted(in_parallel([lambda b=b: one(b) for b in range(n_estimators)]))


def balance_cascade(df: DataFrame, n_estimators: int = 10, depth: int = 10, criterion: str = "gini", seed: int = 1000) -> Voted:
    """After each member, drop the majority rows the ensemble already classifies best."""
    neg, pos = class_sizes(df)
    ratio = min(neg, pos) / max(neg, pos)
    rare = 1 if pos <= neg else 0
    rows = df.select("key", "vec", F.col("target").cast("int").alias("target"))
    left, fitted = rows, Voted()
    for t in range(n_estimators):
        part = R.random_under(left, "key", "target", 1.0, f"{seed}/{t}")
        fitted.members.append(tree(part, depth, criterion, seed=seed + t))
        if t < n_estimators - 1:
            n_left = left.filter(F.col("target") != rare).count()
            if n_left <= min(neg, pos):
                break
            scored = cut_lineage(fitted.score(left, "_p"))
            left = cut_lineage(R.cascade_keep(scored, "key", "target", "_p", ratio, n_estimators).drop("_p"))
    return fitted


def self_paced_ensemble(df: DataFrame, n_estimators: int = 10, depth: int = 10, criterion: str = "gini", bins: int = 5, seed: int = 1000) -> Voted:
    """Each member sees a majority sample chosen by hardness under the members so far."""
    rows = df.select("key", "vec", F.col("target").cast("int").alias("target"))
    fitted = Voted([tree(R.random_under(rows, "key", "target", 1.0, seed), depth, criterion, seed=seed)])
    for t in range(1, n_estimators):
        scored = cut_lineage(fitted.score(rows, "_p"))
        part = R.self_paced_under(scored, "key", "target", "_p", t, n_estimators, bins, seed)
        fitted.members.append(tree(part, depth, criterion, seed=seed + t))
    return fitted
