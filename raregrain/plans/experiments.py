"""Trials over folds: fit on the training side, score the held-out side, rank the trials."""
from __future__ import annotations

import hashlib
import itertools
import json
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from raregrain.operators import metrics as M
from raregrain.operators import trials as T
from raregrain.operators.ensembles import in_parallel
from raregrain.operators.learners import Voted, boosted_trees
from raregrain.operators.prep import fit_prep
from raregrain.operators.resample import random_over, random_under
from raregrain.operators.splits import fold_sides
from raregrain.operators.weights import class_sizes
from raregrain.plans.registry import Builder, build
from raregrain.session import cut_lineage, ensure_checkpoint_dir

Scorer = Callable[[DataFrame, list[str]], DataFrame]


def prepared_folds(folded: DataFrame, key: str, target: str, num_cols: list[str], cat_cols: list[str] = (), k: int = 5) -> list[tuple[DataFrame, DataFrame]]:
    """(train, test) per fold with `vec` features. The preprocessor is fitted once per fold,
    on its training side, and shared by every trial."""
    out = []
    for fold in range(k):
        train, test = fold_sides(folded, fold)
        prep = fit_prep(train, list(num_cols), list(cat_cols))
        both = prep.transform(folded).select(F.col(key).alias("key"), F.col("features").alias("vec"), F.col(target).cast("int").alias("target"), "fold")
        table = cut_lineage(both)
        train, test = fold_sides(table, fold)
        out.append((train.drop("fold"), test.drop("fold")))
    return out


def expand_trials(name: str, grid: dict[str, list]) -> list[Builder]:
    keys = list(grid)
    return [build(name, dict(zip(keys, values))) for values in itertools.product(*grid.values())]


def _rows_seen(df: DataFrame) -> str:
    """Short text that changes when the rows do, whatever their order."""
    h = F.xxhash64("key", "target", "vec")
    return "/".join(str(v) for v in df.agg(F.count("*"), F.bit_xor(h), F.sum(h.cast("decimal(38,0)"))).first())


def part_names(folds: list[tuple[DataFrame, DataFrame]], trials: list[Builder], threshold: float) -> dict[tuple[int, int], str]:
    """(trial, fold) -> a name that follows from the preset, its parameters, the threshold and the fold's rows."""
    rows = [f"{_rows_seen(train)} {_rows_seen(test)}" for train, test in folds]
    asked = [json.dumps([b.name, b.params, b.k_neighbors, threshold], sort_keys=True, default=str) for b in trials]
    return {(t, f): hashlib.md5(f"{what} {seen}".encode()).hexdigest() for t, what in enumerate(asked) for f, seen in enumerate(rows)}


def score_trials(folds: list[tuple[DataFrame, DataFrame]], trials: list[Builder], threshold: float = 0.5, threads: int = 4,
                 store: str | None = None) -> DataFrame:
    """Held-out rows of every (trial, fold): (trial, fold, key, target, score, pred).

    Each part is written as soon as it is scored, then marked as done, so the result is one scan
    however many parts there are. With `store`, a folder all executors reach, a later call takes the
    parts that are done from there: a stopped search goes on, a longer grid adds its new trials, and
    other rows or parameters are scored afresh. Only one search at a time may write to a store.
    """
    spark = folds[0][0].sparkSession
    if store is None:
        ensure_checkpoint_dir(spark)
        store = f"{spark.sparkContext.getCheckpointDir()}/search-{uuid.uuid4().hex}"
        names = {(t, f): f"{t}-{f}" for t in range(len(trials)) for f in range(len(folds))}
    else:
        names = part_names(folds, trials, threshold)
    spark.range(1).select(F.col("id").alias("rows")).write.mode("overwrite").parquet(f"{store}/done/part=none")
    done = {r["part"] for r in spark.read.schema("rows bigint, part string").parquet(f"{store}/done").select("part").distinct().collect()}
    # trials that ask for the same share a part
    todo = {name: at for at, name in names.items() if name not in done}

    def one(name: str, t: int, f: int) -> None:
        train, test = folds[f]
        rows = trials[t].fit(train).score(test, "score").select("key", "target", "score", (F.col("score") > threshold).cast("int").alias("pred"))
        rows.write.mode("overwrite").parquet(f"{store}/parts/part={name}")
        part = spark.read.schema(rows.schema).parquet(f"{store}/parts/part={name}")
        # the mark follows the rows: a part without one is scored again
        part.agg(F.count("*").alias("rows")).write.mode("overwrite").parquet(f"{store}/done/part={name}")

    if todo:
        in_parallel([lambda name=name, at=at: one(name, *at) for name, at in todo.items()], threads)
    scored = spark.read.parquet(f"{store}/parts/part={next(iter(names.values()))}")
    parts = spark.read.schema(scored.schema.add("part", "string")).parquet(f"{store}/parts").filter(F.col("part").isin(sorted(set(names.values()))))
    # one short row per (trial, fold)
    wanted = spark.createDataFrame([(t, f, name) for (t, f), name in names.items()], "trial int, fold int, part string")
    return parts.join(F.broadcast(wanted), "part").select("trial", "fold", "key", "target", "score", "pred")


def run_trials(folds: list[tuple[DataFrame, DataFrame]], trials: list[Builder], refit_metric: str = "pauc_score",
               store: str | None = None) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(scores, leaderboard, best trial) for a list of builders; `store` as in `score_trials`."""
    scores = cut_lineage(M.all_metrics(score_trials(folds, trials, store=store), ["trial", "fold"]))
    board = T.leaderboard(scores)
    return scores, board, T.best_trial(board, refit_metric)


def refit_best(folded_train: DataFrame, trials: list[Builder], best: DataFrame):
    """Fit the winning trial on all rows."""
    return trials[best.first()["trial"]].fit(folded_train)


def cross_score(builder: Builder, folds: list[tuple[DataFrame, DataFrame]], scorer: Scorer | None = None, on_error: str = "raise") -> tuple[list[float], float]:
    """Score per fold and their mean; with on_error='zero' a fold that cannot be fitted scores 0."""
    scorer = scorer or (lambda scored, by: M.pauc(scored, by, name="value"))
    values = []
    for train, test in folds:
        try:
            scored = builder.fit(train).score(test, "score").withColumn("pred", (F.col("score") > 0.5).cast("int"))
            values.append(float(scorer(scored, []).first()["value"]))
        except ValueError:
            if on_error != "zero":
                raise
            values.append(0.0)
    return values, sum(values) / len(values)


def voted_candidate(folds: list[tuple[DataFrame, DataFrame]], members: list[dict], over: float = 0.003, under: float = 0.01, seed: int = 42) -> DataFrame:
    """Fitness of one candidate: over- then under-sample, fit all members, vote, partial AUC per fold."""
    parts = []
    for f, (train, test) in enumerate(folds):
        rows = train.select("key", "vec", "target")
        neg, pos = class_sizes(rows)
        if pos < int(over * neg):
            rows = random_over(rows, "key", "target", over, seed).select(F.concat_ws("/", "key", "copy").alias("key"), "vec", "target")
        rows = cut_lineage(random_under(rows, "key", "target", under, seed))
        voted = Voted(in_parallel([lambda p=p: boosted_trees(rows, **p) for p in members]))
        parts.append(voted.score(test, "score").select(F.lit(f).alias("fold"), "target", "score"))
    scored = parts[0]
    for p in parts[1:]:
        scored = scored.unionByName(p)
    return M.pauc(cut_lineage(scored), ["fold"])


def run_batch(folds: list[tuple[DataFrame, DataFrame]], specs: list[tuple[str, dict[str, list]]], store: str | None = None) -> DataFrame:
    """Many classifiers over the same prepared folds: scores with the classifier's name; `store` as in `score_trials`."""
    builders, names = [], []
    for name, grid in specs:
        for b in expand_trials(name, grid):
            builders.append(b)
            names.append(name)
    scored = score_trials(folds, builders, store=store)
    lookup = F.get(F.array(*[F.lit(n) for n in names]), F.col("trial"))
    return M.all_metrics(scored, ["trial", "fold"]).withColumn("classifier", lookup)
