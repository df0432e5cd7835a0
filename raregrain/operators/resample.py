"""Class rebalancing. Every operator takes training rows (key, target, ...) with a 0/1 label.

Positions are seeded hash ranks, draws are numbered rows of a distributed range joined to
those ranks, so no class is ever collected and the same seed gives the same rows.
`vec` operators return (key, vec, target); new rows get keys after the largest one.
"""
from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.ml.clustering import KMeans
from pyspark.ml.functions import array_to_vector
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from raregrain.functions.columns import hash32, hash_unit
from raregrain.operators.neighbours import knn
from raregrain.operators.ranking import hash_bucket, hash_rank, order_statistic, take_first, take_hashed, value_borders, value_bucket
from raregrain.operators.weights import class_sizes
from raregrain.session import cut_lineage, join_by_key

DRAWS_PER_PIECE = 1000


def _draws(df: DataFrame, count: int) -> DataFrame:
    """`count` numbered draws, spread over the cluster."""
    return df.sparkSession.range(max(count, 0)).withColumnRenamed("id", "draw")


def random_over(df: DataFrame, key: str, target: str, alpha: float, seed=42) -> DataFrame:
    """Add int(alpha * majority) - minority draws with replacement from the minority; `copy` marks them."""
    neg, pos = class_sizes(df, target)
    extra = int(alpha * max(neg, pos)) - min(neg, pos)
    if extra < 0:
        raise ValueError("the minority is already larger than the asked ratio")
    rare = 1 if pos <= neg else 0
    ranked = hash_rank(df.filter(F.col(target) == rare), key, seed, name="_rank")
    picks = _draws(df, extra).withColumn("_rank", hash32(seed, F.lit("over"), "draw") % F.lit(max(min(neg, pos), 1)) + 1)
    added = picks.join(ranked, "_rank").select(*df.columns, (F.col("draw") + 1).alias("copy"))
    return df.withColumn("copy", F.lit(0).cast("bigint")).unionByName(added)


def _majority_quota(df: DataFrame, target: str, keep: int, majority: int) -> DataFrame:
    return df.sparkSession.createDataFrame([(majority, keep)], f"{target} int, quota bigint")


def random_under(df: DataFrame, key: str, target: str, alpha: float, seed=42) -> DataFrame:
    """Keep int(minority / alpha) majority rows without replacement, and the whole minority."""
    neg, pos = class_sizes(df, target)
    majority = 0 if pos <= neg else 1
    quota = _majority_quota(df, target, min(int(min(neg, pos) / alpha), max(neg, pos)), majority)
    return take_hashed(df.withColumn(target, F.col(target).cast("int")), key, seed, quota, [target])


def epoch_rebalance(df: DataFrame, key: str, target: str, copies: int, ratio: float, seed=42, epoch: int = 0) -> DataFrame:
    """Minority rows `copies` times, plus a fresh int(ratio * majority) sample each epoch."""
    neg, pos = class_sizes(df, target)
    rare = 1 if pos <= neg else 0
    many = df.filter(F.col(target) == rare).withColumn("copy", F.explode(F.sequence(F.lit(1), F.lit(copies))))
    major = df.filter(F.col(target) != rare).withColumn(target, F.col(target).cast("int"))
    quota = _majority_quota(df, target, int(ratio * max(neg, pos)), 1 - rare)
    sample = take_hashed(major, key, f"{seed}/{epoch}", quota, [target]).withColumn("copy", F.lit(1))
    return many.withColumn(target, F.col(target).cast("int")).unionByName(sample)


STRATEGIES = {"majority": {"majority"}, "not minority": {"majority"}, "auto": {"majority"},
              "not majority": {"minority"}, "all": {"majority", "minority"}}


def balanced_bootstrap(df: DataFrame, key: str, target: str, members: int, strategy: str = "auto", seed=42) -> DataFrame:
    """One balanced draw per ensemble member, as rows (member, copy, ...).

    Classes named by the strategy are drawn with replacement at the minority's size,
    the other class is kept whole for each member. Keys must be unique.
    """
    if strategy not in STRATEGIES:
        raise ValueError(f"unknown strategy {strategy}")
    neg, pos = class_sizes(df, target)
    small = min(neg, pos)
    rare = 1 if pos <= neg else 0
    role = {rare: "minority", 1 - rare: "majority"}
    size = {0: neg, 1: pos}
    out = None
    for label in (0, 1):
        rows = df.filter(F.col(target) == label)
        if role[label] in STRATEGIES[strategy]:
            # only keys are ranked; the few drawn keys are written first, so that their known
            # size lets the planner avoid shuffling the wide rows they are looked up in
            ranked = hash_rank(rows.select(key), key, seed, name="_rank")
            picks = _draws(df, members * small).select(
                (F.col("draw") / small).cast("int").alias("member"), (F.col("draw") % small).alias("copy"),
                (hash32(seed, F.lit(label), "draw") % F.lit(max(size[label], 1)) + 1).alias("_rank"))
            drawn = cut_lineage(picks.join(ranked, "_rank").select("member", "copy", key))
            part = drawn.join(rows, key).select("member", "copy", *df.columns)
        else:
            part = rows.select(F.explode(F.sequence(F.lit(0), F.lit(members - 1))).alias("member"),
                               F.lit(0).cast("bigint").alias("copy"), *df.columns)
        out = part if out is None else out.unionByName(part)
    return out


# ---- neighbour based -------------------------------------------------------------------

def _sides(df: DataFrame, target: str) -> tuple[DataFrame, DataFrame, int, int, int]:
    neg, pos = class_sizes(df, target)
    rare = 1 if pos <= neg else 0
    return df.filter(F.col(target) == rare), df.filter(F.col(target) != rare), rare, min(neg, pos), max(neg, pos)


def _new_key(df: DataFrame, key: str, number):
    """Keys that no row has: beyond the largest number, or the largest text with the number after it."""
    kind = dict(df.dtypes)[key]
    if kind == "string":
        return F.concat(df.agg(F.max(key).alias("k")).scalar(), F.lit("/"), number.cast("string"))
    return (number + df.agg((F.max(key) + 1).alias("k")).scalar()).cast(kind)


def _interpolate(near: DataFrame, draws: DataFrame, key: str, vec: str, seed, tag: str) -> DataFrame:
    """Draw -> its seed row -> one of the seed's neighbours -> point between the two."""
    u = hash_unit(seed, F.lit(tag + "u"), "draw")
    n = F.element_at("nn", (hash32(seed, F.lit(tag + "n"), "draw") % F.size("nn") + 1).cast("int"))
    return draws.join(near, key).withColumn("_n", n).withColumn("_u", u).select(
        "draw", F.zip_with(F.col(vec), F.col(f"_n.{vec}"), lambda x, z: x + F.col("_u") * (z - x)).alias(vec))


def smote(df: DataFrame, key: str, vec: str, target: str, k: int = 5, n: int | None = None, seed=42,
          alpha: float | None = None) -> DataFrame:
    """Add synthetic minority rows between a minority row and one of its k minority neighbours."""
    minority, _, rare, small, big = _sides(df, target)
    n = n if n is not None else (int(alpha * big) - small if alpha else big - small)
    near = knn(minority.select(key, vec), None, k, key, vec, [vec])
    return _with_synthetic(df, key, vec, target, rare, _smote_rows(near, minority.select(key), small, n, key, vec, seed))


def _smote_rows(near: DataFrame, seeds: DataFrame, size: int, n: int, key: str, vec: str, seed) -> DataFrame:
    """n draws over the ranked seed keys, each resolved against the seed's neighbour list."""
    ranked = hash_rank(seeds, key, seed, name="_rank")
    picks = _draws(near, n).withColumn("_rank", hash32(seed, F.lit("s"), "draw") % F.lit(max(size, 1)) + 1)
    return _interpolate(near, picks.join(ranked, "_rank").drop("_rank"), key, vec, seed, "s")


def _with_synthetic(df: DataFrame, key: str, vec: str, target: str, rare: int, rows: DataFrame) -> DataFrame:
    base = df.select(key, F.col(vec).cast("array<double>").alias(vec), F.col(target).cast("int").alias(target), F.lit(False).alias("synthetic"))
    made = rows.select(_new_key(df, key, F.col("draw")).alias(key), vec, F.lit(rare).alias(target), F.lit(True).alias("synthetic"))
    return base.unionByName(made)


def adasyn(df: DataFrame, key: str, vec: str, target: str, k: int = 5, seed=42) -> DataFrame:
    """Draws per minority row in proportion to the majority share among its k neighbours."""
    minority, _, rare, small, big = _sides(df, target)
    all_near = knn(minority.select(key, vec), df.select(key, vec, target), k, key, vec, [target])
    share = cut_lineage(all_near.select(key, (F.size(F.filter("nn", lambda x: x[target] != rare)) / F.lit(k)).alias("_share")))
    total = share.agg(F.sum("_share").alias("t")).first()["t"] or 0.0
    if total == 0.0:
        raise ValueError("no minority row has a majority neighbour")
    near = knn(minority.select(key, vec), None, k, key, vec, [vec]).join(share, key)
    todo = near.withColumn("_g", F.round(F.col("_share") * F.lit((big - small) / total)).cast("int")).filter("_g > 0")
    # a row asked for very many draws is first cut into pieces that spread over the cluster
    pieces = todo.withColumn("_c", F.explode(F.sequence(F.lit(0), F.floor((F.col("_g") - 1) / DRAWS_PER_PIECE).cast("int")))).repartition(key, "_c")
    first = F.col("_c") * DRAWS_PER_PIECE + 1
    each = pieces.withColumn("_j", F.explode(F.sequence(first, F.least(first + (DRAWS_PER_PIECE - 1), F.col("_g")))))
    u = hash_unit(seed, F.lit("au"), key, "_j")
    nb = F.element_at("nn", (hash32(seed, F.lit("an"), key, "_j") % F.size("nn") + 1).cast("int"))
    made = each.withColumn("_n", nb).withColumn("_u", u).select(
        F.concat_ws("/", F.col(key).cast("string"), F.col("_j").cast("string")).alias("_name"),
        F.zip_with(F.col(vec), F.col(f"_n.{vec}"), lambda x, z: x + F.col("_u") * (z - x)).alias(vec))
    numbered = hash_rank(cut_lineage(made), "_name", seed, name="_rank").withColumn("draw", (F.col("_rank") - 1).cast("bigint"))
    return _with_synthetic(df, key, vec, target, rare, numbered)


def danger_rows(df: DataFrame, key: str, vec: str, target: str, m: int = 10) -> DataFrame:
    """Minority rows with at least half, but not all, of their m neighbours in the majority."""
    minority, _, rare, _, _ = _sides(df, target)
    near = knn(minority.select(key, vec), df.select(key, vec, target), m, key, vec, [target])
    others = F.size(F.filter("nn", lambda x: x[target] != rare))
    return near.select(key, vec, others.alias("majority_near")).filter((F.col("majority_near") >= m / 2) & (F.col("majority_near") < m))


def borderline_smote(df: DataFrame, key: str, vec: str, target: str, k: int = 5, m: int = 10, seed=42) -> DataFrame:
    """SMOTE whose seeds are only the danger rows; neighbours come from the whole minority."""
    minority, _, rare, small, big = _sides(df, target)
    danger = cut_lineage(danger_rows(df, key, vec, target, m).select(key, vec))
    seeds = danger.count()
    if seeds == 0:
        return _with_synthetic(df, key, vec, target, rare, _draws(df, 0).withColumn(vec, F.array().cast("array<double>")))
    near = knn(danger, minority.select(key, vec), k, key, vec, [vec])
    return _with_synthetic(df, key, vec, target, rare, _smote_rows(near, danger.select(key), seeds, big - small, key, vec, seed))


def class_profiles(df: DataFrame, cols: list[str], target: str, sizes: bool = False) -> DataFrame:
    """P(class | value) per column and value, as (column, value, p0, p1), with `sizes` also its rows n."""
    cells = ", ".join(f"'{c}', cast({c} as string)" for c in cols)
    long = df.selectExpr(target, f"stack({len(cols)}, {cells}) as (column, value)")
    return long.groupBy("column", "value").agg(
        F.avg((F.col(target) == 0).cast("double")).alias("p0"), F.avg((F.col(target) == 1).cast("double")).alias("p1"),
        *([F.count(F.lit(1)).alias("n")] if sizes else []))


def smoten(df: DataFrame, key: str, cols: list[str], target: str, k: int = 5, seed=42) -> DataFrame:
    """Categorical SMOTE. The value-difference metric summed over columns is the city-block
    distance between class profiles, so the neighbours come from the ordinary search."""
    minority, _, rare, small, big = _sides(df, target)
    # one join for all columns: a row's cells meet the profiles as (column, value) and come back together in the columns' order
    place = F.create_map(*[x for i, c in enumerate(cols) for x in (F.lit(c), F.lit(i))])
    names = F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).cast("string").alias("value")) for c in cols])
    numbered = cut_lineage(minority.select(F.monotonically_increasing_id().alias("_row"), key, *cols))
    cells = numbered.select("_row", F.explode(names).alias("_c")).select("_row", "_c.column", "_c.value").filter(F.col("value").isNotNull())
    profiles = join_by_key(cells, class_profiles(df, cols, target, sizes=True), ["column", "value"], "n")
    packed = profiles.groupBy("_row").agg(F.array_sort(F.collect_list(F.struct(place[F.col("column")].alias("i"), "p0", "p1"))).alias("_p"))
    # as in a join for each column, a row with a null cell has no profile
    coded = numbered.join(packed.filter(F.size("_p") == len(cols)), "_row").select(
        key, *cols, F.flatten(F.transform("_p", lambda x: F.array(x["p0"], x["p1"]))).alias("_vec"))
    near = knn(coded, None, k, key, "_vec", list(cols), metric="cityblock")
    voted = near.select(key, *[_most_frequent(c).alias(c) for c in cols])
    ranked = hash_rank(minority.select(key), key, seed, name="_rank")
    picks = _draws(df, big - small).withColumn("_rank", hash32(seed, F.lit("s"), "draw") % F.lit(max(small, 1)) + 1)
    made = picks.join(ranked, "_rank").join(voted, key).drop(key).select(_new_key(df, key, F.col("draw")).alias(key), *cols,
                                              F.lit(rare).alias(target), F.lit(True).alias("synthetic"))
    return df.select(key, *cols, F.col(target).cast("int").alias(target), F.lit(False).alias("synthetic")).unionByName(made)


def _most_frequent(col: str):
    """Most frequent value of one payload column in `nn`; ties go to the smallest value."""
    values = F.transform("nn", lambda x: x[col])
    scored = F.transform(F.array_distinct(values), lambda v: F.struct(
        (-F.size(F.filter(values, lambda w: w == v))).alias("n"), v.alias("v")))
    return F.array_min(scored)["v"]


def kmeans_smote(df: DataFrame, key: str, vec: str, target: str, k: int = 5, clusters: int = 8,
                 threshold: float | str = "auto", seed=42) -> DataFrame:
    """Cluster, keep clusters whose minority share passes the threshold, SMOTE inside each.

    A cluster's share of the new rows follows its sparsity: mean minority distance ^ dims / minority rows.
    """
    minority, _, rare, small, big = _sides(df, target)
    points = df.select(key, F.col(vec).cast("array<double>").alias(vec), F.col(target).cast("int").alias(target))
    fitted = KMeans(k=clusters, seed=int(seed), featuresCol="_f", predictionCol="_cluster").fit(points.withColumn("_f", array_to_vector(vec)))
    placed = cut_lineage(fitted.transform(points.withColumn("_f", array_to_vector(vec))).drop("_f"))
    bar = small / (small + big) if threshold == "auto" else float(threshold)
    # the mean pairwise squared distance of a set follows from its per-dimension sums
    dims = len(fitted.clusterCenters()[0])
    rare_part = placed.filter(F.col(target) == rare)
    spread = rare_part.groupBy("_cluster").agg(
        F.count(F.lit(1)).alias("m"),
        *[F.var_pop(F.col(vec)[i]).alias(f"_v{i}") for i in range(dims)])
    sizes = placed.groupBy("_cluster").agg(F.count(F.lit(1)).alias("n"))
    stats = [(r["_cluster"], r["m"], sum(r[f"_v{i}"] for i in range(dims)))
             for r in spread.join(sizes, "_cluster").collect() if r["m"] > k and r["m"] / r["n"] >= bar]
    if not stats:
        raise ValueError("no cluster has enough minority rows")
    logs = [dims * 0.5 * math.log(max(2 * v, 1e-300)) - math.log(m) for _, m, v in stats]
    top = max(logs)
    weights = [math.exp(x - top) for x in logs]
    todo, left, made = big - small, big - small, None
    for at, ((cluster, m, _), w) in enumerate(zip(stats, weights)):
        n = left if at == len(stats) - 1 else min(left, int(round(todo * w / sum(weights))))
        left -= n
        members = rare_part.filter(F.col("_cluster") == cluster).select(key, vec)
        near = knn(members, None, k, key, vec, [vec])
        part = _smote_rows(near, members.select(key), m, n, key, vec, f"{seed}/{cluster}").withColumn("draw", F.col("draw") + (todo - left - n))
        made = part if made is None else made.unionByName(part)
    return _with_synthetic(df, key, vec, target, rare, made)


def near_miss(df: DataFrame, key: str, vec: str, target: str, k: int = 3) -> DataFrame:
    """Keep the minority and as many majority rows, those nearest on average to k minority rows."""
    minority, majority, rare, small, _ = _sides(df, target)
    near = knn(majority.select(key, vec, target), minority.select(key, vec), k, key, vec)
    scored = near.withColumn("mean_distance", F.aggregate("nn", F.lit(0.0), lambda s, x: s + x["distance"]) / F.size("nn")).drop("nn")
    kept = lowest_values(cut_lineage(scored), "mean_distance", key, small)
    return minority.select(key, vec, F.col(target).cast("int").alias(target), F.lit(None).cast("double").alias("mean_distance")).unionByName(
        kept.select(key, vec, F.col(target).cast("int").alias(target), "mean_distance"))


def lowest_values(df: DataFrame, col: str, key: str, n: int) -> DataFrame:
    """The n rows with the lowest value, ties by key (by key hash when keys are not numbers).

    The cut value is found exactly first. Rows below it pass straight through, and rows
    equal to it, however many, are cut by key buckets.
    """
    if n >= df.count():
        return df
    cut = order_statistic(df, col, max(n - 1, 0))
    below, at = df.filter(F.col(col) < cut), df.filter(F.col(col) == cut)
    quota = df.sparkSession.createDataFrame([(0, n - below.count())], "_all int, quota bigint")
    numeric = dict(df.dtypes)[key] in ("int", "bigint", "smallint", "tinyint", "double", "float")
    bucket, order = (value_bucket(key, value_borders(at, key)), [key]) if numeric else (hash_bucket(hash32(0, key), 16), [hash32(0, key), key])
    kept = take_first(at.withColumn("_b", bucket).withColumn("_all", F.lit(0)), ["_all"], "_b", order, quota)
    return below.unionByName(kept.select(*df.columns))


def tomek_links(df: DataFrame, key: str, vec: str, target: str) -> DataFrame:
    """Pairs of opposite class that are each other's nearest row."""
    one = knn(df.select(key, vec, target), None, 1, key, vec, [target])
    near = cut_lineage(one.select(F.col(key).alias("a"), F.col(target).alias("a_target"), F.col("nn")[0]["key"].alias("b"), F.col("nn")[0][target].alias("b_target")))
    back = near.select(F.col("a").alias("b"), F.col("b").alias("a"))
    return near.filter(F.col("a_target") != F.col("b_target")).join(back, ["a", "b"])


def tomek(df: DataFrame, key: str, vec: str, target: str, both: bool = False) -> DataFrame:
    """Drop the majority end (or both ends) of every Tomek link."""
    _, _, rare, _, _ = _sides(df, target)
    links = tomek_links(df, key, vec, target)
    ends = links if both else links.filter(F.col("a_target") != rare)
    return df.join(ends.select(F.col("a").alias(key)), key, "left_anti")


def edited_nearest(df: DataFrame, key: str, vec: str, target: str, k: int = 3) -> DataFrame:
    """Keep rows whose k neighbours all share their class."""
    near = knn(df.select(key, vec, target), None, k, key, vec, [target])
    clash = near.filter(F.exists("nn", lambda x: x[target] != F.col(target))).select(key)
    return df.join(clash, key, "left_anti")


def smote_tomek(df: DataFrame, key: str, vec: str, target: str, k: int = 5, seed=42) -> DataFrame:
    return tomek(cut_lineage(smote(df, key, vec, target, k, seed=seed)), key, vec, target, both=True)


def smote_enn(df: DataFrame, key: str, vec: str, target: str, k: int = 5, seed=42) -> DataFrame:
    return edited_nearest(cut_lineage(smote(df, key, vec, target, k, seed=seed)), key, vec, target)


def cluster_centroids(df: DataFrame, key: str, vec: str, target: str, steps: int = 1000, seed=42) -> DataFrame:
    """Replace the majority by as many K-means centres as there are minority rows.

    Lloyd rounds as joins and aggregates: centres start at the majority rows of lowest hash, every row finds
    its nearest centre by the exact search, and a centre moves to its rows' mean (an empty one stays). Rounds
    end when every centre keeps the rows it had; not to get there within `steps` raises. The result does not depend
    on the number of rows or partitions.
    """
    minority, majority, rare, small, _ = _sides(df, target)
    dims = len(df.select(vec).first()[0])
    rows = cut_lineage(majority.select(F.concat(F.lit("row/"), F.col(key).cast("string")).alias("_k"), F.col(vec).cast("array<double>").alias(vec), F.col(key).alias("_own")))
    first = hash_rank(rows, "_own", seed, name="_rank").filter(F.col("_rank") <= small)
    # centres and rows have keys of their own kind, as the search leaves out a row's own key
    centres = cut_lineage(first.select((F.col("_rank") - 1).cast("bigint").alias("_at"), vec, F.lit(None).cast("string").alias("_rows")))
    for _ in range(steps):
        named = centres.select(F.concat(F.lit("centre/"), F.lpad(F.col("_at").cast("string"), 19, "0")).alias("_k"), vec, "_at")
        near = knn(rows.select("_k", vec), named, 1, "_k", vec, ["_at"])
        moved = near.select(F.col("nn")[0]["_at"].alias("_at"), "_k", vec).groupBy("_at").agg(
            F.array(*[F.avg(F.col(vec)[i]) for i in range(dims)]).alias("_mean"),
            F.concat_ws("/", F.count(F.lit(1)), F.bit_xor(F.xxhash64("_k"))).alias("_now"))
        # a centre's rows are told by their number and hash, as means of the same rows may differ in the last digit
        centres = cut_lineage(centres.join(moved, "_at", "left").select("_at", F.coalesce("_mean", vec).alias(vec), F.coalesce("_now", F.lit("none")).alias("_rows"),
                                                                        F.coalesce(F.col("_rows") == F.coalesce("_now", F.lit("none")), F.lit(False)).alias("_still")))
        if not centres.filter("not _still").limit(1).count():
            break
    else:
        raise RuntimeError(f"K-means centres still moved after {steps} rounds")
    base = minority.select(key, F.col(vec).cast("array<double>").alias(vec), F.col(target).cast("int").alias(target), F.lit(False).alias("synthetic"))
    made = centres.select(_new_key(df, key, F.col("_at")).alias(key), vec, F.lit(1 - rare).alias(target), F.lit(True).alias("synthetic"))
    return base.unionByName(made)


# ---- hardness based --------------------------------------------------------------------

def hardness_bins(scored: DataFrame, target: str, prob: str, bins: int = 5) -> DataFrame:
    """Add hardness |p - y| and its equal-width bin over the majority rows."""
    h = F.abs(F.col(prob) - F.col(target))
    work = scored.withColumn("hardness", h)
    lo = work.agg(F.min("hardness").alias("v")).scalar()
    hi = work.agg(F.max("hardness").alias("v")).scalar()
    at = F.coalesce(F.try_divide((F.col("hardness") - lo) * bins, hi - lo), F.lit(0.0))
    return work.withColumn("bin", F.least(F.floor(at), F.lit(bins - 1)).cast("int"))


def self_paced_under(scored: DataFrame, key: str, target: str, prob: str, round_no: int, rounds: int, bins: int = 5, seed=42) -> DataFrame:
    """Majority sample whose bin quota moves from equal contribution to equal weight over the rounds."""
    minority, majority, rare, small, _ = _sides(scored, target)
    binned = hardness_bins(majority, target, prob, bins)
    shift = math.tan(math.pi * round_no / (2 * rounds)) if round_no < rounds else math.inf
    stats = binned.groupBy("bin").agg(F.count(F.lit(1)).alias("n"), F.avg("hardness").alias("h")).collect()  # one row per bin
    weight = {r["bin"]: 1.0 if math.isinf(shift) else 1.0 / (r["h"] + shift + 1e-12) for r in stats}
    quotas = [(r["bin"], int(min(r["n"], round(small * weight[r["bin"]] / sum(weight.values()))))) for r in stats]
    quota = scored.sparkSession.createDataFrame(quotas, "bin int, quota bigint")
    kept = take_hashed(binned, key, f"{seed}/{round_no}", quota, ["bin"])
    return minority.unionByName(kept.select(*minority.columns))


def cascade_keep(scored: DataFrame, key: str, target: str, prob: str, start_ratio: float, rounds: int) -> DataFrame:
    """Drop the majority rows already classified best, keeping the share ratio^(1/(rounds-1))."""
    minority, majority, rare, _, big = _sides(scored, target)
    rate = start_ratio ** (1.0 / max(rounds - 1, 1))
    risk = majority.withColumn("_risk", -F.abs(F.col(prob) - F.col(target)))
    kept = lowest_values(risk, "_risk", key, int(math.ceil(big * rate)))
    return minority.unionByName(kept.select(*minority.columns))
