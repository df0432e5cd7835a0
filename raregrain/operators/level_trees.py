"""Isolation trees on samples of any size, grown level by level.

A level is one aggregate over (tree, node): how many sampled rows a node holds, and the lowest and
highest value of the feature that a hash of the node names. A node whose feature has a single value
takes another one, by hash, among those that do vary there. Thresholds follow from the range and a
hash, rows are routed by a join with the nodes, and rows of finished nodes leave. No node's rows meet
in one task, the nodes never leave Spark, and every draw can be repeated from the seed.
"""
from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from raregrain.functions.columns import hash32, hash_unit
from raregrain.operators.ranking import take_hashed
from raregrain.session import cut_lineage, join_by_key

NODE = ["tree", "node"]


def average_path(n: Column) -> Column:
    """Mean depth of an unsuccessful search in a tree of n rows."""
    m = n.cast("double")
    long = 2 * (F.log(m - 1) + F.lit(0.5772156649015329)) - 2 * (m - 1) / m
    return F.when(n <= 1, F.lit(0.0)).when(n == 2, F.lit(1.0)).otherwise(long)


def feature_subsets(trees: int, dims: int, max_features: float, seed) -> Column:
    """Features that a tree may split on: the lowest by hash, as an array over the column `tree`."""
    every = F.transform(F.sequence(F.lit(0), F.lit(dims - 1)), lambda f: F.struct(hash32(seed, F.lit("subset"), "tree", f).alias("h"), f.alias("f")))
    return F.transform(F.slice(F.array_sort(every), 1, max(1, int(dims * max_features))), lambda s: s["f"])


def _varying(members: DataFrame, x: DataFrame, key: str, subsets: DataFrame, seed) -> DataFrame:
    """(tree, node, f, lo, hi): for each node one feature, by hash, among those with more than one value."""
    values = members.join(x, key).join(F.broadcast(subsets), "tree").select(*NODE, F.posexplode("x").alias("f", "v"), "cols").filter(F.array_contains("cols", F.col("f")))
    ranges = values.groupBy(*NODE, "f").agg(F.min("v").alias("lo"), F.max("v").alias("hi")).filter("hi > lo")
    picked = ranges.groupBy(*NODE).agg(F.min_by(F.struct("f", "lo", "hi"), F.struct(hash32(seed, F.lit("again"), *NODE, "f"), "f")).alias("s"))
    return picked.select(*NODE, "s.*")


def path_sums(rows: DataFrame, key: str, trees: int, size: int, max_features: float = 1.0, seed=0) -> DataFrame:
    """(key, path): depths at which `trees` trees, grown on `size` rows each, isolate a row, summed.

    `rows`: unique `key`, `x` array<double>. A tree's rows are those with the lowest hashes, drawn without
    replacement; all rows pass through all trees. Null components go right and never split.
    """
    x = cut_lineage(rows.select(key, "x"))
    n = x.count()
    dims = x.agg(F.max(F.size("x"))).first()[0]
    spark = rows.sparkSession
    numbers = spark.range(trees).select(F.col("id").cast("int").alias("tree"))
    # one short row per tree
    subsets = cut_lineage(numbers.withColumn("cols", feature_subsets(trees, dims, max_features, seed)))
    state = x.select(F.explode(F.sequence(F.lit(0), F.lit(trees - 1))).alias("tree"), F.lit(1).cast("bigint").alias("node"), key)
    if size < n:
        named = state.withColumn("_named", F.concat_ws("|", "tree", key))
        state = take_hashed(named, "_named", seed, numbers.withColumn("quota", F.lit(size).cast("bigint")), ["tree"], flag="sampled").drop("_named")
    else:
        state = state.withColumn("sampled", F.lit(True))

    limit = max(1, math.ceil(math.log2(max(size, 2))))
    leaves: list[DataFrame] = []
    for depth in range(limit + 1):
        f = F.get("cols", F.pmod(hash32(seed, F.lit("feature"), *NODE), F.size("cols").cast("bigint")).cast("int"))
        drawn = state.join(x, key).join(F.broadcast(subsets), "tree").withColumn("f", f)
        placed = cut_lineage(drawn.select(*NODE, key, "sampled", "f", F.get("x", F.col("f")).alias("v")))
        held = F.when(F.col("sampled"), F.col("v"))
        nodes = cut_lineage(placed.groupBy(*NODE).agg(F.count("*").alias("rows"), F.count_if("sampled").alias("n"), F.min("f").alias("f"),
                                                      F.min(held).alias("lo"), F.max(held).alias("hi")))
        if nodes.isEmpty():
            break
        nodes = nodes.withColumn("mended", F.lit(False))
        stuck = nodes.filter((F.col("n") > 1) & ~F.coalesce(F.col("hi") > F.col("lo"), F.lit(False)))
        if depth < limit and not stuck.isEmpty():
            members = join_by_key(placed.filter("sampled").select(*NODE, key), stuck.select(*NODE, "rows"), NODE, "rows").select(*NODE, key)
            other = cut_lineage(_varying(members, x, key, subsets, seed).withColumnsRenamed({c: f"_{c}" for c in ("f", "lo", "hi")}))
            found = F.col("_f").isNotNull()
            nodes = nodes.join(other, NODE, "left").select(*NODE, "rows", "n", *[F.coalesce(f"_{c}", c).alias(c) for c in ("f", "lo", "hi")], found.alias("mended"))
        open_ = (F.col("n") > 1) & F.coalesce(F.col("hi") > F.col("lo"), F.lit(False)) & F.lit(depth < limit)
        at = F.col("hi") - hash_unit(seed, F.lit("cut"), *NODE) * (F.col("hi") - F.col("lo"))
        nodes = nodes.select(*NODE, "rows", "n", "mended", F.col("f").alias("split"), open_.alias("open"),
                             F.when(at > F.col("lo"), at).otherwise(F.col("hi")).alias("at"))
        joined = join_by_key(placed, nodes, NODE, "rows")
        leaves.append(cut_lineage(joined.filter(~F.col("open")).groupBy(key).agg(F.sum(F.lit(float(depth)) + average_path(F.col("n"))).alias("path"))))
        going = joined.filter("open")
        other = going.filter("mended").join(x, key).withColumn("v", F.get("x", F.col("split"))).select(*going.columns)
        state = going.filter(~F.col("mended")).unionByName(other).select(
            "tree", (F.col("node") * 2 + F.when(F.col("v") < F.col("at"), 0).otherwise(1)).alias("node"), key, "sampled")
    return reduce(DataFrame.unionByName, leaves).groupBy(key).agg(F.sum("path").alias("path"))
