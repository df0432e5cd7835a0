"""Exact global ranks, running sums and cut-offs without a one-partition window.

A row is first placed in one of many ordered buckets by a function of its order
key alone. Totals per bucket (map-side combined, one row per bucket) give each
bucket its starting offset; only rows of one bucket ever meet in one window.
The result does not depend on where the bucket borders lie, only the balance does.
"""
from __future__ import annotations

import bisect

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from raregrain.functions.columns import as_col, doubles, hash32

HASH_BITS = 12


def bucket_count(df: DataFrame, at_least: int = 64, at_most: int = 4096) -> int:
    """Buckets for one ordered pass: a few per shuffle partition the session is sized for."""
    return max(at_least, min(at_most, 4 * int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))))


def hash_bucket(hash_col: str | Column, bits: int = HASH_BITS) -> Column:
    """Leading bits of a 32-bit hash: uniform and ordered like the hash itself."""
    return F.coalesce(F.shiftright(as_col(hash_col), 32 - bits), F.lit(0))  # never NULL, so joins on it add no filter


def value_borders(df: DataFrame, value: str, buckets: int | None = None) -> list[float]:
    """Approximate quantiles of a numeric column: at most 4096 numbers, read once.

    They are fixed as literals, so every later evaluation (also a re-run after a
    lost executor) places a value in the same bucket.
    """
    buckets = buckets or bucket_count(df)
    probs = [i / buckets for i in range(1, buckets)]
    return sorted(set(df.approxQuantile(value, probs, 0.25 / buckets)))


def value_bucket(value: str | Column, borders: list[float]) -> Column:
    """Number of borders not above the value, by binary search inside one expression."""
    v = as_col(value).cast("double")
    if not borders:
        return F.lit(0)
    size = 1
    while size <= len(borders):
        size *= 2
    padded = doubles(borders + [float("inf")] * (size - 1 - len(borders)))
    steps = []
    while size > 1:
        size //= 2
        steps.append(size)
    return F.coalesce(F.aggregate(
        F.array(*[F.lit(s) for s in steps]),
        F.lit(0),
        lambda at, step: at + F.when(F.get(padded, at + step - 1) <= v, step).otherwise(F.lit(0)),
    ), F.lit(0))


def bucket_of(value: float, borders: list[float]) -> int:
    """Driver-side twin of `value_bucket`, for tests."""
    return bisect.bisect_right(borders, value)


def running_sums(df: DataFrame, by: list[str], bucket: str, order: list, sums: dict[str, Column],
                 descending: bool = False, totals: dict[str, str] | None = None) -> DataFrame:
    """Add, per row, the sums over all rows up to and including it (bucket first, then `order`).

    `totals` maps a sum's name to a column for the group's grand total, which the bucket
    table gives for free.
    """
    work = df
    for name, expr in sums.items():
        work = work.withColumn(f"_v_{name}", expr)
    keys = by + [bucket]
    per_bucket = work.groupBy(*keys).agg(*[F.sum(f"_v_{n}").alias(f"_t_{n}") for n in sums])
    border = F.col(bucket).desc() if descending else F.col(bucket)
    # one row per (group, bucket): a short list even when `by` is empty
    before = Window.partitionBy(*by).orderBy(border).rowsBetween(Window.unboundedPreceding, -1)
    grand = totals or {}
    offsets = per_bucket.select(
        *keys, *[F.coalesce(F.sum(f"_t_{n}").over(before), F.lit(0)).alias(f"_o_{n}") for n in sums],
        *[F.sum(f"_t_{n}").over(Window.partitionBy(*by)).alias(label) for n, label in grand.items()]
    )
    inside = Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    out = work.join(offsets, keys)
    return out.select(
        *df.columns, *grand.values(), *[(F.sum(f"_v_{n}").over(inside) + F.col(f"_o_{n}")).alias(n) for n in sums]
    )


def hash_rank(df: DataFrame, key: str, seed, strata: list[str] = (), name: str = "rank",
              bits: int = HASH_BITS) -> DataFrame:
    """Exact 1..n rank of every row in its stratum, in seeded hash order."""
    strata = list(strata)
    work = df.withColumn("_h", hash32(seed, key)).withColumn("_b", hash_bucket("_h", bits))
    ranked = running_sums(work, strata, "_b", ["_h", key], {name: F.lit(1)})
    return ranked.drop("_h", "_b")


def take_first(df: DataFrame, strata: list[str], bucket: str, order: list, quota: DataFrame,
               quota_col: str = "quota", flag: str | None = None) -> DataFrame:
    """Keep the first `quota` rows of each stratum in (bucket, order) order.

    Rows in buckets before the cut pass straight through; only the one bucket per
    stratum that holds the cut is shuffled and ranked. A stratum without a quota row is
    kept whole. With `flag`, all rows stay and the flag says which ones are chosen.
    `quota` must have one row per stratum, so it is small by construction; the cuts found,
    also one short row per stratum, are read once and fixed.
    """
    counts = df.groupBy(*strata, bucket).agg(F.count(F.lit(1)).alias("_n"))
    upto = Window.partitionBy(*strata).orderBy(bucket).rowsBetween(Window.unboundedPreceding, 0)
    cuts = (
        counts.withColumn("_upto", F.sum("_n").over(upto))
        .join(F.broadcast(quota), strata)
        .groupBy(*strata)
        .agg(
            F.min(F.when(F.col("_upto") >= F.col(quota_col),
                         F.struct(F.col(bucket).alias("b"), (F.col("_upto") - F.col("_n")).alias("before"),
                                  F.col(quota_col).alias("quota")))).alias("_cut")
        )
        .select(*strata, F.col("_cut.b").alias("_cb"), (F.col("_cut.quota") - F.col("_cut.before")).alias("_need"))
    )
    fixed = df.sparkSession.createDataFrame(cuts.collect(), cuts.schema)
    marked = df.join(F.broadcast(fixed), strata, "left")
    whole = F.col("_cb").isNull()
    sure = whole | (F.col(bucket) < F.col("_cb"))
    edge = Window.partitionBy(*strata).orderBy(*order)
    at_cut = marked.filter(F.col(bucket) == F.col("_cb")).withColumn("_r", F.row_number().over(edge))
    cols = df.columns
    if flag is None:
        return marked.filter(sure).select(*cols).unionByName(
            at_cut.filter(F.col("_r") <= F.col("_need")).select(*cols))
    rest = marked.filter(whole | (F.col(bucket) != F.col("_cb")))
    return rest.select(*cols, sure.alias(flag)).unionByName(
        at_cut.select(*cols, (F.col("_r") <= F.col("_need")).alias(flag)))


def take_hashed(df: DataFrame, key: str, seed, quota: DataFrame, strata: list[str],
                quota_col: str = "quota", flag: str | None = None, bits: int = 16) -> DataFrame:
    """Sample without replacement: the `quota` rows of each stratum with the lowest hash."""
    work = df.withColumn("_h", hash32(seed, key)).withColumn("_b", hash_bucket("_h", bits))
    return take_first(work, strata, "_b", ["_h", key], quota, quota_col, flag).drop("_h", "_b")


def order_statistic(df: DataFrame, col: str, rank: int, gather: int = 100_000) -> float:
    """Exact value at a 0-based rank among the non-null values.

    Each pass narrows to the one value bucket holding the rank; its lowest value, which is
    where a value shared by many rows ends up, is counted apart. Only a bucket of at most
    `gather` values is sorted as a list.
    """
    rows = df.select(F.col(col).cast("double").alias("v")).filter(F.col("v").isNotNull())
    n = rows.count()
    while n > gather:
        placed = rows.withColumn("b", value_bucket("v", value_borders(rows, "v")))
        counts = placed.groupBy("b").agg(F.count(F.lit(1)).alias("n"), F.min("v").alias("lo"), F.max("v").alias("hi")).orderBy("b").collect()
        for r in counts:
            if rank < r["n"]:
                break
            rank -= r["n"]
        inside = rows.filter(F.col("v").between(r["lo"], r["hi"]))
        lowest = r["n"] if r["lo"] == r["hi"] else inside.filter(F.col("v") == r["lo"]).count()
        if rank < lowest:
            return r["lo"]
        rank -= lowest
        rows, n = inside.filter(F.col("v") > r["lo"]), r["n"] - lowest
    return rows.agg(F.get(F.sort_array(F.collect_list("v")), F.lit(rank)).alias("v")).first()["v"]


def exact_quantiles(df: DataFrame, wanted: dict[str, float], gather: int = 100_000, margin: float = 0.005) -> dict[str, float]:
    """Exact quantile of each column with linear interpolation, all columns together.

    One pass brackets each quantile, one counts around the bracket, one reads the values
    inside it. A bracket too large to gather is narrowed further by `order_statistic`.
    """
    cols = list(wanted)
    brackets = {c: df.approxQuantile(c, [max(0.0, q - margin), min(1.0, q + margin)], margin / 2) for c, q in wanted.items()}
    aggs = []
    for i, c in enumerate(cols):
        lo, hi = (brackets[c] or [0.0, 0.0])
        aggs += [F.count(c).alias(f"n{i}"), F.count_if(F.col(c) < lo).alias(f"b{i}"), F.count_if(F.col(c).between(lo, hi)).alias(f"i{i}")]
    row = df.agg(*aggs).first()
    ranks, lists = {}, []
    for i, c in enumerate(cols):
        at = wanted[c] * (row[f"n{i}"] - 1)
        low, high = int(at), min(int(at) + 1, row[f"n{i}"] - 1)
        inside = row[f"b{i}"] <= low and high < row[f"b{i}"] + row[f"i{i}"]
        ranks[c] = (at, low, high, inside and row[f"i{i}"] <= gather)
        if ranks[c][3]:
            values = F.sort_array(F.collect_list(F.when(F.col(c).between(*brackets[c]), F.col(c))))
            lists += [F.get(values, F.lit(low - row[f"b{i}"])).alias(f"l{i}"), F.get(values, F.lit(high - row[f"b{i}"])).alias(f"h{i}")]
    found = df.agg(*lists).first() if lists else None
    out = {}
    for i, c in enumerate(cols):
        at, low, high, gathered = ranks[c]
        if row[f"n{i}"] == 0:
            out[c] = None
            continue
        a = float(found[f"l{i}"]) if gathered else order_statistic(df, c, low)
        b = float(found[f"h{i}"]) if gathered else (a if at == low else order_statistic(df, c, high))
        out[c] = a + (at - low) * (b - a)
    return out


def exact_quantile(df: DataFrame, col: str, q: float) -> float:
    return exact_quantiles(df, {col: q})[col]
