"""Feature selection by mutual information, redundancy and correlation."""
from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from raregrain.functions.columns import round_half_away, safe_div

# Quotient guard, correlation floor.
MIQ_GUARD = 0.0001
CORRELATION_FLOOR = 0.001


def joint_histogram(df: DataFrame, a: str, b: str) -> DataFrame:
    """Share of rows per pair of states; states are rounded and shifted to start at 0."""
    states = df.select(round_half_away(a).alias("a"), round_half_away(b).alias("b"))
    lows = states.agg(F.min("a").alias("a"), F.min("b").alias("b"))
    counts = states.groupBy("a", "b").agg(F.count(F.lit(1)).alias("n"))
    total = counts.agg(F.sum("n").alias("n")).scalar()
    return counts.select((F.col("a") - lows.select("a").scalar()).alias("a"), (F.col("b") - lows.select("b").scalar()).alias("b"),
                         (F.col("n") / total).alias("share"))


def mutual_info(df: DataFrame, cols: list[str], against: str) -> DataFrame:
    """Mutual information in bits between each column and `against`: (feature, mi).

    All columns share one partially aggregated pass; what is shuffled is one row per
    (feature, state, state).
    """
    cells = F.array(*[F.struct(F.lit(c).alias("feature"), round_half_away(c).alias("a")) for c in cols])
    long = df.select(round_half_away(against).alias("b"), F.explode(cells).alias("c")).select("b", "c.feature", "c.a")
    joint = long.groupBy("feature", "a", "b").agg(F.count(F.lit(1)).alias("n"))
    w = Window.partitionBy("feature")
    whole = joint.withColumns({
        "na": F.sum("n").over(Window.partitionBy("feature", "a")), "nb": F.sum("n").over(Window.partitionBy("feature", "b")),
        "nn": F.sum("n").over(w)})
    p = F.col("n") / F.col("nn")
    return whole.groupBy("feature").agg(
        F.sum(p * F.log2(F.col("n").cast("double") * F.col("nn") / (F.col("na").cast("double") * F.col("nb")))).alias("mi"))


def max_relevance(df: DataFrame, cols: list[str], target: str) -> DataFrame:
    """Features by mutual information with the class, best first."""
    order = F.create_map(*[x for i, c in enumerate(cols) for x in (F.lit(c), F.lit(i))])
    w = Window.orderBy(F.col("mi").desc(), order[F.col("feature")])  # one row per feature
    return mutual_info(df, cols, target).select("feature", "mi", F.row_number().over(w).alias("place"))


def anova_f(df: DataFrame, cols: list[str], target: str) -> dict[str, float]:
    """F statistic of each column against the class, from one aggregation by class."""
    rows = df.groupBy(target).agg(F.count(F.lit(1)).alias("n"), *[F.avg(c).alias(f"m_{c}") for c in cols],
                                  *[F.var_pop(c).alias(f"v_{c}") for c in cols]).collect()  # one row per class
    n, k = sum(r["n"] for r in rows), len(rows)
    out = {}
    for c in cols:
        mean = sum(r["n"] * r[f"m_{c}"] for r in rows) / n
        between = sum(r["n"] * (r[f"m_{c}"] - mean) ** 2 for r in rows) / (k - 1)
        within = sum(r["n"] * r[f"v_{c}"] for r in rows) / (n - k)
        out[c] = between / within if within else 0.0
    return out


def anova_table(df: DataFrame, cols: list[str], target: str) -> DataFrame:
    """The same statistic as a frame (feature, f), staying in one plan."""
    per = df.groupBy(target).agg(F.count(F.lit(1)).alias("n"), *[x for i, c in enumerate(cols) for x in (F.avg(c).alias(f"m{i}"), F.var_pop(c).alias(f"v{i}"))])
    cells = ", ".join(f"'{c}', m{i}, v{i}" for i, c in enumerate(cols))
    long = per.selectExpr("n", f"stack({len(cols)}, {cells}) as (feature, m, v)")
    grand = Window.partitionBy("feature")
    mean = F.sum(F.col("n") * F.col("m")).over(grand) / F.sum("n").over(grand)
    dev = long.withColumn("d", F.col("n") * F.pow(F.col("m") - mean, F.lit(2.0)))
    s = dev.groupBy("feature").agg(F.sum("d").alias("between"), F.sum(F.col("n") * F.col("v")).alias("within"), F.sum("n").alias("n"), F.count(F.lit(1)).alias("k"))
    return s.select("feature", safe_div(F.col("between") / (F.col("k") - 1), F.col("within") / (F.col("n") - F.col("k"))).alias("f"))


def correlations(df: DataFrame, cols: list[str], against: str) -> dict[str, float]:
    """Absolute Pearson correlation of each column with one column, one aggregation."""
    row = df.agg(*[F.abs(F.corr(c, against)).alias(c) for c in cols]).first()
    return {c: float(row[c] or 0.0) for c in cols}


def mrmr(df: DataFrame, cols: list[str], target: str, method: str = "MIQ", k: int = 10, pool: int | None = None) -> DataFrame:
    """Minimum-redundancy maximum-relevance picks: (place, feature, score).

    MID: relevance - mean redundancy; MIQ: quotient; FCQ: F statistic over mean absolute
    correlation. Relevance is computed once; each round adds one pass that measures the
    last pick against the remaining candidates. The driver holds one number per feature.
    `pool` limits the candidates to so many of the most relevant; by default all can be picked.
    """
    if method not in ("MID", "MIQ", "FCQ"):
        raise ValueError(f"unknown method {method}")
    if method == "FCQ":
        relevance = anova_f(df, cols, target)
    else:
        relevance = {r["feature"]: r["mi"] for r in mutual_info(df, cols, target).collect()}
    ranked = sorted(cols, key=lambda c: (-relevance[c], cols.index(c)))[:pool]
    chosen = [(ranked[0], relevance[ranked[0]])]
    redundancy = dict.fromkeys(ranked, 0.0)
    while len(chosen) < min(k, len(ranked)):
        last, left = chosen[-1][0], [c for c in ranked if c not in {f for f, _ in chosen}]
        if method == "FCQ":
            step = correlations(df, left, last)
        else:
            step = {r["feature"]: r["mi"] for r in mutual_info(df, left, last).collect()}
        for c in left:
            redundancy[c] += step[c]
        score = {}
        for c in left:
            mean = redundancy[c] / len(chosen)
            score[c] = {"MID": relevance[c] - mean, "MIQ": relevance[c] / (mean + MIQ_GUARD),
                        "FCQ": relevance[c] / max(mean, CORRELATION_FLOOR)}[method]
        best = max(left, key=lambda c: score[c])  # the first in relevance order wins a tie
        chosen.append((best, score[best]))
    return df.sparkSession.createDataFrame([(i + 1, f, float(s)) for i, (f, s) in enumerate(chosen)], "place int, feature string, score double")


class MrmrSelector:
    """fit / transform form of `mrmr`."""

    def __init__(self, cols: list[str], target: str, n_features: int = 10, mode: str = "MIQ"):
        self.cols, self.target, self.n_features, self.mode = cols, target, n_features, mode
        self.selected: list[str] = []

    def fit(self, df: DataFrame) -> "MrmrSelector":
        picks = mrmr(df, self.cols, self.target, self.mode, self.n_features)
        self.selected = [r["feature"] for r in picks.orderBy("place").collect()]
        return self

    def transform(self, df: DataFrame) -> DataFrame:
        keep = [c for c in df.columns if c not in self.cols or c in self.selected]
        return df.select(*keep)


def top_by_weight(weights: DataFrame, max_features: int) -> DataFrame:
    """Features with non-zero weight, heaviest first, at most max_features."""
    return weights.filter(F.col("weight") > 0).orderBy(F.col("weight").desc(), "feature").limit(max_features)
