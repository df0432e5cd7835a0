"""Outlier scores; higher means more anomalous. Each detector returns (key, score).

Fitting ends in a handful of numbers per feature, cluster or tree. Rows are scored by
column expressions, or in Arrow batches against a bounded model.
"""
from __future__ import annotations

import math
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.ml.clustering import KMeans
from pyspark.ml.feature import PCA
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from raregrain.functions.columns import doubles, hash32
from raregrain.operators.ensembles import in_parallel
from raregrain.operators.level_trees import path_sums
from raregrain.operators.neighbours import WIDER, _as_matrix, _right_side, _spread, distances, edges, knn, pack_rows, power_sums, stream_past
from raregrain.operators.ranking import exact_quantile, hash_bucket, hash_rank, order_statistic, running_sums, take_hashed, value_borders, value_bucket
from raregrain.session import cut_lineage, join_by_key

# Fixed value: default share of outliers.
CONTAMINATION = 0.0001


def flagged(scores: DataFrame, contamination: float = CONTAMINATION, col: str = "score") -> DataFrame:
    """Add the min-max probability and the label above the (1 - contamination) percentile."""
    cut = exact_quantile(scores, col, 1 - contamination)
    low, high = scores.agg(F.min(col).alias("v")).scalar(), scores.agg(F.max(col).alias("v")).scalar()
    return scores.withColumns({
        "probability": F.coalesce(F.try_divide(F.col(col) - low, high - low), F.lit(0.0)),
        "outlier": (F.col(col) > F.lit(cut)).cast("int")})


def feature_summary(df: DataFrame, vec: str = "vec") -> dict[str, np.ndarray]:
    """Min, max, mean, population std per element, in one pass."""
    row = df.select(Summarizer.metrics("min", "max", "mean", "variance", "count").summary(array_to_vector(F.col(vec).cast("array<double>"))).alias("s")).first()["s"]
    n = row["count"]
    return {"min": row["min"].toArray(), "max": row["max"].toArray(), "mean": row["mean"].toArray(),
            "std": np.sqrt(row["variance"].toArray() * (n - 1) / max(n, 1)), "n": n}


# ---- histograms ------------------------------------------------------------------------

@dataclass
class Histograms:
    """Equal-width density table: features x bins."""

    low: list[float]
    width: list[float]
    density: list[list[float]]

    def bin_of(self, x, i):
        bins = len(self.density[0])
        at = F.floor((x - F.get(doubles(self.low), i)) / F.get(doubles(self.width), i))
        return F.least(F.greatest(at, F.lit(0)), F.lit(bins - 1)).cast("int")

    def log_scores(self, vec: str, log: str, alpha: float, tol: float = 0.5):
        """Per element, the log of density + alpha; values far outside count as empty bins."""
        bins = len(self.density[0])
        f = (lambda d: math.log2(d + alpha)) if log == "log2" else (lambda d: math.log(d + alpha))
        table = [[f(d) for d in row] for row in self.density]
        empty = f(0.0)

        def one(x, i):
            at = (x - F.get(doubles(self.low), i)) / F.get(doubles(self.width), i)
            far = (at < -tol) | (at > bins + tol)
            return F.when(far, F.lit(empty)).otherwise(F.get(F.get(doubles(table), i), self.bin_of(x, i)))

        return F.transform(vec, one)


def fit_histograms(df: DataFrame, vec: str = "vec", bins: int = 10) -> Histograms:
    """Two partially aggregated passes: ranges, then counts per (feature, bin)."""
    s = feature_summary(df, vec)
    width = np.where(s["max"] > s["min"], (s["max"] - s["min"]) / bins, 1.0)
    h = Histograms([float(v) for v in s["min"]], [float(v) for v in width], [[0.0] * bins for _ in width])
    placed = df.select(F.posexplode(F.transform(vec, h.bin_of)).alias("f", "b")).groupBy("f", "b").agg(F.count(F.lit(1)).alias("n"))
    for r in placed.collect():  # at most features x bins rows
        h.density[r["f"]][r["b"]] = r["n"] / (s["n"] * float(width[r["f"]]))
    return h


def hbos(df: DataFrame, key: str = "key", vec: str = "vec", bins: int = 10, alpha: float = 0.1, tol: float = 0.5) -> DataFrame:
    """Sum over features of log2(1 / (density + alpha))."""
    h = fit_histograms(df, vec, bins)
    return df.select(key, F.aggregate(h.log_scores(vec, "log2", alpha, tol), F.lit(0.0), lambda s, x: s - x).alias("score"))


def loda(df: DataFrame, key: str = "key", vec: str = "vec", cuts: int = 100, bins: int = 10, seed: int = 0) -> DataFrame:
    """Random sparse projections, one histogram each; mean negative log density."""
    dims = len(df.select(vec).first()[0])
    rng = np.random.default_rng(seed)
    w = np.zeros((cuts, dims))
    for row in w:
        row[rng.choice(dims, max(1, int(round(math.sqrt(dims)))), replace=False)] = rng.standard_normal(max(1, int(round(math.sqrt(dims)))))

    @F.pandas_udf("array<double>")
    def project(v: pd.Series) -> pd.Series:
        return pd.Series(list(np.stack(v.to_numpy()) @ w.T)) if len(v) else v

    lines = df.select(key, project(F.col(vec).cast("array<double>")).alias("line"))
    h = fit_histograms(lines, "line", bins)
    return lines.select(key, (F.aggregate(h.log_scores("line", "ln", 1e-12), F.lit(0.0), lambda s, x: s - x) / cuts).alias("score"))


# ---- empirical tails -------------------------------------------------------------------

def ecdf(df: DataFrame, by: list[str], col: str) -> DataFrame:
    """Share of rows at or below each distinct value: (by..., value, n, upto, total)."""
    cells = cut_lineage(df.groupBy(*by, F.col(col).alias("x")).agg(F.count(F.lit(1)).alias("n")))
    placed = cells.withColumn("_b", value_bucket("x", value_borders(cells, "x")))
    return running_sums(placed, by, "_b", ["x"], {"upto": F.col("n")}, totals={"upto": "total"}).drop("_b")


def copod(df: DataFrame, key: str = "key", vec: str = "vec") -> DataFrame:
    """Left and right tail logs per feature, skew-chosen; the largest of the three sums."""
    long = df.select(key, F.posexplode(F.col(vec).cast("array<double>")).alias("f", "x"))
    table = ecdf(long, ["f"], "x")
    skew = long.groupBy("f").agg(F.skewness("x").alias("skew"))
    left = -F.log(F.col("upto") / F.col("total"))
    right = -F.log((F.col("total") - F.col("upto") + F.col("n")) / F.col("total"))
    tails = table.join(skew, "f").select("f", "x", left.alias("l"), right.alias("r"), F.when(F.col("skew") < 0, left).otherwise(right).alias("c"), "n")
    # a value that very many rows share does not gather them
    return join_by_key(long, tails, ["f", "x"], "n").groupBy(key).agg(F.greatest(F.sum("l"), F.sum("r"), F.sum("c")).alias("score"))


# ---- neighbours ------------------------------------------------------------------------

def neighbour_lists(df: DataFrame, key: str, vec: str, k: int, with_vec: bool = False) -> DataFrame:
    """The k nearest rows of every row, written once so that several detectors can share them."""
    return cut_lineage(knn(df.select(key, vec), None, k, key, vec, [vec] if with_vec else []))


def knn_distance(near: DataFrame, key: str = "key", method: str = "largest") -> DataFrame:
    d = F.transform("nn", lambda x: x["distance"])
    n = F.size("nn")
    s = F.sort_array(d)
    score = {"largest": F.array_max(d), "mean": F.aggregate(d, F.lit(0.0), lambda a, x: a + x) / n,
             "median": (F.get(s, F.floor((n - 1) / 2).cast("int")) + F.get(s, F.floor(n / 2).cast("int"))) / 2}[method]
    return near.select(key, score.alias("score"))


def lof(near: DataFrame, key: str = "key") -> DataFrame:
    """Mean reachability density of the neighbours over the row's own."""
    e = edges(near, key)
    reach_of = near.select(F.col(key).alias("nkey"), F.array_max(F.transform("nn", lambda x: x["distance"])).alias("kdist"))
    lrd = cut_lineage(e.join(reach_of, "nkey").groupBy(key).agg((F.lit(1.0) / F.avg(F.greatest("kdist", "distance"))).alias("lrd")))
    theirs = lrd.select(F.col(key).alias("nkey"), F.col("lrd").alias("nlrd"))
    return e.join(theirs, "nkey").groupBy(key).agg(F.avg("nlrd").alias("m")).join(lrd, key).select(key, (F.col("m") / F.col("lrd")).alias("score"))


def cof(near: DataFrame, key: str = "key", vec: str = "vec") -> DataFrame:
    """Average chaining distance over the neighbours' mean. `near` carries neighbour vectors."""

    @F.pandas_udf("double")
    def chaining(own: pd.Series, flat: pd.Series) -> pd.Series:
        out = []
        for x, f in zip(own, flat):
            pts = np.vstack([x, np.asarray(f).reshape(-1, len(x))])
            d = distances(pts, pts)
            k, gap, cost = len(pts) - 1, d[0].copy(), 0.0
            gap[0] = np.inf
            for i in range(1, k + 1):
                j = int(gap.argmin())
                cost += 2 * (k + 1 - i) / (k * (k + 1)) * gap[j]
                gap = np.minimum(gap, d[j])
                d[:, j] = np.inf
                gap[j] = np.inf
                gap[~np.isfinite(d[0])] = np.inf
            out.append(cost)
        return pd.Series(out)

    ac = cut_lineage(near.select(key, chaining(vec, F.flatten(F.transform("nn", lambda x: x[vec]))).alias("ac")))
    theirs = ac.select(F.col(key).alias("nkey"), F.col("ac").alias("nac"))
    return edges(near, key).join(theirs, "nkey").groupBy(key).agg(F.avg("nac").alias("m")).join(ac, key).select(
        key, F.coalesce(F.try_divide(F.col("ac"), F.col("m")), F.lit(1.0)).alias("score"))


LIST_ROWS = 8192
HITS = 1 << 22


def shared_reference(near: DataFrame, key: str = "key", size: int = 10, rows_per_block: int = 1024) -> DataFrame:
    """The `size` rows sharing most neighbours with each row: (key, rkey, shared).

    Overlaps are counted block against block over the ids that both hold; `size` rows per row are kept. Rows that share
    nothing come in by key: of those, only the `size` + 1 lowest keys can be among the first. Blocks of ids are small and so
    hold many rows, as each id is looked up once in every other block; a step counts at most some `HITS` common ids.
    """
    lists = near.select(key, F.transform("nn", lambda x: F.xxhash64(x["key"])).alias("ids"), F.array(F.size("nn").cast("bigint")).alias("n"))
    blocks, parts = pack_rows(lists, key, ["ids", "n"], WIDER * rows_per_block, LIST_ROWS)
    kind = dict(near.dtypes)[key]
    # at most size + 1 keys
    lowest = [r[0] for r in near.select(key).orderBy(key).limit(size + 1).collect()]

    def first(i, rk, n):
        """The best of each row: most shared, then lowest key; a pair may come twice, once as sharing nothing."""
        order = np.lexsort((rk, -n, i))
        i, rk, n = i[order], rk[order], n[order]
        starts = np.r_[0, np.flatnonzero(np.diff(i)) + 1]
        top = np.arange(len(i)) - np.repeat(starts, np.diff(np.r_[starts, len(i)])) < size
        return i[top], rk[top], n[top]

    def one(l, r, held):
        lk, rk = np.asarray(l["keys"]), np.asarray(r["keys"])
        if "order" not in l:
            ids = np.asarray(l["ids"])
            l["order"] = np.argsort(ids, kind="stable")
            l["sorted"], l["row"] = ids[l["order"]], np.repeat(np.arange(len(lk)), np.asarray(l["n"]))[l["order"]]
        ids, row = np.asarray(r["ids"]), np.repeat(np.arange(len(rk)), np.asarray(r["n"]))
        # looked up in order, which is several times as fast
        order = np.argsort(ids)
        low, high = np.empty(len(ids), np.int64), np.empty(len(ids), np.int64)
        low[order], high[order] = np.searchsorted(l["sorted"], ids[order], "left"), np.searchsorted(l["sorted"], ids[order], "right")
        hits = high - low
        # right rows of one step: a row's ids stay together
        ends = np.cumsum(np.bincount(row, hits, len(rk)))
        step = (np.maximum(ends - 1, 0) // HITS).astype(np.int64)[row]
        found = []
        for at in np.split(np.arange(len(ids)), np.flatnonzero(np.diff(step)) + 1):
            at = at[hits[at] > 0]
            if len(at):
                # every id of these rows with all rows of the left block that hold it
                h = hits[at]
                of = np.arange(h.sum()) - np.repeat(np.cumsum(h) - h, h) + np.repeat(low[at], h)
                pair, n = np.unique(l["row"][of] * len(rk) + np.repeat(row[at], h), return_counts=True)
                i, j = pair // len(rk), pair % len(rk)
                other = lk[i] != rk[j]
                i, j, n = i[other], j[other], n[other]
                if len(i):
                    found.append(first(i, rk[j], n))
        rest = np.flatnonzero(np.isin(rk, lowest)) if len(lowest) else np.array([], int)
        if len(rest):
            # the lowest keys with every row: those that share nothing with it have a count of 0
            shares = np.zeros((len(lk), len(rest)), np.int64)
            for at, j in enumerate(rest):
                own = np.flatnonzero(row == j)
                of = np.concatenate([np.arange(low[x], high[x]) for x in own]) if len(own) else np.array([], int)
                shares[:, at] = np.bincount(l["row"][of], minlength=len(lk))
            zi, zj = np.nonzero((shares == 0) & (lk[:, None] != rk[rest][None, :]))
            if len(zi):
                found.append((zi, rk[rest][zj], np.zeros(len(zi), np.int64)))
        return tuple(np.concatenate(x) for x in zip(*found)) if found else None

    def merge(held, new):
        i, rk, n = (np.concatenate(x) for x in zip(held, new))
        return first(i, rk, n)

    def done(l, held):
        i, rk, n = first(*held)
        return pd.DataFrame({"key": np.asarray(l["keys"])[i], "rkey": rk, "shared": n})

    found = stream_past(blocks, blocks, one, merge, done, f"key {kind}, rkey {kind}, shared int")
    best = Window.partitionBy("key").orderBy(F.col("shared").desc(), "rkey")
    return found.withColumn("_r", F.row_number().over(best)).filter(F.col("_r") <= size).drop("_r")


def sod(df: DataFrame, near: DataFrame, key: str = "key", vec: str = "vec", size: int = 10, alpha: float = 0.8) -> DataFrame:
    """Distance to the reference set's mean inside the dimensions where that set is narrow."""
    dims = len(df.select(vec).first()[0])
    ref = shared_reference(near, key, size)
    rows = ref.join(df.select(F.col(key).alias("rkey"), F.col(vec).alias("rv")), "rkey")
    sets = rows.groupBy("key").agg(F.array(*[F.avg(F.col("rv")[i]) for i in range(dims)]).alias("m"),
                                   F.array(*[F.var_pop(F.col("rv")[i]) for i in range(dims)]).alias("v"))
    bar = F.aggregate("v", F.lit(0.0), lambda s, x: s + x) / dims * alpha
    both = df.select(F.col(key).alias("key"), F.col(vec).alias("x")).join(sets, "key").withColumn("_bar", bar)
    narrow = F.transform("v", lambda v: (v < F.col("_bar")).cast("int"))
    sq = F.zip_with(F.zip_with("x", "m", lambda a, b: (a - b) * (a - b)), narrow, lambda d, r: d * r)
    n = F.aggregate(narrow, F.lit(0), lambda s, x: s + x)
    return both.select(F.col("key").alias(key), F.coalesce(F.try_divide(F.sqrt(F.aggregate(sq, F.lit(0.0), lambda s, x: s + x)), n.cast("double")), F.lit(0.0)).alias("score"))


#: Nearest rows from which a fall-off is guessed (at least that many times the perplexity), and moments that a pass adds up around one.
NEAREST, NEAREST_TIMES, MOMENTS = 32, 4, 8
#: Weights below e^-NO_WEIGHT / rows are not added to sums that hold a 1: all of them together are less than its rounding.
NO_WEIGHT = 40.0
#: Share of a sum that the moments left out may make up, and how far from its centre a series is used at all.
TOLERANCE, REACH = 1e-12, 0.3
#: Rounding of a squared distance, as a share of the vectors' squares.
ROUNDING = 1e-12


def _children(beta: np.ndarray, lo: np.ndarray, hi: np.ndarray, high: np.ndarray):
    """One bisection step: where the entropy was too high the affinity must fall off faster."""
    lo, hi = np.where(high, beta, lo), np.where(high, hi, beta)
    return np.where(np.isinf(hi), beta * 2, (lo + np.where(np.isinf(hi), 0.0, hi)) / 2), lo, hi


def _weights_at(moments: np.ndarray, r: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sum of weights and their entropy at the fall-off centre * (1 + r), from the moments about the centre (see `_moments_of`)."""
    s, t = np.zeros(len(r)), np.zeros(len(r))
    for k in range(MOMENTS - 1, -1, -1):
        s, t = s * -r + moments[:, k], t * -r + (k + 1) * moments[:, k + 1]
    with np.errstate(divide="ignore", invalid="ignore"):
        return s, np.log(s) + (1 + r) * t / s


def _moments_of(y: np.ndarray, cut: float) -> np.ndarray:
    """Rows x (MOMENTS + 1): sums of e^-y y^k / k! over each row of y, which is written over; terms with y above `cut` may be left out."""
    out = np.empty((len(y), MOMENTS + 1))
    # a NaN is let through, so that it shows in the sums
    near = np.flatnonzero(~(y >= cut))
    if len(near) * 8 < y.size:
        i, y = near // y.shape[1], y.ravel()[near]
        e = np.exp(-y)
        for k in range(MOMENTS + 1):
            out[:, k] = np.bincount(i, e, len(out))
            e *= y
            e /= k + 1
        return out
    np.minimum(y, 1e6, out=y)
    e = np.exp(-y)
    for k in range(MOMENTS + 1):
        e.sum(axis=1, out=out[:, k])
        e *= y
        out[:, k] /= math.factorial(k)
    return out


def _first_centres(near: np.ndarray, goal: float, eps: float, last: float) -> tuple[np.ndarray, np.ndarray]:
    """(centre, low) from each row's sorted nearest squared distances less the first: the fall-off whose entropy among them is the goal.

    Rows with so many equal nearest that no fall-off gets there have `last` and no upper end of `low`, up to which the entropy is too high.
    """
    known = np.isfinite(near)
    x = np.where(known, near, 0.0)
    far = np.maximum(x.max(axis=1, initial=0.0), 1e-300)
    x, copies = x / far[:, None], (known & (x == 0)).sum(axis=1)
    lo, hi = np.full(len(x), -14.0), np.full(len(x), 37.0)
    for _ in range(50):
        mid = (lo + hi) / 2
        b = np.exp(mid)[:, None]
        a = np.exp(-x * b) * known
        s = a.sum(axis=1)
        with np.errstate(divide="ignore", invalid="ignore"):
            high = np.log(s) + (a * x * b).sum(axis=1) / s > goal
        lo, hi = np.where(high, mid, lo), np.where(high, hi, mid)
    never = np.log(np.maximum(copies, 1)) >= goal + eps
    with np.errstate(over="ignore"):
        centre = np.minimum(np.exp(hi) / far, last)
    return np.where(never, last, centre), np.where(never, np.inf, 0.0)


def _walked(state: dict, moments: np.ndarray, goal: float, eps: float, tries: int, late: bool) -> None:
    """Takes each live row's bisection on as far as the moments about its centre tell, and sets the next centres.

    Entropy falls with the fall-off: what is known to be too high at `low` is so below it, and too low above `high`. Between them a step is taken
    where the series is exact to `TOLERANCE`. A row stops at its first step within `eps` of the goal, or its last one.
    """
    live = np.flatnonzero(state["total"] == 0)
    m, centre = moments[live], state["centre"][live]
    # the nearest row alone has a weight of 1
    broken = ~(m[:, 0] >= 0.5)
    state["total"][live[broken]] = np.nan
    live, m, centre = live[~broken], m[~broken], centre[~broken]
    with np.errstate(divide="ignore"):
        reach = np.minimum((TOLERANCE * m[:, 0] / (MOMENTS * m[:, -1])) ** (1 / (MOMENTS - 1)), REACH)
    for r in (-reach, np.zeros(len(live)), reach):
        at, entropy = centre * (1 + r), _weights_at(m, r)[1]
        state["low"][live] = np.where(entropy >= goal + eps, np.maximum(state["low"][live], at), state["low"][live])
        state["high"][live] = np.where(entropy <= goal - eps, np.minimum(state["high"][live], at), state["high"][live])
    going = np.arange(len(live))
    while len(going):
        rows = live[going]
        beta, tried = state["beta"][rows], state["tried"][rows]
        r = beta / centre[going] - 1
        inside = np.abs(r) <= reach[going]
        s, entropy = _weights_at(m[going], np.where(inside, r, 0.0))
        end = inside & ((np.abs(entropy - goal) < eps) | (tried == tries - 1))
        state["total"][rows[end]] = s[end]
        above, below = beta <= state["low"][rows], beta >= state["high"][rows]
        on = ~end & (inside | (above | below) & (tried < tries - 1))
        rows, going, high = rows[on], going[on], np.where(inside, entropy > goal, above)[on]
        for name, x in zip(("beta", "lo", "hi"), _children(state["beta"][rows], state["lo"][rows], state["hi"][rows], high)):
            state[name][rows] = x
        state["tried"][rows] += 1
    left = state["total"][live] == 0
    live, m, centre = live[left], m[left], centre[left]
    # where the series puts the goal; it only has to come close
    a, b = np.full(len(live), -REACH), np.full(len(live), REACH)
    for _ in range(30):
        mid = (a + b) / 2
        above = _weights_at(m, mid)[1] > goal
        a, b = np.where(above, mid, a), np.where(above, b, mid)
    next_, low, high = centre * (1 + (a + b) / 2), state["low"][live], state["high"][live]
    with np.errstate(invalid="ignore"):
        between = np.where(np.isinf(high), 2 * np.maximum(low, centre), (low + high) / 2)
    next_ = np.where((next_ > low) & (next_ < high), next_, between)
    # the step itself, if that takes long or nothing lies between
    state["centre"][live] = np.where(np.isfinite(next_) & ~late, next_, state["beta"][live])


def _in_tiles(block: dict, run, rows: int = 64) -> list:
    """run(some rows of the block), so that its matrices stay in the cache."""
    n = len(block["keys"])
    return [run({c: x if c == "part" else x[len(x) // n * i:len(x) // n * (i + rows)] for c, x in block.items()}) for i in range(0, n, rows)]


def _row_sums(blocks: DataFrame, others: DataFrame, run) -> DataFrame:
    """part, sums: run(block, other) gives rows x width; added up over all other blocks that stream past a block.

    Both are written blocks. A block's sums leave the task once for each run of its rows.
    """
    def done(l, held):
        return pd.DataFrame({"part": [l["part"]], "sums": [held.ravel()]})

    return stream_past(blocks, others, lambda l, r, held: np.concatenate(_in_tiles(l, lambda some: run(some, r))), lambda held, new: held + new, done,
                       "part int, sums array<double>").groupBy("part").agg(F.collect_list("sums").alias("sums"))


def sos(df: DataFrame, key: str = "key", vec: str = "vec", perplexity: float = 4.5, eps: float = 1e-5, tries: int = 100, rows_per_block: int = 1024) -> DataFrame:
    """Probability that no other row binds to this one; every row has an affinity to all others.

    A row's fall-off is bisected until the entropy of its affinities is the log of the perplexity. The entropy of its nearest rows
    tells about where that is; a pass over the block pairs adds up moments of all weights about there, from which the steps follow
    to rounding. Rows whose steps are not all known get another pass about a better place. The last pass adds up
    log(1 - binding probability) of each row.
    Equal rows have a distance of 0 and bind to each other like any; a row alone scores 1.
    """
    kind = dict(df.dtypes)[key]
    rows = df.select(key, F.col(vec).cast("array<double>").alias("v"))
    n = rows.count()
    goal = math.log(min(perplexity, n - 1 - 1e-3)) if n > 1 and perplexity > 0 else 0.0
    if n < 2:
        return df.select(key, F.lit(1.0).alias("score"))
    blocks, parts = pack_rows(rows, key, ["v"], rows_per_block)

    cut, nearest, last = NO_WEIGHT + math.log(n), max(NEAREST, int(NEAREST_TIMES * perplexity)), 2.0 ** (tries - 1)

    def squares(left, right, live):
        a, b = (_as_matrix(s["v"], len(s["keys"])) for s in (left, right))
        if "side" not in right:
            right["side"] = _right_side(b, np.ones(b.shape[1]))
        a = a[live]
        d = power_sums(a, b, 2.0, np.ones(a.shape[1]), right["side"])
        # what cancels is taken from the differences, so that equal rows are at 0
        tiny = 1e-10 * (a * a).sum(axis=1).max(initial=0.0)
        if d.size and d.min() <= tiny:
            i, j = np.nonzero(d <= tiny)
            d[i, j] = ((a[i] - b[j]) ** 2).sum(axis=1)
        if left["part"] == right["part"]:
            d[np.asarray(left["keys"])[live][:, None] == np.asarray(right["keys"])[None, :]] = np.inf
        return d

    def closest(l, r, held):
        """Each row's nearest squared distances so far, in order."""
        def of_rows(some, own):
            d = squares(some, r, np.arange(len(some["keys"])))
            new = np.flatnonzero(d.min(axis=1) < own[:, -1])
            d = d[new]
            if d.shape[1] > nearest:
                d = np.partition(d, nearest - 1, axis=1)[:, :nearest]
            own[new] = np.sort(np.concatenate([own[new], d], axis=1), axis=1)[:, :nearest]
            return own
        held = np.full((len(l["keys"]), nearest), np.inf) if held is None else held
        return np.concatenate([of_rows(some, own) for some, own in zip(_in_tiles(l, lambda some: some), np.split(held, range(64, len(held), 64)))])

    # nearest distances first: weights are taken relative to the nearest one, so that none of them vanishes
    low = stream_past(blocks, blocks, closest, lambda held, new: new, lambda l, held: pd.DataFrame({"part": [l["part"]], "low": [held.ravel()], "size": [(_as_matrix(l["v"], len(held)) ** 2).sum(axis=1)]}),
                      "part int, low array<double>, size array<double>")
    lows = low.groupBy("part").agg(F.collect_list("low").alias("lows"), F.first("size").alias("size"))
    names = ["m", "same", "centre", "low", "high", "beta", "lo", "hi", "tried", "total"]
    arrays = ", ".join(f"{c} array<double>" for c in names) + ", left int"

    def state_row(part, state: dict) -> pd.DataFrame:
        return pd.DataFrame({"part": [part], **{c: [state[c]] for c in names}, "left": [int((state["total"] == 0).sum())]})

    def start(batches):
        for batch in batches:
            for r in batch.itertuples(index=False):
                near = np.sort(np.concatenate([np.asarray(x).reshape(-1, nearest) for x in r.lows], axis=1), axis=1)[:, :nearest]
                one, m = np.ones(len(near)), near[:, 0]
                # nearer to each other than this two distances are equal but for rounding
                same = ROUNDING * (np.asarray(r.size) + m)
                with np.errstate(invalid="ignore"):
                    x = near - m[:, None]
                    x[x < same[:, None]] = 0.0
                    centre, bottom = _first_centres(x, goal, eps, last)
                yield state_row(r.part, {"m": m, "same": same, "centre": centre, "low": bottom, "high": one * np.inf, "beta": one, "lo": one * 0, "hi": one * np.inf, "tried": one * 0, "total": one * 0})

    state = cut_lineage(lows.mapInPandas(start, f"part int, {arrays}"))

    def scaled(d, m, beta, same):
        """Fall-off times distance beyond the nearest; rounding is taken off where a fall-off is so steep that it would show."""
        d -= m
        if (beta * same > 1e-6).any():
            d[d < same] = 0.0
        d *= beta
        return d

    def weigh(left, right):
        m, same, centre, total = (np.asarray(left[c], dtype=float) for c in ("m", "same", "centre", "total"))
        out, live = np.zeros((len(m), MOMENTS + 1)), np.flatnonzero(total == 0)
        if len(live):
            out[live] = _moments_of(scaled(squares(left, right, live), m[live, None], centre[live, None], same[live, None]), cut)
        return out

    def step(late: bool):
        def walk(batches):
            for batch in batches:
                for r in batch.itertuples(index=False):
                    now = {c: np.array(getattr(r, c), dtype=float) for c in names}
                    _walked(now, np.sum([np.asarray(x) for x in r.sums], axis=0).reshape(len(now["m"]), -1), goal, eps, tries, late)
                    yield state_row(r.part, now)
        return walk

    # a late pass takes at least one step of every row
    passes = 0
    while state.filter(F.col("left") > 0).limit(1).count():
        asked = cut_lineage(_spread(blocks.join(state.filter(F.col("left") > 0), "part").select("part", "keys", "v", "m", "same", "centre", "total")))
        new = _row_sums(asked, blocks, weigh).join(state, "part").mapInPandas(step(passes >= 12), f"part int, {arrays}")
        state = cut_lineage(new.unionByName(state.filter(F.col("left") == 0)))
        passes += 1
        if passes > 12 + tries:
            raise RuntimeError("the entropies of some rows are not found")

    def miss(left, right):
        """Sums for the rows of the left block over the binding rows of the right one."""
        m, same, beta, total = (np.asarray(right[c], dtype=float) for c in ("m", "same", "beta", "total"))
        y = scaled(squares(left, right, np.arange(len(left["keys"]))), m, beta, same)
        near = np.flatnonzero(~(y >= cut))
        if len(near) * 8 < y.size:
            i, j = np.divmod(near, y.shape[1])
            each = np.exp(-y.ravel()[near]) / total[j]
            return np.bincount(i, np.log1p(-np.minimum(each, 1 - 1e-15)), len(y))[:, None]
        return np.log1p(-np.minimum(np.exp(-y) / total, 1 - 1e-15)).sum(axis=1)[:, None]

    missed = _row_sums(blocks, cut_lineage(_spread(blocks.join(state.select("part", "m", "same", "beta", "total"), "part"))), miss)

    def scored(batches):
        for batch in batches:
            for r in batch.itertuples(index=False):
                yield pd.DataFrame({key: r.keys, "score": np.exp(np.sum([np.asarray(x) for x in r.sums], axis=0))})

    return missed.join(blocks.select("part", "keys"), "part").mapInPandas(scored, f"{key} {kind}, score double")


def _square_of(x: float) -> float:
    """The largest number whose square root is x or less, so that distances need no roots to be compared."""
    if not x >= 0:
        return -1.0
    z = x * x
    while math.isfinite(z) and math.sqrt(np.nextafter(z, math.inf)) <= x:
        z = float(np.nextafter(z, math.inf))
    while math.sqrt(z) > x:
        z = float(np.nextafter(z, -math.inf))
    return z


def _within(d: np.ndarray, bars: list[float], left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of each row and each column of a matrix, sums of the other side's columns over its cells up to each bar: (rows, bars, width) and (columns, bars, width).

    `left` and `right` are (rows or columns, bars or 1, width). Bars with few cells below are added up cell by cell.
    """
    low, high, width = d.min(), d.max(), right.shape[2]
    rows, columns = np.zeros((len(d), len(bars), width)), np.zeros((d.shape[1], len(bars), width))
    cells = None
    for at in sorted(range(len(bars)), key=lambda i: bars[i]):
        bar, mine, theirs = bars[at], left[:, at % left.shape[1]], right[:, at % right.shape[1]]
        if low > bar:
            continue
        if high <= bar:
            rows[:, at], columns[:, at] = theirs.sum(axis=0), mine.sum(axis=0)
            continue
        hit = d <= bar
        if np.count_nonzero(hit) * 64 < d.size:
            cells = np.flatnonzero(hit)
            i, j = np.divmod(cells, d.shape[1])
            for k in range(width):
                rows[:, at, k], columns[:, at, k] = np.bincount(i, theirs[j, k], len(d)), np.bincount(j, mine[i, k], d.shape[1])
            continue
        hit = hit.astype(float)
        rows[:, at], columns[:, at] = hit @ theirs, (mine.T @ hit).T
    return rows, columns


def loci(df: DataFrame, key: str = "key", vec: str = "vec", alpha: float = 0.5, radii: list[float] | None = None,
         least: int = 20, rows_per_block: int = 1024) -> DataFrame:
    """Largest deviation of a row's local count from its neighbourhood's, over several radii.

    Two blocks meet once for the rows of both in each of three passes: the mean distance, counts, and sums of the neighbours' counts.
    """
    rows = df.select(key, F.col(vec).cast("array<double>").alias("v"))
    blocks, _ = pack_rows(rows, key, ["v"], rows_per_block, flat="v")

    def tiles(l, r, size: int = 32):
        """(rows of l, their squared distances to r, which of these are of one key or None)."""
        a, b = _as_matrix(l["v"], len(l["keys"])), _as_matrix(r["v"], len(r["keys"]))
        w, lk, rk = np.ones(b.shape[1]), np.asarray(l["keys"]), np.asarray(r["keys"])
        side = _right_side(b, w)
        for i in range(0, len(a), size):
            some = slice(i, i + size)
            yield some, power_sums(a[some], b, 2.0, w, side), lk[some, None] == rk[None, :] if l["part"] == r["part"] else None

    if radii is None:
        def gaps(l, r, held):
            s = n = 0
            for _, d, same in tiles(l, r):
                if same is not None:
                    d[same] = 0.0
                s, n = s + np.sqrt(d, out=d).sum(), n + d.size - (0 if same is None else np.count_nonzero(same))
            # a block with itself has every pair twice
            twice = 1 if l["part"] == r["part"] else 2
            return np.array([twice * s, twice * n]), None

        each = stream_past(blocks, blocks, gaps, lambda held, new: held + new, lambda l, held: pd.DataFrame({"s": [held[0]], "n": [held[1]]}),
                           "s double, n double", mutual=["part"])
        mean = each.agg(F.sum("s") / F.sum("n")).first()[0]
        radii = [mean * s for s in (0.7, 0.8, 0.9, 1.0, 1.1, 1.2, 1.4)]
    r = np.array(radii)
    kind = dict(df.dtypes)[key]
    cols = range(len(r))

    def over_pairs(blocks: DataFrame, names: list[str], bars: list[float], columns) -> DataFrame:
        """Per key, arrays over the bars by name: sums of `columns(block)` (rows x bars or 1 x names) over the rows within each bar."""
        def one(l, r, held):
            left, right = columns(l), columns(r)
            own, back = [], np.zeros((len(r["keys"]), len(bars), len(names)))
            for some, d, same in tiles(l, r):
                if same is not None:
                    d[same] = 0.0
                mine, theirs = _within(d, bars, left[some], right)
                own.append(mine)
                back += theirs
            return np.concatenate(own), None if l["part"] == r["part"] else back

        def done(l, held):
            return pd.DataFrame({"part": [l["part"]], "sums": [held.ravel()]})

        def by_key(batches):
            for batch in batches:
                for block in batch.itertuples(index=False):
                    # equal keys are in one block
                    code, found = pd.factorize(pd.Series(list(block.keys)))
                    sums = np.zeros((len(found), len(bars), len(names)))
                    np.add.at(sums, code[code >= 0], np.sum([np.asarray(x) for x in block.sums], axis=0).reshape(len(code), len(bars), -1)[code >= 0])
                    yield pd.DataFrame({"key": found, **{n: list(sums[:, :, k]) for k, n in enumerate(names)}})

        part = stream_past(blocks, blocks, one, lambda held, new: held + new, done, "part int, sums array<double>", mutual=["part"])
        added = part.groupBy("part").agg(F.collect_list("sums").alias("sums")).join(blocks.select("part", "keys"), "part")
        return added.mapInPandas(by_key, f"key {kind}, " + ", ".join(f"{n} array<double>" for n in names))

    counts = cut_lineage(over_pairs(blocks, ["n"], [_square_of(alpha * x) for x in r], lambda b: np.ones((len(b["keys"]), 1, 1))))

    def moments(block):
        n = np.asarray(block["n"], dtype=float).reshape(len(block["keys"]), -1)
        return np.stack([np.ones(n.shape), n, n * n], axis=2)

    blocks, _ = pack_rows(rows.withColumnRenamed(key, "key").join(counts, "key"), "key", ["v", "n"], rows_per_block, flat="v")
    m = over_pairs(blocks, ["c", "s", "q"], [_square_of(x) for x in r], moments)
    ratios = []
    for i in cols:
        c, s, q, n = F.col("c")[i], F.col("s")[i], F.col("q")[i], F.col("n")[i]
        mean = s / c
        spread = F.sqrt(F.greatest(q / c - mean * mean, F.lit(0.0)))
        ratios.append(F.when(c >= least, F.try_divide(mean - n, spread)))
    return m.join(counts, "key").select(F.col("key").alias(key), F.coalesce(F.array_max(F.array(*ratios)), F.lit(0.0)).alias("score"))


def feature_bagging(df: DataFrame, key: str = "key", vec: str = "vec", n_estimators: int = 10, k: int = 10, max_features: float = 1.0,
                    combination: str = "average", seed: int = 0) -> DataFrame:
    """Average or maximum of LOF over random column subsets (half to all columns, scaled by max_features)."""
    dims = len(df.select(vec).first()[0])
    rng = np.random.default_rng(seed)
    top = max(2, int(dims * max_features))
    subsets = [sorted(rng.choice(dims, int(rng.integers(max(1, top // 2), top)), replace=False)) for _ in range(n_estimators)]

    def one(cols: list) -> DataFrame:
        part = df.select(key, F.array(*[F.col(vec)[int(i)] for i in cols]).alias(vec))
        return cut_lineage(lof(neighbour_lists(part, key, vec, k), key))

    # two at a time: one's short jobs fill the gaps between the other's
    scores = reduce(DataFrame.unionByName, in_parallel([lambda cols=cols: one(cols) for cols in subsets], 2))
    return scores.groupBy(key).agg((F.avg("score") if combination == "average" else F.max("score")).alias("score"))


# ---- clusters and covariance -----------------------------------------------------------

def _nearest_of(centres: np.ndarray):
    @F.pandas_udf("double")
    def gap(v: pd.Series) -> pd.Series:
        return pd.Series(distances(np.stack(v.to_numpy()), centres).min(axis=1)) if len(v) else pd.Series([], dtype=float)
    return gap


def cblof(df: DataFrame, key: str = "key", vec: str = "vec", n_clusters: int = 8, alpha: float = 0.9, beta: float = 5.0,
          use_weights: bool = False, seed: int = 0) -> DataFrame:
    """Distance to the own centre (large cluster) or the nearest large centre (small cluster)."""
    points = df.select(key, F.col(vec).cast("array<double>").alias("_x")).withColumn("_f", array_to_vector("_x"))
    fitted = KMeans(k=n_clusters, seed=seed, featuresCol="_f", predictionCol="_c").fit(points)
    placed = fitted.transform(points).drop("_f")
    centres = np.array(fitted.clusterCenters())
    sizes = sorted(((r["count"], r["_c"]) for r in placed.groupBy("_c").count().collect()), key=lambda x: (-x[0], x[1]))
    n, upto, large = sum(s for s, _ in sizes), 0, []
    for i, (s, c) in enumerate(sizes):
        large.append(c)
        upto += s
        if upto >= alpha * n or (i + 1 < len(sizes) and s >= beta * sizes[i + 1][0]):
            break
    own = F.sqrt(F.aggregate(F.zip_with("_x", F.get(doubles(centres.tolist()), F.col("_c")), lambda a, b: (a - b) * (a - b)), F.lit(0.0), lambda s, x: s + x))
    d = F.when(F.col("_c").isin(large), own).otherwise(_nearest_of(centres[large])("_x"))
    if use_weights:
        by = dict((c, s) for s, c in sizes)
        d = d * F.get(F.lit([float(by.get(c, 0)) for c in range(len(centres))]), F.col("_c"))
    return placed.select(key, d.alias("score"))


def pca_score(df: DataFrame, key: str = "key", vec: str = "vec") -> DataFrame:
    """Sum over components of squared projection over eigenvalue, on standardised columns."""
    s = feature_summary(df, vec)
    std = np.where(s["std"] > 0, s["std"], 1.0)
    mean_l, std_l = doubles(s["mean"].tolist()), doubles(std.tolist())
    scaled = F.transform(F.col(vec).cast("array<double>"), lambda x, i: (x - F.get(mean_l, i)) / F.get(std_l, i))
    rows = df.select(key, array_to_vector(scaled).alias("_f"))
    dims = len(std)
    fitted = PCA(k=dims, inputCol="_f", outputCol="_p").fit(rows)
    total = float((s["std"] > 0).sum()) * s["n"] / max(s["n"] - 1, 1)
    eig = [max(float(v) * total, 1e-12) for v in fitted.explainedVariance.toArray()]
    keep = [1.0 / e if e > 1e-9 else 0.0 for e in eig]
    return fitted.transform(rows).select(key, F.aggregate(F.zip_with(vector_to_array("_p"), doubles(keep), lambda p, w: p * p * w), F.lit(0.0), lambda a, x: a + x).alias("score"))


def mean_and_covariance(df: DataFrame, vec: str, centred: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """Sums and outer products per batch, added up by Spark; one row per dimension comes back."""
    def partial(batches):
        for b in batches:
            if len(b):
                x = np.stack(b[vec].to_numpy())
                outer = x.T @ x
                yield pd.DataFrame({"i": np.arange(x.shape[1]), "n": float(len(x)), "s": x.sum(axis=0), "o": list(outer)})

    dims = len(df.select(vec).first()[0])
    parts = df.select(F.col(vec).cast("array<double>").alias(vec)).mapInPandas(partial, "i int, n double, s double, o array<double>")
    rows = parts.groupBy("i").agg(F.sum("n").alias("n"), F.sum("s").alias("s"), F.array(*[F.sum(F.col("o")[j]) for j in range(dims)]).alias("o")).orderBy("i").collect()
    n = rows[0]["n"]
    mean = np.zeros(dims) if centred else np.array([r["s"] for r in rows]) / n
    return mean, np.array([r["o"] for r in rows]) / n - np.outer(mean, mean)


def chi2_quantile(p: float, dims: int) -> float:
    """Quantile of the chi-squared distribution: bisection of the incomplete gamma series."""
    a = dims / 2

    def below(x: float) -> float:
        term = total = 1.0
        for k in range(1, 100_000):
            term *= x / (a + k)
            total += term
            if term < total * 1e-16:
                break
        return math.exp(a * math.log(x) - x - math.lgamma(a + 1)) * total
    lo, hi = 0.0, 1.0
    while below(hi) < p:
        hi *= 2
    for _ in range(80):
        lo, hi = ((lo + hi) / 2, hi) if below((lo + hi) / 2) < p else (lo, (lo + hi) / 2)
    return 2 * lo


def _moments(x: np.ndarray, centred: bool) -> tuple[np.ndarray, np.ndarray, float]:
    """Mean, covariance and log determinant of some rows (minus infinity where they span no volume)."""
    mean = np.zeros(x.shape[1]) if centred else x.mean(0)
    cov = (x - mean).T @ (x - mean) / len(x)
    sign, size = np.linalg.slogdet(cov)
    return mean, cov, float(size) if sign > 0 else -math.inf


def _concentrate(x: np.ndarray, mean: np.ndarray, cov: np.ndarray, h: int, steps: int, centred: bool):
    for _ in range(steps):
        d = x - mean
        near = np.argpartition(((d @ np.linalg.pinv(cov)) * d).sum(1), h - 1)[:h]
        mean, cov, size = _moments(x[near], centred)
    return mean, cov, size


def _starts(x: np.ndarray, starts: int, best: int, share: float, centred: bool, seed: list[int]) -> list[tuple]:
    """Best of many elemental starts: dims + 1 rows, more until they span a volume, then two concentration steps."""
    rng = np.random.default_rng(seed)
    h = min(len(x), max(x.shape[1] + 1, int(math.ceil(share * len(x)))))
    found = []
    for _ in range(starts):
        order = rng.permutation(len(x))
        k = min(len(x), x.shape[1] + 1)
        mean, cov, size = _moments(x[order[:k]], centred)
        while math.isinf(size) and k < len(x):
            k += 1
            mean, cov, size = _moments(x[order[:k]], centred)
        found.append(_concentrate(x, mean, cov, h, 2, centred))
    return sorted(found, key=lambda f: f[2])[:best]


def nested_starts(base: DataFrame, key: str, share: float, centred: bool, subsets: int = 5, rows: int = 300, starts: int = 100, best: int = 10,
                  seed: int = 0) -> list[tuple[np.ndarray, np.ndarray]]:
    """Up to `best` centres and covariances: the best of many starts on disjoint hashed subsets, taken on within their union.

    The union has at most `subsets` x `rows` rows, chosen by hash; it is one task's input, the subsets one task's each.
    """
    quota = base.sparkSession.createDataFrame([(0, subsets * rows)], "_all int, quota bigint")
    pool = cut_lineage(hash_rank(take_hashed(base.withColumn("_all", F.lit(0)), key, seed, quota, ["_all"]).drop("_all"), key, seed, name="_r").select(
        (F.col("_r") % subsets).cast("int").alias("part"), "_r", "x"))
    dims = len(pool.select("x").first()[0])
    kind = "part int, mean array<double>, cov array<double>, size double"

    def frame(part: int, found: list[tuple]) -> pd.DataFrame:
        return pd.DataFrame({"part": part, "mean": [f[0] for f in found], "cov": [f[1].ravel() for f in found], "size": [f[2] for f in found]})

    def begin(pdf: pd.DataFrame) -> pd.DataFrame:
        part = int(pdf["part"].iloc[0])
        return frame(part, _starts(np.stack(pdf.sort_values("_r")["x"].to_numpy()), starts, best, share, centred, [seed, part]))

    def merge(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        x = np.stack(left.sort_values("_r")["x"].to_numpy())
        h = min(len(x), max(dims + 1, int(math.ceil(share * len(x)))))
        found = [_concentrate(x, np.asarray(r.mean_), np.asarray(r.cov).reshape(dims, dims), h, 2, centred) for r in right.rename(columns={"mean": "mean_"}).itertuples()]
        return frame(0, sorted(found, key=lambda f: f[2])[:best])

    one = lambda d: d.withColumn("one", F.lit(0)).groupBy("one")
    begun = pool.groupBy("part").applyInPandas(begin, kind)
    return [(np.array(r["mean"]), np.array(r["cov"]).reshape(dims, dims))
            for r in one(pool).cogroup(one(begun)).applyInPandas(merge, kind).orderBy("size").collect()]


#: Rows around a cut that a concentration step reads to find it; more are counted in finer bins first.
AT_CUT = 20_000


class _Blocks:
    """Rows as written blocks of bytes, for loops that pass over all of them by their distance from a centre."""

    def __init__(self, base: DataFrame, key: str, dims: int):
        def pack_batch(batches):
            for b in batches:
                if len(b):
                    yield pd.DataFrame({"flat": [np.stack(b["x"].to_numpy()).astype(float).tobytes()]})

        self.rows, self.dims = cut_lineage(_spread(base.select(key, "x"), key).select("x").mapInPandas(pack_batch, "flat binary")), dims

    def _each(self, mean: np.ndarray, inverse: np.ndarray):
        """A task's blocks with the squared distances of their rows."""
        dims = self.dims

        def walk(batches):
            for b in batches:
                for flat in b["flat"]:
                    x = np.frombuffer(flat).reshape(-1, dims)
                    d = x - mean
                    yield x, ((d @ inverse) * d).sum(axis=1)
        return walk

    def _counts(self, walk, borders: np.ndarray) -> np.ndarray:
        """Rows between the borders: bin i holds distances from border i - 1 (included) to border i."""
        def count(batches):
            total = np.zeros(len(borders) + 1, int)
            for _, d in walk(batches):
                total += np.bincount(np.searchsorted(borders, d, "right"), minlength=len(total))
            yield pd.DataFrame({"i": np.flatnonzero(total), "n": total[total > 0]})

        out = np.zeros(len(borders) + 1, int)
        for r in self.rows.mapInPandas(count, "i int, n bigint").groupBy("i").agg(F.sum("n").alias("n")).collect():  # one row per bin
            out[r["i"]] = r["n"]
        return out

    def _sums(self, walk, low: float, high: float) -> tuple[int, np.ndarray, np.ndarray, list | None]:
        """Number, sum and outer products of the rows nearer than `low`, and the rows from there to `high` (None: too many)."""
        def add(batches):
            n, s, o, near = 0, 0.0, 0.0, []
            for x, d in walk(batches):
                some = x[d < low]
                n, s, o = n + len(some), s + some.sum(axis=0), o + some.T @ some
                at = np.flatnonzero((d >= low) & (d < high))
                near = None if near is None or len(near) + len(at) > AT_CUT else near + [(float(d[i]), x[i]) for i in at]
            if n or near is None:
                yield pd.DataFrame({"n": n, "whole": near is not None, "d": 0.0, "s": [s], "o": [np.ravel(o)]})
            if near:
                yield pd.DataFrame({"n": 0, "whole": True, "d": [d for d, _ in near], "s": [x for _, x in near], "o": [None] * len(near)})

        # one row per task and the few at the cut
        got = self.rows.mapInPandas(add, "n bigint, whole boolean, d double, s array<double>, o array<double>").collect()
        own = [r for r in got if r["o"] is not None]
        s = sum((np.array(r["s"]) for r in own), np.zeros(self.dims))
        o = sum((np.array(r["o"]).reshape(self.dims, -1) for r in own), np.zeros((self.dims, self.dims)))
        near = sorted(((r["d"], r["s"]) for r in got if r["o"] is None), key=lambda r: r[0])
        return sum(r["n"] for r in own), s, o, near if all(r["whole"] for r in own) else None

    def _borders(self, walk, h: int, guess: float | None) -> tuple[float, float]:
        """A range that holds the h-th least distance and few rows; an empty one above it if very many rows are that near."""
        borders = self.dims * np.logspace(-6, 6, 1025)
        if guess:
            borders = np.unique(np.concatenate([borders, guess * np.linspace(0.8, 1.25, 3072)]))
        while True:
            n = self._counts(walk, borders)
            at = int(np.searchsorted(np.cumsum(n), h, "left"))
            low, high = borders[at - 1] if at else -math.inf, borders[at] if at < len(borders) else math.inf
            if n[at] <= AT_CUT:
                return low, high
            finer = np.unique(np.linspace(low, high, 4097)) if math.isfinite(low) and math.isfinite(high) else []
            if len(finer) < 3:
                break
            borders = finer
        # very many equal distances, or some beyond all borders
        scores = self.rows.mapInPandas(lambda batches: (pd.DataFrame({"d": d}) for _, d in walk(batches)), "d double")
        above = float(np.nextafter(order_statistic(scores, "d", h - 1), math.inf))
        return above, above

    def nearest(self, mean: np.ndarray, cov: np.ndarray, h: int, guess: float | None, centred: bool, width: float = 0.0):
        """Mean, covariance and greatest distance of the h rows nearest to a centre, and of those as near as the last one.

        A pass adds up the rows nearer than the cut and reads the few about it, taken to be within `width` of `guess`.
        Where they are not, one more pass before it finds the cut by counting rows in narrow bins.
        """
        walk = self._each(mean, np.linalg.pinv(cov))
        n, s, o, near = self._sums(walk, guess * (1 - width), guess * (1 + width)) if guess and width else (0, 0, 0, None)
        if near is None or not n < h <= n + len(near):
            low, high = self._borders(walk, h, guess)
            n, s, o, near = self._sums(walk, low, high)
        cut = near[h - n - 1][0] if n < h else float(np.nextafter(low, -math.inf))
        x = np.array([r for d, r in near if d <= cut]).reshape(-1, self.dims)
        n, s, o = n + len(x), s + x.sum(axis=0), o + x.T @ x
        mean = np.zeros(self.dims) if centred else s / n
        return mean, o / n - np.outer(mean, mean), cut


def mcd(df: DataFrame, key: str = "key", vec: str = "vec", steps: int = 500, support: float | None = None, assume_centered: bool = False,
        finalists: int = 3, reweighted: bool = False, seed: int = 0) -> DataFrame:
    """Squared Mahalanobis distance under the covariance of the rows that lie closest together.

    The best of many starts (see `nested_starts`) take two concentration steps over all rows; the one of least determinant
    goes on until it stops falling (not to get there within `steps` raises). `reweighted`: the covariance is scaled to be
    consistent for normal rows, and estimated again from the rows within its 97.5 % bound. A step reads the base rows
    once or twice, from blocks written once (see `_Blocks`), with the last centre and inverse as constants.
    """
    base = df.select(key, F.col(vec).cast("array<double>").alias("x"))
    n, dims = base.count(), len(df.select(vec).first()[0])
    h = int(support * n) if support else (n + dims + 1) // 2

    def scored(mean: np.ndarray, cov: np.ndarray) -> DataFrame:
        inverse = np.linalg.pinv(cov)

        @F.pandas_udf("double")
        def gap(v: pd.Series) -> pd.Series:
            if not len(v):
                return pd.Series([], dtype=float)
            d = np.stack(v.to_numpy()) - mean
            return pd.Series(((d @ inverse) * d).sum(axis=1))
        return base.withColumn("score", gap("x"))

    blocks, cuts = _Blocks(base, key, dims), []

    def concentrated(mean, cov):
        # the cut moves less and less, but by turns more than in the step before
        moves = [abs(b / a - 1) for a, b in zip(cuts[-5:-1], cuts[-4:]) if a > 0]
        width = min(max(4 * max(moves), 1e-4), 1e-3) if moves else 0.0
        mean, cov, cut = blocks.nearest(mean, cov, h, cuts[-1] if cuts else None, assume_centered, width)
        cuts.append(cut)
        return mean, cov, float(np.linalg.slogdet(cov + 1e-12 * np.eye(dims))[1])

    tried = []
    for mean, cov in nested_starts(base, key, h / n, assume_centered, seed=seed)[:finalists]:
        mean, cov, _ = concentrated(mean, cov)
        tried.append(concentrated(mean, cov))
    mean, cov, last = min(tried, key=lambda t: t[2])
    for _ in range(steps):
        mean, cov, size = concentrated(mean, cov)
        if last - size < 1e-9:
            break
        last = size
    else:
        raise RuntimeError(f"the determinant still fell after {steps} steps")
    now = scored(mean, cov)
    if not reweighted:
        return now.select(key, "score")
    cov = cov * order_statistic(now, "score", (n - 1) // 2) / chi2_quantile(0.5, dims)
    within = scored(mean, cov).filter(F.col("score") < chi2_quantile(0.975, dims))
    mean, cov = mean_and_covariance(within, "x", assume_centered)
    return scored(mean, cov).select(key, "score")


# ---- random orders and trees -----------------------------------------------------------

def lmdd(df: DataFrame, key: str = "key", vec: str = "vec", n_iter: int = 50, seed=0) -> DataFrame:
    """Largest gain in variance that a row brings to the rows before it, over hashed random orders.

    Variance is over all values of the prefix, so two running sums per order are enough.
    """
    base = df.select(key, F.size(vec).cast("double").alias("m"), F.aggregate(F.col(vec).cast("array<double>"), F.lit(0.0), lambda s, x: s + x).alias("s1"),
                     F.aggregate(F.col(vec).cast("array<double>"), F.lit(0.0), lambda s, x: s + x * x).alias("s2"))
    orders = base.withColumn("it", F.explode(F.sequence(F.lit(0), F.lit(n_iter - 1))))
    placed = orders.withColumn("_h", hash32(seed, "it", key)).withColumn("_b", hash_bucket("_h"))
    cum = running_sums(placed, ["it"], "_b", ["_h", key], {"c": F.col("m"), "t1": F.col("s1"), "t2": F.col("s2")})
    def var(c, a, b):
        return F.coalesce(F.try_divide(b, c) - F.pow(F.try_divide(a, c), F.lit(2.0)), F.lit(0.0))
    gain = var(F.col("c"), F.col("t1"), F.col("t2")) - var(F.col("c") - F.col("m"), F.col("t1") - F.col("s1"), F.col("t2") - F.col("s2"))
    return cum.withColumn("gain", F.when(F.abs(F.col("c") - F.col("m")) < 0.5, F.lit(0.0)).otherwise(gain)).groupBy(key).agg(F.greatest(F.max("gain"), F.lit(0.0)).alias("score"))


def average_path(n) -> float:
    """Mean depth of an unsuccessful search in a tree of n rows."""
    return 0.0 if n <= 1 else (1.0 if n == 2 else 2 * (math.log(n - 1) + 0.5772156649015329) - 2 * (n - 1) / n)


def _grow(x: np.ndarray, rng, limit: int, cols: np.ndarray) -> dict[str, list]:
    nodes: dict[str, list] = {"f": [], "t": [], "l": [], "r": [], "d": []}

    def add(rows: np.ndarray, depth: int) -> int:
        at = len(nodes["f"])
        for name, v in (("f", -1), ("t", 0.0), ("l", -1), ("r", -1), ("d", depth + average_path(len(rows)))):
            nodes[name].append(v)
        spread = cols[(rows[:, cols].max(axis=0) > rows[:, cols].min(axis=0))] if len(rows) > 1 else []
        if depth < limit and len(spread):
            f = int(rng.choice(spread))
            t = float(rng.uniform(rows[:, f].min(), rows[:, f].max()))
            go = rows[:, f] < t
            nodes["f"][at], nodes["t"][at] = f, t
            nodes["l"][at] = add(rows[go], depth + 1)
            nodes["r"][at] = add(rows[~go], depth + 1)
        return at

    add(x, 0)
    return nodes


def isolation_forest(df: DataFrame, key: str = "key", vec: str = "vec", n_estimators: int = 100, max_samples: int | float | str = 256,
                     max_features: float = 1.0, seed: int = 0, whole: int = 4096) -> DataFrame:
    """2^(-mean path / c(sample)). Samples are drawn without replacement.

    A tree of at most `whole` sampled rows grows in one task and all of them score in batches; trees of
    larger samples grow level by level (`level_trees`), where no task holds a whole sample.
    """
    rows = df.select(key, F.col(vec).cast("array<double>").alias("x"))
    n, dims = rows.count(), len(df.select(vec).first()[0])
    size = min(256, n) if max_samples == "auto" else max(1, int(max_samples * n)) if isinstance(max_samples, float) else min(max_samples, n)
    if size > whole:
        depth = F.col("path") / F.lit(float(n_estimators)) / F.lit(average_path(size))
        return path_sums(rows, key, n_estimators, size, max_features, seed).select(key, F.pow(F.lit(2.0), -depth).alias("score"))
    # trees draw from a pool of at most n_estimators * max_samples hashed rows; other rows never move
    pool_size = min(n, n_estimators * size)
    quota = df.sparkSession.createDataFrame([(0, pool_size)], "_all int, quota bigint")
    pool = cut_lineage(take_hashed(rows.withColumn("_all", F.lit(0)), key, seed, quota, ["_all"]).drop("_all"))
    ranked = hash_rank(pool, key, seed, name="_rank")
    # a tree takes the ranks that equal steps from a place of its own meet; a step without a common divisor with the pool meets none twice
    draws = np.random.default_rng([seed, n_estimators])
    starts, steps = draws.integers(0, pool_size, n_estimators), draws.integers(1, max(pool_size, 2), n_estimators)
    steps = [next(s for s in range(int(step), int(step) + pool_size + 1) if math.gcd(s, pool_size) == 1) for step in steps]
    ways = df.sparkSession.createDataFrame([(t, int(a), int(s)) for t, (a, s) in enumerate(zip(starts, steps))], "tree int, start bigint, step bigint")
    picks = ways.select("tree", F.explode(F.sequence(F.lit(0), F.lit(size - 1))).alias("i"), "start", "step").select(
        "tree", ((F.col("start") + F.col("i").cast("bigint") * F.col("step")) % pool_size + 1).alias("_rank"))

    def grow(pdf: pd.DataFrame) -> pd.DataFrame:
        tree = int(pdf["tree"].iloc[0])
        rng = np.random.default_rng([seed, tree])
        x = np.stack(pdf.sort_values("_rank")["x"].to_numpy())
        cols = np.sort(rng.choice(dims, max(1, int(dims * max_features)), replace=False))
        nodes = _grow(x, rng, max(1, math.ceil(math.log2(max(len(x), 2)))), cols)
        return pd.DataFrame({"tree": [tree], "n": [len(x)], **{k: [v] for k, v in nodes.items()}})

    # n_estimators rows of at most 2 * max_samples nodes each
    forest = picks.join(ranked, "_rank").groupBy("tree").applyInPandas(
        grow, "tree int, n int, f array<int>, t array<double>, l array<int>, r array<int>, d array<double>").orderBy("tree").collect()
    trees = [tuple(np.asarray(r[c]) for c in "ftlrd") for r in forest]
    norm = sum(average_path(r["n"]) for r in forest) / len(forest)

    @F.pandas_udf("double")
    def score(v: pd.Series) -> pd.Series:
        if not len(v):
            return pd.Series([], dtype=float)
        x, depth = np.stack(v.to_numpy()), 0.0
        for f, t, l, r, d in trees:
            at = np.zeros(len(x), dtype=int)
            while True:
                inner = np.flatnonzero(f[at] >= 0)
                if not len(inner):
                    break
                a = at[inner]
                at[inner] = np.where(x[inner, f[a]] < t[a], l[a], r[a])
            depth = depth + d[at]
        return pd.Series(2.0 ** (-(depth / len(trees)) / norm))

    return rows.select(key, score("x").alias("score"))
