"""Exact nearest neighbours and all-pairs sums, in blocks.

`knn` collapses equal vectors first (a vector copied a billion times is one row with its
k+1 lowest keys), assigns vectors to pivot cells, and compares two blocks only when the
triangle inequality cannot rule the pair out. Each block holds a bounded number of rows,
a cell with many rows is cut into many blocks, and only the k+1 best pairs per row leave
a comparison. `pair_sums` is the unpruned form for sums that need every pair; only sums
per row leave it. Blocks are written once and read where they are compared (`stream_past`):
nothing is copied through a shuffle.
"""
from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from raregrain.session import cut_lineage

MAX_PIVOTS = 256
TILE = 32
# rows that a written block holds at most, of a smaller size asked for at most WIDER times as many:
# a block is sent along with each one it meets
BLOCK_ROWS = 2048
WIDER = 8
# rows of a search block, each of which looks through few rows of most blocks: what is sent along with a pair counts for more there
SEARCH_ROWS = 8192
# parts of the right side of a comparison: each gives every left row one partial result
RIGHT_PARTS = 6
RIGHT_BYTES = 64 << 20


def _spread(df: DataFrame, at: str = "part") -> DataFrame:
    """As many parts as tasks run at once, by a column."""
    return df.repartition(max(df.sparkSession.sparkContext.defaultParallelism, 1), at)


def _block_rows(rows: int, most: int = BLOCK_ROWS) -> int:
    return max(rows, min(WIDER * rows, most))


def stream_past(left: DataFrame, right: DataFrame, one, merge, done, schema: str, size: int = 0, on=None, mutual: list[str] | None = None) -> DataFrame:
    """Every right block streams past every left block: `one(l, r, held)` for a pair (None: nothing), results
    folded by `merge(held, new)`, and `done(l, held)` leaves once for each run of a left block.

    Both sides are written blocks with a number `part` that tells left blocks apart. Spark pairs their files without a
    shuffle; `size` is the right side's bytes, of which a task holds one part. `on(l, r)` may leave out pairs of blocks by
    their columns, named l_* and r_*.

    With `mutual`, both sides are the same blocks and two of them meet once only: `one` returns the results of either block, and
    those of right blocks (None: nothing) leave when a task ends, by `done` with the columns that `mutual` names.
    """
    if mutual is not None:
        on = F.col("l_part") <= F.col("r_part")
    names = [f"l_{c}" for c in left.columns], [f"r_{c}" for c in right.columns]
    lf, rf = left.toDF(*names[0]), right.coalesce(max(RIGHT_PARTS, math.ceil(size / RIGHT_BYTES))).toDF(*names[1])
    lf = lf.hint("shuffle_replicate_nl")
    both = lf.crossJoin(rf) if on is None else lf.join(rf, on)

    def loop(batches):
        at, own, held, theirs = None, None, None, {}
        for batch in batches:
            for row in zip(*[batch[c] for c in batch.columns]):
                l, r = dict(zip(left_names, row)), dict(zip(right_names, row[len(left_names):]))
                if l["part"] != at:
                    if held is not None:
                        yield done(own, held)
                    at, own, held = l["part"], l, None
                new = one(own, r, held)
                if mutual is not None:
                    new, back = new
                    if back is not None:
                        # copies, as the batch is not to stay
                        kept = theirs.get(r["part"])
                        theirs[r["part"]] = ({c: np.array(r[c]) for c in mutual}, back) if kept is None else (kept[0], merge(kept[1], back))
                if new is not None:
                    held = new if held is None else merge(held, new)
        if held is not None:
            yield done(own, held)
        for r, back in theirs.values():
            yield done(r, back)

    left_names, right_names = left.columns, right.columns
    return both.mapInPandas(loop, schema)


def _left_side(a: np.ndarray, w: np.ndarray) -> np.ndarray:
    """Rows whose product with `_right_side` is the weighted squared distance."""
    aw = a * w
    return np.concatenate([-2 * aw, (aw * a).sum(axis=1)[:, None], np.ones((len(a), 1))], axis=1)


def _right_side(b: np.ndarray, w: np.ndarray) -> np.ndarray:
    return np.concatenate([b.T, np.ones((1, len(b))), ((b * b) @ w)[None, :]])


def power_sums(a: np.ndarray, b: np.ndarray, power: float, w: np.ndarray, right: np.ndarray | None = None, least: float = 0.0) -> np.ndarray:
    """Matrix of the weighted sums of |a_f - b_f|^power between the rows of a and b.

    Squares are at least `least`; `right` is b's `_right_side`, for callers that use it many times.
    """
    if power == 2.0:
        d2 = _left_side(a, w) @ (_right_side(b, w) if right is None else right)
        return np.maximum(d2, least, out=d2)
    out = np.zeros((len(a), len(b)))
    bt = np.ascontiguousarray(b.T)
    # some rows at a time, so that the sums stay in the cache
    rows = max(1, (1 << 16) // max(len(b), 1))
    for at in range(0, len(a), rows):
        part, x = a[at:at + rows], out[at:at + rows]
        d, t = np.empty_like(x), np.empty_like(x)
        for f in np.flatnonzero(w):
            np.subtract(part[:, f, None], bt[f][None, :], out=d)
            np.abs(d, out=d)
            if power == 3.0:
                np.multiply(d, d, out=t)
                np.multiply(t, d, out=d)
            elif power != 1.0:
                np.power(d, power, out=d)
            if w[f] != 1.0:
                d *= w[f]
            x += d
    return out


#: Right rows that a city-block pass takes at once: with some tens of features its operands stay in the cache.
CITY_COLS = 512


class CityBlock:
    """Weighted city-block distances to the rows of one block of finite vectors: sums of a + b - 2 min(a, b).

    A left row is laid out as wide as a piece of the right side once and meets all pieces: numpy is several times
    as fast on two arrays of one shape as on a number and a row, and weights and sum are one product.
    """

    def __init__(self, b: np.ndarray, w: np.ndarray):
        self.kept, self.n = np.flatnonzero(w), len(b)
        self.w = w[self.kept]
        # values near 0, of whose sums little is lost
        self.centre = b[:, self.kept].mean(axis=0)
        x = b[:, self.kept] - self.centre
        pieces = max(1, math.ceil(len(b) / CITY_COLS))
        self.width = math.ceil(len(b) / pieces)
        padded = np.zeros((len(self.kept), pieces * self.width))
        padded[:, :len(b)] = x.T
        self.pieces = [np.ascontiguousarray(padded[:, i * self.width:(i + 1) * self.width]) for i in range(pieces)]
        self.total = x @ self.w

    def to(self, a: np.ndarray) -> np.ndarray:
        x = a[:, self.kept] - self.centre
        out = np.empty((len(a), len(self.pieces) * self.width))
        own, least = np.empty((2, *self.pieces[0].shape))
        for row, sums in zip(x, out):
            own[:] = row[:, None]
            for at, piece in enumerate(self.pieces):
                np.minimum(own, piece, out=least)
                np.dot(self.w, least, out=sums[at * self.width:(at + 1) * self.width])
        d = out[:, :self.n]
        d *= -2
        d += (x @ self.w)[:, None]
        d += self.total
        return np.maximum(d, 0.0, out=d)


def distances(a: np.ndarray, b: np.ndarray, metric: str = "euclidean", p: float = 2.0,
              weights: np.ndarray | None = None) -> np.ndarray:
    """Distance matrix between the rows of a and b, features optionally weighted."""
    w = np.ones(a.shape[1]) if weights is None else weights
    power = {"euclidean": 2.0, "cityblock": 1.0}.get(metric, p)
    out = power_sums(a, b, power, w)
    return out if power == 1.0 else np.sqrt(out) if power == 2.0 else out ** (1.0 / power)


def _exact(a: np.ndarray, b: np.ndarray, metric: str, p: float) -> np.ndarray:
    """Row-aligned distances by direct differences (no cancellation)."""
    diff = np.abs(a - b)
    if metric == "euclidean":
        return np.sqrt((diff * diff).sum(axis=1))
    power = 1.0 if metric == "cityblock" else p
    return (diff ** power).sum(axis=1) ** (1.0 / power)


@F.pandas_udf(T.BinaryType())
def _as_bytes(flat: pd.Series) -> pd.Series:
    """Doubles as bytes, which Spark hands on whole; null elements become NaN."""
    return pd.Series([np.asarray(x, dtype=float).tobytes() for x in flat], dtype=object)


def _as_matrix(flat: bytes, rows: int) -> np.ndarray:
    return np.frombuffer(flat, dtype=float).reshape(rows, -1)


def _lower_bounds(q: np.ndarray, c: np.ndarray) -> tuple[np.ndarray, np.ndarray, float]:
    """(left, right, scale): left @ right are single-precision lower bounds of the squared distances between rows, divided by scale.

    Products in single precision are off by less than `eps` of the two rows' squares, which are made that much smaller.
    """
    qq, cc = (q * q).sum(axis=1), (c * c).sum(axis=1)
    sizes = np.concatenate([qq, cc])
    scale = float(max(sizes[np.isfinite(sizes)].max(initial=0.0), 1e-290))
    eps = 4 * (q.shape[1] + 8) * 2.0 ** -24
    root = math.sqrt(scale)
    left = np.concatenate([q * (-2 / root), (qq * ((1 - eps) / scale))[:, None], np.ones((len(q), 1))], axis=1).astype(np.float32)
    right = np.concatenate([c.T / root, np.ones((1, len(c))), (cc * ((1 - eps) / scale))[None, :]]).astype(np.float32)
    return left, right, scale


def _with_id(df: DataFrame, vec: str) -> DataFrame:
    """128-bit fingerprint of the vector: equal vectors share it."""
    return df.withColumn("_va", F.xxhash64(vec)).withColumn("_vb", F.xxhash64(F.lit(1), F.col(vec)))


def _in_cells(df: DataFrame, pivots: np.ndarray, metric: str, p: float) -> DataFrame:
    @F.pandas_udf("cell int, reach double")
    def nearest(v: pd.Series) -> pd.DataFrame:
        if len(v) == 0:
            return pd.DataFrame({"cell": [], "reach": []})
        m = np.stack(v.to_numpy())
        cell = distances(m, pivots, metric, p).argmin(axis=1)
        return pd.DataFrame({"cell": cell.astype("int32"), "reach": _exact(m, pivots[cell], metric, p)})

    return df.withColumn("_c", nearest("_vec")).select("*", "_c.cell", "_c.reach").drop("_c")


def _blocks(df: DataFrame, parts: dict[int, int], extra: list[str]) -> DataFrame:
    """Pack rows of one cell into blocks, flat arrays in one row each."""
    lookup = F.create_map(*[x for c, n in parts.items() for x in (F.lit(c), F.lit(n))])
    before = F.create_map(*[x for c, n in zip(parts, np.cumsum([0, *parts.values()]).tolist()) for x in (F.lit(c), F.lit(n))])
    rows = df.withColumn("part", (F.pmod(F.col("_va"), lookup[F.col("cell")]) + before[F.col("cell")]).cast("int"))
    packed = _spread(rows).groupBy("cell", "part").agg(
        F.collect_list(F.struct("_va", "_vb", "reach", "_vec", *extra)).alias("_rows"))
    cols = [F.col(f"_rows.{n}").alias(n) for n in ["_va", "_vb", "reach", *extra]]
    return packed.select("cell", "part", _as_bytes(F.flatten("_rows._vec")).alias("flat"), *cols)


def knn(queries: DataFrame, candidates: DataFrame | None, k: int, key: str = "key", vec: str = "vec",
        payload: list[str] = (), metric: str = "euclidean", p: float = 2.0, pivots: int = 16,
        rows_per_block: int = 2048) -> DataFrame:
    """Add `nn` to the queries: their k nearest candidates as array<struct<distance, key, payload...>>.

    `candidates=None` searches the queries among themselves. The row itself (same key) is
    left out; equal distances are ordered by key.
    """
    payload = list(payload)
    spark = queries.sparkSession
    alone = candidates is None
    candidates = queries if alone else candidates
    base = _with_id(candidates.select(F.col(key).alias("_key"), F.col(vec).cast("array<double>").alias("_vec"), *payload), "_vec")
    first = Window.partitionBy("_va", "_vb").orderBy("_key")
    members = (
        base.withColumn("_r", F.row_number().over(first)).filter(F.col("_r") <= k + 1)
        .groupBy("_va", "_vb").agg(
            F.first("_vec").alias("_vec"), F.min("_key").alias("_first"),
            F.collect_list(F.struct(F.col("_key").alias("key"), *payload)).alias("members")))
    asked = _with_id(queries.withColumn("_vec", F.col(vec).cast("array<double>")), "_vec")

    # a bounded number of pivots: the candidates with the lowest fingerprints
    chosen = base.select("_vec", "_va", "_vb").orderBy("_va", "_vb", "_key").limit(min(pivots, MAX_PIVOTS)).collect()
    if not chosen:
        return queries.withColumn("nn", F.array().cast(_nn_type(candidates, key, payload)))
    centre = np.unique(np.array([r["_vec"] for r in chosen]), axis=0)
    c_cells = cut_lineage(_in_cells(members, centre, metric, p))
    if alone:
        q_cells = c_cells.select("_va", "_vb", "_vec", "cell", "reach")
    else:
        points = asked.select("_va", "_vb", "_vec").dropDuplicates(["_va", "_vb"])
        q_cells = cut_lineage(_in_cells(points, centre, metric, p))
    closest = Window.partitionBy("cell").orderBy("reach")
    # per cell: size, radius, and the radius that holds its k+1 innermost candidates
    c_stat = {r["cell"]: r for r in c_cells.groupBy("cell").agg(F.count(F.lit(1)).alias("n"), F.max("reach").alias("far")).collect()}
    near = {r["cell"]: r["near"] for r in c_cells.select("cell", "reach").withColumn("_r", F.row_number().over(closest))
            .filter(F.col("_r") <= k + 1).groupBy("cell").agg(F.max("reach").alias("near")).collect()}
    q_stat = c_stat if alone else {r["cell"]: r for r in q_cells.groupBy("cell").agg(F.count(F.lit(1)).alias("n"), F.max("reach").alias("far")).collect()}
    gap = distances(centre, centre, metric, p)
    full = [c for c, r in c_stat.items() if r["n"] >= k + 1]
    slack = 1e-9
    limit = {a: min([gap[a, t] + near[t] for t in full], default=math.inf) for a in q_stat}
    pairs = [(a, [b for b in c_stat if gap[a, b] - r["far"] - c_stat[b]["far"] <= limit[a] + r["far"] + slack])
             for a, r in q_stat.items()]
    per_block = _block_rows(rows_per_block, SEARCH_ROWS)
    c_parts = {c: max(1, math.ceil(r["n"] / per_block)) for c, r in c_stat.items()}
    q_parts = {c: max(1, math.ceil(r["n"] / per_block)) for c, r in q_stat.items()}

    # at most MAX_PIVOTS short rows: which query cells have to see a candidate cell
    plan = spark.createDataFrame([(b, [a for a, bs in pairs if b in bs]) for b in c_stat], "cell int, asked array<int>")
    c_side = cut_lineage(_blocks(c_cells, c_parts, ["_first"]).join(F.broadcast(plan), "cell").select("cell", "asked", "flat", "_va", "_vb", "_first"))
    power = {"euclidean": 2.0, "cityblock": 1.0}.get(metric, p)

    def bounded(batches):
        """Blocks with a bound for each row: the distance of the farthest of some k+1 rows of its own block."""
        for batch in batches:
            for block in batch.to_dict("records"):
                q = _as_matrix(block["flat"], len(block["_va"]))
                bar = np.full(len(q), np.inf)
                if alone and len(q) > k:
                    if power == 2.0:
                        shift = np.nan_to_num(centre[block["cell"]], nan=0.0, posinf=0.0, neginf=0.0)
                        left, right, _ = _lower_bounds(q - shift, q - shift)
                    for at in range(0, len(q), 4 * TILE):
                        part = q[at:at + 4 * TILE]
                        near = left[at:at + 4 * TILE] @ right if power == 2.0 else power_sums(part, q, power, np.ones(q.shape[1]))
                        some = np.argpartition(near, k, axis=1)[:, :k + 1]
                        bar[at:at + 4 * TILE] = _exact(np.repeat(part, k + 1, axis=0), q[some.ravel()], metric, p).reshape(-1, k + 1).max(axis=1)
                yield pd.DataFrame({**{c: [block[c]] for c in q_cols}, "bar": [np.where(np.isfinite(bar), bar, np.inf)]})

    # each task starts from these, so that only its few nearer pairs are looked at one by one
    q_blocks = _blocks(q_cells, q_parts, [])
    q_cols = ["part", "cell", "flat", "_va", "_vb", "reach"]
    q_side = cut_lineage(q_blocks.select(*q_cols).mapInPandas(bounded, "part int, cell int, flat binary, _va array<bigint>, _vb array<bigint>, reach array<double>, bar array<double>"))
    far = {c: r["far"] for c, r in c_stat.items()}
    key_type = dict(candidates.select(F.col(key).alias("k")).dtypes)["k"]

    def best_of(i, d, first):
        """Positions of each row's k+1 best, by distance then key."""
        order = np.lexsort((d, i))
        a, b = order[:-1], order[1:]
        if ((i[a] == i[b]) & ~(d[a] < d[b])).any():
            order = np.lexsort((first, d, i))
        starts = np.r_[0, np.flatnonzero(np.diff(i[order])) + 1]
        place = np.arange(len(i)) - np.repeat(starts, np.diff(np.r_[starts, len(i)]))
        return order[place <= k]

    def one(l, r, held):
        """Candidates of one block that may be among the k+1 best of the live rows of one query block."""
        q, c = _as_matrix(l["flat"], len(l["_va"])), _as_matrix(r["flat"], len(r["_va"]))
        # the distance of a row's last held candidate bounds it; rows that the cell border rules out are skipped
        bar = np.array(l["bar"], dtype=float)
        if held is not None:
            ends = np.flatnonzero(np.r_[np.diff(held[0]), 1])
            full = np.diff(np.r_[-1, ends]) == k + 1
            rows = held[0][ends[full]]
            bar[rows] = np.minimum(bar[rows], held[1][ends[full]])
        low = distances(q, centre[[r["cell"]]], metric, p)[:, 0] - far[r["cell"]]
        live = np.flatnonzero(low <= np.minimum(np.asarray(l["reach"]) + limit[l["cell"]], bar) + 1e-7)
        q, bar = q[live], bar[live]
        if power == 2.0:
            # from the cell's centre, as the bounds are off by the vectors' size
            shift = np.nan_to_num(centre[r["cell"]], nan=0.0, posinf=0.0, neginf=0.0)
            left, right, scale = _lower_bounds(q - shift, c - shift)
        # some rows at a time, so that their matrix stays in the cache
        found = []
        for at in range(0, len(q), 4 * TILE):
            some = slice(at, at + 4 * TILE)
            if power == 2.0:
                i, d, j = among(q[some], c, left[some] @ right, scale, bar[some])
            else:
                i, d, j = among(q[some], c, power_sums(q[some], c, power, np.ones(q.shape[1])), 1.0, bar[some])
            found.append((live[some][i], d, j))
        i, d, j = (np.concatenate(x) for x in zip(*found)) if found else ([],) * 3
        if not len(i):
            return None
        return i, d, np.asarray(r["_first"])[j], np.asarray(r["_va"])[j], np.asarray(r["_vb"])[j]

    def among(q, c, near, scale, bar):
        """(row, distance, candidate) of all candidates within a row's bound by `near`, distances to the power over scale or less."""
        free = np.flatnonzero(np.isinf(bar))
        if len(free) and len(c) > k:
            # any k+1 candidates bound the k+1 best
            some = np.argpartition(near[free], k, axis=1)[:, :k + 1]
            own = _exact(np.repeat(q[free], k + 1, axis=0), c[some.ravel()], metric, p)
            bar[free] = own.reshape(-1, k + 1).max(axis=1)
        with np.errstate(over="ignore"):
            cut = ((bar * (1 + 1e-6) + 1e-12) ** power) / scale + 1e-30
            if near.dtype == np.float32:
                # the next number up in the bounds' own precision
                cut = np.nextafter(cut.astype(np.float32), np.float32(np.inf))
        # most rows have no candidate left in a late block; those with a NaN bound are looked through
        rows = np.flatnonzero(~(near.min(axis=1) > cut))
        at = np.flatnonzero((near if len(rows) == len(near) else near[rows]) <= cut[rows, None])
        i, j = np.divmod(at, len(c))
        i = rows[i]
        return i, _exact(q[i], c[j], metric, p), j

    def merge(held, new):
        changed = np.isin(held[0], new[0])
        both = tuple(np.concatenate([x[changed], y]) for x, y in zip(held, new))
        keep = best_of(*both[:3])
        if changed.all():
            return tuple(x[keep] for x in both)
        # rows without a new candidate stay as they are
        order = np.argsort(np.concatenate([held[0][~changed], both[0][keep]]), kind="stable")
        return tuple(np.concatenate([x[~changed], y[keep]])[order] for x, y in zip(held, both))

    def first_of(l, r, held):
        new = one(l, r, held)
        return merge(tuple(x[:0] for x in new), new) if held is None and new is not None else new

    def done(l, held):
        i, d, first, va, vb = held
        return pd.DataFrame({"_va": np.asarray(l["_va"])[i], "_vb": np.asarray(l["_vb"])[i], "c_va": va, "c_vb": vb, "distance": d, "c_first": first})

    rows = sum(r["n"] for r in c_stat.values())
    found = stream_past(
        q_side, c_side, first_of, merge, done,
        f"_va bigint, _vb bigint, c_va bigint, c_vb bigint, distance double, c_first {key_type}",
        rows * (centre.shape[1] + 3) * 8, F.array_contains("r_asked", F.col("l_cell")))
    best = Window.partitionBy("_va", "_vb").orderBy("distance", "c_first")
    trimmed = found.withColumn("_r", F.row_number().over(best)).filter(F.col("_r") <= k + 1).drop("_r", "c_first")
    listed = trimmed.join(c_cells.select(F.col("_va").alias("c_va"), F.col("_vb").alias("c_vb"), "members"), ["c_va", "c_vb"])
    fields = ["key", *payload]
    lists = listed.groupBy("_va", "_vb").agg(
        F.slice(F.array_sort(F.flatten(F.collect_list(F.transform(
            "members", lambda m: F.struct(F.col("distance").alias("distance"), *[m[f].alias(f) for f in fields]))))), 1, k + 1)
        .alias("_nn"))
    back = asked.join(lists, ["_va", "_vb"], "left")
    others = F.slice(F.filter(F.col("_nn"), lambda x: x["key"] != F.col(key)), 1, k)
    return back.select(*queries.columns, others.alias("nn"))


def _nn_type(candidates: DataFrame, key: str, payload: list[str]) -> str:
    types = dict(candidates.dtypes)
    return f"array<struct<distance: double, key: {types[key]}" + "".join(f", {c}: {types[c]}" for c in payload) + ">>"


def edges(neighbours: DataFrame, key: str = "key", keep: list[str] = ()) -> DataFrame:
    """One row per (row, neighbour): at most k per row."""
    return neighbours.select(F.col(key), *keep, F.posexplode("nn").alias("place", "n")).select(
        key, *keep, (F.col("place") + 1).alias("place"), F.col("n.distance").alias("distance"), F.col("n.key").alias("nkey"))


def pack(df: DataFrame, key: str, vec: str, y: str, rows_per_block: int = 1024) -> tuple[DataFrame, int]:
    """Rows hashed into bounded blocks, written once: (part, keys, ys, flat)."""
    parts = max(1, math.ceil(df.count() / _block_rows(rows_per_block)))
    rows = df.select(F.col(key).alias("k"), F.col(y).cast("double").alias("y"), F.col(vec).cast("array<double>").alias("v"))
    packed = _spread(rows.withColumn("part", F.pmod(F.xxhash64("k"), F.lit(parts)).cast("int"))).groupBy("part").agg(
        F.collect_list(F.struct("k", "y", "v")).alias("r"))
    return cut_lineage(packed.select("part", F.col("r.k").alias("keys"), F.col("r.y").alias("ys"), _as_bytes(F.flatten("r.v")).alias("flat"))), parts


def similarity(d: np.ndarray, kernel: str) -> np.ndarray:
    s = -d
    if kernel == "rbf":
        s *= d
    return np.exp(s, out=s)


def _of_pairs(raw: np.ndarray, power: float, kernel: str) -> tuple[np.ndarray, np.ndarray]:
    """Distances and kernel weights of a matrix of power sums, which is written over."""
    d = raw if power == 1.0 else np.sqrt(raw, out=raw) if power == 2.0 else np.cbrt(raw) if power == 3.0 else raw ** (1.0 / power)
    return d, similarity(d, kernel)


def _right_of(a: np.ndarray, b: np.ndarray, power: float, w: np.ndarray):
    """What `_raw` needs of a right block, once for all its left rows."""
    if power == 1.0 and np.isfinite(a).all() and np.isfinite(b).all():
        return CityBlock(b, w)
    return _right_side(b, w) if power == 2.0 else None


def _raw(a: np.ndarray, b: np.ndarray, power: float, w: np.ndarray, right, eps: float) -> np.ndarray:
    if isinstance(right, CityBlock):
        return right.to(a)
    raw = power_sums(a, b, power, w, right, eps)
    return raw if power in (1.0, 2.0) else np.maximum(raw, eps, out=raw)


def pair_sums(blocks: DataFrame, parts: int, weights, metric: str = "euclidean", p: float = 2.0,
              kernel: str = "exp", eps: float = 1e-300) -> DataFrame:
    """Per row, sums over all other rows: distances, kernel weights, weighted targets.

    Blocks meet where their files are read, two of them once: a pair of rows counts for both by the sums over rows
    and columns of its matrix, and pairs never leave the task.
    """
    key_type = dict(blocks.dtypes)["keys"][len("array<"):-1]

    def done(l, held):
        return pd.DataFrame({"key": l["keys"], **held})

    schema = f"key {key_type}, n bigint, dist double, nearest double, s double, sy double"
    one, merge = block_sums(weights, metric, p, kernel, eps)
    part = stream_past(blocks, blocks, one, merge, done, schema, parts * BLOCK_ROWS * len(weights) * 8, mutual=["keys"])
    return part.groupBy("key").agg(F.sum("n").alias("n"), F.sum("dist").alias("dist"), F.min("nearest").alias("nearest"),
                                   F.sum("s").alias("s"), F.sum("sy").alias("sy"))


def block_sums(weights, metric: str, p: float, kernel: str, eps: float):
    """(one, merge) for `stream_past`: the sums of `pair_sums` for the rows of either block of a pair."""
    w = np.asarray(weights, dtype=float)
    power = {"euclidean": 2.0, "cityblock": 1.0}.get(metric, p)

    def one(l, r, held):
        a, b = _as_matrix(l["flat"], len(l["keys"])), _as_matrix(r["flat"], len(r["keys"]))
        ly, ry, lk, rk = np.asarray(l["ys"], dtype=float), np.asarray(r["ys"], dtype=float), np.asarray(l["keys"]), np.asarray(r["keys"])
        right = _right_of(a, b, power, w)
        # equal keys are in blocks of one number
        meet = l["part"] == r["part"]
        # some rows at a time, so that the matrices stay in the cache
        tiles, back = [], None
        for i in range(0, len(a), TILE):
            d, s = _of_pairs(_raw(a[i:i + TILE], b, power, w, right, eps), power, kernel)
            if meet:
                same = lk[i:i + TILE, None] == rk[None, :]
                s[same] = 0.0
                tiles.append({"n": (~same).sum(axis=1), "dist": np.where(same, 0.0, d).sum(axis=1), "nearest": np.where(same, np.inf, d).min(axis=1),
                              "s": s.sum(axis=1), "sy": s @ ry})
            else:
                tiles.append(sums(d, s, ry, 1))
                new = sums(d, s, ly[i:i + TILE], 0)
                back = new if back is None else merge(back, new)
        return {n: np.concatenate([t[n] for t in tiles]) for n in tiles[0]}, back

    def sums(d, s, y, axis) -> dict:
        return {"n": np.full(d.shape[1 - axis], d.shape[axis]), "dist": d.sum(axis=axis), "nearest": d.min(axis=axis), "s": s.sum(axis=axis),
                "sy": s @ y if axis else y @ s}

    def merge(held, new):
        return {n: np.minimum(x, new[n]) if n == "nearest" else x + new[n] for n, x in held.items()}

    return one, merge


def block_slopes(weights, metric: str, p: float, kernel: str, eps: float):
    """one(l, r, held) for `stream_past`: sums over the pairs of two blocks of a coefficient times the pair's kernel weight, by every feature weight.

    Row i with a factor h and a prediction p has the coefficient h_i (y_j - p_i) in its pair with row j. Both rows of a pair
    count at once, and two blocks meet once. Power sums at their floor `eps` have no slope, unless they are distances (power 1).
    """
    w = np.asarray(weights, dtype=float)
    power = {"euclidean": 2.0, "cityblock": 1.0}.get(metric, p)

    def one(l, r, held):
        a, b = _as_matrix(l["flat"], len(l["keys"])), _as_matrix(r["flat"], len(r["keys"]))
        (ly, lh, lp), (ry, rh, rp) = ([np.asarray(x[c], dtype=float) for c in ("ys", "h", "p")] for x in (l, r))
        meet = l["part"] == r["part"]
        lk, rk = (np.asarray(x["keys"]) for x in (l, r)) if meet else (None, None)
        # a block with itself has every pair twice
        left = np.stack([lh, -lh * lp] if meet else [lh, -lh * lp, ly, np.ones(len(a))], axis=1)
        other = np.stack([ry, np.ones(len(b))] if meet else [ry, np.ones(len(b)), rh, -rh * rp])
        right = _right_of(a, b, power, w)
        total, columns = np.zeros(len(w)), np.zeros(len(b))
        if power != 1.0 and not w.any():
            return total
        tiny = max(eps, 1e-10 * max(((x * x) @ np.abs(w)).max(initial=0.0) for x in (a, b)) if power == 2.0 else 0.0)
        for i in range(0, len(a), TILE):
            x = a[i:i + TILE]
            raw = _raw(x, b, power, w, right, eps)
            near = np.nonzero(raw <= tiny) if power != 1.0 and raw.min() <= tiny else None
            d, s = _of_pairs(raw, power, kernel)
            # d s / d raw, by the chain rule through d = raw^(1/power)
            if kernel == "rbf":
                s *= 2.0
                if power != 2.0:
                    s *= d
            if power == 2.0 and kernel == "exp":
                s /= d
            elif power not in (1.0, 2.0):
                s *= d
                s /= raw
            c = left[i:i + TILE] @ other
            if near is not None:
                # rows so close that their sums cancel: from their differences; at the floor there is no slope
                if power == 2.0:
                    gaps = (x[near[0]] - b[near[1]]) ** 2
                    own = gaps @ w
                    with np.errstate(divide="ignore", invalid="ignore"):
                        each = np.where(own > eps, 2.0 * np.exp(-own) if kernel == "rbf" else np.exp(-np.sqrt(own)) / np.sqrt(own), 0.0) * c[near] * (-1.0 / power)
                    if meet:
                        each[lk[i:i + TILE][near[0]] == rk[near[1]]] = 0.0
                    total += each @ gaps
                s[near] = 0.0
            c *= s
            c *= -1.0 / power
            if meet:
                c[lk[i:i + TILE, None] == rk[None, :]] = 0.0
            if power == 2.0:
                total += c.sum(axis=1) @ (x * x) - 2 * ((c @ b) * x).sum(axis=0)
                columns += c.sum(axis=0)
            else:
                total += [float((c * np.abs(x[:, f, None] - b[None, :, f]) ** power).sum()) for f in range(len(w))]
        return total + columns @ (b * b) if power == 2.0 else total

    return one


def pack_rows(df: DataFrame, key: str, arrays: list[str], rows_per_block: int = 1024, most: int = BLOCK_ROWS, flat: str | None = None) -> tuple[DataFrame, int]:
    """Rows hashed into bounded blocks with any array columns flattened, written once: (part, keys, arrays...). Column `flat` is written as bytes."""
    parts = max(1, math.ceil(df.count() / _block_rows(rows_per_block, most)))
    packed = _spread(df.withColumn("part", F.pmod(F.xxhash64(key), F.lit(parts)).cast("int"))).groupBy("part").agg(
        F.collect_list(F.struct(F.col(key).alias("k"), *arrays)).alias("r"))
    return cut_lineage(packed.select("part", F.col("r.k").alias("keys"), *[(_as_bytes(F.flatten(f"r.{a}")) if a == flat else F.flatten(f"r.{a}")).alias(a) for a in arrays])), parts
