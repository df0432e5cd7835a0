"""Near-duplicate vectors: random-hyperplane sign hashing in several tables, exact cosines, connected components.

1. Vectors with equal components are one class, named by two 64-bit hashes. In each of several tables a class is
   dealt to a bucket by the signs of its products with `bits` random normal vectors. A pair at the asked cosine
   differs in one sign with a chance of acos(cosine) / pi, so `tables` follows from `bits` and the chance `miss` of
   meeting in none; `bits` grows with the number of classes, so that buckets keep about `rows` of them.
2. Buckets compare vectors rounded to one byte a component, whose rounding error is known, so no link is lost.
   Rows with a partner that may be similar enough, met in no earlier table, come again with exact vectors.
3. Cosines in double precision confirm links. Each pair is counted in the first table where it meets, so only
   counts by row and one edge by row leave a task, never the pairs. Edges give components by star rounds.

Defined cases: null or empty vectors, zero vectors and those with a null or non-finite component link with nothing,
nor do vectors of different length with each other; a null id links with nothing (component null, kept); rows that
repeat an id and a vector count as one vector and are returned each; where an id has several different
vectors, each row gets the links and the component of its own; an empty table gives an empty result; columns other than id and vector are not read.
"""
from __future__ import annotations

import math

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from raregrain.llm.common import shared, sized, travels
from raregrain.llm.components import components

travels(__name__)

COSINE, MISS, ROWS = 0.9, 1e-4, 1024
#: Classes of one bucket that a task holds at most twice (a block against another); products are taken in tiles.
PIECE, TILE = 8192, 1024


def shape(n: int, cosine: float = COSINE, miss: float = MISS, rows: int = ROWS) -> tuple[int, int]:
    """(bits, tables): buckets of about `rows` of `n` classes, a pair at `cosine` meeting nowhere with chance `miss`."""
    bits = max(4, math.ceil(math.log2(max(n, 1) / rows)))
    if bits > 32:
        raise ValueError(f"{bits} bits a table are over 32: raise rows")
    together = (1 - math.acos(cosine) / math.pi) ** bits
    return bits, 1 if together >= 1 else max(1, math.ceil(math.log(miss) / math.log(1 - together)))


def usable(vec: str):
    """Not null nor empty, every component a finite number, not all zero."""
    finite = F.forall(vec, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != F.lit(float("inf"))))
    return F.coalesce(finite & F.exists(vec, lambda x: x != 0), F.lit(False))


def units(vecs) -> np.ndarray:
    """Rows scaled to length one; the greatest component goes first, so that no square overflows."""
    m = np.array(list(vecs), np.float64)
    m /= np.abs(m).max(1, keepdims=True)
    return m / np.sqrt((m * m).sum(1, keepdims=True))


def signed(vectors: np.ndarray, bits: int, tables: int, seed: int) -> np.ndarray:
    """rows x tables bucket numbers from the signs of products with normal vectors."""
    planes = np.random.default_rng(seed).standard_normal((vectors.shape[1], bits * tables))
    above = (vectors @ planes >= 0).reshape(len(vectors), tables, bits)
    return (above * (np.uint64(1) << np.arange(bits, dtype=np.uint64))).sum(2).astype(">u4")


def _coded(classes: DataFrame, bits: int, tables: int, seed: int, kind: str) -> DataFrame:
    """c, f1, d (length), q (a byte each), s (scale), e (rounding error), sig (tables x 4 bytes)."""
    import pyarrow as pa

    def code(batches):
        for batch in batches:
            col = batch.column("vec")
            lens = np.diff(np.asarray(col.offsets))
            values = np.asarray(col.values)
            for d in np.unique(lens):
                at = np.flatnonzero(lens == d)
                begin = np.asarray(col.offsets)[at]
                for lo in range(0, len(at), 4096):
                    part = at[lo:lo + 4096]
                    u = units(values[begin[lo:lo + 4096, None] + np.arange(d)])
                    s = np.abs(u).max(1) / 127
                    q = np.rint(u / s[:, None]).astype(np.int8)
                    e = np.sqrt(((u - q * s[:, None]) ** 2).sum(1))
                    sig = signed(u, bits, tables, seed)
                    yield pa.RecordBatch.from_arrays(
                        [batch.column("c").take(pa.array(part)), batch.column("f1").take(pa.array(part)), pa.array(np.full(len(part), d, np.int32)), pa.array([x.tobytes() for x in q], pa.binary()),
                         pa.array(s), pa.array(e), pa.array([x.tobytes() for x in sig], pa.binary())], names=["c", "f1", "d", "q", "s", "e", "sig"])

    return classes.select("c", "f1", "vec").mapInArrow(code, f"c {kind}, f1 bigint, d int, q binary, s double, e double, sig binary")


def _keyed(coded: DataFrame, tables: int) -> DataFrame:
    """One row for each class and table: `run` names the bucket, `met` holds its buckets in the tables before."""
    return coded.withColumn("t", F.explode(F.sequence(F.lit(0), F.lit(tables - 1)))).withColumn(
        "run", F.xxhash64("t", "d", F.substring("sig", F.col("t") * 4 + 1, F.lit(4)))).withColumn(
        "met", F.substring("sig", F.lit(1), F.col("t") * 4)).drop("sig")


def _grid(rows: DataFrame, piece: int) -> DataFrame:
    """Buckets of `m` rows are cut into blocks; every two blocks meet in one group (side tells them apart; -1: one block)."""
    parts = rows.withColumn("parts", F.ceil(F.col("m") / piece).cast("int")).withColumn(
        "part", F.pmod(F.xxhash64("f1", "run"), F.col("parts")).cast("int"))
    return parts.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1))).withColumn("lo", F.least("part", "other")).withColumn(
        "hi", F.greatest("part", "other")).withColumn("side", F.when(F.col("lo") == F.col("hi"), -1).when(F.col("part") == F.col("lo"), 0).otherwise(1)).drop("m", "parts", "part", "other")


def _binned(rows: DataFrame, n: int, per_bin: int = 20_000) -> DataFrame:
    bins = max(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), n // per_bin + 1)
    return rows.withColumn("bin", F.pmod(F.xxhash64("run", "lo", "hi"), F.lit(bins)))


def _tiles(side: np.ndarray):
    """Ranges (rows, columns) that cover each pair of the group once: a triangle, or one side against the other."""
    if side[0] < 0:
        cuts = [(a, min(a + TILE, len(side))) for a in range(0, len(side), TILE)]
        yield from ((x, y) for i, x in enumerate(cuts) for y in cuts[i:])
    else:
        n = int((side == 0).sum())
        yield from (((a, min(a + TILE, n)), (b, min(b + TILE, len(side)))) for a in range(0, n, TILE) for b in range(n, len(side), TILE))


def _new_pairs(near: np.ndarray, x: tuple, y: tuple, met: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of a tile that are near and share no bucket of an earlier table."""
    i, j = np.nonzero(near)
    i, j = i + x[0], j + y[0]
    if x == y:
        i, j = i[i < j], j[i < j]
    for t in range(met.shape[1]):
        if not len(i):
            break
        fresh = met[i, t] != met[j, t]
        i, j = i[fresh], j[fresh]
    return i, j


def _met(pdf) -> np.ndarray:
    width = len(pdf["met"].iat[0]) // 4
    return np.frombuffer(b"".join(pdf["met"]), ">u4").reshape(len(pdf), width)


def _by_group(pdf):
    for _, g in pdf.groupby(["run", "lo", "hi"], sort=False):
        if len(g) > 1:
            yield g.sort_values("side", kind="stable").reset_index(drop=True)


def _labels(i: np.ndarray, j: np.ndarray, n: int) -> np.ndarray:
    """Smallest position that each of `n` rows reaches over the pairs."""
    low = np.arange(n)
    while True:
        m = np.minimum(low[i], low[j])
        was = low.copy()
        np.minimum.at(low, i, m)
        np.minimum.at(low, j, m)
        low = low[low]
        if (low == was).all():
            return low


def promising_rows(pdf, cosine: float):
    """Rows of the bin with a partner that rounded vectors leave possible."""
    import pandas as pd

    parts = [pdf.iloc[:0]]
    for g in _by_group(pdf):
        q = np.frombuffer(b"".join(g["q"]), np.int8).reshape(len(g), -1).astype(np.float32)
        s, e, met, side = g["s"].to_numpy(np.float32), g["e"].to_numpy(np.float32), _met(g), g["side"].to_numpy()
        hit = np.zeros(len(g), bool)
        for x, y in _tiles(side):
            a, b = slice(*x), slice(*y)
            least = np.float32(cosine - 1e-5) - e[a, None] - (1 + e[a, None]) * e[None, b]
            i, j = _new_pairs((q[a] @ q[b].T) * (s[a, None] * s[None, b]) >= least, x, y, met)
            hit[i] = True
            hit[j] = True
        if hit.any():
            parts.append(g.loc[hit])
    return pd.concat(parts)[["run", "lo", "hi", "side", "c", "f1", "met"]]


def links_in(pdf, cosine: float):
    """u, v, f1, n. Where u = v: the class (u, f1) links with n vectors in this bin; else an edge that joins what links connect."""
    import pandas as pd

    out = [pdf.assign(u=pdf["c"], v=pdf["c"], n=np.int64(0))[["u", "v", "f1", "n"]].iloc[:0]]
    for g in _by_group(pdf):
        u, met, copies = units(g["vec"]), _met(g), g["copies"].to_numpy()
        total, low, here = np.zeros(len(g), np.int64), np.arange(len(g)), np.arange(len(g))
        for x, y in _tiles(g["side"].to_numpy()):
            i, j = _new_pairs(u[slice(*x)] @ u[slice(*y)].T >= cosine, x, y, met)
            if len(i):
                np.add.at(total, i, copies[j])
                np.add.at(total, j, copies[i])
                low = _labels(np.concatenate([here, i]), np.concatenate([low, j]), len(g))
        linked, moved = np.flatnonzero(total), np.flatnonzero(low != here)
        c, f1 = g["c"], g["f1"]
        out.append(pd.DataFrame({"u": c.iloc[linked], "v": c.iloc[linked], "f1": f1.iloc[linked], "n": total[linked]}))
        out.append(pd.DataFrame({"u": c.iloc[moved].to_numpy(), "v": c.iloc[low[moved]].to_numpy(), "f1": f1.iloc[moved].to_numpy(), "n": np.int64(0)}))
    return pd.concat(out, ignore_index=True)


def near_duplicates(vectors: DataFrame, cosine: float = COSINE, id_col: str = "vec_id", vec_col: str = "embedding", miss: float = MISS,
                    rows: int = ROWS, piece: int = PIECE, seed: int = 17) -> DataFrame:
    """vec_id, n_links, component_id, kept: one row for each row of `vectors`."""
    own = vectors.select(F.col(id_col).alias("vec_id"), F.col(vec_col).cast("array<double>").alias("vec"))
    own = own.withColumn("f1", F.xxhash64("vec")).withColumn("f2", F.xxhash64(F.lit(1), "vec")).withColumn("ok", usable("vec") & F.col("vec_id").isNotNull())
    kind = dict(own.dtypes)["vec_id"]
    once = own.filter("ok").groupBy("f1", "f2", "vec_id").agg(F.first("vec").alias("vec"))
    classes = shared(once.groupBy("f1", "f2").agg(F.min("vec_id").alias("c"), F.count(F.lit(1)).alias("copies"), F.first("vec").alias("vec")))
    n = classes.count()
    bits, tables = shape(n, cosine, miss, rows)
    coded = shared(_coded(classes, bits, tables, seed, kind))
    keyed = _keyed(coded, tables)
    runs = shared(keyed.groupBy("run").agg(F.count(F.lit(1)).alias("m")).filter("m > 1"))
    met = keyed.join(sized(runs), "run").select("run", "c", "f1", "m", "met", "q", "s", "e")
    likely = shared(_binned(_grid(met, piece), n * tables).groupBy("bin").applyInPandas(
        lambda pdf: promising_rows(pdf, cosine), f"run bigint, lo int, hi int, side int, c {kind}, f1 bigint, met binary"))
    exact = _binned(likely, likely.count(), 4_000).join(classes.select("c", "f1", "copies", "vec"), ["c", "f1"])
    out = shared(exact.groupBy("bin").applyInPandas(lambda pdf: links_in(pdf, cosine), f"u {kind}, v {kind}, f1 bigint, n bigint"))
    counts = out.filter("u = v").groupBy(F.col("u").alias("c"), "f1").agg(F.sum("n").alias("n"))
    comp = components(out.filter("u != v").select("u", "v"))
    whole = classes.drop("vec").join(counts, ["c", "f1"], "left").join(comp, F.col("c") == F.col("node"), "left").select(
        F.col("f1").alias("g1"), F.col("f2").alias("g2"), (F.coalesce("n", F.lit(0)) + F.col("copies") - 1).alias("n"), F.coalesce("component", "c").alias("component"))
    component = F.coalesce("component", "vec_id")
    return own.drop("vec").join(whole, F.col("ok") & (F.col("f1") == F.col("g1")) & (F.col("f2") == F.col("g2")), "left").select(
        "vec_id", F.coalesce("n", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"),
        F.coalesce(F.col("vec_id") == component, F.lit(True)).alias("kept"))
