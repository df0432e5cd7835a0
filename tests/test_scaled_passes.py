"""Neighbour searches over blocks of bytes: exact results from single-precision bounds."""
import numpy as np
import pytest

from raregrain.operators import neighbours as N


def frame(spark, points):
    return spark.createDataFrame([(i, [float(x) for x in p]) for i, p in enumerate(points)], "key long, vec array<double>")


def test_search_far_from_the_origin_is_exact_in_blocks_of_bytes(spark, monkeypatch):
    rng = np.random.default_rng(2)
    points = np.vstack([1e6 + rng.normal(size=(150, 5)), rng.normal(size=(100, 5)) * 1e-6, [[0.0] * 5, [1e9] * 5]])
    seen = []
    inner = N.stream_past
    monkeypatch.setattr(N, "stream_past", lambda left, right, *a, **k: seen.append(dict(left.dtypes)["flat"]) or inner(left, right, *a, **k))
    got = {r["key"]: [n["key"] for n in r["nn"]] for r in N.knn(frame(spark, points), None, 4, rows_per_block=8, pivots=3).collect()}
    assert seen == ["binary"]
    for i, p in enumerate(points):
        d = N._exact(np.tile(p, (len(points), 1)), points, "euclidean", 2.0)
        assert got[i] == sorted((j for j in range(len(points)) if j != i), key=lambda j: (d[j], j))[:4]


def test_single_precision_bounds_never_exceed_the_distances():
    rng = np.random.default_rng(3)
    for size in (1e-120, 1e-3, 1.0, 1e30, 1e120):
        a, b = rng.normal(size=(40, 64)) * size, rng.normal(size=(30, 64)) * size
        b[:10] = a[:10]
        left, right, scale = N._lower_bounds(a, b)
        exact = ((a[:, None] - b[None]) ** 2).sum(-1) / scale
        low = left @ right
        assert (low <= exact + 1e-30).all() and (exact - low < 1e-4).all()
