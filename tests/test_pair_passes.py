"""Passes over pairs of blocks: city-block sums, the selector's slopes, whole descents."""
import numpy as np
import pytest
from pyspark.sql import functions as F

from raregrain.operators import neighbours as N
from raregrain.operators import outliers as O
from raregrain.operators import wknn
from raregrain.operators.wknn import WeightedKnnSelector


def frame(spark, points, y=None, keys=None):
    keys, y = range(len(points)) if keys is None else keys, [i % 2 for i in range(len(points))] if y is None else y
    return spark.createDataFrame([(int(k), [float(x) for x in p], int(t)) for k, p, t in zip(keys, points, y)], "key long, vec array<double>, target int")


def test_gradient_meets_blocks_once_and_leaves_one_number_per_feature(spark, monkeypatch):
    rng = np.random.default_rng(1)
    x, keys, w = rng.normal(size=(90, 3)), np.arange(90), np.array([0.5, 0.3, 0.0])
    keys[80:] = keys[:10]
    df = frame(spark, x, keys=keys)
    blocks, parts = N.pack(df, "key", "vec", "target", 2)
    assert parts > 3
    seen = []
    inner = wknn.stream_past
    monkeypatch.setattr(wknn, "stream_past", lambda *a, **k: seen.append(inner(*a, **k)) or seen[-1])
    sel = WeightedKnnSelector(2, kernel="exp", data_type="float64", scaling=False)
    err, g = sel.gradient(blocks, parts, df.select("key", F.col("target").cast("double").alias("y")), w)
    # rows of one key add up and do not meet
    y, apart = np.arange(90) % 2, keys[:, None] != keys[None]
    gaps = (x[:, None] - x[None]) ** 2
    d = np.sqrt(gaps @ w)
    s = np.exp(-d) * apart
    of = np.array([[k == j for j in keys] for k in keys]).astype(float)
    total = of @ s.sum(1)
    p = of @ (s @ y) / total
    h = of @ (2 * (p - y)) / total
    slope = np.where(apart, -s / (2 * np.where(apart, d, 1.0)), 0.0) * h[:, None] * (y[None] - p[:, None])
    assert err == pytest.approx(np.mean((p - y) ** 2), rel=1e-9)
    assert list(g) == pytest.approx(list(np.einsum("ij,ijf->f", slope, gaps) / 90), rel=1e-8)
    assert len(seen) == 2 and seen[1].columns == ["g"]
    assert all("l_part" in f._jdf.queryExecution().executedPlan().toString().split("CartesianProduct")[1].split("\n")[0] for f in seen)


def test_equal_rows_have_no_slope(spark):
    x, t = np.tile(np.random.default_rng(2).normal(size=(6, 2)), (2, 1)), np.array([0, 1, 1, 0, 1, 0, 1, 1, 0, 0, 1, 0])
    df, w = frame(spark, x, t), np.array([0.4, 0.2])
    sel = WeightedKnnSelector(2, kernel="exp", data_type="float64", scaling=False)
    blocks, parts = N.pack(df, "key", "vec", "target", 8)
    _, g = sel.gradient(blocks, parts, df.select("key", F.col("target").cast("double").alias("y")), w)
    gaps = (x[:, None] - x[None]) ** 2
    d = np.sqrt(gaps @ w)
    s = np.exp(-d) * (1 - np.eye(12))
    p = s @ t / s.sum(1)
    slope = np.where(d > 0, -s / (2 * np.where(d > 0, d, 1.0)), 0.0) * (2 * (p - t) / s.sum(1))[:, None] * (t[None] - p[:, None])
    assert list(g) == pytest.approx(list(np.einsum("ij,ijf->f", slope, gaps) / 12), rel=1e-6)


@pytest.mark.parametrize("left, right", [(1, 1), (5, 1100), (40, 1025)])
def test_city_block_sums_in_pieces_equal_direct_differences(left, right):
    rng = np.random.default_rng(right)
    a, b, w = 1e6 + rng.normal(size=(left, 7)), 1e6 + rng.normal(size=(right, 7)), np.array([1.0, 0.5, 0.0, 1.5, 2.0, -0.25, 1.0])
    b[0] = a[0]
    got, want = N.CityBlock(b, w).to(a), (np.abs(a[:, None] - b[None]) @ w)
    assert got.shape == want.shape and np.abs(got - np.maximum(want, 0)).max() < 1e-8
    assert not N.CityBlock(b, np.zeros(7)).to(a).any()


def test_city_block_pairs_use_pieces_unless_a_value_is_not_finite(spark, monkeypatch):
    points = np.random.default_rng(3).normal(size=(20, 2))
    sides = [N._right_of(points, points, 1.0, np.ones(2))]
    points[3, 1] = np.inf
    sides.append(N._right_of(points, points, 1.0, np.ones(2)))
    assert isinstance(sides[0], N.CityBlock) and sides[1] is None


def test_registered_selection_runs_every_round(spark, monkeypatch):
    from raregrain.catalog import models
    made = []

    class Seen(WeightedKnnSelector):
        def _descend(self, df, start, rounds):
            made.append(rounds)
            return start

    monkeypatch.setattr(models, "WeightedKnnSelector", Seen)
    monkeypatch.setattr(models, "vecs", lambda spark, sf: frame(spark, np.random.default_rng(4).normal(size=(8, 5))))
    rows = models.weighted_selection(spark, "").collect()
    assert made == [1000, 300] and len(rows) == 8 and {r["width"] for r in rows} == {4}


def test_rounds_in_one_task_equal_rounds_over_blocks(spark):
    rng = np.random.default_rng(5)
    df = frame(spark, rng.normal(size=(70, 3)))
    how = dict(kernel="exp", data_type="float64", n_iters=4, apply_weights=True, n_iters_weights=2, lambda0=0.0)
    one, many = (WeightedKnnSelector(2, rows_per_block=n, **how).fit(df) for n in (1024, 4))
    assert list(one.weights) == pytest.approx(list(many.weights), rel=1e-9) and one.error == pytest.approx(many.error, rel=1e-9)
    assert list(one.final_weights) == pytest.approx(list(many.final_weights), rel=1e-9) and one.weights.any()


def test_weights_that_all_vanish_leave_empty_vectors(spark):
    df = frame(spark, np.random.default_rng(6).normal(size=(30, 3)))
    fitted = WeightedKnnSelector(2, n_iters=60, n_iters_weights=2, kernel="exp", data_type="float64", lambda1=100.0, apply_weights=True).fit(df)
    assert not fitted.weights.any() and fitted.selected == fitted.final_selected == []
    assert [r["vec"] for r in fitted.transform(df).select("vec").collect()] == [[]] * 30


def test_sums_within_bars_count_for_rows_and_columns():
    rng = np.random.default_rng(7)
    d, left, right = rng.random((40, 300)), rng.normal(size=(40, 1, 2)), rng.normal(size=(300, 1, 2))
    # none, a few cells, many, all; out of order
    bars = [0.5, -1.0, 2.0, 0.001]
    rows, columns = O._within(d, bars, left, right)
    for k, bar in enumerate(bars):
        assert np.allclose(rows[:, k], (d <= bar) @ right[:, 0]) and np.allclose(columns[:, k], (d <= bar).T @ left[:, 0])


def test_squares_are_compared_as_their_roots():
    for x in (0.0, 1e-200, 0.1, 0.7, 1.4142135623730951, 3.0, 1e150, -1.0):
        z = O._square_of(x)
        assert z == -1.0 if x < 0 else np.sqrt(z) <= x < np.sqrt(np.nextafter(z, np.inf))


def test_integral_passes_meet_two_blocks_once(spark, monkeypatch):
    rng = np.random.default_rng(8)
    x, keys = rng.normal(size=(120, 3)), np.arange(120)
    keys[110:] = keys[:10]
    seen = []
    inner = O.stream_past
    monkeypatch.setattr(O, "stream_past", lambda *a, **k: seen.append(inner(*a, **k)) or seen[-1])
    got = {}
    for r in O.loci(frame(spark, x, keys=keys), rows_per_block=2).collect():
        got[r["key"]] = r["score"]
    assert len(seen) == 3 and all("l_part" in f._jdf.queryExecution().executedPlan().toString().split("CartesianProduct")[1].split("\n")[0] for f in seen)
    # as before, rows of one key are at 0 from each other and add up
    apart, of = keys[:, None] != keys[None], (keys[:, None] == keys[None]).astype(float)
    d = np.sqrt(((x[:, None] - x[None]) ** 2).sum(-1)) * apart
    mean, best = d.sum() / apart.sum(), np.full(120, -np.inf)
    for radius in mean * np.array([0.7, 0.8, 0.9, 1.0, 1.1, 1.2, 1.4]):
        n, hit = of @ (d <= 0.5 * radius).sum(1), (d <= radius).astype(float)
        c, s, q = (of @ (hit @ v) for v in (np.ones(120), n, n * n))
        spread = np.sqrt(np.maximum(q / c - (s / c) ** 2, 0))
        best = np.where((c >= 20) & (spread > 0), np.maximum(best, (s / c - n) / np.where(spread > 0, spread, 1)), best)
    assert len(got) == 110 and all(got[k] == pytest.approx(b if np.isfinite(b) else 0.0, abs=1e-9) for k, b in zip(keys, best))


@pytest.mark.parametrize("metric, p", [("euclidean", 2.0), ("cityblock", 1.0)])
def test_search_starts_from_bounds_of_the_own_block(spark, monkeypatch, metric, p):
    points = np.random.default_rng(9).normal(size=(160, 3)).round(1)
    seen = []
    inner = N.stream_past
    monkeypatch.setattr(N, "stream_past", lambda left, *a, **k: seen.append(left) or inner(left, *a, **k))
    got = {r["key"]: r["nn"] for r in N.knn(frame(spark, points), None, 3, metric=metric, p=p, rows_per_block=4, pivots=3).collect()}
    d = np.stack([N._exact(np.tile(x, (160, 1)), points, metric, p) for x in points])
    for i in range(160):
        assert [n["key"] for n in got[i]] == [j for _, j in sorted((d[i, j], j) for j in range(160) if j != i)[:3]]
    # a bound is no nearer than the fourth of the different rows, the row itself among them
    different = np.unique(points, axis=0)
    rows = [(x, b) for r in seen[0].collect() for x, b in zip(np.frombuffer(r["flat"]).reshape(-1, 3), r["bar"])]
    assert len(rows) == len(different) and sum(np.isfinite(b) for _, b in rows) > 100
    assert all(b >= np.sort(N._exact(np.tile(x, (len(different), 1)), different, metric, p))[3] for x, b in rows)
