"""Neighbour search against brute force, resampling invariants."""
import numpy as np
import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from raregrain.operators import neighbours as N
from raregrain.operators import outliers as O
from raregrain.operators import resample as R


def frame(spark, points, labels=None):
    labels = labels if labels is not None else [0] * len(points)
    return spark.createDataFrame([(i, [float(x) for x in np.atleast_1d(p)], int(t)) for i, (p, t) in enumerate(zip(points, labels))],
                                 "key long, vec array<double>, target int")


def brute(points, k, metric, p):
    x = np.array([np.atleast_1d(q) for q in points], dtype=float)
    d = N._exact(np.repeat(x, len(x), 0), np.tile(x, (len(x), 1)), metric, p).reshape(len(x), -1)
    return {i: sorted((d[i, j], j) for j in range(len(x)) if j != i)[:k] for i in range(len(x))}


@settings(max_examples=6, deadline=None, suppress_health_check=list(HealthCheck))
@given(st.lists(st.tuples(st.integers(0, 4), st.integers(0, 4)), min_size=2, max_size=40), st.sampled_from([("euclidean", 2.0), ("cityblock", 1.0), ("minkowski", 3.0)]))
def test_knn_equals_brute_force_with_copies_and_ties(spark, points, kind):
    got = N.knn(frame(spark, points), None, 3, metric=kind[0], p=kind[1], rows_per_block=4, pivots=5).collect()
    want = brute(points, 3, *kind)
    assert len(got) == len(points)
    for r in got:
        assert [n["key"] for n in r["nn"]] == [j for _, j in want[r["key"]]]
        assert [n["distance"] for n in r["nn"]] == pytest.approx([d for d, _ in want[r["key"]]], abs=1e-9)


def test_knn_hot_copies_and_pruned_blocks(spark):
    """A third of the rows are one vector; clusters far apart let cells be skipped."""
    rng = np.random.default_rng(1)
    points = np.vstack([np.zeros((60, 3)), rng.normal(0, 1, (60, 3)) + 50, rng.normal(0, 1, (60, 3)) - 50])
    got = N.knn(frame(spark, points), None, 4, rows_per_block=16, pivots=8).collect()
    want = brute(points, 4, "euclidean", 2.0)
    for r in got:
        assert [n["key"] for n in r["nn"]] == [j for _, j in want[r["key"]]]


def test_pair_sums_by_hand(spark):
    from raregrain.operators.wknn import loo_predictions, mean_errors
    pred = loo_predictions(frame(spark, [0, 1, 3], [0, 1, 1]), "key", "vec", "target", [1.0], rows_per_block=2)
    assert [r["prediction"] for r in pred.orderBy("key").collect()] == pytest.approx([1, 0.268941, 0.731059], abs=1e-6)
    assert mean_errors(pred).first()["mse"] == pytest.approx(0.535592, abs=1e-6)


@pytest.mark.parametrize("metric,p,kernel,error", [("euclidean", None, "rbf", "mse"), ("euclidean", None, "exp", "ce"), ("minkowski", 3.0, "exp", "huber"), ("cityblock", None, "rbf", "mae")])
def test_weight_gradient_matches_finite_differences(spark, metric, p, kernel, error):
    from raregrain.operators.wknn import WeightedKnnSelector
    rng = np.random.default_rng(3)
    df = frame(spark, rng.normal(size=(20, 3)), rng.integers(0, 2, 20))
    sel = WeightedKnnSelector(2, metric=metric, p=p, kernel=kernel, error_type=error, delta=0.3, data_type="float64", scaling=False)
    blocks, parts = N.pack(df, "key", "vec", "target", 8)
    y = df.select("key", F.col("target").cast("double").alias("y"))
    w = np.array([0.5, 0.3, 0.2])
    _, g = sel.gradient(blocks, parts, y, w)
    step = np.array([1e-5, 0, 0])
    slope = (sel.gradient(blocks, parts, y, w + step)[0] - sel.gradient(blocks, parts, y, w - step)[0]) / 2e-5
    assert g[0] == pytest.approx(slope, rel=1e-3, abs=1e-7)


def test_weighted_selection_finds_the_signal(spark):
    from raregrain.operators.wknn import Stepper, WeightedKnnSelector, scaled_gradient
    rng = np.random.default_rng(0)
    y = rng.integers(0, 2, 60)
    x = rng.normal(size=(60, 4))
    x[:, 2] = y * 3 + rng.normal(0, 0.2, 60)
    sel = WeightedKnnSelector(1, n_iters=6, kernel="exp", data_type="float64").fit(frame(spark, x, y))
    assert sel.selected == [2] and sel.transform(frame(spark, x, y)).first()["vec"].__len__() == 1
    for rule in ("SGD", "Momentum", "Adam", "Nadam", "Adagrad", "Adadelta", "RMSProp"):
        s, w = Stepper(rule, 0.1), np.array([1.0])
        for _ in range(20):
            w = s.step(w, 2 * w)
        assert abs(w[0]) < 1.0, rule
    assert np.abs(scaled_gradient(np.array([1e-6, 0.0]), np.array([1.0, 1.0]), 0.1)).max() <= 1e-4 + 1e-12
    with pytest.raises(ValueError):
        WeightedKnnSelector(1, optimizer="Adam")


def imbalanced(spark, n=120, pos=15, dims=3, seed=0):
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(n, dims))
    y = np.zeros(n, dtype=int)
    y[:pos] = 1
    x[:pos] += 1.0
    return frame(spark, x, y), x, y


def counts(df):
    return {r["target"]: r["count"] for r in df.groupBy("target").count().collect()}


def test_random_sampling_by_hand(spark):
    df = spark.createDataFrame([(i, int(i < 2)) for i in range(10)], "key long, target int")
    over = R.random_over(df, "key", "target", 0.5)
    assert counts(over) == {0: 8, 1: 4}
    keyed = over.select((F.col("key") * 100 + F.col("copy")).alias("key"), "target")
    assert counts(R.random_under(keyed, "key", "target", 0.8)) == {0: 5, 1: 4}
    assert counts(R.epoch_rebalance(df, "key", "target", 3, 0.5)) == {0: 4, 1: 6}
    with pytest.raises(ValueError):
        R.random_over(df, "key", "target", 0.1)


def between(p, a, b):
    t = np.dot(p - a, b - a) / max(np.dot(b - a, b - a), 1e-300)
    return -1e-9 <= t <= 1 + 1e-9 and np.allclose(a + t * (b - a), p, atol=1e-9)


@pytest.mark.parametrize("name", ["smote", "adasyn", "borderline_smote"])
def test_synthetic_rows_lie_between_minority_rows(spark, name):
    df, x, y = imbalanced(spark)
    out = getattr(R, name)(df, "key", "vec", "target", 4)
    rows = out.collect()
    assert {r["key"] for r in rows if not r["synthetic"]} == set(range(120))
    assert len({r["key"] for r in rows}) == len(rows)
    made = [r for r in rows if r["synthetic"]]
    if name != "adasyn":
        assert counts(out) == {0: 105, 1: 105}
    assert made
    minority = x[y == 1]
    for r in made[:20]:
        p = np.array(r["vec"])
        assert r["target"] == 1 and any(between(p, a, b) for a in minority for b in minority)


def test_kmeans_smote_and_centroids_sizes(spark):
    df, x, y = imbalanced(spark, pos=30)
    assert counts(R.kmeans_smote(df, "key", "vec", "target", 3, 2, 0.01)) == {0: 90, 1: 90}
    one = R.cluster_centroids(df, "key", "vec", "target")
    assert counts(one) == {0: 30, 1: 30} and len({r["key"] for r in one.collect()}) == 60
    again = R.cluster_centroids(df.repartition(7), "key", "vec", "target")
    centres = lambda d: sorted([round(v, 9) for v in r["vec"]] for r in d.filter("synthetic").collect())
    assert centres(one) == centres(again)


def test_centroids_are_the_means_of_their_rows(spark):
    """A line of evenly spaced rows, on which three centres take seven rounds to settle."""
    x = np.arange(16.0)
    df = frame(spark, np.r_[x, [-50.0] * 3], [0] * len(x) + [1] * 3)
    got = np.array([r["vec"][0] for r in R.cluster_centroids(df, "key", "vec", "target").filter("synthetic").orderBy("key").collect()])
    own = np.abs(x[:, None] - got[None, :]).argmin(axis=1)
    assert len(got) == 3
    assert [x[own == i].mean() for i in range(3)] == pytest.approx(got.tolist(), abs=1e-9)


def test_categorical_smote_uses_known_values(spark):
    rows = [(i, "ab"[i % 2], "xyz"[i % 3], int(i < 8)) for i in range(40)]
    df = spark.createDataFrame(rows, "key long, c string, d string, target int")
    out = R.smoten(df, "key", ["c", "d"], "target", 3)
    assert counts(out) == {0: 32, 1: 32}
    assert {(r["c"], r["d"]) for r in out.filter("synthetic").collect()} <= {(a, b) for a in "ab" for b in "xyz"}


def test_tomek_by_hand(spark):
    df = frame(spark, [0, 1, 1.2, 5], [0, 0, 1, 1])
    links = R.tomek_links(df, "key", "vec", "target").collect()
    assert {(r["a"], r["b"]) for r in links} == {(1, 2), (2, 1)}
    assert {r["key"] for r in R.tomek(df, "key", "vec", "target").collect()} == {0, 2, 3}
    assert {r["key"] for r in R.tomek(df, "key", "vec", "target", both=True).collect()} == {0, 3}


def test_cleaned_combinations_are_subsets(spark):
    df, _, _ = imbalanced(spark, n=60, pos=12)
    full = {r["key"] for r in R.smote(df, "key", "vec", "target", 4).collect()}
    for f in (R.smote_tomek, R.smote_enn):
        assert {r["key"] for r in f(df, "key", "vec", "target", 4).collect()} <= full


def test_balanced_bootstrap_sizes(spark):
    df = spark.createDataFrame([(i, int(i < 5)) for i in range(50)], "key long, target int")
    for strategy, want in (("majority", {0: 5, 1: 5}), ("not majority", {0: 45, 1: 5}), ("all", {0: 5, 1: 5})):
        out = R.balanced_bootstrap(df, "key", "target", 3, strategy)
        for m in range(3):
            assert counts(out.filter(F.col("member") == m)) == want
    with pytest.raises(ValueError):
        R.balanced_bootstrap(df, "key", "target", 3, "some")


def test_hardness_samplers_keep_the_minority(spark):
    df = spark.createDataFrame([(i, int(i < 10), (i % 20) / 20) for i in range(110)], "key long, target int, p double")
    paced = R.self_paced_under(df, "key", "target", "p", 1, 4)
    assert counts(paced)[1] == 10 and 7 <= counts(paced)[0] <= 13
    kept = R.cascade_keep(df, "key", "target", "p", 0.1, 3)
    assert counts(kept) == {0: 32, 1: 10}
    assert min(r["p"] for r in kept.filter("target = 0").collect()) >= 0.6


def planted(spark):
    rng = np.random.default_rng(5)
    x = rng.normal(size=(150, 4)) * [1.0, 2.0, 0.5, 1.5]
    x[0] = [12.0, -14.0, 9.0, 13.0]
    return frame(spark, x)


def near(df, vec=False):
    return O.neighbour_lists(df, "key", "vec", 10, vec)


@pytest.mark.parametrize("name", ["hbos", "copod", "loda", "pca_score", "mcd", "cblof", "loci", "lmdd", "isolation_forest", "knn", "lof", "cof", "sod", "sos", "feature_bagging"])
def test_detectors_rank_the_planted_row_high(spark, name):
    df = planted(spark)
    run = {"knn": lambda: O.knn_distance(near(df)), "lof": lambda: O.lof(near(df)), "cof": lambda: O.cof(near(df, True)), "sod": lambda: O.sod(df, near(df)),
           "sos": lambda: O.sos(df), "isolation_forest": lambda: O.isolation_forest(df, n_estimators=20), "lmdd": lambda: O.lmdd(df, n_iter=5),
           "cblof": lambda: O.cblof(df, n_clusters=3), "loci": lambda: O.loci(df, radii=[3.0, 6.0, 30.0], rows_per_block=40),
           "feature_bagging": lambda: O.feature_bagging(df, n_estimators=2), "loda": lambda: O.loda(df, cuts=30)}.get(name, lambda: getattr(O, name)(df))
    rows = run().orderBy(F.col("score").desc(), "key").collect()
    assert len(rows) == 150 and all(r["score"] == r["score"] for r in rows)
    assert 0 in [r["key"] for r in rows[:8]]


def test_robust_covariance_steps_until_the_determinant_stays(spark):
    """Two fifths of the rows are another group; ten steps are needed from all rows' covariance."""
    rng = np.random.default_rng(4)
    x = np.r_[rng.normal(size=(120, 3)), rng.normal(size=(80, 3)) * 1.5 + 2.5]
    got = np.array([r["score"] for r in O.mcd(frame(spark, x)).orderBy("key").collect()])
    kept = x[got <= np.sort(got)[101]]
    d = x - kept.mean(axis=0)
    assert ((d @ np.linalg.pinv(np.cov(kept.T, bias=True))) * d).sum(axis=1) == pytest.approx(got, abs=1e-6)


@pytest.mark.parametrize("query,operator", [("loda", "loda"), ("isolation_forest", "isolation_forest"), ("feature_bagging", "feature_bagging")])
def test_detector_queries_use_the_operators_defaults(monkeypatch, query, operator):
    from raregrain.catalog import anomalies as A
    asked = []
    monkeypatch.setattr(A, "vecs", lambda spark, sf: "rows")
    monkeypatch.setattr(A, "out", lambda scores: scores)
    monkeypatch.setattr(A.O, operator, lambda df, **how: asked.append(how))
    getattr(A, query)(None, "")
    assert asked == [{}]


def test_isolation_path_constant():
    assert O.average_path(2) == 1.0 and O.average_path(256) == pytest.approx(10.2448, abs=1e-3)
