"""Forests from counted bins against MLlib's on the rows."""
import numpy as np
import pytest
from pyspark.sql import functions as F

from raregrain.operators import binned_forest as B
from raregrain.operators import learners as L
from raregrain.session import cut_lineage


@pytest.fixture(scope="module")
def rows(spark):
    """6,000 rows, of which two features have few values and one has many."""
    df = spark.range(6000).select(F.col("id").alias("key"), F.array(F.floor(F.rand(1) * 9) / 4, F.floor(F.rand(2) * 5) - 2, F.floor(F.rand(3) * 20) * 1.5).alias("vec"))
    odds = F.col("vec")[0] * 0.3 + F.when(F.col("vec")[1] > 0, 0.4).otherwise(0) + F.col("vec")[2] / 100
    return cut_lineage(df.withColumn("target", (F.rand(4) < odds * 0.6).cast("int")))


@pytest.fixture
def counted(monkeypatch):
    monkeypatch.setattr(L, "MANY_DRAWS", 1)
    monkeypatch.setattr(L, "ROWS_PER_CELL", 1)


def probs(model, rows):
    got = model.score(rows).select("key", "prob").collect()
    return np.array([p for _, p in sorted((r["key"], r["prob"]) for r in got)])


@pytest.mark.parametrize("how", [{}, {"class_weight": "balanced"}, {"criterion": "entropy", "max_depth": 4}, {"max_depth": 50}])
def test_without_bootstrap_the_trees_are_those_of_the_rows(rows, how, counted, monkeypatch):
    """All features at every node and no draws: nothing is random, so the probabilities are the same."""
    how = {"n_estimators": 2, "max_features": None, "bootstrap": False, **how}
    now = L.random_forest(rows, **how)
    assert isinstance(now, B.BinnedForest)
    monkeypatch.setattr(L, "MANY_DRAWS", 10 ** 12)
    before = L.random_forest(rows, **how)
    assert isinstance(before, L.Fitted)
    a, b = probs(before, rows), probs(now, rows)
    assert len(b) == 6000 and np.abs(a - b).max() < 1e-9 and a.std() > 0.05


def test_bootstrap_agrees_with_the_rows_but_for_chance(rows, counted, monkeypatch):
    now = L.random_forest(rows, 40, 8)
    again = L.random_forest(rows, 40, 8)
    monkeypatch.setattr(L, "MANY_DRAWS", 10 ** 12)
    before, other = L.random_forest(rows, 40, 8), L.random_forest(rows, 40, 8, seed=7)
    a, b, c = probs(before, rows), probs(now, rows), probs(other, rows)
    assert (b == probs(again, rows)).all()
    # no further from MLlib's forest than another seed of it
    assert np.abs(a - b).mean() < 1.3 * np.abs(a - c).mean() and np.corrcoef(a, b)[0, 1] > 0.97


def test_draws_of_a_cell_are_those_of_its_rows(spark):
    cells = spark.range(300).select(F.array(F.col("id").cast("int")).alias("bins"), F.lit(1).alias("target"), (F.col("id") % 3 * 50).alias("n"))
    got = B.draws(cells, 200, 5).collect()
    for n in (0, 50, 100):
        x = np.array([r["drawn"] for r in got if r["n"] == n], dtype=float)
        assert abs(x.mean() - n) < 0.3 and abs(x.var() - n) < 0.05 * n + 1e-9
    assert abs(np.corrcoef(np.array([r["drawn"] for r in got if r["n"] == 50]).T[:2])[0, 1]) < 0.35


def test_many_rows_have_few_cells_and_unseen_bins_get_a_score(rows, spark, counted):
    """The fit's table does not grow with the rows, and rows whose bins were not there at the fit are scored."""
    found = B.binning(rows)
    twice = rows.unionByName(rows)
    assert found.cells(rows, "vec", None).count() == found.cells(twice, "vec", None).count() <= 2 * 9 * 5 * 20
    model = L.random_forest(rows.filter("vec[0] < 1 or vec[1] < 0"), 3, 5)
    assert isinstance(model, B.BinnedForest)
    new = rows.unionByName(spark.createDataFrame([(-1, [99.0, 99.0, -5.0], 1)], rows.schema))
    got = model.score(new, "p")
    assert got.columns == [*rows.columns, "p"] and got.count() == 6001 and got.filter("p is null or p < 0 or p > 1").count() == 0
    # as MLlib does, nulls stop the scoring
    with pytest.raises(Exception, match="a feature is null"):
        model.score(spark.createDataFrame([(-1, [1.0, None, 1.0], 1)], rows.schema), "p").collect()


def test_thresholds(spark):
    assert B.split_points([1.0, 1.0, 2.0, 4.0]) == [1.5, 3.0] and B.split_points([3.0, 3.0]) == []
    many = B.split_points([float(x) for x in range(1025)])
    assert len(many) == 33 and many[:3] == [8.0, 32.0, 64.0] and many[-2:] == [992.0, 1016.0]


@pytest.mark.parametrize("bad", ["array(double('nan'), 1d, 1d)", "array(null, 1d, 1d)", "array(1d, 1d)", "cast(null as array<double>)"])
def test_odd_values_go_to_mllib_itself(rows, bad):
    assert B.binning(rows.withColumn("vec", F.when(F.col("key") == 5, F.expr(bad)).otherwise(F.col("vec")))) is None


def test_other_forests_stay_with_the_rows(rows, counted):
    wide = rows.withColumn("vec", F.array_repeat(F.col("vec")[0], 20))
    assert isinstance(L.random_forest(wide, 2, 2), L.Fitted)
    assert isinstance(L.random_forest(rows, 2, 2, min_rows=5), L.Fitted)
    assert isinstance(L.random_forest(rows, 1, 2), L.Fitted)


def test_rows_are_spread_over_the_tasks(rows, counted, spark):
    """MLlib's passes over many rows run in as many tasks as there are cores, however few files the rows come from."""
    seen = []

    class Seen:
        def __init__(self, **kw): pass
        def setFeaturesCol(self, x): return self
        def setLabelCol(self, x): return self
        def fit(self, df): seen.append(df.rdd.getNumPartitions())

    from unittest import mock
    with mock.patch.object(L, "RandomForestClassifier", Seen):
        L.random_forest(rows.coalesce(1), 2, 2, min_rows=5)
    assert seen == [spark.sparkContext.defaultParallelism]
