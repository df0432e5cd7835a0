"""Searches whose parts are kept: stopped ones go on, changed ones are scored afresh."""
from dataclasses import dataclass

import pytest
from pyspark.sql import functions as F

from raregrain.plans import experiments as X
from raregrain.plans.registry import Builder

FITS = []


@dataclass
class Scaled(Builder):
    """Scores by the first component times a factor; notes every fit, and fails where it is told to."""

    fails: bool = False

    def fit(self, train):
        if self.fails:
            raise ValueError("stopped")
        FITS.append(self.params["by"])
        return self

    def score(self, df, name="prob"):
        return df.withColumn(name, F.col("vec")[0] * self.params["by"])


def trials(*factors, fails=()):
    return [Scaled("scaled", {"by": by}, fails=by in fails) for by in factors]


def folds(spark, bump=0.0):
    rows = spark.createDataFrame([(i, [i / 40 + bump], int(i % 4 == 0)) for i in range(40)], "key bigint, vec array<double>, target int").coalesce(1)
    return [(rows.filter(F.col("key") % 2 != f), rows.filter(F.col("key") % 2 == f)) for f in (0, 1)]


def rows_of(df):
    return sorted(map(tuple, df.collect()))


@pytest.fixture(autouse=True)
def no_fits():
    FITS.clear()


def test_a_stopped_search_goes_on(spark, tmp_path):
    fs, store = folds(spark), str(tmp_path / "s")
    with pytest.raises(ValueError, match="stopped"):
        X.score_trials(fs, trials(0.5, 1.0, 2.0, fails=[2.0]), store=store, threads=1)
    assert sorted(FITS) == [0.5, 0.5, 1.0, 1.0]
    FITS.clear()
    got = X.score_trials(fs, trials(0.5, 1.0, 2.0), store=store)
    assert FITS == [2.0, 2.0]
    assert rows_of(got) == rows_of(X.score_trials(fs, trials(0.5, 1.0, 2.0))) and got.count() == 3 * 40


def test_rows_written_without_a_mark_are_scored_again(spark, tmp_path):
    fs, store = folds(spark), str(tmp_path / "s")
    name = X.part_names(fs, trials(0.5), 0.5)[0, 0]
    spark.createDataFrame([(1, 1, 9.0, 1)], "key bigint, target int, score double, pred int").write.parquet(f"{store}/parts/part={name}")
    assert rows_of(X.score_trials(fs, trials(0.5), store=store)) == rows_of(X.score_trials(fs, trials(0.5)))


def test_grids_may_grow_shrink_and_repeat_trials(spark, tmp_path):
    fs, store = folds(spark), str(tmp_path / "s")
    X.score_trials(fs, trials(1.0, 2.0), store=store)
    FITS.clear()
    got = X.score_trials(fs, trials(3.0, 2.0, 3.0), store=store)
    assert sorted(FITS) == [3.0, 3.0]
    assert rows_of(got) == rows_of(X.score_trials(fs, trials(3.0, 2.0, 3.0)))


def test_other_rows_or_thresholds_are_not_taken_from_the_store(spark, tmp_path):
    store = str(tmp_path / "s")
    X.score_trials(folds(spark), trials(1.0), store=store)
    FITS.clear()
    other = folds(spark, 0.25)
    assert rows_of(X.score_trials(other, trials(1.0), store=store)) == rows_of(X.score_trials(other, trials(1.0)))
    assert rows_of(X.score_trials(other, trials(1.0), 0.9, store=store)) == rows_of(X.score_trials(other, trials(1.0), 0.9))
    assert len(FITS) == 8


def test_two_hundred_parts_are_one_scan(spark, tmp_path):
    got = X.score_trials(folds(spark), trials(*range(100)), threads=8)
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Relation [") == 1 and "Union" not in plan
    assert got.groupBy("trial", "fold").count().count() == 200
