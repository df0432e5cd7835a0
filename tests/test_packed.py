"""Packed ensembles against the same members scored one after the other."""
import numpy as np
import pytest
from pyspark.sql import functions as F

from raregrain.operators import ensembles as E
from raregrain.operators import learners as L
from raregrain.operators.packed import pack
from raregrain.session import cut_lineage


@pytest.fixture(scope="module")
def rows(spark):
    df = spark.range(1500).select(F.col("id").alias("key"), F.array(*[F.rand(i) for i in range(6)]).alias("vec"))
    return cut_lineage(df.withColumn("target", (F.col("vec")[0] + F.col("vec")[1] * F.col("vec")[2] > 1.25).cast("int")))


def same(model, rows):
    packed, chained = (dict(f(rows).select("key", "prob").collect()) for f in (model.score, model.chained))
    assert pack(model.groups()) is not None and len(packed) == rows.count()
    assert max(abs(packed[k] - chained[k]) for k in chained) < 1e-9
    return packed


@pytest.mark.parametrize("fit", [
    lambda d: E.adaboost(d, 6, depth=2), lambda d: E.adaboost(d, 4, algorithm="SAMME.R", learning_rate=0.5, depth=2),
    lambda d: E.balanced_random_forest(d, 5, 4), lambda d: E.easy_ensemble(d, 3, 3, max_features=4), lambda d: E.balance_cascade(d, 3, 4),
    lambda d: E.self_paced_ensemble(d, 3, 4), lambda d: L.Voted([L.random_forest(d, 4, 3), L.boosted_trees(d, 3), L.Voted([L.tree(d, 3), L.tree(d, 2)])])])
def test_equal_to_chained_members(rows, fit):
    model = fit(rows)
    scores = same(model, rows)
    labels = dict(rows.select("key", "target").collect())
    up = np.mean([scores[k] for k, t in labels.items() if t])
    assert up > np.mean([scores[k] for k, t in labels.items() if not t]) + 0.1


def test_two_hundred_members_in_one_stage(spark, rows):
    """The plan does not grow with the members."""
    few = [L.tree(rows, 3, seed=i) for i in range(2)]
    model = L.Voted(few * 100)
    plan = model.score(rows)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("ArrowEvalPython") == 1 and len(plan) < 4000
    small, big = (dict(m.score(rows).select("key", "prob").collect()) for m in (L.Voted(few), model))
    assert max(abs(small[k] - big[k]) for k in big) < 1e-9


def test_other_members_are_chained(rows):
    model = L.Voted([L.tree(rows, 3), L.late_fusion(rows, max_iter=3)])
    assert model.groups() is None
    assert model.score(rows).select("prob").agg(F.max("prob")).first()[0] <= 1


def test_too_many_nodes_are_chained(rows, monkeypatch):
    from raregrain.operators import packed
    monkeypatch.setattr(packed, "MOST_NODES", 3)
    model = L.Voted([L.tree(rows, 3), L.tree(rows, 2)])
    assert pack(model.groups()) is None and model.score(rows).count() == 1500
