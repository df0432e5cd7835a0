"""Stages inside a pipeline, saved and loaded; the evaluator inside a search."""
import numpy as np
import pytest
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.tuning import ParamGridBuilder, TrainValidationSplit
from pyspark.sql import functions as F

from raregrain.operators import metrics as M
from raregrain.operators.select import mrmr
from raregrain.operators.stages import MrmrStage, PartialAucEvaluator, WeightedKnnStage
from raregrain.operators.wknn import WeightedKnnSelector


def table(spark, n=120):
    rng = np.random.default_rng(5)
    y = (rng.random(n) < 0.3).astype(int)
    rows = [(i, int(y[i]), int(y[i] * 2 + rng.integers(0, 2)), int(rng.integers(0, 4)), int(y[i] + rng.integers(0, 3)),
             [float(y[i] * 2 + rng.normal()), float(rng.normal()), float(rng.normal())]) for i in range(n)]
    return spark.createDataFrame(rows, "key bigint, target int, a int, b int, c int, vec array<double>")


def same(a, b):
    assert a.columns == b.columns
    assert sorted(map(str, a.collect())) == sorted(map(str, b.collect()))


@pytest.mark.parametrize("pool", [0, 2])
def test_mrmr_stage_keeps_what_mrmr_picks(spark, tmp_path, pool):
    df = table(spark)
    pipe = Pipeline(stages=[MrmrStage(inputCols=["a", "b", "c"], numFeatures=2, mode="MID", pool=pool)])
    pipe.write().overwrite().save(str(tmp_path / "p"))
    model = Pipeline.load(str(tmp_path / "p")).fit(df)
    want = {r["feature"] for r in mrmr(df, ["a", "b", "c"], "target", "MID", 2, pool or None).collect()}
    out = model.transform(df)
    assert out.columns == [c for c in df.columns if c not in "abc" or c in want]
    model.write().overwrite().save(str(tmp_path / "m"))
    same(PipelineModel.load(str(tmp_path / "m")).transform(df), out)


def test_weighted_knn_stage_equals_the_selector(spark, tmp_path):
    df, how = table(spark), {"n_iters": 2, "n_iters_weights": 1, "kernel": "exp", "data_type": "float64", "apply_weights": True}
    model = Pipeline(stages=[WeightedKnnStage(maxFeatures=2, settings=how)]).fit(df)
    plain = WeightedKnnSelector(2, **how).fit(df).transform(df)
    got = {r["key"]: r["selected"] for r in model.transform(df).collect()}
    for r in plain.collect():
        assert got[r["key"]] == pytest.approx(r["vec"], abs=1e-9)
    model.write().overwrite().save(str(tmp_path / "m"))
    same(PipelineModel.load(str(tmp_path / "m")).transform(df), model.transform(df))


def test_evaluator_reads_scores_and_probability_vectors(spark, tmp_path):
    df = VectorAssembler(inputCols=["a", "b", "c"], outputCol="features").transform(table(spark))
    scored = LogisticRegression(labelCol="target").fit(df).transform(df)
    flat = scored.select("target", F.udf(lambda v: float(v[1]), "double")("probability").alias("score"))
    want = M.pauc(flat, []).first()["pauc_score"]
    assert PartialAucEvaluator().evaluate(scored) == pytest.approx(want) and want > 0
    assert PartialAucEvaluator(scoreCol="score").evaluate(flat.unionByName(spark.createDataFrame([(None, 0.5), (1, None)], "target int, score double"))) == pytest.approx(want)
    PartialAucEvaluator(minTpr=0.5).write().overwrite().save(str(tmp_path / "e"))
    assert PartialAucEvaluator.load(str(tmp_path / "e")).evaluate(scored) == pytest.approx(M.pauc(flat, [], 0.5).first()["pauc_score"])
    assert PartialAucEvaluator(scoreCol="score").evaluate(flat.filter("target = 0")) == 0.0
    assert PartialAucEvaluator(scoreCol="score").evaluate(flat.filter("false")) == 0.0


def test_evaluator_chooses_in_a_search(spark):
    df = VectorAssembler(inputCols=["a", "b", "c"], outputCol="features").transform(table(spark))
    lr = LogisticRegression(labelCol="target")
    grid = ParamGridBuilder().addGrid(lr.elasticNetParam, [1.0]).addGrid(lr.regParam, [0.01, 50.0]).build()
    found = TrainValidationSplit(estimator=lr, estimatorParamMaps=grid, evaluator=PartialAucEvaluator(labelCol="target"), seed=1).fit(df)
    assert found.validationMetrics[0] > found.validationMetrics[1]
