"""Selection, classifiers and trial runs."""
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from raregrain.operators import ensembles as E
from raregrain.operators import select as K
from raregrain.plans import experiments as X
from raregrain.plans.grids import GRIDS
from raregrain.plans.registry import build, preset_names, split_sampled


def test_mutual_information_by_hand(spark):
    rows = [(0, 0)] * 3 + [(0, 1)] + [(1, 1)] * 3 + [(1, 0)]
    df = spark.createDataFrame(rows, "a int, b int")
    assert K.mutual_info(df, ["a"], "b").first()["mi"] == pytest.approx(0.188722, abs=1e-6)
    hist = {(r["a"], r["b"]): r["share"] for r in K.joint_histogram(df.selectExpr("a - 5 as a", "b * 1.0 as b"), "a", "b").collect()}
    assert hist[(0, 0)] == 0.375 and sum(hist.values()) == 1.0


def states(spark):
    rng = np.random.default_rng(2)
    y = rng.integers(0, 2, 400)
    a = np.where(rng.random(400) < 0.1, 1 - y, y)
    rows = [(int(t), int(v), int(v), int(rng.integers(0, 3)), int(np.where(rng.random() < 0.3, 1 - t, t))) for t, v in zip(y, a)]
    return spark.createDataFrame(rows, "target int, a int, twin int, noise int, weak int")


@pytest.mark.parametrize("method", ["MID", "MIQ", "FCQ"])
def test_first_pick_is_most_relevant_and_twin_is_avoided(spark, method):
    df = states(spark)
    cols = ["weak", "a", "twin", "noise"]
    picks = [r["feature"] for r in K.mrmr(df, cols, "target", method, 10).orderBy("place").collect()]
    assert picks[0] == "a" and sorted(picks) == sorted(cols)
    if method == "FCQ":
        pdf, f = df.toPandas(), K.anova_f(df, cols, "target")
        r = pdf[cols].corr().abs()["a"]
        assert picks[1] == max(("weak", "twin", "noise"), key=lambda c: f[c] / max(r[c], 0.001))
    else:
        assert picks[1] != "twin"
    sel = K.MrmrSelector(cols, "target", 2, method).fit(df)
    assert sel.transform(df).columns == [c for c in df.columns if c == "target" or c in picks[:2]]


def signal(spark, n=400):
    rng = np.random.default_rng(7)
    y = (rng.random(n) < 0.12).astype(int)
    x = rng.normal(size=(n, 3))
    x[:, 0] += 3 * y
    return spark.createDataFrame([(i, [float(v) for v in r], int(t), int(i % 40)) for i, (r, t) in enumerate(zip(x, y))], "key long, vec array<double>, target int, grp int")


SMALL = {"adaboost": {"n_estimators": 3}, "rusboost": {"n_estimators": 2}, "easy_ensemble": {"n_estimators": 2, "rounds": 2}, "balanced_random_forest": {"n_estimators": 3},
         "balanced_bagging": {"n_estimators": 2, "max_features": 2}, "imbalanced_ensemble_smote_bagging": {"n_estimators": 2}, "imbalanced_ensemble_balanced_cascade": {"n_estimators": 3},
         "imbalanced_ensemble_self_paced": {"n_estimators": 3}, "imbalanced_ensemble_overboost": {"n_estimators": 2}, "imbalanced_ensemble_smote_boost": {"n_estimators": 2},
         "imbalanced_ensemble_adacost": {"n_estimators": 2}, "imbalanced_ensemble_adauboost": {"n_estimators": 2}, "weighted_svc": {"max_iter": 10}, "weighted_random_forest": {"n_estimators": 3},
         "late_fusion": {"max_iter": 10}}


@pytest.mark.parametrize("name", sorted(SMALL))
def test_recall_on_planted_signal(spark, name):
    df = signal(spark)
    out = build(name, SMALL[name]).fit(df).score(df)
    rows = out.collect()
    pos = [r["prob"] for r in rows if r["target"]]
    neg = [r["prob"] for r in rows if not r["target"]]
    assert len(rows) == 400 and all(0 <= p <= 1 for p in pos + neg)
    wins = np.mean([(p > q) + 0.5 * (p == q) for p in pos for q in neg])
    assert wins > 0.8


def test_real_boosting_and_bad_algorithm(spark):
    df = signal(spark, 200)
    assert E.adaboost(df, 2, algorithm="SAMME.R").real
    with pytest.raises(ValueError):
        E.adaboost(df, 2, algorithm="X")


def test_boosting_factors():
    a = 0.7
    assert E._boost_factor(a, 1, True, 1, None, 2.0, 0.1) == pytest.approx(math.exp(a))
    assert E._boost_factor(a, 1, True, 1, "adacost", 2.0, 0.1) == pytest.approx(math.exp(a))
    assert E._boost_factor(a, 0, False, 1, "adacost", 2.0, 0.1) == pytest.approx(math.exp(-a * 0.45))
    assert E._boost_factor(a, 1, True, 1, "adauboost", 2.0, 0.1) == pytest.approx(2 * math.exp(a))


def test_registry_names():
    assert split_sampled("sampling_smote_xgboost") == ("smote", "boosted_trees")
    assert split_sampled("sampling_near_miss") == ("near_miss", "svc")
    assert split_sampled("sampling_combine_smote_enn_svc") == ("combine_smote_enn", "svc")
    with pytest.raises(ValueError):
        build("nothing")
    names = set(preset_names())
    assert {n for n in GRIDS} <= names and len(names) > 50


def test_sampled_pipeline_and_detector_presets(spark):
    df = signal(spark, 200)
    for name, params in (("sampling_near_miss_xgboost", {"n_estimators": 2}), ("pyod_hbos", {"model__alpha": 0.1})):
        rows = build(name, params).fit(df).score(df.limit(50)).collect()
        assert len(rows) == 50 and all(0 <= r["prob"] <= 1 for r in rows)


def folds(spark):
    from raregrain.operators.splits import group_folds
    df = signal(spark).select("key", "grp", "target", F.col("vec")[0].alias("a"), F.col("vec")[1].alias("b"))
    return X.prepared_folds(group_folds(df, "grp", "target", 2), "key", "target", ["a", "b"], k=2)


def test_trials_leaderboard_and_saved_models(spark, tmp_path):
    from raregrain.operators.learners import save_best_and_last
    fs = folds(spark)
    trials = X.expand_trials("random_forest", {"n_estimators": [1, 4], "max_depth": [2]})
    scores, board, best = X.run_trials(fs, trials)
    assert scores.count() == 2 * 2 * 7 and board.count() == 14
    top = best.first()["trial"]
    models = {i: t.fit(fs[0][0]) for i, t in enumerate(trials)}
    assert save_best_and_last(models, board, str(tmp_path / "m")) == top
    from pyspark.ml import PipelineModel
    assert PipelineModel.load(str(tmp_path / "m" / "best")).stages
    assert X.refit_best(fs[0][0], trials, best).score(fs[0][1]).count() == fs[0][1].count()


def test_failed_fold_scores_zero_when_asked(spark):
    class Broken:
        def fit(self, train):
            raise ValueError("resampling failed")
    fs = folds(spark)
    assert X.cross_score(Broken(), fs, on_error="zero") == ([0.0, 0.0], 0.0)
    with pytest.raises(ValueError):
        X.cross_score(Broken(), fs)


def test_entry_and_registration(spark):
    import __spark_entry__ as entry
    assert entry.entry(spark).count() == 14
    qs, sql = entry.queries(), entry.oracle_sql()
    assert set(sql) <= set(qs) and len(qs) > 130


def test_every_grid_parameter_is_one_of_its_builder():
    import inspect

    from raregrain.operators import ensembles, learners
    from raregrain.plans.registry import CLASSIFIERS, DETECTORS
    behind = {"weighted_svc": learners.svc, "weighted_random_forest": learners.random_forest,
              "imbalanced_ensemble_adacost": ensembles.adaboost, "imbalanced_ensemble_adauboost": ensembles.adaboost}
    for name, grid in GRIDS.items():
        build_with = behind.get(name) or CLASSIFIERS.get(name) or DETECTORS[name]
        known = inspect.signature(build_with).parameters
        if any(p.kind is p.VAR_KEYWORD for p in known.values()):
            continue  # handed on to a detector behind a neighbour search
        assert set(grid) - {"contamination"} <= set(known), name


def test_new_grid_points_run_and_unknown_ones_raise(spark):
    rows = [(i, [float((i * 7 + j) % 11) + (i % 5 == 0) * 6 for j in range(4)], int(i % 5 == 0)) for i in range(60)]
    df = spark.createDataFrame(rows, "key long, vec array<double>, target int")
    for name, point in (("easy_ensemble", {"n_estimators": 2, "rounds": 2, "max_features": 2}), ("boosted_trees", {"n_estimators": 2, "min_child_weight": 3}),
                        ("rusboost", {"n_estimators": 2, "sampling_strategy": "majority"}), ("isolation_forest", {"n_estimators": 3, "max_samples": "auto"}),
                        ("pyod_isolation_forest", {"n_estimators": 3, "max_samples": 0.5})):
        assert build(name, point).fit(df).score(df).count() == 60
    with pytest.raises(TypeError):
        build("rusboost", {"n_estimators": 2, "no_such": 1}).fit(df)
    with pytest.raises(ValueError):
        build("rusboost", {"n_estimators": 2, "sampling_strategy": "all"}).fit(df)
