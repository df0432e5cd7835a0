"""Classifiers, ensembles, searches: fitted on the given tables, scores or metrics as rows."""
from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from raregrain.catalog.fixtures import CASES, PAIRS, VECS, cases, query, r6, table, vecs
from raregrain.functions import columns as C
from raregrain.operators import learners as L
from raregrain.operators import metrics as M
from raregrain.operators import trials as T
from raregrain.operators.neighbours import pack
from raregrain.operators.newton import first_cuts
from raregrain.operators.prep import fit_prep
from raregrain.operators.splits import group_folds
from raregrain.operators.wknn import WeightedKnnSelector
from raregrain.plans import experiments as X
from raregrain.plans.registry import build
from raregrain.session import cut_lineage

NUM = ["value", "k", "hr"]


def prepared(spark, sf):
    """All cases with scaled features."""
    c = cases(spark, sf)
    rows = fit_prep(c, NUM).transform(c)
    return cut_lineage(rows.select(F.col("event_id").alias("key"), F.col("features").alias("vec"), "target"))


def summary(scored):
    """Confusion counts, label metrics and partial AUC of one fitted model over all rows."""
    rows = cut_lineage(scored.select(F.lit(0).alias("fold"), "key", "target", F.col("prob").alias("score"), (F.col("prob") > 0.5).cast("int").alias("pred")))
    return M.all_metrics(rows, ["fold"]).select("metric", C.round6("value").alias("value"))


def preset(name, **params):
    def run(spark, sf):
        rows = prepared(spark, sf)
        return summary(build(name, params).fit(rows).score(rows))
    return run


for _query, _name, _params in (
    ("model_random_forest", "random_forest", {"n_estimators": 100, "max_depth": 50}),
    ("model_weighted_random_forest", "weighted_random_forest", {"n_estimators": 100, "max_depth": 6}),
    ("model_weighted_svc", "weighted_svc", {}),
    ("model_boosted_trees", "boosted_trees", {"n_estimators": 20, "scale_pos_weight": 3.0, "subsample": 0.8}),
    ("model_newton_trees", "newton_trees", {"n_estimators": 10, "max_depth": 6, "learning_rate": 0.085, "reg_lambda": 8.88, "reg_alpha": 0.678, "subsample": 0.6,
                                            "colsample_bytree": 0.85, "colsample_bylevel": 0.55, "scale_pos_weight": 3.3}),
    ("model_adaboost", "adaboost", {"n_estimators": 10}),
    ("model_adaboost_real", "adaboost", {"n_estimators": 10, "algorithm": "SAMME.R", "learning_rate": 0.5}),
    ("model_rusboost", "rusboost", {"n_estimators": 10}),
    ("model_easy_ensemble", "easy_ensemble", {"n_estimators": 10, "rounds": 10}),
    ("model_balanced_random_forest", "balanced_random_forest", {"n_estimators": 10, "max_depth": 10}),
    ("model_balanced_bagging", "balanced_bagging", {"n_estimators": 10, "depth": 10}),
    ("model_underbagging", "imbalanced_ensemble_underbagging", {"n_estimators": 10, "depth": 10}),
    ("model_smote_bagging", "imbalanced_ensemble_smote_bagging", {"n_estimators": 10, "depth": 10}),
    ("model_balance_cascade", "imbalanced_ensemble_balanced_cascade", {"n_estimators": 10, "depth": 10}),
    ("model_self_paced", "imbalanced_ensemble_self_paced", {"n_estimators": 10, "depth": 10}),
    ("model_overboost", "imbalanced_ensemble_overboost", {"n_estimators": 10}),
    ("model_smote_boost", "imbalanced_ensemble_smote_boost", {"n_estimators": 10}),
    ("model_kmeans_smote_boost", "imbalanced_ensemble_kmeans_smote_boost", {"n_estimators": 10}),
    ("model_adacost", "imbalanced_ensemble_adacost", {"n_estimators": 10}),
    ("model_adauboost", "imbalanced_ensemble_adauboost", {"n_estimators": 10}),
):
    query(_query)(preset(_name, **_params))


def _part(g: str, h: str) -> str:
    return f"(power(sign({g}) * greatest(abs({g}) - 0.5, 0), 2) / ({h} + 2))"


def _leaf(g: str, h: str) -> str:
    return f"(-sign({g}) * greatest(abs({g}) - 0.5, 0) / ({h} + 2))"


@query("newton_first_cuts", f"""with {CASES}, r as (select (0.5 - target) * case target when 1 then 100 else 1 end as g, 0.25 * case target when 1 then 100 else 1 end as h, k, hr, code from cases),
  l as (select 0 as f, case when hr <> 7 then hr end as x, g, h from r union all select 1, code::double, g, h from r),
  t as (select f, sum(g) as tg, sum(h) as th, count(*) as tn, coalesce(sum(g) filter (x is null), 0) as mg, coalesce(sum(h) filter (x is null), 0) as mh, count(*) filter (x is null) as mn from l group by f),
  v as (select f, x, sum(g) as g, sum(h) as h, count(*) as n from l where x is not null group by f, x),
  c as (select f, lead(x) over w as threshold, sum(g) over w as g, sum(h) over w as h, sum(n) over w as n from v window w as (partition by f order by x)),
  s as (select f, threshold, m as missing_left, tg, th, tn, g + if(m, mg, 0) as lg, h + if(m, mh, 0) as lh, (n + if(m, mn, 0))::bigint as left_n
    from c join t using (f) cross join (values (true), (false)) as ways(m) where m or mn > 0),
  p as (select *, 0.5 * ({_part('lg', 'lh')} + {_part('tg - lg', 'th - lh')} - {_part('tg', 'th')}) as gain, (tn - left_n)::bigint as right_n from s where lh >= 1 and th - lh >= 1 and left_n < tn)
  select f, threshold, missing_left, {r6('gain')} as gain, {r6(_leaf('lg', 'lh'))} as "left", {r6(_leaf('tg - lg', 'th - lh'))} as "right", left_n, right_n from p where gain > 0""")
def newton_first_cuts(spark, sf):
    # hour 7 counts as missing, so that both sides are tried for it
    rows = cases(spark, sf).select(F.col("event_id").alias("key"), F.array(F.when(F.col("hr") != 7, F.col("hr")), F.col("code").cast("double")).alias("vec"), "target")
    found = first_cuts(rows, 2, scale_pos_weight=100.0, reg_alpha=0.5, reg_lambda=2.0)
    return found.select("f", "threshold", "missing_left", *[C.round6(c).alias(c) for c in ("gain", "left", "right")], "left_n", "right_n")


@query("model_detector_features")
def xgbod(spark, sf):
    rows = cut_lineage(vecs(spark, sf))
    return summary(build("pyod_xgbod", {"n_estimators": 20}).fit(rows).score(rows))


def _sampled(name, **params):
    def run(spark, sf):
        rows = cut_lineage(vecs(spark, sf))
        return summary(build(name, params).fit(rows).score(rows))
    return run


query("model_smote_svc")(_sampled("sampling_smote_svc"))
query("model_adasyn_boosted_trees")(_sampled("sampling_adasyn_xgboost", n_estimators=20))
query("model_borderline_svc")(_sampled("sampling_borderlinesmote_svc"))
query("model_near_miss_svc")(_sampled("sampling_near_miss"))
query("model_centroids_boosted_trees")(_sampled("sampling_cluster_centroids_xgboost", n_estimators=20))
query("model_tomek_boosted_trees")(_sampled("sampling_tomek_links_xgboost", n_estimators=20))
for _query, _name in (
    ("model_smote_boosted_trees", "sampling_smote_xgboost"), ("model_adasyn_svc", "sampling_adasyn_svc"),
    ("model_borderline_boosted_trees", "sampling_borderlinesmote_xgboost"), ("model_near_miss_boosted_trees", "sampling_near_miss_xgboost"),
    ("model_tomek_svc", "sampling_tomek_links_svc"), ("model_smoten_svc", "sampling_smoten_svc"),
):
    query(_query)(_sampled(_name, **({"n_estimators": 20} if _name.endswith("xgboost") else {})))
query("model_detector_as_classifier")(_sampled("pyod_hbos"))


@query("model_late_fusion")
def late_fusion(spark, sf):
    emb = table(spark, sf, "embeddings").select(F.col("vec_id").alias("key"), F.col("embedding").cast("array<double>").alias("image"), (F.col("label") == 0).cast("int").alias("target"))
    meta = table(spark, sf, "documents").select(F.col("doc_id").alias("key"), (F.col("n_chars") / F.lit(1000.0)).alias("size"), (F.col("lang") == "en").cast("double").alias("is_en"))
    rows = cut_lineage(L.fuse(emb, meta, "key", "image", ["size", "is_en"]).select("key", F.col("features").alias("vec"), "target"))
    return summary(L.late_fusion(rows).score(rows))


@query("model_soft_vote")
def soft_vote(spark, sf):
    rows = prepared(spark, sf)
    members = [build(n, p).fit(rows) for n, p in (("random_forest", {"n_estimators": 10}), ("boosted_trees", {"n_estimators": 10}))]
    return summary(L.Voted(members).score(rows))


def folds_of(spark, sf, k=5):
    folded = cut_lineage(group_folds(cases(spark, sf).select("event_id", "user_id", "target", *NUM), "user_id", "target", k))
    return X.prepared_folds(folded, "event_id", "target", NUM, k=k)


@query("cross_validated_score")
def cross_validated(spark, sf):
    values, mean = X.cross_score(build("random_forest", {"n_estimators": 10, "max_depth": 10}), folds_of(spark, sf))
    return spark.createDataFrame([(i, v) for i, v in enumerate(values)] + [(-1, mean)], "fold int, pauc_score double")


@query("trial_search_leaderboard")
def trial_search(spark, sf):
    trials = X.expand_trials("random_forest", {"n_estimators": [10, 20], "max_depth": [5]})
    _, board, _ = X.run_trials(folds_of(spark, sf), trials)
    return board.select("trial", "metric", C.round6("mean_score").alias("mean_score"), C.round6("std_score").alias("std_score"), "place")


@query("candidate_fitness")
def candidate(spark, sf):
    members = [{"n_estimators": 10, "learning_rate": 0.1}, {"n_estimators": 20, "learning_rate": 0.3}]
    return X.voted_candidate(folds_of(spark, sf), members, over=0.02, under=0.1)


@query("classifier_batch_summary")
def batch(spark, sf):
    scores = cut_lineage(X.run_batch(folds_of(spark, sf), [("random_forest", {"n_estimators": [10], "max_depth": [5, 10]}), ("adaboost", {"n_estimators": [10]})]))
    return T.summarise(scores, ["classifier"]).select("classifier", "trial", *[C.round6(c).alias(c) for c in ("best", "related", "miss_rate")], "best_text", "miss_text")


@query("weighted_neighbour_selection")
def weighted_selection(spark, sf):
    fitted = WeightedKnnSelector(4, kernel="exp", data_type="float64", apply_weights=True).fit(vecs(spark, sf))
    return fitted.transform(vecs(spark, sf)).select("key", F.size("vec").alias("width"), C.round6(F.aggregate("vec", F.lit(0.0), lambda s, x: s + x)).alias("total"))


@query("weighted_neighbour_gradient", f"""with {VECS}, {PAIRS}, p as (select a, any_value(ta) as y, sum(exp(-d)) as s, sum(exp(-d) * tb) / sum(exp(-d)) as p from pairs group by a),
  uv as (select a, f, sum(-exp(-d) / (2 * d) * (x.vec[f] - z.vec[f]) * (x.vec[f] - z.vec[f])) as u, sum(-exp(-d) / (2 * d) * tb * (x.vec[f] - z.vec[f]) * (x.vec[f] - z.vec[f])) as v
    from pairs join vecs x on x.key = a join vecs z on z.key = b, range(1, 65) r(f) group by a, f)
  select (f - 1)::int as feature, {r6('avg(2 * (p - y) / s * (v - p * u))')} as slope from uv join p using (a) group by f union all select -1, {r6('avg((p - y) * (p - y))')} from p""")
def weighted_gradient(spark, sf):
    v = vecs(spark, sf)
    sel = WeightedKnnSelector(4, kernel="exp", data_type="float64", scaling=False)
    blocks, parts = pack(v, "key", "vec", "target", 256)
    err, g = sel.gradient(blocks, parts, v.select("key", F.col("target").cast("double").alias("y")), np.ones(64))
    return spark.createDataFrame([(i, float(x)) for i, x in enumerate(g)] + [(-1, float(err))], "feature int, slope double").withColumn("slope", C.round6("slope"))
