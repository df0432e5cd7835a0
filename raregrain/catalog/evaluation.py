"""Metrics, losses, splits, trials and their results."""
from __future__ import annotations

from pyspark.sql import functions as F

from raregrain.catalog.fixtures import CASES, SCORED, cases, docs, h32, query, r6, scored, table
from raregrain.functions import columns as C
from raregrain.operators import losses as L
from raregrain.operators import metrics as M
from raregrain.operators import splits as S
from raregrain.operators import trials as T
from raregrain.sources import results as R

BY = ["trial", "fold"]


def rounded(df, keep, cols):
    return df.select(*keep, *[C.round6(c).alias(c) for c in cols])


CONF = "conf as (select trial, fold, count(*) filter (target=0 and pred=0)::double as tn, count(*) filter (target=0 and pred=1)::double as fp, count(*) filter (target=1 and pred=0)::double as fn, count(*) filter (target=1 and pred=1)::double as tp from {src} group by all)"
LABELS = """lab as (select *, coalesce((tp+tn)/nullif(tn+fp+fn+tp,0),0) as accuracy_score, coalesce(2*tp/nullif(2*tp+fp+fn,0),0) as f1_score,
  coalesce(tp/nullif(tp+fn,0),0) as sensitivity_score, coalesce(tn/nullif(tn+fp,0),0) as specificity_score from conf),
lab2 as (select *, (sensitivity_score+specificity_score)/2 as roc_auc_score, sqrt(sensitivity_score*specificity_score) as geometric_mean_score, 1-sensitivity_score as miss_rate from lab)"""


def curve(src: str, direction: str) -> str:
    return f"""cells as (select trial, fold, score, sum(target)::double as pos, sum(1-target)::double as neg from {src} group by all),
cum as (select *, sum(pos) over w as cp, sum(neg) over w as cn, sum(pos) over (partition by trial, fold) as np, sum(neg) over (partition by trial, fold) as nn
  from cells window w as (partition by trial, fold order by score {direction} rows between unbounded preceding and current row))"""


def pauc_sql(src: str, cut: str = "abs(1 - 0.8::double)") -> str:
    return curve(src, "asc") + f""",
seg as (select trial, fold, (cp-pos)/nullif(np,0) as x0, cp/nullif(np,0) as x1, (cn-neg)/nullif(nn,0) as y0, cn/nullif(nn,0) as y1, {cut} as c from cum),
pa as (select trial, fold, coalesce(sum(case when x0 >= c then 0 when x1 <= c then (x1-x0)*(y0+y1)/2 else (c-x0)*(y0 + y0+(y1-y0)*(c-x0)/nullif(x1-x0,0))/2 end),0) as pauc_score from seg group by all)"""


@query("confusion_per_fold", f"with {SCORED}, {CONF.format(src='scored')} select trial, fold, tn::bigint as tn, fp::bigint as fp, fn::bigint as fn, tp::bigint as tp from conf")
def confusion(spark, sf):
    return M.confusion(scored(spark, sf), BY)


@query("confusion_from_logits", f"with {SCORED}, s as (select * replace (case when 1/(1+exp(-logit)) > 0.4 then 1 else 0 end as pred) from scored), {CONF.format(src='s')} select trial, fold, tn::bigint as tn, fp::bigint as fp, fn::bigint as fn, tp::bigint as tp from conf")
def confusion_logits(spark, sf):
    s = scored(spark, sf).drop("score", "pred").withColumnRenamed("logit", "score")
    return M.confusion(M.predicted(s, 0.4, "sigmoid"), BY)


LABEL_COLS = ["accuracy_score", "f1_score", "sensitivity_score", "specificity_score", "geometric_mean_score", "miss_rate", "roc_auc_score"]


@query("label_metrics_per_fold", f"with {SCORED}, {CONF.format(src='scored')}, {LABELS} select trial, fold, " + ", ".join(f"{r6(c)} as {c}" for c in LABEL_COLS) + " from lab2")
def label_metrics(spark, sf):
    return rounded(M.label_metrics(M.confusion(scored(spark, sf), BY)), BY, LABEL_COLS)


@query("roc_points", f"with {SCORED}, {curve('scored', 'desc')} select trial, fold, {r6('score')} as score, cn::bigint as fp, cp::bigint as tp, {r6('cn/nullif(nn,0)')} as fpr, {r6('cp/nullif(np,0)')} as tpr from cum")
def roc_points(spark, sf):
    return M.roc(scored(spark, sf), BY).select(*BY, C.round6("score").alias("score"), "fp", "tp", C.round6("fpr").alias("fpr"), C.round6("tpr").alias("tpr"))


@query("full_auc", f"with {SCORED}, {curve('scored', 'desc')} select trial, fold, {r6('sum(neg*(2*cp-pos)/2)/max(np*nn)')} as auc from cum group by all")
def full_auc(spark, sf):
    return rounded(M.auc(scored(spark, sf), BY), BY, ["auc"])


@query("partial_auc_per_fold", f"with {SCORED}, {pauc_sql('scored')} select trial, fold, {r6('pauc_score')} as pauc_score from pa")
def partial_auc(spark, sf):
    return rounded(M.pauc(scored(spark, sf), BY), BY, ["pauc_score"])


@query("partial_auc_other_limit", f"with {SCORED}, {pauc_sql('scored', 'abs(1 - 0.5::double)')} select trial, fold, {r6('pauc_score')} as pauc_score from pa")
def partial_auc_half(spark, sf):
    return rounded(M.pauc(scored(spark, sf), BY, 0.5), BY, ["pauc_score"])


@query("partial_auc_all_rows", f"with {SCORED}, s as (select * replace (0 as fold, 0 as trial) from scored where trial = 1), {pauc_sql('s')} select {r6('pauc_score')} as pauc_score from pa")
def partial_auc_all(spark, sf):
    return M.pauc(scored(spark, sf).filter("trial = 1"), []).select(C.round6("pauc_score").alias("pauc_score"))


@query("partial_auc_one_class_is_zero", f"""with {SCORED}, s as (select * replace (event_type_fold as fold) from (select *, case when target = 1 then 0 else 1 end as event_type_fold from scored)), {pauc_sql('s')}
  select trial, fold, {r6('pauc_score')} as pauc_score from pa""")
def one_class(spark, sf):
    s = scored(spark, sf).withColumn("fold", F.when(F.col("target") == 1, 0).otherwise(1))
    return rounded(M.pauc(s, BY), BY, ["pauc_score"])


@query("mean_tpr_above_limit", f"""with {SCORED}, st as (select trial, fold, target, sum(target) over w as tp, sum(target) over (partition by trial, fold) as np from scored
  window w as (partition by trial, fold order by score desc, {h32("'0'", 'event_id')}, event_id rows between unbounded preceding and current row))
  select trial, fold, {r6('coalesce(avg(tp::double/np) filter (target = 0 and tp::double/np >= 0.8::double), 0)')} as area_above from st group by all""")
def mean_tpr(spark, sf):
    return rounded(M.mean_tpr_above(scored(spark, sf), BY, "event_id"), BY, ["area_above"])


METRIC_UNION = " union all ".join(f"select trial, fold, '{m}' as metric, {m} as value from joined" for m in M.METRICS)
ALL_SCORES = f"{{conf}}, {LABELS}, {{pauc}}, joined as (select * from lab2 join pa using (trial, fold)), scores as ({METRIC_UNION})"


def scores_sql(src: str) -> str:
    return ALL_SCORES.format(conf=CONF.format(src=src), pauc=pauc_sql(src))


@query("all_metrics_one_pass", f"with {SCORED}, {scores_sql('scored')} select trial, fold, metric, {r6('value')} as value from scores")
def all_metrics(spark, sf):
    return rounded(M.all_metrics(scored(spark, sf), BY), [*BY, "metric"], ["value"])


@query("epoch_confusion_totals", f"""with {SCORED} select trial as epoch, count(*) filter (target=0 and pred=0) as tn, count(*) filter (target=0 and pred=1) as fp, count(*) filter (target=1 and pred=0) as fn, count(*) filter (target=1 and pred=1) as tp from scored group by 1""")
def epoch_totals(spark, sf):
    s = scored(spark, sf).withColumn("batch", F.col("event_id") % 64)
    return M.epoch_totals(M.confusion(s, ["trial", "batch"]).withColumnRenamed("trial", "epoch"))


# ---- losses ----
@query("bce_mean", f"with {SCORED} select trial, {r6('avg(5 * target * ln(1 + exp(-logit)) + (1 - target) * ln(1 + exp(logit)))')} as loss from scored group by 1")
def bce_mean(spark, sf):
    return rounded(L.bce(scored(spark, sf), 5.0, ["trial"]), ["trial"], ["loss"])


@query("focal_of_mean_bce", f"with {SCORED}, b as (select trial, avg(5 * target * ln(1 + exp(-logit)) + (1 - target) * ln(1 + exp(logit))) as b from scored group by 1) select trial, {r6('0.25 * power(1 - exp(-b), 2) * b')} as loss from b")
def focal_mean(spark, sf):
    return rounded(L.focal_of_mean(scored(spark, sf), 0.25, 2.0, 5.0, ["trial"]), ["trial"], ["loss"])


CE = "ln(exp(1 - logit) + exp(logit)) - case when target = 1 then logit else 1 - logit end"


@query("focal_per_row", f"with {SCORED}, c as (select trial, case when target = 1 then 3.0::double else 1.0::double end * ({CE}) as c from scored) select trial, {r6('avg(power(1 - exp(-c), 2) * c)')} as loss from c group by 1")
def focal_row(spark, sf):
    return rounded(L.focal_per_row(scored(spark, sf), 2.0, (1.0, 3.0), ["trial"]), ["trial"], ["loss"])


@query("ldam_loss", f"""with {SCORED}, n as (select target, count(*)::double as c from scored group by 1), m as (select target, power(c, -0.25::double) * 0.5 / (select max(power(c, -0.25::double)) from n) as m from n),
  z as (select target, 30 * (1 - logit - case when target = 0 then m else 0 end) as l0, 30 * (logit - case when target = 1 then m else 0 end) as l1, case when target = 1 then 2.0::double else 1.0::double end as w from scored join m using (target))
  select {r6('sum(w * (greatest(l0, l1) + ln(1 + exp(-abs(l0 - l1))) - case when target = 1 then l1 else l0 end)) / sum(w)')} as loss from z""")
def ldam(spark, sf):
    return L.ldam(scored(spark, sf), weights=(1.0, 2.0)).select(C.round6("loss").alias("loss"))


# ---- splits ----
GROUPS = f"""grp as (select user_id, arg_min(target, event_id) as lab, {h32("'42'", 'user_id')} as h from cases group by 1),
size as (select lab, count(*)::double as n, sum(count(*)) over () as total from grp group by 1),
quota as (select *, ceil(total * (1 - 0.8::double) - 1e-9) as t, ceil(total * (1 - 0.8::double) - 1e-9) * n / total as e from size),
quota2 as (select lab, floor(e) + case when row_number() over (order by floor(e) - e, lab) <= t - sum(floor(e)) over () then 1 else 0 end as q from quota),
side as (select user_id, case when row_number() over (partition by grp.lab order by h, user_id) <= q then 'val' else 'train' end as split from grp join quota2 on grp.lab = quota2.lab)"""


@query("group_holdout", f"with {CASES}, {GROUPS} select event_id, split from cases join side using (user_id)")
def group_holdout(spark, sf):
    return S.group_holdout(cases(spark, sf), "event_id", "user_id", "target").select("event_id", "split")


FOLDS = f"""gc as (select user_id, sum(target) as p, count(*) as n, {h32("'42'", 'user_id')} as h from {{src}} group by 1),
pos as (select user_id, (row_number() over (order by p desc, n desc, h, user_id) - 1) % 10 as t from gc),
dealt as (select user_id, (case when t < 5 then t else 9 - t end)::int as fold from pos)"""


@query("stratified_group_folds", f"with {CASES}, {FOLDS.format(src='cases')} select event_id, fold from cases join dealt using (user_id)")
def group_folds(spark, sf):
    return S.group_folds(cases(spark, sf), "user_id", "target").select("event_id", "fold")


@query("stratified_row_folds", f"""with d as (select doc_id, toxic from labels) select doc_id, ((row_number() over (partition by toxic order by {h32("'42'", 'doc_id')}, doc_id) - 1) % 5)::int as fold from d""")
def row_folds(spark, sf):
    return S.row_folds(table(spark, sf, "labels"), "doc_id", "toxic").select("doc_id", "fold")


@query("train_test_rows_of_folds", f"""with {CASES}, {FOLDS.format(src='cases')}, f as (select * from cases join dealt using (user_id)), k as (select unnest([0,1,2,3,4]) as test_fold)
  select test_fold, case when fold = test_fold then 'test' else 'train' end as side, count(*) as n, sum(target)::bigint as pos from f, k group by all""")
def train_test(spark, sf):
    folded = S.group_folds(cases(spark, sf), "user_id", "target")
    # both sides of every fold follow from the per-fold totals
    sizes = folded.groupBy("fold").agg(F.count(F.lit(1)).alias("n"), F.sum("target").cast("bigint").alias("pos"))
    each = sizes.withColumn("test_fold", F.explode(F.sequence(F.lit(0), F.lit(4))))
    return each.groupBy("test_fold", F.when(F.col("fold") == F.col("test_fold"), "test").otherwise("train").alias("side")).agg(
        F.sum("n").cast("bigint").alias("n"), F.sum("pos").cast("bigint").alias("pos"))


# ---- trials ----
def folded_scores(spark, sf):
    c = S.group_folds(cases(spark, sf).select("event_id", "user_id", "target"), "user_id", "target").select("event_id", "fold")
    return M.all_metrics(scored(spark, sf).drop("fold").join(c, "event_id"), BY)


FSRC = f"{SCORED}, {FOLDS.format(src='cases')}, fs as (select s.* replace (d.fold as fold) from scored s join dealt d using (user_id))"
BOARD = "board as (select trial, metric, avg(value) as mean_score, stddev_pop(value) as std_score from scores group by all), ranked as (select *, rank() over (partition by metric order by mean_score desc)::int as place from board)"


@query("leaderboard_by_group_folds", f"with {FSRC}, {scores_sql('fs')}, {BOARD} select trial, metric, {r6('mean_score')} as mean_score, {r6('std_score')} as std_score, place from ranked")
def leaderboard(spark, sf):
    return T.leaderboard(folded_scores(spark, sf)).select("trial", "metric", C.round6("mean_score").alias("mean_score"), C.round6("std_score").alias("std_score"), "place")


def simple_scores(spark, sf):
    return M.all_metrics(scored(spark, sf), BY)


SRC = f"{SCORED}, {scores_sql('scored')}"


@query("fold_mean_and_spread", f"with {SRC} select trial, metric, {r6('avg(value)')} as mean_score, {r6('stddev_pop(value)')} as std_score from scores group by all")
def fold_spread(spark, sf):
    return rounded(T.fold_summary(simple_scores(spark, sf), ["trial"]), ["trial", "metric"], ["mean_score", "std_score"])


@query("best_trial_by_pauc", f"with {SRC}, {BOARD} select trial, {r6('mean_score')} as mean_score from ranked where metric = 'pauc_score' order by ranked.mean_score desc, trial limit 1")
def best_trial(spark, sf):
    return rounded(T.best_trial(T.leaderboard(simple_scores(spark, sf)), "pauc_score"), ["trial"], ["mean_score"])


PIVOT_METRICS = ["f1_score", "pauc_score"]
_p_cols = ", ".join([f"{r6(f'max(value) filter (metric = {chr(39)}{m}{chr(39)} and fold = {i})')} as split{i}_test_{m}" for m in PIVOT_METRICS for i in range(5)]
                    + [f"{r6(f'max({c}) filter (b.metric = {chr(39)}{m}{chr(39)})')} as {s}_test_{m}" for m in PIVOT_METRICS for c, s in (("mean_score", "mean"), ("std_score", "std"), ("place", "rank"))])


@query("leaderboard_wide", f"with {SRC}, {BOARD} select b.trial, {_p_cols.replace('metric =', 'b.metric =').replace('b.b.', 'b.')} from scores s join ranked b on s.trial = b.trial and s.metric = b.metric group by b.trial")
def leaderboard_wide(spark, sf):
    s = simple_scores(spark, sf)
    wide = R.leaderboard_table(T.leaderboard(s), s, list(range(5)), PIVOT_METRICS)
    return rounded(wide, ["trial"], [c for c in wide.columns if c != "trial"])


@query("best_parameter_rows", f"with {SRC}, {BOARD}, best as (select trial from ranked where metric = 'pauc_score' order by mean_score desc, trial limit 1), p as (select trial, count(*) as rows, sum(pred) as flagged from scored group by 1) select 'rows' as name, rows::varchar as value from p join best using (trial) union all select 'flagged', flagged::varchar from p join best using (trial)")
def best_params(spark, sf):
    t = scored(spark, sf).groupBy("trial").agg(F.count(F.lit(1)).alias("n"), F.sum("pred").alias("p")).select(
        "trial", F.create_map(F.lit("model__rows"), F.col("n").cast("string"), F.lit("model__flagged"), F.col("p").cast("string")).alias("params"))
    return R.best_params(t, T.best_trial(T.leaderboard(simple_scores(spark, sf)), "pauc_score"))


@query("summary_per_classifier", f"""with {SRC}, gb as (select trial % 2 as clf, trial, metric, avg(value) as m, stddev_pop(value) as s from scores group by all),
  w as (select clf, trial, max(m) filter (metric = 'geometric_mean_score') as g, max(s) filter (metric = 'geometric_mean_score') as gs, max(m) filter (metric = 'roc_auc_score') as a,
    max(m) filter (metric = 'sensitivity_score') as se, max(s) filter (metric = 'sensitivity_score') as ss from gb group by all)
  select clf::int as clf, trial, {r6('g')} as best, {r6('a')} as related, {r6('1 - se')} as miss_rate, printf('%.2f ± %.2f', g * 100, gs * 100) as best_text, printf('%.1f ± %.1f', (1 - se) * 100, ss * 100) as miss_text
  from w qualify row_number() over (partition by clf order by g desc, trial) = 1""")
def summary(spark, sf):
    s = simple_scores(spark, sf).withColumn("clf", F.col("trial") % 2)
    return T.summarise(s, ["clf"]).select("clf", "trial", *[C.round6(c).alias(c) for c in ("best", "related", "miss_rate")], "best_text", "miss_text")


@query("best_row_per_group", f"with {SRC}, g as (select fold, trial, value from scores where metric = 'f1_score') select fold, arg_max(trial, (value, -trial)) as trial, {r6('max(value)')} as best from g group by fold")
def best_row(spark, sf):
    b = simple_scores(spark, sf).withColumn("mean_score", F.col("value"))
    return rounded(T.best_per_group(b, ["fold"], "f1_score"), ["fold", "trial"], ["best"])


GRID_SQL = """l as (select (select list_sort(list_distinct(list(c_mktsegment))) from customer) as segment, (select list_sort(list_distinct(list(l_returnflag))) from lineitem) as flag, (select list_sort(list_distinct(list(o_orderstatus))) from orders) as status),
 a as (select unnest(segment) as segment, flag, status from l), b as (select segment, unnest(flag) as flag, status from a), trials as (select segment || '|' || flag || '|' || s as trial_key, segment, flag, s as status from (select segment, flag, unnest(status) as s from b))"""


def grid(spark, sf):
    """Value lists read from three tables, expanded to every combination."""
    lists = table(spark, sf, "customer").agg(F.array_sort(F.collect_set("c_mktsegment")).alias("segment"))
    flag = table(spark, sf, "lineitem").agg(F.array_sort(F.collect_set("l_returnflag")).alias("v")).scalar()
    status = table(spark, sf, "orders").agg(F.array_sort(F.collect_set("o_orderstatus")).alias("v")).scalar()
    return T.expand_lists(lists.withColumns({"flag": flag, "status": status}), ["segment", "flag", "status"])


@query("expanded_grid", f"with {GRID_SQL} select trial_key, segment, flag, status from trials")
def expanded(spark, sf):
    return grid(spark, sf).select("trial_key", *[F.col("params")[n].alias(n) for n in ("segment", "flag", "status")])


@query("random_grid_subset", f"""with {GRID_SQL} select trial_key from trials order by {h32("'1000'", 'trial_key')}, trial_key limit 4""")
def random_subset(spark, sf):
    return T.random_trials(grid(spark, sf), 4).select("trial_key")


@query("trials_by_folds", f"with {GRID_SQL} select trial_key, unnest([0,1,2,3,4])::int as fold from trials")
def trials_by_folds(spark, sf):
    return T.with_folds(grid(spark, sf)).select("trial_key", "fold")


@query("soft_vote", f"with {SCORED} select event_id, {r6('avg(score)')} as prob from scored group by 1")
def soft_vote(spark, sf):
    from raregrain.operators.learners import soft_vote as vote
    return rounded(vote(scored(spark, sf).withColumnRenamed("score", "prob"), ["event_id"]), ["event_id"], ["prob"])
