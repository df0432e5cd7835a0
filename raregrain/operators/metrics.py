"""Imbalance-aware metrics over a scored table (by..., target, score, pred).

Curves are built from score-collapsed cells, so ties never depend on row order, and
the running counts use value buckets, so no group is sorted in a single task.
"""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from raregrain.functions.columns import hash32
from raregrain.operators.ranking import hash_bucket, running_sums, value_borders, value_bucket
from raregrain.session import cut_lineage

METRICS = ["accuracy_score", "f1_score", "roc_auc_score", "geometric_mean_score",
           "sensitivity_score", "specificity_score", "pauc_score"]


def predicted(scored: DataFrame, threshold: float, link: str | None = None) -> DataFrame:
    """Hard label from a score; `link='sigmoid'` treats the score as a logit."""
    s = F.col("score")
    if link == "sigmoid":
        s = F.lit(1.0) / (F.lit(1.0) + F.exp(-s))
    return scored.withColumn("pred", (s > F.lit(threshold)).cast("int"))


def confusion(scored: DataFrame, by: list[str]) -> DataFrame:
    """tn, fp, fn, tp per group in one aggregation."""
    t, p = F.col("target"), F.col("pred")
    return scored.groupBy(*by).agg(
        F.count_if((t == 0) & (p == 0)).alias("tn"), F.count_if((t == 0) & (p == 1)).alias("fp"),
        F.count_if((t == 1) & (p == 0)).alias("fn"), F.count_if((t == 1) & (p == 1)).alias("tp"))


def _rate(a: Column, b: Column) -> Column:
    return F.coalesce(F.try_divide(a.cast("double"), b.cast("double")), F.lit(0.0))


def label_metrics(counts: DataFrame) -> DataFrame:
    """Accuracy, F1, sensitivity, specificity, geometric mean, miss rate, hard-label AUC."""
    tn, fp, fn, tp = (F.col(c) for c in ("tn", "fp", "fn", "tp"))
    sens, spec = _rate(tp, tp + fn), _rate(tn, tn + fp)
    return counts.withColumns({
        "accuracy_score": _rate(tp + tn, tn + fp + fn + tp),
        "f1_score": _rate(2 * tp, 2 * tp + fp + fn),
        "sensitivity_score": sens, "specificity_score": spec,
        "geometric_mean_score": F.sqrt(sens * spec), "miss_rate": F.lit(1.0) - sens,
        "roc_auc_score": (sens + spec) / 2})


def score_cells(scored: DataFrame, by: list[str], keep: list[str] = ()) -> DataFrame:
    """Positives and negatives per distinct score, from the only pass over the scored rows.

    The cells are written once: borders, bucket totals and curves all read them.
    """
    return cut_lineage(scored.groupBy(*by, "score", *keep).agg(
        F.sum(F.col("target").cast("bigint")).alias("pos"), F.sum(1 - F.col("target").cast("bigint")).alias("neg")))


def _cumulative(cells: DataFrame, by: list[str], descending: bool) -> DataFrame:
    """Cells with cumulative counts in score order and their group's totals."""
    placed = cells.withColumn("_b", value_bucket("score", value_borders(cells, "score")))
    order = [F.col("score").desc() if descending else F.col("score")]
    return running_sums(placed, by, "_b", order, {"cum_pos": F.col("pos"), "cum_neg": F.col("neg")}, descending,
                        totals={"cum_pos": "n_pos", "cum_neg": "n_neg"}).drop("_b")


def roc(scored: DataFrame, by: list[str]) -> DataFrame:
    """ROC points, one per distinct score, from the highest score down."""
    c = _cumulative(score_cells(scored, by), by, descending=True)
    return c.select(*by, "score", F.col("cum_neg").alias("fp"), F.col("cum_pos").alias("tp"),
                    F.try_divide(F.col("cum_neg").cast("double"), F.col("n_neg").cast("double")).alias("fpr"),
                    F.try_divide(F.col("cum_pos").cast("double"), F.col("n_pos").cast("double")).alias("tpr"))


def auc(scored: DataFrame, by: list[str]) -> DataFrame:
    """Area under the ROC curve by trapezoids over tie-collapsed points."""
    c = _cumulative(score_cells(scored, by), by, descending=True)
    cell = F.col("neg") * (F.col("cum_pos") * 2 - F.col("pos")) / F.lit(2.0)
    return c.groupBy(*by).agg(
        F.coalesce(F.try_divide(F.sum(cell), F.max(F.col("n_pos") * F.col("n_neg")).cast("double")), F.lit(0.0)).alias("auc"))


def pauc(scored: DataFrame, by: list[str], min_tpr: float = 0.8, name: str = "pauc_score") -> DataFrame:
    """Area above `min_tpr`: label and score are flipped, false-positive rate up to 1 - min_tpr.

    Flipping the score is ordering by it upwards, which keeps tiny scores apart.
    The last cell is cut by linear interpolation. A group with one class scores 0.
    """
    return _pauc_of_cells(score_cells(scored, by), by, min_tpr, name)


def _pauc_of_cells(cells: DataFrame, by: list[str], min_tpr: float, name: str) -> DataFrame:
    cut = F.lit(abs(1 - min_tpr))
    c = _cumulative(cells, by, descending=False)
    d = c.select(*by,
                 F.try_divide((F.col("cum_pos") - F.col("pos")).cast("double"), F.col("n_pos").cast("double")).alias("x0"),
                 F.try_divide(F.col("cum_pos").cast("double"), F.col("n_pos").cast("double")).alias("x1"),
                 F.try_divide((F.col("cum_neg") - F.col("neg")).cast("double"), F.col("n_neg").cast("double")).alias("y0"),
                 F.try_divide(F.col("cum_neg").cast("double"), F.col("n_neg").cast("double")).alias("y1"))
    x0, x1, y0, y1 = (F.col(k) for k in ("x0", "x1", "y0", "y1"))
    y_cut = y0 + (y1 - y0) * F.try_divide(cut - x0, x1 - x0)
    area = (F.when(x0 >= cut, F.lit(0.0))
            .when(x1 <= cut, (x1 - x0) * (y0 + y1) / 2)
            .otherwise((cut - x0) * (y0 + y_cut) / 2))
    return d.groupBy(*by).agg(F.coalesce(F.sum(area), F.lit(0.0)).alias(name))


def mean_tpr_above(scored: DataFrame, by: list[str], key: str, min_tpr: float = 0.8, seed=0) -> DataFrame:
    """Area where TPR >= min_tpr divided by its FPR span, on the curve with one step per row.

    Rows with equal scores follow the seeded hash of their key. Cells of one score and
    one hash bucket are summed first, so a score shared by many rows is spread out.
    """
    rows = scored.select(*by, "score", key, "target", hash32(seed, key).alias("_h")).withColumn("_hb", hash_bucket("_h", 10))
    cells = cut_lineage(rows.groupBy(*by, "score", "_hb").agg(F.sum(F.col("target").cast("bigint")).alias("pos")))
    placed = cells.withColumn("_b", value_bucket("score", value_borders(cells, "score")))
    cum = running_sums(placed, by, "_b", [F.col("score").desc(), "_hb"], {"cum_pos": F.col("pos")}, descending=True, totals={"cum_pos": "n_pos"})
    starts = cum.select(*by, "score", "_hb", "n_pos", (F.col("cum_pos") - F.col("pos")).alias("_start"))
    keys = by + ["score", "_hb"]
    inside = Window.partitionBy(*keys).orderBy("_h", key).rowsBetween(Window.unboundedPreceding, 0)
    stepped = rows.join(starts, keys).withColumn("_tp", F.sum(F.col("target").cast("bigint")).over(inside) + F.col("_start"))
    tpr = F.try_divide(F.col("_tp").cast("double"), F.col("n_pos").cast("double"))
    return stepped.groupBy(*by).agg(
        F.coalesce(F.avg(F.when((F.col("target") == 0) & (tpr >= F.lit(min_tpr)), tpr)), F.lit(0.0)).alias("area_above"))


def all_metrics(scored: DataFrame, by: list[str], min_tpr: float = 0.8) -> DataFrame:
    """Every metric per group, as long rows (by..., metric, value)."""
    cells = score_cells(scored, by, ["pred"])
    p, pos, neg = F.col("pred"), F.col("pos"), F.col("neg")

    def total(value, label):
        return F.coalesce(F.sum(F.when(p == label, value)), F.lit(0))

    counts = cells.groupBy(*by).agg(total(neg, 0).alias("tn"), total(neg, 1).alias("fp"), total(pos, 0).alias("fn"), total(pos, 1).alias("tp"))
    by_score = cells.groupBy(*by, "score").agg(F.sum("pos").alias("pos"), F.sum("neg").alias("neg"))
    wide = label_metrics(counts).join(_pauc_of_cells(by_score, by, min_tpr, "pauc_score"), by)
    cells = ", ".join(f"'{m}', {m}" for m in METRICS)
    return wide.selectExpr(*by, f"stack({len(METRICS)}, {cells}) as (metric, value)")


def epoch_totals(batches: DataFrame, epoch: str = "epoch") -> DataFrame:
    """Sum per-batch confusion counts into one row per epoch."""
    return batches.groupBy(epoch).agg(*[F.sum(c).cast("bigint").alias(c) for c in ("tn", "fp", "fn", "tp")])
