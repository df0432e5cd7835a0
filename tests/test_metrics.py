"""Hand-sized answers and invariants of metrics and losses."""
import math

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from raregrain.functions.columns import hash32
from raregrain.operators import losses as L
from raregrain.operators import metrics as M

HAND = [(0, .1), (0, .2), (1, .2), (0, .4), (1, .9), (0, .6), (1, .8), (1, .7), (1, .95), (0, .3)]


def scored(spark, pairs):
    rows = [(i, 0, t, float(s), int(s > 0.5)) for i, (t, s) in enumerate(pairs)]
    return spark.createDataFrame(rows, "key long, fold int, target int, score double, pred int")


def brute_pauc(pairs, min_tpr=0.8):
    cut = abs(1 - min_tpr)
    p, n = sum(t for t, _ in pairs), sum(1 - t for t, _ in pairs)
    if not p or not n:
        return 0.0
    area, x0, y0 = 0.0, 0.0, 0.0
    for s in sorted({s for _, s in pairs}):
        x1 = x0 + sum(t for t, v in pairs if v == s) / p
        y1 = y0 + sum(1 - t for t, v in pairs if v == s) / n
        if x0 < cut:
            xe = min(x1, cut)
            ye = y1 if x1 <= cut else y0 + (y1 - y0) * (cut - x0) / (x1 - x0)
            area += (xe - x0) * (y0 + ye) / 2
        x0, y0 = x1, y1
    return area


def pauc(spark, pairs, **kw):
    return M.pauc(scored(spark, pairs), ["fold"], **kw).first()["pauc_score"]


def test_partial_auc_by_hand(spark):
    assert pauc(spark, HAND) == pytest.approx(0.06)


def test_partial_auc_ends(spark):
    assert pauc(spark, [(i % 2, 0.5) for i in range(10)]) == pytest.approx(0.02)
    assert pauc(spark, [(0, 0.1)] * 5 + [(1, 0.9)] * 5) == pytest.approx(0.2)
    assert pauc(spark, [(1, 0.3), (1, 0.9)]) == 0.0


@settings(max_examples=5, deadline=None, suppress_health_check=list(HealthCheck))
@given(st.lists(st.tuples(st.integers(0, 1), st.integers(0, 6)), min_size=2, max_size=30))
def test_partial_auc_against_brute_force_and_monotone_maps(spark, raw):
    pairs = [(t, s / 7) for t, s in raw]
    value = pauc(spark, pairs)
    assert value == pytest.approx(brute_pauc(pairs), abs=1e-12)
    assert pauc(spark, [(t, math.exp(3 * s)) for t, s in pairs]) == pytest.approx(value, abs=1e-12)


def test_label_metrics_by_hand(spark):
    row = M.label_metrics(spark.createDataFrame([(8, 2, 1, 3)], "tn long, fp long, fn long, tp long")).first()
    want = {"accuracy_score": 0.785714, "f1_score": 0.666667, "sensitivity_score": 0.75, "specificity_score": 0.8,
            "geometric_mean_score": 0.774597, "roc_auc_score": 0.775, "miss_rate": 0.25}
    for k, v in want.items():
        assert row[k] == pytest.approx(v, abs=1e-6)


def test_undefined_scores_are_zero(spark):
    row = M.label_metrics(spark.createDataFrame([(5, 0, 0, 0)], "tn long, fp long, fn long, tp long")).first()
    assert row["f1_score"] == 0 and row["sensitivity_score"] == 0


def test_auc_equals_pair_counting(spark):
    p = [s for t, s in HAND if t]
    n = [s for t, s in HAND if not t]
    want = sum((a > b) + 0.5 * (a == b) for a in p for b in n) / (len(p) * len(n))
    assert M.auc(scored(spark, HAND), ["fold"]).first()["auc"] == pytest.approx(want)


def test_hot_score_is_not_sorted_in_one_piece(spark):
    """A third of the rows share one score; the step curve still matches brute force."""
    pairs = [(i % 3 == 0, 0.5 if i % 3 else (i % 10) / 10) for i in range(300)]
    df = scored(spark, [(int(t), s) for t, s in pairs])
    got = M.mean_tpr_above(df, ["fold"], "key", 0.5).first()["area_above"]
    rows = df.withColumn("h", hash32(0, "key")).collect()
    rows.sort(key=lambda r: (-r["score"], r["h"], r["key"]))
    pos, tp, vals = sum(r["target"] for r in rows), 0, []
    for r in rows:
        tp += r["target"]
        if r["target"] == 0 and tp / pos >= 0.5:
            vals.append(tp / pos)
    assert vals and got == pytest.approx(sum(vals) / len(vals))


def test_losses_by_hand(spark):
    df = spark.createDataFrame([(0.0, 1), (0.0, 0)], "logit double, target int")
    assert L.bce(df).first()["loss"] == pytest.approx(0.693147, abs=1e-6)
    assert L.focal_of_mean(df).first()["loss"] == pytest.approx(0.173287, abs=1e-6)
    rows = spark.createDataFrame([(0.5, 0)] * 16 + [(0.5, 1)], "logit double, target int")
    one = L.ldam(rows, s=1.0, weights=(0.0, 1.0)).first()["loss"]
    assert one == pytest.approx(math.log(1 + math.exp(0.5)), abs=1e-6)


def test_streamed_epoch_totals_match_batch(spark, tmp_path):
    from raregrain.streaming.epochs import epoch_confusion, score_stream
    df = scored(spark, HAND * 5).withColumn("epoch", F.col("key") % 2)
    df.repartition(4).write.parquet(str(tmp_path / "in"))
    stream = score_stream(spark, str(tmp_path / "in"), df.schema)
    q = epoch_confusion(stream).writeStream.outputMode("complete").format("memory").queryName("epoch_totals").option(
        "checkpointLocation", str(tmp_path / "ckpt")).start()
    q.processAllAvailable()
    q.stop()
    got = {tuple(r) for r in spark.table("epoch_totals").select("epoch", "tn", "fp", "fn", "tp").collect()}
    want = {tuple(r) for r in M.confusion(df, ["epoch"]).select("epoch", "tn", "fp", "fn", "tp").collect()}
    assert got == want
