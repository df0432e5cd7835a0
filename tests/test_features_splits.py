"""Derived features, sources, preparation, splits."""
import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from raregrain.functions import columns as C
from raregrain.operators import derive as D
from raregrain.operators import prep as P
from raregrain.operators import ranking as R
from raregrain.operators import splits as S
from raregrain.operators.weights import class_weights
from raregrain.sources import results, tables


def test_levels_put_a_feature_after_its_inputs():
    lv = D.levels(D.ALL_FEATURES)
    at = {n: i for i, level in enumerate(lv) for n in level}
    assert at["shape_complexity_index"] > max(at["border_complexity"], at["lesion_shape_index"])
    assert sum(map(len, lv)) == len(D.ALL_FEATURES) == 43
    with pytest.raises(ValueError):
        D.levels({"a": "b + 1", "b": "a + 1"})


def test_division_rules(spark):
    row = spark.createDataFrame([(10.0, 0.0)], "a double, b double").select(C.safe_div("a", "b").alias("s"), C.guarded_div("a", "b").alias("g")).first()
    assert row["s"] is None and row["g"] == pytest.approx(1_000_000)


def test_strict_threshold_drops_null(spark):
    df = spark.createDataFrame([(95.0,), (95.1,), (None,)], "c double")
    assert D.confident(df, "c").count() == 1


def test_csv_scan_with_declared_schema(spark, tmp_path):
    names = [f.name for f in tables.metadata_schema().fields]
    row = {n: "1" for n in names} | {"isic_id": "A", "patient_id": "P", "age_approx": "NA", "sex": ""}
    path = tmp_path / "m.csv"
    path.write_text(",".join(names) + "\n" + ",".join(row[n] for n in names) + "\n")
    df = tables.read_metadata(spark, str(path))
    got = df.first()
    assert got["age_approx"] is None and got["isic_id"] == "A" and got["target"] == 1
    shuffled = names[::-1]
    other = tmp_path / "shuffled.csv"
    other.write_text(",".join(shuffled) + "\n" + ",".join(row[n] for n in shuffled) + "\n")
    assert tables.read_metadata(spark, str(other), header=shuffled).first()["patient_id"] == "P"
    full = D.derive(df, D.ALL_FEATURES)
    assert len(full.columns) == len(names) + 43 and full.first()["lesion_size_ratio"] == 1.0


def test_payload_files_join_by_name(spark, tmp_path):
    for n in ("a", "b"):
        (tmp_path / f"{n}.bin").write_bytes(n.encode() * 3)
    rows = spark.createDataFrame([("a", 1)], "key string, v int")
    out = tables.attach_payload(rows, tables.read_payloads(spark, str(tmp_path)), "key").collect()
    assert [(r["key"], bytes(r["content"])) for r in out] == [("a", b"aaa")]


def test_result_files_by_glob(spark, tmp_path):
    for n in ("x_results", "Retail_results"):
        (tmp_path / f"{n}.csv").write_text("trial,value\n0,0.5\n")
    df = results.read_results(spark, str(tmp_path / "*_results.csv"), "trial int, value double", "(agriculture|retail)")
    assert df.count() == 1


def test_leaderboard_files_round_trip(spark, tmp_path):
    from raregrain.operators import trials as T
    scores = spark.createDataFrame([(t, f, "pauc_score", 0.1 * (t + 1) + 0.01 * f) for t in range(2) for f in range(5)], "trial int, fold int, metric string, value double")
    wide = results.leaderboard_table(T.leaderboard(scores), scores, list(range(5)), ["pauc_score"])
    results.write_leaderboard(wide, str(tmp_path / "b"))
    back = spark.read.option("header", True).csv(str(tmp_path / "b"))
    assert back.count() == 2 and "split3_test_pauc_score" in back.columns and "rank_test_pauc_score" in back.columns
    t = spark.createDataFrame([(0, {"model__n": "1"}), (1, {"model__n": "2"})], "trial int, params map<string,string>")
    results.write_best_params(t, T.best_trial(T.leaderboard(scores), "pauc_score"), str(tmp_path / "p"))
    assert spark.read.csv(str(tmp_path / "p")).first()[:] == ("n", "2")


def test_competition_rank(spark):
    from raregrain.operators import trials as T
    scores = spark.createDataFrame([(0, 0, "m", 0.9), (1, 0, "m", 0.9), (2, 0, "m", 0.8)], "trial int, fold int, metric string, value double")
    assert [r["place"] for r in T.leaderboard(scores).orderBy("trial").collect()] == [1, 1, 3]


def test_scaler_uses_population_std(spark):
    df = spark.createDataFrame([(1.0,), (2.0,), (3.0,), (4.0,)], "x double")
    p = P.fit_prep(df, ["x"])
    assert p.means["x"] == 2.5 and p.stds["x"] == pytest.approx(1.118034, abs=1e-6)
    assert min(r["x"] for r in p.scale(df).collect()) == pytest.approx(-1.341641, abs=1e-6)
    flat = spark.createDataFrame([(3.0,), (3.0,)], "x double")
    assert P.fit_prep(flat, ["x"]).scale(flat).first()["x"] == 0.0


def test_mode_tie_and_unknown_category(spark):
    df = spark.createDataFrame([("a",), ("b",), ("b",), ("a",), (None,)], "c string")
    p = P.fit_prep(df, [], ["c"])
    assert p.modes["c"] == "a"
    new = p.transform(spark.createDataFrame([("z",), ("b",)], "c string")).collect()
    assert [list(r["features"]) for r in new] == [[0.0, 0.0], [0.0, 1.0]]


def test_pipeline_resamples_only_while_fitting(spark):
    from pyspark.ml.classification import LogisticRegression
    rows = [(i, float(i % 7), "u" if i % 2 else "v", int(i % 10 == 0)) for i in range(100)]
    df = spark.createDataFrame(rows, "key long, x double, c string, target int")
    seen = []

    def double_minority(d):
        out = d.unionByName(d.filter("target = 1"))
        seen.append(out.count())
        return out

    model = P.fit_resampled([P.preprocessor(["x"], ["c"]), P.TrainOnly(double_minority), LogisticRegression(labelCol="target", maxIter=3)], df)
    assert seen == [110] and model.transform(df).count() == 100


def test_class_weights_by_hand(spark):
    df = spark.createDataFrame([(int(i < 2),) for i in range(10)], "target int")
    r = class_weights(df).first()
    assert (r["pos_weight"], r["weight_neg"], r["weight_pos"]) == (4.0, 1.25, 5.0)


def grouped(spark, sizes):
    rows = [(k, g, int(i < p)) for g, (n, p) in enumerate(sizes) for i, k in enumerate(range(g * 1000, g * 1000 + n))]
    return spark.createDataFrame(rows, "key long, grp long, target int")


@settings(max_examples=5, deadline=None, suppress_health_check=list(HealthCheck))
@given(st.lists(st.integers(1, 12).flatmap(lambda n: st.tuples(st.just(n), st.integers(0, n))), min_size=6, max_size=25))
def test_group_folds_keep_groups_whole_and_positives_level(spark, sizes):
    df = S.group_folds(grouped(spark, sizes), "grp", "target", 3)
    rows = df.collect()
    assert len(rows) == sum(n for n, _ in sizes)
    assert all(len({r["fold"] for r in rows if r["grp"] == g}) == 1 for g in {r["grp"] for r in rows})
    per = [sum(r["target"] for r in rows if r["fold"] == f) for f in range(3)]
    assert max(per) - min(per) <= max(p for _, p in sizes) or max(per) == 0


def test_group_holdout_sizes(spark):
    df = grouped(spark, [(3, 3 if g < 4 else 0) for g in range(20)])
    rows = S.group_holdout(df, "key", "grp", "target", 0.75).collect()
    val = {r["grp"] for r in rows if r["split"] == "val"}
    assert len(val) == 5 and len([g for g in val if g < 4]) == 1
    assert not val & {r["grp"] for r in rows if r["split"] == "train"}


@settings(max_examples=6, deadline=None, suppress_health_check=list(HealthCheck))
@given(st.lists(st.floats(-50, 50), min_size=1, max_size=60), st.floats(0, 1))
def test_exact_quantile_with_narrowing(spark, values, q):
    import numpy as np
    df = spark.createDataFrame([(float(v),) for v in values], "x double")
    want = float(np.quantile(values, q))
    assert R.exact_quantiles(df, {"x": q})["x"] == pytest.approx(want, abs=1e-9)
    rank = int(q * (len(values) - 1))
    assert R.order_statistic(df, "x", rank, gather=3) == sorted(values)[rank]


def test_order_statistic_with_a_hot_value(spark):
    values = [5.0] * 400 + [5.5] * 3 + [1.0, 9.0, 7.0]
    df = spark.createDataFrame([(v,) for v in values], "x double")
    for rank in (0, 1, 200, 400, 401, 403, 404, 405):
        assert R.order_statistic(df, "x", rank, gather=2) == sorted(values)[rank]


def test_lowest_values_cut_inside_ties(spark):
    from raregrain.operators.resample import lowest_values
    df = spark.createDataFrame([(i, float(i % 3 > 0), f"k{i}") for i in range(60)], "key long, x double, name string")
    assert {r["key"] for r in lowest_values(df, "x", "key", 30).collect()} == {i for i in range(60) if i % 3 == 0} | {1, 2, 4, 5, 7, 8, 10, 11, 13, 14}
    assert lowest_values(df, "x", "name", 30).count() == 30 and lowest_values(df, "x", "key", 99).count() == 60


def test_value_bucket_matches_bisect(spark):
    borders = [0.5, 1.0, 2.5, 7.0, 7.5]
    values = [-1.0, 0.5, 0.7, 1.0, 3.0, 7.0, 7.2, 7.5, 9.0]
    df = spark.createDataFrame([(v,) for v in values], "v double")
    assert [r["b"] for r in df.select(R.value_bucket("v", borders).alias("b")).collect()] == [R.bucket_of(v, borders) for v in values]


def test_hash_rank_and_take_hashed_agree(spark):
    df = spark.range(500).select(F.col("id").alias("key"), (F.col("id") % 3).cast("int").alias("s"))
    ranked = {r["key"]: r["rank"] for r in R.hash_rank(df, "key", 7, ["s"]).collect()}
    assert sorted(ranked[k] for k in range(0, 500, 3)) == list(range(1, 168))
    quota = spark.createDataFrame([(0, 10), (1, 0), (2, 10_000)], "s int, quota bigint")
    kept = {r["key"] for r in R.take_hashed(df, "key", 7, quota, ["s"]).collect()}
    assert kept == {k for k in range(500) if (k % 3 == 0 and ranked[k] <= 10) or k % 3 == 2}
    flags = R.take_hashed(df, "key", 7, quota, ["s"], flag="f").collect()
    assert len(flags) == 500 and {r["key"] for r in flags if r["f"]} == kept


def test_join_by_key_gives_the_same_rows_whichever_way_it_goes(spark):
    from raregrain.session import join_by_key
    df = spark.createDataFrame([(i, "hot" if i % 3 else f"k{i % 20}") for i in range(200)] + [(900, None)], "i int, g string")
    side = df.groupBy("g").agg(F.count(F.lit(1)).alias("n"))
    want = sorted(df.join(side, "g").collect())
    for small, hot in ((100, 1), (0, 50), (0, 10_000)):
        assert sorted(join_by_key(df, side, ["g"], "n", small, hot).collect()) == want
