"""Scans, projections, filters, joins, aggregates, sorts, set operations, scalar functions."""
from __future__ import annotations

from pyspark.sql import functions as F

from raregrain.catalog.fixtures import CASES, NULLS, SCORED, TYPE_CODE, VECS, cases, docs, nulls, query, r6, scored, table, vecs
from raregrain.functions import columns as C
from raregrain.operators import derive as D
from raregrain.operators import prep as P
from raregrain.operators.weights import class_counts, class_weights, with_weight

# ---- derived features on line items standing in for measurements ----
# each measurement name is bound to a shape over line-item columns
BIND = {
    "clin_size_long_diam_mm": "l_quantity", "age_approx": "l_discount * 100", "tbp_lv_A": "l_quantity / 2",
    "tbp_lv_Aext": "l_tax * 10", "tbp_lv_B": "l_discount", "tbp_lv_Bext": "l_tax", "tbp_lv_H": "l_quantity",
    "tbp_lv_Hext": "l_discount * 10", "tbp_lv_L": "l_extendedprice / 1000", "tbp_lv_Lext": "l_tax * 100",
    "tbp_lv_areaMM2": "l_extendedprice / 100", "tbp_lv_area_perim_ratio": "l_quantity / 10",
    "tbp_lv_color_std_mean": "l_tax", "tbp_lv_deltaA": "l_discount", "tbp_lv_deltaB": "l_tax",
    "tbp_lv_deltaL": "l_quantity / 10", "tbp_lv_deltaLBnorm": "l_discount * 2", "tbp_lv_eccentricity": "l_tax * 3",
    "tbp_lv_minorAxisMM": "l_quantity / 4", "tbp_lv_nevi_confidence": "l_quantity", "tbp_lv_norm_border": "l_discount * 5",
    "tbp_lv_norm_color": "l_tax * 5", "tbp_lv_perimeterMM": "l_quantity", "tbp_lv_radial_color_std_max": "l_discount",
    "tbp_lv_stdL": "l_tax * 2", "tbp_lv_stdLExt": "l_discount * 3", "tbp_lv_symm_2axis": "l_discount * 4",
    "tbp_lv_x": "l_quantity - 25", "tbp_lv_y": "l_discount * 100 - 5", "tbp_lv_z": "l_tax * 100",
}
ROW_ID = ["l_orderkey", "l_partkey", "l_suppkey", "l_linenumber"]
BOUND = ("bound as (select l_orderkey, l_partkey, l_suppkey, l_linenumber, l_returnflag as anatom_site_general, l_linestatus as tbp_lv_location, "
         + ", ".join(f"({e})::double as {n}" for n, e in BIND.items()) + " from lineitem)")


def measured(spark, sf):
    exprs = [f"cast({e} as double) as {n}" for n, e in BIND.items()]
    return table(spark, sf, "lineitem").selectExpr(
        *ROW_ID, "l_returnflag as anatom_site_general", "l_linestatus as tbp_lv_location", *exprs)


DSQ = "deltaA * tbp_lv_deltaA + tbp_lv_deltaB * tbp_lv_deltaB + tbp_lv_deltaL * tbp_lv_deltaL"
FEATURE_SQL = {
    "lesion_size_ratio": "tbp_lv_minorAxisMM / nullif(clin_size_long_diam_mm, 0)",
    "lesion_shape_index": "tbp_lv_areaMM2 / nullif(tbp_lv_perimeterMM * tbp_lv_perimeterMM, 0)",
    "hue_contrast": "abs(tbp_lv_H - tbp_lv_Hext)",
    "luminance_contrast": "abs(tbp_lv_L - tbp_lv_Lext)",
    "lesion_color_difference": f"sqrt(tbp_lv_{DSQ})",
    "border_complexity": "tbp_lv_norm_border + tbp_lv_symm_2axis",
    "color_uniformity": "tbp_lv_color_std_mean / (tbp_lv_radial_color_std_max + 1e-5)",
    "position_distance_3d": "sqrt(tbp_lv_x * tbp_lv_x + tbp_lv_y * tbp_lv_y + tbp_lv_z * tbp_lv_z)",
    "perimeter_to_area_ratio": "tbp_lv_perimeterMM / nullif(tbp_lv_areaMM2, 0)",
    "area_to_perimeter_ratio": "tbp_lv_areaMM2 / nullif(tbp_lv_perimeterMM, 0)",
    "lesion_visibility_score": "tbp_lv_deltaLBnorm + tbp_lv_norm_color",
    "symmetry_border_consistency": "tbp_lv_symm_2axis * tbp_lv_norm_border",
    "consistency_symmetry_border": "tbp_lv_symm_2axis * tbp_lv_norm_border / nullif(tbp_lv_symm_2axis + tbp_lv_norm_border, 0)",
    "color_consistency": "tbp_lv_stdL / nullif(tbp_lv_Lext, 0)",
    "consistency_color": "tbp_lv_stdL * tbp_lv_Lext / nullif(tbp_lv_stdL + tbp_lv_Lext, 0)",
    "size_age_interaction": "clin_size_long_diam_mm * age_approx",
    "hue_color_std_interaction": "tbp_lv_H * tbp_lv_color_std_mean",
    "lesion_severity_index": "(tbp_lv_norm_border + tbp_lv_norm_color + tbp_lv_eccentricity) / 3",
    "shape_complexity_index": "tbp_lv_norm_border + tbp_lv_symm_2axis + tbp_lv_areaMM2 / nullif(tbp_lv_perimeterMM * tbp_lv_perimeterMM, 0)",
    "color_contrast_index": "tbp_lv_deltaA + tbp_lv_deltaB + tbp_lv_deltaL + tbp_lv_deltaLBnorm",
    "log_lesion_area": "ln(tbp_lv_areaMM2 + 1)",
    "normalized_lesion_size": "clin_size_long_diam_mm / nullif(age_approx, 0)",
    "mean_hue_difference": "(tbp_lv_H + tbp_lv_Hext) / 2",
    "std_dev_contrast": f"sqrt((tbp_lv_{DSQ}) / 3)",
    "color_shape_composite_index": "(tbp_lv_color_std_mean + tbp_lv_area_perim_ratio + tbp_lv_symm_2axis) / 3",
    "lesion_orientation_3d": "atan2(tbp_lv_y, tbp_lv_x)",
    "overall_color_difference": "(tbp_lv_deltaA + tbp_lv_deltaB + tbp_lv_deltaL) / 3",
    "symmetry_perimeter_interaction": "tbp_lv_symm_2axis * tbp_lv_perimeterMM",
    "comprehensive_lesion_index": "(tbp_lv_area_perim_ratio + tbp_lv_eccentricity + tbp_lv_norm_color + tbp_lv_symm_2axis) / 4",
    "color_variance_ratio": "tbp_lv_color_std_mean / nullif(tbp_lv_stdLExt, 0)",
    "border_color_interaction": "tbp_lv_norm_border * tbp_lv_norm_color",
    "border_color_interaction_2": "tbp_lv_norm_border * tbp_lv_norm_color / nullif(tbp_lv_norm_border + tbp_lv_norm_color, 0)",
    "size_color_contrast_ratio": "clin_size_long_diam_mm / nullif(tbp_lv_deltaLBnorm, 0)",
    "age_normalized_nevi_confidence": "tbp_lv_nevi_confidence / nullif(age_approx, 0)",
    "age_normalized_nevi_confidence_2": "sqrt(clin_size_long_diam_mm * clin_size_long_diam_mm + age_approx * age_approx)",
    "color_asymmetry_index": "tbp_lv_radial_color_std_max * tbp_lv_symm_2axis",
    "volume_approximation_3d": "tbp_lv_areaMM2 * sqrt(tbp_lv_x * tbp_lv_x + tbp_lv_y * tbp_lv_y + tbp_lv_z * tbp_lv_z)",
    "color_range": "abs(tbp_lv_L - tbp_lv_Lext) + abs(tbp_lv_A - tbp_lv_Aext) + abs(tbp_lv_B - tbp_lv_Bext)",
    "shape_color_consistency": "tbp_lv_eccentricity * tbp_lv_color_std_mean",
    "border_length_ratio": "tbp_lv_perimeterMM / nullif(2 * pi() * sqrt(tbp_lv_areaMM2 / pi()), 0)",
    "age_size_symmetry_index": "age_approx * clin_size_long_diam_mm * tbp_lv_symm_2axis",
    "index_age_size_symmetry": "age_approx * tbp_lv_areaMM2 * tbp_lv_symm_2axis",
}
GROUPS = {
    "derived_ratios": ["lesion_size_ratio", "lesion_shape_index", "perimeter_to_area_ratio", "area_to_perimeter_ratio",
                       "color_consistency", "normalized_lesion_size", "color_uniformity", "color_variance_ratio",
                       "size_color_contrast_ratio", "age_normalized_nevi_confidence", "border_length_ratio"],
    "derived_contrasts": ["hue_contrast", "luminance_contrast", "lesion_color_difference", "color_contrast_index",
                          "mean_hue_difference", "std_dev_contrast", "overall_color_difference", "color_range",
                          "lesion_visibility_score"],
    "derived_interactions": ["symmetry_border_consistency", "consistency_symmetry_border", "consistency_color",
                             "size_age_interaction", "hue_color_std_interaction", "symmetry_perimeter_interaction",
                             "border_color_interaction", "border_color_interaction_2", "color_asymmetry_index",
                             "shape_color_consistency", "age_size_symmetry_index", "index_age_size_symmetry"],
    "derived_composites": ["border_complexity", "position_distance_3d", "lesion_severity_index", "shape_complexity_index",
                           "log_lesion_area", "color_shape_composite_index", "lesion_orientation_3d",
                           "comprehensive_lesion_index", "age_normalized_nevi_confidence_2", "volume_approximation_3d"],
}


def _feature_query(names):
    def run(spark, sf):
        df = D.derive(measured(spark, sf), D.ALL_FEATURES)
        return df.select(*ROW_ID, *[C.round6(n).alias(n) for n in names])
    return run


for _name, _cols in GROUPS.items():
    _sql = f"with {BOUND} select {', '.join(ROW_ID)}, " + ", ".join(f"{r6(FEATURE_SQL[c])} as {c}" for c in _cols) + " from bound"
    query(_name, _sql)(_feature_query(_cols))


@query("derived_site_text", f"with {BOUND} select anatom_site_general || '_' || tbp_lv_location as combined_anatomical_site, count(*) as n from bound group by 1")
def derived_site(spark, sf):
    return D.derive(measured(spark, sf), D.EXTRA_FEATURES).groupBy("combined_anatomical_site").agg(F.count(F.lit(1)).alias("n"))


# ---- sources ----
@query("feature_label_group", f"with {CASES} select event_id, user_id, target, value, k, hr from cases")
def feature_label_group(spark, sf):
    return D.labelled(cases(spark, sf), ["value", "k", "hr"], "event_id", "user_id", "target")


@query("text_na_to_null", f"""with {NULLS}, t as (select event_id, coalesce(value::varchar, 'NA') as v from nulls)
  select event_id, case when v <> 'NA' then v::double end as value from t""")
def text_na_to_null(spark, sf):
    from raregrain.sources.tables import na_to_null
    text = nulls(spark, sf).select("event_id", F.coalesce(F.col("value").cast("string"), F.lit("NA")).alias("value"))
    return na_to_null(text, ["value"])


@query("rows_with_payload", "select doc_id, toxic, length(text)::bigint as payload_size from labels join documents using (doc_id)")
def rows_with_payload(spark, sf):
    from raregrain.sources.tables import attach_payload
    out = attach_payload(table(spark, sf, "labels"), table(spark, sf, "documents").select("doc_id", "text"), "doc_id")
    return out.select("doc_id", "toxic", F.length("text").cast("bigint").alias("payload_size"))


@query("drop_leak_columns", f"with {CASES} select event_id, user_id, target, value, k, hr, code from cases")
def drop_leak(spark, sf):
    return cases(spark, sf).drop("event_type")


@query("ordered_feature_subset", f"with {CASES} select hr, k, value from cases")
def ordered_subset(spark, sf):
    return cases(spark, sf).select("hr", "k", "value")


@query("label_recode", f"with {CASES} select event_id, case when target = 0 then -1 else target end::int as target from cases")
def label_recode(spark, sf):
    return D.recode_label(cases(spark, sf), "target").select("event_id", "target")


@query("named_matrix_columns", f"with {VECS} select key, {', '.join(r6(f'vec[{i}]') + f' as v{i}' for i in range(1, 65))} from vecs")
def named_matrix(spark, sf):
    names = [f"v{i}" for i in range(1, 65)]
    out = P.named_columns(vecs(spark, sf), "vec", names)
    return out.select("key", *[C.round6(c).alias(c) for c in names])


@query("matrix_columns_by_index", f"with {VECS} select key, {r6('vec[6]')} as first, {r6('vec[1]')} as second, {r6('vec[64]')} as third from vecs")
def matrix_by_index(spark, sf):
    v = vecs(spark, sf).select("key", C.pick("vec", [5, 0, 63]).alias("p"))
    return v.select("key", *[C.round6(F.col("p")[i]).alias(n) for i, n in enumerate(["first", "second", "third"])])


@query("weighted_columns", f"with {VECS}, w as (select key, list_transform(vec, lambda x, i: x * sqrt(i / 64.0::double)) as v from vecs) select key, {r6('list_sum(v)')} as total, {r6('v[10]')} as tenth from w")
def weighted_columns(spark, sf):
    weights = F.array(*[F.sqrt(F.lit(i / 64.0)) for i in range(1, 65)])
    v = vecs(spark, sf).select("key", C.weigh("vec", weights).alias("v"))
    return v.select("key", C.round6(F.aggregate("v", F.lit(0.0), lambda s, x: s + x)).alias("total"), C.round6(F.col("v")[9]).alias("tenth"))


# ---- filters ----
@query("confidence_filter", f"with {NULLS} select event_id, value from nulls where value > 95")
def confidence_filter(spark, sf):
    return D.confident(nulls(spark, sf), "value", 95).select("event_id", "value")


@query("threshold_cascade", f"""with {CASES} select t::double as threshold, count(*) filter (value > t) as n_rows,
  coalesce(sum(target) filter (value > t), 0)::bigint as n_positive from cases, (values (70), (90), (95)) x(t) group by t""")
def cascade(spark, sf):
    return D.threshold_cascade(cases(spark, sf), "value", [70, 90, 95], "target")


@query("label_filter", f"with {CASES} select target, count(*) as n, {r6('avg(value)')} as mean_value from cases where target <> 0 group by target union all select target, count(*), {r6('avg(value)')} from cases where target = 0 group by target")
def label_filter(spark, sf):
    c = cases(spark, sf)
    def side(rows):
        return rows.groupBy("target").agg(F.count(F.lit(1)).alias("n"), C.round6(F.avg("value")).alias("mean_value"))
    return side(c.filter(F.col("target") != 0)).unionByName(side(c.filter(F.col("target") == 0)))


@query("member_filter", f"with {CASES} select event_id from cases where user_id in (select user_id from cases where target = 1)")
def member_filter(spark, sf):
    c = cases(spark, sf)
    return c.join(c.filter("target = 1").select("user_id"), "user_id", "left_semi").select("event_id")


@query("finite_scores_only", f"with {SCORED}, m as (select trial, fold, sum(target * pred)::double / nullif(sum(pred), 0) as v from scored group by all) select trial, fold, {r6('v')} as v from m where v is not null and not isnan(v)")
def finite_scores(spark, sf):
    from raregrain.sources.results import finite_only
    m = scored(spark, sf).groupBy("trial", "fold").agg(F.try_divide(F.sum(F.col("target") * F.col("pred")).cast("double"), F.sum("pred").cast("double")).alias("v"))
    return finite_only(m, "v").select("trial", "fold", C.round6("v").alias("v"))


# ---- joins, sets ----
@query("rows_by_group_side", f"""with {CASES}, g as (select distinct user_id from cases where user_id % 5 = 0)
  select 'in' as side, count(*) as n, sum(target)::bigint as pos from cases where user_id in (select user_id from g)
  union all select 'out', count(*), sum(target)::bigint from cases where user_id not in (select user_id from g)""")
def rows_by_side(spark, sf):
    c = cases(spark, sf)
    g = c.select("user_id").distinct().filter(F.col("user_id") % 5 == 0)
    def side(df, name):
        return df.agg(F.count(F.lit(1)).alias("n"), F.sum("target").cast("bigint").alias("pos")).select(F.lit(name).alias("side"), "n", "pos")
    return side(c.join(g, "user_id", "left_semi"), "in").unionByName(side(c.join(g, "user_id", "left_anti"), "out"))


@query("group_first_label", f"with {CASES} select user_id, arg_min(target, event_id) as group_label from cases group by user_id")
def group_first_label(spark, sf):
    from raregrain.operators.splits import group_labels
    return group_labels(cases(spark, sf), "event_id", "user_id", "target")


@query("row_joins_group_label", f"""with {CASES}, g as (select user_id, arg_min(target, event_id) as group_label from cases group by user_id)
  select event_id, target, group_label from cases join g using (user_id)""")
def row_group_label(spark, sf):
    from raregrain.operators.splits import group_labels
    c = cases(spark, sf)
    return c.join(group_labels(c, "event_id", "user_id", "target"), "user_id").select("event_id", "target", "group_label")


@query("union_minority_sample", f"with {CASES} select event_id, target from cases where target = 1 union all select event_id, target from cases where target = 1 union all select event_id, target from cases where target = 0 and value > 100")
def union_bag(spark, sf):
    c = cases(spark, sf).select("event_id", "target", "value")
    pos = c.filter("target = 1")
    return pos.unionByName(pos).unionByName(c.filter("target = 0 and value > 100")).drop("value")


@query("difference_of_rows", f"with {CASES} select event_id from cases where event_id not in (select event_id from cases where target = 1)")
def difference(spark, sf):
    c = cases(spark, sf).select("event_id", "target")
    return c.join(c.filter("target = 1").select("event_id"), "event_id", "left_anti").select("event_id")


@query("fused_vector_and_metadata", f"""with f as (select vec_id, embedding::double[] as v, n_chars, (lang = 'en')::int as is_en from embeddings join documents on vec_id = doc_id)
  select vec_id, (len(v) + 2)::int as width, {r6('list_sum(v) + n_chars / 1000.0::double + is_en')} as total from f""")
def fused(spark, sf):
    from raregrain.operators.learners import fuse
    meta = table(spark, sf, "documents").select(F.col("doc_id").alias("vec_id"), (F.col("n_chars") / F.lit(1000.0)).alias("size"), (F.col("lang") == "en").cast("double").alias("is_en"))
    emb = table(spark, sf, "embeddings").select("vec_id", F.col("embedding").cast("array<double>").alias("vec"))
    out = fuse(emb, meta, "vec_id", "vec", ["size", "is_en"])
    return out.select("vec_id", F.size("features").alias("width"), C.round6(F.aggregate("features", F.lit(0.0), lambda s, x: s + x)).alias("total"))


# ---- aggregates ----
@query("rows_and_positives", f"with {CASES} select count(*) as n_rows, sum(target)::bigint as n_positive from cases")
def rows_and_positives(spark, sf):
    return cases(spark, sf).agg(F.count(F.lit(1)).alias("n_rows"), F.sum("target").cast("bigint").alias("n_positive"))


@query("class_counts_rarest", f"with {CASES} select count(*) filter (target = 0) as n_neg, count(*) filter (target = 1) as n_pos, case when n_pos < n_neg then 1 else 0 end as rarest from cases")
def counts(spark, sf):
    return class_counts(cases(spark, sf))


@query("distinct_groups", f"with {CASES} select distinct user_id from cases")
def distinct_groups(spark, sf):
    return cases(spark, sf).select("user_id").distinct()


@query("class_weight_pairs", f"""with {CASES}, c as (select count(*) filter (target = 0)::double as a, count(*) filter (target = 1)::double as b from cases)
  select {r6('a / b')} as pos_weight, {r6('(a + b) / a')} as weight_neg, {r6('(a + b) / b')} as weight_pos, {r6('(a + b) / (2 * a)')} as balanced_neg, {r6('(a + b) / (2 * b)')} as balanced_pos from c""")
def weights(spark, sf):
    cols = ["pos_weight", "weight_neg", "weight_pos", "balanced_neg", "balanced_pos"]
    return class_weights(cases(spark, sf)).select(*[C.round6(c).alias(c) for c in cols])


@query("balanced_row_weights", f"""with {CASES}, n as (select target, count(*) as c from cases group by 1)
  select event_id, {r6('(select count(*) from cases) / (2.0::double * c)')} as weight, case when target = 1 then 50.0::double else 1.0::double end as mapped from cases join n using (target)""")
def row_weights(spark, sf):
    w = with_weight(with_weight(cases(spark, sf)), scheme={0: 1, 1: 50}, name="mapped")
    return w.select("event_id", C.round6("weight").alias("weight"), "mapped")


@query("column_statistics", f"""with {NULLS} select c as "column", {r6('avg(v)')} as mean, {r6('median(v)')} as median, {r6('stddev_pop(v)')} as std
  from (select 'value' as c, value as v from nulls union all select 'k', k from nulls union all select 'hr', hr from nulls) group by c""")
def column_statistics(spark, sf):
    return P.column_stats(nulls(spark, sf), ["value", "k", "hr"]).select("column", *[C.round6(c).alias(c) for c in ("mean", "median", "std")])


@query("column_modes", f"""with {NULLS}, l as (select 'event_type' as c, event_type as v from nulls union all select 'code', code::varchar from nulls),
  n as (select c, v, count(*) as n from l where v is not null group by all)
  select c as "column", v as mode, n from n qualify row_number() over (partition by c order by n desc, v) = 1""")
def modes(spark, sf):
    return P.column_modes(nulls(spark, sf), ["event_type", "code"])


@query("group_statistics", f"with {CASES} select user_id, {r6('avg(value)')} as mean_value, {r6('stddev_samp(value)')} as std_value, count(*) as n from cases group by user_id")
def group_statistics(spark, sf):
    return cases(spark, sf).groupBy("user_id").agg(C.round6(F.avg("value")).alias("mean_value"), C.round6(F.stddev_samp("value")).alias("std_value"), F.count(F.lit(1)).alias("n"))


@query("group_normalised_columns", f"""with g as (select l_suppkey, count(*) as count_per_group, avg(l_quantity) as mq, stddev_samp(l_quantity) as sq, avg(l_tax) as mt, stddev_samp(l_tax) as st from lineitem group by 1)
  select {', '.join(ROW_ID)}, count_per_group, {r6('(l_quantity - mq) / (sq + 1e-5)')} as l_quantity_group_norm, {r6('(l_tax - mt) / (st + 1e-5)')} as l_tax_group_norm from lineitem join g using (l_suppkey)""")
def normalised(spark, sf):
    out = D.group_normalise(table(spark, sf, "lineitem").select(*ROW_ID, "l_quantity", "l_tax"), ["l_quantity", "l_tax"], "l_suppkey")
    return out.select(*ROW_ID, "count_per_group", *[C.round6(c).alias(c) for c in ("l_quantity_group_norm", "l_tax_group_norm")])


# ---- sorts ----
@query("first_keys", "select vec_id from embeddings order by vec_id limit 10")
def first_keys(spark, sf):
    return table(spark, sf, "embeddings").select("vec_id").orderBy("vec_id").limit(10)


# ---- scalar functions ----
@query("scalar_math", f"""select {', '.join(ROW_ID)}, {r6('abs(l_tax - l_discount)')} as f_abs, {r6('sqrt(l_quantity)')} as f_sqrt, {r6('power(l_quantity, 1.5::double)')} as f_pow,
  {r6('ln(l_quantity + 1)')} as f_ln, {r6('atan2(l_tax, l_discount)')} as f_atan, {r6('exp(-l_quantity / 10)')} as f_exp, {r6('1 / (1 + exp(-(l_quantity - 25) / 10))')} as f_sigmoid,
  {r6('ln(exp(l_tax) + exp(l_discount))')} as f_lse, {r6('greatest(l_discount - 0.05::double, 0)')} as f_clamp, {r6('l_quantity / (l_discount + 1e-5)')} as f_guarded, {r6('l_quantity / nullif(l_discount, 0)')} as f_safe,
  case when l_tax - l_discount > 0 then floor((l_tax - l_discount) * 50 + 0.5::double) else ceil((l_tax - l_discount) * 50 - 0.5::double) end::int as f_round from lineitem""")
def scalar_math(spark, sf):
    li = table(spark, sf, "lineitem")
    q, t, d = F.col("l_quantity"), F.col("l_tax"), F.col("l_discount")
    exprs = {"f_abs": F.abs(t - d), "f_sqrt": F.sqrt(q), "f_pow": F.pow(q, F.lit(1.5)), "f_ln": F.log(q + 1), "f_atan": F.atan2(t, d),
             "f_exp": F.exp(-q / 10), "f_sigmoid": C.sigmoid((q - 25) / 10), "f_lse": C.log_sum_exp(t, d),
             "f_clamp": C.clamp_floor(d - F.lit(0.05), 0.0), "f_guarded": C.guarded_div(q, d), "f_safe": C.safe_div(q, d)}
    return li.select(*ROW_ID, *[C.round6(e).alias(n) for n, e in exprs.items()], C.round_half_away((t - d) * 50).alias("f_round"))


@query("text_functions", """select o_orderkey, concat_ws('_', o_orderstatus, o_orderpriority) as joined, replace('model__' || o_orderpriority, 'model__', '') as bare,
  contains(o_orderpriority, 'HIGH') as has_high, regexp_matches(o_orderpriority, '(urgent|low)', 'i') as excluded from orders""")
def text_functions(spark, sf):
    p = F.col("o_orderpriority")
    return table(spark, sf, "orders").select("o_orderkey", F.concat_ws("_", "o_orderstatus", p).alias("joined"), C.bare_param_name(F.concat(F.lit("model__"), p)).alias("bare"),
                                             F.contains(p, F.lit("HIGH")).alias("has_high"), p.rlike("(?i)(urgent|low)").alias("excluded"))


@query("array_arithmetic", f"with {VECS} select key, {r6('list_sum(list_transform(vec, lambda x: x * x))')} as sq, {r6('list_sum(list_transform(vec, lambda x, i: x * x * i))')} as weighted from vecs")
def array_arithmetic(spark, sf):
    idx = F.sequence(F.lit(1.0).cast("int"), F.lit(64))
    v = vecs(spark, sf)
    return v.select("key", C.round6(C.dot("vec", "vec")).alias("sq"), C.round6(C.dot(C.squares("vec"), idx.cast("array<double>"))).alias("weighted"))


@query("bce_rows", f"with {SCORED} select trial, event_id, {r6('3 * target * ln(1 + exp(-logit)) + (1 - target) * ln(1 + exp(logit))')} as bce from scored")
def bce_rows(spark, sf):
    from raregrain.operators.losses import bce_per_row
    return scored(spark, sf).select("trial", "event_id", C.round6(bce_per_row(pos_weight=3.0)).alias("bce"))
