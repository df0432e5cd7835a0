"""Row-wise features, declared as name -> expression and applied level by level."""
from __future__ import annotations

import re

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from raregrain.functions.columns import EPS
from raregrain.session import join_by_key

# Column names and formulas of the measurement table.
NUMERIC_COLUMNS = [
    "clin_size_long_diam_mm", "age_approx", "tbp_lv_A", "tbp_lv_Aext", "tbp_lv_B", "tbp_lv_Bext",
    "tbp_lv_C", "tbp_lv_Cext", "tbp_lv_H", "tbp_lv_Hext", "tbp_lv_L", "tbp_lv_Lext",
    "tbp_lv_areaMM2", "tbp_lv_area_perim_ratio", "tbp_lv_color_std_mean", "tbp_lv_deltaA",
    "tbp_lv_deltaB", "tbp_lv_deltaL", "tbp_lv_deltaLB", "tbp_lv_deltaLBnorm",
    "tbp_lv_eccentricity", "tbp_lv_minorAxisMM", "tbp_lv_nevi_confidence", "tbp_lv_norm_border",
    "tbp_lv_norm_color", "tbp_lv_perimeterMM", "tbp_lv_radial_color_std_max", "tbp_lv_stdL",
    "tbp_lv_stdLExt", "tbp_lv_symm_2axis", "tbp_lv_symm_2axis_angle",
]
POSITION_COLUMNS = ["tbp_lv_x", "tbp_lv_y", "tbp_lv_z"]
CATEGORICAL_COLUMNS = ["sex", "anatom_site_general", "tbp_tile_type", "tbp_lv_location", "tbp_lv_location_simple"]
LEAK_COLUMNS = ["lesion_id", "iddx_1", "iddx_2", "iddx_3", "iddx_4", "iddx_5", "iddx_full",
                "mel_mitotic_index", "mel_thick_mm", "tbp_lv_dnn_lesion_confidence"]

BASE_FEATURES = {
    "lesion_size_ratio": "try_divide(tbp_lv_minorAxisMM, clin_size_long_diam_mm)",
    "lesion_shape_index": "try_divide(tbp_lv_areaMM2, tbp_lv_perimeterMM * tbp_lv_perimeterMM)",
    "hue_contrast": "abs(tbp_lv_H - tbp_lv_Hext)",
    "luminance_contrast": "abs(tbp_lv_L - tbp_lv_Lext)",
    "lesion_color_difference":
        "sqrt(tbp_lv_deltaA * tbp_lv_deltaA + tbp_lv_deltaB * tbp_lv_deltaB + tbp_lv_deltaL * tbp_lv_deltaL)",
    "border_complexity": "tbp_lv_norm_border + tbp_lv_symm_2axis",
    "color_uniformity": f"tbp_lv_color_std_mean / (tbp_lv_radial_color_std_max + {EPS}D)",
    "position_distance_3d": "sqrt(tbp_lv_x * tbp_lv_x + tbp_lv_y * tbp_lv_y + tbp_lv_z * tbp_lv_z)",
    "perimeter_to_area_ratio": "try_divide(tbp_lv_perimeterMM, tbp_lv_areaMM2)",
    "area_to_perimeter_ratio": "try_divide(tbp_lv_areaMM2, tbp_lv_perimeterMM)",
    "lesion_visibility_score": "tbp_lv_deltaLBnorm + tbp_lv_norm_color",
    "symmetry_border_consistency": "tbp_lv_symm_2axis * tbp_lv_norm_border",
    "consistency_symmetry_border":
        "try_divide(tbp_lv_symm_2axis * tbp_lv_norm_border, tbp_lv_symm_2axis + tbp_lv_norm_border)",
    "color_consistency": "try_divide(tbp_lv_stdL, tbp_lv_Lext)",
    "consistency_color": "try_divide(tbp_lv_stdL * tbp_lv_Lext, tbp_lv_stdL + tbp_lv_Lext)",
    "size_age_interaction": "clin_size_long_diam_mm * age_approx",
    "hue_color_std_interaction": "tbp_lv_H * tbp_lv_color_std_mean",
    "lesion_severity_index": "(tbp_lv_norm_border + tbp_lv_norm_color + tbp_lv_eccentricity) / 3",
    "shape_complexity_index": "border_complexity + lesion_shape_index",
    "color_contrast_index": "tbp_lv_deltaA + tbp_lv_deltaB + tbp_lv_deltaL + tbp_lv_deltaLBnorm",
    "log_lesion_area": "ln(tbp_lv_areaMM2 + 1)",
    "normalized_lesion_size": "try_divide(clin_size_long_diam_mm, age_approx)",
    "mean_hue_difference": "(tbp_lv_H + tbp_lv_Hext) / 2",
    "std_dev_contrast":
        "sqrt((tbp_lv_deltaA * tbp_lv_deltaA + tbp_lv_deltaB * tbp_lv_deltaB + tbp_lv_deltaL * tbp_lv_deltaL) / 3)",
    "color_shape_composite_index":
        "(tbp_lv_color_std_mean + tbp_lv_area_perim_ratio + tbp_lv_symm_2axis) / 3",
    "lesion_orientation_3d": "atan2(tbp_lv_y, tbp_lv_x)",
    "overall_color_difference": "(tbp_lv_deltaA + tbp_lv_deltaB + tbp_lv_deltaL) / 3",
}
EXTRA_FEATURES = {
    "combined_anatomical_site": "concat(anatom_site_general, '_', tbp_lv_location)",
    "symmetry_perimeter_interaction": "tbp_lv_symm_2axis * tbp_lv_perimeterMM",
    "comprehensive_lesion_index":
        "(tbp_lv_area_perim_ratio + tbp_lv_eccentricity + tbp_lv_norm_color + tbp_lv_symm_2axis) / 4",
    "color_variance_ratio": "try_divide(tbp_lv_color_std_mean, tbp_lv_stdLExt)",
    "border_color_interaction": "tbp_lv_norm_border * tbp_lv_norm_color",
    "border_color_interaction_2":
        "try_divide(tbp_lv_norm_border * tbp_lv_norm_color, tbp_lv_norm_border + tbp_lv_norm_color)",
    "size_color_contrast_ratio": "try_divide(clin_size_long_diam_mm, tbp_lv_deltaLBnorm)",
    "age_normalized_nevi_confidence": "try_divide(tbp_lv_nevi_confidence, age_approx)",
    "age_normalized_nevi_confidence_2":
        "sqrt(clin_size_long_diam_mm * clin_size_long_diam_mm + age_approx * age_approx)",
    "color_asymmetry_index": "tbp_lv_radial_color_std_max * tbp_lv_symm_2axis",
    "volume_approximation_3d":
        "tbp_lv_areaMM2 * sqrt(tbp_lv_x * tbp_lv_x + tbp_lv_y * tbp_lv_y + tbp_lv_z * tbp_lv_z)",
    "color_range":
        "abs(tbp_lv_L - tbp_lv_Lext) + abs(tbp_lv_A - tbp_lv_Aext) + abs(tbp_lv_B - tbp_lv_Bext)",
    "shape_color_consistency": "tbp_lv_eccentricity * tbp_lv_color_std_mean",
    "border_length_ratio": "try_divide(tbp_lv_perimeterMM, 2 * pi() * sqrt(tbp_lv_areaMM2 / pi()))",
    "age_size_symmetry_index": "age_approx * clin_size_long_diam_mm * tbp_lv_symm_2axis",
    "index_age_size_symmetry": "age_approx * tbp_lv_areaMM2 * tbp_lv_symm_2axis",
}
ALL_FEATURES = {**BASE_FEATURES, **EXTRA_FEATURES}


def levels(spec: dict[str, str]) -> list[dict[str, str]]:
    """Group a feature spec by dependency: a feature comes after the features it names."""
    needs = {n: {w for w in re.findall(r"[A-Za-z_]\w*", e) if w in spec and w != n} for n, e in spec.items()}
    done: set[str] = set()
    out = []
    while len(done) < len(spec):
        ready = [n for n in spec if n not in done and needs[n] <= done]
        if not ready:
            raise ValueError(f"circular features: {sorted(set(spec) - done)}")
        out.append({n: spec[n] for n in ready})
        done.update(ready)
    return out


def derive(df: DataFrame, spec: dict[str, str] = BASE_FEATURES) -> DataFrame:
    """Add every feature of the spec; one projection per dependency level, no shuffle."""
    for level in levels(spec):
        df = df.withColumns({name: F.expr(e) for name, e in level.items()})
    return df


def confident(df: DataFrame, col: str, threshold: float = 95.0) -> DataFrame:
    """Rows strictly above the threshold; NULL is dropped."""
    return df.filter(F.col(col) > F.lit(threshold))


def threshold_cascade(df: DataFrame, col: str, thresholds: list[float], target: str) -> DataFrame:
    """Rows and positives left at each threshold, in one pass over the table."""
    aggs = []
    for i, t in enumerate(thresholds):
        hit = F.col(col) > F.lit(float(t))
        aggs += [F.count_if(hit).alias(f"n{i}"),
                 F.coalesce(F.sum(F.when(hit, F.col(target))), F.lit(0)).cast("bigint").alias(f"p{i}")]
    cells = ", ".join(f"{float(t)}D, n{i}, p{i}" for i, t in enumerate(thresholds))
    return df.agg(*aggs).selectExpr(f"stack({len(thresholds)}, {cells}) as (threshold, n_rows, n_positive)")


def labelled(df: DataFrame, features: list[str], key: str, group: str, target: str) -> DataFrame:
    """Key, group, label and ordered features; everything else is pruned from the scan."""
    return df.select(key, group, F.col(target).cast("int").alias("target"), *features)


def group_normalise(df: DataFrame, cols: list[str], group: str, eps: float = EPS) -> DataFrame:
    """(x - group mean) / (group sample std + eps) for all columns, plus the group size.

    The statistics come from one partially combined aggregation joined back; groups that hold very
    many rows are joined by broadcast, so their rows never meet in one task.
    """
    stats = df.groupBy(group).agg(
        F.count(F.lit(1)).alias("count_per_group"),
        *[F.avg(c).alias(f"_m_{c}") for c in cols], *[F.stddev_samp(c).alias(f"_s_{c}") for c in cols])
    out = join_by_key(df, stats, [group], "count_per_group")
    return out.select(
        *df.columns, "count_per_group",
        *[((F.col(c) - F.col(f"_m_{c}")) / (F.col(f"_s_{c}") + F.lit(eps))).alias(f"{c}_group_norm") for c in cols])


def recode_label(df: DataFrame, target: str, negative: int = -1) -> DataFrame:
    """0/1 label as -1/1 for one-class models."""
    return df.withColumn(target, F.when(F.col(target) == 0, F.lit(negative)).otherwise(F.col(target)).cast("int"))
