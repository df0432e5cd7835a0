"""Imputing, scaling and encoding, fitted on the training side and applied anywhere."""
from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.ml import Estimator, Model, Pipeline, PipelineModel, Transformer
from pyspark.ml.feature import Imputer, OneHotEncoder, StringIndexer, VectorAssembler
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from raregrain.operators.ranking import exact_quantiles


def column_stats(df: DataFrame, cols: list[str]) -> DataFrame:
    """Mean, exact median, population std of each numeric column, as long rows."""
    aggs = []
    for i, c in enumerate(cols):
        aggs += [F.avg(c).alias(f"m{i}"), F.stddev_pop(c).alias(f"s{i}")]
    medians = exact_quantiles(df, dict.fromkeys(cols, 0.5))
    cells = ", ".join(f"'{c}', m{i}, {medians[c]!r}D, s{i}" for i, c in enumerate(cols))
    return df.agg(*aggs).selectExpr(f"stack({len(cols)}, {cells}) as (column, mean, median, std)")


def column_modes(df: DataFrame, cols: list[str]) -> DataFrame:
    """Most frequent non-null value of each column; ties go to the smallest value."""
    cells = ", ".join(f"'{c}', cast({c} as string)" for c in cols)
    long = df.selectExpr(f"stack({len(cols)}, {cells}) as (column, value)").filter("value is not null")
    counts = long.groupBy("column", "value").agg(F.count(F.lit(1)).alias("n"))
    return counts.groupBy("column").agg(F.min(F.struct((-F.col("n")).alias("o"), "value")).alias("_m")).select(
        "column", F.col("_m.value").alias("mode"), (-F.col("_m.o")).alias("n"))


def median_fill(df: DataFrame, cols: list[str]) -> DataFrame:
    """Fill NULL in each column by the exact whole-table median."""
    medians = exact_quantiles(df, dict.fromkeys(cols, 0.5))
    return df.withColumns({c: F.coalesce(F.col(c), F.lit(medians[c])) for c in cols})


@dataclass
class FittedPrep:
    """Fitted parameters: one mean/std per numeric column, one mode and category list per text column."""

    num_cols: list[str]
    cat_cols: list[str]
    means: dict[str, float]
    stds: dict[str, float]
    modes: dict[str, str]
    categories: dict[str, list[str]] = field(default_factory=dict)
    one_hot: bool = True

    def impute(self, df: DataFrame) -> DataFrame:
        cols = {c: F.coalesce(F.col(c).cast("double"), F.lit(self.means[c])) for c in self.num_cols}
        cols |= {c: F.coalesce(F.col(c), F.lit(self.modes[c])) for c in self.cat_cols}
        return df.withColumns(cols)

    def scale(self, df: DataFrame) -> DataFrame:
        """Zero std divides by one."""
        return df.withColumns({c: (F.col(c) - F.lit(self.means[c])) / F.lit(self.stds[c] or 1.0) for c in self.num_cols})

    def encode(self, df: DataFrame) -> DataFrame:
        """0/1 column per known category, sorted; an unknown value is all zeros."""
        flags = {}
        for c in self.cat_cols:
            for v in self.categories[c]:
                flags[f"{c}={v}"] = F.coalesce((F.col(c) == F.lit(v)).cast("double"), F.lit(0.0))
        return df.withColumns(flags)

    def feature_names(self) -> list[str]:
        if not self.one_hot:
            return self.num_cols + self.cat_cols
        return self.num_cols + [f"{c}={v}" for c in self.cat_cols for v in self.categories[c]]

    def transform(self, df: DataFrame) -> DataFrame:
        """Numeric block, then categorical block, as one `features` array; other columns stay."""
        out = self.scale(self.impute(df))
        if not self.one_hot:
            return out
        out = self.encode(out)
        names = self.feature_names()
        flags = [n for n in names if n not in self.num_cols]
        return out.withColumn("features", F.array(*[F.col(f"`{n}`") for n in names])).drop(*flags)


def fit_prep(df: DataFrame, num_cols: list[str], cat_cols: list[str] = (), one_hot: bool = True) -> FittedPrep:
    """Two small aggregations; only per-column numbers and category lists reach the driver.

    std is the population std of the mean-imputed column, as the scaler sees it.
    """
    cat_cols = list(cat_cols)
    aggs = [F.count(F.lit(1)).alias("_all")]
    for c in num_cols:
        aggs += [F.count(c).alias(f"_c_{c}"), F.avg(c).alias(f"_m_{c}"), F.var_pop(c).alias(f"_v_{c}")]
    row = df.agg(*aggs).first()
    means = {c: float(row[f"_m_{c}"] or 0.0) for c in num_cols}
    stds = {c: float(((row[f"_v_{c}"] or 0.0) * row[f"_c_{c}"] / max(row["_all"], 1)) ** 0.5) for c in num_cols}
    modes, cats = {}, {}
    if cat_cols:
        modes = {r["column"]: r["mode"] for r in column_modes(df, cat_cols).collect()}
        if one_hot:
            sets = df.agg(*[F.array_sort(F.collect_set(c)).alias(c) for c in cat_cols]).first()
            cats = {c: list(sets[c]) for c in cat_cols}
    return FittedPrep(list(num_cols), cat_cols, means, stds, modes, cats, one_hot)


def preprocessor(num_cols: list[str], cat_cols: list[str], one_hot: bool = True) -> "PrepEstimator":
    """The same steps as a `pyspark.ml` stage, for use inside a Pipeline."""
    return PrepEstimator(num_cols, cat_cols, one_hot)


class PrepEstimator(Estimator):
    """Fit on train, emit a `features` vector."""

    def __init__(self, num_cols, cat_cols, one_hot=True):
        super().__init__()
        self.args = (list(num_cols), list(cat_cols), one_hot)

    def _fit(self, dataset):
        return PrepModel(fit_prep(dataset, *self.args))


class PrepModel(Model):
    def __init__(self, fitted: FittedPrep):
        super().__init__()
        self.fitted = fitted

    def _transform(self, dataset):
        out = self.fitted.transform(dataset)
        return out.withColumn("features", array_to_vector("features")) if self.fitted.one_hot else out


def mllib_preprocessor(num_cols: list[str], cat_cols: list[str]) -> Pipeline:
    """Imputer, indexer and encoder from MLlib, persistable; unknown categories become zeros."""
    imputed = [f"{c}__i" for c in num_cols]
    stages = [Imputer(strategy="mean", inputCols=num_cols, outputCols=imputed)]
    if cat_cols:
        stages += [
            StringIndexer(inputCols=cat_cols, outputCols=[f"{c}__x" for c in cat_cols],
                          stringOrderType="alphabetAsc", handleInvalid="keep"),
            OneHotEncoder(inputCols=[f"{c}__x" for c in cat_cols], outputCols=[f"{c}__o" for c in cat_cols], dropLast=True)]
    stages.append(VectorAssembler(inputCols=imputed + [f"{c}__o" for c in cat_cols], outputCol="features"))
    return Pipeline(stages=stages)


class TrainOnly(Estimator):
    """Resampling stage: acts while the following stages are fitted, passes rows through when scoring."""

    def __init__(self, resample):
        super().__init__()
        self.resample = resample

    def _fit(self, dataset):
        return _PassThrough()


class _PassThrough(Transformer):
    def _transform(self, dataset):
        return dataset


def fit_resampled(stages: list, train: DataFrame):
    """Fit stages in order; a TrainOnly stage changes only what later stages are fitted on."""
    fitted, data = [], train
    for stage in stages:
        if isinstance(stage, TrainOnly):
            data = stage.resample(data)
            continue
        model = stage.fit(data) if isinstance(stage, Estimator) else stage
        fitted.append(model)
        data = model.transform(data)
    return PipelineModel(fitted)


def named_columns(df: DataFrame, col: str, names: list[str], is_vector: bool = False) -> DataFrame:
    """Give names back to the columns of a matrix. A row whose width differs from the number of names is an error."""
    v = vector_to_array(col) if is_vector else F.col(col)
    wrong = F.raise_error(F.concat(F.lit(f"{len(names)} names for a matrix of width "), F.size("_v").cast("string")))
    return df.withColumn("_v", v).withColumn("_v", F.when(F.size("_v") == len(names), F.col("_v")).otherwise(wrong)).select(
        *[c for c in df.columns if c != col], *[F.col("_v")[i].alias(n) for i, n in enumerate(names)])
