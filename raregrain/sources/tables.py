"""Readers for the measurement table and keyed payloads."""
from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from raregrain.operators.derive import CATEGORICAL_COLUMNS, LEAK_COLUMNS, NUMERIC_COLUMNS, POSITION_COLUMNS


def metadata_schema() -> T.StructType:
    """Declared once, so a scan never reads the files twice to guess types."""
    text = {"isic_id", "patient_id", *CATEGORICAL_COLUMNS, "attribution", *LEAK_COLUMNS} - {"tbp_lv_dnn_lesion_confidence", "mel_thick_mm"}
    names = ["isic_id", "target", "patient_id", *NUMERIC_COLUMNS, *POSITION_COLUMNS, *CATEGORICAL_COLUMNS, "attribution", *LEAK_COLUMNS]
    kinds = {"target": T.IntegerType()}
    return T.StructType([T.StructField(n, kinds.get(n, T.StringType() if n in text else T.DoubleType())) for n in names])


def read_metadata(spark: SparkSession, path: str, schema: T.StructType | None = None, header: list[str] | None = None) -> DataFrame:
    """CSV with a header; empty and 'NA' cells are NULL. `header` gives the file's column order when it differs."""
    schema = schema or metadata_schema()
    if header:
        by_name = {f.name: f for f in schema.fields}
        schema = T.StructType([by_name.get(h, T.StructField(h, T.StringType())) for h in header])
    reader = spark.read.schema(schema).option("header", True).option("nullValue", "NA").option("mode", "FAILFAST")
    return nan_to_null(reader.option("enforceSchema", False).csv(path))


def nan_to_null(df: DataFrame) -> DataFrame:
    """NaN means missing: turn it into NULL once, at the scan."""
    floats = [f.name for f in df.schema.fields if isinstance(f.dataType, (T.DoubleType, T.FloatType))]
    return df.withColumns({c: F.nanvl(F.col(c), F.lit(None)) for c in floats}) if floats else df


def na_to_null(df: DataFrame, cols: list[str], mark: str = "NA") -> DataFrame:
    """Text column to double, the missing mark and anything unreadable to NULL."""
    return df.withColumns({c: F.when(F.col(c) != mark, F.col(c)).try_cast("double") for c in cols})


def read_payloads(spark: SparkSession, path: str) -> DataFrame:
    """Binary files keyed by their bare file name."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path)
    name = F.regexp_extract("path", r"([^/]+?)(\.[^./]*)?$", 1)
    return files.select(name.alias("key"), F.col("length"), "content")


def attach_payload(rows: DataFrame, payloads: DataFrame, key: str) -> DataFrame:
    """Each row with its payload, by key; Spark picks the join side by size."""
    return rows.join(payloads, key)
