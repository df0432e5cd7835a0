"""Epoch metrics over a stream of scored rows: the same counts as the batch form, kept as state."""
from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from raregrain.operators.metrics import confusion


def score_stream(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """Scored rows arriving as files."""
    return spark.readStream.schema(schema).parquet(path)


def epoch_confusion(stream: DataFrame, epoch: str = "epoch") -> DataFrame:
    """Running tn, fp, fn, tp per epoch; state is one row per epoch."""
    return confusion(stream, [epoch])
