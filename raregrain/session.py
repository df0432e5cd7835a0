"""Session helpers shared by iterative operators."""
from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

CHECKPOINT_KEY = "spark.checkpoint.dir"


def ensure_checkpoint_dir(spark: SparkSession) -> None:
    """Use the shared folder the cluster names; only an unset local session gets its own."""
    sc = spark.sparkContext
    if sc.getCheckpointDir() is not None:
        return
    named = spark.conf.get(CHECKPOINT_KEY, None)
    if named:
        sc.setCheckpointDir(named)
    elif sc.master.startswith("local"):
        sc.setCheckpointDir(tempfile.mkdtemp(prefix="raregrain-ckpt-"))
    else:
        raise RuntimeError(f"set {CHECKPOINT_KEY} to a folder every executor can reach")


def cut_lineage(df: DataFrame, *layout: str) -> DataFrame:
    """Write the rows as a table in the shared checkpoint folder and return a frame that reads it.

    Loops call this once per round and operators call it for an input they read several
    times. The plan stays small, the planner knows the table's size, and a lost executor
    re-reads files instead of replaying the work. `layout` columns become folders, so that
    a filter on them reads only its part.
    """
    spark = df.sparkSession
    ensure_checkpoint_dir(spark)
    path = f"{spark.sparkContext.getCheckpointDir()}/table-{uuid.uuid4().hex}"
    writer = df.write.partitionBy(*layout) if layout else df.write
    writer.parquet(path)
    return spark.read.schema(df.schema).parquet(path).select(*df.columns)


def join_by_key(df: DataFrame, side: DataFrame, keys: list[str], rows: str, small: int = 100_000, hot: int = 1_000_000) -> DataFrame:
    """Inner join with a table of one row per key, whose column `rows` says how many rows of `df` the key has.

    A side counted to be small is broadcast. Of a larger one only the hot keys are, of which there are
    at most (rows of `df`) / `hot`; the other keys meet by a shuffle in which no key is large.
    """
    side = cut_lineage(side)
    if side.count() <= small:
        return df.join(F.broadcast(side), keys)
    top = side.filter(F.col(rows) > hot)
    rest = df.join(F.broadcast(top.select(*keys)), keys, "left_anti").join(side.filter(F.col(rows) <= hot), keys)
    return df.join(F.broadcast(top), keys).unionByName(rest)
