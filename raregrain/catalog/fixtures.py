"""The given tables seen as rare-event data: Spark frames and the same rows as SQL text."""
from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    """Register a query and, where SQL can express it, its independent check."""
    def add(fn):
        if name in QUERIES:
            raise ValueError(f"query {name} is registered twice")
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn
    return add


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def r6(expr: str) -> str:
    return f"floor(({expr}) * 1e6 + 0.5) / 1e6"


def h32(*parts: str) -> str:
    return "('0x' || substr(md5(concat_ws('|', " + ", ".join(parts) + ")), 1, 8))::bigint"


TYPE_CODE = "case event_type when 'click' then 0 when 'error' then 1 when 'purchase' then 2 when 'signup' then 3 else 4 end"


def cases(spark, sf) -> DataFrame:
    return table(spark, sf, "events").select(
        "event_id", "user_id", "event_type", "value",
        F.when((F.col("event_type") == "error") & (F.col("value") > 150), 1).otherwise(0).alias("target"),
        F.get_json_object("props", "$.k").cast("double").alias("k"), F.hour("ts").cast("double").alias("hr"),
        F.expr(TYPE_CODE).cast("int").alias("code"))


CASES = f"""cases as (select event_id, user_id, event_type, value,
  case when event_type = 'error' and value > 150 then 1 else 0 end as target,
  json_extract_string(props, '$.k')::double as k, extract(hour from ts)::double as hr, {TYPE_CODE} as code from events)"""


def nulls(spark, sf) -> DataFrame:
    return cases(spark, sf).withColumns({
        "value": F.when(F.col("event_id") % 17 == 0, F.lit(None)).otherwise(F.col("value")),
        "event_type": F.when(F.col("event_id") % 13 == 0, F.lit(None)).otherwise(F.col("event_type"))})


NULLS = CASES + """, nulls as (select * replace (case when event_id % 17 = 0 then null else value end as value,
  case when event_id % 13 = 0 then null else event_type end as event_type) from cases)"""


def scored(spark, sf) -> DataFrame:
    """Two trials of a deterministic score, with user-hash folds."""
    base = cases(spark, sf)
    one = base.select(F.lit(1).alias("trial"), "event_id", "user_id", "target", (F.floor("value") / F.lit(500.0)).alias("score"))
    two = base.select(F.lit(2).alias("trial"), "event_id", "user_id", "target", (F.col("k") / F.lit(100.0)).alias("score"))
    return one.unionByName(two).withColumns({
        "pred": (F.col("score") > 0.3).cast("int"), "fold": (F.col("user_id") % 5).cast("int"),
        "logit": F.col("score") * 4 - 2})


SCORED = CASES + """, base as (
  select 1 as trial, event_id, user_id, target, floor(value) / 500.0::double as score from cases union all
  select 2 as trial, event_id, user_id, target, k / 100.0::double as score from cases),
scored as (select *, case when score > 0.3::double then 1 else 0 end as pred, (user_id % 5)::int as fold, score * 4 - 2 as logit from base)"""


def docs(spark, sf) -> DataFrame:
    return table(spark, sf, "labels").join(table(spark, sf, "documents"), "doc_id")


def vecs(spark, sf) -> DataFrame:
    return table(spark, sf, "embeddings").select(
        F.col("vec_id").alias("key"), F.col("embedding").cast("array<double>").alias("vec"), (F.col("label") == 0).cast("int").alias("target"))


VECS = "vecs as (select vec_id as key, embedding::double[] as vec, (label = 0)::int as target from embeddings)"
PAIRS = """pairs as (select a.key as a, b.key as b, a.target as ta, b.target as tb,
  sqrt(list_sum(list_transform(list_zip(a.vec, b.vec), lambda z: (z[1]-z[2])*(z[1]-z[2])))) as d
  from vecs a join vecs b on a.key <> b.key)"""
