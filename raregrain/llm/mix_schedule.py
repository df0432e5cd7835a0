"""Mixing sources to target weights by a low-discrepancy schedule of equal-token blocks.

Targets: sources in code-point order (null last) weigh 5, 2, 1 and so on, and share `share` times all
tokens; a target stops at `epochs` times its source's size and the excess is shared out again by weight.
Blocks: a source's documents in seeded hash order form one stream of tokens, cut every `block` tokens;
a second epoch reads the stream again. Schedule: van der Corput points are mapped through the
sources' cumulative shares of slots; the slot's rank within its source says which block it takes. The
few slots beyond a source's quota go, in order, to the sources that are still short, so quotas are exact.

Defined cases: null text has size 0 and is taken 0 times; sources of size 0 have target 0; repeated rows
each take their share; an empty table gives an empty schedule; a null id is a value like any other.
"""
from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from raregrain.llm.common import WORD, shared, sized
from raregrain.operators.ranking import running_sums, value_bucket

#: Weights by position, repeating (fixed values).
WEIGHTS = [5, 2, 1]
SHARE, EPOCHS, BLOCK = 1.5, 2, 2048
MAX_SOURCES = 100_000


def level_targets(sizes: list[int], weights: list[int], total: float, epochs: float = EPOCHS) -> list[float]:
    """Shares of `total` by weight, none above `epochs` times its size: fills up the sources that reach their stop first."""
    order = sorted(range(len(sizes)), key=lambda i: (epochs * sizes[i] / weights[i], i))
    left, weight, out = total, sum(weights), [0.0] * len(sizes)
    for i in order:
        level = left / weight if weight else 0.0
        if epochs * sizes[i] <= weights[i] * level:
            out[i] = float(epochs * sizes[i])
            left -= out[i]
            weight -= weights[i]
        else:
            out[i] = weights[i] * level
    return out


def sized_documents(docs: DataFrame, seed: str = "mix") -> DataFrame:
    """Adds `size` (tokens) and `h`, the hash that orders a source's documents; texts are not kept."""
    return docs.select("doc_id", "source", F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long").alias("size"),
                       F.md5(F.concat_ws("|", F.lit(seed), F.coalesce(F.col("doc_id").cast("string"), F.lit("")))).alias("h"))


def plan_sources(rows: DataFrame, share: float = SHARE, epochs: float = EPOCHS, weights: list[int] = WEIGHTS, block: int = BLOCK) -> list[dict]:
    """One entry per source: s, source, size, target, quota of tokens and slots. Sources are a short list; more than `MAX_SOURCES` raise."""
    got = rows.groupBy("source").agg(F.sum("size").alias("size"), F.count(F.lit(1)).alias("n")).limit(MAX_SOURCES + 1).collect()
    if len(got) > MAX_SOURCES:
        raise ValueError(f"more than {MAX_SOURCES} sources: group them before mixing")
    got.sort(key=lambda r: (r["source"] is None, (r["source"] or "").encode("utf-8")))
    sizes = [r["size"] for r in got]
    targets = level_targets(sizes, [weights[i % len(weights)] for i in range(len(got))], share * sum(sizes), epochs)
    out = []
    for s, (r, target) in enumerate(zip(got, targets, strict=True)):
        quota, blocks = math.floor(target), math.ceil(r["size"] / block)
        slots = quota // r["size"] * blocks + math.ceil(quota % r["size"] / block) if r["size"] else 0
        out.append({"s": s, "source": r["source"], "source_size": r["size"], "target": target, "rows": r["n"], "quota": quota, "blocks": blocks, "slots": slots})
    return out


def _frame(spark: SparkSession, plan: list[dict], *cols: str) -> DataFrame:
    kinds = {"s": "int", "source": "string", "source_size": "long", "target": "double", "quota": "long", "blocks": "long", "slots": "long"}
    return spark.createDataFrame([tuple(p[c] for c in cols) for p in plan], ", ".join(f"{c} {kinds[c]}" for c in cols))


def streams(rows: DataFrame, plan: list[dict]) -> DataFrame:
    """doc_id, s, size, begin, end: each document's place in its source's stream of tokens.

    Running sums go bucket by bucket of the hash; the number of buckets follows the largest source,
    so that a source with most of the rows is spread like the others.
    """
    known = sized(_frame(rows.sparkSession, plan, "s", "source").withColumnRenamed("source", "_s"), len(plan))
    bits = min(24, max(4, math.ceil(math.log2(max([p["rows"] for p in plan], default=1) / 20_000 + 1)) + 4))
    placed = rows.join(known, F.col("source").eqNullSafe(F.col("_s"))).select("doc_id", "s", "size", "h").withColumn(
        "bucket", F.conv(F.substring("h", 1, 6), 16, 10).cast("long").bitwiseAND(2 ** 24 - 1))
    placed = placed.withColumn("bucket", F.floor(F.col("bucket") / 2 ** (24 - bits)))
    return running_sums(placed, ["s"], "bucket", ["h", "doc_id", "size"], {"end": F.col("size")}).select(
        "doc_id", "s", "size", (F.col("end") - F.col("size")).alias("begin"), "end")


def schedule(spark: SparkSession, plan: list[dict]) -> DataFrame:
    """slot, s, rank: which source each slot serves and how many slots of that source come before it.

    Points are the bit-reversed slot numbers; bounds are whole numbers, so reruns agree. Counts per
    source (a short list) reach the driver to settle the slots beyond the quotas.
    """
    total = sum(p["slots"] for p in plan)
    bits = min(52, max(16, total.bit_length() + 4))
    bounds, at = [], 0
    for p in plan[:-1]:
        at += p["slots"]
        bounds.append(float(at * 2 ** bits // max(total, 1)))
    # equal bounds belong to sources without slots: a point at a bound belongs to the source after all of them
    point = F.conv(F.reverse(F.lpad(F.bin("slot"), bits, "0")), 2, 10).cast("long")
    s = value_bucket(point, bounds) if bounds else F.lit(0)
    slots = spark.range(total).select(F.col("id").alias("slot"), F.floor(F.col("id") / 65_536).alias("chunk")).withColumn("s", s.cast("int"))
    ranked = shared(running_sums(slots, ["s"], "chunk", ["slot"], {"rank": F.lit(1)}).select("slot", "s", (F.col("rank") - 1).alias("rank")))
    have = {r["s"]: r["n"] for r in ranked.groupBy("s").agg(F.count(F.lit(1)).alias("n")).collect()}
    missing, over, n_over = [], [], 0
    for p in plan:
        n = have.get(p["s"], 0)
        missing += [(p["s"], r) for r in range(n, p["slots"])]  # a few per source: the points' discrepancy
        over.append((p["s"], p["slots"], n_over))
        n_over += max(0, n - p["slots"])
    quota = sized(spark.createDataFrame(over, "s int, slots long, before long"), len(over))
    free = spark.createDataFrame([(j, s2, r) for j, (s2, r) in enumerate(missing)], "j long, s2 int, r2 long")
    marked = ranked.join(quota, "s").withColumn("j", F.when(F.col("rank") >= F.col("slots"), F.col("before") + F.col("rank") - F.col("slots")))
    return marked.join(sized(free, len(missing)), "j", "left").select(
        "slot", F.coalesce("s2", "s").alias("s"), F.coalesce("r2", "rank").alias("rank"))


def mix(docs: DataFrame, share: float = SHARE, epochs: float = EPOCHS, weights: list[int] = WEIGHTS, block: int = BLOCK,
        seed: str = "mix") -> tuple[DataFrame, DataFrame, list[dict]]:
    """(places, pieces, plan). `pieces` is the mix: slot, s, block, and the piece (begin, end in the source's
    stream) of each document in it; `places` has each document's place, so that tokens can be cut out.

    Blocks are keys of the join, so a hot source is spread over its blocks; a long document lies in many.
    """
    spark = docs.sparkSession
    rows = shared(sized_documents(docs, seed))
    plan = plan_sources(rows, share, epochs, weights, block)
    places = shared(streams(rows, plan))
    parts = places.filter("size > 0").select("s", "begin", "end", F.explode(F.expr(
        f"sequence(cast(floor(begin / {block}) as bigint), cast(floor((end - 1) / {block}) as bigint))")).alias("block"))
    per = sized(_frame(spark, plan, "s", "source_size", "quota", "blocks"), len(plan))
    # whole epochs come first; the last one stops where the quota ends
    asked = schedule(spark, plan).join(per, "s").withColumn("block", F.expr("rank % blocks")).withColumn("epoch", F.expr("rank div blocks")).withColumn(
        "upto", F.expr("quota - epoch * source_size")).select("slot", "s", "block", "epoch", "upto")
    pieces = asked.join(parts, ["s", "block"]).select(
        "slot", "s", "block", "epoch", F.col("begin").alias("doc_begin"), F.greatest(F.col("begin"), F.col("block") * block).alias("begin"),
        F.least(F.col("end"), (F.col("block") + 1) * block, F.col("upto")).alias("end")).filter("end > begin")
    return places, pieces, plan


def taken(docs: DataFrame, **how) -> DataFrame:
    """doc_id, source, size, source_size, target, taken: one row for each document."""
    places, pieces, plan = mix(docs, **how)
    sums = pieces.groupBy("s", "doc_begin").agg(F.sum(F.col("end") - F.col("begin")).alias("taken"))
    per = sized(_frame(docs.sparkSession, plan, "s", "source", "source_size", "target"), len(plan))
    keyed = places.withColumn("doc_begin", F.when(F.col("size") > 0, F.col("begin")))
    return keyed.join(sums, ["s", "doc_begin"], "left").join(per, "s").select(
        "doc_id", "source", "size", "source_size", "target", F.coalesce("taken", F.lit(0)).cast("long").alias("taken"))
