"""Quality by importance resampling: hashed n-gram models of target and raw text, sampled by Gumbel top-k.

Words and pairs of words are hashed into `BUCKETS`. The target model counts the texts labelled good, the
raw model counts all texts; a text's log weight is the sum over its n-grams of the log ratio of the two. Adding
standard Gumbel noise and keeping the `k` largest keys draws `k` texts without replacement, in
proportion to their weights. Noise comes from a hash of the id (of the text where the id is null), so reruns agree.

Defined cases: null or empty texts have no n-grams and log weight 0; without good texts all weights are 0;
rows of one id share a draw, and so do equal texts without an id; of rows with equal keys at the cut as many are
kept as make `k`, picked by a hash of the row's place; an empty table gives an empty result.
"""
from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from raregrain.llm.common import byte_view, mix, portions, shared, sized, travels, word_hashes
from raregrain.operators.ranking import order_statistic, take_hashed

travels(__name__)

BUCKETS = 10_000
SMOOTH = 1.0


def buckets_of(column) -> tuple[np.ndarray, np.ndarray]:
    """Bucket of every word and every pair of neighbouring words, and the number of the text it belongs to."""
    raw, offsets = byte_view(column)
    words, first = word_hashes(raw, offsets, lower=True)
    owner = np.repeat(np.arange(len(first) - 1), np.diff(first))
    pair = mix(words[:-1] * np.uint64(0x9E3779B97F4A7C15) + words[1:]) if len(words) > 1 else words[:0]
    inside = owner[:-1] == owner[1:] if len(words) > 1 else np.zeros(0, bool)
    h = np.concatenate([words, pair[inside]])
    return (h % np.uint64(BUCKETS)).astype(np.int64), np.concatenate([owner, owner[:-1][inside] if len(words) > 1 else owner[:0]])


def log_ratios(docs: DataFrame, good: DataFrame) -> np.ndarray:
    """Log ratio of the target to the raw model for each bucket. `good`: doc_id of the target texts.

    Each task sums its texts into two dense tables of `BUCKETS` counts before anything is shuffled.
    """
    import pyarrow as pa

    ids = shared(good.select("doc_id").filter(F.col("doc_id").isNotNull()).distinct()).withColumn("good", F.lit(1))
    rows = docs.select("doc_id", "text").join(sized(ids, most=1_000_000), "doc_id", "left").select("text", F.coalesce("good", F.lit(0)).alias("good"))

    def tally(batches):
        raw, target = np.zeros(BUCKETS, np.int64), np.zeros(BUCKETS, np.int64)
        for batch in portions(batches):
            b, owner = buckets_of(batch.column("text"))
            raw += np.bincount(b, minlength=BUCKETS)
            target += np.bincount(b[batch.column("good").to_numpy()[owner] == 1], minlength=BUCKETS)
        yield pa.RecordBatch.from_pydict({"b": pa.array(np.arange(BUCKETS, dtype=np.int32)), "raw": pa.array(raw), "target": pa.array(target)})

    got = rows.mapInArrow(tally, "b int, raw bigint, target bigint").groupBy("b").agg(F.sum("raw").alias("raw"), F.sum("target").alias("target")).toPandas()
    raw, target = np.full(BUCKETS, SMOOTH), np.full(BUCKETS, SMOOTH)
    raw[got["b"]] += got["raw"].to_numpy()
    target[got["b"]] += got["target"].to_numpy()
    if not got["target"].sum():
        return np.zeros(BUCKETS)
    return np.log(target / target.sum()) - np.log(raw / raw.sum())


def resample(docs: DataFrame, good: DataFrame, k: int | None = None, fraction: float = 0.5, seed: str = "gumbel") -> DataFrame:
    """doc_id, log_weight, key, selected: one row for each document. `k` texts are drawn (`fraction` of all if not given)."""
    import pyarrow as pa

    ratio = log_ratios(docs, good)

    def weigh(batches):
        for batch in portions(batches):
            b, owner = buckets_of(batch.column("text"))
            sums = np.bincount(owner, ratio[b], batch.num_rows).astype(np.float64)  # whole numbers where no text has a word
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("draw"), pa.array(sums)], names=["doc_id", "draw", "log_weight"])

    named = F.coalesce(F.col("doc_id").cast("string"), F.concat(F.lit("text "), F.xxhash64("text").cast("string")))
    rows = docs.select("doc_id", named.alias("draw"), "text")
    weighed = rows.mapInArrow(weigh, f"doc_id {dict(rows.dtypes)['doc_id']}, draw string, log_weight double")
    unit = (F.conv(F.substring(F.md5(F.concat_ws("|", F.lit(seed), "draw")), 1, 12), 16, 10).cast("double") + 0.5) / F.lit(float(1 << 48))
    keyed = shared(weighed.select("doc_id", "log_weight", (F.col("log_weight") - F.log(-F.log(unit))).alias("key"), F.monotonically_increasing_id().alias("place")))
    cols = ["doc_id", "log_weight", "key", "selected"]
    n = keyed.count()
    k = round(fraction * n) if k is None else min(k, n)
    if not k:
        return keyed.withColumn("selected", F.lit(False)).select(cols)
    cut = order_statistic(keyed, "key", n - k)
    marked = keyed.withColumn("selected", F.col("key") >= F.lit(cut))
    met = marked.agg(F.count_if("selected").alias("n"), F.count_if(F.col("key") == F.lit(cut)).alias("tied")).first()
    if met["n"] == k:
        return marked.select(cols)
    quota = docs.sparkSession.createDataFrame([(0, k - (met["n"] - met["tied"]))], "_all int, quota bigint")
    tied = take_hashed(keyed.filter(F.col("key") == F.lit(cut)).withColumn("_all", F.lit(0)), "place", seed, quota, ["_all"], flag="selected")
    return marked.filter(F.col("key") != F.lit(cut)).select(cols).unionByName(tied.select(cols))
