"""Quality rules at host level, in DataFrame operations only.

Each document is measured and judged by its own rules; failures are aggregated by host, the
hosts' failure rates are shrunk with a beta prior fitted to all hosts (method of moments), and
the hosts whose rate is high even at the lower end of its posterior lose their documents too.

Defined cases: null text has no words; a null host forms a group of its own; repeated rows count
as they stand; an empty table gives an empty result; other columns of the input are ignored.
"""
from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from raregrain.llm.common import SPACE, WORD, shared, sized
from raregrain.llm.shrink import grand_mean, posterior, strength

SYMBOLS = r"[#*$%&|<>]"
MIN_WORDS, REPEAT_PERCENT, WINDOW = 10, 20, 5


def measures(docs: DataFrame, text: str = "text") -> DataFrame:
    """Adds n_words, word_chars, n_symbols, n_dup_lines and n_repeat_words to every row.

    A window's hash is kept per position; only texts in which some window comes twice are
    sorted, which gives the positions of repeated windows and from them the covered words.
    """
    body = F.coalesce(F.col(text), F.lit(""))
    lines = F.filter(F.split(body, "\n", -1), lambda x: x.rlike(rf"[^{SPACE}]"))
    with_words = docs.withColumn("_w", F.regexp_extract_all(body, F.lit(f"({WORD})"), 1)).withColumn("_l", lines)
    hashed = with_words.withColumn("_k", F.transform("_w", lambda w: F.xxhash64(w))).withColumn(
        "_h", F.when(F.size("_k") >= WINDOW, F.expr(
            f"transform(sequence(0, size(_k) - {WINDOW}), i -> xxhash64(slice(_k, i + 1, {WINDOW})))")).otherwise(F.expr("array()").cast("array<bigint>")))
    twice = F.size("_h") > F.size(F.array_distinct("_h"))
    ordered = hashed.withColumn("_o", F.when(twice, F.expr("array_sort(transform(_h, (x, i) -> struct(x, i)))")))
    # start positions of windows whose hash stands next to an equal one in sorted order
    places = ordered.withColumn("_p", F.when(F.col("_o").isNotNull(), F.expr(
        "array_sort(transform(filter(_o, (e, j) -> (j > 0 and get(_o, j - 1).x = e.x) or (get(_o, j + 1).x <=> e.x)), e -> e.i))")))
    covered = F.expr(f"aggregate(_p, struct(0L as n, -{WINDOW} as last), (a, p) -> struct(a.n + least({WINDOW}, p - a.last) as n, p as last), a -> a.n)")
    return places.select(
        *docs.columns, F.size("_w").cast("long").alias("n_words"),
        F.length(F.regexp_replace(body, f"[{SPACE}]+", "")).cast("long").alias("word_chars"),
        F.regexp_count(body, F.lit(SYMBOLS)).cast("long").alias("n_symbols"),
        (F.size("_l") - F.size(F.array_distinct("_l"))).cast("long").alias("n_dup_lines"),
        F.coalesce(covered, F.lit(0)).cast("long").alias("n_repeat_words"))


def base_failed():
    return (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > REPEAT_PERCENT * F.col("n_words"))


def host_rates(judged: DataFrame, host: str = "host", failed: str = "base_failed") -> DataFrame:
    """One row per host: n, bad, the shrunk failure rate and the lower end of its posterior."""
    hosts = shared(judged.groupBy(host).agg(F.count(F.lit(1)).alias("n"), F.sum(F.col(failed).cast("long")).alias("bad")))
    mean = F.lit(grand_mean(hosts))
    return posterior(hosts, mean, strength(hosts, mean))


HOST_LIMIT = 0.5


def quality_rules(docs: DataFrame, host: str = "source", text: str = "text", limit: float = HOST_LIMIT) -> DataFrame:
    """Rows of `docs` (one row each) with their measures, `base_failed`, `host_low` and `kept`.

    A host is rejected when the lower end of its posterior failure rate is above `limit`. The measured
    rows are written once without their texts; hosts are few rows after map-side counting, and are
    broadcast only when they have been counted and are within the bound.
    """
    measured = shared(measures(docs.select("doc_id", F.col(host).alias("host"), F.col(text).alias("text"))).drop("text")
                      .withColumn("base_failed", base_failed()))
    rates = host_rates(measured)
    out = measured.join(sized(rates.select(F.col("host").alias("_host"), F.col("low").alias("host_low"))),
                        F.col("host").eqNullSafe(F.col("_host")), "left").drop("_host")
    return out.withColumn("kept", ~F.col("base_failed") & ~(F.coalesce(F.col("host_low"), F.lit(0.0)) > limit))
