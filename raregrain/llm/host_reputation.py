"""URL filter: listed rules first, then an empirical-Bayes reputation of the page's host.

Labelled outcomes are counted by host, and rates are shrunk level by level: suffixes towards the
mean of all pages, registered domains towards their suffix, hosts towards their domain. A page is
blocked when the lower end of its host's posterior is above the limit.

Defined cases: a null url, or one without `://`, has an empty host and path; all such pages share the
empty host. Null or repeated labels of a page: nulls count for nothing, one bad label makes the page bad.
Hosts without labels inherit their domain's rate. Repeated pages stay; empty tables give empty results.
"""
from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from raregrain.llm.common import shared, sized
from raregrain.llm.shrink import grand_mean, posterior, strength

PARTS = r"(?s)^.*?://([^/?#]*)([^?#]*)"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Second-level labels under which domains are registered (fixed values).
SECOND_LEVEL = ["ac", "co", "com", "edu", "gov", "net", "org"]
LIMIT = 0.5


def host_of(url: str | Column) -> Column:
    c = F.col(url) if isinstance(url, str) else url
    return F.coalesce(F.translate(F.regexp_extract(c, PARTS, 1), UPPER, LOWER), F.lit(""))


def path_of(url: str | Column) -> Column:
    c = F.col(url) if isinstance(url, str) else url
    return F.coalesce(F.regexp_extract(c, PARTS, 2), F.lit(""))


def with_levels(hosts: DataFrame, host: str = "host") -> DataFrame:
    """Adds the public suffix (last label, or two as in `co.uk`) and the registered domain (one label more)."""
    labels = F.split(F.col(host), r"\.")
    two = (F.size(labels) >= 3) & (F.length(F.element_at(labels, -1)) == 2) & F.get(labels, F.size(labels) - 2).isin(SECOND_LEVEL)
    n = F.when(two, 2).otherwise(1)
    return (hosts.withColumn("suffix", F.array_join(F.slice(labels, -F.least(n, F.size(labels)), F.least(n, F.size(labels))), "."))
            .withColumn("domain", F.array_join(F.slice(labels, -F.least(n + 1, F.size(labels)), F.least(n + 1, F.size(labels))), ".")))


def listed_rule(host: Column, path: Column, rules: list[tuple[str, str]]) -> Column:
    """The longest rule `host/path` that fits: the rule's host or a subdomain of it, and a path that starts alike."""
    fits = []
    for _, rule in sorted(rules, key=lambda r: (-len(r[1]), r[1])):
        at = rule.index("/")
        fits.append(F.when(((host == rule[:at]) | host.endswith("." + rule[:at])) & path.startswith(rule[at:]), F.lit(rule)))
    return F.coalesce(*fits, F.lit(None).cast("string"))


def reputations(outcomes: DataFrame) -> DataFrame:
    """`outcomes`: one row per host with n labelled pages and bad ones. Returns host, rate, low."""
    hosts = shared(with_levels(outcomes))
    sums = lambda df, by: shared(df.groupBy(*by).agg(F.sum("n").alias("n"), F.sum("bad").alias("bad")))
    domains = sums(hosts, ["suffix", "domain"])
    suffixes = sums(domains, ["suffix"])
    mean = F.lit(grand_mean(suffixes))
    above = posterior(suffixes, mean, strength(suffixes, mean)).select("suffix", F.col("rate").alias("prior"))
    for units, key in ((domains, "suffix"), (hosts, "domain")):
        level = shared(units.join(above, key))
        done = posterior(level, F.col("prior"), strength(level, F.col("prior")))
        above = done.select("domain", F.col("rate").alias("prior")) if key == "suffix" else done
    return above.select("host", "rate", "low")


def url_filter(pages: DataFrame, labels: DataFrame, rules: list[tuple[str, str]], limit: float = LIMIT) -> DataFrame:
    """page_id, host, path, rule, verdict and the host's shrunk rate and bound, one row for each page.

    `labels`: page_id, bad (boolean). Pages are counted by host before anything is gathered; the
    hosts' table is broadcast only if it has been counted and is within the bound, else Spark joins
    it by host and splits a skewed host.
    """
    parts = pages.select("page_id", host_of("url").alias("host"), path_of("url").alias("path"))
    marks = labels.filter(F.col("bad").isNotNull() & F.col("page_id").isNotNull()).groupBy("page_id").agg(F.max("bad").alias("bad"))
    outcomes = parts.join(marks, "page_id", "left").groupBy("host").agg(
        F.count("bad").alias("n"), F.coalesce(F.sum(F.col("bad").cast("long")), F.lit(0)).alias("bad"))
    known = shared(reputations(outcomes))
    rule = listed_rule(F.col("host"), F.col("path"), rules)
    verdicts = reduce(lambda c, r: F.when(F.col("rule") == r[1], r[0]).otherwise(c), rules,
                      F.when(F.col("low") > limit, "block").otherwise("allow"))
    return (parts.withColumn("rule", rule).join(sized(known), "host", "left")
            .select("page_id", "host", "path", "rule", verdicts.alias("verdict"), "rate", "low"))
