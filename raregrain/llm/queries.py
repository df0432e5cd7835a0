"""The registered queries opN_<name>: whole tables in, one row for each of their rows out."""
from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from raregrain.llm import chat_tree, collocations, decontam, host_reputation, host_rules, importance, lang_bloom, lsh_forest, mix_schedule, nb_toxicity, random_battery, sign_hashing, sql, token_cuts
from raregrain.llm.common import table

URL_RULES = [("allow", "com/"), ("block", "example.com/en/"), ("allow", "www.example.com/en/"), ("block", "net/es/"), ("block", "net/fr/")]


def page_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Outcomes of pages: bad when the label of that id says low quality or toxic."""
    return table(spark, sf_dir, "labels").select(F.col("doc_id").alias("page_id"), ((F.col("quality") == 0) | (F.col("toxic") == 1)).alias("bad"))


def op1_prefix_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    text = "</s>[INST] ok [/INST]"
    extra = spark.createDataFrame([(-1, 0, "user", text), (-1, 1, "assistant", text)], turns.schema)
    return chat_tree.digests(chat_tree.read_back(*chat_tree.build(turns.unionByName(extra))))


def op2_language_bloom(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return lang_bloom.identify(docs, lang_bloom.fit(docs))


def op3_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix_schedule.taken(table(spark, sf_dir, "documents")).drop("source")


def op4_lsh_forest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lsh_forest.near_duplicates(table(spark, sf_dir, "documents"))


def op5_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    good = table(spark, sf_dir, "labels").filter("quality = 1")
    return importance.resample(table(spark, sf_dir, "documents"), good)


def op6_secret_battery(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = random_battery.scan(table(spark, sf_dir, "documents"))
    base = F.filter("spans", lambda s: s["kind"] != "random")
    count = lambda kind: F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long")
    return rows.select("doc_id", *[count(k).alias(f"n_{k}") for k in ("assign", "access", "hex")],
                       F.sha2(random_battery.listed(base), 256).alias("base_sha256"), random_battery.listed(F.col("spans")).alias("spans"))


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return nb_toxicity.score(docs, nb_toxicity.fit(docs, table(spark, sf_dir, "labels")))


def op8_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontam.decontaminate(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select(
        "doc_id", "n_words", "n_hit", F.size("item_ids").cast("long").alias("n_items"),
        F.sha2(F.array_join("item_ids", ","), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"))


def op9_url_reputation(spark: SparkSession, sf_dir: str) -> DataFrame:
    return host_reputation.url_filter(table(spark, sf_dir, "pages"), page_labels(spark, sf_dir), URL_RULES).select(
        "page_id", "host", "path", "rule", "verdict")


def op10_host_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return host_rules.quality_rules(table(spark, sf_dir, "documents")).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def op11_token_cuts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_cuts.alignments(table(spark, sf_dir, "documents"))


def op12_sign_hashing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sign_hashing.near_duplicates(table(spark, sf_dir, "embeddings"))


def op13_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations.collocations(table(spark, sf_dir, "documents"))


QUERIES = {f.__name__: f for f in (
    op1_prefix_tree, op2_language_bloom, op3_mix_sources, op4_lsh_forest, op5_importance_resampling, op6_secret_battery, op7_toxicity,
    op8_decontaminate, op9_url_reputation, op10_host_rules, op11_token_cuts, op12_sign_hashing,
    op13_collocations)}
ORACLES = {"op1_prefix_tree": sql.OP1, "op3_mix_sources": sql.OP3, "op8_decontaminate": sql.OP8, "op9_url_reputation": sql.OP9, "op10_host_rules": sql.OP10,
           "op12_sign_hashing": sql.OP12, "op13_collocations": sql.OP13}
