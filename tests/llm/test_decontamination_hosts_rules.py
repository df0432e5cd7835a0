from raregrain.llm import decontam, host_reputation, host_rules, sql
from raregrain.llm.queries import URL_RULES

from .helpers import clashing, documents, duck, rows_of
from pyspark.sql import functions as F


def result(docs, items, **how):
    return decontam.decontaminate(docs, items, **how).select(
        "doc_id", "n_words", "n_hit", F.size("item_ids").cast("long").alias("n_items"), F.sha2(F.array_join("item_ids", ","), 256).alias("items_sha256"),
        (F.col("n_hit") > 0).alias("contaminated"))


def contaminated(spark):
    item = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu"
    items = spark.createDataFrame([(1, item), (2, "Tiny"), (3, None), (4, "..."), (5, item), (10, "Één twee drie"), (11, "the the the the the the the the the the the")],
                                  "item_id bigint, text string")
    texts = [None, "", "x " + item.upper() + " y", item.replace("kappa", "kapow"), "tiny TINY, tiny", "één twee drie", "ÉÉN twee. drie É Één-twee drie", "the " * 30,
             " ".join(item.split()[:10]), "z " * 50_000 + item, "tiny TINY, tiny"]
    return documents(spark, texts, ids=[0, 1, 2, 3, 4, 5, 6, 7, 8, None, 4]), items


def test_both_ways_of_joining_equal_sql(spark):
    docs, items = contaminated(spark)
    want = duck(sql.OP8, documents=docs, benchmark=items)
    assert rows_of(result(clashing(docs), clashing(items))) == want
    assert rows_of(result(docs, items, bound=0)) == want
    assert rows_of(result(docs, items, shingle=3)) == want
    assert rows_of(result(docs, items.limit(0))) == duck(sql.OP8, documents=docs, benchmark=items.limit(0))
    assert result(docs.limit(0), items).count() == 0
    left = [r["doc_id"] for r in decontam.without_benchmark(clashing(docs), items).collect()]
    assert sorted(left) == [0, 1, 3, 5]  # the first letter of one item is not A-Z, so its case counts


def test_urls(spark):
    urls = [None, "", "no scheme", "http://", "HTTP://WWW.Example.COM/en/x", "https://a.b.net/es/?q=/fr/", "x://net/fr/", "http://example.com?x/en/", "ftp://evilnet/es/",
            "http://shop.co.uk/a#b", "http://bad.org/1", "http://ÄB.com/é", "http://a/b://c/d", "\nhttp://n.com/\nx"]
    pages = spark.createDataFrame([(i if i else None, u) for i, u in enumerate(urls)] + [(100 + i, f"http://bad.org/{i}") for i in range(60)] + [(7, urls[7])], "page_id bigint, url string")
    labels = spark.createDataFrame([(100 + i, 0 if i < 55 else 1, None) for i in range(60)] + [(100, 1, 0), (None, 0, 1), (9, None, None)], "doc_id bigint, quality int, toxic int")
    marks = labels.select(F.col("doc_id").alias("page_id"), ((F.col("quality") == 0) | (F.col("toxic") == 1)).alias("bad"))
    cols = ["page_id", "host", "path", "rule", "verdict"]
    got = host_reputation.url_filter(clashing(pages).drop("host"), marks, URL_RULES).select(*cols)
    assert rows_of(got) == duck(sql.OP9, pages=pages, labels=labels)
    assert {r["verdict"] for r in got.filter("host = 'bad.org'").collect()} == {"block"}
    assert {r["verdict"] for r in host_reputation.url_filter(pages, marks.limit(0), []).collect()} == {"allow"}
    assert host_reputation.url_filter(pages.limit(0), marks, URL_RULES).count() == 0
    levels = host_reputation.with_levels(spark.createDataFrame([("a.shop.co.uk",), ("x.y.net",), ("net",), ("",)], "host string")).collect()
    assert [(r["suffix"], r["domain"]) for r in levels] == [("co.uk", "shop.co.uk"), ("net", "y.net"), ("net", "net"), ("", "")]


def test_host_rules_equal_sql_and_drop_a_bad_host(spark):
    fine = [f"one two three four five six seven eight nine ten eleven {i}" for i in range(60)]
    texts = fine + ["a b c d e " * 40] * 55 + fine[:5] + [None, "", "x", "line one\nline one\n\n \nline one", "# * é\u00a0b\x0bc " * 9, "q " * 60_000]
    host = ["good"] * 60 + ["bad"] * 60 + [None] * 6
    ids = list(range(len(texts) - 1)) + [0]
    docs = spark.createDataFrame([(i, t, s) for i, t, s in zip(ids, texts, host, strict=True)], "doc_id bigint, text string, source string")
    cols = ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"]
    got = host_rules.quality_rules(clashing(docs)).select(*cols)
    assert rows_of(got) == duck(sql.OP10, documents=docs)
    kept = {r["doc_id"]: r["kept"] for r in got.filter("doc_id between 1 and 119").collect()}
    assert all(kept[i] for i in range(1, 60)) and not any(kept[i] for i in range(60, 120))
    assert host_rules.quality_rules(docs.limit(0)).count() == 0
