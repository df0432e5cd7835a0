import math
import zlib

import numpy as np
import pyarrow as pa

from raregrain.llm import importance, lang_bloom, nb_toxicity
from raregrain.llm.common import byte_view, word_hashes
from raregrain.llm.grams import pieces
from raregrain.llm.queries import QUERIES

from .helpers import SPACED, clashing, documents


def test_language_accuracy_on_held_out_rows(spark, sf):
    got = QUERIES["op2_language_bloom"](spark, sf).toPandas().set_index("doc_id")
    want = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "lang").toPandas().set_index("doc_id")["lang"]
    assert [bool(v) for v in got["held_out"]] == [zlib.crc32(str(i).encode()) % 5 == 0 for i in got.index]
    held = got[got["held_out"]]
    assert (held["lang_pred"] == want[held.index]).mean() > 0.97
    assert got["score"].between(0, 1).all()


def test_language_of_odd_texts(spark):
    learn = documents(spark, ["the cat sat on the mat and the dog"] * 40).unionByName(
        documents(spark, ["le chat est sur le tapis avec une souris"] * 40, ids=range(100, 140), lang="fr"))
    model = lang_bloom.fit(learn)
    odd = clashing(documents(spark, [None, "", "12 34 !?", "THE CAT", "le chat " * 200_000, "the dog"], ids=[1, 2, None, 4, 5, 5]))
    got = [(r["doc_id"], r["lang_pred"]) for r in lang_bloom.identify(odd, model).collect()]
    assert got == [(1, "und"), (2, "und"), (None, "und"), (4, "en"), (5, "fr"), (5, "en")]
    assert lang_bloom.identify(odd.limit(0), model).count() == 0
    nothing = lang_bloom.fit(learn.limit(0))
    assert {r["lang_pred"] for r in lang_bloom.identify(odd, nothing).collect()} == {"und"}


def test_filter_has_no_false_negative_and_few_false_positives():
    rng = np.random.default_rng(1)
    profiles = [rng.integers(0, 2 ** 63, 2000).astype(np.uint64) for _ in range(70)]  # more than 64: a second word of bits
    f = lang_bloom.Filter([str(i) for i in range(70)], profiles)
    for i in (0, 63, 64, 69):
        bit = lambda h: (f.masks(h)[:, i // 64] >> np.uint64(i % 64)) & np.uint64(1)  # noqa: B023, E731
        assert bit(profiles[i]).all()
        assert bit(rng.integers(0, 2 ** 63, 5000).astype(np.uint64)).mean() < 0.06  # (1 - exp(-3 / 8)) cubed is 0.03


def test_grams_of_cut_texts_equal_those_of_whole_texts():
    texts = ["Straße und Wörter, " * 9, None, "", "a", "日本語 text"]
    for n in (2, 4):
        whole = sorted(zip(*[x.tolist() for x in next(pieces(texts, 4)).grams(n)], strict=True))
        cut = sorted(z for p in pieces(texts, 4, limit=7) for z in zip(*[x.tolist() for x in p.grams(n)], strict=True))
        assert whole == cut


def test_word_hashes_follow_words_over_cuts(monkeypatch):
    from raregrain.llm import common
    texts = ["A bb  ccc\td", None, "", "x" * 50 + " y", " lead", "trail ", "é è z"] * 5
    raw, off = byte_view(pa.array(texts))
    h, first = word_hashes(raw, off, lower=True)
    for size in (8, 16, 64):
        monkeypatch.setattr(common, "CHUNK", size)
        h2, first2 = word_hashes(raw, off, lower=True)
        assert (h == h2).all() and (first == first2).all()
    seen = {}
    for i, t in enumerate(texts):
        words = SPACED.findall((t or "").lower())
        assert len(words) == first[i + 1] - first[i]
        for w, x in zip(words, h[first[i]:first[i + 1]], strict=True):
            assert seen.setdefault(w, x) == x
    assert len(set(seen.values())) == len(seen)


def toxic_table(spark):
    rng = np.random.default_rng(3)
    words = ["".join(rng.choice(list("abcdefgh"), 4)) for _ in range(300)]
    texts, labels = [], []
    for i in range(600):
        body = list(rng.choice(words, 40))
        if i % 4 == 0:
            body[5:5] = ["vilest", "scoundrel"]
        texts.append(" ".join(body))
        labels.append((i, 1, int(i % 4 == 0)))
    return documents(spark, texts), spark.createDataFrame(labels, "doc_id bigint, quality int, toxic int")


def test_toxicity_on_held_out_rows_and_odd_texts(spark):
    docs, labels = toxic_table(spark)
    model = nb_toxicity.fit(clashing(docs), clashing(labels))
    got = nb_toxicity.score(docs, model).toPandas()
    held = got[got["held_out"]]
    assert (held["predicted"] == (held["doc_id"] % 4 == 0)).all()
    odd = documents(spark, [None, "", "VILEST scoundrel", "x " * 300_000], ids=[None, 1, 1, 2])
    assert [r["predicted"] for r in nb_toxicity.score(clashing(odd), model).collect()] == [0, 0, 1, 0]
    assert nb_toxicity.without_toxic(odd, model).count() == 3
    assert nb_toxicity.score(odd.limit(0), model).count() == 0


def test_toxicity_without_two_classes(spark):
    docs, labels = toxic_table(spark)
    for some in (labels.limit(0), labels.filter("toxic = 0"), labels.withColumn("toxic", labels["toxic"].cast("int") * None)):
        assert {r["predicted"] for r in nb_toxicity.score(docs.limit(5), nb_toxicity.fit(docs, some)).collect()} == {0}


def test_importance_weights_equal_brute_force(spark):
    texts = ["good words here", "good words there", "bad junk junk", "junk here", None, "", "good words here"]
    docs = documents(spark, texts, ids=[0, 1, 2, 3, 4, 5, 0])
    good = spark.createDataFrame([(0,), (1,), (1,), (None,)], "doc_id bigint")
    got = importance.resample(clashing(docs), good, k=3).toPandas()
    b, owner = importance.buckets_of(pa.array(texts))
    raw, target = np.ones(importance.BUCKETS), np.ones(importance.BUCKETS)
    np.add.at(raw, b, 1)
    np.add.at(target, b[np.isin(owner, [0, 1, 6])], 1)
    ratio = np.log(target / target.sum()) - np.log(raw / raw.sum())
    want = np.bincount(owner, ratio[b], len(texts))
    assert np.allclose(sorted(got["log_weight"]), sorted(want))
    assert np.allclose(got.set_index("doc_id").loc[[1, 2, 3, 4, 5], "log_weight"], want[1:6])
    keys = sorted(got["key"], reverse=True)
    assert (got["selected"] == (got["key"] >= keys[2])).all() and math.isfinite(keys[-1])
    assert len(b) == sum(2 * len((t or "").split()) - 1 for t in texts if t)
    assert importance.resample(docs.limit(0), good).count() == 0
    assert (importance.resample(docs, good.limit(0)).toPandas()["log_weight"] == 0).all()


def test_importance_keeps_exactly_k_of_tied_rows(spark):
    docs = documents(spark, ["same words"] * 1000 + ["other words", None, None], ids=[None] * 1000 + [1, 2, None])
    good = spark.createDataFrame([(1,)], "doc_id bigint")
    for k in (0, 1, 10, 1001, 1003, 5000):
        got = importance.resample(docs, good, k=k).toPandas()
        assert len(got) == 1003 and got["selected"].sum() == min(k, 1003)
        if 0 < k < 1003:
            assert got[got["selected"]]["key"].min() >= got[~got["selected"]]["key"].max()
    # equal texts without an id share a draw, a null text has one of its own
    assert importance.resample(docs, good, k=10).filter("doc_id is null").select("key").distinct().count() == 2
