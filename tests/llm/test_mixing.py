from collections import Counter

from raregrain.llm import mix_schedule, sql

from .helpers import clashing, documents, duck, rows_of


def table_of(spark):
    texts = ["w " * n for n in (5, 0, 3000, 12, 7, 7, 40_000, 900, 1, 2500)] + [None, "x y"]
    docs = documents(spark, texts, ids=[0, 1, 2, 3, 4, 4, 6, 7, 8, 9, None, 11])
    sources = ["b", "b", "a", "é", None, None, "a", "b", "empty", "Z", "none", "b"]
    pairs = spark.createDataFrame([(i, t, s) for (i, t), s in zip([(r["doc_id"], r["text"]) for r in docs.collect()], sources, strict=True)],
                                  "doc_id bigint, text string, source string")
    return pairs


def test_taken_words_equal_the_closed_form(spark):
    docs = table_of(spark)
    got = mix_schedule.taken(clashing(docs), block=64).drop("source")
    assert rows_of(got) == duck(sql.OP3, documents=docs)
    assert rows_of(got) == rows_of(mix_schedule.taken(docs.repartition(3), block=7).drop("source"))  # neither layout nor block matters
    assert mix_schedule.taken(docs.limit(0)).count() == 0


def test_targets_fill_up_in_order():
    sizes, weights = [10, 100, 0, 50], [5, 2, 1, 5]
    got = mix_schedule.level_targets(sizes, weights, 1.5 * sum(sizes))
    assert abs(sum(got) - 1.5 * sum(sizes)) < 1e-9 and all(t <= 2 * s + 1e-9 for t, s in zip(got, sizes, strict=True))
    assert got[0] == 20.0 and got[2] == 0.0


def test_schedule_serves_exact_quotas_evenly(spark):
    docs = table_of(spark)
    places, pieces, plan = mix_schedule.mix(docs, block=16)
    slots = sorted((r["slot"], r["s"], r["rank"]) for r in mix_schedule.schedule(spark, plan).collect())
    assert [x[0] for x in slots] == list(range(sum(p["slots"] for p in plan)))
    for p in plan:  # each source's ranks without gap or repeat
        assert sorted(r for _, s, r in slots if s == p["s"]) == list(range(p["slots"]))
    total = len(slots)
    big = max(plan, key=lambda p: p["slots"])
    seen = 0
    for i, (_, s, _) in enumerate(slots):  # low discrepancy: every beginning of the schedule has its share
        seen += s == big["s"]
        assert abs(seen - (i + 1) * big["slots"] / total) < 12
    rows = pieces.collect()
    assert all(r["end"] - r["begin"] <= 16 for r in rows)
    took = Counter()
    for r in rows:
        took[r["s"]] += r["end"] - r["begin"]
    assert all(took[p["s"]] == p["quota"] for p in plan)
    assert max(Counter((r["slot"]) for r in rows).values()) <= 16
