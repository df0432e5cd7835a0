import random

from raregrain.llm import lsh_forest
from raregrain.llm.components import components
from raregrain.llm.queries import QUERIES

from .helpers import brute_components, clashing, documents, shingles


def test_small_tables_equal_all_pairs(spark, sf):
    got = QUERIES["op4_lsh_forest"](spark, sf).toPandas().set_index("doc_id")
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").toPandas()
    want = brute_components(docs["doc_id"].tolist(), docs["text"].tolist(), 85)
    assert got["component_id"].to_dict() == want
    assert (got["kept"] == (got.index == got["component_id"])).all()
    assert {i: len(shingles(t)) for i, t in docs.itertuples(index=False)} == got["n_shingles"].to_dict()


def test_groups_of_edits_equal_all_pairs(spark, percent=80, piece=16):
    """Groups whose links lie on both sides of the threshold; small pieces force the grid and the deeper prefixes."""
    rng = random.Random(7)
    words = [f"w{i}" for i in range(4000)]
    texts = []
    for group in range(4):
        base = rng.choices(words, k=rng.choice([30, 120, 400]))
        for _ in range(60 if group == 0 else 15):
            edit = list(base)
            for _ in range(rng.randint(0, max(1, len(base) // 25))):
                edit[rng.randrange(len(edit))] = rng.choice(words)
            texts.append(" ".join(edit))
    texts += [" ".join(rng.choices(words, k=50)) for _ in range(40)] + ["Same  TEXT\there", "same text here"] * 10
    order = list(range(len(texts)))
    rng.shuffle(order)
    docs = documents(spark, [texts[i] for i in order]).repartition(4)
    got = lsh_forest.near_duplicates(clashing(docs), percent=percent, piece=piece, base=3).toPandas().set_index("doc_id")["component_id"].to_dict()
    assert got == brute_components(list(range(len(texts))), [texts[i] for i in order], percent)


def test_crowded_runs_still_meet_at_base_depth(spark):
    """Four classes share the base value and part below it; two more per run than `longest`."""
    def label(*values):
        return b"".join(v.to_bytes(2, "big") for v in values)
    nodes = spark.createDataFrame([(i, 10, bytearray(label(7, 10 * i, i))) for i in range(4)], "c bigint, n_shingles bigint, sig binary")
    runs = lsh_forest._runs(nodes, trees=1, depth=3, base=1, longest=2).toPandas()
    assert any(set(g["c"]) == {0, 1, 2, 3} for _, g in runs.groupby("run"))


def test_crowded_chain_equals_all_pairs(spark, percent=80):
    """A passage moves on from one place to the next, so that neighbouring places are just similar enough; copies crowd each place's runs."""
    rng = random.Random(5)
    words = [f"w{i}" for i in range(5000)]
    line = rng.choices(words, k=3000)
    texts = []
    for place in range(40):
        for _ in range(10):
            edit = line[place * 46:place * 46 + 464]
            edit[rng.choice([0, -1])] = rng.choice(words)
            texts.append(" ".join(edit))
    got = lsh_forest.near_duplicates(documents(spark, texts).repartition(4), percent=percent, piece=64, base=3, longest=4).toPandas()
    assert got.set_index("doc_id")["component_id"].to_dict() == brute_components(list(range(len(texts))), texts, percent)


def test_odd_rows(spark):
    long = "word " * 100_000 + "end"
    texts = [None, "", "  \t", "one", "ONE", "one two", long, long.upper(), "one two", "a b c d e f", "a b c d e f"]
    ids = [1, 2, 3, 4, 5, 6, 7, 8, None, 9, 9]
    out = lsh_forest.near_duplicates(documents(spark, texts, ids)).collect()
    got = sorted((r["doc_id"] or 0, r["n_shingles"], r["component_id"], r["kept"]) for r in out)
    assert got == sorted([(0, 1, None, True), (1, 0, 1, True), (2, 0, 2, True), (3, 0, 3, True), (4, 1, 4, True), (5, 1, 4, False), (6, 1, 6, True),
                          (7, 2, 7, True), (8, 2, 7, False), (9, 2, 9, True), (9, 2, 9, True)])
    kept = lsh_forest.one_per_group(clashing(documents(spark, texts, ids)))
    assert sorted(r["doc_id"] or 0 for r in kept.collect()) == [0, 1, 2, 3, 4, 6, 7, 9]
    assert lsh_forest.near_duplicates(documents(spark, ["x"]).limit(0)).count() == 0


def test_components_of_paths_stars_and_loops(spark):
    links = [(i, i + 1) for i in range(100, 160)] + [(7, i) for i in range(200, 300)] + [(5, 5), (None, 3), (1, None)]
    got = {r["node"]: r["component"] for r in components(spark.createDataFrame(links, "u bigint, v bigint")).collect()}
    assert got == {i: 100 for i in range(101, 161)} | {i: 7 for i in range(200, 300)}
    assert components(spark.createDataFrame([], "u bigint, v bigint")).count() == 0
