"""Passes over block pairs: whole results, and no copies of blocks in a shuffle."""
import numpy as np
import pytest

from raregrain.operators import neighbours as N
from raregrain.operators import outliers as O
from raregrain.operators import resample as R


def frame(spark, points, labels=None):
    labels = np.zeros(len(points), int) if labels is None else labels
    return spark.createDataFrame([(i, [float(x) for x in p], int(t)) for i, (p, t) in enumerate(zip(points, labels))], "key long, vec array<double>, target int")


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_blocks_meet_without_a_shuffle_of_copies(spark):
    points = np.random.default_rng(0).normal(size=(60, 3))
    blocks, parts = N.pack(frame(spark, points), "key", "vec", "target", 2)
    assert parts > 3
    sums = N.pair_sums(blocks, parts, [1.0] * 3)
    text = plan(sums)
    # the only rows that move are sums per row
    assert "CartesianProduct" in text and "Generate" not in text and text.count("Exchange hashpartitioning") == 1
    d = np.sqrt(((points[:, None] - points[None]) ** 2).sum(-1))
    got = {r["key"]: r for r in sums.collect()}
    assert len(got) == 60 and all(r["n"] == 59 for r in got.values())
    assert [got[i]["dist"] for i in range(60)] == pytest.approx(list(d.sum(1)))


def test_neighbours_leave_one_search_without_copied_blocks(spark, monkeypatch):
    points = np.random.default_rng(1).normal(size=(300, 4)).round(1)
    seen = []
    inner = N.stream_past
    monkeypatch.setattr(N, "stream_past", lambda *a, **k: seen.append(inner(*a, **k)) or seen[-1])
    got = {r["key"]: r["nn"] for r in N.knn(frame(spark, points), None, 5, rows_per_block=2, pivots=4).collect()}
    assert "CartesianProduct" in plan(seen[0]) and "Exchange hashpartitioning" not in plan(seen[0])
    d = np.array([N._exact(np.tile(p, (300, 1)), points, "euclidean", 2.0) for p in points])
    for i in range(300):
        assert [n["key"] for n in got[i]] == [j for _, j in sorted((d[i, j], j) for j in range(300) if j != i)[:5]]


def test_integral_counts_leave_once_for_a_run_of_blocks(spark, monkeypatch):
    points = np.random.default_rng(2).normal(size=(200, 3))
    rows = []
    inner = O.stream_past
    monkeypatch.setattr(O, "stream_past", lambda *a, **k: rows.append(inner(*a, **k)) or rows[-1])
    scores = O.loci(frame(spark, points), rows_per_block=2)
    assert scores.count() == 200
    # 13 blocks of at most 16 rows: formerly each of 169 pairs gave its rows away
    assert all(r.count() <= 200 * max(N.RIGHT_PARTS, 1) for r in rows)


def test_affinities_with_far_rows_left_out_equal_all_pairs(spark):
    rng = np.random.default_rng(3)
    points = np.vstack([rng.normal(size=(40, 3)), rng.normal(size=(40, 3)) + 200])
    got = {r["key"]: r["score"] for r in O.sos(frame(spark, points), rows_per_block=2).collect()}
    d = ((points[:, None] - points[None]) ** 2).sum(-1)
    np.fill_diagonal(d, np.inf)
    bind = np.zeros_like(d)
    for i in range(80):
        beta, lo, hi = 1.0, 0.0, np.inf
        for _ in range(100):
            a = np.exp(-(d[i] - d[i].min()) * beta)
            h = np.log(a.sum()) + beta * (np.where(np.isinf(d[i]), 0, d[i] - d[i].min()) * a).sum() / a.sum()
            if abs(h - np.log(4.5)) < 1e-5:
                break
            lo, hi = (beta, hi) if h > np.log(4.5) else (lo, beta)
            beta = beta * 2 if np.isinf(hi) else (lo + hi) / 2
        bind[i] = a / a.sum()
    want = np.prod(1 - bind, axis=0)
    assert [got[i] for i in range(80)] == pytest.approx(list(want), rel=1e-9, abs=1e-12)


def test_shared_reference_keeps_rows_that_share_nothing_and_compares_no_dense_flags(spark, monkeypatch):
    rng = np.random.default_rng(4)
    points = np.vstack([rng.normal(size=(6, 2)) + 100 * i for i in range(12)])
    near = O.neighbour_lists(frame(spark, points), "key", "vec", 3)
    got = {}
    inner, seen = O.stream_past, []
    monkeypatch.setattr(O, "stream_past", lambda *a, **k: seen.append(inner(*a, **k)) or seen[-1])
    for r in O.shared_reference(near, "key", 8, 2).orderBy("key", "shared", ascending=[True, False]).collect():
        got.setdefault(r["key"], []).append((-r["shared"], r["rkey"]))
    lists = {r["key"]: {n["key"] for n in r["nn"]} for r in near.collect()}
    for i in range(72):
        want = sorted((-len(lists[i] & lists[j]), j) for j in range(72) if j != i)[:8]
        assert sorted(got[i]) == want
    assert seen[0].count() <= 72 * 8 * N.RIGHT_PARTS


def test_smoten_looks_all_columns_up_in_one_join(spark, monkeypatch):
    rng = np.random.default_rng(5)
    cols = [f"c{i}" for i in range(12)]
    rows = [(i, *[str(rng.integers(0, 3)) if rng.random() > 0.02 else None for _ in cols], int(i % 4 == 0)) for i in range(80)]
    df = spark.createDataFrame(rows, "key long, " + ", ".join(f"{c} string" for c in cols) + ", target int")
    coded = []
    inner = R.knn
    monkeypatch.setattr(R, "knn", lambda d, *a, **k: coded.append(d) or inner(d, *a, **k))
    R.smoten(df, "key", cols, "target", 3).count()
    assert plan(coded[0]).split("Initial Plan")[0].count("Join") <= 4
    table = {(r["column"], r["value"]): [r["p0"], r["p1"]] for r in R.class_profiles(df, cols, "target").collect()}
    want = {r[0]: [p for c, v in zip(cols, r[1:-1]) for p in table[c, v]] for r in rows if r[-1] == 1 and None not in r}
    assert {r["key"]: list(r["_vec"]) for r in coded[0].collect()} == want
