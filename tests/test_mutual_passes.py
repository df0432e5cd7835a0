"""Blocks that meet once for both sides, searches whose rows keep what they hold, wide blocks of neighbour lists."""
import numpy as np
import pytest

from raregrain.operators import neighbours as N
from raregrain.operators import outliers as O


def frame(spark, points, keys=None):
    keys = range(len(points)) if keys is None else keys
    return spark.createDataFrame([(int(k), [float(x) for x in p], i % 2) for i, (k, p) in enumerate(zip(keys, points))], "key long, vec array<double>, target int")


@pytest.mark.parametrize("metric, p, kernel", [("euclidean", 2.0, "exp"), ("euclidean", 2.0, "rbf"), ("cityblock", 1.0, "exp"), ("minkowski", 3.0, "exp")])
def test_two_blocks_meet_once_and_count_for_both(spark, monkeypatch, metric, p, kernel):
    points, w = np.random.default_rng(6).normal(size=(70, 3)), np.array([1.0, 0.5, 0.0])
    seen = []
    inner = N.stream_past
    monkeypatch.setattr(N, "stream_past", lambda *a, **k: seen.append(inner(*a, **k)) or seen[-1])
    blocks, parts = N.pack(frame(spark, points), "key", "vec", "target", 2)
    assert parts > 3
    got = {r["key"]: r for r in N.pair_sums(blocks, parts, w, metric, p, kernel).collect()}
    assert "l_part" in seen[0]._jdf.queryExecution().executedPlan().toString().split("CartesianProduct")[1].split("\n")[0]
    d = (np.abs(points[:, None] - points[None]) ** p @ w) ** (1 / p)
    s = np.exp(-d * d if kernel == "rbf" else -d)
    np.fill_diagonal(s, 0)
    y = np.arange(70) % 2
    assert [got[i]["n"] for i in range(70)] == [69] * 70
    for name, want in (("dist", d.sum(1)), ("nearest", np.where(np.eye(70), np.inf, d).min(1)), ("s", s.sum(1)), ("sy", s @ y)):
        assert [got[i][name] for i in range(70)] == pytest.approx(list(want), rel=1e-9), name


def test_rows_of_one_key_stay_apart_from_their_own_sums(spark):
    points = np.random.default_rng(7).normal(size=(60, 2))
    keys = np.arange(60) // 2
    blocks, parts = N.pack(frame(spark, points, keys), "key", "vec", "target", 2)
    got = {r["key"]: r for r in N.pair_sums(blocks, parts, [1.0, 1.0]).collect()}
    d = np.sqrt(((points[:, None] - points[None]) ** 2).sum(-1)) * (keys[:, None] != keys[None])
    # a key's rows add up
    assert all(got[k]["n"] == 2 * 58 and got[k]["dist"] == pytest.approx(d[keys == k].sum()) for k in range(30))


def test_late_blocks_change_few_rows_and_ties_go_by_key(spark, monkeypatch):
    monkeypatch.setattr(N, "RIGHT_PARTS", 1)
    points = np.random.default_rng(8).normal(size=(400, 3)).round(1)
    points[:40, 0] += 50
    got = {r["key"]: r["nn"] for r in N.knn(frame(spark, points), None, 3, rows_per_block=2, pivots=2).collect()}
    for i, p in enumerate(points):
        d = N._exact(np.tile(p, (400, 1)), points, "euclidean", 2.0)
        assert [n["key"] for n in got[i]] == [j for _, j in sorted((d[j], j) for j in range(400) if j != i)[:3]]


@pytest.mark.parametrize("hits", [5, 1 << 22])
def test_neighbour_lists_meet_in_wide_blocks_in_bounded_steps(spark, monkeypatch, hits):
    monkeypatch.setattr(O, "HITS", hits)
    monkeypatch.setattr(O, "LIST_ROWS", 40)
    seen = []
    inner = O.stream_past
    monkeypatch.setattr(O, "stream_past", lambda left, *a, **k: seen.append(left.count()) or inner(left, *a, **k))
    rng = np.random.default_rng(9)
    # row 0 is in the middle of all others
    points = np.vstack([np.zeros((1, 2)), rng.normal(size=(99, 2)) * np.repeat([1, 1000, 10000], 33)[:, None]])
    near = O.neighbour_lists(frame(spark, points), "key", "vec", 4)
    got = {}
    for r in O.shared_reference(near, "key", 6, 10).collect():
        got.setdefault(r["key"], []).append((-r["shared"], r["rkey"]))
    lists = {r["key"]: {n["key"] for n in r["nn"]} for r in near.collect()}
    for i in range(100):
        assert sorted(got[i]) == sorted((-len(lists[i] & lists[j]), j) for j in range(100) if j != i)[:6]
    # blocks of rows, not more of them because the caller's blocks are small
    assert seen[0] == 2 or seen[0] == 3
