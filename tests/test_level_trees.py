"""Isolation trees grown level by level against a plain recursion with the same draws."""
import hashlib
import math

import numpy as np
import pytest

from raregrain.operators import outliers as O


def h32(*parts):
    return int(hashlib.md5("|".join(str(p) for p in parts).encode()).hexdigest()[:8], 16)


def brute(x, trees, size, max_features, seed):
    n, dims = x.shape
    limit, paths = max(1, math.ceil(math.log2(max(size, 2)))), np.zeros(n)
    for tree in range(trees):
        cols = sorted(range(dims), key=lambda f: (h32(seed, "subset", tree, f), f))[:max(1, int(dims * max_features))]
        sample = set(sorted(range(n), key=lambda k: (h32(seed, f"{tree}|{k}"), f"{tree}|{k}"))[:size])

        def walk(rows, node, depth):
            held = [r for r in rows if r in sample]
            f = cols[h32(seed, "feature", tree, node) % len(cols)]
            if depth < limit and len(held) > 1 and np.ptp(x[held, f]) == 0:
                free = [c for c in cols if np.ptp(x[held, c]) > 0]
                f = min(free, key=lambda c: (h32(seed, "again", tree, node, c), c)) if free else f
            lo, hi = x[held, f].min(), x[held, f].max()
            if depth == limit or len(held) <= 1 or lo == hi:
                paths[rows] += depth + O.average_path(len(held))
                return
            t = hi - h32(seed, "cut", tree, node) / 2 ** 32 * (hi - lo)
            t = t if t > lo else hi
            walk([r for r in rows if x[r, f] < t], 2 * node, depth + 1)
            walk([r for r in rows if not x[r, f] < t], 2 * node + 1, depth + 1)

        walk(list(range(n)), 1, 0)
    return 2.0 ** (-paths / trees / O.average_path(size))


def rows(n, seed):
    """Continuous, two-valued and constant features, copies, and one far row."""
    rng = np.random.default_rng(seed)
    x = np.c_[rng.normal(size=(n, 2)), rng.integers(0, 2, n), np.ones(n)]
    x[5:25] = x[4]
    x[0] = [9.0, -9.0, 1.0, 1.0]
    return x


def frame(spark, x):
    return spark.createDataFrame([(k, [float(a) for a in v]) for k, v in enumerate(x)], "key bigint, vec array<double>").repartition(3)


@pytest.mark.parametrize("n,trees,share,features", [(120, 3, 1.0, 1.0), (150, 2, 0.5, 0.75)])
def test_levels_equal_a_plain_recursion(spark, n, trees, share, features):
    x = rows(n, n)
    got = dict(O.isolation_forest(frame(spark, x), n_estimators=trees, max_samples=share, max_features=features, seed=11, whole=1).collect())
    want = brute(x, trees, int(share * n), features, 11)
    assert len(got) == n and max(abs(got[k] - want[k]) for k in range(n)) < 1e-9
    assert max(got, key=got.get) == 0


def test_rows_that_are_all_alike_are_one_leaf(spark):
    got = O.isolation_forest(frame(spark, np.ones((20, 2))), n_estimators=2, max_samples=1.0, whole=1).collect()
    assert len(got) == 20 and {round(r["score"], 9) for r in got} == {0.5}


def test_samples_are_drawn_without_replacement(spark, monkeypatch):
    """Trees of a full sample hold every row once, so copies of the draw cannot thin them."""
    sizes = []
    monkeypatch.setattr(O, "average_path", lambda n, plain=O.average_path: sizes.append(n) or plain(n))
    O.isolation_forest(frame(spark, rows(60, 1)), n_estimators=4, max_samples=1.0).count()
    assert sizes == [60] * 4
