"""Second-order boosting against hand-worked splits and a plain exhaustive grower."""
import numpy as np
import pytest
from pyspark.sql import functions as F

from raregrain.operators.newton import best_cuts, cut_gains, newton_trees
from raregrain.plans.registry import build


def soft(g, alpha):
    return np.sign(g) * max(abs(g) - alpha, 0.0)


def part(g, h, alpha, lam):
    return soft(g, alpha) ** 2 / (h + lam) if h + lam else 0.0


def exhaustive(x, g, h, depth, alpha, lam, gamma, least, rate):
    """Leaf value of every row, by trying every cut of every feature in every node. NaN goes where it gains more."""
    out = np.zeros(len(x))

    def grow(rows, depth, value):
        best = None
        G, H = g[rows].sum(), h[rows].sum()
        for f in range(x.shape[1]):
            v = x[rows, f]
            for t in np.append(np.unique(v[~np.isnan(v)])[1:], np.inf):
                for to_left in (True, False):
                    go = np.where(np.isnan(v), to_left, v < t)
                    left, right = rows[go], rows[~go]
                    if not len(left) or not len(right) or h[left].sum() < least or h[right].sum() < least:
                        continue
                    gain = 0.5 * (part(g[left].sum(), h[left].sum(), alpha, lam) + part(g[right].sum(), h[right].sum(), alpha, lam) - part(G, H, alpha, lam)) - gamma
                    if gain > 1e-9 and (best is None or gain > best[0] + 1e-9):
                        best = (gain, left, right)
        if depth == 0 or best is None:
            out[rows] = value
            return
        for side in best[1:]:
            grow(side, depth - 1, -rate * soft(g[side].sum(), alpha) / (h[side].sum() + lam))

    grow(np.arange(len(x)), depth, -rate * soft(g.sum(), alpha) / (h.sum() + lam))
    return out


def frame(spark, x, y):
    rows = [(i, [None if np.isnan(a) else float(a) for a in v], int(t)) for i, (v, t) in enumerate(zip(x, y, strict=True))]
    return spark.createDataFrame(rows, "key long, vec array<double>, target int")


def test_one_split_worked_by_hand(spark):
    # two bins: (g, h, n) = (-4, 2, 4) and (3, 1, 2); alpha 1, lambda 2: left 3^2 / 4, right 2^2 / 3, both 0
    cells = spark.createDataFrame([(0, 0, 0, -4, 2, 4), (0, 0, 1, 3, 1, 2)], "node long, f int, bin int, g long, h long, n long")
    (r,) = cut_gains(cells, reg_alpha=1.0, reg_lambda=2.0).collect()
    assert (r["cut"], r["left_n"], r["right_n"]) == (1, 4, 2)
    assert r["gain"] == pytest.approx(0.5 * (9 / 4 + 4 / 3))
    assert (r["left"], r["right"]) == (pytest.approx(3 / 4), pytest.approx(-2 / 3))
    assert cut_gains(cells, reg_alpha=1.0, reg_lambda=2.0, gamma=2.0).count() == 0
    assert cut_gains(cells, min_child_weight=1.5).count() == 0
    assert cut_gains(cells, min_rows=3).count() == 0


def test_missing_rows_take_the_better_side(spark):
    cells = spark.createDataFrame([(0, 0, -1, 5, 2, 4), (0, 0, 0, -4, 2, 4), (0, 0, 1, 3, 1, 2)], "node long, f int, bin int, g long, h long, n long")
    r = best_cuts(cells).first()
    assert (r["cut"], r["missing_left"]) == (1, False)


@pytest.mark.parametrize("alpha, lam, gamma", [(0.0, 1.0, 0.0), (0.7, 8.9, 0.0), (0.0, 1.0, 0.5)])
def test_trees_equal_an_exhaustive_grower(spark, alpha, lam, gamma):
    rng = np.random.default_rng(5)
    x = rng.integers(0, 12, (240, 3)).astype(float)
    x[rng.random(x.shape) < 0.1] = np.nan
    y = ((np.nan_to_num(x[:, 0]) > 7) ^ (rng.random(240) < 0.15)).astype(int)
    weight, rate, margin = np.where(y == 1, 3.0, 1.0), 0.3, np.zeros(240)
    for _ in range(3):
        p = 1 / (1 + np.exp(-margin))
        margin = margin + exhaustive(x, (p - y) * weight, p * (1 - p) * weight, 3, alpha, lam, gamma, 1.0, rate)
    rows = frame(spark, x, y)
    # every=2: margins are written once in between
    model = newton_trees(rows, 3, rate, 3, scale_pos_weight=3.0, gamma=gamma, every=2, **{"alpha": alpha, "lambda": lam})
    got = model.margin(rows).orderBy("key").toPandas()["margin"].to_numpy()
    assert np.allclose(got, margin, atol=1e-6)


def test_penalties_shrink_leaves_and_reruns_agree(spark):
    rng = np.random.default_rng(1)
    x = rng.normal(size=(400, 5))
    rows = frame(spark, x, (x[:, 0] + x[:, 1] > 0.5).astype(int))
    def sizes(**p):
        model = newton_trees(rows, 2, 0.3, 2, subsample=0.8, colsample_bytree=0.8, colsample_bylevel=0.7, colsample_bynode=0.9, **p)
        return model, max(abs(v) for t in model.trees for v in t.value)
    (first, plain), (again, _) = sizes(), sizes()
    assert [t.value for t in first.trees] == [t.value for t in again.trees]
    assert sizes(reg_lambda=50.0)[1] < plain and sizes(reg_alpha=5.0)[1] < plain
    assert all(t.feature == [-1] and t.value == [0.0] for t in sizes(reg_alpha=1e6)[0].trees)


def test_defined_cases(spark):
    rng = np.random.default_rng(2)
    x = rng.normal(size=(300, 2))
    rows = frame(spark, x, (x[:, 0] > 1).astype(int))
    odd = spark.createDataFrame([(900, None, 0), (901, [None, float("nan")], 1), (902, [0.5], 0), (903, [2.0, 1.0], None)], rows.schema)
    model = build("newton_trees", {"model__n_estimators": 3, "min_data_in_leaf": 2, "max_bins": 512}).fit(rows.unionByName(odd))  # every value is a border
    scored = model.score(rows.unionByName(odd)).toPandas()
    assert len(scored) == 304 and scored["prob"].between(0, 1).all()
    hit = scored[scored["key"] < 900]
    assert hit[hit["target"] == 1]["prob"].min() > hit[hit["target"] == 0]["prob"].max()
    empty = newton_trees(rows.limit(0), 3)
    assert empty.score(rows.limit(2)).toPandas()["prob"].tolist() == [0.5, 0.5]
    one_class = newton_trees(rows.withColumn("target", F.lit(0)), 2, learning_rate=1.0)
    assert one_class.score(rows).agg(F.max("prob")).first()[0] < 0.2
    with pytest.raises(TypeError):
        newton_trees(rows, depths=3)
    with pytest.raises(ValueError):
        newton_trees(rows, 1, min_child_weight=0.0, max_nodes=1, max_depth=4)
