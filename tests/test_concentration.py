"""Concentration steps over blocks of bytes: whole results from few passes."""
import numpy as np
import pytest

from raregrain.operators import outliers as O


def frame(spark, points):
    return spark.createDataFrame([(i, [float(x) for x in p]) for i, p in enumerate(points)], "key long, vec array<double>")


def test_concentration_step_finds_its_rows_in_two_passes(spark, monkeypatch):
    points = np.random.default_rng(0).normal(size=(500, 3))
    points[100:220] = points[100]
    rows = O._Blocks(frame(spark, points).withColumnRenamed("vec", "x"), "key", 3)
    passes = []
    inner = O._Blocks._counts
    monkeypatch.setattr(O._Blocks, "_counts", lambda *a: passes.append(1) or inner(*a))
    mean, cov = points[:50].mean(0), np.cov(points[:50].T)
    d = np.einsum("ij,jk,ik->i", points - mean, np.linalg.pinv(cov), points - mean)
    # many rows share row 100's distance; the cut may fall on them, below or above
    for h in (1, int((d < d[100]).sum()) + 5, 251, 499, 500):
        near = points[d <= np.sort(d)[h - 1] + 1e-12]
        for guess, few in ((None, 20_000), (float(np.sort(d)[h - 1]), 20_000), (None, 3)):
            monkeypatch.setattr(O, "AT_CUT", few)
            passes.clear()
            m, c, cut = rows.nearest(mean, cov, h, guess, False)
            assert cut == pytest.approx(np.sort(d)[h - 1])
            assert m == pytest.approx(near.mean(0)) and c == pytest.approx(np.cov(near.T, bias=True), abs=1e-12)
            assert few < 100 or len(passes) == 1
            # the cut is where the last step left it: one pass
            monkeypatch.setattr(O, "AT_CUT", 20_000)
            passes.clear()
            again = rows.nearest(mean, cov, h, cut, False, 1e-6)
            assert not passes and again[2] == cut and again[0] == pytest.approx(m)


def test_robust_covariance_searches_no_order_statistic(spark, monkeypatch):
    points = np.random.default_rng(1).normal(size=(300, 3))
    monkeypatch.setattr(O, "order_statistic", lambda *a: pytest.fail("a step sorted the scores again"))
    assert O.mcd(frame(spark, points)).count() == 300
