"""Affinities over all rows and trimmed covariance against plain versions."""
import math

import numpy as np
import pytest

from raregrain.operators import outliers as O


def frame(spark, x, keys=None):
    return spark.createDataFrame([(int(k), [float(a) for a in v]) for k, v in zip(range(len(x)) if keys is None else keys, x)], "key bigint, vec array<double>").repartition(3)


def brute_sos(x, perplexity=4.5, eps=1e-5, tries=100):
    d = ((x[:, None, :] - x[None, :, :]) ** 2).sum(2)
    n, goal, b = len(x), math.log(min(perplexity, len(x) - 1 - 1e-3)), np.zeros((len(x), len(x)))
    for i in range(n):
        other = np.delete(np.arange(n), i)
        beta, lo, hi = 1.0, 0.0, math.inf
        for _ in range(tries):
            a = np.exp(-(d[i, other] - d[i, other].min()) * beta)
            p = a / a.sum()
            h = -(p[p > 0] * np.log(p[p > 0])).sum()
            if abs(h - goal) < eps:
                break
            lo, hi = (beta, hi) if h > goal else (lo, beta)
            beta = beta * 2 if math.isinf(hi) else (lo + hi) / 2
        b[i, other] = p
    return np.exp(np.log1p(-np.minimum(b, 1 - 1e-15)).sum(0))


@pytest.mark.parametrize("rows,block", [(500, 128), (60, 1024), (3, 2)])
def test_affinities_reach_all_rows(spark, rows, block):
    rng = np.random.default_rng(rows)
    x = np.concatenate([rng.standard_normal((rows - 2, 5)), 6 + rng.standard_normal((2, 5))])
    if rows > 10:
        x[5] = x[6]
    got = dict(O.sos(frame(spark, x), rows_per_block=block).select("key", "score").collect())
    want = brute_sos(x)
    assert len(got) == rows and max(abs(got[i] - want[i]) for i in range(rows)) < 1e-6
    if rows == 500:
        far = [i for i in range(rows) if got[i] == 1.0]
        assert len(set(got.values())) > 480 and not far


def test_one_row_binds_to_nothing(spark):
    assert [tuple(r) for r in O.sos(frame(spark, np.ones((1, 3)))).collect()] == [(0, 1.0)]


def test_chi2_quantiles():
    """Known values of the tables."""
    for p, dims, value in ((0.5, 1, 0.454936), (0.975, 1, 5.023886), (0.5, 10, 9.341818), (0.975, 10, 20.483177), (0.975, 64, 88.004051)):
        assert abs(O.chi2_quantile(p, dims) - value) < 1e-4


def one_start(x):
    """Concentration from all rows only."""
    h = (len(x) + x.shape[1] + 1) // 2
    mean, cov, last = *O._moments(x, False)[:2], math.inf
    while True:
        mean, cov, size = O._concentrate(x, mean, cov, h, 1, False)
        if last - size < 1e-9:
            return mean, cov, size
        last = size


def test_covariance_rejects_a_planted_cluster(spark):
    """Two fifths of the rows lie in a cluster of their own: one start from all rows keeps it, many starts reject it."""
    rng = np.random.default_rng(7)
    x = np.concatenate([rng.standard_normal((600, 4)), 5 + 0.8 * rng.standard_normal((400, 4))])
    mean, cov, size = one_start(x)
    d = x - mean
    kept = ((d @ np.linalg.inv(cov)) * d).sum(1)
    assert np.median(kept[600:]) < np.quantile(kept[:600], 0.9)
    got = dict(O.mcd(frame(spark, x), reweighted=True).collect())
    score = np.array([got[i] for i in range(1000)])
    assert score[600:].min() > np.quantile(score[:600], 0.97)
    # distances of ordinary rows follow the chi-squared distribution they should
    assert abs(np.median(score[:600]) / O.chi2_quantile(0.5, 4) - 1) < 0.25


def test_covariance_equals_plain_version_on_clean_rows(spark):
    """Without outliers: the raw covariance of the best half, scaled, then estimated again from the rows within the bound."""
    rng = np.random.default_rng(3)
    x = rng.standard_normal((400, 3)) @ np.diag([1.0, 2.0, 0.5])
    got = dict(O.mcd(frame(spark, x), reweighted=True).collect())
    best = min((O._concentrate(x, *O._moments(x[rng.permutation(400)[:4]], False)[:2], 202, 60, False) for _ in range(300)), key=lambda f: f[2])
    d = x - best[0]
    raw = ((d @ np.linalg.inv(best[1])) * d).sum(1)
    scale = np.sort(raw)[199] / O.chi2_quantile(0.5, 3)
    mean, cov, _ = O._moments(x[raw / scale < O.chi2_quantile(0.975, 3)], False)
    d = x - mean
    want = ((d @ np.linalg.inv(cov)) * d).sum(1)
    assert np.corrcoef(want, [got[i] for i in range(400)])[0, 1] > 0.999


@pytest.mark.parametrize("nearest", [32, 5])
def test_affinities_take_few_passes_from_any_first_guess(spark, monkeypatch, nearest):
    rng = np.random.default_rng(11)
    x = rng.standard_normal((300, 20))
    # more equal rows than the perplexity: no fall-off gets down to it
    x[:7] = x[0]
    passes, inner = [], O._row_sums
    monkeypatch.setattr(O, "_row_sums", lambda *a: passes.append(1) or inner(*a))
    monkeypatch.setattr(O, "NEAREST", nearest)
    monkeypatch.setattr(O, "NEAREST_TIMES", 1 if nearest == 5 else 4)
    got = dict(O.sos(frame(spark, x), rows_per_block=8).select("key", "score").collect())
    want = brute_sos(x)
    assert max(abs(got[i] - want[i]) for i in range(300)) < 1e-9
    # five nearest tell little about where to look
    assert len(passes) <= (4 if nearest == 32 else 10)


def test_a_missing_element_shows_in_all_affinities(spark):
    x = np.random.default_rng(12).standard_normal((9, 2))
    x[4, 1] = np.nan
    assert [r["score"] for r in O.sos(frame(spark, x)).collect()] == [None] * 9
