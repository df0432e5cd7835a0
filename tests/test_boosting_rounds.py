"""A boosting round's rows are scored once, whatever the number of passes over them."""
import numpy as np

from raregrain.operators import ensembles as E


def test_a_rounds_rows_are_held_while_it_lasts_and_no_longer(spark):
    rng = np.random.default_rng(10)
    x = rng.normal(size=(300, 2))
    y = (x[:, 0] + rng.normal(size=300) > 0.5).astype(int)
    df = spark.createDataFrame([(i, [float(v) for v in p], int(t)) for i, (p, t) in enumerate(zip(x, y))], "key long, vec array<double>, target int")
    spark.catalog.clearCache()
    held, weights = [], []

    def look(rows, t):
        held.append("InMemoryTableScan" in rows._jdf.queryExecution().executedPlan().toString())
        weights.append({r["key"]: r["w"] for r in rows.collect()})
        return rows

    fitted = E.adaboost(df, 7, resample=look)
    # the first round and the one after a rewrite read a written table
    assert held == [False, True, True, True, True, False, True]
    assert not spark.sparkContext._jsc.getPersistentRDDs()
    for t, alpha in enumerate(fitted.alphas[:-1]):
        p = {r["key"]: r["prob"] for r in fitted.members[t].score(df).collect()}
        grown = {i: weights[t][i] * (np.exp(alpha) if (p[i] > 0.5) != y[i] else 1.0) for i in p}
        total = sum(grown.values())
        assert all(abs(weights[t + 1][i] - g / total) < 1e-12 for i, g in grown.items())
