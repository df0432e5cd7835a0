"""Outlier detectors."""
from __future__ import annotations

from pyspark.sql import functions as F

from raregrain.catalog.fixtures import CASES, PAIRS, VECS, cases, h32, query, r6, table, vecs
from raregrain.catalog.nearest import nn_sql
from raregrain.functions import columns as C
from raregrain.operators import outliers as O


def out(df, key="key"):
    return df.select(key, C.round6("score").alias("score"))


@query("outlier_threshold_probability", f"""with {CASES}, q as (select quantile_cont(value, 1 - 0.0001::double) as c, min(value) as lo, max(value) as hi from cases)
  select event_id, {r6('(value - lo) / (hi - lo)')} as probability, (value > c)::int as outlier from cases, q""")
def threshold(spark, sf):
    s = cases(spark, sf).select("event_id", F.col("value").alias("score"))
    return O.flagged(s).select("event_id", C.round6("probability").alias("probability"), "outlier")


@query("ecdf_per_feature", f"""with {CASES}, l as (select 'value' as f, value as x from cases union all select 'k', k from cases), d as (select f, x, cume_dist() over (partition by f order by x) as c from l)
  select distinct f as feature, x as value, {r6('c')} as share from d""")
def ecdf(spark, sf):
    l = cases(spark, sf).selectExpr("stack(2, 'value', value, 'k', k) as (feature, v)")
    return O.ecdf(l, ["feature"], "v").select("feature", F.col("x").alias("value"), C.round6(F.col("upto") / F.col("total")).alias("share"))


LONG = f"{VECS}, lv as (select key, i as f, vec[i] as x from vecs, range(1, 65) r(i))"


@query("histogram_outliers", f"""with {LONG}, rg as (select f, min(x) as lo, (max(x) - min(x)) / 10 as w from lv group by f),
  b as (select key, lv.f, least(greatest(floor((x - lo) / w), 0), 9) as b, w from lv join rg on lv.f = rg.f), ct as (select f, b, count(*) as n, max(w) as w from b group by f, b)
  select key, {r6('sum(-log2(n / ((select count(*) from vecs) * ct.w) + 0.1::double))')} as score from b join ct on b.f = ct.f and b.b = ct.b group by key""")
def hbos(spark, sf):
    return out(O.hbos(vecs(spark, sf)))


@query("copula_outliers", f"""with {LONG}, sk as (select f, skewness(x) as s from lv group by f), t as (select key, lv.f, -ln(cume_dist() over (partition by lv.f order by x)) as l, -ln(cume_dist() over (partition by lv.f order by x desc)) as r, s from lv join sk on lv.f = sk.f)
  select key, {r6('greatest(sum(l), sum(r), sum(case when s < 0 then l else r end))')} as score from t group by key""")
def copod(spark, sf):
    return out(O.copod(vecs(spark, sf)))


@query("neighbour_distance_outliers", f"with {nn_sql(5)} select a as key, {r6('max(d)')} as largest, {r6('avg(d)')} as mean, {r6('median(d)')} as median from nn group by a")
def knn_distance(spark, sf):
    near = O.neighbour_lists(vecs(spark, sf), "key", "vec", 5)
    parts = [O.knn_distance(near, "key", m).withColumnRenamed("score", m) for m in ("largest", "mean", "median")]
    df = parts[0].join(parts[1], "key").join(parts[2], "key")
    return df.select("key", *[C.round6(m).alias(m) for m in ("largest", "mean", "median")])


@query("local_outlier_factor", f"""with {nn_sql(10)}, kd as (select a, max(d) as kd from nn group by a), lrd as (select nn.a, 1 / avg(greatest(kd, d)) as lrd from nn join kd on nn.b = kd.a group by nn.a)
  select nn.a as key, {r6('avg(y.lrd) / max(x.lrd)')} as score from nn join lrd x on nn.a = x.a join lrd y on nn.b = y.a group by nn.a""")
def lof(spark, sf):
    return out(O.lof(O.neighbour_lists(vecs(spark, sf), "key", "vec", 10)))


@query("connectivity_outliers")
def cof(spark, sf):
    return out(O.cof(O.neighbour_lists(vecs(spark, sf), "key", "vec", 10, with_vec=True)))


@query("subspace_outliers", f"""with {nn_sql(20)}, sh as (select x.a as key, y.a as rkey, count(*)::int as shared from nn x join nn y on x.b = y.b and x.a <> y.a group by all),
  z as (select v.key, w.key as rkey, coalesce(shared, 0)::int as shared from vecs v join vecs w on v.key <> w.key left join sh on sh.key = v.key and sh.rkey = w.key),
  ref as (select key, rkey from z qualify row_number() over (partition by key order by shared desc, rkey) <= 10),
  st as (select ref.key, i, avg(vec[i]) as m, var_pop(vec[i]) as v from ref join vecs on vecs.key = rkey, range(1, 65) r(i) group by ref.key, i),
  nr as (select *, v < 0.8::double * avg(v) over (partition by key) as narrow from st)
  select nr.key, {r6('coalesce(sqrt(sum(case when narrow then (vec[i] - m) * (vec[i] - m) else 0 end)) / nullif(count(*) filter (narrow), 0), 0)')} as score from nr join vecs on vecs.key = nr.key group by nr.key""")
def sod(spark, sf):
    v = vecs(spark, sf)
    return out(O.sod(v, O.neighbour_lists(v, "key", "vec", 20)))


@query("shared_neighbour_reference", f"""with {nn_sql(10)}, sh as (select x.a as key, y.a as rkey, count(*)::int as shared from nn x join nn y on x.b = y.b and x.a <> y.a group by all),
  z as (select v.key, w.key as rkey, coalesce(shared, 0)::int as shared from vecs v join vecs w on v.key <> w.key left join sh on sh.key = v.key and sh.rkey = w.key)
  select key, rkey, shared from z qualify row_number() over (partition by key order by shared desc, rkey) <= 5""")
def shared_reference(spark, sf):
    return O.shared_reference(O.neighbour_lists(vecs(spark, sf), "key", "vec", 10), "key", 5, 128)


@query("affinity_outliers")
def sos(spark, sf):
    return out(O.sos(vecs(spark, sf)))


@query("correlation_integral_outliers", f"""with {VECS}, {PAIRS}, dd as (select a, b, d from pairs union all select key, key, 0 from vecs), md as (select sum(d) / count(*) as m from pairs),
  rd as (select unnest([0.7, 0.8, 0.9, 1.0, 1.1, 1.2, 1.4])::double * m as r from md),
  ct as (select a, r, count(*) filter (d <= 0.5 * r)::double as n from dd, rd group by a, r),
  mo as (select dd.a, ct.r, count(*)::double as c, sum(n) as s, sum(n * n) as q from dd join ct on ct.a = dd.b where dd.d <= ct.r group by dd.a, ct.r),
  ra as (select mo.a, case when c >= 20 then (s / c - n) / nullif(sqrt(greatest(q / c - (s / c) * (s / c), 0)), 0) end as x from mo join ct on ct.a = mo.a and ct.r = mo.r)
  select a as key, {r6('coalesce(max(x), 0)')} as score from ra group by a""")
def loci(spark, sf):
    return out(O.loci(vecs(spark, sf), rows_per_block=256))


@query("cluster_outliers")
def cblof(spark, sf):
    return out(O.cblof(vecs(spark, sf)))


@query("component_outliers")
def pca(spark, sf):
    return out(O.pca_score(vecs(spark, sf)))


@query("robust_covariance_outliers")
def mcd(spark, sf):
    return out(O.mcd(vecs(spark, sf), reweighted=True))


@query("projection_histogram_outliers")
def loda(spark, sf):
    return out(O.loda(vecs(spark, sf)))


@query("random_order_variance_outliers", f"""with {VECS}, b as (select key, 64.0::double as m, list_sum(vec) as s1, list_sum(list_transform(vec, lambda x: x * x)) as s2 from vecs), o as (select *, unnest(range(50)) as it from b),
  c as (select *, sum(m) over w as c, sum(s1) over w as t1, sum(s2) over w as t2 from o window w as (partition by it order by {h32("'0'", 'it', 'key')}, key rows between unbounded preceding and current row))
  select key, {r6('greatest(max(case when c - m < 0.5 then 0 else (t2 / c - power(t1 / c, 2)) - ((t2 - s2) / (c - m) - power((t1 - s1) / (c - m), 2)) end), 0)')} as score from c group by key""")
def lmdd(spark, sf):
    return out(O.lmdd(vecs(spark, sf)))


@query("isolation_forest")
def isolation_forest(spark, sf):
    return out(O.isolation_forest(vecs(spark, sf)))


@query("feature_bagged_outliers")
def feature_bagging(spark, sf):
    return out(O.feature_bagging(vecs(spark, sf)))
