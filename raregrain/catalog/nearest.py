"""Neighbour search, all-pairs sums, neighbour-based rebalancing, feature selection."""
from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from raregrain.catalog.fixtures import CASES, PAIRS, SCORED, VECS, cases, docs, h32, query, r6, scored, table, vecs
from raregrain.functions import columns as C
from raregrain.operators import neighbours as N
from raregrain.operators import resample as R
from raregrain.operators import select as K


def nn_sql(k: int, left: str = "true", right: str = "true", base: str = VECS) -> str:
    return f"""{base}, {PAIRS}, nn as (select *, row_number() over (partition by a order by d, b) as place from pairs where {left} and {right} qualify place <= {k})"""


# ---- selection ----
DISC = f"{CASES}, disc as (select event_id, target, floor(value / 50)::int as v, floor(k / 20)::int as kk, hr::int as h, code as t from cases)"
DISC_COLS = ["v", "kk", "h", "t"]


def disc(spark, sf):
    return cases(spark, sf).select("event_id", "target", F.floor(F.col("value") / 50).cast("int").alias("v"), F.floor(F.col("k") / 20).cast("int").alias("kk"),
                                   F.col("hr").cast("int").alias("h"), F.col("code").alias("t"))


def _mi_union(pairs) -> str:
    rows = " union all ".join(f"select '{a}' as f, '{b}' as g, {a} as a, {b} as b from disc" for a, b in pairs)
    return f"""longp as ({rows}), jn as (select f, g, a, b, count(*)::double as n from longp group by all),
    jm as (select *, sum(n) over (partition by f, g, a) as na, sum(n) over (partition by f, g, b) as nb, sum(n) over (partition by f, g) as nn from jn),
    mi as (select f, g, sum(n / nn * log2(n * nn / (na * nb))) as mi from jm group by all)"""


REL = _mi_union([(c, "target") for c in DISC_COLS])
ALL_MI = _mi_union([(c, d) for c in DISC_COLS for d in [*DISC_COLS, "target"] if c != d])


@query("joint_histogram", f"with {DISC} select v - (select min(v) from disc) as a, t - (select min(t) from disc) as b, {r6('count(*)::double / (select count(*) from disc)')} as share from disc group by v, t")
def joint_histogram(spark, sf):
    return K.joint_histogram(disc(spark, sf), "v", "t").select("a", "b", C.round6("share").alias("share"))


@query("mutual_information", f"with {DISC}, {REL} select f as feature, {r6('mi')} as mi from mi")
def mutual_information(spark, sf):
    return K.mutual_info(disc(spark, sf), DISC_COLS, "target").select("feature", C.round6("mi").alias("mi"))


@query("max_relevance_ranking", f"with {DISC}, {REL} select f as feature, row_number() over (order by mi.mi desc)::int as place, {r6('mi')} as mi from mi")
def relevance_ranking(spark, sf):
    return K.max_relevance(disc(spark, sf), DISC_COLS, "target").select("feature", "place", C.round6("mi").alias("mi"))


def _greedy(score: str, rel: str, red: str) -> str:
    return f"""s1 as (select f, rel as score from {rel} order by rel desc limit 1),
    c2 as (select r.f, rel, avg(red) as red from {rel} r join {red} p on p.f = r.f and p.g in (select f from s1) where r.f not in (select f from s1) group by all),
    s2 as (select f, {score} as score from c2 order by 2 desc, rel desc limit 1),
    c3 as (select r.f, rel, avg(red) as red from {rel} r join {red} p on p.f = r.f and p.g in (select f from s1 union all select f from s2) where r.f not in (select f from s1 union all select f from s2) group by all),
    s3 as (select f, {score} as score from c3 order by 2 desc, rel desc limit 1)
    select 1 as place, f as feature, {r6('score')} as score from s1 union all select 2, f, {r6('score')} from s2 union all select 3, f, {r6('score')} from s3"""


_MI_PARTS = "relt as (select f, mi as rel from mi where g = 'target'), redt as (select f, g, mi as red from mi where g <> 'target')"
for _m, _e in (("MID", "rel - red"), ("MIQ", "rel / (red + 0.0001::double)")):
    def _mrmr(spark, sf, method=_m):
        return K.mrmr(disc(spark, sf), DISC_COLS, "target", method, 3).select("place", "feature", C.round6("score").alias("score"))
    query(f"mrmr_{'difference' if _m == 'MID' else 'quotient'}", f"with {DISC}, {ALL_MI}, {_MI_PARTS}, {_greedy(_e, 'relt', 'redt')}")(_mrmr)

# the embeddings' 64 columns, cut into steps of a quarter
WIDE_COLS = [f"x{i}" for i in range(64)]
WIDE = f"""{VECS}, wl as (select key, target, 'x' || (i - 1) as f, floor(vec[i] * 4)::int as a from vecs, range(1, 65) r(i)),
  relt as (select f, sum(n / nn * log2(n * nn / (na * nb))) as rel from (select *, sum(n) over (partition by f, a) as na, sum(n) over (partition by f, target) as nb, sum(n) over (partition by f) as nn
    from (select f, a, target, count(*)::double as n from wl group by all)) group by f),
  redt as (select f, g, sum(n / nn * log2(n * nn / (na * nb))) as red from (select *, sum(n) over (partition by f, g, a) as na, sum(n) over (partition by f, g, b) as nb, sum(n) over (partition by f, g) as nn
    from (select x.f, y.f as g, x.a, y.a as b, count(*)::double as n from wl x join wl y on x.key = y.key and x.f <> y.f group by all)) group by f, g)"""


def _greedy_picks(score: str, k: int, relevance: str = "relt") -> str:
    steps = [f"c1 as materialized (select f, rel as score, 1 as place from {relevance} order by rel desc limit 1)"]
    for i in range(2, k + 1):
        steps.append(f"""c{i} as materialized (select * from c{i - 1} union all (select f, {score} as score, {i} from (select r.f, rel, avg(red) as red from {relevance} r join redt p on p.f = r.f
          where p.g in (select f from c{i - 1}) and r.f not in (select f from c{i - 1}) group by all) order by 2 desc, rel desc limit 1))""")
    return f"{', '.join(steps)} select place, f as feature, {r6('score')} as score from c{k}"


for _m, _e, _k in (("MID", "rel - red", 10), ("MIQ", "rel / (red + 0.0001::double)", 20)):
    def _mrmr_wide(spark, sf, method=_m, k=_k, pool=None):
        wide = vecs(spark, sf).select("key", "target", *[F.floor(F.col("vec")[i] * 4).cast("int").alias(c) for i, c in enumerate(WIDE_COLS)])
        return K.mrmr(wide, WIDE_COLS, "target", method, k, pool).select("place", "feature", C.round6("score").alias("score"))
    query(f"mrmr_{'difference' if _m == 'MID' else 'quotient'}_of_64", f"with {WIDE}, {_greedy_picks(_e, _k)}")(_mrmr_wide)


@query("mrmr_quotient_within_pool", f"""with {WIDE}, pooled as materialized (select * from relt order by rel desc limit 16),
  {_greedy_picks("rel / (red + 0.0001::double)", 10, "pooled")}""")
def mrmr_pool(spark, sf):
    return _mrmr_wide(spark, sf, "MIQ", 10, 16)


NUM_COLS = ["value", "k", "hr"]
ANOVA = """lf as (select target, 'value' as f, value as x from cases union all select target, 'k', k from cases union all select target, 'hr', hr from cases),
  g as (select f, target, count(*)::double as n, avg(x) as m, var_pop(x) as v from lf group by all), gm as (select *, sum(n*m) over (partition by f) / sum(n) over (partition by f) as mm from g),
  fs as (select f, (sum(n*(m-mm)*(m-mm)) / (count(*)-1)) / (sum(n*v) / (sum(n)-count(*))) as rel from gm group by f)"""


@query("anova_f_statistic", f"with {CASES}, {ANOVA} select f as feature, {r6('rel')} as f from fs")
def anova(spark, sf):
    return K.anova_table(cases(spark, sf), NUM_COLS, "target").select("feature", C.round6("f").alias("f"))


_CORR = " union all ".join(f"select '{a}' as f, '{b}' as g, greatest(abs(corr({a}, {b})), 0.001::double) as red from cases" for a in NUM_COLS for b in NUM_COLS if a != b)
_CORR_RAW = _CORR.replace("greatest(", "").replace(", 0.001::double)", "")


@query("mrmr_f_and_correlation", f"with {CASES}, {ANOVA}, cr as ({_CORR_RAW}), {_greedy('rel / greatest(red, 0.001::double)', 'fs', 'cr')}")
def mrmr_fcq(spark, sf):
    return K.mrmr(cases(spark, sf), NUM_COLS, "target", "FCQ", 3).select("place", "feature", C.round6("score").alias("score"))


@query("pairwise_correlations", f"with {CASES} " + " union all ".join(f"select '{c}' as feature, {r6(f'abs(corr({c}, value))')} as r from cases" for c in ("k", "hr", "target")))
def correlations(spark, sf):
    row = cases(spark, sf).agg(*[F.abs(F.corr(c, "value")).alias(c) for c in ("k", "hr", "target")])
    return row.selectExpr("stack(3, 'k', k, 'hr', hr, 'target', target) as (feature, r)").select("feature", C.round6("r").alias("r"))


@query("features_by_weight", f"""with {VECS}, w as (select i as feature, greatest(avg(vec[i]), 0) as weight from vecs, range(1, 65) r(i) group by i) select feature::int as feature, {r6('weight')} as weight from w where weight > 0 order by w.weight desc, feature limit 10""")
def features_by_weight(spark, sf):
    w = vecs(spark, sf).select(F.posexplode("vec").alias("p", "x")).groupBy((F.col("p") + 1).alias("feature")).agg(F.greatest(F.avg("x"), F.lit(0.0)).alias("weight"))
    return K.top_by_weight(w, 10).select("feature", C.round6("weight").alias("weight"))


# ---- all pairs and kernels ----
def _kernel_sql(dist: str, kernel: str) -> str:
    s = "exp(-d*d)" if kernel == "rbf" else "exp(-d)"
    return f"""pw as (select a.key as a, b.target as tb, {dist} as d from vecs a join vecs b on a.key <> b.key), ks as (select a, count(*) as n, avg(d) as mean_distance, min(d) as nearest, sum({s}) as s, sum({s} * tb) / sum({s}) as prediction from pw group by a)"""


WEIGHTS = [(i % 4) / 2.0 for i in range(1, 65)]
_E = "sqrt(greatest(list_sum(list_transform(list_zip(a.vec, b.vec), lambda z, i: (i % 4) / 2.0::double * (z[1]-z[2])*(z[1]-z[2]))), 1e-300))"
_M3 = "power(greatest(list_sum(list_transform(list_zip(a.vec, b.vec), lambda z, i: (i % 4) / 2.0::double * power(abs(z[1]-z[2]), 3))), 1e-300), 1/3.0::double)"
_CB = "list_sum(list_transform(list_zip(a.vec, b.vec), lambda z, i: (i % 4) / 2.0::double * abs(z[1]-z[2])))"


def _kernel_query(metric: str, p: float, kernel: str):
    def run(spark, sf):
        blocks, parts = N.pack(vecs(spark, sf), "key", "vec", "target", 256)
        out = N.pair_sums(blocks, parts, WEIGHTS, metric, p, kernel)
        return out.select("key", "n", *[C.round6(e).alias(a) for e, a in ((F.col("dist") / F.col("n"), "mean_distance"), (F.col("nearest"), "nearest"), (F.col("s"), "s"), (F.col("sy") / F.col("s"), "prediction"))])
    return run


for _name, _d, _metric, _p, _kern in (("euclidean_all_pairs_exp", _E, "euclidean", 2.0, "exp"), ("euclidean_all_pairs_rbf", _E, "euclidean", 2.0, "rbf"),
                                      ("minkowski_all_pairs_exp", _M3, "minkowski", 3.0, "exp"), ("cityblock_all_pairs_exp", _CB, "cityblock", 1.0, "exp")):
    query(_name, f"with {VECS}, {_kernel_sql(_d, _kern)} select a as key, n, {r6('mean_distance')} as mean_distance, {r6('nearest')} as nearest, {r6('s')} as s, {r6('prediction')} as prediction from ks")(_kernel_query(_metric, _p, _kern))


@query("leave_one_out_errors", f"""with {VECS}, pw as (select a.key as a, a.target as ta, b.target as tb, sqrt(greatest(list_sum(list_transform(list_zip(a.vec, b.vec), lambda z: (z[1]-z[2])*(z[1]-z[2]))), 1e-300)) as d from vecs a join vecs b on a.key <> b.key),
  p as (select a, ta as y, sum(exp(-d) * tb) / sum(exp(-d)) as p from pw group by all)
  select {r6('avg((y-p)*(y-p))')} as mse, {r6('avg(abs(y-p))')} as mae, {r6('avg(case when abs(y-p) <= 0.2::double then 0.5*(y-p)*(y-p) else 0.2::double*abs(y-p) - 0.5*0.2::double*0.2::double end)')} as huber, {r6('avg(-ln(greatest(1 - abs(y-p), 1e-300)))')} as ce from p""")
def loo_errors(spark, sf):
    from raregrain.operators.wknn import loo_predictions, mean_errors
    return mean_errors(loo_predictions(vecs(spark, sf), "key", "vec", "target", [1.0] * 64), delta=0.2).select(*[C.round6(c).alias(c) for c in ("mse", "mae", "huber", "ce")])


@query("weight_penalties", f"""with {VECS}, w as (select i, abs(avg(vec[i])) as w from vecs, range(1, 65) r(i) group by i)
  select {r6('2 * sum(1/(1+exp(-100*w)) - 0.5::double)')} as l0, {r6('sum(w)')} as l1, {r6('sum(w*w)')} as l2 from w""")
def weight_penalties(spark, sf):
    from raregrain.operators.wknn import penalties
    w = vecs(spark, sf).select(F.posexplode("vec").alias("p", "x")).groupBy("p").agg(F.abs(F.avg("x")).alias("weight"))
    return penalties(w).select(*[C.round6(c).alias(c) for c in ("l0", "l1", "l2")])


@query("nearest_five", f"with {nn_sql(5)} select a as key, place::int as place, b as nkey, {r6('d')} as distance from nn")
def nearest_five(spark, sf):
    v = vecs(spark, sf)
    return N.edges(N.knn(v, None, 5, rows_per_block=128)).select("key", "place", "nkey", C.round6("distance").alias("distance"))


@query("nearest_minority_three", f"with {nn_sql(3, 'ta = 0', 'tb = 1')} select a as key, place::int as place, b as nkey, {r6('d')} as distance from nn")
def nearest_minority(spark, sf):
    v = vecs(spark, sf)
    return N.edges(N.knn(v.filter("target = 0"), v.filter("target = 1"), 3)).select("key", "place", "nkey", C.round6("distance").alias("distance"))


# ---- neighbour based rebalancing ----
SMOTE_SQL = f"""{nn_sql(5, 'ta = 1', 'tb = 1')}, {{seeds}}, dr as (select unnest(range((select count(*) from vecs where target = 0) - (select count(*) from vecs where target = 1))) as draw),
  pk as (select draw, s.key as seed_key, {h32("'42'", "'sn'", 'draw')} % 5 + 1 as place, {h32("'42'", "'su'", 'draw')} / 4294967296.0::double as u from dr join seeds s on s.r = {h32("'42'", "'s'", 'draw')} % (select count(*) from seeds) + 1),
  made as (select draw + (select max(key) + 1 from vecs) as key, [x + u * (z - x) for x, z in list_zip(v.vec, w.vec)] as vec from pk join vecs v on v.key = seed_key join nn on nn.a = seed_key and nn.place = pk.place join vecs w on w.key = nn.b)"""
SMOTE_SQL = SMOTE_SQL.replace("[x + u * (z - x) for x, z in list_zip(v.vec, w.vec)]", "list_transform(list_zip(v.vec, w.vec), lambda p: p[1] + u * (p[2] - p[1]))")
SEEDS_ALL = f"seeds as (select key, row_number() over (order by {h32(chr(39)+'42'+chr(39), 'key')}, key) as r from vecs where target = 1)"
DANGER = f"""n10 as (select a, d, tb, row_number() over (partition by a order by d, b) as place from pairs where ta = 1 qualify place <= 10),
  danger as (select a as key, sum(1 - tb) as majority_near from n10 group by a having sum(1 - tb) >= 5 and sum(1 - tb) < 10),
  seeds as (select key, row_number() over (order by {h32("'42'", 'key')}, key) as r from danger)"""
OUT = f"select key, target, false as synthetic, {r6('list_sum(vec)')} as total, {r6('vec[1]')} as first from vecs union all select key, 1, true, {r6('list_sum(vec)')}, {r6('vec[1]')} from made"


def _resampled(df):
    return df.select("key", "target", "synthetic", C.round6(F.aggregate("vec", F.lit(0.0), lambda s, x: s + x)).alias("total"), C.round6(F.col("vec")[0]).alias("first"))


@query("smote", f"with {SMOTE_SQL.format(seeds=SEEDS_ALL)} {OUT}")
def smote(spark, sf):
    return _resampled(R.smote(vecs(spark, sf), "key", "vec", "target"))


@query("smote_text_keys", f"""with {SMOTE_SQL.format(seeds=SEEDS_ALL)}, topped as (select *, (select max(cast(key as varchar)) from vecs) || '/' || (key - 1 - (select max(key) from vecs)) as name from made)
  select cast(key as varchar) as key, target, false as synthetic, {r6('list_sum(vec)')} as total, {r6('vec[1]')} as first from vecs union all select name, 1, true, {r6('list_sum(vec)')}, {r6('vec[1]')} from topped""")
def smote_text_keys(spark, sf):
    return _resampled(R.smote(vecs(spark, sf).withColumn("key", F.col("key").cast("string")), "key", "vec", "target"))


@query("danger_rows", f"with {VECS}, {PAIRS}, {DANGER} select key, majority_near::int as majority_near from danger")
def danger(spark, sf):
    return R.danger_rows(vecs(spark, sf), "key", "vec", "target").select("key", "majority_near")


@query("borderline_smote", f"with {SMOTE_SQL.format(seeds=DANGER)} {OUT}")
def borderline(spark, sf):
    return _resampled(R.borderline_smote(vecs(spark, sf), "key", "vec", "target"))


@query("near_miss", f"""with {nn_sql(3, 'ta = 0', 'tb = 1')}, md as (select a as key, avg(d) as m from nn group by a)
  select key, 1 as target, null::double as mean_distance from vecs where target = 1 union all
  (select key, 0, {r6('m')} from md order by m, key limit (select count(*) from vecs where target = 1))""")
def near_miss(spark, sf):
    return R.near_miss(vecs(spark, sf), "key", "vec", "target").select("key", "target", C.round6("mean_distance").alias("mean_distance"))


TOMEK = f"{nn_sql(1)}, links as (select x.a, x.ta, x.b from nn x join nn y on x.b = y.a and y.b = x.a where x.ta <> x.tb)"


@query("tomek_links", f"with {TOMEK} select a, b, ta as a_target from links")
def tomek_links(spark, sf):
    return R.tomek_links(vecs(spark, sf), "key", "vec", "target").select("a", "b", "a_target")


@query("tomek_cleaned", f"with {TOMEK} select key, target from vecs where key not in (select a from links where ta = 0)")
def tomek(spark, sf):
    return R.tomek(vecs(spark, sf), "key", "vec", "target").select("key", "target")


@query("edited_nearest_neighbours", f"with {nn_sql(3)} select key, target from vecs where key not in (select a from nn where ta <> tb)")
def enn(spark, sf):
    return R.edited_nearest(vecs(spark, sf), "key", "vec", "target").select("key", "target")


def _shape(df):
    return df.select("key", "target", F.col("synthetic"))


ADASYN = f"""{nn_sql(5, 'ta = 1')}, sh as (select a as key, sum(1 - tb) / 5.0::double as r from nn group by a),
  g as (select key, round(r * (((select count(*) from vecs where target = 0) - (select count(*) from vecs where target = 1)) / (select sum(r) from sh)))::bigint as g from sh),
  near as (select *, row_number() over (partition by a order by d, b) as place from pairs where ta = 1 and tb = 1 qualify place <= 5),
  dr as (select key, unnest(range(1, g + 1)) as j from g), nm as (select key, j, key || '/' || j as name from dr),
  rk as (select *, row_number() over (order by {h32("'42'", 'name')}, name) - 1 as draw, {h32("'42'", "'an'", 'key', 'j')} % 5 + 1 as place, {h32("'42'", "'au'", 'key', 'j')} / 4294967296.0::double as u from nm),
  made as (select draw + (select max(key) + 1 from vecs) as key, list_transform(list_zip(v.vec, w.vec), lambda p: p[1] + u * (p[2] - p[1])) as vec
    from rk join vecs v on v.key = rk.key join near on near.a = rk.key and near.place = rk.place join vecs w on w.key = near.b)"""


@query("adasyn", f"with {ADASYN} {OUT}")
def adasyn(spark, sf):
    return _resampled(R.adasyn(vecs(spark, sf), "key", "vec", "target"))


def doc_cases(spark, sf):
    return docs(spark, sf).select(F.col("doc_id").alias("key"), "lang", "source", F.col("toxic").alias("target"))


@query("class_profiles", f"""with d as (select lang, source, toxic from labels join documents using (doc_id)), l as (select 'lang' as c, lang as v, toxic from d union all select 'source', source, toxic from d)
  select c as "column", v as value, {r6('avg((toxic = 0)::int)')} as p0, {r6('avg((toxic = 1)::int)')} as p1 from l group by c, v""")
def class_profiles(spark, sf):
    return R.class_profiles(doc_cases(spark, sf), ["lang", "source"], "target").select("column", "value", C.round6("p0").alias("p0"), C.round6("p1").alias("p1"))


SMOTEN = f"""d as (select doc_id as key, lang, source, toxic as target from labels join documents using (doc_id)),
  pl as (select lang, avg((target = 0)::int) as l0, avg((target = 1)::int) as l1 from d group by 1), ps as (select source, avg((target = 0)::int) as s0, avg((target = 1)::int) as s1 from d group by 1),
  m as (select key, lang, source, l0, l1, s0, s1 from d join pl using (lang) join ps using (source) where target = 1),
  nn as (select a.key as a, b.key as b, b.lang, b.source, abs(a.l0 - b.l0) + abs(a.l1 - b.l1) + abs(a.s0 - b.s0) + abs(a.s1 - b.s1) as d from m a join m b on a.key <> b.key
    qualify row_number() over (partition by a.key order by abs(a.l0 - b.l0) + abs(a.l1 - b.l1) + abs(a.s0 - b.s0) + abs(a.s1 - b.s1), b.key) <= 5),
  vl as (select a, lang from nn group by a, lang qualify row_number() over (partition by a order by count(*) desc, lang) = 1), vs as (select a, source from nn group by a, source qualify row_number() over (partition by a order by count(*) desc, source) = 1),
  seeds as (select key, row_number() over (order by {h32("'42'", 'key')}, key) as r from m), dr as (select unnest(range((select count(*) filter (target = 0) - count(*) filter (target = 1) from d))) as draw)"""


@query("smoten", f"""with {SMOTEN} select key, lang, source, target, false as synthetic from d union all
  select draw + (select max(key) + 1 from d), vl.lang, vs.source, 1, true from dr join seeds on seeds.r = {h32("'42'", "'s'", 'draw')} % (select count(*) from seeds) + 1 join vl on vl.a = seeds.key join vs on vs.a = seeds.key""")
def smoten(spark, sf):
    return R.smoten(doc_cases(spark, sf), "key", ["lang", "source"], "target")


@query("kmeans_smote")
def kmeans_smote(spark, sf):
    return _resampled(R.kmeans_smote(vecs(spark, sf), "key", "vec", "target", k=3, clusters=3, threshold=0.01))


# one round: every majority row to its nearest centre, every centre to its rows' mean; rounds end when all centres keep their rows
LLOYD = """near as (select m.key, c.num, m.vec from maj m, lloyd c where c.moved qualify row_number() over (partition by m.key
    order by list_sum(list_transform(list_zip(m.vec, c.vec), lambda z: (z[1]-z[2])*(z[1]-z[2]))), c.num) = 1),
  means as (select num, list(x order by d) as vec from (select num, d, avg(vec[d]) as x from near, range(1, 65) t(d) group by num, d) group by num),
  held as (select num, string_agg(key::varchar, ',' order by key) as keys from near group by num),
  next as (select c.i, c.num, coalesce(means.vec, c.vec) as vec, coalesce(held.keys, 'none') as keys, c.keys as before
    from lloyd c left join means using (num) left join held using (num) where c.moved)
  select i + 1, num, vec, keys, bool_or(keys <> before) over () from next"""


@query("cluster_centroids", f"""with recursive {VECS}, maj as (select key, vec, row_number() over (order by {h32("'42'", 'key')}, key) - 1 as num from vecs where target = 0),
  lloyd(i, num, vec, keys, moved) as (select 0, num, vec, '', true from maj where num < (select count(*) from vecs where target = 1) union all (with {LLOYD})),
  last as (select * from lloyd where i = (select max(i) from lloyd))
  select key, target, false as synthetic, {r6('list_sum(vec)')} as total, {r6('vec[1]')} as first from vecs where target = 1 union all
  select num + (select max(key) + 1 from vecs), 0, true, {r6('list_sum(vec)')}, {r6('vec[1]')} from last""")
def cluster_centroids(spark, sf):
    return _resampled(R.cluster_centroids(vecs(spark, sf), "key", "vec", "target"))


GROWN = f"""{SMOTE_SQL.format(seeds=SEEDS_ALL)}, grown as (select key, vec, target, false as synthetic from vecs union all select key, vec, 1, true from made),
  gp as (select a.key as a, b.key as b, a.target as ta, b.target as tb, sqrt(list_sum(list_transform(list_zip(a.vec, b.vec), lambda z: (z[1]-z[2])*(z[1]-z[2])))) as d from grown a join grown b on a.key <> b.key)"""


@query("smote_tomek", f"""with {GROWN}, g1 as (select * from gp qualify row_number() over (partition by a order by d, b) = 1), lk as (select x.a from g1 x join g1 y on x.b = y.a and y.b = x.a where x.ta <> x.tb)
  select key, target, synthetic from grown where key not in (select a from lk)""")
def smote_tomek(spark, sf):
    return _shape(R.smote_tomek(vecs(spark, sf), "key", "vec", "target"))


@query("smote_edited", f"""with {GROWN}, g3 as (select * from gp qualify row_number() over (partition by a order by d, b) <= 3)
  select key, target, synthetic from grown where key not in (select a from g3 where ta <> tb)""")
def smote_enn(spark, sf):
    return _shape(R.smote_enn(vecs(spark, sf), "key", "vec", "target"))


@query("hardness_bins", f"""with {SCORED}, s as (select event_id, target, score, abs(score - target) as h from scored where trial = 1 and target = 0)
  select event_id, least(floor((h - (select min(h) from s)) * 5 / ((select max(h) from s) - (select min(h) from s))), 4)::int as bin from s""")
def hardness_bins(spark, sf):
    s = scored(spark, sf).filter("trial = 1 and target = 0")
    return R.hardness_bins(s, "target", "score").select("event_id", "bin")


@query("self_paced_sample", f"""with {SCORED}, s as (select event_id, target, score, abs(score - target) as h from scored where trial = 1 and target = 0),
  b as (select *, least(floor((h - (select min(h) from s)) * 5 / ((select max(h) from s) - (select min(h) from s))), 4)::int as bin from s),
  st as (select bin, count(*) as n, 1 / (avg(h) + tan(pi() * 2 / 10) + 1e-12) as w from b group by bin),
  q as (select bin, least(n, round((select count(*) from scored where trial = 1 and target = 1) * w / sum(w) over ()))::bigint as q from st)
  select event_id, target, score from scored where trial = 1 and target = 1 union all
  select event_id, target, score from (select b.*, q, row_number() over (partition by b.bin order by {h32("'42/2'", 'event_id')}, event_id) as r from b join q using (bin)) where r <= q""")
def self_paced(spark, sf):
    return R.self_paced_under(scored(spark, sf).filter("trial = 1"), "event_id", "target", "score", 2, 5).select("event_id", "target", "score")


@query("cascade_kept_rows", f"""with {SCORED}, s as (select event_id, target, score from scored where trial = 1), c as (select count(*) filter (target = 1)::double as p, count(*) filter (target = 0)::double as n from s)
  select event_id, target from s where target = 1 union all (select event_id, target from s where target = 0 order by -abs(score - target), event_id limit (select ceil(n * power(p / n, 1 / 4.0::double))::bigint from c))""")
def cascade_kept(spark, sf):
    s = scored(spark, sf).filter("trial = 1")
    from raregrain.operators.weights import class_sizes
    neg, pos = class_sizes(s)
    return R.cascade_keep(s, "event_id", "target", "score", pos / neg, 5).select("event_id", "target")
