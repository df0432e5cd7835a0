"""Transforms and random rebalancing."""
from __future__ import annotations

from pyspark.sql import functions as F

from raregrain.catalog.fixtures import CASES, NULLS, cases, docs, h32, nulls, query, r6, table
from raregrain.functions import columns as C
from raregrain.operators import prep as P
from raregrain.operators import resample as R

IMP = f"{NULLS}, imp as (select event_id, coalesce(value, (select avg(value) from nulls)) as value, k from nulls)"


@query("mean_imputed", f"with {IMP} select event_id, {r6('value')} as value from imp")
def mean_imputed(spark, sf):
    n = nulls(spark, sf)
    return P.fit_prep(n, ["value"]).impute(n).select("event_id", C.round6("value").alias("value"))


@query("mode_imputed", f"""with {NULLS} select event_id, coalesce(event_type, (select event_type from nulls where event_type is not null group by 1 order by count(*) desc, 1 limit 1)) as event_type from nulls""")
def mode_imputed(spark, sf):
    n = nulls(spark, sf)
    return P.fit_prep(n, [], ["event_type"]).impute(n).select("event_id", "event_type")


@query("standard_scaled", f"with {IMP} select event_id, {r6('(value - (select avg(value) from imp)) / (select stddev_pop(value) from imp)')} as value, {r6('(k - (select avg(k) from imp)) / (select stddev_pop(k) from imp)')} as k from imp")
def scaled(spark, sf):
    n = nulls(spark, sf)
    p = P.fit_prep(n, ["value", "k"])
    return p.scale(p.impute(n)).select("event_id", C.round6("value").alias("value"), C.round6("k").alias("k"))


@query("one_hot_encoded", """with d as (select doc_id, lang, source from labels join documents using (doc_id))
  select doc_id, [(lang = v)::int for v in (select list_sort(list_distinct(list(lang))) from d)]::varchar as lang_flags,
  [(source = v)::int for v in (select list_sort(list_distinct(list(source))) from d)]::varchar as source_flags from d""")
def one_hot(spark, sf):
    d = docs(spark, sf).select("doc_id", "lang", "source")
    p = P.fit_prep(d, [], ["lang", "source"])
    out = p.encode(d)
    def text(c):
        flags = [F.col(f"`{c}={v}`").cast("int").cast("string") for v in p.categories[c]]
        return F.concat(F.lit("["), F.concat_ws(", ", *flags), F.lit("]"))
    return out.select("doc_id", text("lang").alias("lang_flags"), text("source").alias("source_flags"))


@query("assembled_features", f"""with d as (select doc_id, n_chars::double as n_chars, lang from labels join documents using (doc_id)), l as (select list_sort(list_distinct(list(lang))) as ls from d)
  select doc_id, (1 + len(ls))::int as width, {r6('(n_chars - (select avg(n_chars) from d)) / (select stddev_pop(n_chars) from d)')} as first, list_position(ls, lang)::int + 1 as hot from d, l""")
def assembled(spark, sf):
    d = docs(spark, sf).select("doc_id", F.col("n_chars").cast("double").alias("n_chars"), "lang")
    out = P.fit_prep(d, ["n_chars"], ["lang"]).transform(d)
    flags = F.slice("features", 2, F.size("features") - 1)
    return out.select("doc_id", F.size("features").alias("width"), C.round6(F.col("features")[0]).alias("first"), (F.array_position(flags, 1.0) + 1).cast("int").alias("hot"))


@query("median_filled", f"with {NULLS} select event_id, {r6('coalesce(value, (select median(value) from nulls))')} as value from nulls")
def median_filled(spark, sf):
    return P.median_fill(nulls(spark, sf), ["value"]).select("event_id", C.round6("value").alias("value"))


@query("mllib_preprocessed")
def mllib_preprocessed(spark, sf):
    d = docs(spark, sf).select("doc_id", F.col("n_chars").cast("double").alias("n_chars"), "lang", "source")
    return P.mllib_preprocessor(["n_chars"], ["lang", "source"]).fit(d).transform(d).select("doc_id", F.col("features").cast("string").alias("features"))


SIZES = "(select count(*) from cases where target = 1)"


@query("random_over_sample", f"""with {CASES}, m as (select event_id, row_number() over (order by {h32("'42'", 'event_id')}, event_id) as r from cases where target = 1),
  d as (select unnest(range(floor(0.02::double * (select count(*) from cases where target = 0))::bigint - {SIZES})) as draw)
  select event_id, target, 0::bigint as copy from cases union all
  select m.event_id, 1, draw + 1 from d join m on m.r = {h32("'42'", "'over'", 'draw')} % {SIZES} + 1""")
def random_over(spark, sf):
    return R.random_over(cases(spark, sf).select("event_id", "target"), "event_id", "target", 0.02)


@query("random_under_sample", f"""with {CASES} select event_id, target from cases where target = 1 union all
  select event_id, target from (select event_id, target, row_number() over (order by {h32("'42'", 'event_id')}, event_id) as r from cases where target = 0) where r <= floor({SIZES} / 0.05::double)""")
def random_under(spark, sf):
    return R.random_under(cases(spark, sf).select("event_id", "target"), "event_id", "target", 0.05)


@query("epoch_rebalance", f"""with {CASES} select event_id, target, unnest([1, 2, 3])::int as copy from cases where target = 1 union all
  select event_id, target, 1 from (select event_id, target, row_number() over (order by {h32("'42/2'", 'event_id')}, event_id) as r from cases where target = 0) where r <= floor(0.3::double * (select count(*) from cases where target = 0))""")
def epoch_rebalance(spark, sf):
    return R.epoch_rebalance(cases(spark, sf).select("event_id", "target"), "event_id", "target", 3, 0.3, epoch=2)


def _boot_sql(drawn: set[int]) -> str:
    parts = []
    for label in (0, 1):
        if label in drawn:
            parts.append(f"""select (draw // {SIZES})::int as member, draw % {SIZES} as copy, event_id, target from (select unnest(range(3 * {SIZES})) as draw) d
              join (select event_id, target, row_number() over (order by {h32("'42'", 'event_id')}, event_id) as r from cases where target = {label}) m
              on m.r = {h32("'42'", f"'{label}'", 'draw')} % (select count(*) from cases where target = {label}) + 1""")
        else:
            parts.append(f"select unnest([0, 1, 2])::int as member, 0::bigint as copy, event_id, target from cases where target = {label}")
    return f"with {CASES} " + " union all ".join(parts)


for _s, _d in (("majority", {0}), ("not minority", {0}), ("not majority", {1}), ("all", {0, 1})):
    def _run(spark, sf, strategy=_s):
        return R.balanced_bootstrap(cases(spark, sf).select("event_id", "target"), "event_id", "target", 3, strategy)
    query(f"balanced_bootstrap_{_s.replace(' ', '_')}", _boot_sql(_d))(_run)
