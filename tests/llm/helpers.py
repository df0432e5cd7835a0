"""Tables in small, comparison with DuckDB, and plain versions of what the operators compute."""
import os
import re
from collections import Counter

import duckdb

DOCS = "doc_id bigint, text string, lang string, source string, n_chars bigint"
SPACED = re.compile(r"[^\x20\x09-\x0D]+")


def lower_az(text):
    return (text or "").translate({c: c + 32 for c in range(65, 91)})


def documents(spark, texts, ids=None, source="s", lang="en"):
    rows = [(i, t, lang, source, len(t or "")) for i, t in zip(ids or range(len(texts)), texts, strict=True)]
    return spark.createDataFrame(rows, DOCS)


def clashing(df):
    """The same table with columns named like ones that operators make."""
    from pyspark.sql import functions as F
    names = ["w", "pos", "token", "_t", "size", "host", "h", "s", "kept", "score", "spans", "run", "m", "n", "p", "end", "begin", "component_id", "held_out", "key", "row"]
    return df.select("*", *[F.lit("x").alias(c) for c in names if c not in df.columns])


def rows_of(df):
    return Counter(tuple(round(v, 9) if isinstance(v, float) else v for v in r) for r in df.select(*sorted(df.columns)).collect())


def duck(sql, sf_dir=None, **frames):
    con = duckdb.connect()
    for t in ("documents", "pages", "benchmark", "labels", "conversations", "embeddings"):
        if t in frames:
            con.register(f"_{t}", frames[t].toArrow())  # keeps nulls among ids
            con.sql(f"create view {t} as select * from _{t}")
        elif sf_dir:
            path = f"{sf_dir}/{t}.parquet"
            con.sql(f"create view {t} as select * from '{path if os.path.isfile(path) else path + '/*.parquet'}'")
    rel = con.sql(sql)
    cols = sorted(rel.columns)
    at = [rel.columns.index(c) for c in cols]
    return Counter(tuple(round(r[i], 9) if isinstance(r[i], float) else r[i] for i in at) for r in rel.fetchall())


def shingles(text, size=5):
    w = SPACED.findall(lower_az(text))
    k = min(size, len(w))
    return {tuple(w[i:i + k]) for i in range(len(w) - k + 1)} if w else set()


def brute_components(ids, texts, percent):
    """Smallest reachable id of every document, links by comparing all pairs of sets."""
    sets = [shingles(t) for t in texts]
    parent = dict(zip(ids, ids, strict=True))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x
    for i in range(len(ids)):
        for j in range(i):
            if sets[i] and sets[j]:
                both = len(sets[i] & sets[j])
                if 100 * both >= percent * (len(sets[i]) + len(sets[j]) - both):
                    a, b = root(ids[i]), root(ids[j])
                    parent[max(a, b)] = min(a, b)
    return {i: root(i) for i in ids}
