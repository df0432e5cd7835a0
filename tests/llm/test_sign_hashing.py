"""Links and components of vectors against all pairs of cosines."""
import numpy as np
import pytest

from raregrain.llm import sign_hashing as S
from tests.llm.helpers import clashing, duck, rows_of


def brute(ids, vectors, cosine=0.9):
    """(id, links, smallest reachable id) of each row, by comparing all pairs; ids are distinct."""
    ok = [v is not None and len(v) > 0 and all(x is not None and np.isfinite(x) for x in v) and any(v) for v in vectors]
    links = {i: set() for i in ids}
    for a in range(len(ids)):
        for b in range(a):
            if ok[a] and ok[b] and len(vectors[a]) == len(vectors[b]):
                x, y = np.array(vectors[a], float), np.array(vectors[b], float)
                x, y = x / np.abs(x).max(), y / np.abs(y).max()
                if x @ y / np.sqrt((x @ x) * (y @ y)) >= cosine:
                    links[ids[a]].add(ids[b])
                    links[ids[b]].add(ids[a])
    out = {}
    for i in ids:
        seen, todo = {i}, [i]
        while todo:
            todo.extend(links[todo.pop()] - seen)
            seen |= links[i].union(*(links[k] for k in seen))
        out[i] = (len(links[i]), min(seen), i == min(seen))
    return out


def table(spark, ids, vectors, extra=False):
    df = spark.createDataFrame([(i, v, 0) for i, v in zip(ids, vectors, strict=True)], "vec_id bigint, embedding array<double>, label int")
    return clashing(df) if extra else df


def result(df):
    return {r["vec_id"]: (r["n_links"], r["component_id"], r["kept"]) for r in df.collect()}


def clusters(rng, groups, dims=16, noise=0.08):
    """Chains and clouds around random centres, some pairs just above and some just below the threshold."""
    out = []
    for size in groups:
        c = rng.standard_normal(dims)
        c /= np.linalg.norm(c)
        out += [(c + noise * rng.standard_normal(dims)) * rng.uniform(0.1, 50) for _ in range(size)]
    return [v.tolist() for v in out]


def test_equal_to_all_pairs(spark):
    rng = np.random.default_rng(3)
    vectors = clusters(rng, [1] * 150 + [2] * 20 + [5] * 10 + [60], noise=0.07)
    order = rng.permutation(len(vectors))
    vectors = [vectors[k] for k in order]
    ids = [int(x) for x in rng.permutation(10_000)[:len(vectors)]]
    want = brute(ids, vectors)
    assert any(v[0] for v in want.values()) and any(not v[0] for v in want.values())
    assert result(S.near_duplicates(table(spark, ids, vectors))) == want
    # several bits, and buckets cut into blocks that meet in a grid
    assert result(S.near_duplicates(table(spark, ids, vectors, extra=True), rows=8, piece=7)) == want


def test_recall_of_the_tables():
    """Pairs at exactly the asked cosine meet in some table."""
    rng = np.random.default_rng(5)
    bits, tables = S.shape(3_000_000)
    a = rng.standard_normal((3000, 64))
    b = rng.standard_normal((3000, 64))
    a /= np.linalg.norm(a, axis=1, keepdims=True)
    b -= (a * b).sum(1, keepdims=True) * a
    b = 0.9 * a + np.sqrt(1 - 0.81) * b / np.linalg.norm(b, axis=1, keepdims=True)
    assert np.allclose((a * b).sum(1), 0.9)
    met = (S.signed(a, bits, tables, 17) == S.signed(b, bits, tables, 17)).any(1)
    assert met.mean() >= 0.999


def test_rounded_vectors_lose_no_link(spark):
    """The bound on the rounding error holds for pairs at the threshold itself."""
    rng = np.random.default_rng(9)
    a = rng.standard_normal((200, 8))
    a /= np.linalg.norm(a, axis=1, keepdims=True)
    b = rng.standard_normal((200, 8))
    b -= (a * b).sum(1, keepdims=True) * a
    b = 0.9000001 * a + np.sqrt(1 - 0.9000001 ** 2) * b / np.linalg.norm(b, axis=1, keepdims=True)
    vectors = [v.tolist() for v in np.concatenate([a, b])]
    got = result(S.near_duplicates(table(spark, list(range(400)), vectors)))
    assert got == brute(list(range(400)), vectors)


def test_cases(spark):
    nan, inf = float("nan"), float("inf")
    v, w = [1.0, 2.0, 3.0, -0.5], [-3.0, 1.0, 0.2, 5.0]
    ids = [9, 4, 7, 1, 2, 3, 5, 6, 8, 10, 11, 12, 13]
    vectors = [v, v, [2 * x for x in v], None, [], [0.0] * 4, [1.0, None, 3.0, -0.5], [nan, 2.0, 3.0, -0.5], [inf, 2.0, 3.0, -0.5], v[:3],
               [1e200 * x for x in w], [1e-200 * x for x in w], [-x for x in w]]
    assert result(S.near_duplicates(table(spark, ids, vectors, extra=True))) == brute(ids, vectors)
    # a null id, and rows that repeat an id and a vector
    got = S.near_duplicates(table(spark, [None, 3, 3, 8, 8], [v, v, v, v, w])).collect()
    assert sorted((tuple(r) for r in got), key=str) == sorted([(None, 0, None, True), (3, 1, 3, True), (3, 1, 3, True), (8, 1, 3, False), (8, 0, 8, True)], key=str)
    empty = S.near_duplicates(table(spark, [1], [v]).filter("false"))
    assert empty.count() == 0 and empty.columns == ["vec_id", "n_links", "component_id", "kept"]


def test_copies_of_one_vector(spark):
    rng = np.random.default_rng(1)
    v, far = rng.standard_normal(32).tolist(), rng.standard_normal(32).tolist()
    df = spark.range(3000).selectExpr("id + 5 vec_id").crossJoin(table(spark, [0], [v]).select("embedding")).unionByName(table(spark, [1, 2], [[1.01 * x for x in v], far]).drop("label"))
    got = result(S.near_duplicates(df))
    assert got[1] == (3000, 1, True) and got[2] == (0, 2, True) and got[5] == (3000, 1, False) and len(set(got.values())) == 3


def test_query_against_sql(spark, sf):
    from raregrain.llm.queries import ORACLES, QUERIES
    name = "op12_sign_hashing"
    assert rows_of(QUERIES[name](spark, sf)) == duck(ORACLES[name], sf)


def test_shape():
    with pytest.raises(ValueError):
        S.shape(10 ** 15)
    assert S.shape(1, 1.0)[1] == 1
    assert S.shape(10 ** 6)[0] > S.shape(10 ** 4)[0]
