"""Collocations against a plain version that counts every phrase as text."""
import random
import re
from collections import Counter

import numpy as np
import pytest

from raregrain.llm import collocations as C
from tests.llm.helpers import clashing, duck, lower_az, rows_of

SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint"


def brute(rows, least=100, top=2000, longest=5, percent=100):
    count, total = Counter(), Counter()
    for text, lang in rows:
        lang = lang if lang is not None else "und"
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", lower_az(text)):
            w = re.findall(r"[^\x20\x09]+", piece)
            total[lang] += len(w)
            for size in range(1, longest + 1):
                for i in range(len(w) - size + 1):
                    count[lang, tuple(w[i:i + size])] += 1
    found = {k: n for k, n in count.items() if n >= least}
    out = []
    for lang in total:
        ranked = []
        for (tongue, p), a in found.items():
            if tongue == lang and len(p) > 1:
                cuts = [(1000 * a * total[lang] // (found[lang, p[:k]] * found[lang, p[k:]]), k) for k in range(1, len(p))]
                longer = [n for (x, q), n in found.items() if x == lang and len(q) > len(p) and any(q[i:i + len(p)] == p for i in range(len(q)))]
                if not any(100 * n >= percent * a for n in longer):
                    score, k = min(cuts)
                    ranked.append((-score, -a, " ".join(p).encode(), found[lang, p[:k]], found[lang, p[k:]]))
        out += [(lang, i + 1, p.decode(), -a, left, right, total[lang], -s) for i, (s, a, p, left, right) in enumerate(sorted(ranked)[:top])]
    return sorted(out)


def table(spark, rows):
    return spark.createDataFrame([(i, t, lang, "s", 0) for i, (t, lang) in enumerate(rows)], SCHEMA)


def result(df):
    return sorted(tuple(r[c] for c in ("lang", "rank", "phrase", "a", "l", "r", "n", "score")) for r in df.collect())


def some_rows(n=60, seed=1):
    rng = random.Random(seed)
    words = ["New", "york", "CITY", "the", "of", "a", "Ärger", "ärger", "naïve", "-", "x1"]
    fixed = ["new york city", "The end of", "a\tb  c d", "one. two", "of,the", "new\nyork"]
    rows = []
    for _ in range(n):
        parts = [rng.choice(fixed) if rng.random() < 0.5 else rng.choice(words) for _ in range(rng.randint(0, 60))]
        rows.append((rng.choice([" ", "  ", " \t"]).join(parts) + rng.choice(["", ".", "!?", "\r\n"]), rng.choice(["en", "de", None])))
    return rows + [(None, "en"), ("", None), ("  ", "fr"), ("...", "fr"), (rows[0][0], rows[0][1]), (rows[0][0], rows[0][1])]


@pytest.mark.parametrize("how", [{}, {"flush": 5}, {"slice_bytes": 700}, {"top": 4}])
def test_equal_to_plain_version(spark, how):
    """Counts handed on in pieces; phrases compared in several passes."""
    rows = some_rows()
    want = brute(rows, least=12, top=how.get("top", 2000))
    assert len(want) > (5 if how.get("top") else 15)
    got = C.collocations(clashing(table(spark, rows)).repartition(3), least=12, **how)
    assert result(got) == want


def test_parameters(spark):
    rows = some_rows(seed=2)
    assert result(C.collocations(table(spark, rows), least=9, longest=3, percent=60)) == brute(rows, least=9, longest=3, percent=60)


def test_words_across_chunks_and_portions(monkeypatch):
    """Hashes do not depend on where bytes are cut."""
    rng = np.random.default_rng(0)
    text = bytes(rng.choice(np.frombuffer(b"abcdE \t.,\n", np.uint8), 5000)) + b"x" * 300 + b" end. " + b"y" * 200
    raw = np.frombuffer(text, np.uint8)
    offsets = np.array([0, 0, 17, 1000, 1000, 5100, 5450, len(text)])
    whole = C.Hasher(3).words(raw, offsets)
    monkeypatch.setattr(C, "CHUNK", 64)
    cut = C.Hasher(3).words(raw, offsets)
    assert all(np.array_equal(a, b) for a, b in zip(whole, cut, strict=True))
    want = [(m.start() + a, m.end() + a) for a, b in zip(offsets[:-1], offsets[1:]) for m in re.finditer(rb"[^ \t.,;:!?\n\x0b\x0c\r]+", text[a:b])]
    assert list(zip(whole[1].tolist(), whole[2].tolist())) == want
    same = {}
    for h, s, e in zip(whole[0].tolist(), whole[1], whole[2]):
        assert same.setdefault(text[s:e].lower(), h) == h
    assert len(set(same.values())) == len(same)
    f, good = C.Hasher(3).grams(whole[0], whole[3], 3)
    seen = {}
    for i in np.flatnonzero(good):
        key = b" ".join(text[whole[1][i + j]:whole[2][i + j]].lower() for j in range(3))
        assert seen.setdefault(key, f[i]) == f[i]
    assert len(set(seen.values())) == len(seen)


def test_collisions_are_found(spark):
    """With few bits fingerprints collide; another base is tried, and without a clean one the operator refuses."""
    rows = some_rows(40)
    with pytest.raises(RuntimeError):
        C.collocations(table(spark, rows), least=12, bits=5, attempts=1)


def test_collisions_start_again(spark):
    rows = [(t, "en") for t, _ in some_rows(25)]
    want = brute(rows, least=12)
    bits = 14
    results = []
    for seed in range(1, 9):
        try:
            results.append(result(C.collocations(table(spark, rows), least=12, bits=bits, attempts=1, seed=seed)) == want)
        except RuntimeError:
            results.append(None)
        if None in results and True in results[results.index(None):]:
            break
    assert False not in results and True in results


def test_bucket_maps(spark, monkeypatch):
    """Ranges with few and with many full buckets, counts above one byte, and blobs added up in steps."""
    rng = np.random.default_rng(0)
    monkeypatch.setattr(C, "FAN", 2)
    wide = 1 << C.RANGE_BITS
    n = rng.integers(0, 400, (9, 2, wide)) * (rng.random((9, 2, wide)) < np.array([0.001, 0.9])[:, None])
    rows = [(1, r, t, C._pack(np.flatnonzero(n[t, r]).astype(np.uint32)), np.minimum(n[t, r][n[t, r] > 0], 300).astype(np.uint32).tobytes()) for t in range(9) for r in range(2)]
    parts = spark.createDataFrame(rows, "size int, range int, task int, low binary, n binary").repartition(9)
    held = C.full_buckets(parts, 300)[1]
    want = np.minimum(n, 300).sum(0) >= 300
    got = np.unpackbits(C._full(held), bitorder="little").astype(bool)
    assert np.array_equal(got[:2 * wide].reshape(2, -1), want) and not got[2 * wide:].any()
    f = np.arange(2 * wide, dtype=np.uint64) << np.uint64(64 - C.MAP_BITS)
    assert np.array_equal(C._passes(C._full(held), f), want.ravel())
    assert len(held[1]) == wide // 8 > len(held[0])


def test_blocks_are_added_up_in_steps(spark, monkeypatch):
    monkeypatch.setattr(C, "FAN", 2)
    rows = some_rows(30, seed=5)
    assert result(C.collocations(table(spark, rows).repartition(9), least=9)) == brute(rows, least=9)


def test_exact_scores_and_ties(spark):
    """Products beyond 64 bits, and ranks by count and then by bytes."""
    rows = [("b b. é z. z é. a a. " * 30, "en"), ("c d. d c " * 30, "en")]
    assert result(C.collocations(table(spark, rows), least=30)) == brute(rows, least=30)
    got = spark.sql("select (cast(1000 as decimal(4, 0)) * a * total) div (cast(l as decimal(20, 0)) * r) as s from values "
                    "(7000000000L, 9000000000000L, 8000000000L, 7000000001L) t(a, total, l, r)").first()["s"]
    assert got == 1000 * 7000000000 * 9000000000000 // (8000000000 * 7000000001)


def test_empty_table(spark):
    got = C.collocations(table(spark, [("a", "en")]).filter("false"))
    assert got.count() == 0 and got.columns == ["lang", "rank", "phrase", "a", "l", "r", "n", "score"]


def test_query_against_sql(spark):
    from raregrain.llm.queries import ORACLES, QUERIES
    sf, name = "/root/testdata/sf0.01", "op13_collocations"
    got = QUERIES[name](spark, sf)
    assert got.count() > 50 and rows_of(got) == duck(ORACLES[name], sf)
