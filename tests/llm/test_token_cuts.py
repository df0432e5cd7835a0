"""Alignment of two tokenizers against a plain version that scans both token lists."""
import hashlib
import random
from collections import Counter

import numpy as np
import pytest

from raregrain.llm import token_cuts as T
from tests.llm.helpers import clashing, documents

ODD = ["a ", " ", "  ", " a", "a  ", "\n", "a\n b", "a \n b", "　 x", "naïve <|endoftext|> x", "  a  b \n\n c\t", "日本語 text 😀 x", "▁x", "a▁b c",
       "x" * 3000, " " * 2500, "é́ ö", "1234567890 " * 50, "don't I'LL 've", "  x​ y", "", None, "</s> <s> <unk> <0x41>", "one two  three", "\x00 \x07", "x\r\ny"]


@pytest.fixture(scope="module")
def both():
    return T.Both()


def tokens(text, both):
    """(ids of A, ids of B, their bytes), or None for a text without tokens; whole texts, by the files' own libraries."""
    if not text:
        return None
    a = both.first.slow.encode(" " + text, add_special_tokens=False).ids
    b = both.second.model.encode(text)
    ba, bb = [both.first.bytes[i] for i in a], [both.second.bytes[i] for i in b]
    return None if b"".join(ba) != (" " + text).encode() or b"".join(bb) != b"".join(ba) else (a, b, ba, bb)


def spans(pieces):
    out, at = [], 0
    for p in pieces:
        out.append((at, at + len(p)))
        at += len(p)
    return out


def brute(texts, both):
    linked, rows = [], []
    for text in texts:
        t = tokens(text, both)
        if t is None:
            linked.append(Counter())
            rows.append((0, 0, 0, 0, ""))
            continue
        a, b, ba, bb = t
        sa, sb = spans(ba), spans(bb)
        shared = sorted({y for _, y in sa} & {y for _, y in sb})
        groups, lo = [], 0
        for hi in shared:
            groups.append(",".join(str(i) for i, (_, y) in zip(a, sa) if lo < y <= hi) + "|" + ",".join(str(i) for i, (_, y) in zip(b, sb) if lo < y <= hi))
            lo = hi
        pairs, j0 = Counter(), 0
        for i, (x, y) in zip(a, sa):
            while sb[j0][1] <= x:
                j0 += 1
            j = j0
            while j < len(sb) and sb[j][0] < y:
                pairs[i, b[j]] += 1
                j += 1
        linked.append(pairs)
        rows.append((len(a), len(b), len(groups), sum(pairs.values()), hashlib.sha256(";".join(groups).encode()).hexdigest()))
    count = Counter(p for c in linked for p in c)
    top = {}
    for (a, _), n in count.items():
        top[a] = max(top.get(a, 0), n)
    return [(*r[:4], sum(k for p, k in c.items() if count[p] == top[p[0]]), sum(k * count[p] for p, k in c.items()), r[4]) for r, c in zip(rows, linked)]


def result(df):
    return sorted(((r["doc_id"], r["n_a"], r["n_b"], r["n_groups"], r["n_links"], r["n_best"], r["count_sum"], r["groups_sha256"]) for r in df.collect()), key=str)


def wanted(ids, texts, both):
    return sorted(((i, *r) for i, r in zip(ids, brute(texts, both))), key=str)


def some_texts(n=40):
    rng = random.Random(4)
    words = ["the", "Haus", "naïve", "qzx", "co-operate", "12,5", "garçon", "e-mail@x.org", "ümlaut", "\n", "", "  ", "zzzzzzzzzz", "don't", "日本"]
    return [" ".join(rng.choice(words) for _ in range(rng.randint(1, 60))) for _ in range(n)]


def test_same_ids_as_the_files_libraries(both):
    """Words encoded once and joined again give what whole texts give."""
    texts = [t for t in ODD + some_texts() if t]
    good, (a, na), (b, nb) = both.tokens(texts)
    want = [(k, t) for k, t in enumerate(tokens(x, both) for x in texts) if t is not None]
    assert good.tolist() == [k for k, _ in want]
    assert a.tolist() == [i for _, t in want for i in t[0]] and na.tolist() == [len(t[0]) for _, t in want]
    assert b.tolist() == [i for _, t in want for i in t[1]] and nb.tolist() == [len(t[1]) for _, t in want]


def test_cuts_are_all_shared_ends():
    rng = np.random.default_rng(2)
    for wide in (2, 3, 9, 60):
        for _ in range(30):
            n = int(rng.integers(1, 400))
            a, b = (np.unique(np.append(rng.integers(1, n * wide, n), n * wide)) for _ in range(2))
            cut = T.shared_cuts(a, b, np.array([len(a) - 1]))
            assert a[cut].tolist() == sorted(set(a.tolist()) & set(b.tolist()))
    # several texts one after the other, and one without any inner cut
    a, b = np.array([3, 5, 10, 11, 13, 20]), np.array([1, 4, 10, 12, 14, 20])
    assert a[T.shared_cuts(a, b, np.array([2, 5]))].tolist() == [10, 20]


def test_digits():
    figure, count = T._digits(100_000)
    for i in (0, 1, 9, 10, 99, 100, 999, 1000, 9999, 10_000, 99_999):
        assert bytes(figure[:count[i], i]).decode() == str(i)


@pytest.mark.parametrize("how", [{}, {"bound": 0}, {"flush": 50}])
def test_equal_to_plain_version(spark, both, how):
    """Counts by broadcast and by join, and handed on in one piece or several."""
    texts = ODD + some_texts() + ["same text, twice"] * 2
    ids = [None, *range(1, len(texts))]
    got = result(T.alignments(clashing(documents(spark, texts, ids)).repartition(3), **how))
    assert got == wanted(ids, texts, both)


def test_kept_words_are_bounded():
    small = T.Both(keep=10)
    big = T.Both()
    for t in some_texts(12):
        x, y = T.align([t, "a b", None], small), T.align([t, "a b", None], big)
        assert all(np.array_equal(x[k], y[k]) for k in x)
    assert len(small.at) < 30 < len(big.at)


def test_whole_texts_when_words_cannot_be_parted(both):
    plain = T.Both()
    plain.by_word = False
    x, y = T.align(some_texts(10) + ODD, plain), T.align(some_texts(10) + ODD, both)
    assert all(np.array_equal(x[k], y[k]) for k in x)


def test_long_text_and_empty_table(spark, both):
    long = "mixed Wörter 123 and so on, " * 150
    assert result(T.alignments(documents(spark, [long, "x" * 20_000]))) == wanted([0, 1], [long, "x" * 20_000], both)
    none = T.alignments(documents(spark, ["a"]).filter("false"))
    assert none.count() == 0 and none.columns == ["doc_id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256", "n_best", "count_sum"]
