"""Language identification with language-bitmask n-gram filters.

A language's profile is the set of character n-grams that make up at least `share` of its n-grams. All
profiles lie in one bit-sliced Bloom filter: a slot holds one bit per language, so that the AND of an
n-gram's slots returns all languages that contain it. A text's n-grams give a popcount per language; the
hits that a filter as full as this language's gives by chance are taken off, and the largest count decides.

Defined cases: a null text, or one without a letter, is `und` with score 0; without any learnt
language everything is `und`; ties go to the language first in code-point order; repeated rows get equal
results; a null id is kept and not learnt from.
"""
from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from raregrain.llm.common import held_out, learnable, mix, portions, shared, travels
from raregrain.llm.grams import pieces

travels(__name__)

SIZES = (2, 3, 4)
SLICES = 3
#: Learnt from at most about so many documents of each language (chosen by a hash of the id), whole texts.
FIT_DOCS = 3000
#: So many languages at most (their number bounds the filter's width).
MAX_LANGUAGES = 4096


def slots(h: np.ndarray, bits: int) -> list[np.ndarray]:
    step = np.uint64(64 - bits)
    return [(mix(h + np.uint64((0x9E3779B97F4A7C15 * (k + 1)) & 0xFFFFFFFFFFFFFFFF)) >> step).astype(np.int64) for k in range(SLICES)]


class Filter:
    """The bit-sliced filter: `table[slot]` holds a bit for every language."""

    def __init__(self, languages: list[str], profiles: list[np.ndarray]):
        most = max([len(p) for p in profiles], default=0)
        self.languages, self.bits = languages, max(12, (8 * max(most, 1) - 1).bit_length())
        self.table = np.zeros((1 << self.bits, (len(languages) + 63) // 64), np.uint64)
        for i, p in enumerate(profiles):
            for at in slots(p, self.bits):
                self.table[at, i // 64] |= np.uint64(1 << (i % 64))
        fill = [((self.table[:, i // 64] >> np.uint64(i % 64)) & np.uint64(1)).mean() for i in range(len(languages))]
        self.chance = np.array(fill) ** SLICES

    def masks(self, h: np.ndarray) -> np.ndarray:
        """Bitmask of the languages that contain each n-gram."""
        a, *rest = slots(h, self.bits)
        found = self.table[a]
        for b in rest:
            found &= self.table[b]
        return found

    def decide(self, texts: list[str | None]) -> tuple[list[str], list[float]]:
        n = np.zeros(len(texts))
        hits = np.zeros((len(texts), len(self.languages)))
        for piece in pieces(texts, max(SIZES)):
            for size in SIZES:
                h, owner = piece.grams(size)
                n += np.bincount(owner, minlength=len(texts))
                found = self.masks(h)
                for i in range(len(self.languages)):
                    hits[:, i] += np.bincount(owner, (found[:, i // 64] >> np.uint64(i % 64)) & np.uint64(1), len(texts))
        if not self.languages:
            return ["und"] * len(texts), [0.0] * len(texts)
        true = np.maximum(hits - n[:, None] * self.chance, 0) / (1 - np.minimum(self.chance, 0.999999))
        best = true.argmax(1)
        score = np.minimum(true[np.arange(len(texts)), best] / np.maximum(n, 1), 1.0)
        lettered = n > 0
        return [self.languages[b] if ok else "und" for b, ok in zip(best, lettered, strict=True)], np.where(lettered, score, 0.0).tolist()


def fit(docs: DataFrame, fit_docs: int = FIT_DOCS, share: float = 2e-5) -> Filter:
    """Profiles from the rows that may be learnt from. A profile has at most 1 / `share` n-grams of each size, so
    what reaches the driver is bounded; n-grams are counted where the texts are before counts are joined."""
    import pyarrow as pa

    rows = docs.select("doc_id", "text", "lang").filter(F.col("lang").isNotNull() & F.col("text").isNotNull() & learnable())
    counts = rows.groupBy("lang").count().limit(MAX_LANGUAGES + 1).collect()
    if len(counts) > MAX_LANGUAGES:
        raise ValueError(f"more than {MAX_LANGUAGES} languages")
    if not counts:
        return Filter([], [])
    part = F.create_map(*[x for r in counts for x in (F.lit(r["lang"]), F.lit(min(1.0, fit_docs / r["count"])))])
    unit = F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30)) / F.lit(float(1 << 30))
    chosen = rows.filter(unit < F.element_at(part, F.col("lang"))).select("lang", "text")

    def count(batches):
        for batch in batches:
            names, which = np.unique(np.array(batch.column("lang").to_pylist(), object), return_inverse=True)
            texts = batch.column("text").to_pylist()
            got = [[[] for _ in SIZES] for _ in names]
            for piece in pieces(texts, max(SIZES)):
                for k, size in enumerate(SIZES):
                    h, owner = piece.grams(size)
                    for i in range(len(names)):
                        got[i][k].append(np.unique(h[which[owner] == i], return_counts=True))
            for i, name in enumerate(names):
                for k, size in enumerate(SIZES):
                    h, n = np.concatenate([g[0] for g in got[i][k]]), np.concatenate([g[1] for g in got[i][k]])
                    yield pa.RecordBatch.from_pydict({"lang": pa.array([name] * len(h), pa.string()), "size": pa.array(np.full(len(h), size, np.int32)),
                                                      "h": pa.array(h.view(np.int64)), "n": pa.array(n.astype(np.int64))})

    grams = chosen.mapInArrow(count, "lang string, size int, h bigint, n bigint").groupBy("lang", "size", "h").agg(F.sum("n").alias("n"))
    grams = shared(grams)
    total = {(r["lang"], r["size"]): r["n"] for r in grams.groupBy("lang", "size").agg(F.sum("n").alias("n")).collect()}
    least = F.create_map(*[x for k, v in total.items() for x in (F.lit(f"{k[1]}|{k[0]}"), F.lit(max(2, int(share * v) + 1)))])
    kept = grams.filter(F.col("n") >= F.element_at(least, F.concat_ws("|", "size", "lang"))).select("lang", "h").toPandas()
    names = sorted({k[0] for k in total}, key=lambda x: x.encode("utf-8", "surrogatepass"))
    return Filter(names, [kept.loc[kept["lang"] == x, "h"].to_numpy(np.int64).view(np.uint64) for x in names])


def identify(docs: DataFrame, model: Filter) -> DataFrame:
    """doc_id, held_out, lang_pred, score: one row for each document; only the text takes part in the prediction."""
    import pyarrow as pa

    def predict(batches):
        for batch in portions(batches):
            pred, score = model.decide(batch.column("text").to_pylist())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("held_out"), pa.array(pred, pa.string()), pa.array(score, pa.float64())],
                                             names=["doc_id", "held_out", "lang_pred", "score"])

    rows = docs.select("doc_id", held_out().alias("held_out"), "text")
    return rows.mapInArrow(predict, f"doc_id {dict(rows.dtypes)['doc_id']}, held_out boolean, lang_pred string, score double")
