"""Toxicity: a linear classifier over character n-grams scaled by naive Bayes log-count ratios.

The `INPUTS` hashed n-grams with the clearest naive Bayes log-count ratios between toxic and clean texts
are the features: presence times ratio, divided by the root of the number of features present. A
logistic regression (Spark ML) weighs them. Ratios and weights come from a bounded sample of
labelled rows; every text is scored whole.

Defined cases: a null or empty text has no n-grams and gets the intercept's score; ids with several labels
are toxic if one says so; null labels are not learnt from; with fewer than two classes among the labels the
score is their share (0 without labels); repeated rows get equal scores.
"""
from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from raregrain.llm.common import held_out, learnable, portions, shared, sized, travels
from raregrain.llm.grams import pieces

travels(__name__)

SIZES = (3, 4, 5)
BITS = 18
#: Code points that are worked on at a time.
PIECE = 1 << 18
#: At most about so many labelled documents of each class are learnt from (chosen by a hash of the id).
FIT_DOCS = 4000
PENALTY, SMOOTH, INPUTS = 5e-4, 10.0, 4096


def _once(b: np.ndarray, last: np.ndarray) -> np.ndarray:
    """Each number once; `last` is scratch space with a place for every number."""
    i = np.arange(len(b))
    last[b] = i
    return b[last[b] == i]


def present(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """Numbers of the n-grams present in each text, one text after the other, and each text's first index (plus the end).

    Repeats go after every piece, so a long text needs no more than one piece and a number for each bucket.
    """
    step = np.uint64(64 - BITS)
    last = np.zeros(1 << BITS, np.int32)
    parts: list[list[np.ndarray]] = [[] for _ in texts]
    for piece in pieces(texts, max(SIZES), PIECE):
        grams = [piece.grams(size) for size in SIZES]
        b, owner = np.concatenate([(h >> step).astype(np.int32) for h, _ in grams]), np.concatenate([o for _, o in grams])
        order = np.argsort(owner, kind="stable")
        b, owner = b[order], owner[order]
        own, at = np.unique(owner, return_index=True)
        for d, x in zip(own.tolist(), np.split(b, at[1:]) if len(own) else [], strict=True):
            x = np.concatenate([*parts[d], x]) if parts[d] else x
            parts[d] = [_once(x, last)]
    counts = [len(own[0]) if own else 0 for own in parts]
    return np.concatenate([own[0] for own in parts if own] or [np.zeros(0, np.int32)]), np.concatenate([[0], np.cumsum(counts, dtype=np.int64)])


def _slices(texts: list[str | None]):
    """Bounds of successive texts that have about `PIECE` code points together."""
    at, size = 0, 0
    for i, t in enumerate(texts):
        size += len(t or "")
        if size >= PIECE:
            yield at, i + 1
            at, size = i + 1, 0
    if at < len(texts):
        yield at, len(texts)


class Model:
    """Weights of the n-grams (ratios included; NaN: not an input) and the intercept."""

    def __init__(self, weights: np.ndarray, intercept: float):
        self.weights, self.intercept = weights.astype(np.float32), intercept

    def scores(self, texts: list[str | None]) -> np.ndarray:
        return np.concatenate([self._scores(texts[a:b]) for a, b in _slices(texts)] or [np.zeros(0)])

    def _scores(self, texts: list[str | None]) -> np.ndarray:
        flat, first = present(texts)
        w = self.weights[flat].astype(np.float64)
        used = ~np.isnan(w)
        owner = np.repeat(np.arange(len(texts)), np.diff(first))[used]
        sums = np.bincount(owner, w[used], len(texts)) / np.sqrt(np.maximum(np.bincount(owner, minlength=len(texts)), 1))
        return 1 / (1 + np.exp(-np.clip(sums + self.intercept, -500, 500)))


def fit(docs: DataFrame, labels: DataFrame, fit_docs: int = FIT_DOCS) -> Model:
    """`labels`: doc_id, toxic. Learns only from rows outside the held-out fifth."""
    import pyarrow as pa
    from pyspark.ml.classification import LogisticRegression
    from pyspark.ml.linalg import SparseVector, VectorUDT

    marks = labels.select("doc_id", "toxic").filter(F.col("toxic").isin(0, 1) & learnable()).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    counts = {r["toxic"]: r["count"] for r in marks.groupBy("toxic").count().collect()}
    if len(counts) < 2:
        share = min(max(float(next(iter(counts), 0)), 1e-9), 1 - 1e-9)
        return Model(np.full(1 << BITS, np.nan), float(np.log(share / (1 - share))))
    part = F.when(F.col("toxic") == 1, min(1.0, fit_docs / counts[1])).otherwise(min(1.0, 2 * fit_docs / counts[0]))
    unit = F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30)) / F.lit(float(1 << 30))
    asked = shared(marks.filter(unit < part).withColumn("weight", 1 / part))

    def features(batches):
        for batch in portions(batches):
            texts = batch.column("text").to_pylist()
            for a, b in _slices(texts):
                flat, first = present(texts[a:b])
                lists = pa.ListArray.from_arrays(pa.array(first.astype(np.int32)), pa.array(flat))
                yield pa.RecordBatch.from_arrays([batch.column("toxic")[a:b], batch.column("weight")[a:b], lists], names=["toxic", "weight", "grams"])

    rows = docs.select("doc_id", "text").join(sized(asked), "doc_id").select(F.col("toxic").cast("int").alias("toxic"), "weight", "text")
    sample = shared(rows.mapInArrow(features, "toxic int, weight double, grams array<int>"))

    def tally(batches):
        sums = np.zeros((2, 1 << BITS))
        for batch in batches:
            t, w = batch.column("toxic").to_numpy(), batch.column("weight").to_numpy()
            g = batch.column("grams")
            n = np.diff(g.offsets.to_numpy())
            flat = g.flatten().to_numpy()
            for k in (0, 1):
                sums[k] += np.bincount(flat[np.repeat(t == k, n)], np.repeat(w, n)[np.repeat(t == k, n)], 1 << BITS)
        seen = np.flatnonzero(sums.sum(0))
        yield pa.RecordBatch.from_pydict({"gram": pa.array(seen.astype(np.int32)), "clean": pa.array(sums[0, seen]), "toxic": pa.array(sums[1, seen])})

    table = sample.mapInArrow(tally, "gram int, clean double, toxic double").groupBy("gram").agg(F.sum("clean").alias("clean"), F.sum("toxic").alias("toxic")).toPandas()
    # smoothing in proportion to the classes: an unseen n-gram has ratio 0, a rare one little more
    share = counts[1] / (counts[0] + counts[1])
    sums = np.repeat([[SMOOTH * (1 - share)], [SMOOTH * share]], 1 << BITS, 1)
    sums[0, table["gram"]] += table["clean"].to_numpy()
    sums[1, table["gram"]] += table["toxic"].to_numpy()
    ratio = np.log(sums[1] / counts[1]) - np.log(sums[0] / counts[0])

    # the n-grams whose ratio stands out most from its sampling error are the inputs
    clear = np.abs(ratio) / np.sqrt(1 / sums[0] + 1 / sums[1])
    best = np.sort(np.argsort(-clear, kind="stable")[:INPUTS])
    place = np.full(1 << BITS, -1)
    place[best] = np.arange(len(best))
    weight_of = ratio[best]

    def scaled(grams):
        at = place[np.asarray(grams, np.int64)]
        at = np.sort(at[at >= 0])
        return SparseVector(INPUTS, at, weight_of[at] / np.sqrt(max(len(at), 1)))

    vectors = shared(sample.select("toxic", "weight", F.udf(scaled, VectorUDT())("grams").alias("features")))
    found = LogisticRegression(labelCol="toxic", weightCol="weight", regParam=PENALTY, standardization=False, maxIter=50).fit(vectors)
    weights = np.full(1 << BITS, np.nan)
    weights[best] = found.coefficients.toArray() * weight_of
    return Model(weights, float(found.intercept))


def score(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, held_out, score, predicted: one row for each document, from its whole text alone."""
    import pyarrow as pa

    def run(batches):
        for batch in portions(batches):
            s = model.scores(batch.column("text").to_pylist())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("held_out"), pa.array(s), pa.array((s >= 0.5).astype(np.int32))],
                                             names=["doc_id", "held_out", "score", "predicted"])

    rows = docs.select("doc_id", held_out().alias("held_out"), "text")
    return rows.mapInArrow(run, f"doc_id {dict(rows.dtypes)['doc_id']}, held_out boolean, score double, predicted int")


def without_toxic(docs: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """The rows of `docs`, all columns as they are, that the model does not predict to be toxic."""
    import pyarrow as pa

    def run(batches):
        for batch in portions(batches, text):
            yield batch.filter(pa.array(model.scores(batch.column(text).to_pylist()) < 0.5))

    return docs.mapInArrow(run, docs.schema)
