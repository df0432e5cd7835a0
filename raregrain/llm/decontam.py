"""Benchmark decontamination as a prefix-filtered containment join, in DataFrame operations only.

Every benchmark item gives windows of `window` consecutive words (one window if it is shorter).
A window must be contained whole and in order, so of its shingles, ordered by rarity in the corpus,
one prefix shingle is necessary: the rarest. Places in documents where that shingle stands are the
candidates; the shingle's offset in the window fixes where the window would begin, the bounds
`begin >= 0` and `begin + length <= words` drop places without room, and what is left is compared
word by word with the text.

Every text is cut into words once: a table keeps its number of words and the places of all items' shingles,
by which rarity is counted and candidates are found. Only documents with a candidate are cut again, to compare.

Defined cases: null or empty texts have no words; an item without words has no window; repeated
documents each get their result; equal items each count; null ids of documents are kept as they are,
a null item id hits words but is not listed.
"""
from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from raregrain.llm.common import BROADCAST_ROWS, shared, sized

#: ASCII characters that are no letter and no digit part words.
GAPS = "".join(chr(c) for c in range(128) if not chr(c).isalnum())
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
WINDOW, SHINGLE = 10, 2


def words(text: str | Column) -> Column:
    """Words of the text with A-Z lower-cased; other letters keep their case."""
    c = F.col(text) if isinstance(text, str) else text
    blanked = F.translate(F.coalesce(c, F.lit("")), GAPS + UPPER, " " * len(GAPS) + LOWER)
    return F.array_remove(F.split(blanked, " "), "")


def windows_of(items: DataFrame, window: int = WINDOW) -> DataFrame:
    """One row for each distinct window: `win` (array of words) and `items` (ids that hold it)."""
    w = items.select("item_id", words("text").alias("w")).filter(F.size("w") > 0)
    cut = w.select("item_id", F.explode(F.expr(
        f"transform(sequence(0, greatest(size(w) - {window}, 0)), i -> slice(w, i + 1, {window}))")).alias("win"))
    return cut.groupBy("win").agg(F.collect_set("item_id").alias("items"))


def _places(docs: DataFrame, size: int) -> DataFrame:
    """Each position of each text with the shingle that begins there (null: too near to the end, or no word).

    Outer, so that no filter on the array's size, which would cut the text into words again, is put below it.
    """
    at = docs.select("doc_id", "_t", "n", "w", F.posexplode_outer("w").alias("pos", "_first"))
    rest = [F.get("w", F.col("pos") + k) for k in range(1, size)]
    token = F.when(F.col("pos") <= F.col("n") - size, F.xxhash64("_first", *rest))
    return at.select("doc_id", "_t", "n", "pos", token.alias("token"))


def _located(docs: DataFrame, windows: DataFrame, shingle: int, bound: int) -> tuple[DataFrame, DataFrame]:
    """(doc_id, _t, begin, len, items of every place where a window occurs; doc_id, _t, n of every document).

    `docs`: doc_id, text. Sides of at most `bound` rows, counted, are broadcast; beyond it places meet them by shuffles.
    """
    windows = shared(windows.select(F.xxhash64("win").alias("id"), "win", "items", F.size("win").alias("len")))
    least = windows.agg(F.min("len")).first()[0] or shingle
    body = docs.select("doc_id", F.xxhash64("text").alias("_t"), words("text").alias("w")).withColumn("n", F.size("w"))
    lengths, candidates = None, []
    for size in sorted({min(shingle, least), shingle}, reverse=True):
        mine = windows.filter(F.col("len") >= shingle if size == shingle else F.col("len") < shingle)
        part = F.posexplode(F.expr(f"transform(sequence(0, size(win) - {size}), i -> xxhash64({', '.join(f'get(win, i + {k})' for k in range(size))}))"))
        shingles = mine.select("id", "len", part.alias("offset", "token"))
        vocabulary = shared(shingles.select("token").distinct().withColumn("known", F.lit(True)))
        rows, few = _places(body, size), vocabulary.count() <= bound
        if lengths is None and few:  # the first place of a text stays in any case, for its number of words
            table = shared(rows.join(F.broadcast(vocabulary), "token", "left").filter("known or pos is null or pos = 0").select("doc_id", "_t", "n", "pos", F.when(F.col("known"), F.col("token")).alias("token")))
            lengths, places = table.filter("pos is null or pos = 0").select("doc_id", "_t", "n"), table.filter("token is not null")
        else:
            lengths = body.select("doc_id", "_t", "n") if lengths is None else lengths
            places = shared(rows.filter("token is not null").join(F.broadcast(vocabulary) if few else vocabulary, "token", "left_semi"))
        counts = places.groupBy("token").count()
        # a shingle that no document holds cannot begin a match: its window is left out
        rare = shingles.join(counts, "token", "left").groupBy("id", "len").agg(F.min(F.struct(F.coalesce("count", F.lit(0)).alias("n"), "token", "offset")).alias("r"))
        prefix = shared(rare.filter(F.col("r.n") > 0).select(F.col("r.token").alias("token"), F.col("r.offset").alias("offset"), "id", "len"))
        begin = F.col("pos") - F.col("offset")
        room = (F.col("pos") >= F.col("offset")) & (begin + F.col("len") <= F.col("n"))
        candidates.append(places.join(sized(prefix, most=bound), "token").filter(room).select("doc_id", "_t", begin.alias("begin"), "len", "id"))
    found = candidates[0]
    for more in candidates[1:]:
        found = found.unionByName(more)
    found = shared(found.distinct())
    asked = shared(found.select(F.col("doc_id").alias("_d"), F.col("_t").alias("_u")).distinct())
    same_text = F.col("doc_id").eqNullSafe(F.col("_d")) & (F.xxhash64("text") == F.col("_u"))
    texts = docs.select("doc_id", "text").join(sized(asked, most=10 * bound), same_text, "left_semi").select(
        F.col("doc_id").alias("_d"), F.xxhash64("text").alias("_u"), words("text").alias("w")).dropDuplicates(["_d", "_u"])
    at = found.join(texts, F.col("doc_id").eqNullSafe(F.col("_d")) & (F.col("_t") == F.col("_u"))).join(sized(windows.drop("len"), most=bound), "id")
    hit = at.filter(F.slice("w", F.col("begin") + 1, F.col("len")) == F.col("win"))
    return hit.select("doc_id", "_t", "begin", "len", "items"), lengths


def occurrences(docs: DataFrame, windows: DataFrame, window: int = WINDOW, shingle: int = SHINGLE, bound: int = BROADCAST_ROWS) -> DataFrame:
    """doc_id, _t (hash of the text), begin, len, items: every place where a window occurs in a document."""
    return _located(docs, windows, shingle, bound)[0]


def decontaminate(docs: DataFrame, items: DataFrame, window: int = WINDOW, shingle: int = SHINGLE, bound: int = BROADCAST_ROWS) -> DataFrame:
    """One row for each document: doc_id, _t, n_words, hits (sorted begin/len), items (sorted as strings), n_hit.

    Only places of verified windows are gathered by document; the hit words are counted from their union.
    """
    own = docs.select("doc_id", "text")
    places, lengths = _located(own, windows_of(items, window), shingle, bound)
    hits = places.groupBy("doc_id", "_t").agg(
        F.array_sort(F.collect_set(F.struct("begin", "len"))).alias("hits"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_set("items")))).alias("ids"))
    n_hit = F.expr("aggregate(hits, struct(0L as n, 0 as upto), (a, h) -> struct("
                   "a.n + greatest(h.begin + h.len - greatest(h.begin, a.upto), 0) as n, greatest(a.upto, h.begin + h.len) as upto), a -> a.n)")
    hits = hits.select(F.col("doc_id").alias("_d"), F.col("_t").alias("_u"), "hits",
                       F.array_sort(F.transform("ids", lambda x: x.cast("string"))).alias("item_ids"), n_hit.alias("n_hit"))
    lengths = lengths.select("doc_id", "_t", F.col("n").cast("long").alias("n_words"))
    return lengths.join(hits, F.col("doc_id").eqNullSafe(F.col("_d")) & (F.col("_t") == F.col("_u")), "left").select(
        "doc_id", "_t", "n_words", F.coalesce("n_hit", F.lit(0)).cast("long").alias("n_hit"),
        F.coalesce("item_ids", F.expr("array()").cast("array<string>")).alias("item_ids"),
        F.coalesce("hits", F.expr("array()").cast("array<struct<begin:int,len:int>>")).alias("hits"))


def without_benchmark(docs: DataFrame, items: DataFrame, window: int = WINDOW, shingle: int = SHINGLE, bound: int = BROADCAST_ROWS) -> DataFrame:
    """The rows of `docs` in which no window of an item occurs."""
    hit = shared(occurrences(docs.select("doc_id", "text"), windows_of(items, window), window, shingle, bound).select("doc_id", "_t").distinct())
    hit = sized(hit.select(F.col("doc_id").alias("_d"), F.col("_t").alias("_u")), most=500_000)
    return docs.join(hit, docs["doc_id"].eqNullSafe(hit["_d"]) & (F.xxhash64(docs["text"]) == hit["_u"]), "left_anti")
