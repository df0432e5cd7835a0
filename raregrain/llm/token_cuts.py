"""Alignment of two tokenizers' tokens by divide and conquer at shared cuts, with pair counts over the corpus.

Both encodings of a text cover the same bytes, so a token's end is a byte offset. An interval between two shared
ends is split at a shared end near its middle: from the middle token of A the next ends of B and of A are bisected in
turn until they agree, to the right and, without success, to the left; both halves go on alike. Intervals without a
shared end are the groups. All intervals of a depth are split at once, over all texts of a portion.

Tokens of A and B are linked where their bytes overlap: one link for each stretch between neighbouring ends of either.
The first pass writes every document's link pairs with their multiplicities; pairs are counted by document over the
whole corpus, and the second pass adds the counts up. The table of counts is broadcast within a bound, and joined by
key beyond it. A document is the unit that one task holds.

Defined cases: null and empty texts, and texts that either encoding does not give back byte for byte, have no tokens
(zeros, an empty digest); repeated rows are documents of their own; null ids stay; an empty table gives an empty
result; columns other than id and text are not read.
"""
from __future__ import annotations

import hashlib
import json
import os
import re
import sys
from types import ModuleType

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from raregrain.llm.common import portions, shared, travels

travels(__name__)

FOLDER = "/opt/tokenizers"
BYTE_BPE, PIECE_BPE = f"{FOLDER}/byte_bpe_50k.json", f"{FOLDER}/piece_bpe_32k.model"
#: Distinct pairs up to which their counts are broadcast (12 bytes each).
BROADCAST_PAIRS = 4_000_000
#: Distinct pairs that a task gathers before it hands their counts on.
FLUSH = 1 << 20
#: Tokens of words that a worker keeps.
KEEP = 1 << 21

# The split of byte-level vocabularies of this kind.
SPLIT = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Texts with other characters, or with longer runs, are left to the reference implementation of the file's format.
STRANGE = "[^\\x00-ɏͰ-ԯ‐-‧₠-₿]"
UNUSUAL = re.compile(f"{STRANGE}|\\S{{1000}}|\\s{{1000}}")
STRANGE = re.compile(STRANGE)


def _byte_letters() -> dict[str, int]:
    """The letter that stands for each byte in byte-level vocabularies: itself if printable, else the next from 256 on."""
    own = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in own]
    return {chr(b): b for b in own} | {chr(256 + i): b for i, b in enumerate(rest)}


class ByteLevel:
    """Byte-level BPE from a tokenizer file in JSON; special tokens' strings are plain text."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        self.slow = Tokenizer.from_file(path)
        self.slow.encode_special_tokens = True
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        letters, vocab = _byte_letters(), spec["model"]["vocab"]
        self.size = max(vocab.values()) + 1
        self.bytes = [b""] * self.size
        for word, i in vocab.items():
            self.bytes[i] = bytes(letters[c] for c in word)
        self.fast = self._ranked(spec, vocab)
        #: The split puts a blank before other characters into the piece that follows, whatever stands before it.
        self.by_word = self.fast is not None

    def _ranked(self, spec, vocab):
        """The same encoding by ranks, if the merges stand in the order of the ids they make; else None."""
        pre = spec["pre_tokenizer"]
        plain = pre["type"] == "ByteLevel" and pre["use_regex"] and not pre["add_prefix_space"] and spec["normalizer"] is None
        made = [vocab["".join(m if isinstance(m, list) else m.split(" "))] for m in spec["model"]["merges"]]
        singles = {i for i, b in enumerate(self.bytes) if len(b) == 1}
        if not plain or len(singles) != 256 or made != sorted(made) or max(singles) > min(made, default=self.size) or len(made) + 256 != len(vocab):
            return None
        import tiktoken

        return tiktoken.Encoding(f"byte-level-{self.size}", pat_str=SPLIT, mergeable_ranks={b: i for i, b in enumerate(self.bytes)}, special_tokens={})

    def encode(self, texts: list[str]) -> list[list[int]]:
        return [self.slow.encode(t, add_special_tokens=False).ids if self.fast is None or UNUSUAL.search(t) else self.fast.encode_ordinary(t) for t in texts]


class Pieces:
    """Pieces of a model file, with U+2581 as space and <0xHH> as bytes."""

    def __init__(self, path: str):
        import sentencepiece
        from sentencepiece import sentencepiece_model_pb2 as proto

        self.model = sentencepiece.SentencePieceProcessor(model_file=path)
        self.size = self.model.get_piece_size()
        piece = [self.model.id_to_piece(i) for i in range(self.size)]
        self.bytes = [bytes([int(p[3:5], 16)]) if self.model.is_byte(i) else p.replace("▁", " ").encode() for i, p in enumerate(piece)]
        spec = proto.ModelProto()
        with open(path, "rb") as f:
            spec.ParseFromString(f.read())
        norm = spec.normalizer_spec
        as_is = not norm.precompiled_charsmap and not norm.remove_extra_whitespaces and norm.add_dummy_prefix and norm.escape_whitespaces
        #: Nothing is normalised and no piece holds a blank behind another character, so none reaches over a word's begin.
        self.by_word = as_is and not any(re.search("[^▁]▁", p) for p in piece)

    def encode(self, texts: list[str]) -> list[list[int]]:
        return self.model.encode(texts, out_type=int, num_threads=1)


def loaded(path: str):
    """The tokenizer of a file, once for each Python process: kept in a module of its own, which no task carries along."""
    kept = sys.modules.setdefault("_raregrain_tokenizers", ModuleType("_raregrain_tokenizers")).__dict__
    if path not in kept:
        kept[path] = ByteLevel(path) if path.endswith(".json") else Pieces(path)
    return kept[path]


def _agree(a: np.ndarray, b: np.ndarray, at: np.ndarray, stop: np.ndarray, right: bool) -> np.ndarray:
    """From tokens `at` of A on, the nearest token whose end B shares: up to, not with, `stop` (-1: none)."""
    out = np.full(len(at), -1)
    left = np.arange(len(at))
    while len(left):
        x = a[at[left]]
        if right:
            y = b[np.searchsorted(b, x)]
            nxt = np.searchsorted(a, y)
        else:
            k = np.searchsorted(b, x, "right") - 1
            y = np.where(k >= 0, b[np.maximum(k, 0)], -1)
            nxt = np.searchsorted(a, y, "right") - 1
        same = x == y
        out[left[same]] = at[left[same]]
        at[left] = nxt
        inside = nxt < stop[left] if right else nxt > stop[left]
        left = left[~same & inside]
    return out


def shared_cuts(a: np.ndarray, b: np.ndarray, last: np.ndarray) -> np.ndarray:
    """Tokens of A that end at a shared cut, sorted. `a`, `b`: rising end offsets of both; `last`: tokens of A that
    are known to end at one, the last of all among them (the ends of the texts)."""
    found = [last]
    lo, hi = np.concatenate([[0], last[:-1] + 1]), last
    while len(lo):
        wide = hi > lo  # tokens lo to hi, of which hi ends at the interval's end
        lo, hi = lo[wide], hi[wide]
        middle = (lo + hi - 1) // 2
        cut = _agree(a, b, middle.copy(), hi, True)
        none = np.flatnonzero(cut < 0)
        back = none[middle[none] > lo[none]]
        cut[back] = _agree(a, b, middle[back] - 1, lo[back] - 1, False)
        has = cut >= 0
        lo, hi, cut = lo[has], hi[has], cut[has]
        found.append(cut)
        lo, hi = np.stack([lo, cut + 1], 1).ravel(), np.stack([cut, hi], 1).ravel()
    return np.sort(np.concatenate(found))


def links(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(token of A, token of B, end) of every overlap: bytes between neighbouring ends lie in one token of each."""
    ends = np.concatenate([a, b])
    ends.sort(kind="stable")
    ends = ends[np.concatenate([ends[1:] != ends[:-1], [True]])] if len(ends) else ends
    return np.searchsorted(a, ends), np.searchsorted(b, ends), ends


def _digits(size: int) -> tuple[np.ndarray, np.ndarray]:
    """Decimal digits of 0 .. size-1, first digit first, and how many there are."""
    ids = np.arange(size)
    count = np.maximum(1, np.floor(np.log10(np.maximum(ids, 1))).astype(int) + 1)
    count += (10 ** count <= ids).astype(int) - (10 ** (count - 1) > np.maximum(ids, 1)).astype(int)
    wide = int(count.max())
    return np.stack([np.where(d < count, ids // 10 ** np.maximum(count - 1 - d, 0) % 10 + 48, 0) for d in range(wide)]).astype(np.uint8), count


def group_text(ids_a: np.ndarray, ids_b: np.ndarray, end_a: np.ndarray, end_b: np.ndarray, digits) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of `a1,a2|b1;a3|b2;` over all groups and, for each group, where its text ends. `end_a`, `end_b`: last token of each group."""
    na, nb = len(ids_a), len(ids_b)
    first_a, first_b = np.concatenate([[0], end_a[:-1] + 1]), np.concatenate([[0], end_b[:-1] + 1])
    ga, gb = np.repeat(np.arange(len(end_a)), end_a - first_a + 1), np.repeat(np.arange(len(end_b)), end_b - first_b + 1)
    at_a, at_b = np.arange(na) + first_b[ga], np.arange(nb) + end_a[gb] + 1
    ids, sign = np.empty(na + nb, np.int64), np.full(na + nb, ord(","), np.uint8)
    ids[at_a], ids[at_b] = ids_a, ids_b
    sign[at_a[end_a]], sign[at_b[end_b]] = ord("|"), ord(";")
    figure, count = digits
    width = count[ids]
    stop = np.cumsum(width + 1)
    begin = stop - width - 1
    out = np.empty(int(stop[-1]) if len(stop) else 0, np.uint8)
    for d in range(len(figure)):
        some = np.flatnonzero(width > d)
        out[begin[some] + d] = figure[d][ids[some]]
    out[stop - 1] = sign
    return out, stop[at_b[end_b]]


def bodies(text: str) -> list[str]:
    """The text cut at every blank that follows a character other than white space (those blanks are left out)."""
    parts = text.split(" ")
    if not BLANKS.search(text):
        return parts
    out, held = [], ""
    for k, p in enumerate(parts):
        held = f"{held} {p}" if k and held is not None else p
        if p and not p[-1].isspace():
            out.append(held)
            held = None
    if held is not None:  # blanks at the end stay with the word before, as an empty text has no tokens
        out[-1:] = [" ".join([*out[-1:], held])] if held == "" else [*out[-1:], held]
    return out


#: Texts in which a blank follows white space or is the first or last character.
BLANKS = re.compile(r"\s |^ | \Z")


class Both:
    """Two tokenizers over the same texts: ids and ends of both, and the work behind `align`."""

    def __init__(self, a: str = BYTE_BPE, b: str = PIECE_BPE, keep: int = KEEP):
        self.first, self.second, self.keep = loaded(a), loaded(b), keep
        self.by_word = self.first.by_word and self.second.by_word
        self.digits = _digits(max(self.first.size, self.second.size))
        self.lens = [np.array([len(x) for x in t.bytes]) for t in (self.first, self.second)]
        self._forget()

    def _forget(self):
        self.at, self.good = {}, np.zeros(0, bool)
        self.pool = [(np.zeros(0, np.int32), np.zeros(1, np.int64)) for _ in range(2)]

    def _learn(self, new: list[str]):
        """Words with nothing unusual are encoded in one call, as one text that is cut at their begins again."""
        plain = [x for x in new if x and len(x) < 1000 and not x[-1].isspace()] if self.by_word else []
        if STRANGE.search(" ".join(plain)):
            plain = [x for x in plain if not STRANGE.search(x)]
        text = " ".join(plain)
        data = f" {text}".encode()
        found = [t.encode([x])[0] for t, x in ((self.first, f" {text}"), (self.second, text))] if plain else [[], []]
        if plain and all(b"".join(map(t.bytes.__getitem__, x)) == data for t, x in zip((self.first, self.second), found, strict=True)):
            ends = np.cumsum(np.fromiter((len(x.encode()) + 1 for x in plain), np.int64, len(plain)))
            for side, ids in enumerate(found):
                ids = np.array(ids, np.int32)
                self._add(side, ids, np.searchsorted(np.cumsum(self.lens[side][ids]), ends) + 1)
            self._name(plain, np.ones(len(plain), bool))
            new = [x for x in new if x not in self.at]
        if not new:
            return
        found = [self.first.encode([" " + x for x in new]), self.second.encode(new)]
        good = np.zeros(len(new), bool)
        for k, (word, x, y) in enumerate(zip(new, *found, strict=True)):
            data = f" {word}".encode()
            good[k] = b"".join(map(self.first.bytes.__getitem__, x)) == data and b"".join(map(self.second.bytes.__getitem__, y)) == data
        for side, lists in enumerate(found):
            self._add(side, np.array([i for x in lists for i in x], np.int32), np.cumsum([len(x) for x in lists]))
        self._name(new, good)

    def _add(self, side: int, ids: np.ndarray, stop: np.ndarray):
        old, first = self.pool[side]
        self.pool[side] = np.concatenate([old, ids]), np.concatenate([first, first[-1] + stop])

    def _name(self, words: list[str], good: np.ndarray):
        self.at.update(zip(words, range(len(self.good), len(self.good) + len(words)), strict=True))
        self.good = np.concatenate([self.good, good])

    def tokens(self, texts: list[str]):
        """(which texts come back byte for byte, then for A and for B: ids one text after the other, tokens of each text)."""
        cut = [bodies(t) if self.by_word else [t] for t in texts]
        flat = [x for c in cut for x in c]
        if max(len(ids) for ids, _ in self.pool) > self.keep or not self.by_word:
            self._forget()
        new = [x for x in dict.fromkeys(flat) if x not in self.at]
        if new:
            self._learn(new)
        word = np.fromiter(map(self.at.__getitem__, flat), np.int64, len(flat))
        size = np.array([len(c) for c in cut])
        text = np.repeat(np.arange(len(cut)), size)
        bad = np.zeros(len(cut), bool)
        bad[text[~self.good[word]]] = True
        word, text = word[~bad[text]], text[~bad[text]]
        out = []
        for ids, first in self.pool:
            n = first[word + 1] - first[word]
            stop = np.cumsum(n)
            at = np.arange(stop[-1] if len(stop) else 0) + np.repeat(first[word] - (stop - n), n)
            out.append((ids[at].astype(np.int64), np.bincount(text, n, len(cut)).astype(np.int64)[~bad]))
        return np.flatnonzero(~bad), *out


def align(texts: list, both: Both) -> dict:
    """Tokens, groups and links of texts; those that an encoding does not give back have no tokens.

    Returns `n_a`, `n_b`, `n_groups`, `n_links` by text, `digest` as a list, and `doc`, `code`, `times`: the distinct
    pairs of each text (code = A's id x B's size + B's id).
    """
    n = len(texts)
    some = np.array([k for k in range(n) if texts[k]], np.int64)
    out = {k: np.zeros(n, np.int64) for k in ("n_a", "n_b", "n_groups", "n_links")} | {k: np.zeros(0, np.int64) for k in ("doc", "code", "times")}
    out["digest"] = [""] * n
    good, (ids_a, size_a), (ids_b, size_b) = both.tokens([texts[k] for k in some])
    good = some[good]
    if not len(good):
        return out
    a, b = np.cumsum(both.lens[0][ids_a]), np.cumsum(both.lens[1][ids_b])
    last = np.cumsum(size_a) - 1
    cut = shared_cuts(a, b, last)
    line, stop = group_text(ids_a, ids_b, cut, np.searchsorted(b, a[cut]), both.digits)
    text_end = stop[np.searchsorted(cut, last)]
    for k, x, y in zip(good.tolist(), np.concatenate([[0], text_end[:-1]]).tolist(), text_end.tolist(), strict=True):
        out["digest"][k] = hashlib.sha256(line[x:y - 1]).hexdigest()
    i, j, end = links(a, b)
    doc = np.searchsorted(a[last], end)
    out["n_a"][good], out["n_b"][good] = size_a, size_b
    out["n_groups"][good] = np.bincount(np.searchsorted(last, cut), minlength=len(good))
    out["n_links"][good] = np.bincount(doc, minlength=len(good))
    pairs = both.first.size * both.second.size
    key = doc * pairs + ids_a[i] * both.second.size + ids_b[j]
    key.sort()
    at = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
    out["doc"], out["code"], out["times"] = good[key[at] // pairs], key[at] % pairs, np.diff(np.concatenate([at, [len(key)]]))
    return out


ROW = "doc_id {kind}, row bigint, n_a bigint, n_b bigint, n_groups bigint, n_links bigint, groups_sha256 string, once binary, more binary, times binary, codes array<bigint>, ns array<bigint>"


def _wide(first, second):
    """Type that holds every pair's code."""
    return np.int64 if first.size * second.size > 1 << 32 else np.uint32


def _merged(held: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    code, n = np.concatenate([x for x, _ in held]), np.concatenate([x for _, x in held])
    order = np.argsort(code, kind="stable")
    code, n = code[order], n[order]
    at = np.flatnonzero(np.concatenate([[True], code[1:] != code[:-1]])) if len(code) else np.zeros(0, int)
    return code[at], np.add.reduceat(n, at) if len(at) else n


def encoded(docs: DataFrame, a: str = BYTE_BPE, b: str = PIECE_BPE, flush: int = FLUSH) -> DataFrame:
    """A row for each document with its pairs (once: codes met once; more, times: the others), and rows without one
    (row null) that hold how many of a task's documents have a pair."""
    import pyarrow as pa

    kind = dict(docs.dtypes)["doc_id"]
    own = docs.select("doc_id", "text")

    def encode(batches):
        from pyspark import TaskContext

        both = Both(a, b)
        wide = _wide(both.first, both.second)
        names = [x.split(" ")[0] for x in ROW.split(", ")]
        seen, held, n_held = TaskContext.get().partitionId() << 40, [], 0
        id_type = None

        def counts(held):
            code, n = _merged(held)
            blank = {"doc_id": pa.nulls(1, id_type), "row": pa.nulls(1, pa.int64()), "groups_sha256": pa.nulls(1, pa.string())}
            blank |= {k: pa.nulls(1, pa.int64()) for k in ("n_a", "n_b", "n_groups", "n_links")} | {k: pa.nulls(1, pa.binary()) for k in ("once", "more", "times")}
            return pa.RecordBatch.from_arrays([*(blank[k] for k in names[:-2]), pa.array([code], pa.list_(pa.int64())), pa.array([n], pa.list_(pa.int64()))], names=names)

        for batch in portions(batches):
            id_type = batch.schema.field("doc_id").type
            r = align(batch.column("text").to_pylist(), both)
            n = batch.num_rows
            at = np.searchsorted(r["doc"], np.arange(n + 1))
            single = r["times"] == 1
            once, more, times = [], [], []
            for x, y in zip(at[:-1], at[1:], strict=True):
                one, code = single[x:y], r["code"][x:y].astype(wide)
                once.append(code[one].tobytes())
                more.append(code[~one].tobytes())
                times.append(r["times"][x:y][~one].astype(np.uint32).tobytes())
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(np.arange(seen, seen + n)), *(pa.array(r[k]) for k in ("n_a", "n_b", "n_groups", "n_links")), pa.array(r["digest"], pa.string()),
                 pa.array(once, pa.binary()), pa.array(more, pa.binary()), pa.array(times, pa.binary()), pa.nulls(n, pa.list_(pa.int64())), pa.nulls(n, pa.list_(pa.int64()))], names=names)
            seen += n
            held.append(np.unique(r["code"], return_counts=True))
            n_held += len(held[-1][0])
            if n_held > flush:
                held = [_merged(held)]
                n_held = len(held[0][0])
                if n_held > flush // 2:
                    yield counts(held)
                    held, n_held = [], 0
        if n_held:
            yield counts(held)

    return own.mapInArrow(encode, ROW.format(kind=kind))


def _pairs(once: bytes, more: bytes, times: bytes, wide) -> tuple[np.ndarray, np.ndarray]:
    x = np.frombuffer(once, wide)
    return np.concatenate([x, np.frombuffer(more, wide)]), np.concatenate([np.ones(len(x), np.int64), np.frombuffer(times, np.uint32)])


def _summed_by_broadcast(rows: DataFrame, counted: DataFrame, size_b: int, wide, kind: str) -> DataFrame:
    import pyarrow as pa

    t = counted.toArrow().sort_by("code")
    code, n = t.column("code").to_numpy(), t.column("n").to_numpy()
    side = rows.sparkSession.sparkContext.broadcast((code.astype(wide), n, _best(code // size_b, n)))

    def add(batches):
        code, n, best = side.value
        for batch in batches:
            got = [np.zeros(batch.num_rows, np.int64) for _ in range(2)]
            for k, blobs in enumerate(zip(*(batch.column(c).to_pylist() for c in ("once", "more", "times")), strict=True)):
                c, times = _pairs(*blobs, wide)
                if len(c):
                    at = np.searchsorted(code, c)
                    got[0][k], got[1][k] = times[best[at]].sum(), (times * n[at]).sum()
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in KEPT), *(pa.array(x) for x in got)], names=[*KEPT, "n_best", "count_sum"])

    return rows.mapInArrow(add, f"doc_id {kind}, n_a bigint, n_b bigint, n_groups bigint, n_links bigint, groups_sha256 string, n_best bigint, count_sum bigint")


KEPT = ["doc_id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256"]


def _best(group: np.ndarray, n: np.ndarray) -> np.ndarray:
    """Whether a row's n is the highest of its group; rows are sorted by group."""
    if not len(n):
        return np.zeros(0, bool)
    first = np.flatnonzero(np.concatenate([[True], group[1:] != group[:-1]]))
    return n == np.repeat(np.maximum.reduceat(n, first), np.diff(np.concatenate([first, [len(n)]])))


def _summed_by_join(rows: DataFrame, counted: DataFrame, size_b: int, wide) -> DataFrame:
    import pyarrow as pa

    def spread(batches):
        for batch in batches:
            for row, *blobs in zip(*(batch.column(c).to_pylist() for c in ("row", "once", "more", "times")), strict=True):
                c, times = _pairs(*blobs, wide)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(c), row)), pa.array(c.astype(np.int64)), pa.array(times)], names=["row", "code", "times"])

    highest = counted.groupBy(F.expr(f"code div {size_b}").alias("a")).agg(F.max("n").alias("top"))
    marked = counted.withColumn("a", F.expr(f"code div {size_b}")).join(highest, "a").select("code", "n", (F.col("n") == F.col("top")).alias("best"))
    sums = rows.select("row", "once", "more", "times").mapInArrow(spread, "row bigint, code bigint, times bigint").join(marked, "code").groupBy("row").agg(
        F.sum(F.when(F.col("best"), F.col("times")).otherwise(0)).alias("n_best"), F.sum(F.col("times") * F.col("n")).alias("count_sum"))
    return rows.select(*KEPT, "row").join(sums, "row", "left").select(*KEPT, F.coalesce("n_best", F.lit(0)).cast("long").alias("n_best"), F.coalesce("count_sum", F.lit(0)).cast("long").alias("count_sum"))


def pair_counts(table: DataFrame) -> DataFrame:
    """code, n: how many documents hold a pair of ids linked."""
    parts = table.filter("row is null").select(F.explode(F.arrays_zip("codes", "ns")).alias("p"))
    return parts.groupBy(F.col("p.codes").alias("code")).agg(F.sum("p.ns").alias("n"))


def alignments(docs: DataFrame, a: str = BYTE_BPE, b: str = PIECE_BPE, bound: int = BROADCAST_PAIRS, flush: int = FLUSH) -> DataFrame:
    """doc_id, n_a, n_b, n_groups, n_links, groups_sha256, n_best, count_sum: one row for each document."""
    kind = dict(docs.dtypes)["doc_id"]
    first, second = loaded(a), loaded(b)
    wide = _wide(first, second)
    table = shared(encoded(docs, a, b, flush))
    counted = shared(pair_counts(table))
    rows = table.filter("row is not null")
    if counted.count() <= bound:
        return _summed_by_broadcast(rows.select(*KEPT, "once", "more", "times"), counted, second.size, wide, kind)
    return _summed_by_join(rows, counted, second.size, wide)
