"""Collocations: frequent phrases by Rabin-Karp fingerprints, scored at their weakest cut.

1. Prefix polynomials modulo 2^64 hash every word of a portion of text at once, and prefix polynomials over the words'
   hashes every n-gram. Leading bits of the fingerprints are counted in buckets, packed by range: a frequent phrase
   has a full bucket. The map of full buckets has a fixed size, whatever the data; where data outgrow it, more
   n-grams pass and are counted than need be.
2. N-grams in full buckets are counted by fingerprint: tasks merge equal ones and hand on sorted blocks of
   (fingerprint, count, pointer to one occurrence), a block for each range of fingerprints, whose blocks the shuffle
   brings together to be added up. What is found often enough is frequent.
3. Only frequent phrases become text, cut out of the documents that their pointers name. Then every occurrence of
   their fingerprints in the corpus is compared with that text byte by byte, in as many passes as the phrases fill
   broadcasts of bounded size. A collision starts the counting again with another base.
4. Scores, nested phrases and ranks are joins and aggregates over the frequent phrases.

Defined cases: null and empty texts have no words; a null language is `und`; repeated rows count each; null ids are
like others, as they are not read; an empty table gives an empty result; columns other than text and lang are not
read. A document is the unit one task holds, its words 40 bytes each.
"""
from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from raregrain.llm.common import byte_view, mix, portions, shared, sized, travels

travels(__name__)

LONGEST, LEAST, TOP, PERCENT = 5, 100, 2000, 100
#: Bits of a fingerprint that name its bucket, those of them within a range, and how many blobs of a range meet in one group.
MAP_BITS, RANGE_BITS, FAN = 27, 20, 64
#: Bytes of phrases that are broadcast at once to be compared.
SLICE = 1 << 26
#: Entries that a task gathers before it hands them on, and bytes of text it reads at a time.
FLUSH, PORTION = 1 << 20, 1 << 21
CHUNK = 1 << 20
ATTEMPTS = 8

WORD, BLANK, BREAK = 0, 1, 2


def _kinds() -> np.ndarray:
    kind = np.zeros(256, np.uint8)
    kind[[0x20, 0x09]] = BLANK
    kind[[ord(c) for c in ".,;:!?\n\v\f\r"]] = BREAK
    return kind


def _base(seed: int) -> np.uint64:
    return mix(np.array([2 * seed + 0x9E3779B97F4A7C15], np.uint64))[0] | np.uint64(1)


def powers(base: np.uint64, n: int) -> tuple[np.ndarray, np.ndarray]:
    """base^0 .. base^n and their inverses modulo 2^64."""
    inverse = np.uint64(pow(int(base), -1, 1 << 64))
    return tuple(np.cumprod(np.concatenate([[np.uint64(1)], np.full(n, b, np.uint64)])) for b in (base, inverse))


class Hasher:
    """Word and n-gram fingerprints of portions of text, under the base of a seed. `bits`: fewer than 64 make collisions."""

    def __init__(self, seed: int, bits: int = 64):
        self.drop = np.uint64(64 - bits)
        self.kind, self.base = _kinds(), _base(seed)
        self.code = np.arange(1, 257, dtype=np.uint64)
        self.code[65:91] += np.uint64(32)  # A-Z as a-z
        self.lower = np.arange(256, dtype=np.uint8)
        self.lower[65:91] += np.uint8(32)
        self.up, self.down = powers(self.base, CHUNK)

    def _reach(self, n: int):
        if n >= len(self.up):
            self.up, self.down = powers(self.base, 1 << int(n).bit_length())

    def words(self, raw: np.ndarray, offsets: np.ndarray):
        """(hash, begin, end, run) of every word; words of one run follow each other in one piece of one text.

        Bytes are worked through in chunks that end outside words.
        """
        begin, stop = int(offsets[0]), int(offsets[-1])
        edge = np.unique(offsets)
        out, at, breaks = [], begin, 0
        while at < stop:
            end = self._chunk_end(raw, edge, at, stop)
            kind = self.kind[raw[at:end]]
            inside = kind == WORD
            border = edge[(edge > at) & (edge < end)] - at
            first, last = inside.copy(), inside.copy()
            first[1:] &= ~inside[:-1]
            first[border] = inside[border]
            last[:-1] &= ~inside[1:]
            last[border - 1] = inside[border - 1]
            s, e = np.flatnonzero(first), np.flatnonzero(last) + 1
            self._reach(end - at)
            sums = np.concatenate([[np.uint64(0)], np.cumsum(self.code[raw[at:end]] * self.up[:end - at])])
            h = (sums[e] - sums[s]) * self.down[s] + (e - s).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93)
            before = np.cumsum(kind == BREAK)
            out.append((mix(h), s + at, e + at, before[s] + breaks if len(s) else np.zeros(0, np.int64)))
            breaks += int(before[-1])
            at = end
        if not out:
            return np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64)
        h, s, e, piece = (np.concatenate(x) for x in zip(*out, strict=True))
        text = np.searchsorted(offsets, s, "right")
        new = np.concatenate([[True], (piece[1:] != piece[:-1]) | (text[1:] != text[:-1])]) if len(s) else np.zeros(0, bool)
        return h, s, e, np.cumsum(new)

    def _chunk_end(self, raw, edge, at: int, stop: int) -> int:
        end = min(stop, at + CHUNK)
        while end < stop:
            k = int(np.searchsorted(edge, end, "right")) - 1
            gap = np.flatnonzero(self.kind[raw[at:end]] != WORD)
            best = max(int(edge[k]), at + int(gap[-1]) + 1 if len(gap) else at)
            if best > at:
                return best
            end = min(stop, end + CHUNK)
        return end

    def grams(self, h: np.ndarray, run: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
        """(fingerprint, whether it lies in one run) of the n-grams that begin at each word with size - 1 words after it."""
        n = len(h) - size + 1
        if n <= 0:
            return np.zeros(0, np.uint64), np.zeros(0, bool)
        self._reach(len(h))
        sums = np.concatenate([[np.uint64(0)], np.cumsum(h * self.up[:len(h)])])
        f = (sums[size:] - sums[:-size]) * self.down[:n]
        f += np.uint64(size * 0xA24BAED4963EE407 & 0xFFFFFFFFFFFFFFFF)
        return mix(f) >> self.drop << self.drop, run[size - 1:] == run[:n]


def _salt(langs: list, seed: int) -> np.ndarray:
    """A number for each language, mixed into the fingerprints: everything is counted by language."""
    import hashlib

    known = {x: np.uint64(int.from_bytes(hashlib.blake2b(f"{seed} {x}".encode(), digest_size=8).digest(), "little")) for x in set(langs)}
    return np.array([known[x] for x in langs], np.uint64)


def _full(held: dict[int, bytes]) -> np.ndarray:
    """The map of full buckets, a bit each, from its ranges: lists of buckets or bits."""
    bits = np.zeros((1 << MAP_BITS - RANGE_BITS, 1 << RANGE_BITS - 3), np.uint8)
    for k, blob in held.items():
        if len(blob) == bits.shape[1]:
            bits[k] = np.frombuffer(blob, np.uint8)
        else:
            some = np.zeros(1 << RANGE_BITS, bool)
            some[np.frombuffer(blob, np.uint32)] = True
            bits[k] = np.packbits(some, bitorder="little")
    return bits.ravel()


def _passes(full: np.ndarray, f: np.ndarray) -> np.ndarray:
    b = f >> np.uint64(64 - MAP_BITS)
    return (full[b >> np.uint64(3)] >> (b & np.uint64(7)).astype(np.uint8) & np.uint8(1)).astype(bool)


def _portions(batches):
    """(batch, bytes, offsets, language of each text) in portions."""
    for batch in portions(batches, limit=PORTION):
        if batch.num_rows:
            yield batch, *byte_view(batch.column("text")), batch.column("lang").to_pylist()


def _own(docs: DataFrame) -> DataFrame:
    text, lang = F.coalesce("text", F.lit("")), F.coalesce("lang", F.lit("und"))
    return docs.select(F.shiftrightunsigned(F.xxhash64(text, lang), 32).alias("doc"), lang.alias("lang"), text.alias("text"))


def _pack(b: np.ndarray) -> bytes:
    """Rising buckets of one range in two bytes each: how many there are under each of the leading bits, then the others."""
    lead = (b & np.uint32((1 << RANGE_BITS) - 1)) >> np.uint32(16)
    return np.bincount(lead, minlength=1 << RANGE_BITS - 16).astype(np.uint32).tobytes() + (b & np.uint32(0xFFFF)).astype(np.uint16).tobytes()


def _unpack(blob: bytes) -> np.ndarray:
    n = 1 << RANGE_BITS - 16
    return np.repeat(np.arange(n) << 16, np.frombuffer(blob, np.uint32, n)) + np.frombuffer(blob, np.uint16, offset=4 * n)


def bucket_counts(docs: DataFrame, longest: int, least: int, seed: int, flush: int = 4 * FLUSH, bits: int = 64) -> DataFrame:
    """size, range, task, low, n: buckets of n-grams that a task found and how often, up to `least`, a blob for each range."""
    import pyarrow as pa

    narrow = np.uint8 if least <= 255 else np.uint32

    def count(batches):
        from pyspark import TaskContext

        hasher, task = Hasher(seed, bits), TaskContext.get().partitionId()
        held = {size: [] for size in range(1, longest + 1)}

        def blobs(size):
            b = np.concatenate(held[size])
            held[size] = []
            b.sort()
            at = np.flatnonzero(np.concatenate([[True], b[1:] != b[:-1]]))
            n = np.minimum(np.diff(np.concatenate([at, [len(b)]])), least).astype(narrow)
            b = b[at]
            ranges = np.arange(1 << MAP_BITS - RANGE_BITS)
            cut = np.searchsorted(b >> np.uint32(RANGE_BITS), np.append(ranges, len(ranges)))
            some = np.flatnonzero(cut[1:] > cut[:-1])
            return pa.RecordBatch.from_arrays(
                [pa.array(np.full(len(some), size, np.int32)), pa.array(some.astype(np.int32)), pa.array(np.full(len(some), task, np.int32)),
                 pa.array([_pack(b[cut[k]:cut[k + 1]]) for k in some], pa.binary()), pa.array([n[cut[k]:cut[k + 1]].tobytes() for k in some], pa.binary())],
                names=["size", "range", "task", "low", "n"])

        for _, raw, offsets, lang in _portions(batches):
            h, s, _, run = hasher.words(raw, offsets)
            salt = _salt(lang, seed)[np.searchsorted(offsets, s, "right") - 1]
            for size, some in held.items():
                f, good = hasher.grams(h, run, size)
                some.append(((f[good] ^ salt[:len(f)][good]) >> np.uint64(64 - MAP_BITS)).astype(np.uint32))
                if sum(map(len, some)) > flush:
                    yield blobs(size)
        for size, some in held.items():
            if sum(map(len, some)):
                yield blobs(size)

    return _own(docs).mapInArrow(count, "size int, range int, task int, low binary, n binary")


def _stepped(parts: DataFrame, tasks: int, added) -> DataFrame:
    """Blobs of a range, one for each task, until at most FAN of them are left: many are added up in steps."""
    groups = tasks // FAN + 1
    while groups > 1:
        parts = parts.withColumn("task", F.pmod("task", F.lit(groups))).groupBy("size", "range", "task").applyInPandas(added, parts.schema)
        groups = groups // FAN + 1 if groups > FAN else 1
    return parts


def full_buckets(parts: DataFrame, least: int) -> dict[int, dict[int, bytes]]:
    """For each size and range, the buckets counted `least` times or more: a list if few, else a bit each."""
    import pandas as pd

    narrow = np.uint8 if least <= 255 else np.uint32

    def total(pdf):
        n = np.zeros(1 << RANGE_BITS, np.int64)
        for low, k in zip(pdf["low"], pdf["n"], strict=True):
            n[_unpack(low)] += np.frombuffer(k, narrow)
        return n

    def added(key, pdf):
        n = np.minimum(total(pdf), least)
        low = np.flatnonzero(n)
        return pd.DataFrame({"size": [key[0]], "range": [key[1]], "task": [key[2]], "low": [_pack(low.astype(np.uint32))], "n": [n[low].astype(narrow).tobytes()]})

    def full(key, pdf):
        some = total(pdf) >= least
        few = some.sum() * 4 < len(some) // 8
        return pd.DataFrame({"size": [key[0]], "range": [key[1]], "held": [np.flatnonzero(some).astype(np.uint32).tobytes() if few else np.packbits(some, bitorder="little").tobytes()]})

    out = {}
    parts = _stepped(parts, parts.rdd.getNumPartitions(), added)
    for r in parts.groupBy("size", "range").applyInPandas(full, "size int, range int, held binary").filter(F.length("held") > 0).toLocalIterator():
        out.setdefault(r["size"], {})[r["range"]] = bytes(r["held"])
    return out


def _merge(held):
    f, n, p = (np.concatenate(x) for x in zip(*held, strict=True))
    order = np.argsort(f, kind="stable")
    f = f[order]
    first = np.flatnonzero(np.concatenate([[True], f[1:] != f[:-1]])) if len(f) else np.zeros(0, int)
    if not len(first):
        return f, n, p
    return f[first], np.add.reduceat(n[order], first), np.minimum.reduceat(p[order], first)


#: Ranges that fingerprints are dealt to, as a power of two.
PRINT_RANGES = 8


def counted(docs: DataFrame, longest: int, seed: int, full, flush: int = FLUSH, bits: int = 64) -> DataFrame:
    """size, range, task, f, n, p: fingerprints of n-grams in full buckets, rising, how often a task found them, and a pointer
    to each (32 bits of a text's hash, then the byte where it begins), a blob for each range; size 0: words of a language.
    `full`: broadcast buckets of each size."""
    import pyarrow as pa

    names = ["size", "range", "task", "f", "n", "p", "lang", "total"]

    def count(batches):
        from pyspark import TaskContext

        hasher, total, task = Hasher(seed, bits), {}, TaskContext.get().partitionId()
        maps = {size: _full(held) for size, held in sorted(full.value.items())}
        held, rows = {size: [] for size in maps}, 0

        def batches_of():
            for size, some in held.items():
                if some:
                    f, *others = _merge(some)
                    ranges = np.arange(1 << PRINT_RANGES)
                    cut = np.searchsorted(f >> np.uint64(64 - PRINT_RANGES), np.append(ranges, len(ranges)).astype(np.uint64))
                    mine = np.flatnonzero(cut[1:] > cut[:-1])
                    k = len(mine)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(np.full(k, size, np.int32)), pa.array(mine.astype(np.int32)), pa.array(np.full(k, task, np.int32)),
                         *(pa.array([c[cut[x]:cut[x + 1]].tobytes() for x in mine], pa.binary()) for c in (f, *others)), pa.nulls(k, pa.string()), pa.nulls(k, pa.int64())], names=names)
                    held[size] = []

        for batch, raw, offsets, lang in _portions(batches):
            h, s, _, run = hasher.words(raw, offsets)
            row = np.searchsorted(offsets, s, "right") - 1
            for x, k in zip(lang, np.bincount(row, minlength=len(lang)).tolist(), strict=True):
                total[x] = total.get(x, 0) + k
            salt = _salt(lang, seed)[row]
            pointer = np.asarray(batch.column("doc"))[row] << 32 | s - offsets[row]
            passed = np.ones(len(h) + 1, bool)
            for size, bucket in maps.items():
                f, good = hasher.grams(h, run, size)
                f = f ^ salt[:len(f)]
                # both phrases one word shorter passed, and this one does
                where = np.flatnonzero(good & passed[:len(f)] & passed[1:len(f) + 1])
                where = where[_passes(bucket, f[where])]
                passed = np.zeros(len(h) + 1, bool)
                passed[where] = True
                f, first, n = np.unique(f[where], return_index=True, return_counts=True)
                held[size].append((f, n, pointer[where[first]]))
                rows += len(f)
            if rows > flush:
                held = {size: [_merge(some)] for size, some in held.items()}
                rows = sum(len(some[0][0]) for some in held.values())
                if rows > flush // 2:
                    yield from batches_of()
                    rows = 0
        yield from batches_of()
        if total:
            k = len(total)
            yield pa.RecordBatch.from_arrays([*(pa.array(np.full(k, x, np.int32)) for x in (0, 0, task)), *(pa.nulls(k, pa.binary()) for _ in range(3)),
                                              pa.array(list(total), pa.string()), pa.array(list(total.values()), pa.int64())], names=names)

    return _own(docs).mapInArrow(count, "size int, range int, task int, f binary, n binary, p binary, lang string, total bigint")


def frequent(parts: DataFrame, least: int) -> DataFrame:
    """size, f, n, p of the fingerprints counted `least` times or more; the lowest pointer stays."""
    import pandas as pd

    def merged(pdf):
        return _merge([(np.frombuffer(f, np.uint64), np.frombuffer(n, np.int64), np.frombuffer(p, np.int64)) for f, n, p in zip(pdf["f"], pdf["n"], pdf["p"], strict=True)])

    def added(key, pdf):
        f, n, p = merged(pdf)
        return pd.DataFrame({"size": [key[0]], "range": [key[1]], "task": [key[2]], "f": [f.tobytes()], "n": [n.tobytes()], "p": [p.tobytes()]})

    def kept(key, pdf):
        f, n, p = merged(pdf)
        often = n >= least
        return pd.DataFrame({"size": np.int32(key[0]), "f": f[often].view(np.int64), "n": n[often], "p": p[often]})

    tasks = parts.agg(F.coalesce(F.max("task"), F.lit(0))).first()[0] + 1
    parts = _stepped(parts.filter("size > 0").select("size", "range", "task", "f", "n", "p"), tasks, added)
    return parts.groupBy("size", "range").applyInPandas(kept, "size int, f bigint, n bigint, p bigint")


def phrases_at(docs: DataFrame, found: DataFrame, seed: int, bits: int = 64) -> DataFrame:
    """f, lang, phrase: the text at the pointers (f, size, p), its words joined by blanks."""
    import pyarrow as pa

    wanted = shared(found.groupBy(F.shiftrightunsigned("p", 32).alias("doc")).agg(
        F.collect_list(F.struct("f", "size", F.col("p").bitwiseAND(0xFFFFFFFF).alias("at"))).alias("marks")))
    bodies = _own(docs).join(sized(wanted), "doc").select("lang", "text", "marks")

    def cut(batches):
        hasher = Hasher(seed, bits)
        for batch, raw, offsets, lang in _portions(batches):
            h, s, e, run = hasher.words(raw, offsets)
            prints, salt, rows = {}, _salt(lang, seed).view(np.int64).tolist(), []
            for k, marks in enumerate(batch.column("marks").to_pylist()):
                for m in marks:
                    i, size = int(np.searchsorted(s, offsets[k] + m["at"])), m["size"]
                    if size not in prints:
                        prints[size] = hasher.grams(h, run, size)[0].view(np.int64)
                    if i < len(prints[size]) and prints[size][i] ^ salt[k] == m["f"]:  # else another text has the same hash
                        rows.append((m["f"], lang[k], b" ".join(hasher.lower[raw[s[i + j]:e[i + j]]].tobytes() for j in range(size)).decode()))
            f, tongue, phrase = zip(*rows, strict=True) if rows else ((), (), ())
            yield pa.RecordBatch.from_arrays([pa.array(f, pa.int64()), pa.array(tongue, pa.string()), pa.array(phrase, pa.string())], names=["f", "lang", "phrase"])

    # texts that repeat give a phrase once
    return bodies.mapInArrow(cut, "f bigint, lang string, phrase string").distinct()


def _same_bytes(text: np.ndarray, s: np.ndarray, width: np.ndarray, other: np.ndarray, o: np.ndarray) -> np.ndarray:
    """Whether text[s:s+width] equals other[o:o+width], for every row of s, o and width."""
    same = np.ones(len(s), bool)
    for lo in range(0, len(s), 1 << 17):
        part = slice(lo, lo + (1 << 17))
        n = width[part]
        stop = np.cumsum(n)
        step = np.arange(stop[-1]) - np.repeat(stop - n, n)
        differ = text[np.repeat(s[part], n) + step] != other[np.repeat(o[part], n) + step]
        same[part] = ~np.logical_or.reduceat(differ, stop - n)
    return same


def _joined(raw, s, e, lower) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """All words, lower-cased, each with a blank after it, and where they begin and end: a phrase is one stretch of this."""
    stop = np.cumsum(e - s + 1)
    begin = stop - (e - s + 1)
    flat = np.full(int(stop[-1]) if len(stop) else 0, 32, np.uint8)
    inside = np.ones(len(flat), bool)
    inside[stop - 1] = False
    if len(s):
        step = np.zeros(int(e[-1] - s[0]) + 1, np.int8)
        step[s - s[0]] += 1
        step[e - s[0]] -= 1
        flat[inside] = lower[raw[s[0]:e[-1]][np.cumsum(step[:-1], dtype=np.int8).astype(bool)]]
    return flat, begin, stop - 1


def mismatches(docs: DataFrame, phrases, full, seed: int, bits: int = 64) -> DataFrame:
    """f, phrase: occurrences in the corpus whose fingerprint is one of the phrases' but whose words or language differ.

    `phrases`: broadcast (size -> sorted fingerprints, language, begin and length of their texts; the texts' bytes).
    """
    import pyarrow as pa

    def compare(batches):
        hasher = Hasher(seed, bits)
        sizes, pool = phrases.value
        maps = {size: _full(full.value[size]) for size in sizes}
        pool = np.frombuffer(pool, np.uint8)
        for _, raw, offsets, lang in _portions(batches):
            h, s, e, run = hasher.words(raw, offsets)
            row = np.searchsorted(offsets, s, "right") - 1
            salt, tongue = _salt(lang, seed)[row], np.array(lang, object)[row]
            flat, begin, stop = _joined(raw, s, e, hasher.lower)
            for size, (keys, tongues, at, width) in sizes.items():
                f, good = hasher.grams(h, run, size)
                f = f ^ salt[:len(f)]
                where = np.flatnonzero(good & _passes(maps[size], f))
                k = np.searchsorted(keys, f[where])
                k[k == len(keys)] = 0
                known = keys[k] == f[where]
                where, k = where[known], k[known]
                same = (stop[where + size - 1] - begin[where] == width[k]) & (tongue[where] == tongues[k])
                alike = np.flatnonzero(same)
                same[alike] = _same_bytes(flat, begin[where[alike]], width[k[alike]], pool, at[k[alike]])
                if not same.all():
                    bad = where[~same]
                    yield pa.RecordBatch.from_arrays([pa.array(f[bad].view(np.int64)), pa.array([flat[begin[w]:stop[w + size - 1]].tobytes().decode() for w in bad], pa.string())], names=["f", "phrase"])

    return _own(docs).mapInArrow(compare, "f bigint, phrase string")


def _packed(rows) -> tuple[dict, bytes]:
    """The phrases of a slice in the form that `mismatches` reads."""
    texts = [x.encode() for x in rows.column("phrase").to_pylist()]
    width = np.array([len(x) for x in texts], np.int64)
    at = np.cumsum(width) - width
    f, size, lang = rows.column("f").to_numpy().view(np.uint64), rows.column("size").to_numpy(), np.array(rows.column("lang").to_pylist(), object)
    out = {}
    for k in np.unique(size).tolist():
        mine = np.flatnonzero(size == k)
        mine = mine[np.argsort(f[mine])]
        out[k] = f[mine], lang[mine], at[mine], width[mine]
    return out, b"".join(texts)


def frequent_phrases(docs: DataFrame, longest: int = LONGEST, least: int = LEAST, seed: int = 1, slice_bytes: int = SLICE, flush: int = FLUSH,
                     bits: int = 64, attempts: int = ATTEMPTS) -> tuple[DataFrame, DataFrame]:
    """(lang, size, phrase, n of every phrase of 1 to `longest` words found `least` times or more; lang, total words)."""
    context = docs.sparkSession.sparkContext
    for attempt in range(seed, seed + attempts):
        full = context.broadcast(full_buckets(bucket_counts(docs, longest, least, attempt, 4 * flush, bits), least))
        parts = shared(counted(docs, longest, attempt, full, flush, bits))
        found = shared(frequent(parts, least))
        named = shared(found.join(phrases_at(docs, found, attempt, bits), "f").select("size", "f", "n", "lang", "phrase"))
        held = named.agg(F.count(F.lit(1)).alias("n"), F.countDistinct("f").alias("f"), F.coalesce(F.sum(F.length("phrase") + 40), F.lit(0)).alias("b")).first()
        if held["n"] != held["f"] or held["n"] != found.count():
            continue
        slices = int(held["b"]) // slice_bytes + 1
        clean = True
        for k in range(slices):
            part = named.filter(F.pmod(F.xxhash64("f"), F.lit(slices)) == k).select("size", "f", "lang", "phrase").toArrow()
            if clean and part.num_rows:
                clean = not mismatches(docs, context.broadcast(_packed(part)), full, attempt, bits).limit(1).count()
        if clean:
            return named.select("lang", "size", "phrase", "n"), parts.filter("size = 0").groupBy("lang").agg(F.sum("total").alias("total"))
    raise RuntimeError(f"fingerprints collided under {attempts} bases")


def collocations(docs: DataFrame, longest: int = LONGEST, least: int = LEAST, top: int = TOP, percent: int = PERCENT, **how) -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score: each language's best phrases of 2 to `longest` words."""
    phrases, totals = frequent_phrases(docs, longest, least, **how)
    words = F.split("phrase", " ")
    longer = phrases.filter("size > 1").withColumn("w", words)
    # the weakest cut
    cuts = longer.select("lang", "phrase", F.col("n").alias("a"), "w", "size", F.explode(F.expr("sequence(1, size - 1)")).alias("k")).select(
        "lang", "phrase", "a", "k", F.array_join(F.expr("slice(w, 1, k)"), " ").alias("head"), F.array_join(F.expr("slice(w, k + 1, size - k)"), " ").alias("rest"))
    part = lambda name, count: sized(phrases.select("lang", F.col("phrase").alias(name), F.col("n").alias(count)))
    scored = cuts.join(part("head", "l"), ["lang", "head"]).join(part("rest", "r"), ["lang", "rest"]).join(F.broadcast(totals), "lang")
    scored = scored.withColumn("score", F.expr("(cast(1000 as decimal(4, 0)) * a * total) div (cast(l as decimal(20, 0)) * r)"))
    weakest = scored.groupBy("lang", "phrase").agg(F.min(F.struct("score", "k", "l", "r", "a", F.col("total").alias("n"))).alias("c")).select("lang", "phrase", "c.*")
    # phrases that hardly ever stand outside a longer one
    inner = longer.filter("size > 2").select("lang", F.col("n").alias("outer"), F.explode(F.expr(
        "flatten(transform(sequence(2, size - 1), m -> transform(sequence(1, size - m + 1), i -> array_join(slice(w, i, m), ' '))))")).alias("phrase"))
    held = inner.groupBy("lang", "phrase").agg(F.max("outer").alias("outer"))
    kept = weakest.join(held, ["lang", "phrase"], "left").filter(F.col("outer").isNull() | (F.col("outer") * 100 < F.col("a") * percent))
    # a language's best within each of several parts first, so that no task ranks a whole language
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    order = [F.desc("score"), F.desc("a"), F.asc("phrase")]
    rank = lambda *by: F.row_number().over(Window.partitionBy(*by).orderBy(*order)).cast("long")
    best = kept.withColumn("part", F.pmod(F.xxhash64("phrase"), F.lit(parts))).withColumn("rank", rank("lang", "part")).filter(F.col("rank") <= top)
    return best.withColumn("rank", rank("lang")).filter(F.col("rank") <= top).select("lang", "rank", "phrase", "a", "l", "r", "n", "score")
