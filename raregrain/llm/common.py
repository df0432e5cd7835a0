"""Helpers shared by the text operators: reading tables, shared tables, sized joins, text kernels."""
from __future__ import annotations

import sys

import numpy as np
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from raregrain.session import cut_lineage

def travels(name: str) -> None:
    """Functions of this module go to the executors whole, which then need no copy of the package."""
    cloudpickle.register_pickle_by_value(sys.modules[name])


travels(__name__)

SPACE = r"\x20\x09-\x0D"
WORD = rf"[^{SPACE}]+"
#: Rows up to which a side is broadcast after it has been counted.
BROADCAST_ROWS = 50_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared(df: DataFrame) -> DataFrame:
    """Write to the cluster's shared folder and read back: cuts lineage, survives lost executors."""
    return cut_lineage(df)


def sized(df: DataFrame, rows: int | None = None, most: int = BROADCAST_ROWS) -> DataFrame:
    """Hint a broadcast only for a side whose counted rows are within the bound; Spark picks otherwise.

    `df` should be a shared table or cheap, as its rows are counted here unless `rows` is given.
    """
    return F.broadcast(df) if (df.count() if rows is None else rows) <= most else df


def learnable(doc_id: str = "doc_id") -> Column:
    """Rows that a model may learn from: crc32 of doc_id as text, modulo 5, is not 0 (null ids: not learnt from)."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 5 != 0, F.lit(False))


def held_out(doc_id: str = "doc_id") -> Column:
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 5 == 0, F.lit(False))


# ---------------------------------------------------------------------------------------------
# Vectorised kernels over an Arrow batch's text; memory follows `CHUNK`, not the batch or the document.

CHUNK = 1 << 20
_BASE = np.uint64(0x9E3779B97F4A7C15 | 1)
_POWERS: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def mix(x: np.ndarray) -> np.ndarray:
    """64-bit finaliser (xor-shift-multiply), in place."""
    x ^= x >> np.uint64(33)
    x *= np.uint64(0xFF51AFD7ED558CCD)
    x ^= x >> np.uint64(33)
    x *= np.uint64(0xC4CEB9FE1A85EC53)
    x ^= x >> np.uint64(33)
    return x


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    size = 1 << max(20, int(n).bit_length())
    if size not in _POWERS:
        _POWERS.clear()
        inverse = np.uint64(pow(int(_BASE), -1, 1 << 64))
        _POWERS[size] = tuple(np.cumprod(np.concatenate([[np.uint64(1)], np.full(size, b, np.uint64)])) for b in (_BASE, inverse))
    return _POWERS[size]


def byte_view(column) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of an Arrow string array without copying; nulls read as empty."""
    import pyarrow as pa
    import pyarrow.compute as pc

    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = pc.fill_null(column, "")
    column = column.cast(pa.large_string())
    _, off, data = column.buffers()
    offsets = np.frombuffer(off, np.int64)[column.offset:column.offset + len(column) + 1]
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw, offsets


def portions(batches, text: str = "text", limit: int = 1 << 20):
    """Arrow batches cut so that each has about `limit` bytes of text, or one row."""
    for batch in batches:
        _, offsets = byte_view(batch.column(text))
        at = 0
        while at < batch.num_rows:
            end = max(at + 1, int(np.searchsorted(offsets, offsets[at] + limit, "right")) - 1)
            yield batch.slice(at, end - at)
            at = end
        if not batch.num_rows:
            yield batch


def _tables(lower: bool) -> tuple[np.ndarray, np.ndarray]:
    is_word = np.ones(256, bool)
    is_word[[32, 9, 10, 11, 12, 13]] = False
    code = np.arange(1, 257, dtype=np.uint64)
    if lower:
        code[65:91] += np.uint64(32)
    return is_word, code


def word_hashes(raw: np.ndarray, offsets: np.ndarray, lower: bool) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of every white-space separated word, and the first word's index of each text (plus the end).

    Works through the bytes in pieces cut between words, so that a very long text needs no more memory.
    """
    is_word, code = _tables(lower)
    begin, stop = int(offsets[0]), int(offsets[-1])
    edge = np.unique(offsets)
    hashes, starts = [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)]
    at = begin
    while at < stop:
        end = min(stop, at + CHUNK)
        if end < stop:  # move the cut back to a gap or a text's border, else on to the next one
            gap = np.flatnonzero(~is_word[raw[at:end]])
            k = np.searchsorted(edge, end, "right") - 1
            border = int(edge[k]) if k >= 0 and edge[k] > at else at
            best = max(border, at + int(gap[-1]) + 1 if len(gap) else at)
            while best <= at:
                more = min(stop, end + CHUNK)
                gap = np.flatnonzero(~is_word[raw[end:more]])
                k = np.searchsorted(edge, end, "left")
                border = int(edge[k]) if k < len(edge) else stop
                best = min(border, end + int(gap[0]) + 1) if len(gap) else (border if border <= more else at)
                end = more
                if end == stop and best <= at:
                    best = stop
            end = best
        piece = raw[at:end]
        inside = is_word[piece]
        first = inside.copy()
        first[1:] &= ~inside[:-1]
        cut = edge[(edge >= at) & (edge < end)] - at
        first[cut] = inside[cut]
        s = np.flatnonzero(first)
        if len(s):
            last = inside.copy()
            last[:-1] &= ~inside[1:]
            back = cut[cut > 0] - 1
            last[back] = inside[back]
            e = np.flatnonzero(last) + 1
            up, down = _powers(len(piece))
            sums = np.concatenate([[np.uint64(0)], np.cumsum(code[piece] * up[:len(piece)])])
            h = (sums[e] - sums[s]) * down[s]
            h += (e - s).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93)
            hashes.append(mix(h))
            starts.append(s + at)
        at = end
    starts = np.concatenate(starts)
    return np.concatenate(hashes), np.searchsorted(starts, offsets)


def shingle_hashes(words: np.ndarray, size: int) -> np.ndarray:
    """Order-sensitive hash of every run of `size` words (len(words) - size + 1 of them)."""
    n = len(words) - size + 1
    out = np.zeros(max(n, 0), np.uint64)
    for k in range(size):
        out += words[k:k + n] * np.uint64((0xA24BAED4963EE407 * (2 * k + 1) | 1) & 0xFFFFFFFFFFFFFFFF)
        out ^= out >> np.uint64(29)
    return mix(out)
