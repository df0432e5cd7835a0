"""Hashed character n-grams of whole texts, in pieces of bounded memory."""
from __future__ import annotations

from collections.abc import Iterator

import numpy as np

from raregrain.llm.common import CHUNK, mix, travels

travels(__name__)

_LETTERS: list[np.ndarray] = []


def letters() -> np.ndarray:
    """Which code points are letters (Unicode category L)."""
    if not _LETTERS:
        _LETTERS.append(np.fromiter((chr(c).isalpha() for c in range(0x110000)), bool, 0x110000))
    return _LETTERS[0]


class Pieces:
    """Some texts' letters, lower-cased, everything else one space: `codes` one after the other, `owner` the text's
    number of each place, `room` the code points from there to the text's end, `core` places that this piece owns."""

    def __init__(self, codes, owner, room, core):
        self.codes, self.owner, self.room, self.core = codes, owner, room, core

    def grams(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        """(hash, owner) of every n-gram that does not begin with two spaces."""
        size = len(self.codes) - n + 1
        if size <= 0:
            return np.zeros(0, np.uint64), np.zeros(0, np.int64)
        c = self.codes
        good = self.core[:size] & (self.room[:size] >= n)
        good &= (c[:size] != 32) | (c[1:size + 1] != 32) if n > 1 else c[:size] != 32
        at = np.flatnonzero(good)
        h = np.full(len(at), n, np.uint64)
        for k in range(n):
            h *= np.uint64(0x100000001B3)
            h += c[at + k]
        return mix(h), self.owner[at]


def pieces(texts: list[str | None], reach: int, limit: int = CHUNK) -> Iterator[Pieces]:
    """Texts (null: empty) in pieces of about `limit` code points; a longer text is cut, and its pieces overlap
    by `reach` code points so that no n-gram is lost or counted twice."""
    is_letter = letters()
    buf, owner, cores, size = [], [], [], 0

    def flush():
        lens = np.array([len(x) for x in buf])
        raw = np.frombuffer("".join(buf).encode("utf-32-le", "surrogatepass"), "<u4")
        codes = np.where(is_letter[raw], raw, 32).astype(np.uint64)
        ends = np.repeat(np.cumsum(lens), lens)
        place = np.arange(len(codes))
        return Pieces(codes, np.repeat(owner, lens), ends - place, place < np.repeat(np.cumsum(lens) - lens + cores, lens))

    for d, text in enumerate(texts):
        text = f" {(text or '').lower()} "
        for a in range(0, len(text), limit):
            buf.append(text[a:a + limit + reach])
            owner.append(d)
            cores.append(min(limit, len(text) - a))
            size += len(buf[-1])
            if size >= limit:
                yield flush()
                buf, owner, cores, size = [], [], [], 0
    if buf:
        yield flush()
