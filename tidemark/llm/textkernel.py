"""Numpy kernels over batches of UTF-8 texts: words, word hashes and shingles, without a loop per word.

A batch is laid out as one byte array in which every text is followed by a separator byte, so a word
never spans two texts. Hashes are 64-bit polynomials of a word's bytes, mixed; they depend on the
word alone, not on where it stands.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa

#: Bytes of text handled at a time; a longer text is handled alone.
CHUNK_BYTES = 2 << 20
#: Bytes of words hashed at a time, in arrays of 8 bytes for each; a longer word is hashed alone. A worker keeps as many powers of the base.
HASH_BYTES = 1 << 18
_U = np.uint64
_BASE = 0x9E3779B97F4A7C15 | 1


def _class(separators: Iterable[int]) -> np.ndarray:
    table = np.ones(256, dtype=bool)
    table[list(separators)] = False
    return table


#: Words are runs of bytes other than space and 0x09 to 0x0D.
SPACE_WORDS = _class([0x20, *range(0x09, 0x0E)])
#: Words are runs of ASCII letters, digits and all characters beyond ASCII.
ALNUM_WORDS = _class([*range(0x00, 0x30), *range(0x3A, 0x41), *range(0x5B, 0x61), *range(0x7B, 0x80)])
#: Words are runs of letters, digits and characters beyond ASCII, or runs of other visible characters.
TOKENS = np.where(SPACE_WORDS, np.where(ALNUM_WORDS, 1, 2), 0).astype(np.uint8)
TOKENS[65:91] = 1
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit integers that scatters them."""
    x = x.astype(_U, copy=True)
    x ^= x >> _U(30)
    x *= _U(0xBF58476D1CE4E5B9)
    x ^= x >> _U(27)
    x *= _U(0x94D049BB133111EB)
    x ^= x >> _U(31)
    return x


_POWERS = np.empty(0, dtype=_U)
_INVERSE = np.empty(0, dtype=_U)


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse modulo 2**64, at least ``n`` of each."""
    global _POWERS, _INVERSE
    if len(_POWERS) < n:
        m = max(n, 1 << 16)
        for base in (_BASE, pow(_BASE, -1, 1 << 64)):
            p = np.full(m, base, dtype=_U)
            p[0] = 1
            np.multiply.accumulate(p, out=p)
            _POWERS, _INVERSE = (p, _INVERSE) if base == _BASE else (_POWERS, p)
    return _POWERS, _INVERSE


def lay_out(column: pa.Array, lower: bool) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of all texts with a separator after each, and where each text ends; null is empty."""
    if not pa.types.is_large_string(column.type):
        column = column.cast(pa.large_string())
    if column.null_count:
        column = column.fill_null("")
    n = len(column)
    offsets = np.frombuffer(column.buffers()[1], dtype=np.int64)[column.offset : column.offset + n + 1]
    data = column.buffers()[2]
    raw = np.frombuffer(data, dtype=np.uint8)[offsets[0] : offsets[-1]] if data is not None and n and data.size else np.empty(0, np.uint8)
    if lower:
        raw = LOWER[raw]
    ends = offsets[1:] - offsets[0] + np.arange(n)
    out = np.full(len(raw) + n, 0x20, dtype=np.uint8)
    keep = np.ones(len(out), dtype=bool)
    keep[ends] = False
    out[keep] = raw
    return out, ends


class Words:
    """The words of a batch: byte spans, hashes, and the first and last word of each text."""

    def __init__(self, column: pa.Array, table: np.ndarray, lower: bool = True):
        self.bytes, ends = lay_out(column, lower)
        kind = np.zeros(len(self.bytes) + 2, dtype=np.uint8)
        kind[1:-1] = table[self.bytes]
        change = kind[1:] != kind[:-1]
        self.start = np.flatnonzero(change & (kind[1:] > 0))
        self.end = np.flatnonzero(change & (kind[:-1] > 0))
        last = np.searchsorted(self.start, ends)
        self.first = np.concatenate([[0], last[:-1]]).astype(np.int64)
        self.last = last.astype(np.int64)
        self.hash = self._hash()

    def _hash(self) -> np.ndarray:
        out = np.empty(len(self.start), dtype=_U)
        at = 0
        while at < len(out):
            # as many words as fit HASH_BYTES, one at least
            to = max(at + 1, int(np.searchsorted(self.end, self.start[at] + HASH_BYTES, side="right")))
            lo, hi = int(self.start[at]), int(self.end[to - 1])
            power, inverse = _powers(hi - lo + 1)
            total = np.empty(hi - lo + 1, dtype=_U)
            total[0] = 0
            np.cumsum((self.bytes[lo:hi].astype(_U) + _U(1)) * power[: hi - lo], out=total[1:])
            s, e = self.start[at:to] - lo, self.end[at:to] - lo
            out[at:to] = mix64((total[e] - total[s]) * inverse[s])
            at = to
        return out

    def counts(self) -> np.ndarray:
        return self.last - self.first

    def word(self, i: int) -> bytes:
        return self.bytes[self.start[i] : self.end[i]].tobytes()


def ngrams(hashes: np.ndarray, k: int) -> np.ndarray:
    """A hash of every ``k`` consecutive entries (of all texts in a row; callers cut at text ends)."""
    n = len(hashes) - k + 1
    if n <= 0:
        return np.empty(0, dtype=_U)
    out = np.full(n, k, dtype=_U)
    for j in range(k):
        out *= _U(0xD6E8FEB86659FD93)
        out += hashes[j : j + n]
    return mix64(out)


def shingle_sets(words: Words, k: int) -> list[np.ndarray]:
    """Per text the sorted distinct hashes of its ``k``-word shingles; shorter texts are one shingle."""
    grams, none = ngrams(words.hash, k), np.empty(0, dtype=_U)
    out = []
    for lo, hi in zip(words.first.tolist(), words.last.tolist(), strict=True):
        if hi - lo >= k:
            out.append(np.unique(grams[lo : hi - k + 1]))
        elif hi > lo:
            out.append(ngrams(words.hash[lo:hi], hi - lo))
        else:
            out.append(none)
    return out


def chunks(batch: pa.RecordBatch, column: str = "text", limit: int = CHUNK_BYTES) -> Iterator[pa.RecordBatch]:
    """Slices of ``batch`` with about ``limit`` bytes of text each; a longer text stands alone."""
    text = batch.column(batch.schema.get_field_index(column))
    if not pa.types.is_large_string(text.type):
        text = text.cast(pa.large_string())
    offsets = np.frombuffer(text.buffers()[1], dtype=np.int64)[text.offset : text.offset + len(text) + 1] if len(text) else np.zeros(1, np.int64)
    at = 0
    while at < len(text):
        to = max(at + 1, int(np.searchsorted(offsets, offsets[at] + limit, side="right")) - 1)
        to = min(to, len(text))
        yield batch.slice(at, to - at)
        at = to
