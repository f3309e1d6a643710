"""Words of whole texts as NumPy arrays, straight from Arrow buffers.

A word is a maximal run of bytes that a 256-entry table maps to non-zero. All
bytes of a multi-byte UTF-8 character are 0x80 or more, so a table over bytes
expresses any rule that treats the non-ASCII characters alike.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

U64 = np.uint64
#: Odd multipliers of two independent word hashes.
BASES = (0x9E3779B97F4A7C15, 0xA0761D6478BD642F)
_MIX1, _MIX2 = U64(0xBF58476D1CE4E5B9), U64(0x94D049BB133111EB)
_STEP = U64(0xD6E8FEB86659FD93)


def _alnum() -> np.ndarray:
    t = np.zeros(256, np.uint8)
    for b in [*range(0x30, 0x3A), *range(0x61, 0x7B), *range(0x80, 0x100)]:
        t[b] = b
    t[0x41:0x5B] = np.arange(0x61, 0x7B)
    return t


def _spaced() -> np.ndarray:
    t = np.arange(256, dtype=np.uint8)
    t[0] = 0xFF  # NUL is a word byte; 0xFF does not occur in UTF-8
    t[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = 0
    return t


#: Lower-cased A-Z, digits and everything beyond ASCII; words `[^\x00-\x2F\x3A-\x60\x7B-\x7F]+`.
ALNUM = _alnum()
#: Everything but space and the controls 9 to 13, unchanged; words `[^\x20\x09-\x0D]+`.
SPACED = _spaced()

_powers: dict[int, np.ndarray] = {}


def _power(base: int, n: int) -> np.ndarray:
    have = _powers.get(base)
    if have is None or len(have) < n:
        size = max(n, 1 << 16)
        have = np.full(size, base, U64)
        have[0] = 1
        have = np.multiply.accumulate(have)
        # A long text's powers are not held on to.
        if size <= 1 << 21:
            _powers[base] = have
    return have[:n]


def mix(x: np.ndarray) -> np.ndarray:
    """Spread the bits of 64-bit values (a bijection)."""
    x = x ^ (x >> U64(30))
    x = x * _MIX1
    x ^= x >> U64(27)
    x *= _MIX2
    x ^= x >> U64(31)
    return x


@dataclass
class Words:
    """Words of some consecutive texts: ``ends[d]`` words lie before the end of text ``d``."""

    data: np.ndarray    # mapped bytes, 0 between words
    start: np.ndarray   # byte positions
    stop: np.ndarray
    ends: np.ndarray    # per text
    hash: np.ndarray    # uint64 per word

    @property
    def starts(self) -> np.ndarray:
        return np.concatenate(([0], self.ends[:-1])) if len(self.ends) else self.ends

    def left(self) -> np.ndarray:
        """Per word, the words from it to its text's end, itself included."""
        sizes = np.diff(self.ends, prepend=0)
        return np.repeat(self.ends, sizes) - np.arange(len(self.hash))

    def text(self, a: int, b: int) -> bytes:
        """Words a to b-1, joined by one space."""
        return b" ".join(self.data[s:e].tobytes() for s, e in zip(self.start[a:b].tolist(), self.stop[a:b].tolist()))


def buffers(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string column, null as empty; offsets start at 0."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks() if column.num_chunks != 1 else column.chunk(0)
    if isinstance(column, pa.ChunkedArray):
        column = pa.concat_arrays(column.chunks)
    if column.null_count:
        column = column.fill_null("")
    wide = pa.types.is_large_string(column.type)
    _, offs, data = column.buffers()
    n = len(column)
    if n == 0 or offs is None:
        return np.zeros(0, np.uint8), np.zeros(n + 1, np.int64)
    o = np.frombuffer(offs, np.int64 if wide else np.int32)[column.offset:column.offset + n + 1].astype(np.int64)
    d = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return d[o[0]:o[-1]], o - o[0]


def chunks(offsets: np.ndarray, limit: int = 1 << 20) -> Iterator[tuple[int, int]]:
    """Ranges of texts of about ``limit`` bytes together; a longer text is alone."""
    i, n = 0, len(offsets) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + limit, "right")) - 1)
        yield i, j
        i = j


def words(data: np.ndarray, offsets: np.ndarray, table: np.ndarray, which: int = 0) -> Words:
    """Words and their hashes; ``offsets`` are the texts' places in ``data``, the first 0; ``which`` picks the hash."""
    base = BASES[which]
    m = table[data]
    n = len(m)
    inside = m != 0
    edge = offsets[1:-1]
    before = np.empty(n, bool)
    after = np.empty(n, bool)
    if n:
        before[0] = after[-1] = False
        before[1:] = inside[:-1]
        after[:-1] = inside[1:]
        before[edge[edge < n]] = False
        inner = edge[edge > 0] - 1
        after[inner] = False
    start = np.flatnonzero(inside & ~before)
    stop = np.flatnonzero(inside & ~after) + 1
    total = np.empty(n + 1, U64)
    total[0] = 0
    np.cumsum(m * _power(base, n), dtype=U64, out=total[1:])
    h = (total[stop] - total[start]) * _power(pow(base, -1, 1 << 64), n + 1)[start]
    return Words(m, start, stop, np.searchsorted(start, offsets[1:], "left"), mix(h))


def grams(h: np.ndarray, k: int) -> np.ndarray:
    """Hash of the k words from each position on (the last k-1 positions have none)."""
    n = len(h) - k + 1
    if n <= 0:
        return np.zeros(0, U64)
    out = h[:n].copy()
    for j in range(1, k):
        out *= _STEP
        out += h[j:j + n]
    return mix(out)


def slide(x: np.ndarray, w: int, op) -> np.ndarray:
    """``op`` (np.minimum or np.maximum) over the w values from each position on."""
    n = len(x) - w + 1
    if n <= 0:
        return x[:0]
    out, have = x, 1
    while have < w:
        step = min(have, w - have)
        out = op(out[:len(out) - step], out[step:])
        have += step
    return out


def winnow(h: np.ndarray, left: np.ndarray, k: int, w: int) -> np.ndarray:
    """Positions of the smallest k-gram hash of every window of w k-grams inside one text.

    ``h`` are ``grams(_, k)``. All positions that attain a window's minimum are
    kept, so two texts that share k + w - 1 words share a kept hash.
    """
    n = len(h)
    if n < w:
        return np.zeros(0, np.int64)
    low = slide(h, w, np.minimum)
    low = np.where(left[:len(low)] >= k + w - 1, low, U64(0))  # a window across texts selects nothing
    pad = np.zeros(w - 1, U64)
    reach = slide(np.concatenate((pad, low, pad)), w, np.maximum)
    return np.flatnonzero((h == reach[:n]) & (reach[:n] > 0))
