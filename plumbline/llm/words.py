"""Word scanning over Arrow text columns with numpy.

A text column is one UTF-8 buffer plus offsets. Word characters are given as a
table over the 256 byte values: bytes of 0x80 and above always belong to words
in the patterns used here, so byte-wise and code-point-wise words are the same.
Word and sequence fingerprints are polynomial hashes modulo 2^64 over mixed
values; a null text has no bytes.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

U = np.uint64
_BASE = U(0x9E3779B97F4A7C15 | 1)
_SEQ = U(0xD6E8FEB86659FD93 | 1)


def _inverse(x: np.uint64) -> np.uint64:
    return U(pow(int(x), -1, 1 << 64))


class _Powers:
    """Powers of a number modulo 2^64, as many as were ever asked for."""

    def __init__(self, base: np.uint64) -> None:
        self.base, self.table = base, np.ones(1, U)

    def upto(self, n: int) -> np.ndarray:
        if len(self.table) < n:
            out = np.full(max(n, 1 << 16), self.base, U)
            out[0] = 1
            self.table = np.multiply.accumulate(out)
        return self.table[:n]


_POW, _INV = _Powers(_BASE), _Powers(_inverse(_BASE))
_SPOW, _SINV = _Powers(_SEQ), _Powers(_inverse(_SEQ))


def mix(x: np.ndarray) -> np.ndarray:
    """The 64-bit finaliser of splitmix."""
    x = x.astype(U, copy=True)
    x ^= x >> U(30)
    x *= U(0xBF58476D1CE4E5B9)
    x ^= x >> U(27)
    x *= U(0x94D049BB133111EB)
    x ^= x >> U(31)
    return x


def _byte_values(fold: bool) -> np.ndarray:
    out = mix(np.arange(1, 257, dtype=U))
    if fold:
        out[ord("A") : ord("Z") + 1] = out[ord("a") : ord("z") + 1]
    return out


def spaced() -> np.ndarray:
    """Word bytes of ``[^\\x20\\x09-\\x0D]+``."""
    out = np.ones(256, bool)
    out[[0x20, *range(0x09, 0x0E)]] = False
    return out


def alnum() -> np.ndarray:
    """Word bytes of ``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+`` once A-Z are lower-cased."""
    out = np.zeros(256, bool)
    out[0x80:] = True
    for a, b in ("09", "az", "AZ"):
        out[ord(a) : ord(b) + 1] = True
    return out


def flat(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a text column and the offsets of its rows."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks() if column.num_chunks != 1 else column.chunk(0)
    column = pc.fill_null(column.cast(pa.large_binary()), b"")
    off = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    raw = column.buffers()[2]
    data = np.frombuffer(raw, np.uint8)[off[0] : off[-1]] if raw is not None and len(off) and off[-1] > off[0] else np.zeros(0, np.uint8)
    return data, off - off[0]


#: Rows of a part at most, so that they can be counted in 16 bits.
ROWS = 1 << 15


def slices(off: np.ndarray, most: int = 1 << 21) -> Iterator[tuple[int, int]]:
    """Row ranges of at most so many bytes, or of one row."""
    lo, n = 0, len(off) - 1
    while lo < n:
        hi = min(max(lo + 1, int(np.searchsorted(off, off[lo] + most, "right")) - 1), lo + ROWS, n)
        yield lo, hi
        lo = hi


def pieces(batches, text: str, most: int = 1 << 21):
    """Each batch cut into parts of bounded size: (part, bytes, offsets)."""
    for batch in batches:
        data, off = flat(batch.column(batch.schema.get_field_index(text)))
        for lo, hi in slices(off, most):
            yield batch.slice(lo, hi - lo), data[off[lo] : off[hi]], off[lo : hi + 1] - off[lo]


class Words:
    """The words of some texts: byte ranges, and for each text its first word."""

    def __init__(self, data: np.ndarray, off: np.ndarray, table: np.ndarray, fold: bool = False) -> None:
        self.data, self.off, self.fold = data, off, fold
        m = table[data]
        start, end = m.copy(), m.copy()
        if len(m):
            start[1:] &= ~m[:-1]
            end[:-1] &= ~m[1:]
            first = off[:-1][off[:-1] < off[1:]]
            start[first] = m[first]
            last = off[1:][off[:-1] < off[1:]] - 1
            end[last] = m[last]
        self.mask = m
        self.start = np.flatnonzero(start)
        self.end = np.flatnonzero(end) + 1
        self.first = np.searchsorted(self.start, off)

    def counts(self) -> np.ndarray:
        return np.diff(self.first)

    def owner(self) -> np.ndarray:
        """The row of each word."""
        return np.repeat(np.arange(len(self.first) - 1), np.diff(self.first))

    def hashes(self) -> np.ndarray:
        """A 64-bit fingerprint of each word."""
        n, values = len(self.start), _byte_values(self.fold)
        out, lo = np.empty(n, U), 0
        while lo < n:
            hi = max(lo + 1, int(np.searchsorted(self.end, self.start[lo] + (1 << 20), "right")))
            a, b = self.start[lo], self.end[hi - 1]
            total = np.zeros(b - a + 1, U)
            np.cumsum(values[self.data[a:b]] * _POW.upto(b - a), out=total[1:])
            s, e = self.start[lo:hi] - a, self.end[lo:hi] - a
            out[lo:hi] = (total[e] - total[s]) * _INV.upto(b - a)[s]
            lo = hi
        return mix(out + (self.end - self.start).astype(U))

    def text(self, i: int) -> bytes:
        return self.data[self.start[i] : self.end[i]].tobytes()


def grams(h: np.ndarray, k: int, salt: int = 0) -> np.ndarray:
    """A fingerprint of every k consecutive values."""
    n = len(h) - k + 1
    if n <= 0:
        return np.zeros(0, U)
    h = mix(h ^ U(salt)) if salt else h
    out, step = np.empty(n, U), 1 << 18
    for lo in range(0, n, step):
        hi = min(n, lo + step)
        part = h[lo : hi + k - 1]
        total = np.zeros(len(part) + 1, U)
        np.cumsum(part * _SPOW.upto(len(part)), out=total[1:])
        out[lo:hi] = (total[k:] - total[:-k]) * _SINV.upto(len(part))[: hi - lo]
    return mix(out + U(k))


def inside(first: np.ndarray, k: int, n: int) -> np.ndarray:
    """Which of the n - k + 1 windows lie in one row; first: as in Words."""
    if n < k:
        return np.zeros(0, bool)
    owner = np.repeat(np.arange(len(first) - 1), np.diff(first))
    return owner[: n - k + 1] == owner[k - 1 :]


def covered(starts: np.ndarray, k: int | np.ndarray, n: int) -> np.ndarray:
    """Which of n words lie in a window that begins at one of the starts."""
    d = np.zeros(n + 1, np.int64)
    np.add.at(d, starts, 1)
    np.add.at(d, starts + k, -1)
    return np.cumsum(d[:-1]) > 0


def per_row(values: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Sums of the values of each row's words."""
    total = np.concatenate([[0], np.cumsum(values, dtype=np.int64)])
    return total[first[1:]] - total[first[:-1]]
