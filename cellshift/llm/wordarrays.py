"""Words and word windows of whole texts as NumPy arrays over whole Arrow buffers; no per-word Python objects."""

from __future__ import annotations

import ctypes
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

SLICE_BYTES = 1 << 20  # text handled at once; one longer text is handled alone, whole


def _mix(h: np.ndarray) -> np.ndarray:
    """Finaliser of a 64-bit hash, in place."""
    h ^= h >> np.uint64(30)
    h *= np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(27)
    h *= np.uint64(0x94D049BB133111EB)
    h ^= h >> np.uint64(31)
    return h


def mix(h: np.ndarray, salt: int = 0) -> np.ndarray:
    return _mix(h + np.uint64((salt * 0x9E3779B97F4A7C15) % 2**64))


_BYTES = np.arange(256, dtype=np.uint8)
#: The separators of words: space and \x09-\x0D.
SPACE = (_BYTES == 0x20) | ((_BYTES >= 0x09) & (_BYTES <= 0x0D))
#: Every ASCII character that is neither letter nor digit.
NOT_ALNUM = (_BYTES < 128) & ~np.array([chr(b).isascii() and chr(b).isalnum() for b in range(256)])
_KEEP = _BYTES.copy()
#: A-Z to a-z.
FOLD = np.where((_BYTES >= 65) & (_BYTES <= 90), _BYTES + 32, _BYTES).astype(np.uint8)
_CODE = mix(np.arange(1, 257, dtype=np.uint64), 11)
_STEP = 0x5851F42D4C957F2D | 1
_UNSTEP = pow(_STEP, -1, 2**64)


try:
    _libc = ctypes.CDLL("libc.so.6")
    _libc.malloc_trim
except (OSError, AttributeError):  # another C library
    _libc = None


class _Powers:
    """Powers of the hash step and of its inverse modulo 2**64, grown as needed."""

    def __init__(self):
        self.up = self.down = np.ones(1, np.uint64)

    def need(self, n: int) -> None:
        if len(self.up) < n:
            size = max(n, SLICE_BYTES)
            self.up, self.down = np.full(size, _STEP, np.uint64), np.full(size, _UNSTEP, np.uint64)
            for p in (self.up, self.down):
                p[0] = 1
                np.multiply.accumulate(p, out=p)


_powers = _Powers()


def buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and row offsets (from 0) of a string column; NULL counts as empty."""
    if column.null_count:
        column = pc.fill_null(column, "")
    kind = np.int64 if pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type) else np.int32
    _, off, data = column.buffers()
    if off is None or len(column) == 0:
        return np.zeros(0, np.uint8), np.zeros(len(column) + 1, np.int64)
    offsets = np.frombuffer(off, kind)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    if data is None:
        return np.zeros(0, np.uint8), offsets - offsets[0]
    return np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]], offsets - offsets[0]


def slices(batch: pa.RecordBatch, text: str, size: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """The batch in runs of rows with about ``size`` bytes of text; every row is in one run, whole."""
    _, offsets = buffers(batch.column(batch.schema.get_field_index(text)))
    at, n = 0, batch.num_rows
    while at < n:
        to = max(at + 1, int(np.searchsorted(offsets, offsets[at] + size, "right")) - 1)
        yield batch.slice(at, min(to, n) - at)
        at = to
    release()


#: What frees the tables of another operator in a reused worker; called when words are counted here next.
idle: list = []


def release() -> None:
    """Give freed memory back to the system: workers are kept between tasks and stages of quite different needs."""
    pa.default_memory_pool().release_unused()
    if _libc is not None:
        _libc.malloc_trim(0)


def trimmed(rows: Iterator) -> Iterator:
    """All of ``rows``; what their generator held is given back to the system when it has ended."""
    yield from rows
    release()


class Words:
    """Words of a text column.

    ``start``/``end`` are byte places in ``data``; the words of row i are first[i]:first[i+1]; ``row`` is each word's
    row. Bytes for which ``sep`` holds separate words; a row's end ends a word.
    """

    def __init__(self, column: pa.Array, sep: np.ndarray = SPACE):
        while idle:
            idle.pop()()
        self.data, self.offsets = buffers(column)
        word = ~sep[self.data]
        begin, close = word.copy(), word.copy()
        begin[1:] &= ~word[:-1]
        close[:-1] &= ~word[1:]
        n = len(self.data)
        if n:
            cut = np.unique(self.offsets)
            inner = cut[cut < n]
            begin[inner] = word[inner]
            last = cut[cut > 0] - 1
            close[last] = word[last]
        self.start, self.end = np.flatnonzero(begin), np.flatnonzero(close) + 1
        self.first = np.searchsorted(self.start, self.offsets)
        self.count = np.diff(self.first)
        self.row = np.repeat(np.arange(len(self.count)), self.count)

    def hashes(self, fold: bool = False) -> np.ndarray:
        """64-bit hash of each word, with A-Z lower-cased if ``fold``."""
        n = len(self.data)
        _powers.need(n + 1)
        code = (_CODE[FOLD] if fold else _CODE)[self.data]
        code *= _powers.up[:n]
        total = np.zeros(n + 1, np.uint64)
        np.cumsum(code, out=total[1:])
        h = total[self.end] - total[self.start]
        h *= _powers.down[self.start]
        return _mix(h ^ (self.end - self.start).astype(np.uint64))


def windows(h: np.ndarray, row: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Hash of every run of ``size`` words by first word, and whether the run lies in one row."""
    n = len(h) - size + 1
    if n <= 0:
        return np.zeros(0, np.uint64), np.zeros(0, bool)
    g = np.zeros(n, np.uint64)
    for i in range(size):
        g *= np.uint64(_STEP)
        g += h[i : i + n]
    return _mix(g), row[size - 1 :] == row[:n]


def as_long(h: np.ndarray) -> pa.Array:
    return pa.array(h.view(np.int64))


def lists(values: np.ndarray, counts: np.ndarray) -> pa.ListArray:
    """A list column from concatenated values and their number by row."""
    return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(counts)]).astype(np.int32)), pa.array(values))
