"""Vectorised text helpers used inside Arrow tasks: word bounds, word hashes, sorted-set arithmetic.

All of them work on the UTF-8 bytes of a slice of rows. Both word definitions used here (white-space
words and letter/digit words) are decided by ASCII bytes alone, so a byte table gives exact bounds.
Words and shingles are compared by 64-bit hashes; two different words of one corpus share a hash with
probability about n^2 / 2^65.
"""

from __future__ import annotations

import ctypes
import gc
import sys
from collections.abc import Iterator

import numpy as np
import pyarrow as pa

SLICE_BYTES = 2 << 20  # text handled at once inside a task; a longer single text is a slice of its own

LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
#: white-space words: every byte but space and \x09-\x0D
SPACE_WORD = np.ones(256, dtype=bool)
SPACE_WORD[[32, *range(9, 14)]] = False
#: letter/digit words after lower-casing: 0-9, a-z (A-Z) and everything beyond ASCII
ALNUM_WORD = np.zeros(256, dtype=bool)
ALNUM_WORD[48:58] = ALNUM_WORD[65:91] = ALNUM_WORD[97:123] = ALNUM_WORD[128:] = True

_RNG = np.random.Generator(np.random.PCG64(20240229))
_BYTE = _RNG.integers(1, 2**64 - 1, 256, dtype=np.uint64)
_BASE = 0x9E3779B97F4A7C15
_BASE_INV = pow(_BASE, -1, 2**64)
SHINGLE_KEYS = _RNG.integers(1, 2**64 - 1, 64, dtype=np.uint64) | np.uint64(1)
_LOWER_BYTE = _BYTE[LOWER]
HASH_BYTES = 1 << 17  # bytes hashed at once (a longer word alone)


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    out = []
    for base in (_BASE, _BASE_INV):
        p = np.full(n, base, dtype=np.uint64)
        p[0] = 1
        out.append(np.cumprod(p, dtype=np.uint64))
    return out[0], out[1]


def mix64(x: np.ndarray) -> np.ndarray:
    """Finaliser that spreads every input bit over the 64 output bits."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def string_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes and row offsets (n + 1) of a string column; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_string())
    if column.null_count:
        column = column.fill_null("")
    off = np.frombuffer(column.buffers()[1], dtype=np.int64)[column.offset:column.offset + len(column) + 1]
    data = column.buffers()[2]
    buf = np.frombuffer(data, dtype=np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    if not len(column):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    return buf[off[0]:off[-1]], off - off[0]


def row_slices(column: pa.Array, limit: int = SLICE_BYTES) -> Iterator[tuple[int, int]]:
    """Ranges of rows whose texts together hold at most ``limit`` bytes (one row at least)."""
    _, off = string_bytes(column)
    lo, n = 0, len(off) - 1
    while lo < n:
        hi = max(lo + 1, int(np.searchsorted(off, off[lo] + limit, side="right")) - 1)
        yield lo, min(hi, n)
        lo = hi


class Words:
    """Words of a slice of rows: ``start``/``end`` (bytes), ``row`` and ``first`` (n + 1 word offsets per row)."""

    def __init__(self, column: pa.Array, table: np.ndarray):
        self.buf, self.off = string_bytes(column)
        n = len(self.buf)
        is_word = table[self.buf]
        edge = np.zeros(n + 1, dtype=bool)
        edge[self.off] = True
        before = np.zeros(n, dtype=bool)
        before[1:] = is_word[:-1]
        before[edge[:n]] = False
        after = np.zeros(n, dtype=bool)
        after[:-1] = is_word[1:]
        after[edge[1:]] = False
        self.start = np.flatnonzero(is_word & ~before)
        self.end = np.flatnonzero(is_word & ~after) + 1
        self.first = np.searchsorted(self.start, self.off)

    @property
    def row(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.off) - 1), np.diff(self.first))

    def hashes(self) -> np.ndarray:
        """64-bit hash of every word after lower-casing A-Z."""
        out = np.empty(len(self.start), np.uint64)
        up, down = _powers(min(len(self.buf), HASH_BYTES) + 1)
        i = 0
        while i < len(out):
            base = self.start[i]
            j = max(i + 1, int(np.searchsorted(self.end, base + HASH_BYTES, side="right")))
            size = self.end[j - 1] - base
            if size >= len(up):
                up, down = _powers(size + 1)
            total = np.zeros(size + 1, dtype=np.uint64)
            np.cumsum(_LOWER_BYTE[self.buf[base:base + size]] * up[:size], out=total[1:])
            a, b = self.start[i:j] - base, self.end[i:j] - base
            out[i:j] = (total[b] - total[a]) * down[a]
            i = j
        return mix64(out)


def runs(words: np.ndarray, size: int) -> np.ndarray:
    """Hash of every run of ``size`` consecutive word hashes."""
    n = len(words) - size + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    out = words[:n] * SHINGLE_KEYS[0]
    for k in range(1, size):
        out = out + words[k:k + n] * SHINGLE_KEYS[k]
    return mix64(out + np.uint64(size))


def csr_indices(start: np.ndarray, length: np.ndarray) -> np.ndarray:
    """Concatenation of ``arange(s, s + l)`` for every pair."""
    total = int(length.sum())
    if not total:
        return np.zeros(0, np.int64)
    shift = np.cumsum(length) - length
    return np.arange(total, dtype=np.int64) + np.repeat(start - shift, length)


class IdPool:
    """Lists of token ids under running numbers, kept in one growing array."""

    def __init__(self):
        self.ids = np.zeros(1 << 16, np.uint32)
        self.begin, self.count = np.zeros(1 << 14, np.int64), np.zeros(1 << 14, np.int64)
        self.used = self.size = 0

    def add(self, ids, count) -> None:
        """Append one list per entry of ``count``; ``ids`` holds them all."""
        n, at = self.size, self.used
        while at + len(ids) > len(self.ids):
            self.ids = np.concatenate([self.ids, np.zeros_like(self.ids)])
        while n + len(count) > len(self.begin):
            self.begin, self.count = (np.concatenate([x, np.zeros_like(x)]) for x in (self.begin, self.count))
        self.ids[at:at + len(ids)] = ids
        self.begin[n:n + len(count)] = at + np.cumsum(count) - count
        self.count[n:n + len(count)] = count
        self.used, self.size = at + len(ids), n + len(count)

    def take(self, numbers: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(all ids of the lists with these numbers, length of each list)."""
        count = self.count[numbers]
        return self.ids[csr_indices(self.begin[numbers], count)], count


def numbered(words: list[str], known: dict[str, int]) -> np.ndarray:
    return np.fromiter(map(known.__getitem__, words), np.int64, len(words))


def kept_by_worker(name: str, make):
    """An object that this Python worker keeps between tasks (a bounded cache): made by the first task that asks for it."""
    store = sys.__dict__.setdefault("_churnscope_kept", {})
    if name not in store:
        store[name] = make()
    return store[name]


def tidy() -> None:
    """Give back what earlier tasks of this (reused) worker left behind; called when a large task begins."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # not glibc
        pass


def rebuilt(cls, shared):
    """An object of ``cls`` from a broadcast of its attributes (executors need not know the class by name)."""
    out = cls.__new__(cls)
    out.__dict__.update(shared.value)
    return out
