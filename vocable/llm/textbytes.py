"""Vectorised word, line and shingle hashing over Arrow string columns.

Works on the UTF-8 buffer of a chunk of texts.  Strings are hashed with a
polynomial prefix hash over 64-bit random byte codes (arithmetic mod 2**64),
then mixed; two different strings collide with probability about 2**-64.
All results depend on the bytes only, never on partition or chunk.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401

U64 = np.uint64
#: White space of the contracts: \x20 and \x09-\x0D, nothing else.
SPACE = np.zeros(256, bool)
SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32

_rng = np.random.Generator(np.random.PCG64(20240229))
_CODE = _rng.integers(1, 1 << 63, 256, dtype=np.uint64) * U64(2) + U64(1)
_R = U64(0x9E3779B97F4A7C15 | 1)
_RINV = U64(pow(int(_R), -1, 1 << 64))
_MIX1, _MIX2 = U64(0xBF58476D1CE4E5B9), U64(0x94D049BB133111EB)
_pow: dict[str, np.ndarray] = {"r": np.ones(1, U64), "inv": np.ones(1, U64)}


def mix(x: np.ndarray) -> np.ndarray:
    """Finaliser that spreads every input bit over the whole 64-bit word."""
    x = (x ^ (x >> U64(30))) * _MIX1
    x = (x ^ (x >> U64(27))) * _MIX2
    return x ^ (x >> U64(31))


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_pow["r"]) < n:
        m = max(n, 1 << 20)
        for key, base in (("r", _R), ("inv", _RINV)):
            p = np.full(m, base, U64)
            p[0] = 1
            _pow[key] = np.multiply.accumulate(p)
    return _pow["r"][:n], _pow["inv"][:n]


class Texts:
    """The bytes of a chunk of texts: ``buf`` and per-row ``start``/``end``."""

    def __init__(self, texts: pa.Array, lower: bool = False):
        texts = texts.fill_null("") if texts.null_count else texts
        texts = texts.cast(pa.large_binary())
        off = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset:texts.offset + len(texts) + 1]
        data = texts.buffers()[2]
        raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
        self.buf = raw[off[0]:off[-1]] if len(off) else raw[:0]
        off = off - off[0] if len(off) else np.zeros(1, np.int64)
        self.start, self.end, self.n = off[:-1], off[1:], len(texts)
        if lower:
            self.buf = LOWER[self.buf]
        self._prefix = None

    def prefix(self) -> np.ndarray:
        if self._prefix is None:
            r, _ = _powers(len(self.buf) + 1)
            p = np.zeros(len(self.buf) + 1, U64)
            np.cumsum(_CODE[self.buf] * r[:-1], out=p[1:])
            self._prefix = p
        return self._prefix

    def hash_ranges(self, s: np.ndarray, e: np.ndarray) -> np.ndarray:
        """64-bit hashes of ``buf[s:e]`` for each pair; equal bytes give equal hashes."""
        p = self.prefix()
        _, inv = _powers(len(self.buf) + 1)
        return mix((p[e] - p[s]) * inv[s] + (e - s).astype(U64) * _MIX2)

    def words(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(row, start, end) of every maximal run of non-space bytes inside a row."""
        return self._runs(~SPACE[self.buf])

    def lines(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(row, start, end) of every \\n-split line; an empty row has one empty line."""
        nl = np.flatnonzero(self.buf == 10)
        s = np.concatenate([self.start, nl + 1])
        e = np.concatenate([nl, self.end])
        s.sort(kind="stable")
        e.sort(kind="stable")
        row = np.repeat(np.arange(self.n), 1 + self.count(nl))
        return row, s, e

    def count(self, pos: np.ndarray) -> np.ndarray:
        """Number of sorted positions ``pos`` inside each row."""
        return np.searchsorted(pos, self.end) - np.searchsorted(pos, self.start)

    def count_mask(self, mask: np.ndarray) -> np.ndarray:
        c = np.zeros(len(mask) + 1, np.int64)
        np.cumsum(mask, out=c[1:])
        return c[self.end] - c[self.start]

    def _runs(self, inside: np.ndarray):
        n = len(inside)
        if n == 0:
            z = np.zeros(0, np.int64)
            return z, z, z
        first = np.empty(n, bool)      # a run begins here
        first[0] = inside[0]
        np.logical_and(inside[1:], ~inside[:-1], out=first[1:])
        cut = np.unique(self.start[(self.start < n)])
        first[cut] = inside[cut]       # a row's first byte never continues the row before
        s = np.flatnonzero(first)
        last = np.empty(n, bool)       # a run ends after this byte
        last[-1] = inside[-1]
        np.logical_and(inside[:-1], ~inside[1:], out=last[:-1])
        stop = np.unique(self.end[self.end > 0]) - 1
        last[stop] = inside[stop]
        e = np.flatnonzero(last) + 1
        # rows without bytes own no position; side="right" skips them
        row = np.searchsorted(self.end, s, side="right")
        return row, s, e


def shingle_hashes(row: np.ndarray, word: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """(index of first word, hash) of each window of ``n`` consecutive words of one row."""
    if len(word) < n:
        return np.zeros(0, np.int64), np.zeros(0, U64)
    at = np.flatnonzero(row[n - 1:] == row[:len(row) - n + 1])
    h = np.zeros(len(at), U64)
    for j in range(n):
        h = mix(h * _R + word[at + j] + U64(j + 1))
    return at, h


def spans(start: np.ndarray, n: np.ndarray) -> np.ndarray:
    """Indices of the ranges ``start[i] : start[i] + n[i]``, one after the other."""
    total = int(n.sum())
    out = np.ones(total, np.int64)
    full = n > 0
    start, n = start[full], n[full]
    if not len(n):
        return out
    at = np.cumsum(n) - n
    out[0] = start[0]
    out[at[1:]] = start[1:] - start[:-1] - n[:-1] + 1
    return np.cumsum(out)


def chunks(batch: pa.RecordBatch, column: str, max_bytes: int = 1 << 20) -> Iterator[pa.RecordBatch]:
    """Slices of ``batch`` of at most ``max_bytes`` of text each, or one row.

    Bounds the memory of the numpy work; a single longer text stays whole.
    """
    texts = batch.column(batch.schema.get_field_index(column))
    size = np.asarray(pa.compute.fill_null(pa.compute.binary_length(texts), 0), np.int64)
    ends = np.cumsum(size)
    i, n = 0, batch.num_rows
    while i < n:
        base = ends[i - 1] if i else 0
        j = max(i + 1, int(np.searchsorted(ends, base + max_bytes, side="right")))
        yield batch.slice(i, j - i)
        i = j
