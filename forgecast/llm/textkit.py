"""Vectorised word splitting and 64-bit hashing over Arrow text columns.

Everything here works on whole texts. Temporary arrays are bounded: rows are
taken in groups of about ``SLICE_BYTES`` and hashes are summed over runs of
``CHUNK_BYTES``, so one very long text costs memory in proportion to its own
length only.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

SLICE_BYTES = 1 << 18
CHUNK_BYTES = 1 << 18

_U = np.uint64
_BASE = 0x9E3779B97F4A7C15 | 1
_WORD_BASE = _U(0xD6E8FEB86659FD93)


def _byte_values() -> np.ndarray:
    return np.random.default_rng(20240607).integers(1, 2**63, 256, dtype=np.uint64) | _U(1)


EXACT = _byte_values()
#: the same value for A-Z and a-z: hashing lower-cases ASCII for free
FOLDED = EXACT.copy()
FOLDED[ord("A"):ord("Z") + 1] = EXACT[ord("a"):ord("z") + 1]


def byte_set(*ranges: tuple[int, int]) -> np.ndarray:
    """Boolean table over byte values, true inside the inclusive ranges."""
    out = np.zeros(256, dtype=bool)
    for lo, hi in ranges:
        out[lo:hi + 1] = True
    return out


#: separators of the word class [^\x20\x09-\x0D]+
SPACES = byte_set((0x20, 0x20), (0x09, 0x0D))
#: separators of the word class [^\x00-\x2F\x3A-\x60\x7B-\x7F]+ taken after lower-casing
#: A-Z, so upper-case letters are no separators
NON_ALNUM = byte_set((0x00, 0x2F), (0x3A, 0x40), (0x5B, 0x60), (0x7B, 0x7F))


def mix(x: np.ndarray) -> np.ndarray:
    """Bijective 64-bit finaliser."""
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


class _Powers:
    """Powers of the byte base and of its inverse modulo 2**64."""

    def __init__(self) -> None:
        self.up = np.ones(1, dtype=np.uint64)
        self.down = np.ones(1, dtype=np.uint64)

    def get(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self.up) < n:
            size = 1 << max(12, (n - 1).bit_length())
            inverse = pow(_BASE, -1, 1 << 64)
            for name, base in (("up", _BASE), ("down", inverse)):
                x = np.full(size, base, dtype=np.uint64)
                x[0] = 1
                setattr(self, name, np.multiply.accumulate(x))
        return self.up[:n], self.down[:n]


_POWERS = _Powers()


def segment_hash(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray,
                 values: np.ndarray = EXACT) -> np.ndarray:
    """64-bit hash of each byte segment (ascending, not overlapping)."""
    out = np.empty(len(starts), dtype=np.uint64)
    i = 0
    while i < len(starts):
        a = int(starts[i])
        j = max(i + 1, int(np.searchsorted(ends, a + CHUNK_BYTES, side="right")))
        b = int(ends[j - 1])
        up, down = _POWERS.get(b - a + 1)
        c = np.zeros(b - a + 1, dtype=np.uint64)
        np.cumsum(values[buf[a:b]] * up[:b - a], out=c[1:])
        s, e = starts[i:j] - a, ends[i:j] - a
        out[i:j] = (c[e] - c[s]) * down[s] + (e - s).astype(np.uint64) * _WORD_BASE
        i = j
    return mix(out)


class Texts(NamedTuple):
    """Consecutive rows of a text column: their bytes and row offsets."""

    buf: np.ndarray
    offs: np.ndarray

    @property
    def rows(self) -> int:
        return len(self.offs) - 1


def slices(column: pa.Array, max_bytes: int = SLICE_BYTES) -> Iterator[tuple[int, Texts]]:
    """(first row, Texts) groups of a text column; a null text counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = pc.fill_null(column.cast(pa.large_string()), "")
    if not len(column):
        return
    offs = np.frombuffer(column.buffers()[1], dtype=np.int64)[
        column.offset:column.offset + len(column) + 1]
    data = column.buffers()[2]
    whole = np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, np.uint8)
    lo = 0
    while lo < len(column):
        hi = int(np.searchsorted(offs, offs[lo] + max_bytes, side="right")) - 1
        hi = min(max(hi, lo + 1), len(column))
        yield lo, Texts(whole[offs[lo]:offs[hi]], offs[lo:hi + 1] - offs[lo])
        lo = hi


class Words(NamedTuple):
    """Words of a slice; words first[i]:first[i+1] belong to row i."""

    starts: np.ndarray
    ends: np.ndarray
    first: np.ndarray

    @property
    def counts(self) -> np.ndarray:
        return np.diff(self.first)

    def rows(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.first) - 1), self.counts)


def split_words(t: Texts, separators: np.ndarray = SPACES) -> Words:
    """Maximal runs of non-separator bytes; no run crosses a row."""
    if not len(t.buf):
        empty = np.zeros(0, dtype=np.int64)
        return Words(empty, empty, np.zeros(t.rows + 1, dtype=np.int64))
    inside = ~separators[t.buf]
    edge = np.zeros(len(t.buf) + 1, dtype=bool)
    edge[1:-1] = inside[1:] != inside[:-1]
    first, last = inside.copy(), inside
    first[1:] &= edge[1:-1] | _row_starts(t)[1:]
    ends = np.zeros(len(t.buf), dtype=bool)
    ends[-1] = last[-1]
    ends[:-1] = last[:-1] & (edge[1:-1] | _row_starts(t)[1:])
    starts = np.flatnonzero(first)
    return Words(starts, np.flatnonzero(ends) + 1, np.searchsorted(starts, t.offs))


def _row_starts(t: Texts) -> np.ndarray:
    out = np.zeros(len(t.buf), dtype=bool)
    at = t.offs[:-1]
    out[at[at < len(t.buf)]] = True
    return out


def window_hash(h: np.ndarray, n: int) -> np.ndarray:
    """Rolling hash of every run of n consecutive word hashes (length max(0, len-n+1))."""
    m = len(h) - n + 1
    if m <= 0:
        return np.zeros(0, dtype=np.uint64)
    acc, power = np.zeros(m, dtype=np.uint64), _U(1)
    with np.errstate(over="ignore"):
        for k in range(n):
            acc += h[k:k + m] * power
            power = power * _WORD_BASE
    return mix(acc + _U(n))


class Shingles(NamedTuple):
    """Distinct n-word shingles: hash and group index, groups ascending."""

    hash: np.ndarray
    group: np.ndarray
    counts: np.ndarray


def shingle_sets(h: np.ndarray, first: np.ndarray, n: int = 5) -> Shingles:
    """The distinct n-word shingles of each group of words first[i]:first[i+1].

    A group with 1..n-1 words has its whole sequence as its only shingle; an
    empty group has none.
    """
    groups = len(first) - 1
    counts = np.diff(first)
    hashes, owner = np.zeros(0, np.uint64), np.zeros(0, np.int64)
    word_group = np.repeat(np.arange(groups), counts)
    if len(h) >= n:
        ok = word_group[:len(h) - n + 1] == word_group[n - 1:]
        hashes, owner = window_hash(h, n)[ok], word_group[:len(h) - n + 1][ok]
    short = np.flatnonzero((counts > 0) & (counts < n))
    if len(short):
        acc, power = np.zeros(len(short), dtype=np.uint64), _U(1)
        with np.errstate(over="ignore"):
            for k in range(n - 1):
                has = counts[short] > k
                acc[has] += h[first[short[has]] + k] * power
                power = power * _WORD_BASE
        hashes = np.concatenate([hashes, mix(acc + counts[short].astype(np.uint64))])
        owner = np.concatenate([owner, short])
        order = np.argsort(owner, kind="stable")
        hashes, owner = hashes[order], owner[order]
    if len(hashes):
        order = np.argsort(hashes, kind="stable")
        hs, os_ = hashes[order], owner[order]
        again = np.flatnonzero((hs[1:] == hs[:-1]) & (os_[1:] == os_[:-1])) + 1
        if len(again):
            keep = np.ones(len(hashes), dtype=bool)
            keep[order[again]] = False
            hashes, owner = hashes[keep], owner[keep]
    return Shingles(hashes, owner, np.bincount(owner, minlength=groups))


def set_keys(s: Shingles) -> np.ndarray:
    """64-bit key of each group's set: equal sets have equal keys; 0 for empty sets."""
    out = np.zeros(len(s.counts), dtype=np.uint64)
    full = np.flatnonzero(s.counts)
    if len(full):
        at = np.concatenate([[0], np.cumsum(s.counts[full])[:-1]])
        sums = np.add.reduceat(mix(s.hash ^ _U(0x5851F42D4C957F2D)), at)
        out[full] = mix(sums + s.counts[full].astype(np.uint64))
        out[full[out[full] == 0]] = 1
    return out


def parity_sketch(s: Shingles, longs: int) -> np.ndarray:
    """(groups, longs) bitmaps: the parity of the set's elements per bit.

    Bits in which two sketches differ are at most the elements in which the two
    sets differ, which bounds their overlap from above.
    """
    bits = 64 * longs
    slot = (mix(s.hash ^ _U(0x2545F4914F6CDD1D)) % _U(bits)).astype(np.int64)
    flat = np.bincount(s.group * bits + slot, minlength=len(s.counts) * bits) & 1
    packed = np.packbits(flat.astype(np.uint8).reshape(-1, bits), axis=1)
    return np.ascontiguousarray(packed).view(np.int64).reshape(-1, longs)


def binary_column(data: np.ndarray, lengths: np.ndarray) -> pa.Array:
    """Binary array of consecutive byte runs of ``data`` (no copy)."""
    offs = np.zeros(len(lengths) + 1, dtype=np.int64)
    np.cumsum(lengths, out=offs[1:])
    raw = np.ascontiguousarray(data).view(np.uint8).reshape(-1)
    kind, dtype = (pa.binary(), np.int32) if offs[-1] < 2**31 else (pa.large_binary(), np.int64)
    return pa.Array.from_buffers(kind, len(lengths),
                                 [None, pa.py_buffer(offs.astype(dtype)), pa.py_buffer(raw)])


def list_column(values: np.ndarray, lengths: np.ndarray) -> pa.Array:
    """List array of consecutive runs of ``values``."""
    offs = np.zeros(len(lengths) + 1, dtype=np.int32)
    np.cumsum(lengths, out=offs[1:])
    return pa.ListArray.from_arrays(pa.array(offs), pa.array(values))


def row_sums(values: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Sum of values[first[i]:first[i+1]] for each i."""
    c = np.zeros(len(values) + 1, dtype=np.int64)
    np.cumsum(values, out=c[1:])
    return c[first[1:]] - c[first[:-1]]


def signed(x: np.ndarray) -> np.ndarray:
    return x.view(np.int64)
