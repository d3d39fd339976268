"""Vectorised text kernel shared by the text operators.

Arrow string columns already hold a batch's texts as one UTF-8 buffer with row offsets.  Everything here works on that
buffer with numpy: words are found by byte class, hashed by a polynomial prefix sum, and combined into n-grams, without
a Python loop over rows or words.  Rows are taken in slices of a bounded number of bytes (a longer row is a slice of its
own), so memory follows the slice and not the batch.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import cached_property

import numpy as np
import pyarrow as pa

SLICE_BYTES = 1 << 20
_MASK = (1 << 64) - 1
_BASE = 0x9E3779B97F4A7C15
_BASE_INV = pow(_BASE, -1, 1 << 64)

LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32

#: Words are maximal runs of bytes that are not ASCII white space: [^\x20\x09-\x0D]+
NOT_SPACE = np.ones(256, dtype=bool)
NOT_SPACE[[9, 10, 11, 12, 13, 32]] = False

#: Words are maximal runs of digits, lower-case letters and non-ASCII bytes: [^\x00-\x2F\x3A-\x60\x7B-\x7F]+
ALNUM = np.zeros(256, dtype=bool)
ALNUM[48:58] = ALNUM[97:123] = ALNUM[128:] = True


def _powers(base: int, n: int) -> np.ndarray:
    out = np.empty(n, dtype=np.uint64)
    out[0] = 1
    done, step = 1, base
    with np.errstate(over="ignore"):
        while done < n:
            k = min(done, n - done)
            out[done : done + k] = out[:k] * np.uint64(step)
            done += k
            step = step * step & _MASK
    return out


class _Powers:
    up = _powers(_BASE, 1 << 12)
    down = _powers(_BASE_INV, 1 << 12)

    @classmethod
    def to(cls, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(cls.up) < n:
            size = 1 << (n - 1).bit_length()
            cls.up, cls.down = _powers(_BASE, size), _powers(_BASE_INV, size)
        return cls.up, cls.down


def mix(h: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every input bit reaches every output bit."""
    h = h ^ (h >> np.uint64(32))
    h = h * np.uint64(0xD6E8FEB86659FD93)
    h = h ^ (h >> np.uint64(32))
    h = h * np.uint64(0xD6E8FEB86659FD93)
    return h ^ (h >> np.uint64(32))


@dataclass
class Slice:
    """Rows lo..hi of a batch: their bytes, and the first byte of each row (one more entry than rows)."""

    lo: int
    hi: int
    data: np.ndarray
    offsets: np.ndarray

    @property
    def rows(self) -> int:
        return self.hi - self.lo


def text_buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes and row offsets of a string or binary column; null is the empty text."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if not pa.types.is_large_binary(column.type):
        column = column.cast(pa.large_string() if not pa.types.is_binary(column.type) else pa.large_binary())
    if pa.types.is_large_string(column.type):
        column = column.cast(pa.large_binary())
    if column.null_count:
        column = column.fill_null(b"")
    if not len(column):
        return np.empty(0, np.uint8), np.zeros(1, np.int64)
    _, offsets, data = column.buffers()
    off = np.frombuffer(offsets, dtype=np.int64)[column.offset : column.offset + len(column) + 1]
    raw = np.frombuffer(data, dtype=np.uint8) if data is not None else np.empty(0, np.uint8)
    return raw[off[0] : off[-1]], off - off[0]


def slices(column: pa.Array, most: int = SLICE_BYTES) -> Iterator[Slice]:
    data, off = text_buffers(column)
    lo, n = 0, len(off) - 1
    while lo < n:
        hi = max(lo + 1, int(np.searchsorted(off, off[lo] + most, side="right")) - 1)
        yield Slice(lo, hi, data[off[lo] : off[hi]], off[lo : hi + 1] - off[lo])
        lo = hi


@dataclass
class Words:
    """Words of a slice in text order: first byte, end byte, row within the slice; their bytes are those of ``data``."""

    data: np.ndarray
    start: np.ndarray
    end: np.ndarray
    row: np.ndarray
    counts: np.ndarray  # words per row

    @cached_property
    def hash(self) -> np.ndarray:
        """The 64-bit hash of each word's bytes."""
        return span_hash(self.data, self.start, self.end)


def runs(inside: np.ndarray, offsets: np.ndarray, cut: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """First and end positions of the maximal runs of true bytes; runs end at row ends and, where given, before cuts."""
    n = len(inside)
    before = np.zeros(n, dtype=bool)
    before[1:] = inside[:-1]
    if cut is not None:
        before &= ~cut
    firsts = offsets[:-1]
    before[firsts[firsts < n]] = False
    start = np.flatnonzero(inside & ~before)
    joined = inside & before  # the byte continues the run of the byte before it
    after = np.zeros(n, dtype=bool)
    after[:-1] = joined[1:]
    return start, np.flatnonzero(inside & ~after) + 1


def span_hash(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each span of bytes, from one prefix sum over all of them."""
    n = len(data)
    if not len(start):
        return np.empty(0, np.uint64)
    up, down = _Powers.to(n + 1)
    total = np.empty(n + 1, dtype=np.uint64)
    total[0] = 0
    with np.errstate(over="ignore"):
        np.cumsum((data.astype(np.uint64) + np.uint64(1)) * up[:n], out=total[1:])
        return mix((total[end] - total[start]) * down[start] + (end - start).astype(np.uint64))


def _pieces(length: np.ndarray, most: int = SLICE_BYTES) -> Iterator[slice]:
    """Runs of spans of some ``most`` bytes in all (a longer span is a run of its own)."""
    total, lo = np.cumsum(length), 0
    while lo < len(length):
        hi = max(lo + 1, int(np.searchsorted(total, (total[lo - 1] if lo else 0) + most, side="right")))
        yield slice(lo, hi)
        lo = hi


def gather(data: np.ndarray, start: np.ndarray, length: np.ndarray) -> np.ndarray:
    """The bytes of the spans, one span after the other."""
    parts = []
    for s in _pieces(length):
        n = length[s]
        parts.append(data[np.repeat(start[s] - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))])
    return np.concatenate(parts) if parts else np.empty(0, np.uint8)


def equal(a: np.ndarray, a_start: np.ndarray, b: np.ndarray, b_start: np.ndarray, length: np.ndarray) -> np.ndarray:
    """Whether each span of a has the bytes of the span of b that has its number; both have the given lengths, above zero."""
    out = np.ones(len(length), bool)
    for s in _pieces(length):
        n = length[s]
        first = np.cumsum(n) - n
        steps = np.arange(int(n.sum())) - np.repeat(first, n)
        other = a[np.repeat(a_start[s], n) + steps] != b[np.repeat(b_start[s], n) + steps]
        if other.any():
            out[s] = ~np.logical_or.reduceat(other, first)
    return out


_LOW_BYTES = np.array([(1 << 8 * n) - 1 for n in range(8)] + [_MASK], np.uint64)
SHORT = 16


def ends(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The first and the next eight bytes of each span as numbers, zero beyond its end: with its length, the whole content of
    a span of at most SHORT bytes."""
    padded = np.concatenate([data, np.zeros(SHORT, np.uint8)])
    eight = np.ndarray((len(padded) - 7,), "<u8", padded, strides=(1,))
    length = end - start
    return eight[start] & _LOW_BYTES[np.minimum(length, 8)], eight[np.minimum(start + 8, len(eight) - 1)] & _LOW_BYTES[np.clip(length - 8, 0, 8)]


def content_hash(data: np.ndarray, start: np.ndarray, end: np.ndarray, parts: tuple[np.ndarray, np.ndarray] | None = None) -> np.ndarray:
    """A hash to sort spans by before they are compared: of a short span's bytes, of a longer one's first and last bytes."""
    low, high = parts or ends(data, start, end)
    with np.errstate(over="ignore"):
        h = low * np.uint64(0x9FB21C651E98DF25) ^ (high + (end - start).astype(np.uint64)) * np.uint64(_BASE)
        if len(long := np.flatnonzero(end - start > SHORT)):
            low, high = ends(data, end[long] - SHORT, end[long])
            h[long] ^= mix(low * np.uint64(_BASE) + high)
        return mix(h)


def distinct(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The number of the first span of each different content, and the content's number of every span.

    Spans are sorted by their hash and held against the first with that hash, short ones by the two numbers that are their
    bytes, longer ones byte by byte; those that differ from it are told apart by their bytes, so two contents are never
    taken for one.
    """
    if not len(start):
        return np.empty(0, np.int64), np.empty(0, np.int64)
    low, high = parts = ends(data, start, end)
    _, first, back = np.unique(content_hash(data, start, end, parts), return_index=True, return_inverse=True)
    length, to = end - start, first[back]
    same = (length == length[to]) & (low == low[to]) & (high == high[to])
    check = np.flatnonzero(same & (length > SHORT) & (to != np.arange(len(to))))
    same[check] = equal(data, start[check], data, start[to[check]], length[check])
    if not same.all():
        more: dict[bytes, int] = {}
        extra: list[int] = []
        for i in np.flatnonzero(~same).tolist():
            word = data[start[i] : end[i]].tobytes()
            if word not in more:
                more[word] = len(first) + len(extra)
                extra.append(i)
            back[i] = more[word]
        first = np.concatenate([first, np.array(extra, first.dtype)])
    return first, back


def binary(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> pa.Array:
    """The spans as a binary column."""
    length = end - start
    offsets = np.zeros(len(start) + 1, np.int64)
    np.cumsum(length, out=offsets[1:])
    wide = pa.Array.from_buffers(pa.large_binary(), len(start), [None, pa.py_buffer(offsets), pa.py_buffer(gather(data, start, length))])
    return wide.cast(pa.binary())


def words(piece: Slice, kind: np.ndarray = NOT_SPACE, lower: np.ndarray | None = None) -> Words:
    data = LOWER[piece.data] if lower is None else lower
    start, end = runs(kind[data], piece.offsets)
    row = np.searchsorted(piece.offsets[1:], start, side="right")
    return Words(data, start, end, row, np.bincount(row, minlength=piece.rows))


def combine(*parts: np.ndarray) -> np.ndarray:
    """The hash of a sequence of hashes; the order counts."""
    with np.errstate(over="ignore"):
        h = np.zeros(len(parts[0]), np.uint64) + np.uint64(len(parts))
        for p in parts:
            h = (h ^ p) * np.uint64(0x9FB21C651E98DF25)
            h = h ^ (h >> np.uint64(29))
        return mix(h)
