"""The pairs of some texts whose md5 comes first, by md5 over arrays: all pairs are compared, and none are listed."""

from __future__ import annotations

import hashlib

import numpy as np

CHUNK = 1 << 14  # pairs at a time: a dozen arrays of 64 kB
LONGEST = 55  # bytes that fit one block of md5

_SHIFTS = [s for r in ((7, 12, 17, 22), (5, 9, 14, 20), (4, 11, 16, 23), (6, 10, 15, 21)) for s in r * 4]
_SINES = np.floor(np.abs(np.sin(np.arange(1, 65))) * 2**32).astype(np.uint32)
_WORD = [(i, (5 * i + 1) % 16, (3 * i + 5) % 16, 7 * i % 16)[i // 16] for i in range(64)]
_START = np.array([0x67452301, 0xEFCDAB89, 0x98BADCFE, 0x10325476], np.uint32)


def leading(words: dict[int, np.ndarray], n: int) -> np.ndarray:
    """The first 32 bits of n md5 digests, as numbers in the order of their hexadecimal forms.

    words: those of the 16 words of a padded block that are not zero everywhere."""
    a, b, c, d = (np.full(n, x, np.uint32) for x in _START)
    f, t = np.empty(n, np.uint32), np.empty(n, np.uint32)
    for i in range(61):  # the last three steps leave the first word as it is
        if i < 16:
            np.bitwise_xor(c, d, out=f)
            np.bitwise_and(f, b, out=f)
            np.bitwise_xor(f, d, out=f)
        elif i < 32:
            np.bitwise_xor(b, c, out=f)
            np.bitwise_and(f, d, out=f)
            np.bitwise_xor(f, c, out=f)
        elif i < 48:
            np.bitwise_xor(b, c, out=f)
            np.bitwise_xor(f, d, out=f)
        else:
            np.bitwise_not(d, out=f)
            np.bitwise_or(f, b, out=f)
            np.bitwise_xor(f, c, out=f)
        np.add(a, f, out=a)
        np.add(a, _SINES[i], out=a)
        if _WORD[i] in words:
            np.add(a, words[_WORD[i]], out=a)
        s = _SHIFTS[i]
        np.left_shift(a, np.uint32(s), out=t)
        np.right_shift(a, np.uint32(32 - s), out=a)
        np.bitwise_or(a, t, out=a)
        np.add(a, b, out=a)
        a, b, c, d = d, a, b, c
    return (b + _START[0]).byteswap()


class Pairs:
    """md5 of head + first + '|' + second, for pairs of texts given by their numbers."""

    def __init__(self, head: bytes, texts: list[bytes]):
        self.head, self.texts = head, texts
        self.size = np.array([len(x) for x in texts], np.int64)
        self.whole = len(head) + 1 + 2 * int(self.size.max(initial=0)) <= LONGEST
        if not self.whole:
            return
        block = lambda parts: np.frombuffer(b"".join([b"\0" * at + x + b"\0" * (64 - at - len(x)) for at, x in parts]), "<u4").reshape(-1, 16)
        lengths, self.kind = np.unique(self.size, return_inverse=True)
        first = block([(0, head + x + b"|") for x in texts])
        second = np.stack([block([(len(head) + n + 1, x + b"\x80") for x in texts]) for n in lengths.tolist()])
        self.used = [w for w in range(14) if first[:, w].any() or second[:, :, w].any()]
        self.first, self.second = ([np.ascontiguousarray(x[..., w]) for w in self.used] for x in (first, second))

    def text(self, i: int, j: int) -> bytes:
        return self.head + self.texts[i] + b"|" + self.texts[j]

    def leading(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        if not self.whole:
            return np.array([int.from_bytes(hashlib.md5(self.text(x, y)).digest()[:4]) for x, y in zip(i.tolist(), j.tolist(), strict=True)], np.uint32)
        kind = self.kind[i]
        words = {w: a[i] | b[kind, j] for w, a, b in zip(self.used, self.first, self.second, strict=True)}
        words[14] = ((self.size[i] + self.size[j] + len(self.head) + 1) * 8).astype(np.uint32)
        return leading(words, len(i))


def first_pairs(head: bytes, texts: list[bytes], grade: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
    """Numbers (i, j) of the ``most`` pairs with grade[i] > grade[j] that are first by md5 of head, text i, '|' and text j,
    then by text i and text j; in no particular order.

    All pairs' digests are compared, a chunk at a time; what is held are the pairs that may still be among the first."""
    by = np.argsort(grade, kind="stable")
    below = np.searchsorted(grade[by], grade[by], side="left")  # a place's lower ones are the first so many places
    ends = np.cumsum(below)
    n = int(ends[-1]) if len(ends) else 0

    def chunk(lo: int, hi: int) -> tuple[np.ndarray, np.ndarray]:
        a, b = (int(np.searchsorted(ends, x, side="right")) for x in (lo, hi - 1))
        ahead = ends[a : b + 1] - below[a : b + 1]
        i = np.repeat(np.arange(a, b + 1), np.minimum(ends[a : b + 1], hi) - np.maximum(ahead, lo))
        return by[i], by[np.arange(lo, hi) - ahead[i - a]]

    if n <= most:
        return chunk(0, n) if n else (np.zeros(0, np.int64), np.zeros(0, np.int64))
    if most < 1:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    pairs, bound, held, size = Pairs(head, texts), np.uint32(0xFFFFFFFF), [], 0

    def cut() -> None:
        nonlocal held, size, bound
        key, i, j = (np.concatenate(x) for x in zip(*held, strict=True))
        if len(key) > most:
            bound = np.partition(key, most - 1)[most - 1]
            keep = key <= bound
            key, i, j = key[keep], i[keep], j[keep]
        held, size = [(key, i, j)], len(key)

    for lo in range(0, n, CHUNK):
        i, j = chunk(lo, min(lo + CHUNK, n))
        key = pairs.leading(i, j)
        near = key <= bound
        held.append((key[near], i[near], j[near]))
        size += len(held[-1][0])
        if size > 2 * most + CHUNK:
            cut()
    cut()
    key, i, j = held[0]
    last = np.flatnonzero(key == bound)
    spare = len(key) - most
    if spare > 0:  # several at the bound: their whole digests decide
        whole = sorted(last.tolist(), key=lambda x: (hashlib.md5(pairs.text(i[x], j[x])).digest(), texts[i[x]], texts[j[x]]))
        keep = np.ones(len(key), bool)
        keep[whole[len(whole) - spare :]] = False
        i, j = i[keep], j[keep]
    return i, j
