"""Hashed n-gram logistic regression trained with FTRL-proximal updates (McMahan et al. 2013).

A text is cut into runs of letters, digits and non-ASCII bytes and runs of ASCII punctuation; both kinds are words here.
A *gram* is a hashed combination of words.  The model is a dense vector of ``dim`` weights, nearly all zero through the
L1 term; only the non-zero ones travel to the executors, so the size of the broadcast is bounded by ``dim`` and not by
the corpus.  A text's score is one sparse dot product.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

from . import kernel

_CLASS = np.zeros(256, dtype=np.uint8)
_CLASS[33:127] = 2
_CLASS[48:58] = _CLASS[65:91] = _CLASS[97:123] = 1
_CLASS[128:] = 1
_UPPER = np.zeros(256, dtype=np.int64)
_UPPER[65:91] = 1


@dataclass(frozen=True)
class GramSpec:
    """Which grams a model sees.

    words: distances between the words of a gram; ``()`` is the single word, ``(1,)`` neighbours, ``(2,)`` a skip-gram.
    shapes: the same over word shapes (kind, letter case, whether the word repeats the one before).
    presence: a gram counts once per text; otherwise its share of the text's grams times ``scale``.
    """

    words: tuple[tuple[int, ...], ...]
    shapes: tuple[tuple[int, ...], ...] = ()
    presence: bool = False
    scale: float = 1.0
    dim: int = 1 << 20


@dataclass
class Grams:
    row: np.ndarray  # row within the slice
    col: np.ndarray  # hashed index below dim
    per_row: np.ndarray  # words of each row


def grams(piece: kernel.Slice, spec: GramSpec) -> Grams:
    """All grams of a slice, one entry per occurrence."""
    kinds = _CLASS[piece.data]
    change = np.zeros(len(kinds), dtype=bool)
    change[1:] = kinds[1:] != kinds[:-1]
    low = kernel.LOWER[piece.data]
    start, end = kernel.runs(kinds > 0, piece.offsets, change)
    row = np.searchsorted(piece.offsets[1:], start, side="right")
    per_row = np.bincount(row, minlength=piece.rows)
    word = kernel.span_hash(low, start, end)
    views = [(1, word, spec.words)]
    if spec.shapes:
        upper = np.concatenate(([0], np.cumsum(_UPPER[piece.data])))
        caps = upper[end] - upper[start]
        shape = kinds[start].astype(np.uint64) * np.uint64(8) + np.where(caps == 0, 0, np.where(caps * 2 > end - start, 2, 1)).astype(np.uint64) * np.uint64(2)
        again = np.zeros(len(word), dtype=bool)
        again[1:] = (word[1:] == word[:-1]) & (row[1:] == row[:-1])
        views.append((2, shape + again.astype(np.uint64), spec.shapes))
    rows, cols = [], []
    n = len(word)
    for view, values, families in views:
        for number, gaps in enumerate(families):
            reach = sum(gaps)
            if n <= reach:
                continue
            at = np.arange(n - reach)
            parts, step = [values[: n - reach]], 0
            for g in gaps:
                step += g
                parts.append(values[step : n - reach + step])
            inside = row[: n - reach] == row[reach:]
            h = kernel.combine(np.full(n - reach, view * 64 + number, np.uint64), *parts)
            rows.append(row[at[inside]])
            cols.append((h[inside] & np.uint64(spec.dim - 1)).astype(np.int64))
    join = lambda xs: np.concatenate(xs) if xs else np.empty(0, np.int64)
    return Grams(join(rows), join(cols), per_row)


def examples(piece: kernel.Slice, spec: GramSpec) -> list[tuple[np.ndarray, np.ndarray]]:
    """Per row of the slice: its distinct gram indices and their values."""
    g = grams(piece, spec)
    key, count = np.unique(g.row * np.int64(spec.dim) + g.col, return_counts=True)
    row, col = key // spec.dim, (key % spec.dim).astype(np.int32)
    value = np.ones(len(key), np.float32) if spec.presence else (count * spec.scale / np.maximum(g.per_row[row], 1)).astype(np.float32)
    cut = np.searchsorted(row, np.arange(piece.rows + 1))
    return [(col[a:b], value[a:b]) for a, b in zip(cut[:-1], cut[1:], strict=True)]


def margins(piece: kernel.Slice, spec: GramSpec, weights: np.ndarray, bias: float) -> np.ndarray:
    """The linear score of each row; a text without words has the bias alone."""
    g = grams(piece, spec)
    w = weights[g.col]
    hit = np.flatnonzero(w)
    row, col, w = g.row[hit], g.col[hit], w[hit].astype(np.float64)
    if spec.presence:
        _, first = np.unique(row * np.int64(spec.dim) + col, return_index=True)
        return bias + np.bincount(row[first], weights=w[first], minlength=piece.rows)
    return bias + np.bincount(row, weights=w, minlength=piece.rows) * spec.scale / np.maximum(g.per_row, 1)


@dataclass
class Model:
    spec: GramSpec
    index: np.ndarray
    weight: np.ndarray
    bias: float

    def dense(self) -> np.ndarray:
        out = np.zeros(self.spec.dim, np.float32)
        out[self.index] = self.weight
        return out


@dataclass(frozen=True)
class Ftrl:
    """Hyper-parameters: learning rate and its offset, L1 and L2, passes over the sample, seed of the order."""

    alpha: float = 0.3
    beta: float = 1.0
    l1: float = 0.5
    l2: float = 0.01
    epochs: int = 4
    seed: int = 7


def train(rows: list[tuple[np.ndarray, np.ndarray]], labels: np.ndarray, spec: GramSpec, how: Ftrl, importance: np.ndarray | None = None) -> Model:
    """FTRL-proximal over the examples in a seeded order, one pass per epoch.

    Each coordinate keeps z and n; its rate falls with its own squared gradients and its weight is zero while
    abs(z) <= l1.  The bias is a coordinate of its own without L1.  No example or a single class: a constant model.
    """
    z, n = np.zeros(spec.dim), np.zeros(spec.dim)
    bz = bn = 0.0
    weight = np.ones(len(labels)) if importance is None else importance
    order = np.random.default_rng(how.seed)

    def solve(zz, nn, l1):
        return np.where(np.abs(zz) <= l1, 0.0, (np.sign(zz) * l1 - zz) / ((how.beta + np.sqrt(nn)) / how.alpha + how.l2))

    for _ in range(how.epochs):
        for i in order.permutation(len(labels)):
            col, value = rows[i]
            zc, nc = z[col], n[col]
            w = solve(zc, nc, how.l1)
            b = -bz / ((how.beta + bn**0.5) / how.alpha + how.l2)
            p = 1.0 / (1.0 + np.exp(-min(max(float(w @ value) + b, -35.0), 35.0)))
            error = (p - labels[i]) * weight[i]
            g = error * value
            after = nc + g * g
            z[col] = zc + g - (np.sqrt(after) - np.sqrt(nc)) / how.alpha * w
            n[col] = after
            grown = bn + error * error
            bz, bn = bz + error - (grown**0.5 - bn**0.5) / how.alpha * b, grown
    w = solve(z, n, how.l1)
    index = np.flatnonzero(w)
    return Model(spec, index.astype(np.int32), w[index].astype(np.float32), float(-bz / ((how.beta + bn**0.5) / how.alpha + how.l2)))


def probability(margin: np.ndarray) -> np.ndarray:
    return 1.0 / (1.0 + np.exp(-np.clip(margin, -35.0, 35.0)))
