"""Language-model scores: a gated recurrent network with a class-factored output, beside a smoothed unigram base.

Counts.  Every training token is counted by its bytes in one pass with partial sums; hashes only sort words before
their bytes are compared, so no two words are taken for one.  The head are all words of at most ``MOST_WORD`` bytes at or
above a count such that there are at most ``MOST_HEAD`` of them, found from a histogram of logarithmic count bands; it is
broadcast with that bound, 21 MB.  The counts of rarer words are joined to the places where they occur, never broadcast.

Output.  P(word) = P(class | state) * P(word | class).  The ``WORDS`` most frequent words form ``CLASSES`` classes with
a softmax of their own over the state; further head words form one class per octave of their count and the rest one
class, within which a word has its smoothed share of the counts, one unseen word included.  So P is a distribution over
the training words and one unseen word, and with zero weights it is the unigram model, from which training starts.

Training.  Truncated backpropagation in numpy, with Adagrad steps, over every document outside the held-out fold, whole:
each partition starts from the same weights, documents run in parallel lanes, gradients go back ``WINDOW`` tokens while
the state is carried on, and the partitions' weights are averaged by tokens in a tree of tasks.  What is trained on
grows with the input; the weights do not.

Scores.  Documents run whole through the network in parallel lanes; the state is carried from window to window up to
the document's end token, so long texts need no more memory than short ones beyond their tokens.

Defined results for odd input
    null and empty text: the end token alone.  null keys: trained or held out as the crc32 of the empty text says.
    Repeated rows: each its row.  No training document: N = V = 0 and the base gives every token probability 1, the
    model its share of one unseen word.  Empty table: empty result.  Other columns are dropped, so names cannot clash.
"""

from __future__ import annotations

import heapq
import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import kernel
from .shared import fold, stored, stream_arrow

FOLD, HELD_OUT = 10, 0
MOST_HEAD, MOST_WORD = 1 << 18, 64
WORDS, CLASSES, BANDS = 2048, 32, 24
PER_CLASS = WORDS // CLASSES
RARE = CLASSES + BANDS
HIDDEN = 16
WINDOW, SCORE_WINDOW = 16, 32
TRAIN_LANES, TRAIN_LEAST, SCORE_LANES = 256, 64, 256
RATE = 0.15
MOST_LOGIT = 60.0
BLOCK_BYTES = 4 << 20
SCORE_BYTES = 8 << 20  # more: a block takes as many steps as its longest text has tokens
ADD = 0.1
END = b""  # the end token; no word is empty
_F = np.float32


# ---- tokens ---------------------------------------------------------------------------------------------------------


@dataclass
class Tokens:
    """The tokens of some rows: each row's words and its end token, as numbers of the different words.  The spans name the
    words' bytes in ``data``; the end token is an empty span, and the last number."""

    data: np.ndarray
    start: np.ndarray
    end: np.ndarray
    ids: np.ndarray
    counts: np.ndarray  # tokens per row

    @classmethod
    def of(cls, pieces: list[kernel.Slice]) -> Tokens:
        found = [kernel.words(p) for p in pieces]
        low = np.concatenate([w.data for w in found])
        base = np.cumsum([0, *(len(p.data) for p in pieces[:-1])])
        start, end = (np.concatenate([getattr(w, side) + at for w, at in zip(found, base, strict=True)]) for side in ("start", "end"))
        first, back = kernel.distinct(low, start, end)
        counts = np.concatenate([w.counts for w in found])
        ids = np.insert(back, np.cumsum(counts), len(first))
        return cls(low, np.append(start[first], 0), np.append(end[first], 0), ids, counts + 1)


@dataclass
class Lexicon:
    """The head words, the most frequent first (ties by their bytes), with their classes, and the totals of the training
    tokens.  Word i is the bytes offsets[i] to offsets[i + 1]."""

    data: np.ndarray
    offsets: np.ndarray
    counts: np.ndarray
    tokens: int  # N
    types: int  # V

    @classmethod
    def of(cls, counts: dict[bytes, int], tokens: int, types: int) -> Lexicon:
        words = sorted(counts, key=lambda w: (-counts[w], w))
        return cls(np.frombuffer(b"".join(words), np.uint8), np.cumsum([0, *map(len, words)]), np.array([counts[w] for w in words], np.int64), tokens, types)

    def packed(self) -> tuple:
        return self.data, self.offsets, self.counts, self.tokens, self.types

    def __post_init__(self):
        n = len(self.counts)
        rank = np.arange(n)
        listed = rank < WORDS
        band = np.minimum(np.log2(np.maximum(self.counts, 1)).astype(np.int64), BANDS - 1)
        self.cls = np.where(listed, rank // PER_CLASS, CLASSES + band).astype(np.int16)
        self.place = np.where(listed, rank % PER_CLASS, 0).astype(np.int16)
        self.listed = listed
        self.input = np.where(listed, rank, WORDS + band).astype(np.int16)
        weight = self.counts + ADD
        mass = np.bincount(self.cls, weights=weight, minlength=RARE + 1)
        self.rare_types = self.types - n
        self.rare_mass = (self.tokens - int(self.counts.sum())) + ADD * (self.rare_types + 1)  # with one unseen word
        mass[RARE] = self.rare_mass
        self.mass = mass
        self.within = np.log10(weight / np.maximum(mass[self.cls], 1e-9))
        self.base = np.log10(weight / (self.tokens + ADD * (self.types + 1)))
        self.unigram = np.full((CLASSES, PER_CLASS), -30.0)
        self.unigram[self.cls[listed], self.place[listed]] = np.log(weight[listed] / mass[self.cls[listed]])
        self.class_log = np.where(mass > 0, np.log(np.maximum(mass, 1e-9) / max(mass.sum(), 1e-9)), -30.0)


class Head:
    """The number of a word in the lexicon, or -1."""

    def __init__(self, lexicon: Lexicon):
        self.data, self.offsets = lexicon.data, lexicon.offsets
        full = np.flatnonzero(np.diff(self.offsets))
        self.end_token = int(np.flatnonzero(np.diff(self.offsets) == 0)[0]) if len(full) < len(self.offsets) - 1 else -1
        h = kernel.content_hash(self.data, self.offsets[full], self.offsets[full + 1])
        order = np.argsort(h, kind="stable")
        self.hashes, self.word = h[order], full[order]
        again = np.flatnonzero(self.hashes[1:] == self.hashes[:-1]) + 1  # words with the hash of the one before
        self.more = {self.data[self.offsets[w] : self.offsets[w + 1]].tobytes(): int(w) for w in self.word[again]}

    def find(self, tokens: Tokens) -> np.ndarray:
        """For each different word of the tokens, the end token last."""
        out = np.full(len(tokens.start), -1, np.int32)
        out[-1] = self.end_token
        if not len(self.hashes) or len(out) == 1:
            return out
        start, end = tokens.start[:-1], tokens.end[:-1]
        h = kernel.content_hash(tokens.data, start, end)
        at = np.minimum(np.searchsorted(self.hashes, h), len(self.hashes) - 1)
        word = self.word[at]
        maybe = np.flatnonzero(self.hashes[at] == h)
        known = self.offsets[word[maybe]]
        same = self.offsets[word[maybe] + 1] - known == end[maybe] - start[maybe]
        maybe, known = maybe[same], known[same]
        good = kernel.equal(tokens.data, start[maybe], self.data, known, end[maybe] - start[maybe])
        out[maybe[good]] = word[maybe[good]]
        if self.more:
            for i in np.flatnonzero(out[:-1] < 0).tolist():
                out[i] = self.more.get(tokens.data[start[i] : end[i]].tobytes(), -1)
        return out


# ---- network --------------------------------------------------------------------------------------------------------


class Network:
    """Gated recurrent units with one-hot input; outputs are read from the state before a token is fed."""

    NAMES = ("X", "U", "Wc", "bc", "Wo", "bo")

    def __init__(self, lexicon: Lexicon, weights: dict[str, np.ndarray] | None = None, seed: int = 5):
        rng = np.random.default_rng(seed)
        draw = lambda *shape, scale: (rng.standard_normal(shape) * scale).astype(_F)
        self.lexicon = lexicon
        self.w = weights or {
            "X": draw(WORDS + BANDS + 1, 3 * HIDDEN, scale=0.3),
            "U": draw(HIDDEN, 3 * HIDDEN, scale=0.25),
            "Wc": np.zeros((HIDDEN, RARE + 1), _F),
            "bc": lexicon.class_log.astype(_F),
            "Wo": np.zeros((CLASSES, HIDDEN, PER_CLASS), _F),
            "bo": lexicon.unigram.astype(_F),
        }

    def step(self, h: np.ndarray, x: np.ndarray) -> tuple[np.ndarray, ...]:
        """Next state, and what the way back needs."""
        return self.advance(h, self.w["X"][x])

    def advance(self, h: np.ndarray, a: np.ndarray) -> tuple[np.ndarray, ...]:
        """As step, from the inputs' rows of X."""
        u = h @ self.w["U"]
        gates = a[:, : 2 * HIDDEN] + u[:, : 2 * HIDDEN]
        gates *= _F(0.5)
        np.tanh(gates, out=gates)
        gates *= _F(0.5)
        gates += _F(0.5)
        r, z, un = gates[:, :HIDDEN], gates[:, HIDDEN:], u[:, 2 * HIDDEN :]
        n = r * un
        n += a[:, 2 * HIDDEN :]
        np.tanh(n, out=n)
        new = h - n
        new *= z
        new += n
        return new, r, z, n, un

    def output(self, h: np.ndarray, cls: np.ndarray, place: np.ndarray, grads: dict[str, np.ndarray] | None = None):
        """Natural log-probability of the class, and of the word in it where the class has a softmax; with grads, also
        the gradient of the loss at the states."""
        logit = h @ self.w["Wc"]
        logit += self.w["bc"]
        out, back = self._softmax(logit, cls)
        dh = None
        if grads is not None:
            grads["Wc"] += h.T @ back
            grads["bc"] += np.ones(len(back), back.dtype) @ back
            dh = back @ self.w["Wc"].T
        order = np.argsort(cls, kind="stable")
        ends = np.searchsorted(cls[order], np.arange(CLASSES + 1))
        order = order[: ends[-1]]
        if len(order):
            inner, found = h[order], [c for c in range(CLASSES) if ends[c] < ends[c + 1]]
            part = [slice(ends[c], ends[c + 1]) for c in found]
            logit = self.w["bo"][cls[order]]
            for c, s in zip(found, part, strict=True):
                logit[s] += inner[s] @ self.w["Wo"][c]
            got, back = self._softmax(logit, place[order])
            out[order] += got
            if grads is not None:
                d, ones = np.empty_like(inner), np.ones(len(back), back.dtype)
                for c, s in zip(found, part, strict=True):
                    grads["Wo"][c] += inner[s].T @ back[s]
                    grads["bo"][c] += ones[s] @ back[s]
                    np.matmul(back[s], self.w["Wo"][c].T, out=d[s])
                dh[order] += d
        return out, dh

    @staticmethod
    def _softmax(logit, target):
        """log p of the targets, and p - 1 there.  Logits are held within MOST_LOGIT, so no row needs its maximum; sums over a
        row are products with ones, which BLAS does many times faster than a reduction over so few columns."""
        np.clip(logit, -MOST_LOGIT, MOST_LOGIT, out=logit)
        rows = np.arange(len(logit))
        out = logit[rows, target]
        p = np.exp(logit, out=logit)
        total = p @ np.ones(p.shape[1], p.dtype)
        out -= np.log(total)
        p *= (1 / total)[:, None]
        p[rows, target] -= 1
        return out, p


@dataclass
class Lanes:
    """Documents laid end to end in parallel lanes, the longest lane first."""

    order: np.ndarray  # token numbers, lane after lane
    offset: np.ndarray
    length: np.ndarray
    first: np.ndarray  # whether a token begins its document

    @classmethod
    def of(cls, counts: np.ndarray, lanes: int) -> Lanes:
        start = np.cumsum(counts) - counts
        heap = [(0, i) for i in range(min(lanes, len(counts)))]
        rows: list[list[int]] = [[] for _ in heap]
        for d in np.argsort(-counts, kind="stable").tolist():
            size, lane = heap[0]
            rows[lane].append(d)
            heapq.heapreplace(heap, (size + int(counts[d]), lane))
        length = np.array([sum(int(counts[d]) for d in r) for r in rows], np.int64)
        by = np.argsort(-length, kind="stable")
        docs = np.array([d for lane in by for d in rows[lane]], np.int64)
        size = counts[docs]
        order = np.repeat(start[docs], size) + np.arange(int(size.sum())) - np.repeat(np.cumsum(size) - size, size)
        first = np.zeros(int(counts.sum()), bool)
        first[start] = True
        length = length[by]
        return cls(order, np.cumsum(length) - length, length, first)

    @classmethod
    def even(cls, counts: np.ndarray, lanes: int) -> Lanes:
        """All documents in one row, cut into lanes of equal length (to a token), each of TRAIN_LEAST tokens at least: for
        training, where a document that a cut divides goes on in the next lane from an empty state."""
        n = int(counts.sum())
        lanes = max(1, min(lanes, n // TRAIN_LEAST))
        length = n // lanes + (np.arange(lanes) < n % lanes)
        first = np.zeros(n, bool)
        first[np.cumsum(counts) - counts] = True
        return cls(np.arange(n), np.cumsum(length) - length, length, first)

    def windows(self, size: int) -> Iterator[list[np.ndarray]]:
        """Token numbers of the lanes still running, step by step, a window at a time."""
        for lo in range(0, int(self.length[0]) if len(self.length) else 0, size):
            hi = min(lo + size, int(self.length[0]))
            active = np.searchsorted(-self.length, -np.arange(lo, hi), side="left")
            yield [self.order[self.offset[:k] + t] for t, k in zip(range(lo, hi), active.tolist(), strict=True)]


@dataclass
class Block:
    """Tokens of some documents: head position (-1: rare), class, place in the class, input number."""

    head: np.ndarray
    cls: np.ndarray
    place: np.ndarray
    input: np.ndarray
    counts: np.ndarray

    @classmethod
    def of(cls, tokens: Tokens, lexicon: Lexicon, head: Head) -> Block:
        word = head.find(tokens)
        known, n = word >= 0, len(word)
        parts = [np.full(n, RARE, np.int16), np.zeros(n, np.int16), np.full(n, WORDS + BANDS, np.int16)]
        for part, of in zip(parts, (lexicon.cls, lexicon.place, lexicon.input), strict=True):
            part[known] = of[word[known]]
        return cls(word[tokens.ids], *(x[tokens.ids] for x in parts), tokens.counts)


def score_block(net: Network, block: Block) -> np.ndarray:
    """log10 P of every token, but for the share within the rare class."""
    lex, out = net.lexicon, np.zeros(len(block.head))
    lanes = Lanes.of(block.counts, SCORE_LANES)
    h = np.zeros((len(lanes.length), HIDDEN), _F)
    for steps in lanes.windows(SCORE_WINDOW):
        tokens = np.concatenate(steps)
        a, fresh = net.w["X"][block.input[tokens]], lanes.first[tokens]
        seen, sizes = np.empty((len(tokens), HIDDEN), _F), [len(t) for t in steps]
        ends = np.cumsum(sizes)
        starts = ends - sizes
        begins = np.logical_or.reduceat(fresh, starts).tolist()
        for lo, hi, new in zip(starts.tolist(), ends.tolist(), begins, strict=True):
            h = h[: hi - lo]
            if new:
                h = h * ~fresh[lo:hi, None]
            seen[lo:hi] = h
            h = net.advance(h, a[lo:hi])[0]
        got, _ = net.output(seen, block.cls[tokens], block.place[tokens])
        out[tokens] = got
    out /= math.log(10)
    plain = (block.head >= 0) & (block.cls >= CLASSES)
    out[plain] += lex.within[block.head[plain]]
    return out


def train_block(net: Network, block: Block, state: dict[str, np.ndarray]) -> None:
    """One pass of truncated backpropagation over the block; state: Adagrad's sums of squares."""
    w = net.w
    lanes = Lanes.even(block.counts, TRAIN_LANES)
    h = np.zeros((len(lanes.length), HIDDEN), _F)
    H = HIDDEN
    for steps in lanes.windows(WINDOW):
        tokens = np.concatenate(steps)
        ends = np.cumsum([len(t) for t in steps]).tolist()
        spans = [slice(hi - len(t), hi) for t, hi in zip(steps, ends, strict=True)]
        x, fresh = block.input[tokens], lanes.first[tokens]
        a, new = w["X"][x], [bool(fresh[s].any()) for s in spans]
        before, r, z, n, un = (np.empty((len(tokens), H), _F) for _ in range(5))
        for s, begins in zip(spans, new, strict=True):
            h = h[: s.stop - s.start]
            if begins:
                h = h * ~fresh[s][:, None]
            before[s] = h
            h, r[s], z[s], n[s], un[s] = net.advance(h, a[s])
        grads = {k: np.zeros_like(w[k]) for k in ("Wc", "bc", "Wo", "bo")}
        _, d_out = net.output(before, block.cls[tokens], block.place[tokens], grads)
        to_n = (1 - z) * (1 - n * n)
        to_u = np.empty((len(tokens), 3, H), _F)
        to_u[:, 2] = to_n * r
        np.multiply(to_u[:, 2] * un, 1 - r, out=to_u[:, 0])
        np.multiply((before - n) * z, 1 - z, out=to_u[:, 1])
        down, after, back_u = np.zeros_like(h), np.empty_like(before), np.ascontiguousarray(w["U"].T)
        for s, begins in zip(spans[::-1], new[::-1], strict=True):
            k = s.stop - s.start
            if len(down) < k:
                down = np.concatenate([down, np.zeros((k - len(down), H), _F)])
            after[s] = down
            du = (down[:, None, :] * to_u[s]).reshape(k, 3 * H)
            down = down * z[s]
            down += du @ back_u
            down += d_out[s]
            if begins:
                down *= ~fresh[s][:, None]
        da = (after[:, None, :] * to_u).reshape(-1, 3 * H)
        grads["U"] = before.T @ da
        da[:, 2 * H :] = after * to_n
        order = np.argsort(x, kind="stable")
        rows = x[order]
        first = np.flatnonzero(np.append(True, rows[1:] != rows[:-1]))
        rows = rows[first]
        gx = np.add.reduceat(da[order], first, axis=0)
        scale = _F(1.0 / len(tokens))
        for k, g in grads.items():
            g *= scale
            state[k] += g * g
            w[k] -= _F(RATE) * g / np.sqrt(state[k])
        gx *= scale
        state["X"][rows] += gx * gx
        w["X"][rows] -= _F(RATE) * gx / np.sqrt(state["X"][rows])


# ---- on the cluster -------------------------------------------------------------------------------------------------


def _blocks(batches: Iterator[pa.RecordBatch], text_at: int, most: int = BLOCK_BYTES) -> Iterator[tuple[list[pa.RecordBatch], Tokens]]:
    """Rows and their tokens, for some ``most`` bytes of text at a time: what a task holds is bounded by that and its longest text."""
    held: list[pa.RecordBatch] = []
    pieces, size = [], 0
    for batch in batches:
        for p in kernel.slices(batch.column(text_at)):
            held.append(batch.slice(p.lo, p.rows))
            pieces.append(p)
            size += len(p.data)
            if size >= most:
                yield held, Tokens.of(pieces)
                held, pieces, size = [], [], 0
    if held:
        yield held, Tokens.of(pieces)


def token_counts(train: DataFrame, text: str = "text") -> DataFrame:
    """(word, c) over all training tokens; the end token is the empty word."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, t in _blocks(batches, 0):
            yield pa.RecordBatch.from_arrays([kernel.binary(t.data, t.start, t.end), pa.array(np.bincount(t.ids, minlength=len(t.start)))], ["word", "n"])

    return stream_arrow(train.select(text), work, "word binary, n long").groupBy("word").agg(F.sum("n").alias("c"))


def lexicon_of(counts: DataFrame) -> Lexicon:
    """The head and totals of a stored count table; collects at most MOST_HEAD words of at most MOST_WORD bytes."""
    band = F.floor(F.log2("c") * 16).cast("int")
    short = F.octet_length("word") <= MOST_WORD
    sums = counts.groupBy(band.alias("b")).agg(F.count_if(short).alias("n"), F.count("*").alias("v"), F.sum("c").alias("s")).collect()
    types, tokens, taken, least = sum(r["v"] for r in sums), sum(r["s"] for r in sums), 0, None
    for b, n in sorted(((r["b"], r["n"]) for r in sums), reverse=True):
        if taken + n > MOST_HEAD:
            break
        taken, least = taken + n, b
    if least is None:
        return Lexicon.of({}, int(tokens), int(types))
    got = counts.where((band >= least) & short).toArrow()
    return Lexicon.of(dict(zip(got["word"].to_pylist(), got["c"].to_pylist(), strict=True)), int(tokens), int(types))


def _tree_mean(parts: DataFrame, n: int) -> np.ndarray | None:
    """The token-weighted sum of the rows' weight vectors over their weights, reduced 16 to 1 by tasks."""

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, weight = None, 0.0
        for batch in batches:
            for w, v in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                x = np.frombuffer(v.as_py(), np.float64)
                total, weight = (x.copy() if total is None else total + x), weight + w
        if total is not None:
            yield pa.RecordBatch.from_arrays([pa.array([weight]), pa.array([total.tobytes()], pa.binary())], ["weight", "sum"])

    while n > 16:
        n = -(-n // 16)
        parts = stored(stream_arrow(parts.repartition(n), add, "weight double, sum binary"), "lm-means")
    got = [(r["weight"], np.frombuffer(r["sum"], np.float64)) for r in parts.collect()]
    weight = sum(w for w, _ in got)
    return sum(x for _, x in got) / weight if weight else None


def fit(documents: DataFrame, key: str = "doc_id", text: str = "text") -> tuple[Network, DataFrame]:
    """The trained network and the stored counts; learns from documents outside the held-out fold."""
    spark = documents.sparkSession
    train = documents.where(fold(FOLD, key) != HELD_OUT)
    counts = stored(token_counts(train, text), "lm-counts")
    lexicon = lexicon_of(counts)
    net = Network(lexicon)
    packed = spark.sparkContext.broadcast(lexicon.packed())

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = Network(Lexicon(*packed.value))
        head, state, seen = Head(own.lexicon), {k: np.full_like(v, 1e-6) for k, v in own.w.items()}, 0
        for _, tokens in _blocks(batches, 0):
            train_block(own, Block.of(tokens, own.lexicon, head), state)
            seen += len(tokens.ids)
        if seen:
            flat = np.concatenate([own.w[k].ravel() for k in Network.NAMES]).astype(np.float64) * seen
            yield pa.RecordBatch.from_arrays([pa.array([float(seen)]), pa.array([flat.tobytes()], pa.binary())], ["weight", "sum"])

    parts = stored(stream_arrow(train.select(text), work, "weight double, sum binary"), "lm-weights")
    mean, at = _tree_mean(parts, parts.count()), 0
    if mean is not None:
        for k in Network.NAMES:
            size = net.w[k].size
            net.w[k] = mean[at : at + size].reshape(net.w[k].shape).astype(_F)
            at += size
    return net, counts


def score(documents: DataFrame, net: Network, counts: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, held_out, n_tokens, n_known, train_tokens, base_score, score) for every document."""
    spark, lex = documents.sparkSession, net.lexicon
    packed = spark.sparkContext.broadcast((lex.packed(), net.w))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, weights = packed.value
        own = Network(Lexicon(*words), weights)
        head = Head(own.lexicon)
        for held, tokens in _blocks(batches, 1, SCORE_BYTES):
            block, n = Block.of(tokens, own.lexicon, head), tokens.counts
            row = np.repeat(np.arange(len(n)), n)
            known = block.head >= 0
            total = lambda v, of=row, m=len(n): np.bincount(of, weights=v, minlength=m)
            model = total(score_block(own, block))
            base = total(own.lexicon.base[block.head[known]], row[known]) if known.any() else np.zeros(len(n))
            types = len(tokens.start)
            pair, times = np.unique(row[~known] * types + tokens.ids[~known], return_counts=True)
            word = pair % types
            offsets = np.searchsorted(pair // types, np.arange(len(n) + 1)).astype(np.int32)
            rare = pa.StructArray.from_arrays([kernel.binary(tokens.data, tokens.start[word], tokens.end[word]), pa.array(times.astype(np.int32))], ["word", "n"])
            keys = pa.concat_arrays([b.column(0) for b in held])
            yield pa.RecordBatch.from_arrays(
                [keys, pa.array(n.astype(np.int64)), pa.array(total(known.astype(float)).astype(np.int64)), pa.array(base), pa.array(model), pa.ListArray.from_arrays(pa.array(offsets), rare)],
                [key, "n_tokens", "known", "base", "model", "rare"],
            )

    kind = documents.schema[key].dataType.simpleString()
    seen = stream_arrow(documents.select(key, text), work, f"{key} {kind}, n_tokens long, known long, base double, model double, rare array<struct<word:binary,n:int>>")
    rows = stored(seen.withColumn("__id", F.monotonically_increasing_id()), "lm-rows")
    rare = rows.select("__id", F.explode("rare").alias("r")).select("__id", "r.word", "r.n").join(counts, "word", "left")
    c = F.coalesce("c", F.lit(0))
    sums = rare.groupBy("__id").agg(
        F.sum(F.when(c > 0, F.col("n")).otherwise(0)).alias("rare_known"),
        F.sum(F.col("n") * F.log10((c + ADD) / F.lit(lex.tokens + ADD * (lex.types + 1)))).alias("rare_base"),
        F.sum(F.col("n") * F.log10((c + ADD) / F.lit(float(lex.rare_mass)))).alias("rare_model"),
    )
    zero = F.lit(0.0)
    return rows.drop("rare").join(sums, "__id", "left").select(
        key,
        (fold(FOLD, key) == HELD_OUT).alias("held_out"),
        "n_tokens",
        (F.col("known") + F.coalesce("rare_known", F.lit(0))).cast("long").alias("n_known"),
        F.lit(lex.tokens).cast("long").alias("train_tokens"),
        (F.col("base") + F.coalesce("rare_base", zero)).alias("base_score"),
        (F.col("model") + F.coalesce("rare_model", zero)).alias("score"),
    )


def op6_lm_scoring(documents: DataFrame) -> DataFrame:
    return score(documents, *fit(documents))
