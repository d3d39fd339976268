"""Token counts by finite-state transducers compiled from a byte-level BPE vocabulary.

Two deterministic machines count the tokens that the vocabulary's library would return, without its encoder.

Pre-tokens.  The splitting pattern ('s 't 're 've 'm 'll 'd | ?letters | ?numbers | ?others | white space, of which the
last character before other text stands apart) is a transducer of eleven states over twelve character classes; its
transitions are annotated with the pre-tokens they begin.  A text is cut into chunks; each chunk's map from the state
before it to the state after it is found for all states at once (a chunk whose last characters bring all states
together has a constant map), the maps are composed by a parallel prefix scan, and every chunk is then run from its own
known state, all chunks in step.  Texts of a slice are one sequence, with a resetting class between them.

Tokens.  Within a pre-token the number of tokens of each prefix follows from a deterministic transducer over bytes.  A
prefix has one last token: the only suffix token that may follow the last token of what stands before it, where two
tokens may stand side by side if no merge across their border would come first.  A state is the set of places where a
token could still begin, each with its trie node, the token before it and the count up to it relative to the count
now; a transition is annotated with the change of the count, so tokens are emitted (or taken back, where a merge joins
them) as bytes are read.  States are compiled when first met and shared by all texts of a worker process; a table of
pre-tokens with their totals, by their bytes, saves running the same word again.

Merges must be listed after the merges that make their parts, as training produces them; ``Bpe`` checks that.

Defined results for odd input
    null and empty text: 0 tokens.  The added special token inside a text is one token, as the library's default has it.
    Texts of any length: whole, in slices of rows; memory follows the longest text.  Repeated rows: each its row.
    Empty table: empty result.  Other columns are dropped, so names cannot clash.
"""

from __future__ import annotations

import json
import re
import unicodedata

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import kernel
from .shared import map_arrow

# ---- pre-token transducer -------------------------------------------------------------------------------------------

SP, WS, LETTER, NUMBER, OTHER, APOS, ONE, R, V, LL, E, END = range(12)
_START, _L, _N, _O, _SP, _WS, _Q, _QR, _QV, _QL, _C = range(11)
_LETTERS = (LETTER, ONE, R, V, LL, E)
HERE, BEFORE = 1, 2  # a pre-token begins at this character; at the one before it


def _compile() -> tuple[np.ndarray, np.ndarray]:
    """next state and begun pre-tokens for (state, class)."""
    to, mark = np.zeros((11, 12), np.uint8), np.zeros((11, 12), np.uint8)
    fresh = {SP: _SP, WS: _WS, NUMBER: _N, OTHER: _O, APOS: _Q} | dict.fromkeys(_LETTERS, _L)
    stays = {_L: _LETTERS, _N: (NUMBER,), _O: (OTHER, APOS)}
    for c in range(11):
        for s in (_START, _C, _L, _N, _O):
            if c in stays.get(s, ()):
                to[s, c] = s
            else:
                to[s, c], mark[s, c] = fresh[c], HERE
        if c in (SP, WS):
            to[_SP, c] = to[_WS, c] = fresh[c]
        else:
            to[_SP, c], mark[_SP, c] = (_O if c == APOS else fresh[c]), BEFORE
            to[_WS, c], mark[_WS, c] = fresh[c], HERE | BEFORE
        short = {ONE: _C, R: _QR, V: _QV, LL: _QL}
        if c in short:
            to[_Q, c] = short[c]
        elif c in (OTHER, APOS):
            to[_Q, c] = _O
        else:
            to[_Q, c], mark[_Q, c] = fresh[c], HERE
        for s, needs in ((_QR, E), (_QV, E), (_QL, LL)):
            if c == needs:
                to[s, c] = _C
            else:
                to[s, c], mark[s, c] = to[_L, c], mark[_L, c] | BEFORE
    # An open apostrophe followed by s, t, m, d is complete; by r, v, l it may still be the mark alone.
    for s in (_QR, _QV, _QL):
        mark[s, END] = BEFORE
    return to, mark


NEXT, MARK = _compile()
_CHUNK, _TAIL = 512, 12


def state_maps(symbols: np.ndarray) -> np.ndarray:
    """For each row of symbols: the state after it for every state before it."""
    states = np.broadcast_to(np.arange(len(NEXT), dtype=np.uint8), (len(symbols), len(NEXT)))
    for t in range(symbols.shape[1]):
        states = NEXT[states, symbols[:, t, None]]
    return states


def scan(maps: np.ndarray) -> np.ndarray:
    """Inclusive prefix composition of state maps, by doubling."""
    out, step = maps.copy(), 1
    while step < len(out):
        out[step:] = np.take_along_axis(out[step:], out[:-step].astype(np.intp), axis=1)
        step *= 2
    return out


def pretoken_marks(symbols: np.ndarray) -> np.ndarray:
    """Where pre-tokens begin, for one sequence of character classes."""
    n = len(symbols)
    rows = max(1, -(-n // _CHUNK))
    padded = np.full(rows * _CHUNK, END, np.uint8)
    padded[:n] = symbols
    chunks = padded.reshape(rows, _CHUNK)
    maps = state_maps(chunks[:, -_TAIL:])
    open_ = np.flatnonzero((maps != maps[:, :1]).any(axis=1))  # the last characters leave the state open
    if len(open_):
        maps[open_] = state_maps(chunks[open_])
    state = np.zeros(rows, np.uint8)
    state[1:] = scan(maps)[:-1, _START]
    marks = np.empty((_CHUNK, rows), np.uint8)
    columns = np.ascontiguousarray(chunks.T)
    for t in range(_CHUNK):
        c = columns[t]
        marks[t] = MARK[state, c]
        state = NEXT[state, c]
    flat = np.ascontiguousarray(marks.T).ravel()[:n]
    begins = (flat & HERE).astype(bool)
    begins[:-1] |= (flat[1:] & BEFORE) > 0
    return begins


def _classes() -> np.ndarray:
    table = np.full(0x110000, OTHER, np.uint8)
    for code in range(0x110000):
        kind = unicodedata.category(chr(code))[0]
        if kind == "L":
            table[code] = LETTER
        elif kind == "N":
            table[code] = NUMBER
    # The code points of Unicode's White_Space property (fixed values).
    for code in [*range(0x9, 0xE), 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]:
        table[code] = WS
    table[0x20], table[0x27] = SP, APOS
    for letters, kind in (("stmd", ONE), ("r", R), ("v", V), ("l", LL), ("e", E)):
        table[[ord(x) for x in letters]] = kind
    return table


# ---- token transducer -----------------------------------------------------------------------------------------------


CHANGE_BITS = 16
MOST_CHANGE = 1 << CHANGE_BITS - 1  # a token of more bytes could take back more tokens than a transition can say
_CHANGE = (1 << CHANGE_BITS) - 1
MEMO_BITS = 19  # of the number of entries in the table of totals, 28 bytes each


def _byte_alphabet() -> dict[str, int]:
    """The vocabulary's printable stand-in of each byte: printable Latin-1 is itself, the rest counts up from U+0100."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


class Bpe:
    """The transducer over bytes; states and transitions are compiled as they are met."""

    def __init__(self, merges: list[tuple[bytes, bytes]]):
        self.rank: dict[tuple[bytes, bytes], int] = {}
        made: dict[bytes, tuple[int, bytes, bytes]] = {}
        for r, (a, b) in enumerate(merges):
            if any(len(x) > 1 and x not in made for x in (a, b)):
                raise ValueError("a merge comes before the merges of its parts")
            self.rank[a, b] = r
            made.setdefault(a + b, (r, a, b))
        self.trie: dict[int, int] = {}
        self.token: list[bytes | None] = [None]
        never = len(merges) + 1
        self.left: dict[bytes, list[tuple[bytes, int]]] = {}
        self.right: dict[bytes, list[tuple[bytes, int]]] = {}
        for t in [*(bytes([b]) for b in range(256)), *made]:
            node = 0
            for b in t:
                key = node << 8 | b
                if key not in self.trie:
                    self.trie[key] = len(self.token)
                    self.token.append(None)
                node = self.trie[key]
            self.token[node] = t
            # The symbols at t's left and right end while it is being made, each with the rank that consumes it.
            for side, spine in ((1, self.left), (2, self.right)):
                now, until, out = t, never, []
                while True:
                    out.append((now, until))
                    if len(now) == 1:
                        break
                    until, now = made[now][0], made[now][side]
                spine[t] = out
        self.fits: dict[tuple[bytes, bytes], bool] = {}
        self.ids: dict[tuple, int] = {}
        self.states: list[tuple] = []
        self.step: dict[int, int] = {}
        self._id(((0, None, 0),))

    def _id(self, state: tuple) -> int:
        got = self.ids.get(state)
        if got is None:
            got = self.ids[state] = len(self.states)
            self.states.append(state)
        return got

    def beside(self, a: bytes, b: bytes) -> bool:
        """Whether a and b stay two tokens: no merge across their border comes before its parts are consumed."""
        got = self.fits.get((a, b))
        if got is None:
            rank, got = self.rank, True
            for x, x_until in self.right[a]:
                for y, y_until in self.left[b]:
                    r = rank.get((x, y))
                    if r is not None and r < x_until and r <= y_until:
                        got = False
                        break
                if not got:
                    break
            self.fits[a, b] = got
        return got

    def compile(self, key: int) -> int:
        """The transition (state << 8 | byte) -> state << CHANGE_BITS | (change of the count + MOST_CHANGE)."""
        byte, moved, last, change = key & 255, [], None, 0
        for node, before, relative in self.states[key >> 8]:
            to = self.trie.get(node << 8 | byte)
            if to is None:
                continue
            moved.append((to, before, relative))
            t = self.token[to]
            if last is None and t is not None and (before is None or self.beside(before, t)):
                last, change = t, relative + 1
        if not -MOST_CHANGE <= change < MOST_CHANGE:
            raise ValueError(f"a byte changes the count by {change}; a transition holds less than {MOST_CHANGE}")
        out = self._id((*((n, b, r - change) for n, b, r in moved), (0, last, 0)))
        self.step[key] = value = out << CHANGE_BITS | change + MOST_CHANGE
        return value

    def count(self, word: bytes) -> int:
        state = total = 0
        get = self.step.get
        for b in word:
            v = get(state << 8 | b)
            if v is None:
                v = self.compile(state << 8 | b)
            state = v >> CHANGE_BITS
            total += (v & _CHANGE) - MOST_CHANGE
        return total


class Counter:
    """Token counts of whole texts; special: the added tokens that are recognised inside texts."""

    def __init__(self, merges: list[tuple[bytes, bytes]], special: list[str], most_states: int = 400_000):
        self.merges, self.most_states = merges, most_states
        self.bpe = Bpe(merges)
        self.classes = _classes()
        self.special = re.compile("|".join(re.escape(s) for s in sorted(special, key=len, reverse=True))) if special else None
        self.shift, size = np.uint64(64 - MEMO_BITS), 1 << MEMO_BITS
        self.low, self.high = np.zeros(size, np.uint64), np.zeros(size, np.uint64)
        self.length, self.total = np.zeros(size, np.int64), np.zeros(size, np.int32)

    @classmethod
    def load(cls, path: str) -> Counter:
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        back = _byte_alphabet()
        pairs = [m.split(" ") if isinstance(m, str) else m for m in spec["model"]["merges"]]
        return cls([(bytes(back[c] for c in a), bytes(back[c] for c in b)) for a, b in pairs], [t["content"] for t in spec["added_tokens"]])

    def _pretoken_counts(self, data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """Short pre-tokens are looked up by the two numbers that are their bytes; the rest, and those not met lately, are
        told apart and run through the machine once each."""
        length = end - start
        low, high = parts = kernel.ends(data, start, end)
        slot = (kernel.content_hash(data, start, end, parts) >> self.shift).astype(np.int64)
        out = self.total[slot].astype(np.int64)
        miss = np.flatnonzero((self.length[slot] != length) | (self.low[slot] != low) | (self.high[slot] != high) | (length > kernel.SHORT))
        if len(miss):
            if len(self.bpe.states) > self.most_states:  # bounded memory: compile anew
                self.bpe = Bpe(self.merges)
            first, back = kernel.distinct(data, start[miss], end[miss])
            at = miss[first]
            raw, count = data.tobytes(), self.bpe.count
            got = np.array([count(raw[s:e]) for s, e in zip(start[at].tolist(), end[at].tolist(), strict=True)], np.int64)
            out[miss] = got[back]
            _, last = np.unique(slot[at][::-1], return_index=True)  # one pre-token a slot, all its numbers together
            put = at[::-1][last]
            self.low[slot[put]], self.high[slot[put]], self.length[slot[put]], self.total[slot[put]] = low[put], high[put], length[put], got[::-1][last]
        return out

    def counts(self, piece: kernel.Slice) -> np.ndarray:
        """Tokens of each row of the slice."""
        out = np.zeros(piece.rows, np.int64)
        if not len(piece.data):
            return out
        raw = piece.data.tobytes()
        codes = np.frombuffer(raw.decode("utf-8").encode("utf-32-le"), np.uint32)
        lead = np.flatnonzero((piece.data & 0xC0) != 0x80)  # first byte of each character
        cuts = np.searchsorted(lead, piece.offsets[1:])  # characters before the end of each row
        kinds = np.insert(self.classes[codes], cuts, END)
        place = np.insert(lead, cuts, piece.offsets[1:])
        if self.special is not None:
            for m in self.special.finditer(raw.decode("latin-1")):
                row = int(np.searchsorted(piece.offsets[1:], m.start(), side="right"))
                if m.end() <= piece.offsets[row + 1]:
                    out[row] += 1
                    lo, hi = np.searchsorted(lead, [m.start(), m.end()]) + row
                    kinds[lo:hi] = END
        begins = pretoken_marks(kinds)
        edge = np.flatnonzero(begins | (kinds == END))
        begin = np.flatnonzero(begins[edge])
        start, end = place[edge[begin]], place[edge[begin + 1]]  # the sequence closes with END
        row = np.searchsorted(piece.offsets[1:], start, side="right")
        return out + np.bincount(row, weights=self._pretoken_counts(piece.data, start, end), minlength=piece.rows).astype(np.int64)


_COUNTERS: dict[str, Counter] = {}


def counter(path: str) -> Counter:
    """The process's compiled counter for a vocabulary file."""
    if path not in _COUNTERS:
        _COUNTERS[path] = Counter.load(path)
    return _COUNTERS[path]


def token_counts(documents: DataFrame, vocabulary: str, limit: int = 512, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, n_bytes, n_tokens, over_limit); vocabulary: path of a byte-level BPE file, present on every executor."""

    def work(batch: pa.RecordBatch):
        this = counter(vocabulary)
        for p in kernel.slices(batch.column(1)):
            n = this.counts(p)
            yield pa.RecordBatch.from_arrays([batch.column(0)[p.lo : p.hi], pa.array(np.diff(p.offsets)), pa.array(n)], [key, "n_bytes", "n_tokens"])

    kind = documents.schema[key].dataType.simpleString()
    return map_arrow(documents.select(key, text), work, f"{key} {kind}, n_bytes long, n_tokens long").withColumn("over_limit", F.col("n_tokens") > limit)


def op8_token_counts(documents: DataFrame) -> DataFrame:
    import public_tokenizers

    return token_counts(documents, public_tokenizers.path("byte_bpe_50k.json"))
