"""Benchmark decontamination by winnowing.

Both sides keep, of every 4 consecutive 7-word grams, the one with the least hash (the last of equals).  A window of 10
words holds exactly 4 such grams, so any 10 words that a document shares with a benchmark item leave a fingerprint in
common.  Items shorter than 10 words are one window; documents look for grams of just those lengths.

Documents are scanned once.  The scan carries a bitmap of the benchmark's fingerprints, whose size is fixed
(``BITS``), so nothing that is broadcast grows with the benchmark or the documents; only positions whose bit is set
leave the scan, with the words around them.  They are joined with the benchmark's fingerprints on the whole hash and
extended word by word; a run of 10 or more equal words is a hit.  A hash alone never decides.  A fingerprint that many
documents share is a hot key of that join only, which adaptive execution can split.

Defined results for odd input
    null, empty or word-less text: no words, nothing hit.  Items with null key or without words have no window.
    Repeated documents: each has its row (rows of equal key and text have equal results).  Repeated items count once
    by key.  Empty documents: empty result.  Empty benchmark: nothing hit, the digest of the empty text.
    Texts of any length are scanned whole.  Extra columns play no part.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import kernel
from .shared import map_arrow, stored

WINDOW = 10
GRAM = 7
KEEP = WINDOW - GRAM + 1
BITS = 25  # the bitmap has 2**25 bits, 4 MiB
_REACH = WINDOW - GRAM


def _grams(hashes: np.ndarray, k: int) -> np.ndarray:
    n = len(hashes) - k + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    with np.errstate(over="ignore"):
        h = np.zeros(n, np.uint64) + np.uint64(k)
        for j in range(k):
            h = h * np.uint64(0x9FB21C651E98DF25) + hashes[j : j + n]
    return kernel.mix(h)


def _selected(w: kernel.Words) -> tuple[np.ndarray, np.ndarray]:
    """Positions (among the slice's words) and hashes of the winnowed grams."""
    g = _grams(w.hash, GRAM)
    n = len(g) - KEEP + 1
    if n <= 0:
        return np.empty(0, np.int64), np.empty(0, np.uint64)
    inside = w.row[:n] == w.row[WINDOW - 1 : WINDOW - 1 + n]
    least, place = g[:n].copy(), np.zeros(n, np.int64)
    for j in range(1, KEEP):
        take = g[j : j + n] <= least
        least[take] = g[j : j + n][take]
        place[take] = j
    at = np.unique((np.arange(n) + place)[inside])
    return at, g[at]


def _short(w: kernel.Words, length: int) -> tuple[np.ndarray, np.ndarray]:
    g = _grams(w.hash, length)
    at = np.flatnonzero(w.row[: len(g)] == w.row[length - 1 :][: len(g)]) if len(g) else np.empty(0, np.int64)
    return at, g[at]


class _Pieces:
    """The words of a slice as text, on demand."""

    def __init__(self, low: np.ndarray, w: kernel.Words):
        self.text, self.start, self.end = low.tobytes(), w.start, w.end

    def get(self, lo: int, hi: int) -> list[str]:
        return [self.text[s:e].decode("utf-8", "surrogatepass") for s, e in zip(self.start[lo:hi].tolist(), self.end[lo:hi].tolist(), strict=True)]


_HIT = "array<struct<hash:bigint,len:int,pos:bigint,left:int,words:array<string>>>"
_HIT_TYPE = pa.list_(pa.struct([("hash", pa.int64()), ("len", pa.int32()), ("pos", pa.int64()), ("left", pa.int32()), ("words", pa.list_(pa.string()))]))


def _entry(h: int, length: int, at: int, first: int, last: int, text: _Pieces) -> dict:
    """A fingerprint with its surroundings, as far as a window can reach within its row (words first..last)."""
    reach = _REACH if length == GRAM else 0
    lo, hi = max(first, at - reach), min(last, at + abs(length) + reach)
    return {"hash": h, "len": length, "pos": at - first, "left": at - lo, "words": text.get(lo, hi)}


def _row_bounds(w: kernel.Words) -> tuple[np.ndarray, np.ndarray]:
    last = np.cumsum(w.counts)
    return last - w.counts, last


def items(benchmark: DataFrame, key: str, text: str) -> DataFrame:
    """The benchmark's fingerprints: hash, len (7: winnowed gram; -n: a whole item of n words), item_id, left, words."""

    def work(batch: pa.RecordBatch):
        for p in kernel.slices(batch.column(1)):
            low = kernel.LOWER[p.data]
            w = kernel.words(p, kernel.ALNUM, low)
            text_, (first, last) = _Pieces(low, w), _row_bounds(w)
            out = [[] for _ in range(p.rows)]
            for at, h in zip(*(x.tolist() for x in _selected(w)), strict=True):
                r = int(w.row[at])
                out[r].append(_entry(h - (1 << 64) if h >> 63 else h, GRAM, at, int(first[r]), int(last[r]), text_))
            for r in np.flatnonzero((w.counts > 0) & (w.counts < WINDOW)).tolist():
                n = int(w.counts[r])
                h = int(_grams(w.hash[first[r] : last[r]], n)[0])
                out[r].append(_entry(h - (1 << 64) if h >> 63 else h, -n, int(first[r]), int(first[r]), int(last[r]), text_))
            yield pa.RecordBatch.from_arrays([batch.column(0)[p.lo : p.hi], pa.array(out, _HIT_TYPE)], ["item", "f"])

    kind = benchmark.schema[key].dataType.simpleString()
    found = map_arrow(benchmark.select(key, text).where(F.col(key).isNotNull()), work, f"item {kind}, f {_HIT}")
    return found.select("item", F.explode("f").alias("f")).select("f.hash", "f.len", "item", F.col("f.left").alias("ileft"), F.col("f.words").alias("iwords")).distinct()


def decontaminate(documents: DataFrame, benchmark: DataFrame, key: str = "doc_id", text: str = "text", item: str = "item_id") -> DataFrame:
    """(key, n_words, n_hit, n_items, items_sha256, contaminated) for every document."""
    spark, asked = documents.sparkSession, key
    prints = stored(items(benchmark, item, text), "benchmark-fingerprints")
    documents, key, text = documents.select(F.col(key).alias("__key"), F.col(text).alias("__text")), "__key", "__text"
    bit = F.shiftrightunsigned(F.col("hash"), 64 - BITS)
    # At most 2**BITS / 64 rows, however large the benchmark is.
    cells = prints.groupBy(F.shiftright(bit, 6).alias("cell")).agg(F.bit_or(F.expr(f"shiftleft(1L, cast(shiftrightunsigned(hash, {64 - BITS}) & 63 as int))")).alias("bits")).toArrow()
    bitmap = np.zeros(1 << (BITS - 6), np.int64)
    bitmap[cells["cell"].to_numpy()] = cells["bits"].to_numpy()
    lengths = sorted(-r["len"] for r in prints.where("len < 0").select("len").distinct().collect())  # at most nine
    shared = spark.sparkContext.broadcast(bitmap.view(np.uint64))

    def known(h: np.ndarray) -> np.ndarray:
        i = h >> np.uint64(64 - BITS)
        return (shared.value[(i >> np.uint64(6)).astype(np.int64)] >> (i & np.uint64(63))) & np.uint64(1) == 1

    def work(batch: pa.RecordBatch):
        for p in kernel.slices(batch.column(1)):
            low = kernel.LOWER[p.data]
            w = kernel.words(p, kernel.ALNUM, low)
            out: list = [None] * p.rows
            text_, bounds = None, None
            for length, (at, h) in [(GRAM, _selected(w)), *((-n, _short(w, n)) for n in lengths)]:
                hit = known(h)
                if not hit.any():
                    continue
                text_ = text_ or _Pieces(low, w)
                first, last = bounds = bounds or _row_bounds(w)
                for a, x in zip(at[hit].tolist(), h[hit].tolist(), strict=True):
                    r = int(w.row[a])
                    out[r] = out[r] or []
                    out[r].append(_entry(x - (1 << 64) if x >> 63 else x, length, a, int(first[r]), int(last[r]), text_))
            raw = p.data.tobytes()
            same = np.array([xxhash.xxh3_64_intdigest(raw[s:e]) for s, e in zip(p.offsets[:-1].tolist(), p.offsets[1:].tolist(), strict=True)], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0)[p.lo : p.hi], pa.array(same), pa.array(w.counts.astype(np.int64)), pa.array(out, _HIT_TYPE)], [key, "same", "n_words", "f"])

    def extend(batch: pa.RecordBatch) -> pa.RecordBatch:
        lo, hi = [], []
        cols = [batch.column(batch.schema.get_field_index(c)).to_pylist() for c in ("len", "pos", "left", "words", "ileft", "iwords")]
        for length, pos, left, words, ileft, iwords in zip(*cols, strict=True):
            n = abs(length)
            if words[left : left + n] != iwords[ileft : ileft + n]:
                lo.append(0), hi.append(0)
                continue
            back = 0
            while back < min(left, ileft) and words[left - 1 - back] == iwords[ileft - 1 - back]:
                back += 1
            on = n
            while left + on < len(words) and ileft + on < len(iwords) and words[left + on] == iwords[ileft + on]:
                on += 1
            full = length < 0 or back + on >= WINDOW
            lo.append(pos - back if full else 0), hi.append(pos + on if full else 0)
        keep = [batch.column(batch.schema.get_field_index(c)) for c in (key, "same", "item")]
        return pa.RecordBatch.from_arrays([*keep, pa.array(lo, pa.int64()), pa.array(hi, pa.int64())], [key, "same", "item", "lo", "hi"])

    kind = documents.schema[key].dataType.simpleString()
    rows = stored(map_arrow(documents.select(key, text), work, f"{key} {kind}, same long, n_words long, f {_HIT}"), "decontamination-scan")
    hits = rows.where("f is not null").select(key, "same", F.explode("f").alias("f")).select(key, "same", "f.*").join(prints, ["hash", "len"])
    spans = map_arrow(hits, extend, f"{key} {kind}, same long, item {benchmark.schema[item].dataType.simpleString()}, lo long, hi long").where("hi > lo")
    # Spans and items of one document: bounded by its own length and by what its result has to name.
    each = spans.groupBy(key, "same").agg(F.sort_array(F.collect_set(F.struct("lo", "hi"))).alias("spans"), F.sort_array(F.collect_set(F.col("item").cast("string"))).alias("items"))
    start = F.struct(F.lit(0).cast("long").alias("end"), F.lit(0).cast("long").alias("n"))
    merged = F.aggregate("spans", start, lambda a, s: F.struct(F.greatest(a["end"], s["hi"]).alias("end"), (a["n"] + F.greatest(F.lit(0).cast("long"), s["hi"] - F.greatest(a["end"], s["lo"]))).alias("n")))
    each = each.select(F.col(key).alias("__k"), F.col("same").alias("__s"), merged["n"].alias("n_hit"), F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join("items", ",").cast("binary"), 256).alias("items_sha256"))
    slim = rows.select(key, "same", "n_words")
    joined = slim.join(stored(each, "decontamination-hits"), slim[key].eqNullSafe(F.col("__k")) & (slim["same"] == F.col("__s")), "left")
    return joined.select(F.col(key).alias(asked), "n_words", F.coalesce("n_hit", F.lit(0).cast("long")).alias("n_hit"), F.coalesce("n_items", F.lit(0).cast("long")).alias("n_items"), F.coalesce("items_sha256", F.sha2(F.lit("").cast("binary"), 256)).alias("items_sha256"), (F.coalesce("n_hit", F.lit(0).cast("long")) > 0).alias("contaminated"))


OP5_SQL = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
b AS (SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark WHERE item_id IS NOT NULL),
bw AS (SELECT DISTINCT item_id, least(len(w), 10) AS n, array_to_string(w[i : i + least(len(w), 10) - 1], ' ') AS s
       FROM (SELECT item_id, w, unnest(range(1, greatest(len(w) - 9, 1) + 1)) AS i FROM b WHERE len(w) > 0)),
ns AS (SELECT DISTINCT n FROM bw),
dw AS (SELECT doc_id, i, n, array_to_string(w[i : i + n - 1], ' ') AS s
       FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM d, ns WHERE len(w) >= n)),
h AS (SELECT dw.doc_id, dw.i, dw.n, bw.item_id FROM dw JOIN bw ON dw.n = bw.n AND dw.s = bw.s),
hit AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT DISTINCT doc_id, unnest(range(i, i + n)) AS p FROM h) GROUP BY doc_id),
it AS (SELECT doc_id, count(*) AS n_items, string_agg(CAST(item_id AS VARCHAR), ',' ORDER BY CAST(item_id AS VARCHAR)) AS s FROM (SELECT DISTINCT doc_id, item_id FROM h) GROUP BY doc_id)
SELECT d.doc_id, CAST(len(d.w) AS BIGINT) AS n_words, CAST(coalesce(hit.n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(it.n_items, 0) AS BIGINT) AS n_items,
       sha256(coalesce(it.s, '')) AS items_sha256, coalesce(hit.n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN hit ON d.doc_id IS NOT DISTINCT FROM hit.doc_id LEFT JOIN it ON d.doc_id IS NOT DISTINCT FROM it.doc_id
"""


def op5_decontamination(documents: DataFrame, benchmark: DataFrame) -> DataFrame:
    return decontaminate(documents, benchmark)
