"""SimHash near-duplicates: 64-bit fingerprints linked at a Hamming distance of two or less, by anchor-point covering.

Anchors.  The anchors are the codewords of the perfect Hamming code [63, 57] on the low 63 bits, with the top bit free:
2^58 points whose balls of radius 1 cover all 2^64 fingerprints, so the covering radius is 1.

Replication.  A fingerprint is sent to the anchors around it.  Two fingerprints x and y at distance <= 2 have a point m
with d(x, m) <= 1 and d(y, m) <= 1, and m lies in the ball of exactly one anchor; so x and y meet at that anchor if each
goes to the anchor of every point within 1 of it.  That is within the covering radius plus half of the threshold: at
most 33 anchors a fingerprint, where covering radius plus whole threshold would take over 600 and find nothing more.

Comparison.  The fingerprints at one anchor differ from it in at most two of 63 bits and in the free bit, so an anchor
never holds more than 4,034 different ones, however many documents there are.  They are compared with each other there;
what is emitted is a star for each group linked within the anchor, not its pairs.  Documents with equal fingerprints are
one row before all of this, so groups of exact copies cost nothing.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import kernel
from .components import components
from .shared import columns_free_of, map_arrow, mark, name_of, renamed, split_off, stored, stream_arrow, sweep, text_digest

SHINGLE = 3
DISTANCE = 2
SEED = 42


def _shingle_spans(piece: kernel.Slice) -> tuple[bytes, np.ndarray, np.ndarray, np.ndarray]:
    """The words of the slice joined by single spaces, and each shingle's first byte, end byte and row."""
    low = kernel.LOWER[piece.data]
    start, end = kernel.runs(kernel.NOT_SPACE[low], piece.offsets)
    row = np.searchsorted(piece.offsets[1:], start, side="right")
    n = len(low)
    keep = kernel.NOT_SPACE[low]
    gap = end[(end < n) & ~keep[np.minimum(end, max(n - 1, 0))]] if n else end
    keep[gap] = True
    low[gap] = 32
    place = np.cumsum(keep) - 1
    first, last = place[start] if n else start, (place[end - 1] + 1) if n else end
    counts = np.bincount(row, minlength=piece.rows)
    begin = np.cumsum(counts) - counts
    take = np.where(counts == 0, 0, np.maximum(counts - SHINGLE + 1, 1))
    which = np.repeat(np.arange(piece.rows), take)
    i = np.arange(take.sum()) - np.repeat(np.cumsum(take) - take, take) + begin[which]
    j = np.minimum(i + SHINGLE - 1, begin[which] + counts[which] - 1)
    return low[keep].tobytes(), first[i], last[j], which


def fingerprints(piece: kernel.Slice) -> np.ndarray:
    """The fingerprint of each row as an unsigned number; without words it is zero."""
    text, a, b, row = _shingle_spans(piece)
    digest = xxhash.xxh64_digest
    raw = b"".join([digest(text[s:e], SEED) for s, e in zip(a.tolist(), b.tolist(), strict=True)])
    out = np.zeros(piece.rows, np.uint64)
    if not raw:
        return out
    count = np.bincount(row, minlength=piece.rows)
    full = np.flatnonzero(count)
    bits = np.unpackbits(np.frombuffer(raw, np.uint8).reshape(-1, 8), axis=1)
    ones = np.add.reduceat(bits, (np.cumsum(count) - count)[full], axis=0, dtype=np.int64)
    out[full] = np.packbits(ones * 2 > count[full][:, None], axis=1).view(">u8").ravel().astype(np.uint64)
    return out


_POINTS = np.uint64(1) << np.arange(64, dtype=np.uint64)
_PLACE = np.arange(1, 64, dtype=np.uint64)  # the check column of bit i is the number i + 1
_CHECKS = [np.bitwise_or.reduce(_POINTS[:63][(_PLACE >> np.uint64(k)) & np.uint64(1) == 1]) for k in range(6)]


def _nearest(points: np.ndarray) -> np.ndarray:
    """The anchor in whose ball each point lies: flip the bit the Hamming syndrome names."""
    syndrome = np.zeros(points.shape, np.uint64)
    for k, mask in enumerate(_CHECKS):
        syndrome |= (np.bitwise_count(points & mask) & 1).astype(np.uint64) << np.uint64(k)
    flip = np.where(syndrome > 0, np.uint64(1) << (np.maximum(syndrome, np.uint64(1)) - np.uint64(1)), np.uint64(0))
    return points ^ flip


def _flips(reach: int) -> np.ndarray:
    """All patterns of at most ``reach`` set bits."""
    return np.array([sum(1 << b for b in bits) for n in range(reach + 1) for bits in combinations(range(64), n)], np.uint64)


def anchors(fp: np.ndarray, reach: int = DISTANCE // 2) -> tuple[np.ndarray, np.ndarray]:
    """(index of the fingerprint, anchor) for every anchor a fingerprint is sent to: those of all points within ``reach`` of
    it, which are the anchors within the covering radius plus ``reach``."""
    around = fp[:, None] ^ _flips(reach)[None, :]
    found = np.sort(_nearest(around), axis=1)
    new = np.ones(found.shape, dtype=bool)
    new[:, 1:] = found[:, 1:] != found[:, :-1]
    return np.nonzero(new)[0], found[new]


def _stars(fp: np.ndarray) -> tuple[list[np.ndarray], list[np.ndarray]]:
    """Links among the fingerprints of one anchor: each to the first of its group there."""
    label = np.arange(len(fp))
    near = [np.flatnonzero(np.bitwise_count(fp ^ x) <= DISTANCE) for x in fp]
    moving = True
    while moving:
        lowest = np.array([label[x].min() for x in near])
        moving = bool((lowest < label).any())
        label = lowest
    away = np.flatnonzero(label != np.arange(len(fp)))
    return [fp[away]], [fp[label[away]]]


def links(fps: DataFrame, reach: int = DISTANCE // 2) -> DataFrame:
    """(a, b) between different fingerprints: enough links to connect all those at distance <= 2.

    fps: one column ``fp`` (long), each value once.  reach: how far beyond the covering radius a fingerprint is sent; half
    of the threshold finds every link, and the whole of it finds the same ones at some sixty times the copies.
    """
    step = 4096 if reach < 2 else 64

    def send(batch: pa.RecordBatch):
        values = batch.column(0).to_numpy().view(np.uint64)
        for lo in range(0, len(values), step):
            part = values[lo : lo + step]
            which, anchor = anchors(part, reach)
            yield pa.RecordBatch.from_arrays([pa.array(anchor.view(np.int64)), pa.array(part[which].view(np.int64))], ["anchor", "fp"])

    def compare(batches):
        rest_a, rest_f = np.empty(0, np.int64), np.empty(0, np.int64)

        def linked(anchor, fp):
            fp = fp.view(np.uint64)
            cut = np.flatnonzero(np.concatenate(([True], anchor[1:] != anchor[:-1], [True]))) if len(anchor) else np.zeros(1, np.int64)
            size = np.diff(cut)
            two = cut[:-1][size == 2]
            close = two[np.bitwise_count(fp[two] ^ fp[two + 1]) <= DISTANCE]
            left, right = [fp[close]], [fp[close + 1]]
            for s in np.flatnonzero(size > 2):
                a, b = _stars(fp[cut[s] : cut[s + 1]])
                left += a
                right += b
            a, b = np.concatenate(left), np.concatenate(right)
            pair = np.unique(np.stack([np.minimum(a, b), np.maximum(a, b)], axis=1), axis=0)
            return pa.RecordBatch.from_arrays([pa.array(np.ascontiguousarray(pair[:, 0]).view(np.int64)), pa.array(np.ascontiguousarray(pair[:, 1]).view(np.int64))], ["a", "b"])

        for batch in batches:
            a = np.concatenate([rest_a, batch.column(0).to_numpy()])
            f = np.concatenate([rest_f, batch.column(1).to_numpy()])
            if not len(a):
                continue
            done = int(np.searchsorted(a, a[-1], side="left"))  # sorted: the last anchor may go on in the next batch
            yield linked(a[:done], f[:done])
            rest_a, rest_f = a[done:], f[done:]
        yield linked(rest_a, rest_f)

    sent = map_arrow(fps.select("fp"), send, "anchor long, fp long")
    return stream_arrow(sent.repartition("anchor").sortWithinPartitions("anchor"), compare, "a long, b long").distinct()


def fingerprint(documents: DataFrame, text: str = "text") -> DataFrame:
    """documents with ``fp`` (long, the fingerprint's bits)."""
    frame = columns_free_of(documents, "fp")
    names, at = frame.columns, frame.columns.index(text)

    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        fp = np.concatenate([fingerprints(p) for p in kernel.slices(batch.column(at))])
        keep = [i for i in range(len(names)) if i != at]
        return pa.RecordBatch.from_arrays([*(batch.column(i) for i in keep), pa.array(fp.view(np.int64))], [*(names[i] for i in keep), "fp"])

    return map_arrow(frame, work, frame.drop(text).select("*", F.lit(0).cast("long").alias("fp")).schema)


def _groups(documents: DataFrame, key: str, text: str) -> tuple[DataFrame, DataFrame]:
    """(key, fp) of every document, and (fp, component_id) of every different fingerprint; both stored, and nothing else."""
    spark, since = documents.sparkSession, mark()
    rows = stored(fingerprint(documents.select(key, text), text), "fingerprints")
    each = stored(rows.groupBy("fp").agg(F.min(key).alias("first")), "distinct-fingerprints")
    root = components(links(each.select("fp"))).withColumnRenamed("node", "fp")
    joined = stored(each.join(root, "fp"), "rooted")
    lowest = joined.groupBy("root").agg(F.min("first").alias("lowest"))
    linked = joined.join(lowest, "root").select("fp", "lowest")
    groups = stored(each.join(linked, "fp", "left").select("fp", F.coalesce("lowest", "first").alias("component_id")), "groups")
    sweep(spark, since, rows, groups)
    return rows, groups


def near_duplicates(documents: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, fingerprint, component_id) for every document; component_id is the smallest key reachable over links.

    Null, empty and blank texts have fingerprint zero and are linked like any other.  Texts are taken whole, whatever
    their length.  Repeated rows and exact copies share a fingerprint and so a component.  A null key is kept; it links
    other rows but is never a component_id while a component has another key.  Empty table: empty result.  Other
    columns play no part.
    """
    rows, group = _groups(documents, key, text)
    return rows.join(group, "fp").select(key, F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def first_of_each_group(documents: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """The documents that stay: of each component the one with the smallest key (repeated rows of it once).

    A document is its key and the digest of its text, so unrelated texts under one key stay or go each by its own
    component; of texts of one component under its smallest key the one with the smallest digest stays.  Rows without a
    key stay, since no key names them as the copy of another.

    What stays is decided on names of 16 bytes; the texts are then read once more and filtered by the names of those that
    go.  Only rows that are repeated, key and text, meet in a shuffle, after partial aggregation.
    """
    spark, since = documents.sparkSession, mark()
    rows, new = renamed(documents)
    who, digest = F.col(new[key]), text_digest(F.col(new[text]))
    named = rows.withColumn("__name", F.when(who.isNotNull(), name_of(who, digest)))
    small = rows.where(who.isNotNull()).withColumn("__mark", F.struct(who.alias("key"), digest.alias("digest")))
    all_, group = _groups(small, "__mark", new[text])
    name = name_of(F.col("m.key"), F.col("m.digest")).alias("__name")
    stay = group.select(F.col("component_id").alias("m")).distinct().select(name)
    times = stored(all_.select(F.col("__mark").alias("m")).select(name).groupBy("__name").agg(F.count("*").alias("n")), "names")
    apart = stored(times.join(stay.withColumn("stays", F.lit(True)), "__name", "left").where("stays is null or n > 1"), "names-apart")
    once = split_off(named.where(F.col("__name").isNotNull()), apart.select("__name"), "left_anti").select(*new.values())
    out = once.unionAll(rows.where(who.isNull()))
    again = apart.where("stays").select("__name")
    if not again.isEmpty():
        out = out.unionAll(split_off(named, again, "left_semi").dropDuplicates(["__name"]).select(*new.values()))
    sweep(spark, since, apart)
    return out.toDF(*documents.columns)
