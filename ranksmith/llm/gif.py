"""GIF as a media column: an encoder, a decoder, and features of the decoded frames.

The decoder reads GIF87a and GIF89a: global and local palettes, LZW code streams of 2 to 12 bits with deferred clear,
interlacing, transparency, the four disposal methods and frame delays.  Frames are kept as palette indices and, for
features, composed to RGB on the logical screen.

LZW without a loop over pixels.  Between two clear codes the width of every code follows from its number alone, so the
codes are cut from the bit stream at once.  Code c above the clear and end codes stands for the output of one earlier
code and the pixel after it: a copy from an earlier place.  Lengths are resolved code by code, pixels by doubling steps
over all at once.

Payload columns: bytes are stored as samples of frames 96 pixels wide with a 256-grey palette, at most 96 rows a frame,
so that index and grey value are the byte itself and reading back is exact.  What is read back is the screen as composed
for each frame, cut to the frame's box.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import kernel
from .shared import map_arrow

UNIT = 576
WIDTH = 96
HEIGHT = 96
DELAY = 4  # hundredths of a second
BINS = 8
TAIL = 32
_GREY = bytes(v for v in range(256) for _ in range(3))


_WIDTHS: dict[int, np.ndarray] = {}


def _width_table(bits: int) -> np.ndarray:
    """Widths of the codes after a clear, as many as the largest table allows before it is full, and then 12."""
    if bits not in _WIDTHS:
        first, n = (1 << bits) + 2, 4097
        out, width, free = np.empty(n, np.int64), bits + 1, first
        for i in range(n):
            out[i] = width
            if i:  # the code just read completes an entry
                free = min(free + 1, 4096)
            if free == 1 << width and width < 12:
                width += 1
        _WIDTHS[bits] = out
    return _WIDTHS[bits]


def lzw_encode(pixels: bytes, bits: int = 8) -> bytes:
    """The LZW code stream of the pixels; the table is cleared when it is full."""
    clear, end = 1 << bits, (1 << bits) + 1
    codes, runs = [clear], []
    table: dict[int, int] = {}
    get, add = table.get, codes.append
    free, at = end + 1, 1
    if pixels:
        now = pixels[0]
        for p in memoryview(pixels)[1:]:
            key = now << 8 | p
            known = get(key)
            if known is not None:
                now = known
                continue
            add(now)
            if free < 4095:
                table[key] = free
                free += 1
            else:
                add(clear)
                runs.append(len(codes) - at)
                at = len(codes)
                table.clear()
                free = end + 1
            now = p
        add(now)
    add(end)
    runs.append(len(codes) - at)
    table_ = _width_table(bits)
    widths = np.concatenate([table_[:1], *[table_[:r] for r in runs]])
    values = np.array(codes, np.uint32)
    spread = (values[:, None] >> np.arange(12, dtype=np.uint32)) & 1
    return np.packbits(spread[np.arange(12) < widths[:, None]].astype(np.uint8), bitorder="little").tobytes()


def _codes(raw: np.ndarray, bit: int, widths: np.ndarray) -> np.ndarray:
    """The codes at the given bit of the stream; raw has four spare bytes at its end."""
    place = bit + np.cumsum(widths) - widths
    byte = place >> 3
    word = raw[byte].astype(np.uint32) | raw[byte + 1].astype(np.uint32) << 8 | raw[byte + 2].astype(np.uint32) << 16
    return (word >> (place & 7).astype(np.uint32)) & ((1 << widths) - 1).astype(np.uint32)


def lzw_decode(stream: bytes, bits: int, pixels: int) -> np.ndarray:
    """At most ``pixels`` palette indices; a stream that ends early leaves the rest zero."""
    clear, end = 1 << bits, (1 << bits) + 1
    raw = np.frombuffer(stream + b"\0\0\0\0", np.uint8)
    total, bit, filled = len(stream) * 8, 0, 0
    out = np.zeros(pixels, np.uint8)
    table = _width_table(bits)
    ends = np.cumsum(table)
    while filled < pixels and bit < total:
        n = int(np.searchsorted(ends, total - bit, side="right"))
        if n == 0:
            break
        widths = table[:n] if n < len(table) else np.concatenate([table, np.full((total - bit - int(ends[-1])) // 12, 12)])
        codes = _codes(raw, bit, widths)
        stop = np.flatnonzero((codes == clear) | (codes == end))
        k = int(stop[0]) if len(stop) else len(codes)
        bit += int(widths[: k + 1].sum())
        if k:
            got = _expand(codes[:k].astype(np.int64), clear, pixels - filled)
            out[filled : filled + len(got)] = got
            filled += len(got)
        if not len(stop) or codes[k] == end:
            break
    return out


def _expand(codes: np.ndarray, clear: int, most: int) -> np.ndarray:
    """Pixels of the codes between two clears."""
    first = clear + 2
    length = np.ones(len(codes), np.int64)
    back = np.flatnonzero(codes >= first)
    if len(back):
        lengths = [1] * len(codes)
        for i, c in zip(back.tolist(), (codes[back] - first).tolist(), strict=True):
            if c >= i:
                raise ValueError("a code beyond the table")
            lengths[i] = lengths[c] + 1
        length = np.array(lengths, np.int64)
    start = np.cumsum(length) - length
    n = int(start[-1] + length[-1])
    source = np.arange(n)
    value = np.zeros(n, np.uint8)
    lone = codes < clear
    value[start[lone]] = codes[lone]
    if len(back):
        size = length[back]
        shift = np.repeat(start[back] - start[codes[back] - first], size)
        inside = np.repeat(start[back], size) + np.arange(int(size.sum())) - np.repeat(np.cumsum(size) - size, size)
        source[inside] = inside - shift
        while True:
            further = source[source]
            if np.array_equal(further, source):
                break
            source = further
    return value[source][:most]


def _blocks(data: bytes, at: int) -> tuple[bytes, int]:
    parts = []
    while at < len(data) and data[at]:
        parts.append(data[at + 1 : at + 1 + data[at]])
        at += 1 + data[at]
    return b"".join(parts), at + 1


@dataclass
class Frame:
    left: int
    top: int
    indices: np.ndarray  # rows x columns, in display order
    palette: np.ndarray  # n x 3
    delay: int = 0
    disposal: int = 0
    transparent: int | None = None


@dataclass
class Gif:
    width: int
    height: int
    background: np.ndarray
    frames: list[Frame]
    loops: int | None = None

    def composed(self) -> Iterator[np.ndarray]:
        """The screen (height x width x 3) as each frame is shown."""
        screen = np.broadcast_to(self.background, (self.height, self.width, 3)).copy()
        for f in self.frames:
            h, w = f.indices.shape
            box = np.s_[f.top : f.top + h, f.left : f.left + w]
            before = screen.copy() if f.disposal == 3 else None
            part = screen[box]
            pick = f.indices[: part.shape[0], : part.shape[1]]
            rgb = f.palette[np.minimum(pick, len(f.palette) - 1)]
            screen[box] = rgb if f.transparent is None else np.where((pick == f.transparent)[..., None], part, rgb)
            yield screen.copy()
            if f.disposal == 2:
                screen[box] = self.background
            elif f.disposal == 3:
                screen = before


def _palette(data: bytes, at: int, flags: int) -> tuple[np.ndarray, int]:
    n = 2 << (flags & 7)
    return np.frombuffer(data[at : at + 3 * n], np.uint8).reshape(-1, 3), at + 3 * n


def decode(data: bytes) -> Gif:
    if data[:6] not in (b"GIF87a", b"GIF89a"):
        raise ValueError("not a GIF")
    width, height, flags, back, _ = struct.unpack("<HHBBB", data[6:13])
    at, shared = 13, np.array([[0, 0, 0], [255, 255, 255]], np.uint8)
    if flags & 0x80:
        shared, at = _palette(data, at, flags)
    gif = Gif(width, height, shared[min(back, len(shared) - 1)], [])
    delay, disposal, clear = 0, 0, None
    while at < len(data):
        kind, at = data[at], at + 1
        if kind == 0x21:
            label = data[at]
            block, at = _blocks(data, at + 1)
            if label == 0xF9 and len(block) >= 4:
                delay, disposal, clear = block[1] | block[2] << 8, block[0] >> 2 & 7, block[3] if block[0] & 1 else None
            elif label == 0xFF and block[:11] == b"NETSCAPE2.0" and len(block) >= 14:
                gif.loops = block[12] | block[13] << 8
        elif kind == 0x2C:
            left, top, w, h, own = struct.unpack("<HHHHB", data[at : at + 9])
            at, palette = at + 9, shared
            if own & 0x80:
                palette, at = _palette(data, at, own)
            bits = data[at]
            stream, at = _blocks(data, at + 1)
            pixels = lzw_decode(stream, bits, w * h).reshape(h, w)
            if own & 0x40:
                order = np.concatenate([np.arange(a, h, s) for a, s in ((0, 8), (4, 8), (2, 4), (1, 2))])
                shown = np.empty_like(pixels)
                shown[order] = pixels
                pixels = shown
            gif.frames.append(Frame(left, top, pixels, palette, delay, disposal, clear))
            delay, disposal, clear = 0, 0, None
        elif kind == 0x3B:
            break
        else:
            raise ValueError("an unknown block")
    return gif


def _sub_blocks(stream: bytes) -> bytes:
    return b"".join(bytes([len(part)]) + part for part in (stream[i : i + 255] for i in range(0, len(stream), 255))) + b"\0"


def encode(payload: bytes) -> bytes:
    """An animated grey GIF whose frames hold the payload row by row; its length must be a positive multiple of 576."""
    if not payload or len(payload) % UNIT:
        raise ValueError("the payload must be a positive multiple of 576 bytes")
    full = WIDTH * HEIGHT
    height = min(HEIGHT, len(payload) // WIDTH)
    out = [b"GIF89a", struct.pack("<HHBBB", WIDTH, height, 0xF7, 0, 0), _GREY]
    for i in range(0, len(payload), full):
        part = payload[i : i + full]
        out += [b"\x21\xf9\x04\x04", struct.pack("<H", DELAY), b"\0\0", b"\x2c", struct.pack("<HHHHB", 0, 0, WIDTH, len(part) // WIDTH, 0), b"\x08", _sub_blocks(lzw_encode(part))]
    return b"".join([*out, b"\x3b"])


def padded(data: bytes) -> bytes:
    return data + b"\xff" * (max(UNIT, -(-len(data) // UNIT) * UNIT) - len(data))


_SCHEMA = "n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string, n_frames int, duration_cs int, frames array<struct<delay_cs:int,red:array<int>,green:array<int>,blue:array<int>>>"
_FRAMES = pa.list_(pa.struct([("delay_cs", pa.int32()), *((c, pa.list_(pa.int32())) for c in ("red", "green", "blue"))]))


def shown(gif: Gif) -> Iterator[np.ndarray]:
    """Each frame's box of the composed screen: what a viewer sees of it, disposal and transparency applied."""
    for f, screen in zip(gif.frames, gif.composed(), strict=True):
        yield screen[f.top : f.top + f.indices.shape[0], f.left : f.left + f.indices.shape[1]]


def histograms(box: np.ndarray) -> list[list[int]]:
    """Counts of red, green and blue by eighths of the scale."""
    return [np.bincount((box[..., c] >> 5).ravel(), minlength=BINS).tolist() for c in range(3)]


def media_columns(documents: DataFrame, key: str = "doc_id", text: str = "text", keep_media: bool = False) -> DataFrame:
    """Each text stored as a GIF and read back: digests, sizes, and frames with their delays and colour histograms
    (keep_media: the GIF too).

    feature: counts of the samples by eighths of the grey scale, comma-joined (the payload's frames are grey).  null and empty texts: one unit of
    padding.  Texts of any length: as many frames as they need.  Repeated rows: each its row, with equal values for
    equal texts.  Empty table: empty result.  Other columns are dropped, so names cannot clash.
    """
    kinds = [("n_bytes", pa.int64()), ("payload_bytes", pa.int64()), ("payload_sha256", pa.string()), ("tail_crc32", pa.int64()), ("media_bytes", pa.int64()), ("media_sha256", pa.string()), ("feature", pa.string()), ("n_frames", pa.int32()), ("duration_cs", pa.int32()), ("frames", _FRAMES)]
    names, types = zip(*kinds, *([("media", pa.binary())] if keep_media else []), strict=True)

    def work(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        for p in kernel.slices(batch.column(1)):
            raw, rows = p.data.tobytes(), []
            for s, e in zip(p.offsets[:-1].tolist(), p.offsets[1:].tolist(), strict=True):
                media = encode(padded(raw[s:e]))
                gif = decode(media)
                samples, frames = [], []
                for f, box in zip(gif.frames, shown(gif), strict=True):
                    samples.append(box[..., 0].tobytes())
                    frames.append(dict(zip(("delay_cs", "red", "green", "blue"), (f.delay, *histograms(box)), strict=True)))
                back = b"".join(samples)
                counts = [sum(x) for x in zip(*(f["red"] for f in frames), strict=True)]
                row = [e - s, len(back), hashlib.sha256(back).hexdigest(), zlib.crc32(back[-TAIL:]), len(media), hashlib.sha256(media).hexdigest(), ",".join(map(str, counts)), len(frames), sum(f["delay_cs"] for f in frames), frames]
                rows.append(row + [media] if keep_media else row)
            yield pa.RecordBatch.from_arrays([batch.column(0)[p.lo : p.hi], *(pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True))], [key, *names])

    kind = documents.schema[key].dataType.simpleString()
    return map_arrow(documents.select(key, text), work, f"{key} {kind}, {_SCHEMA}" + (", media binary" if keep_media else ""))


def op9_gif(documents: DataFrame) -> DataFrame:
    """The query's columns; the frames, their delays and colour histograms as JSON."""
    return media_columns(documents).withColumn("frames", F.to_json("frames"))
