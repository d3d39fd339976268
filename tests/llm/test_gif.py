import hashlib
import struct
import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from ranksmith.llm import gif

from .helpers import empty, odd


@settings(max_examples=60, deadline=None)
@given(st.binary(max_size=3000), st.integers(1, 5))
def test_lzw_round_trip(data, times):
    data = data * times
    assert gif.lzw_decode(gif.lzw_encode(data), 8, len(data)).tobytes() == data


@pytest.mark.parametrize("data", [b"", b"a", b"a" * 100_000, bytes(range(256)) * 300, np.random.default_rng(0).integers(0, 256, 60_000, dtype=np.uint8).tobytes()])
def test_lzw_full_tables(data):
    assert gif.lzw_decode(gif.lzw_encode(data), 8, len(data)).tobytes() == data


def plain_lzw_decode(stream, bits, pixels):
    """A code-by-code decoder after the format's description, with deferred clear."""
    clear, end = 1 << bits, (1 << bits) + 1
    table, width, out, last, at = [bytes([i]) for i in range(clear)] + [b"", b""], bits + 1, b"", None, 0
    while len(out) < pixels:
        code = int.from_bytes(stream[at // 8 : at // 8 + 4], "little") >> at % 8 & (1 << width) - 1
        at += width
        if code == clear:
            table, width, last = table[: end + 1], bits + 1, None
            continue
        if code == end:
            break
        word = table[code] if code < len(table) else last + last[:1]
        if last is not None and len(table) < 4096:
            table.append(last + word[:1])
        if len(table) == 1 << width and width < 12:
            width += 1
        out, last = out + word, word
    return out[:pixels]


@pytest.mark.parametrize("bits", [2, 4, 8])
def test_decoder_and_encoder_against_a_plain_decoder(bits):
    rng = np.random.default_rng(bits)
    for n in (1, 5, 300, 20_000):
        data = rng.integers(0, min(1 << bits, 5), n, dtype=np.uint8).tobytes()
        stream = gif.lzw_encode(data, bits)
        assert plain_lzw_decode(stream, bits, n) == data == gif.lzw_decode(stream, bits, n).tobytes()


def test_deferred_clear():
    """A stream that keeps its full table: 12-bit codes go on without a clear."""
    rng = np.random.default_rng(9)
    data = rng.integers(0, 4, 60_000, dtype=np.uint8).tobytes()
    bits, clear = 2, 4
    table, codes, now = {bytes([i]): i for i in range(4)}, [(clear, 3)], b""
    free, width, read = 6, 3, 0
    for p in data:
        if now + bytes([p]) in table:
            now += bytes([p])
            continue
        codes.append((table[now], width))
        if read and free_seen < 4096:
            free_seen += 1
        elif not read:
            free_seen = 6
        read = 1
        if free_seen == 1 << width and width < 12:
            width += 1
        if free < 4096:
            table[now + bytes([p])] = free
            free += 1
        now = bytes([p])
    codes.append((table[now], width))
    value = place = 0
    for c, w in codes:
        value |= c << place
        place += w
    stream = value.to_bytes(place // 8 + 1, "little")
    assert plain_lzw_decode(stream, bits, len(data)) == data
    assert gif.lzw_decode(stream, bits, len(data)).tobytes() == data


def frame(pixels, left=0, top=0, disposal=0, clear=None, delay=7, interlaced=False, palette=None):
    h, w = pixels.shape
    flags = (0x40 if interlaced else 0) | (0x81 if palette else 0)
    out = b"\x21\xf9\x04" + bytes([disposal << 2 | (clear is not None)]) + struct.pack("<H", delay) + bytes([clear or 0]) + b"\0"
    if interlaced:
        order = [y for a, s in ((0, 8), (4, 8), (2, 4), (1, 2)) for y in range(a, h, s)]
        pixels = pixels[order]
    return out + b"\x2c" + struct.pack("<HHHHB", left, top, w, h, flags) + (palette or b"") + b"\x02" + gif._sub_blocks(gif.lzw_encode(pixels.astype(np.uint8).tobytes(), 2))


def animation(*frames, size=(6, 10)):
    table = bytes([0, 0, 0, 255, 0, 0, 0, 255, 0, 0, 0, 255])
    loop = b"\x21\xff\x0bNETSCAPE2.0\x03\x01\x05\x00\x00"
    return b"GIF89a" + struct.pack("<HHBBB", size[0], size[1], 0x81, 3, 0) + table + loop + b"".join(frames) + b"\x3b"


def test_palettes_disposal_transparency_interlace():
    base = np.ones((10, 6), int)
    spot = np.array([[2, 0], [0, 2]])
    own = bytes([9, 9, 9, 8, 8, 8, 7, 7, 7, 6, 6, 6])
    g = gif.decode(animation(frame(base), frame(spot, 1, 1, disposal=2, clear=0), frame(spot, 3, 3, disposal=3, clear=0), frame(spot, 0, 0, palette=own), frame(np.arange(60).reshape(10, 6) % 4, interlaced=True)))
    a, b, c, d, e = g.composed()
    red, green, blue = [255, 0, 0], [0, 255, 0], [0, 0, 255]
    assert g.loops == 5 and [f.delay for f in g.frames] == [7] * 5
    assert (a == red).all()
    assert b[1, 1].tolist() == green and b[1, 2].tolist() == red  # transparent pixels keep what is below
    assert c[1, 1].tolist() == c[1, 2].tolist() == blue and c[3, 3].tolist() == green  # method 2 restores the background
    assert d[3, 3].tolist() == red and d[0, 0].tolist() == [7, 7, 7]  # method 3 restores what was there
    assert (g.frames[4].indices == np.arange(60).reshape(10, 6) % 4).all()


def test_contract(spark, small):
    docs = spark.read.parquet(f"{small}/documents.parquet")
    got = {r["doc_id"]: r for r in gif.media_columns(docs, keep_media=True).collect()}
    for r in docs.collect():
        raw = (r["text"] or "").encode()
        n = max(576, -(-len(raw) // 576) * 576)
        payload = raw + b"\xff" * (n - len(raw))
        g = got[r["doc_id"]]
        assert (g["n_bytes"], g["payload_bytes"], g["payload_sha256"], g["tail_crc32"]) == (len(raw), n, hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-32:]))
        assert g["media_bytes"] == len(g["media"]) and g["media_sha256"] == hashlib.sha256(g["media"]).hexdigest()
        counts = np.bincount(np.frombuffer(payload, np.uint8) // 32, minlength=8)
        assert g["feature"] == ",".join(map(str, counts))
        stored = gif.decode(g["media"])
        assert b"".join(s[: f.indices.shape[0], :, 0].tobytes() for s, f in zip(stored.composed(), stored.frames)) == payload


def test_odd_rows(spark):
    got = gif.op9_gif(odd(spark, ["media_bytes", "feature"])).collect()
    assert len(got) == 12 and {r["payload_bytes"] for r in got if r["doc_id"] in (2, 3)} == {576}
    assert len({tuple(r)[1:] for r in got if r["doc_id"] in (5, 10)}) == 1
    assert gif.op9_gif(empty(spark)).count() == 0
    with pytest.raises(ValueError):
        gif.decode(b"PNG")


def test_what_is_read_back_is_the_composed_screen(spark, small):
    """A frame's box as shown, not its indices: transparent pixels show what is below, and so count in the histograms."""
    base, spot = np.ones((10, 6), int), np.array([[2, 0], [0, 2]])
    g = gif.decode(animation(frame(base), frame(spot, 1, 1, disposal=2, clear=0)))
    whole, box = gif.shown(g)
    assert whole.shape == (10, 6, 3) and box.tolist() == [[[0, 255, 0], [255, 0, 0]], [[255, 0, 0], [0, 255, 0]]]
    assert gif.histograms(box) == [[2, 0, 0, 0, 0, 0, 0, 2], [2, 0, 0, 0, 0, 0, 0, 2], [4, 0, 0, 0, 0, 0, 0, 0]]
    for r in gif.media_columns(spark.read.parquet(f"{small}/documents.parquet"), keep_media=True).limit(20).collect():
        again = gif.decode(bytes(r["media"]))
        assert [(f["delay_cs"], [f["red"], f["green"], f["blue"]]) for f in r["frames"]] == [(f.delay, gif.histograms(b)) for f, b in zip(again.frames, gif.shown(again), strict=True)]
