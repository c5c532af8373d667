"""Image headers made by bytes: every format, both byte orders, cut and hostile files, and what is written is read back."""

import struct
import zlib
from datetime import datetime

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tessera.sources import headers


def segment(marker, body):
    return bytes([0xFF, marker]) + struct.pack(">H", len(body) + 2) + body


def jpeg(w, h, *more, sof=0xC0):
    return b"\xff\xd8" + segment(0xE0, b"JFIF\0" + b"\0" * 9) + b"".join(more) + segment(0xDB, b"\0" * 65) + segment(sof, b"\x08" + struct.pack(">HH", h, w) + b"\x03" + b"\0" * 9) + b"\xff\xda\0\x0c" + b"data" * 9 + b"\xff\xd9"


def chunk(name, body):
    return struct.pack(">I", len(body)) + name + body + struct.pack(">I", zlib.crc32(name + body))


def png(w, h, *more):
    return headers.PNG + chunk(b"IHDR", struct.pack(">II", w, h) + b"\x08\x06\0\0\0") + b"".join(more) + chunk(b"IDAT", b"x" * 30) + chunk(b"IEND", b"")


def riff(*parts):
    body = b"WEBP" + b"".join(n + struct.pack("<I", len(v)) + v + b"\0" * (len(v) % 2) for n, v in parts)
    return b"RIFF" + struct.pack("<I", len(body)) + body


def vp8(w, h):
    return b"VP8 ", b"\x30\x01\0\x9d\x01\x2a" + struct.pack("<HH", w, h) + b"z" * 7


def vp8l(w, h):
    return b"VP8L", b"\x2f" + struct.pack("<I", w - 1 | (h - 1) << 14) + b"z" * 4


def vp8x(w, h):
    return b"VP8X", bytes([0, 0, 0, 0]) + (w - 1).to_bytes(3, "little") + (h - 1).to_bytes(3, "little")


def gif(w, h):
    return b"GIF89a" + struct.pack("<HH", w, h) + b"\0" * 20


def tiff(order, main, exif=(), gps=()):
    """A block in either byte order: directories one after the other, long values at the end."""
    out = {"<": b"II*\0", ">": b"MM\0*"}[order] + struct.pack(order + "I", 8)
    tables = [list(main), list(exif), list(gps)]
    at = [8, 0, 0]
    tables[0] += [(headers.EXIF, 4, 1, None, 1)] * bool(exif) + [(headers.GPS, 4, 1, None, 2)] * bool(gps)
    sizes = [2 + 12 * len(t) + 4 for t in tables]
    at[1], at[2] = 8 + sizes[0], 8 + sizes[0] + sizes[1]
    tail_at, tail = at[2] + sizes[2], b""
    for t in tables:
        out += struct.pack(order + "H", len(t))
        for tag, kind, n, raw, *to in t:
            raw = struct.pack(order + "I", at[to[0]]) if to else raw
            value = raw.ljust(4, b"\0") if len(raw) <= 4 else struct.pack(order + "I", tail_at + len(tail))
            tail += raw if len(raw) > 4 else b""
            out += struct.pack(order + "HHI", tag, kind, n) + value
        out += b"\0\0\0\0"
    return out + tail


def camera(order):
    text = lambda tag, s: (tag, 2, len(s) + 1, s.encode() + b"\0")
    ratios = lambda *v: struct.pack(order + f"{len(v)}I", *v)
    gps = [text(1, "S"), (2, 5, 3, ratios(33, 1, 30, 1, 3600, 100)), text(3, "E"), (4, 5, 3, ratios(151, 1, 12, 1, 0, 1)), (6, 5, 1, ratios(255, 2))]
    return tiff(order, [text(headers.MAKE, "Maker"), text(headers.MODEL, "Model X1")], [text(headers.TAKEN, "2021:07:09 18:30:05")], gps)


FOUND = {"make": "Maker", "model": "Model X1", "taken": "2021-07-09 18:30:05", "year": 2021, "month": 7, "day": 9, "hour": 18, "altitude": 127.5, "latitude": -(33.5 + 0.01), "longitude": 151.2}


@pytest.mark.parametrize("data,kind", [(jpeg(640, 480), "jpeg"), (jpeg(640, 480, sof=0xC2), "jpeg"), (png(640, 480), "png"), (gif(640, 480), "gif"), (riff(vp8(640, 480)), "webp"), (riff(vp8l(640, 480)), "webp"), (riff(vp8x(640, 480), vp8(9, 9)), "webp")])
def test_sizes(data, kind):
    own = headers.read(data)
    assert (own["format"], own["width"], own["height"]) == (kind, 640, 480)
    assert headers.read(data[:8191]) == own
    for n in range(len(data)):
        cut = headers.read(data[:n])
        assert (cut["width"], cut["height"]) in ((640, 480), (None, None))


@pytest.mark.parametrize("order", "<>")
def test_exif_fields(order):
    block = camera(order)
    for data in (jpeg(64, 48, segment(0xE1, b"http://ns.adobe.com/xap/1.0/\0"), segment(0xE1, b"Exif\0\0" + block)), png(64, 48, chunk(b"eXIf", block)), riff(vp8x(64, 48), vp8(64, 48), (b"EXIF", block)), riff(vp8x(64, 48), (b"EXIF", b"Exif\0\0" + block))):
        own = headers.read(data)
        assert (own["width"], own["height"]) == (64, 48)
        assert {k: own[k] for k in FOUND} == pytest.approx(FOUND)
    own = headers.read(tiff(order, [(headers.WIDTH, 3, 1, struct.pack(order + "H", 70)), (headers.HEIGHT, 4, 1, struct.pack(order + "I", 50))]))
    assert (own["format"], own["width"], own["height"]) == ("tiff", 70, 50)


def test_hostile_files():
    """Offsets beyond the file, directories that point at themselves, counts of four thousand million, zero denominators."""
    text = (headers.MAKE, 2, 2**32 - 1, b"\xff\xff\xff\xff")
    block = b"II*\0" + struct.pack("<I", 8) + struct.pack("<H", 65_535) + struct.pack("<HHI", *text[:3]) + text[3] + struct.pack("<HHII", headers.EXIF, 4, 1, 8) + struct.pack("<HHII", headers.GPS, 4, 1, 2**32 - 1)
    assert headers.exif(block)["make"] is None
    ratios = struct.pack("<6I", 10, 0, 0, 1, 0, 1)
    zero = tiff("<", [], [], [(1, 2, 2, b"N\0"), (2, 5, 3, ratios), (3, 2, 2, b"E\0"), (4, 5, 3, ratios)])
    assert "latitude" not in headers.exif(zero) and headers.exif(zero)["altitude"] is None
    assert headers.read(png(0, 5))["width"] is None and headers.read(png(2**31, 5))["width"] is None
    assert headers.read(b"\xff\xd8\xff" + b"\xff" * 1000)["width"] is None and headers.read(b"\xff\xd8\xff\xe0\0\0" + b"x" * 50)["width"] is None
    for data in (None, b"", b"x", b"\0" * 100, b"\0\0\0\x18ftypisom"):
        assert headers.read(data)["width"] is None
    for when in ("2021:13:45 00:00:00", "not a date at all !", "0000:00:00 00:00:00"):
        assert "year" not in headers.exif(tiff("<", [], [(headers.TAKEN, 2, 20, when.encode() + b"\0")]))


WHOLE = [jpeg(64, 48, segment(0xE1, b"Exif\0\0" + camera("<"))), png(64, 48, chunk(b"eXIf", camera(">"))), riff(vp8x(64, 48), vp8(64, 48), (b"EXIF", camera("<")))]


@settings(max_examples=400, deadline=None)
@given(st.sampled_from(WHOLE), st.lists(st.tuples(st.integers(0, 400), st.integers(0, 255)), max_size=12), st.integers(0, 400))
def test_changed_bytes_never_fail(data, changes, cut):
    own = bytearray(data)
    for at, value in changes:
        own[at % len(own)] = value
    for version in (bytes(own), bytes(own[:cut])):
        found = headers.read(version)
        assert set(found) <= set(headers.NAMES)
        again = headers.with_exif(version, headers.exif_block("d", None, None, None, None))
        assert again is None or headers.kind_of(again) == headers.kind_of(version)


@settings(max_examples=150, deadline=None)
@given(st.sampled_from([*WHOLE, jpeg(64, 48), png(64, 48), riff(vp8l(64, 48))]), st.text(min_size=1, max_size=300).filter(lambda s: s.strip() == s and "\0" not in s and not any(0xD800 <= ord(c) < 0xE000 for c in s)), st.datetimes(datetime(1900, 1, 1), datetime(2100, 1, 1)), st.floats(-90, 90), st.floats(-180, 180))
def test_what_is_written_is_read_back(data, word, taken, lat, lng):
    """In place of the block that was there; the image's own bytes stay."""
    out = headers.with_exif(data, headers.exif_block(word, word[::-1].strip() or None, taken, lat, lng))
    own = headers.read(out)
    assert (own["width"], own["height"], own["description"], own["make"]) == (64, 48, word, None)
    assert own["taken"] == taken.strftime("%Y-%m-%d %H:%M:%S") and abs(own["latitude"] - lat) < 1e-9 and abs(own["longitude"] - lng) < 1e-9
    assert out.count(b"Exif\0\0") <= 1 and (b"datadata" in out or b"x" * 30 in out or b"z" * 4 in out)
    if out[:4] == b"RIFF":
        assert struct.unpack_from("<I", out, 4)[0] == len(out) - 8 and out[20] & 8


def test_columns(spark):
    rows = [(1, jpeg(64, 48, segment(0xE1, b"Exif\0\0" + camera("<")))), (2, None), (3, b"nothing"), (4, png(5, 6)), (5, riff(vp8(7, 8)))]
    df = spark.createDataFrame(rows, "id int, data binary").repartition(2)
    got = {r.id: r.f for r in df.select("id", headers.fields(F.col("data")).alias("f")).collect()}
    assert (got[1].width, got[1].model, got[1].year) == (64, "Model X1", 2021) and got[2].format is None and got[3].format is None and (got[4].width, got[4].taken, got[5].height) == (5, None, 8)
    out = df.withColumn("data", headers.written(F.col("data"), F.lit("Über"), F.when(F.col("id") > 1, "A"), F.lit("2020-02-03 04:05:06").cast("timestamp"), F.lit(None), F.lit(1.0)))
    back = {r.id: r.f for r in out.select("id", headers.fields(F.col("data")).alias("f")).collect()}
    assert (back[1].description, back[1].artist, back[1].taken, back[1].latitude, back[1].width) == ("Über", None, "2020-02-03 04:05:06", None, 64)
    assert back[4].artist == "A" and back[5].hour == 4 and back[2].format is None and {r.id: r.data for r in out.collect()}[3] == b"nothing"
