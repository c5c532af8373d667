"""Image files by their bytes: size, EXIF fields, and EXIF written into a file.

Files come as a binary column; a task takes them batch by batch. A file's first kilobytes are enough for the size and mostly for
the EXIF block. Every offset and count in a file is checked against what there is, so a cut or hostile file gives nulls.
"""

from __future__ import annotations

import math
import struct
import zlib
from collections.abc import Iterator
from datetime import datetime

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

FIELDS = "format string, width int, height int, make string, model string, description string, artist string, taken string, year int, month int, day int, hour int, altitude double, latitude double, longitude double"
NAMES = [f.split()[0] for f in FIELDS.split(", ")]
# Tags of EXIF directories, and bytes of a value of each type.
WIDTH, HEIGHT, DESCRIPTION, MAKE, MODEL, ARTIST, EXIF, GPS, TAKEN = 0x100, 0x101, 0x10E, 0x10F, 0x110, 0x13B, 0x8769, 0x8825, 0x9003
LAT_REF, LAT, LNG_REF, LNG, ALTITUDE = 1, 2, 3, 4, 6
TYPES = {1: "B", 2: "s", 3: "H", 4: "I", 5: "II", 7: "s", 9: "i", 10: "ii"}
PNG, APP1 = b"\x89PNG\r\n\x1a\n", b"Exif\0\0"


def directory(block: bytes, at: int, order: str) -> dict[int, object]:
    """The entries of a TIFF directory: text, or a tuple of numbers. What lies beyond the block is left out."""
    out: dict[int, object] = {}
    if not 0 < at <= len(block) - 2:
        return out
    count = min(struct.unpack_from(order + "H", block, at)[0], (len(block) - at - 2) // 12)
    for i in range(count):
        tag, kind, n = struct.unpack_from(order + "HHI", block, at + 2 + 12 * i)
        if kind not in TYPES:
            continue
        code = TYPES[kind]
        size = struct.calcsize("=" + code) * n
        start = at + 10 + 12 * i if size <= 4 else struct.unpack_from(order + "I", block, at + 10 + 12 * i)[0]
        if not n or start + size > len(block):
            continue
        raw = block[start : start + size]
        out.setdefault(tag, raw.split(b"\0")[0].decode("utf-8", "replace") if code == "s" else struct.unpack(order + code * n, raw))
    return out


def _ratio(values: object, i: int) -> float | None:
    """The i-th of the rational numbers."""
    if not isinstance(values, tuple) or len(values) < 2 * i + 2 or not values[2 * i + 1]:
        return None
    return values[2 * i] / values[2 * i + 1]


def _degrees(values: object, ref: object) -> float | None:
    parts = [_ratio(values, i) for i in range(3)]
    if None in parts or not isinstance(ref, str):
        return None
    value = parts[0] + parts[1] / 60 + parts[2] / 3600
    return -value if ref.upper() in ("S", "W") else value


def exif(block: bytes) -> dict[str, object]:
    """The fields of an EXIF block (a TIFF header and its directories)."""
    order = {b"II": "<", b"MM": ">"}.get(block[:2])
    if order is None or len(block) < 8 or struct.unpack_from(order + "H", block, 2)[0] != 42:
        return {}
    main = directory(block, struct.unpack_from(order + "I", block, 4)[0], order)
    below = lambda tag: directory(block, main[tag][0], order) if isinstance(main.get(tag), tuple) else {}
    more, gps = below(EXIF), below(GPS)
    text = lambda value: value.strip() or None if isinstance(value, str) else None
    out: dict[str, object] = {"make": text(main.get(MAKE)), "model": text(main.get(MODEL)), "description": text(main.get(DESCRIPTION)), "artist": text(main.get(ARTIST))}
    for name, tag in (("width", WIDTH), ("height", HEIGHT)):
        if isinstance(main.get(tag), tuple):
            out[name] = main[tag][0]
    try:
        when = datetime.strptime(more[TAKEN], "%Y:%m:%d %H:%M:%S")
        out |= {"taken": when.strftime("%Y-%m-%d %H:%M:%S") if when.year > 999 else None, "year": when.year, "month": when.month, "day": when.day, "hour": when.hour}
    except (KeyError, TypeError, ValueError):
        pass
    lat, lng = _degrees(gps.get(LAT), gps.get(LAT_REF)), _degrees(gps.get(LNG), gps.get(LNG_REF))
    out["altitude"] = _ratio(gps.get(ALTITUDE), 0)
    return out | ({"latitude": lat, "longitude": lng} if lat is not None and lng is not None else {})


def segments(data: bytes) -> Iterator[tuple[int, int, int]]:
    """Of a JPEG file the marker, start and end of each segment before the image data."""
    at = 2
    while at + 4 <= len(data) and data[at] == 0xFF:
        marker = data[at + 1]
        if marker == 0xFF:
            at += 1
            continue
        if marker in (0xD9, 0xDA):
            return
        if marker == 1 or 0xD0 <= marker <= 0xD7:
            at += 2
            continue
        size = int.from_bytes(data[at + 2 : at + 4], "big")
        if size < 2:
            return
        yield marker, at, at + 2 + size
        at += 2 + size


def chunks(data: bytes, at: int, order: str, extra: int, pad: int) -> Iterator[tuple[bytes, int, int]]:
    """Of a PNG or RIFF file the name, start and end of each chunk's data."""
    while at + 8 <= len(data):
        a, b = struct.unpack_from(order + "4s4s", data, at)
        name, size = (b, int.from_bytes(a, "big")) if extra else (a, int.from_bytes(b, "little"))
        yield name, at + 8, at + 8 + size
        at += 8 + size + extra + (size % 2 if pad else 0)


def _jpeg(data: bytes) -> dict[str, object]:
    out: dict[str, object] = {}
    for marker, start, end in segments(data):
        if 0xC0 <= marker <= 0xCF and marker not in (0xC4, 0xC8, 0xCC) and start + 9 <= len(data):
            out["height"], out["width"] = struct.unpack_from(">HH", data, start + 5)
        if marker == 0xE1 and data[start + 4 : start + 10] == APP1:
            out = exif(data[start + 10 : end]) | out
    return out


def _png(data: bytes) -> dict[str, object]:
    out: dict[str, object] = {}
    for name, start, end in chunks(data, 8, ">", 4, 0):
        if name == b"IHDR" and start + 8 <= len(data):
            out["width"], out["height"] = struct.unpack_from(">II", data, start)
        if name == b"eXIf":
            out = exif(data[start:end]) | out
    return out


def _webp(data: bytes) -> dict[str, object]:
    out: dict[str, object] = {}
    for name, start, end in chunks(data, 12, "<", 0, 1):
        head, size = data[start : min(end, start + 10)], {}
        if name == b"VP8X" and len(head) == 10:
            size = {"width": 1 + int.from_bytes(head[4:7], "little"), "height": 1 + int.from_bytes(head[7:10], "little")}
        elif name == b"VP8 " and len(head) == 10 and head[3:6] == b"\x9d\x01\x2a":
            size = {"width": int.from_bytes(head[6:8], "little") & 0x3FFF, "height": int.from_bytes(head[8:10], "little") & 0x3FFF}
        elif name == b"VP8L" and len(head) >= 5 and head[0] == 0x2F:
            bits = int.from_bytes(head[1:5], "little")
            size = {"width": 1 + (bits & 0x3FFF), "height": 1 + (bits >> 14 & 0x3FFF)}
        elif name == b"EXIF":
            block = data[start:end]
            size = exif(block.removeprefix(APP1))
        out = size | out
    return out


def kind_of(data: bytes) -> str | None:
    if data[:3] == b"\xff\xd8\xff":
        return "jpeg"
    if data[:8] == PNG:
        return "png"
    if data[:4] == b"RIFF" and data[8:12] == b"WEBP":
        return "webp"
    if data[:6] in (b"GIF87a", b"GIF89a"):
        return "gif"
    if data[:4] in (b"II*\0", b"MM\0*"):
        return "tiff"
    return "video" if data[4:8] == b"ftyp" else None


def read(data: bytes | None) -> dict[str, object]:
    """All fields of one file; a size of 0 or beyond 2^31 is none."""
    data = bytes(data or b"")
    kind = kind_of(data)
    out: dict[str, object] = {"format": kind}
    if kind == "gif" and len(data) >= 10:
        out["width"], out["height"] = struct.unpack_from("<HH", data, 6)
    elif kind in ("jpeg", "png", "webp"):
        out |= {"jpeg": _jpeg, "png": _png, "webp": _webp}[kind](data)
    elif kind == "tiff":
        out |= exif(data)
    if not (0 < (out.get("width") or 0) < 2**31 and 0 < (out.get("height") or 0) < 2**31):
        out["width"] = out["height"] = None
    return out


def fields(data: Column) -> Column:
    """A struct of FIELDS for each file of a binary column."""

    def run(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for files in batches:
            own = [read(f) for f in files]
            yield pd.DataFrame({n: pd.Series([f.get(n) for f in own], dtype=object) for n in NAMES})

    return F.pandas_udf(run, FIELDS)(data)


def _table(entries: list[tuple[int, int, int, bytes]], at: int) -> bytes:
    """A little-endian directory that starts at at, its longer values behind it."""
    head, tail = struct.pack("<H", len(entries)), b""
    behind = at + 2 + 12 * len(entries) + 4
    for tag, kind, n, raw in sorted(entries):
        value = raw.ljust(4, b"\0") if len(raw) <= 4 else struct.pack("<I", behind + len(tail))
        head += struct.pack("<HHI", tag, kind, n) + value
        if len(raw) > 4:
            tail += raw + b"\0" * (len(raw) % 2)
    return head + b"\0\0\0\0" + tail


def exif_block(description: str | None, artist: str | None, taken: datetime | None, latitude: float | None, longitude: float | None) -> bytes:
    """An EXIF block with what is given."""
    text = lambda tag, s: (tag, 2, len(s.encode()) + 1, s.encode() + b"\0")
    main = [text(tag, s) for tag, s in ((DESCRIPTION, description), (ARTIST, artist)) if s]
    below = []
    if taken is not None:
        below.append((EXIF, [text(TAKEN, taken.strftime("%Y:%m:%d %H:%M:%S"))]))
    if latitude is not None and longitude is not None and math.isfinite(latitude) and math.isfinite(longitude):
        parts = lambda v: struct.pack("<6I", int(abs(v)), 1, int(abs(v) * 60 % 60), 1, round(abs(v) * 3600 % 60 * 10**7), 10**7)
        below.append((GPS, [text(LAT_REF, "S" if latitude < 0 else "N"), (LAT, 5, 3, parts(latitude)), text(LNG_REF, "W" if longitude < 0 else "E"), (LNG, 5, 3, parts(longitude))]))
    # The main directory's length doesn't depend on where the others are.
    start = 8 + len(_table([*main, *[(tag, 4, 1, b"\0" * 4) for tag, _ in below]], 8))
    tail = b""
    for tag, entries in below:
        main.append((tag, 4, 1, struct.pack("<I", start + len(tail))))
        tail += _table(entries, start + len(tail))
    return b"II*\0" + struct.pack("<I", 8) + _table(main, 8) + tail


def with_exif(data: bytes, block: bytes) -> bytes | None:
    """A file with an EXIF block in place of those it has; null where it can't hold one."""
    kind = kind_of(data)
    if kind == "jpeg" and len(block) <= 65_527:
        old = [(a, b) for marker, a, b in segments(data) if marker == 0xE1 and data[a + 4 : a + 10] == APP1]
        rest = b"".join(data[a:b] for a, b in zip([2, *[b for _, b in old]], [*[a for a, _ in old], len(data)], strict=True))
        return data[:2] + b"\xff\xe1" + struct.pack(">H", len(block) + 8) + APP1 + block + rest
    if kind == "png":
        body = b"eXIf" + block
        whole, done = data[:8], False
        for name, start, end in chunks(data, 8, ">", 4, 0):
            if end + 4 > len(data):
                return None
            whole += b"" if name == b"eXIf" else data[start - 8 : end + 4]
            if name == b"IHDR":
                whole, done = whole + struct.pack(">I", len(block)) + body + struct.pack(">I", zlib.crc32(body)), True
        return whole if done else None
    if kind == "webp":
        size, found = read(data), [(n, data[a:b]) for n, a, b in chunks(data, 12, "<", 0, 1) if b <= len(data)]
        if size["width"] is None or not found:
            return None
        flags = next((v[0] for n, v in found if n == b"VP8X"), 0x10 * (found[0][0] == b"VP8L" and len(found[0][1]) > 4 and found[0][1][4] >> 4 & 1))
        head = bytes([flags | 8, 0, 0, 0]) + (size["width"] - 1).to_bytes(3, "little") + (size["height"] - 1).to_bytes(3, "little")
        every = [(b"VP8X", head), *[(n, v) for n, v in found if n not in (b"VP8X", b"EXIF")], (b"EXIF", block)]
        body = b"WEBP" + b"".join(n + struct.pack("<I", len(v)) + v + b"\0" * (len(v) % 2) for n, v in every)
        return b"RIFF" + struct.pack("<I", len(body)) + body
    return None


def written(data: Column, description: Column, artist: Column, taken: Column, latitude: Column, longitude: Column) -> Column:
    """Each file with these fields as its EXIF block; the file as it is where it can't hold one."""

    def run(batches: Iterator[tuple[pd.Series, ...]]) -> Iterator[pd.Series]:
        for columns in batches:
            out = []
            for data_, *own in zip(*columns, strict=True):
                given = [None if v is None or v is pd.NaT or v != v else v for v in own]
                out.append(None if data_ is None else with_exif(bytes(data_), exif_block(*given)) or bytes(data_))
            yield pd.Series(out, dtype=object)

    return F.pandas_udf(run, "binary")(data, description, artist, taken.cast("timestamp"), latitude.cast("double"), longitude.cast("double"))
