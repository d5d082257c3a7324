"""Pixel and JPEG helpers for pandas and Arrow functions: plain numpy and bytes, decoders are passed in."""

from __future__ import annotations

import math
import struct
from datetime import datetime
from typing import BinaryIO

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F


def sharpness(grey: np.ndarray) -> float | None:
    """Variance of the sum of both axes' second differences inside the image; None below 8 pixels a side."""
    image = np.asarray(grey, np.float64)
    if image.ndim != 2 or min(image.shape) < 8:
        return None
    return float((np.diff(image, 2, axis=0)[:, 1:-1] + np.diff(image, 2, axis=1)[1:-1]).var())


def cosine_basis(n: int) -> np.ndarray:
    k = np.arange(n)
    return np.cos(math.pi * np.outer(k, 2 * k + 1) / (2 * n))


def perceptual_hash(grey: np.ndarray) -> int:
    """64 bits of a 32 x 32 luma image: low frequencies of the cosine transform against their median, as a signed long."""
    basis = cosine_basis(32)
    low = (basis @ np.asarray(grey, float) @ basis.T)[:8, :8]
    value = int.from_bytes(np.packbits(low > np.median(low)).tobytes(), "big")
    return value - (1 << 64) if value >> 63 else value


def shrunk(grey: np.ndarray, n: int) -> np.ndarray:
    """n x n means of exact pixel areas."""
    out = np.asarray(grey, float)
    for _ in range(2):  # rows, then columns
        size = len(out)
        sums = np.concatenate((np.zeros((1, out.shape[1])), np.cumsum(out, axis=0)))
        edge = np.arange(n + 1) * (size / n)
        low = np.minimum(edge.astype(int), size - 1)
        part = (edge - low)[:, None]
        out = (np.diff(sums[low] * (1 - part) + sums[low + 1] * part, axis=0) / (size / n)).T
    return out


def sharpness_column(pixels: Column, width: Column) -> Column:
    """Sharpness of row-major grey pixels (array<int>) of the given width."""

    @F.pandas_udf("double")
    def run(values: pd.Series, widths: pd.Series) -> pd.Series:
        return pd.Series([sharpness(np.asarray(v, np.float32).reshape(-1, int(w))) if v is not None and w else None for v, w in zip(values, widths, strict=True)], dtype="float64")

    return run(pixels, width)


def _ifd(entries: list[tuple[int, int, int, bytes]], at: int) -> bytes:
    """A TIFF directory (big-endian) at offset `at`: values over 4 bytes follow it."""
    behind = at + 2 + 12 * len(entries) + 4
    rows, data = b"", b""
    for tag, kind, count, value in sorted(entries):
        if len(value) > 4:
            rows += struct.pack(">HHII", tag, kind, count, behind + len(data))
            data += value + b"\0" * (len(value) % 2)
        else:
            rows += struct.pack(">HHI", tag, kind, count) + value.ljust(4, b"\0")
    return struct.pack(">H", len(entries)) + rows + b"\0\0\0\0" + data


def _rationals(value: float) -> bytes:
    value = abs(value)
    degrees = int(value)
    minutes = int((value - degrees) * 60)
    seconds = round((value - degrees - minutes / 60) * 3600, 4)
    return struct.pack(">6I", degrees, 1, minutes, 1, round(seconds * 10_000), 10_000)


def exif_payload(at: datetime | None, lat: float | None, lon: float | None) -> bytes:
    """A TIFF block with a capture date and coordinates, as far as they are given."""
    stamp = at.strftime("%Y:%m:%d %H:%M:%S").encode() + b"\0" if at else None
    gps = []
    if lat is not None and lon is not None:
        gps = [(1, 2, 2, b"N\0" if lat >= 0 else b"S\0"), (2, 5, 3, _rationals(lat)), (3, 2, 2, b"E\0" if lon >= 0 else b"W\0"), (4, 5, 3, _rationals(lon))]
    dates = [(0x9003, 2, 20, stamp), (0x9004, 2, 20, stamp)] if stamp else []
    pointers = [(0x8769, 4, 1, b"\0" * 4)] * bool(dates) + [(0x8825, 4, 1, b"\0" * 4)] * bool(gps)
    main = [(0x0132, 2, 20, stamp)] * bool(stamp)
    size = len(_ifd(main + pointers, 8))
    date_at, gps_at = 8 + size, 8 + size + (len(_ifd(dates, 0)) if dates else 0)
    places = {0x8769: struct.pack(">I", date_at), 0x8825: struct.pack(">I", gps_at)}
    main += [(tag, kind, n, places[tag]) for tag, kind, n, _ in pointers]
    return b"MM\0*\0\0\0\x08" + _ifd(main, 8) + (_ifd(dates, date_at) if dates else b"") + (_ifd(gps, gps_at) if gps else b"")


def jpeg_segments(data: bytes) -> tuple[list[tuple[int, bytes]], int]:
    """(marker, whole segment) of a JPEG up to its scan, and the scan's offset."""
    if data[:2] != b"\xff\xd8":
        raise ValueError("not a JPEG")
    out, at = [], 2
    while at + 3 < len(data) and data[at] == 0xFF and data[at + 1] != 0xDA:
        marker = data[at + 1]
        size = 2 if marker == 1 or 0xD0 <= marker <= 0xD8 else 2 + int.from_bytes(data[at + 2 : at + 4], "big")
        out.append((marker, data[at : at + size]))
        at += size
    return out, at


def with_exif(data: bytes, payload: bytes) -> bytes:
    """The JPEG with its Exif segment replaced, behind JFIF; compressed data stay byte for byte."""
    body = b"Exif\0\0" + payload
    exif = b"\xff\xe1" + struct.pack(">H", len(body) + 2) + body
    segments, scan = jpeg_segments(data)
    rest = [(m, s) for m, s in segments if not (m == 0xE1 and s[4:10] == b"Exif\0\0")]
    lead = next((i + 1 for i, (m, _) in enumerate(rest) if m == 0xE0), 0)
    parts = [s for _, s in rest]
    return b"".join([data[:2], *parts[:lead], exif, *parts[lead:], data[scan:]])


def exif_fields(data: bytes) -> dict[str, object]:
    """make, model, datetime, orientation, lat and lon of a JPEG's Exif segment, as far as it has them."""
    segments, _ = jpeg_segments(data)
    block = next((s[10:] for m, s in segments if m == 0xE1 and s[4:10] == b"Exif\0\0"), b"")
    if len(block) < 8:
        return {}
    order = ">" if block[:2] == b"MM" else "<"
    read = lambda form, at: struct.unpack_from(order + form, block, at)

    def directory(at: int) -> dict[int, object]:
        found: dict[int, object] = {}
        for i in range(read("H", at)[0]):
            tag, kind, n = read("HHI", at + 2 + 12 * i)
            width = {1: 1, 2: 1, 3: 2, 4: 4, 5: 8, 7: 1, 9: 4, 10: 8}.get(kind, 1)
            here = at + 10 + 12 * i if width * n <= 4 else read("I", at + 10 + 12 * i)[0]
            if kind == 2:
                found[tag] = block[here : here + n].split(b"\0")[0].decode("latin-1").strip()
            elif kind in (5, 10):
                pairs = [read("II" if kind == 5 else "ii", here + 8 * j) for j in range(n)]
                found[tag] = [a / b if b else None for a, b in pairs]
            elif kind in (3, 4, 9):
                values = read({3: "H", 4: "I", 9: "i"}[kind] * n, here)
                found[tag] = values[0] if n == 1 else list(values)
        return found

    try:
        main = directory(read("I", 4)[0])
        sub = directory(main[0x8769]) if 0x8769 in main else {}
        gps = directory(main[0x8825]) if 0x8825 in main else {}
    except (struct.error, IndexError):
        return {}
    out = {"make": main.get(0x010F), "model": main.get(0x0110), "orientation": main.get(0x0112), "datetime": sub.get(0x9003) or main.get(0x0132)}
    if gps.get(2) and gps.get(4):
        degrees = lambda v: v[0] + v[1] / 60 + v[2] / 3600
        out["lat"] = degrees(gps[2]) * (-1 if gps.get(1) == "S" else 1)
        out["lon"] = degrees(gps[4]) * (-1 if gps.get(3) == "W" else 1)
    return {k: v for k, v in out.items() if v is not None}


def _raw_directory(block: bytes, order: str, at: int) -> dict[int, tuple[int, int, bytes]]:
    """tag: (kind, count, big-endian value) of a TIFF directory."""
    out = {}
    for i in range(struct.unpack_from(order + "H", block, at)[0]):
        tag, kind, n = struct.unpack_from(order + "HHI", block, at + 2 + 12 * i)
        unit, parts = {1: (1, 1), 2: (1, 1), 3: (2, 1), 4: (4, 1), 5: (4, 2), 6: (1, 1), 7: (1, 1), 8: (2, 1), 9: (4, 1), 10: (4, 2), 11: (4, 1), 12: (8, 1)}.get(kind, (0, 0))
        size = unit * parts * n
        here = at + 10 + 12 * i if size <= 4 else struct.unpack_from(order + "I", block, at + 10 + 12 * i)[0]
        value = block[here : here + size]
        if not unit or len(value) < size:
            continue
        if order == "<" and unit > 1:
            value = b"".join(value[j : j + unit][::-1] for j in range(0, size, unit))
        out[tag] = (kind, n, value)
    return out


def merged_payload(block: bytes, at: datetime | None, lat: float | None, lon: float | None) -> bytes:
    """A TIFF block with a capture date and coordinates beside what `block` has, which wins; thumbnails and maker links are left out."""
    main, sub, gps = {}, {}, {}
    if len(block) >= 8:
        order = ">" if block[:2] == b"MM" else "<"
        main = _raw_directory(block, order, struct.unpack_from(order + "I", block, 4)[0])
        for tag, inner in ((0x8769, sub), (0x8825, gps)):
            if tag in main:
                inner.update(_raw_directory(block, order, struct.unpack(">I", main.pop(tag)[2])[0]))
    sub.pop(0xA005, None)
    made = exif_payload(at, lat, lon)
    fresh = _raw_directory(made, ">", 8)
    for tag, inner in ((0x8769, sub), (0x8825, gps)):
        if tag in fresh:
            for key, value in _raw_directory(made, ">", struct.unpack(">I", fresh.pop(tag)[2])[0]).items():
                inner.setdefault(key, value)
    for key, value in fresh.items():
        main.setdefault(key, value)
    listed = lambda d: [(tag, kind, n, value) for tag, (kind, n, value) in d.items()]
    pointers = [(0x8769, 4, 1, b"\0" * 4)] * bool(sub) + [(0x8825, 4, 1, b"\0" * 4)] * bool(gps)
    sub_at = 8 + len(_ifd(listed(main) + pointers, 8))
    gps_at = sub_at + (len(_ifd(listed(sub), sub_at)) if sub else 0)
    places = {0x8769: struct.pack(">I", sub_at), 0x8825: struct.pack(">I", gps_at)}
    return b"MM\0*\0\0\0\x08" + _ifd(listed(main) + [(tag, kind, n, places[tag]) for tag, kind, n, _ in pointers], 8) + (_ifd(listed(sub), sub_at) if sub else b"") + (_ifd(listed(gps), gps_at) if gps else b"")


def repaired_head(f: BinaryIO, at: datetime | None, lat: float | None, lon: float | None) -> tuple[bytes | None, bool, int]:
    """(new head or None, whether the file has a date, where the scan begins) of a JPEG that lacks a date or place; only its head is read."""
    data = f.read(1 << 18)
    while True:
        try:
            segments, scan = jpeg_segments(data)
        except (ValueError, IndexError):
            return None, False, 0
        more = f.read(len(data)) if scan + 4 > len(data) else b""
        if not more:
            break
        data += more
    if data[scan : scan + 2] != b"\xff\xda":
        return None, False, 0
    have = exif_fields(data[:scan])
    dated, placed = "datetime" in have, "lat" in have
    if (at is None or dated) and (lat is None or lon is None or placed):
        return None, dated, scan
    block = next((s[10:] for m, s in segments if m == 0xE1 and s[4:10] == b"Exif\0\0"), b"")
    try:
        payload = merged_payload(block, None if dated else at, None if placed else lat, None if placed else lon)
    except (struct.error, IndexError):
        return None, dated, scan
    if len(payload) + 8 > 0xFFFF:
        return None, dated, scan
    return with_exif(data[:scan], payload), dated, scan
