"""Media columns: Netpbm and BMP files to numpy arrays, area-resized tiles and difference hashes.

decode() reads P1-P6 Netpbm (plain and raw, 8 or 16 bit) and uncompressed BMP (1, 4, 8, 24, 32 bit, either row
order). area_resize() averages exact pixel areas by an integral image. media_columns() applies both to a binary
column: an NPY tile (uint8), its difference hash, and the decoded size.

Edge cases: a null or undecodable file gives null results and a reason in `media_error`; images smaller than the
tile are enlarged by the same area rule; other columns pass through untouched.
"""

from __future__ import annotations

import hashlib
import io
import re
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from lantern.llm.words import chunks

PAD = 64
TILE = 32
MEDIA_FIELDS = [
    T.StructField("media_width", T.IntegerType()),
    T.StructField("media_height", T.IntegerType()),
    T.StructField("media_tile", T.BinaryType()),
    T.StructField("media_dhash", T.StringType()),
    T.StructField("media_error", T.StringType()),
]


def _netpbm_header(data: bytes, fields: int) -> tuple[list[int], int]:
    """The header's numbers after the magic, comments skipped, and the offset behind the one blank that ends it."""
    found, at = [], 2
    token = re.compile(rb"(?:\s|#[^\n\r]*[\n\r])*(\d+)")
    for _ in range(fields):
        m = token.match(data, at)
        if not m:
            raise ValueError("netpbm header")
        found.append(int(m[1]))
        at = m.end()
    return found, at + 1


def _decode_netpbm(data: bytes) -> np.ndarray:
    kind = data[1] - 48
    bitmap, plain, channels = kind in (1, 4), kind <= 3, 3 if kind in (3, 6) else 1
    (width, height, *rest), at = _netpbm_header(data, 2 if bitmap else 3)
    top = rest[0] if rest else 1
    if not (width and height and 0 < top < 65536):
        raise ValueError("netpbm size")
    n = width * height * channels
    if plain:
        body = re.sub(rb"#[^\n\r]*", b"", data[at - 1 :])
        digits = re.findall(rb"[01]", body) if bitmap else body.split()
        values = np.array([int(x) for x in digits[:n]], np.int64)
    elif bitmap:
        stride = (width + 7) // 8
        raw = np.frombuffer(data, np.uint8, stride * height, at).reshape(height, stride)
        values = np.unpackbits(raw, axis=1)[:, :width].astype(np.int64).ravel()
    else:
        values = np.frombuffer(data, ">u2" if top > 255 else np.uint8, n, at)
    if len(values) < n:
        raise ValueError("netpbm is short")
    if bitmap:
        values = (1 - values) * 255
    elif top != 255:
        values = (values.astype(np.int64) * 255 + top // 2) // top
    return values.astype(np.uint8).reshape((height, width, channels))


def _decode_bmp(data: bytes) -> np.ndarray:
    offset, header, width, height, _, bits, packing = struct.unpack_from("<I I i i H H I", data, 10)
    if packing not in (0, 3) or bits not in (1, 4, 8, 24, 32) or width <= 0 or height == 0:
        raise ValueError("bmp kind")
    rows, stride = abs(height), (width * bits + 31) // 32 * 4
    raw = np.frombuffer(data, np.uint8, stride * rows, offset).reshape(rows, stride)
    if bits >= 24:
        image = raw[:, : width * bits // 8].reshape(rows, width, bits // 8)[:, :, 2::-1]
    else:
        used = struct.unpack_from("<I", data, 46)[0] or 1 << bits
        palette = np.frombuffer(data, np.uint8, used * 4, 14 + header).reshape(used, 4)[:, 2::-1]
        each = 8 // bits
        index = (raw[:, :, None] >> (np.arange(each - 1, -1, -1) * bits).astype(np.uint8)) & np.uint8((1 << bits) - 1)
        image = palette[index.reshape(rows, -1)[:, :width]]
    return np.ascontiguousarray(image if height < 0 else image[::-1])


def decode(data: bytes) -> np.ndarray:
    """A Netpbm or BMP file as uint8 (height, width, 1 or 3)."""
    if data[:1] == b"P" and data[1:2] in b"123456" and len(data) > 2:
        return _decode_netpbm(data)
    if data[:2] == b"BM":
        return _decode_bmp(data)
    raise ValueError("neither netpbm nor bmp")


def encode_pgm(payload: bytes, width: int) -> bytes:
    """The payload's bytes as the samples of a raw 8-bit grey Netpbm; its length is a multiple of width."""
    return b"P5\n%d %d\n255\n" % (width, len(payload) // width) + payload


def area_resize(grey: np.ndarray, height: int, width: int) -> np.ndarray:
    """Mean of each output cell's exact source area, from one integral image interpolated at the cell edges."""
    rows, cols = grey.shape
    integral = np.zeros((rows + 1, cols + 1))
    np.cumsum(np.cumsum(grey, axis=0, dtype=np.float64), axis=1, out=integral[1:, 1:])

    def edges(n: int, parts: int) -> tuple[np.ndarray, np.ndarray]:
        x = np.arange(parts + 1) * (n / parts)
        low = np.minimum(x.astype(np.int64), n - 1)
        return low, x - low

    y, fy = edges(rows, height)
    x, fx = edges(cols, width)
    down = integral[y] * (1 - fy)[:, None] + integral[y + 1] * fy[:, None]
    both = down[:, x] * (1 - fx) + down[:, x + 1] * fx
    return np.diff(np.diff(both, axis=0), axis=1) / ((rows / height) * (cols / width))


def luma(image: np.ndarray) -> np.ndarray:
    return image[:, :, 0].astype(np.float64) if image.shape[2] == 1 else image @ np.array([0.299, 0.587, 0.114])


def difference_hash(grey: np.ndarray) -> str:
    """64 bits as 16 hex digits: whether brightness rises from each cell to its right neighbour on a 9 x 8 grid."""
    cells = np.round(area_resize(grey, 8, 9), 6)
    return np.packbits(cells[:, 1:] > cells[:, :-1]).tobytes().hex()


def npy_tile(grey: np.ndarray, tile: int = TILE) -> bytes:
    out = io.BytesIO()
    np.save(out, np.clip(np.rint(area_resize(grey, tile, tile)), 0, 255).astype(np.uint8), allow_pickle=False)
    return out.getvalue()


def media_columns(df: DataFrame, column: str = "content", tile: int = TILE) -> DataFrame:
    """df with media_width, media_height, media_tile (NPY bytes), media_dhash and media_error for the files in `column`."""
    schema = T.StructType([f for f in df.schema.fields if f.name not in {m.name for m in MEDIA_FIELDS}] + MEDIA_FIELDS)
    kept = [f.name for f in schema.fields[: -len(MEDIA_FIELDS)]]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for cell in batch.column(batch.schema.get_field_index(column)):
                try:
                    image = decode(cell.as_py() or b"")
                    grey = luma(image)
                    rows.append((image.shape[1], image.shape[0], npy_tile(grey, tile), difference_hash(grey), None))
                except (ValueError, struct.error, IndexError) as e:
                    rows.append((None, None, None, None, str(e)[:80] or "undecodable"))
            made = [pa.array(c, t) for c, t in zip(list(zip(*rows)) or [()] * 5, (pa.int32(), pa.int32(), pa.binary(), pa.string(), pa.string()), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(batch.schema.get_field_index(k)) for k in kept] + made, names=schema.names)

    return df.mapInArrow(run, schema)


def text_media(documents: DataFrame, width: int = PAD) -> DataFrame:
    """Each text's UTF-8 bytes, zero-padded to a positive multiple of 64, stored as a raw grey Netpbm of `width` columns.

    The stored form is read back by decode() and every figure comes from those bytes. Null text counts as empty;
    equal texts give equal values; repeated rows give repeated results. Returns doc_id, n_bytes, payload_bytes,
    payload_sha256, tail_crc32, media_bytes, media_sha256, feature (the difference hash), tile (NPY bytes).
    """
    schema = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string, tile binary"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, texts in chunks(batches):
            rows = []
            for text in texts:
                media = encode_pgm(text + bytes(-len(text) % PAD or (0 if text else PAD)), width)
                image = decode(media)
                back, grey = image.tobytes(), luma(image)
                rows.append((len(text), len(back), hashlib.sha256(back).hexdigest(), zlib.crc32(back[-PAD:]), len(media), hashlib.sha256(media).hexdigest(), difference_hash(grey), npy_tile(grey)))
            kinds = (pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.binary())
            made = [pa.array(c, t) for c, t in zip(zip(*rows), kinds, strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(batch.schema.get_field_index("doc_id")), *made], names=[x.split()[0] for x in schema.split(", ")])

    return documents.select(documents["doc_id"].cast("long").alias("doc_id"), documents["text"].cast("string").alias("text")).mapInArrow(run, schema)
