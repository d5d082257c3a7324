"""Photo, video and face records from file contents and probe output; settings, gazetteers and archive parts.

Decoders and detectors are passed in as functions, so no image, video or model library is needed here.
"""

from __future__ import annotations

import hashlib
import io
import zipfile
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lantern.functions.dates import filename_datetime, iso6709, video_datetime
from lantern.functions.images import exif_fields, perceptual_hash, sharpness, shrunk
from lantern.functions.names import basename, media_type

STREAM = "struct<codec_type:string,codec_name:string,width:bigint,height:bigint,tags:map<string,string>,side_data_list:array<struct<rotation:string>>>"
PROBE = f"format struct<duration:string,tags:map<string,string>>, streams array<{STREAM}>"
# Tag names of the container formats, in the order in which they count.
PLACE_TAGS = ("com.apple.quicktime.location.iso6709", "location", "location-eng")
MOMENT_TAGS = ("com.apple.quicktime.creationdate", "creation_time")
IDENTIFIER_TAG = "com.apple.quicktime.content.identifier"
CROP_REACH, LEAST_CROP = 0.85, 8


def tag(tags: Column, *names: str) -> Column:
    """The first non-empty value among the named tags, whatever their case."""

    def named(name: str) -> Column:
        same = F.filter(F.map_entries(tags), lambda e: F.lower(e["key"]) == name)
        return F.nullif(F.try_element_at(same, F.lit(-1))["value"], F.lit(""))

    return F.coalesce(*map(named, names))


def video_records(probes: DataFrame) -> DataFrame:
    """(file_id, video_codec, width, height, duration_s, place, content_id, taken_at, taken_at_src) of probes(file_id, path, probe, mtime).

    The first video stream counts, turned by its last rotation; the date is the container's, else the file name's, else mtime.
    """
    parsed = probes.select("file_id", "path", "mtime", F.from_json("probe", PROBE).alias("p"))
    stream = F.try_element_at(F.filter("p.streams", lambda s: s["codec_type"] == "video"), F.lit(1))
    rows = parsed.withColumn("s", stream).withColumn("turns", F.filter(F.transform("s.side_data_list", lambda d: d["rotation"].try_cast("double")), lambda r: r.isNotNull()))
    turn = F.coalesce(F.try_element_at("turns", F.lit(-1)), tag(F.col("s.tags"), "rotate").try_cast("double"), F.lit(0.0)).cast("long")
    side = F.abs(turn) % 180 == 90
    named = filename_datetime(basename(F.col("path")))
    own = video_datetime(tag(F.col("p.format.tags"), *MOMENT_TAGS))
    return rows.select(
        "file_id",
        F.col("s.codec_name").alias("video_codec"),
        F.when(side, F.col("s.height")).otherwise(F.col("s.width")).alias("width"),
        F.when(side, F.col("s.width")).otherwise(F.col("s.height")).alias("height"),
        F.round(F.col("p.format.duration").try_cast("double"), 2).alias("duration_s"),
        iso6709(tag(F.col("p.format.tags"), *PLACE_TAGS)).alias("place"),
        tag(F.col("p.format.tags"), IDENTIFIER_TAG).alias("content_id"),
        F.coalesce(own, named, "mtime").alias("taken_at"),
        F.when(own.isNotNull(), "video").when(named.isNotNull(), "filename").otherwise("mtime").alias("taken_at_src"),
    )


def backfilled(metadata: DataFrame, probes: DataFrame) -> DataFrame:
    """metadata(file_id, content_id) with the identifiers of probes(file_id, online, probe) where none was asked for yet.

    Null means not asked, '' asked without an identifier (unreadable files too); what is offline stays null.
    """
    asked = probes.where("online").select("file_id", F.coalesce(tag(F.from_json("probe", PROBE)["format"]["tags"], IDENTIFIER_TAG), F.lit("")).alias("_found"))
    return metadata.join(asked, "file_id", "left").withColumn("content_id", F.coalesce("content_id", "_found")).drop("_found")


def photo_records(files: DataFrame, decode: Callable[[bytes], np.ndarray]) -> DataFrame:
    """One row per files(file_id, content): ok, error, content_hash, width, height, make, model, orientation, datetime, lat, lon, phash, sharpness.

    decode gives a grey image; a file that it refuses keeps its hash and has ok = false and the reason.
    """
    kinds = {"file_id": pa.int64(), "ok": pa.bool_(), "error": pa.string(), "content_hash": pa.string(), "width": pa.int64(), "height": pa.int64(), "make": pa.string(), "model": pa.string()}
    kinds |= {"orientation": pa.int64(), "datetime": pa.string(), "lat": pa.float64(), "lon": pa.float64(), "phash": pa.int64(), "sharpness": pa.float64()}

    def record(file_id: int, data: bytes) -> dict:
        out = {"file_id": file_id, "ok": True, "content_hash": hashlib.blake2b(data, digest_size=32).hexdigest()}
        try:
            grey = decode(data)
            out |= {"height": grey.shape[0], "width": grey.shape[1], "phash": perceptual_hash(shrunk(grey, 32)), "sharpness": sharpness(grey)}
            out |= exif_fields(data) if data[:2] == b"\xff\xd8" else {}
        except Exception as e:  # noqa: BLE001  a decoder's own error types
            out |= {"ok": False, "error": f"{type(e).__name__}: {e}"[:200]}
        return out

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [record(i, c.as_py() or b"") for i, c in zip(batch.column(0).to_pylist(), batch.column(1), strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array([r.get(k) for r in rows], t) for k, t in kinds.items()], names=list(kinds))

    spell = {pa.int64(): "long", pa.float64(): "double", pa.string(): "string", pa.bool_(): "boolean"}
    return files.select(F.col("file_id").cast("long").alias("file_id"), "content").mapInArrow(run, ", ".join(f"{k} {spell[t]}" for k, t in kinds.items()))


def overlaps_left_out(boxes: np.ndarray, scores: np.ndarray, most: float = 0.4) -> np.ndarray:
    """Indices of the boxes (left, top, right, bottom) that stay, best score first: none shares more than `most` of its union with a better one."""
    area = np.prod(boxes[:, 2:] - boxes[:, :2], axis=1)
    rest, kept = np.argsort(-scores, kind="stable"), []
    while len(rest):
        best, rest = rest[0], rest[1:]
        kept.append(best)
        size = np.clip(np.minimum(boxes[rest, 2:], boxes[best, 2:]) - np.maximum(boxes[rest, :2], boxes[best, :2]), 0, None)
        both = size[:, 0] * size[:, 1]
        rest = rest[both <= most * (area[rest] + area[best] - both)]
    return np.array(kept, np.int64)


def detected_faces(files: DataFrame, load: Callable[[], Callable[[bytes], list[dict]]]) -> DataFrame:
    """(file_id, x, y, w, h, det_score, embedding) per face of files(file_id, content); load() runs once a task and gives the detector."""
    names = ("x", "y", "w", "h", "det_score")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        detect = load()
        for batch in batches:
            found = [(i, face) for i, c in zip(batch.column(0).to_pylist(), batch.column(1), strict=True) for face in detect(c.as_py() or b"")]
            made = [pa.array([f[n] for _, f in found], pa.float64()) for n in names]
            yield pa.RecordBatch.from_arrays([pa.array([i for i, _ in found], pa.int64()), *made, pa.array([[float(v) for v in f["embedding"]] for _, f in found], pa.list_(pa.float32()))], names=["file_id", *names, "embedding"])

    return files.select(F.col("file_id").cast("long").alias("file_id"), "content").mapInArrow(run, "file_id long, x double, y double, w double, h double, det_score double, embedding array<float>")


def crop_box(x: Column, y: Column, w: Column, h: Column, width: Column, height: Column) -> Column:
    """struct(left, top, right, bottom) in pixels around a face given in parts of the image; null under 8 pixels."""
    half = F.greatest(w * width, h * height) * CROP_REACH
    cx, cy = (x + w / 2) * width, (y + h / 2) * height
    low = lambda v: F.greatest(F.lit(0), v.cast("int"))
    box = F.struct(low(cx - half).alias("left"), low(cy - half).alias("top"), F.least(width.cast("int"), (cx + half).cast("int")).alias("right"), F.least(height.cast("int"), (cy + half).cast("int")).alias("bottom"))
    return F.when((box["right"] - box["left"] >= LEAST_CROP) & (box["bottom"] - box["top"] >= LEAST_CROP), box)


def album_members(items: DataFrame, files: DataFrame) -> DataFrame:
    """(album_name, file_id) of items(album_name, volume_id, rel_path) whose file has arrived; run again as more files do."""
    return items.distinct().join(files.select("volume_id", "rel_path", "file_id"), ["volume_id", "rel_path"]).select("album_name", "file_id")


def folder_children(listing: DataFrame, folder: str = "") -> DataFrame:
    """(name, files) of the folders right below `folder`, with the number of media files under each."""
    inside = listing if not folder else listing.where(F.col("rel_path").startswith(folder.rstrip("/") + "/"))
    rest = F.split(F.substring("rel_path", F.lit(len(folder.rstrip("/")) + 2 if folder else 1), F.length("rel_path")), "/")
    return inside.where(F.size(rest) > 1).groupBy(F.element_at(rest, 1).alias("name")).agg(F.count("*").alias("files"))


def browse(listing: DataFrame, folder: str = "", zips: bool = False) -> DataFrame:
    """(kind, name, path, size, sort_key) of what stands right in `folder`: its folders, and its ZIP archives if asked for.

    listing(rel_path, size_bytes) has a row per file; folders are those that hold a file at any depth, size null. Names
    with a dot in front are left out. Sort by (kind, sort_key, name): whatever the case.
    """
    top = folder.strip("/")
    inside = listing.where(F.col("rel_path").startswith(top + "/")) if top else listing
    rest = F.split(F.substring("rel_path", F.lit(len(top) + 2 if top else 1), F.length("rel_path")), "/")
    shown = inside.select(rest.alias("rest"), "size_bytes").where(~F.col("rest")[0].startswith("."))
    path = F.concat(F.lit(top + "/" if top else ""), F.col("rest")[0])
    rows = shown.where(F.size("rest") > 1).select(F.lit("dir").alias("kind"), F.col("rest")[0].alias("name"), path.alias("path"), F.lit(None).cast("long").alias("size")).distinct()
    if zips:
        packed = shown.where((F.size("rest") == 1) & F.lower(F.col("rest")[0]).endswith(".zip"))
        rows = rows.unionByName(packed.select(F.lit("zip").alias("kind"), F.col("rest")[0].alias("name"), path.alias("path"), F.col("size_bytes").cast("long").alias("size")))
    return rows.withColumn("sort_key", F.lower("name"))


def media_here(listing: DataFrame, folder: str = "") -> DataFrame:
    """One row: media_count, the photos and videos right in `folder`, hidden ones aside."""
    top = folder.strip("/")
    name = F.substring("rel_path", F.lit(len(top) + 2 if top else 1), F.length("rel_path"))
    here = (F.col("rel_path").startswith(top + "/") if top else F.lit(True)) & ~name.contains("/") & ~name.startswith(".")
    return listing.agg(F.count_if(here & media_type(name).isNotNull()).alias("media_count"))


def settings(table: DataFrame, defaults: dict[str, str]) -> dict[str, str]:
    """The named settings of table(key, value), defaults where it has none; only these few rows are read."""
    return defaults | {r["key"]: r["value"] for r in table.where(F.col("key").isin(list(defaults))).select("key", "value").collect() if r["value"] is not None}


def gazetteer(spark: SparkSession, path: str) -> DataFrame:
    """(city_id, lat, lon, city, state, country_code) of a city list as CSV with a header lat, lon, name, admin1, admin2, cc."""
    rows = spark.read.csv(path, header=True, schema="lat double, lon double, name string, admin1 string, admin2 string, cc string")
    return rows.select(F.xxhash64("lat", "lon", "name").alias("city_id"), "lat", "lon", F.col("name").alias("city"), F.col("admin1").alias("state"), F.col("cc").alias("country_code"))


def zip_parts(files: DataFrame, most: int = 64 << 20) -> DataFrame:
    """(n_files, n_bytes, archive): stored ZIP archives of files(name, content), each begun anew beyond `most` bytes.

    A task packs its own rows, so no archive needs more than one task's memory and a lost task is packed again. Names
    are taken as they are: make them unique first. Rows without content (vanished files) are left out.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def done() -> pa.RecordBatch:
            z.close()
            return pa.RecordBatch.from_arrays([pa.array([n], pa.int64()), pa.array([size], pa.int64()), pa.array([out.getvalue()], pa.binary())], names=["n_files", "n_bytes", "archive"])

        out, n, size = io.BytesIO(), 0, 0
        z = zipfile.ZipFile(out, "w", zipfile.ZIP_STORED)
        for batch in batches:
            for name, content in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                if not content.is_valid:
                    continue
                z.writestr(zipfile.ZipInfo(name), content.as_py())
                n, size = n + 1, size + len(content.as_buffer())
                if size >= most:
                    yield done()
                    out, n, size = io.BytesIO(), 0, 0
                    z = zipfile.ZipFile(out, "w", zipfile.ZIP_STORED)
        if n:
            yield done()

    return files.select("name", "content").mapInArrow(run, "n_files long, n_bytes long, archive binary")
