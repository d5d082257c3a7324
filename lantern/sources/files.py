"""Folder, archive and sidecar sources, and the artifact sinks."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lantern.functions.dates import located
from lantern.functions.names import VIDEO_EXTENSIONS, basename, media_type, shard

PIECE = 1 << 20

# The folders that a scan leaves out, the stills that carry a content identifier, and its form.
SKIPPED = r"(^|/)(\.[^/]*|node_modules|\.venv|__pycache__)(/|$)"
STILLS = ("heic", "heif", "jpg", "jpeg", "png")
UUID = "[0-9A-F]{8}-[0-9A-F]{4}-[0-9A-F]{4}-[0-9A-F]{4}-[0-9A-F]{12}"


def listing(spark: SparkSession, root: str, volume_id: int = 0) -> DataFrame:
    """(volume_id, abs_path, rel_path, size_bytes, mtime_ns, media_type) of the media files below a folder; contents are not read."""
    found = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root).select("path", "length", "modificationTime")
    base = F.lit(re.sub(r"^[a-z]+:(//[^/]*)?(?=/)", "", root).rstrip("/"))
    path = F.regexp_replace("path", r"^[a-z]+:(//[^/]*)?(?=/)", "")
    rel = F.expr("substr(_p, length(_b) + 2)")
    out = found.select(path.alias("_p"), base.alias("_b"), "length", "modificationTime").select(
        F.lit(volume_id).cast("long").alias("volume_id"), F.col("_p").alias("abs_path"), rel.alias("rel_path"), F.col("length").alias("size_bytes"), (F.unix_micros("modificationTime") * 1000).alias("mtime_ns"), media_type(basename(F.col("_p"))).alias("media_type")
    )
    return out.where(F.col("media_type").isNotNull() & ~F.col("rel_path").rlike(SKIPPED))


def contents(spark: SparkSession, root: str) -> DataFrame:
    return spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root).select("path", "length", "content")


def plain(path: str) -> str:
    """A path without the local scheme."""
    return re.sub(r"^file:(//)?(?=/)", "", path)


def opened(path: str) -> pa.NativeFile:
    """A seekable file of a local or shared path, or of a URI that Arrow's file systems open."""
    if "://" in plain(path):
        system, at = fs.FileSystem.from_uri(path)
        return system.open_input_file(at)
    return fs.LocalFileSystem().open_input_file(plain(path))


def _by_path(files: DataFrame, column: str, read: Callable[[pa.NativeFile, str], object], kind: pa.DataType) -> DataFrame:
    """(path, `column`): what `read` makes of each open file, null where it can't be read. Files are opened in their tasks, one at a time."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 64):
                out = []
                for path in (part := batch.column(0).slice(at, 64)).to_pylist():
                    try:
                        with opened(path) as f:
                            out.append(read(f, path))
                    except OSError:
                        out.append(None)
                yield pa.RecordBatch.from_arrays([part, pa.array(out, kind)], names=["path", column])

    return files.select("path").mapInArrow(run, f"path string, {column} {'binary' if kind == pa.binary() else 'string'}")


def _whole_digest(f: pa.NativeFile) -> str:
    digest = hashlib.blake2b(digest_size=32)
    while piece := f.read(4 * PIECE):
        digest.update(piece)
    return digest.hexdigest()


def spread(files: DataFrame, rows: int = 4096) -> DataFrame:
    """files dealt out by number, about `rows` to a task: rows of few bytes that each stand for a file's work."""
    return files.repartition(max(1, -(-files.count() // rows)))


def md5_digests(files: DataFrame) -> DataFrame:
    """(path, size, digest) of whole files read in pieces, null where a file is gone. Nothing is listed: the paths are given."""

    def read(f: pa.NativeFile, _: str) -> str:
        digest = hashlib.md5(usedforsecurity=False)
        while piece := f.read(4 * PIECE):
            digest.update(piece)
        return f"{f.tell()} {digest.hexdigest()}"

    found = _by_path(files, "found", read, pa.string())
    return found.select("path", F.split_part("found", F.lit(" "), F.lit(1)).cast("long").alias("size"), F.split_part("found", F.lit(" "), F.lit(2)).alias("digest"))


def fingerprints(files: DataFrame) -> DataFrame:
    """(path, content_hash): blake2b-256 of photos, "q:" and a quick one of size and both ends for videos, by ranged reads.

    A video of any length costs two reads of PIECE bytes, a photo is read in pieces; null where a file is gone.
    """

    def read(f: pa.NativeFile, path: str) -> str:
        if not path.lower().endswith(VIDEO_EXTENSIONS):
            return _whole_digest(f)
        size = f.size()
        digest = hashlib.blake2b(str(size).encode() + f.read(PIECE), digest_size=32)
        if size > 2 * PIECE:
            f.seek(size - PIECE)
            digest.update(f.read(PIECE))
        return "q:" + digest.hexdigest()

    return _by_path(files, "content_hash", read, pa.string())


def full_fingerprints(files: DataFrame) -> DataFrame:
    """(path, content_hash): blake2b-256 of whole files read in pieces, to verify what quick hashes propose; null where a file is gone."""
    return _by_path(files, "content_hash", lambda f, _: _whole_digest(f), pa.string())


def still_heads(files: DataFrame, head: int = 256_000) -> DataFrame:
    """(path, content) of the stills among files(path): their first `head` bytes, the only ones read; null where a file is gone."""
    stills = files.where(F.lower("path").rlike(r"\.(" + "|".join(STILLS) + ")$"))
    return _by_path(stills, "content", lambda f, _: f.read(head), pa.binary())


def head_identifiers(files: DataFrame, head: int = 256_000) -> DataFrame:
    """(path, content_id, pos): distinct upper-case UUIDs in each file's first bytes, JVM-side."""
    text = F.decode(F.substring("content", 1, head), "ISO-8859-1")
    return files.select("path", F.posexplode(F.array_distinct(F.regexp_extract_all(text, F.lit(UUID), F.lit(0)))).alias("pos", "content_id"))


GEO = "struct<latitude:double,longitude:double>"
SIDECAR = f"photoTakenTime struct<timestamp:string>, creationTime struct<timestamp:string>, geoData {GEO}, geoDataExif {GEO}"


def sidecar(json: Column) -> Column:
    """struct(taken_at, place) of a sidecar's text: the taken time or else the creation time, the first usable coordinates."""
    raw = F.from_json(json, SIDECAR)
    seconds = F.coalesce(F.nullif(raw["photoTakenTime"]["timestamp"], F.lit("")), F.nullif(raw["creationTime"]["timestamp"], F.lit("")))
    place = F.coalesce(located(raw["geoData"]["latitude"], raw["geoData"]["longitude"]), located(raw["geoDataExif"]["latitude"], raw["geoDataExif"]["longitude"]))
    return F.struct(F.timestamp_seconds(seconds.try_cast("long")).alias("taken_at"), place.alias("place"))


def write_artifacts(artifacts: DataFrame, path: str) -> None:
    """artifacts(file_id, content) as Parquet in 256 shard folders; overwritten as a whole, so a rerun is safe."""
    artifacts.withColumn("shard", shard(F.col("file_id"))).write.mode("overwrite").partitionBy("shard").parquet(path)


def write_paths(files: DataFrame, volumes: DataFrame, path: str) -> None:
    """Absolute paths, one per line."""
    files.join(volumes, "volume_id").select(F.concat_ws("/", "mount", "rel_path").alias("value")).write.mode("overwrite").text(path)


def byte_range(content: Column, start: int, end: int | None) -> Column:
    """Bytes start .. end of a file, null where start lies behind it."""
    size = F.length(content)
    last = F.least(F.lit(end), size - 1) if end is not None else size - 1
    return F.when(F.lit(start) < size, F.substring(content, F.lit(start + 1), last - start + 1))
