"""Export archives by ranged reads, and trees of files as a sink: Python data sources.

The reader plans a partition per archive and seeks: the end record and the ZIP64 one from the archive's tail, then the
central directory in pieces. Members are read by their own ranges, so the work is dealt by members and not by archives,
and no archive is ever one cell. The writers make a file under a name of its own beside the target and rename it, so a
killed run leaves whole files only; the next run's plan is anti-joined with what lies there. Paths are local or shared
POSIX paths, or for reading any URI that Arrow's file systems open; the target folder must be shared by all executors.
"""

from __future__ import annotations

import json
import os
import shutil
import struct
import uuid
import zipfile
import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from datetime import UTC, datetime

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition, WriterCommitMessage

from lantern.functions.dates import filename_datetime
from lantern.functions.images import repaired_head
from lantern.functions.names import basename, container, is_year_bucket, media_type
from lantern.operators import archives
from lantern.session import remove, shared_dir, written
from lantern.sources.files import PIECE, opened, plain, sidecar

ENTRIES, FILES = 4096, 4096
ENTRY_SCHEMA = "archive string, name string, size long, crc long, packed long, method int, header_at long, error string"
ENTRY_TYPES = (pa.string(), pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.string())
ENTRY_NAMES = [x.split()[0] for x in ENTRY_SCHEMA.split(", ")]
SPARE = 1.02  # of the free space that an extraction needs


# -- reading


def directory_span(f: pa.NativeFile) -> tuple[int, int, int]:
    """(start, length, shift) of an archive's central directory; shift is how far all offsets are off, for bytes put before the archive."""
    size = f.size()
    reach = min(size, 22 + 0xFFFF + 20)
    f.seek(size - reach)
    tail = f.read(reach)
    at = tail.rfind(b"PK\5\6")
    while at >= 0 and (len(tail) - at < 22 or len(tail) - at - 22 < struct.unpack_from("<H", tail, at + 20)[0]):
        at = tail.rfind(b"PK\5\6", 0, at)
    if at < 0:
        raise zipfile.BadZipFile("no end record")
    entries, length, start = struct.unpack_from("<HLL", tail, at + 10)
    end = size - reach + at
    if (entries == 0xFFFF or length == 0xFFFFFFFF or start == 0xFFFFFFFF) and at >= 20 and tail[at - 20 : at - 16] == b"PK\6\7":
        for end in (end - 20 - 56, struct.unpack_from("<Q", tail, at - 12)[0]):
            f.seek(max(0, end))
            record = f.read(56)
            if record[:4] == b"PK\6\6":
                break
        else:
            raise zipfile.BadZipFile("no ZIP64 end record")
        length, start = struct.unpack_from("<QQ", record, 40)
    shift = end - length - start
    if shift < 0 or start + shift < 0:
        raise zipfile.BadZipFile("central directory out of bounds")
    return start + shift, length, shift


def entry_name(raw: bytes, flags: int) -> str:
    """An entry's name: UTF-8, and where neither flag nor bytes say so the archive's old code page."""
    try:
        return raw.decode("utf-8")
    except UnicodeDecodeError:
        return raw.decode("utf-8", "replace") if flags & 0x800 else raw.decode("cp437")


def entries(archive: str) -> Iterator[tuple]:
    """The central directory's files, read in pieces: (archive, name, size, crc, packed, method, header_at, error)."""
    with opened(archive) as f:
        at, left, shift = directory_span(f)
        held = b""
        f.seek(at)
        while left or held:
            while left and (len(held) < 46 or len(held) < 46 + sum(struct.unpack_from("<3H", held, 28))):
                piece = f.read(min(PIECE, left))
                if not piece:
                    raise zipfile.BadZipFile("central directory cut off")
                held, left = held + piece, left - len(piece)
            if len(held) < 46 or held[:4] != b"PK\1\2":
                raise zipfile.BadZipFile("bad directory entry")
            done = 0
            while len(held) - done >= 46 and len(held) - done >= (n := 46 + sum(struct.unpack_from("<3H", held, done + 28))) and held[done : done + 4] == b"PK\1\2":
                flags, method, crc, packed, size, named, extra = (struct.unpack_from("<HH4xLLLHH", held, done + 8))
                header_at = struct.unpack_from("<L", held, done + 42)[0]
                name = held[done + 46 : done + 46 + named]
                more = held[done + 46 + named : done + 46 + named + extra]
                while len(more) >= 4:
                    kind, width = struct.unpack_from("<HH", more)
                    if kind == 1:
                        wide = iter(struct.unpack_from(f"<{min(width, 24) // 8}Q", more, 4))
                        size = next(wide, size) if size == 0xFFFFFFFF else size
                        packed = next(wide, packed) if packed == 0xFFFFFFFF else packed
                        header_at = next(wide, header_at) if header_at == 0xFFFFFFFF else header_at
                    more = more[4 + width :]
                if not name.endswith(b"/"):
                    yield archive, entry_name(name, flags), size, crc, packed, method, header_at + shift, None
                done += n
            held = held[done:]


@dataclass
class Archive(InputPartition):
    path: str


class ZipDirectory(DataSource):
    """The entries of archives; option `paths` is a JSON list. An archive that can't be read is one row with its error."""

    @classmethod
    def name(cls) -> str:
        return "lantern_zip_directory"

    def schema(self) -> str:
        return ENTRY_SCHEMA

    def reader(self, schema) -> DataSourceReader:
        return ZipDirectoryReader(json.loads(self.options["paths"]))


class ZipDirectoryReader(DataSourceReader):
    def __init__(self, paths: list[str]):
        self.paths = paths

    def partitions(self) -> list[Archive]:
        return [Archive(p) for p in self.paths]

    def read(self, partition: Archive) -> Iterator[pa.RecordBatch]:
        def batch() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), ENTRY_TYPES)], names=ENTRY_NAMES)

        rows: list[tuple] = []
        try:
            for row in entries(partition.path):
                rows.append(row)
                if len(rows) == ENTRIES:
                    yield batch()
                    rows = []
        except (zipfile.BadZipFile, OSError, struct.error) as e:
            rows.append((partition.path, *[None] * 6, type(e).__name__))
        if rows:
            yield batch()


def archive_entries(spark: SparkSession, paths: list[str]) -> DataFrame:
    """(archive, name, size, crc, packed, method, header_at, error) of the files in archives, by their central directories only.

    Folders have no row. An archive that can't be read has the rows before the fault and one with `error`. Without paths
    the result is empty.
    """
    if not paths:
        return spark.createDataFrame([], ENTRY_SCHEMA)
    spark.dataSource.register(ZipDirectory)
    return spark.read.format("lantern_zip_directory").option("paths", json.dumps(paths)).load()


def unpacked(f: pa.NativeFile, header_at: int, packed: int, size: int, method: int, crc: int) -> Iterator[bytes]:
    """A member's bytes in pieces, stored or deflated; raises where size or checksum differ."""
    f.seek(header_at)
    head = f.read(30)
    if head[:4] != b"PK\3\4" or method not in (0, 8):
        raise zipfile.BadZipFile(f"no member that can be read, method {method}")
    f.seek(header_at + 30 + sum(struct.unpack_from("<HH", head, 26)))
    inflate, left, seen, total = zlib.decompressobj(-15), packed, 0, 0
    while left:
        raw = f.read(min(PIECE, left))
        if not raw:
            raise zipfile.BadZipFile("member cut off")
        left -= len(raw)
        while raw:
            piece, raw = (inflate.decompress(raw, PIECE), inflate.unconsumed_tail) if method else (raw, b"")
            seen, total = zlib.crc32(piece, seen), total + len(piece)
            yield piece
    if method and (piece := inflate.flush()):
        seen, total = zlib.crc32(piece, seen), total + len(piece)
        yield piece
    if (seen, total) != (crc, size):
        raise zipfile.BadZipFile("size or checksum differs")


def member_contents(members: DataFrame) -> DataFrame:
    """(archive, name, content) of small members such as sidecars, each read by its own range; null where it can't be read."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part, out = batch.slice(at, 256), []
                for r in part.to_pylist():
                    try:
                        with opened(r["archive"]) as f:
                            out.append(b"".join(unpacked(f, r["header_at"], r["packed"], r["size"], r["method"], r["crc"])))
                    except (zipfile.BadZipFile, zlib.error, OSError):
                        out.append(None)
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(out, pa.binary())], names=["archive", "name", "content"])

    return members.select("archive", "name", "size", "crc", "packed", "method", "header_at").repartitionByRange("archive", "header_at").mapInArrow(run, "archive string, name string, content binary")


# -- writing


@dataclass
class Counted(WriterCommitMessage):
    counts: dict


def whole(target: str, pieces: Iterator[bytes]) -> int:
    """Write pieces beside the target and rename: the target is whole or as it was. Its folder is made."""
    os.makedirs(os.path.dirname(target), exist_ok=True)
    part, n = f"{target}.part-{uuid.uuid4().hex}", 0
    try:
        with open(part, "wb") as out:
            for piece in pieces:
                n += out.write(piece)
        os.replace(part, target)
    finally:
        if os.path.exists(part):
            os.unlink(part)
    return n


def inside(root: str, name: str) -> str:
    """The path of a relative name below root; a name that leads out is refused."""
    path = os.path.normpath(os.path.join(root, name))
    if not path.startswith(root.rstrip("/") + "/"):
        raise ValueError(f"{name} leads out of {root}")
    return path


class TreeWriter(DataSourceArrowWriter):
    """Takes each row's file to its place and counts; the committed counts are written to the option `report`."""

    def __init__(self, options: dict):
        self.root, self.report = plain(options["path"]), plain(options["report"])

    def take(self, row: dict, counts: Counter) -> None:
        """A row of (path, content)."""
        if row["content"] is None:
            counts["left_out"] += 1
            return
        counts["bytes"] += whole(inside(self.root, row["path"]), iter([row["content"]]))
        counts["written"] += 1

    def write(self, batches: Iterator[pa.RecordBatch]) -> Counted:
        counts: Counter = Counter()
        for batch in batches:
            for i in range(batch.num_rows):
                self.take(batch.slice(i, 1).to_pylist()[0], counts)
        return Counted(dict(counts))

    def commit(self, messages: list[Counted | None]) -> None:
        total: Counter = Counter()
        for m in messages:
            if m is not None:
                total.update(m.counts)
        whole(self.report, iter([json.dumps(total).encode()]))

    def abort(self, messages: list[Counted | None]) -> None:
        """Whole files stay, for the next run to find; unfinished ones are removed by their own tasks or by swept()."""


class ExtractionWriter(TreeWriter):
    """Takes members of archives to their places, or links to such places; faults are counted and leave nothing behind."""

    def take(self, row: dict, counts: Counter) -> None:
        try:
            target = inside(self.root, row["dest"])
            if row["link_to"] is not None:
                counts["linked"] += linked(inside(self.root, row["link_to"]), target)
                return
            if os.path.exists(target) and os.path.getsize(target) >= row["size"]:
                counts["skipped"] += 1
            else:
                with opened(row["archive"]) as f:
                    counts["bytes"] += whole(target, unpacked(f, row["header_at"], row["packed"], row["size"], row["method"], row["crc"]))
                counts["written"] += 1
            changed, dated = mended(target, row["taken_at"], row["lat"], row["lon"], row["named_at"])
            counts["repaired"] += changed
            counts["undated"] += not dated
        except (zipfile.BadZipFile, zlib.error, OSError, ValueError):
            counts["errors"] += 1


def linked(source: str, target: str) -> int:
    """A hard link, or a copy where there are no links; 0 if the target is there in the source's size."""
    if os.path.exists(target):
        if os.path.samefile(source, target) or os.path.getsize(source) == os.path.getsize(target):
            return 0
        os.unlink(target)
    os.makedirs(os.path.dirname(target), exist_ok=True)
    try:
        os.link(source, target)
    except (OSError, NotImplementedError):
        with open(source, "rb") as f:
            whole(target, iter(lambda: f.read(PIECE), b""))
        shutil.copystat(source, target)
    return 1


def mended(path: str, taken_at: datetime | None, lat: float | None, lon: float | None, named_at: datetime | None) -> tuple[bool, bool]:
    """Give a JPEG the date and place that its own metadata lack, and the file its time: (whether bytes changed, whether a date was given).

    What the file has wins. Only the head is read and made anew; compressed data are copied as they are.
    """
    own_date, changed = False, False
    if path.lower().endswith((".jpg", ".jpeg")):
        with open(path, "rb") as f:
            head, own_date, at = repaired_head(f, taken_at, lat, lon)
            if head is not None:
                f.seek(at)
                whole(path, (x for part in ([head], iter(lambda: f.read(PIECE), b"")) for x in part))
                changed = True
    stamp = taken_at or (None if own_date else named_at)
    if stamp is not None:
        seconds = stamp.replace(tzinfo=stamp.tzinfo or UTC).timestamp()
        os.utime(path, (seconds, seconds))
    return changed, stamp is not None


class FileTree(DataSource):
    """A folder of files as a sink for rows (path, content)."""

    @classmethod
    def name(cls) -> str:
        return "lantern_file_tree"

    def writer(self, schema, overwrite: bool) -> DataSourceArrowWriter:
        return TreeWriter(dict(self.options))


class Extraction(DataSource):
    """A folder as a sink for rows of extraction_rows()."""

    @classmethod
    def name(cls) -> str:
        return "lantern_extraction"

    def writer(self, schema, overwrite: bool) -> DataSourceArrowWriter:
        return ExtractionWriter(dict(self.options))


def _sent(rows: DataFrame, source: type[DataSource], path: str) -> dict[str, int]:
    spark = rows.sparkSession
    spark.dataSource.register(source)
    report = f"{shared_dir(spark)}/lantern-report-{uuid.uuid4().hex}.json"
    rows.write.format(source.name()).option("report", report).mode("append").save(path)
    counts = json.loads(spark.read.text(report, wholetext=True).first()[0])
    remove(spark, report)
    return counts


def write_tree(files: DataFrame, path: str) -> dict[str, int]:
    """Write files(path, content) below a folder that all executors share, each whole or not at all; rows without content are left out and counted.

    A rerun replaces files by the same name. Of rows with one path the last written stays: make paths unique first.
    """
    return _sent(files.select("path", "content"), FileTree, path)


# -- an import: plan, what is left of it, and its run


def import_plan(entries: DataFrame) -> DataFrame:
    """Rows for extract() from archive_entries(): a place for each media file, its sidecar's date and place, and links for equal copies.

    A path that several archives list counts once, from the first archive by name. Sidecars are found across archives
    and folders by archives.sidecar_cascade(), adopted() and shared(). Date of last resort is the file name's.
    """
    good = entries.where("error is null")
    first = F.row_number().over(Window.partitionBy("name").orderBy("archive", "header_at"))
    listed = written(good.withColumn("_n", first).where("_n = 1").drop("_n", "error"), "listed")
    is_sidecar = F.lower("name").endswith(".json")
    media = listed.where(~is_sidecar & media_type(basename(F.col("name"))).isNotNull())
    cars = listed.where(is_sidecar)
    own = archives.sidecar_cascade(media, cars).select("name", "sidecar")
    pairs = archives.shared(media, own.unionByName(archives.adopted(media, cars, own)))
    read = member_contents(cars.join(pairs.select(F.col("sidecar").alias("name")).distinct(), "name", "left_semi"))
    facts = read.select(F.col("name").alias("sidecar"), sidecar(F.decode("content", "UTF-8")).alias("_s")).select("sidecar", F.col("_s.taken_at").alias("taken_at"), F.col("_s.place.lat").alias("lat"), F.col("_s.place.lon").alias("lon"))
    plan = archives.extraction_plan(media)
    found = media.join(plan, "name").join(pairs, "name", "left").join(facts, "sidecar", "left")
    link = F.when(~F.col("is_primary"), F.col("primary_dest"))
    return written(found.select("archive", "name", "size", "crc", "packed", "method", "header_at", "dest", link.alias("link_to"), "taken_at", "lat", "lon", filename_datetime(basename(F.col("name"))).alias("named_at")), "import-plan")


def present(spark: SparkSession, path: str) -> DataFrame:
    """(dest, length) of the files below a folder, by a listing; empty where there is no folder."""
    if not os.path.isdir(plain(path)):
        return spark.createDataFrame([], "dest string, length long")
    found = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select("path", "length")
    return found.select(F.expr(f"substr(regexp_replace(path, '^file:(//)?(?=/)', ''), {len(plain(path).rstrip('/')) + 2})").alias("dest"), "length")


def remaining(plan: DataFrame, there: DataFrame) -> DataFrame:
    """The plan's rows that still have work: places where nothing lies in full size, and those that metadata may still mend."""
    full = plan.join(there.select("dest", "length"), "dest", "left")
    done = F.coalesce(F.col("length") >= F.col("size"), F.lit(False)) & F.col("taken_at").isNull() & F.col("lat").isNull()
    return full.where(~done).select(plan.columns)


def swept(spark: SparkSession, path: str) -> int:
    """Remove what killed tasks left below a folder; the number of files."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name in batch.column(0).to_pylist():
                os.unlink(inside(plain(path), name))
            yield batch

    return present(spark, path).where(F.col("dest").rlike(r"\.part-[0-9a-f]{32}$")).select("dest").mapInArrow(run, "dest string").count()


def extract(plan: DataFrame, path: str) -> dict[str, int]:
    """Run import_plan() into a folder that all executors share: counts of written, skipped, linked, repaired, undated, errors, bytes.

    What is there in full size is left alone, so a killed run is taken up where it ended. Members are dealt by archive
    and offset, whatever archive they are in. Links follow when all files are there. Too little free space is refused
    before anything is written.
    """
    spark, root = plan.sparkSession, plain(path)
    os.makedirs(root, exist_ok=True)
    swept(spark, path)
    left = written(remaining(plan, present(spark, path)), "import-left")
    missing = left.where("link_to is null").join(present(spark, path), "dest", "left").where("length is null or length < size").agg(F.coalesce(F.sum("size"), F.lit(0))).first()[0]
    if missing * SPARE > shutil.disk_usage(root).free:
        raise OSError(f"{missing} bytes needed in {path}, {shutil.disk_usage(root).free} free")
    counts: Counter = Counter(dict.fromkeys(("written", "skipped", "linked", "repaired", "undated", "errors", "bytes"), 0))
    tasks = max(1, -(-left.count() // FILES))  # by number: rows of few bytes that each stand for a file's work
    counts.update(_sent(left.where("link_to is null").repartitionByRange(tasks, "archive", "header_at"), Extraction, path))
    counts.update(_sent(left.where("link_to is not null").repartition(tasks, "link_to"), Extraction, path))
    return dict(counts)


def album_items(plan: DataFrame) -> DataFrame:
    """(album, dest) of the places that lie in an album's folder: what to add to albums once files have ids."""
    box = F.trim(container(F.col("name")))
    return plan.where(~is_year_bucket(box) & (box != "")).select(box.alias("album"), "dest").distinct()
