"""Archives by ranged reads and resumable extraction, against zipfile and after a kill."""

import datetime as dt
import hashlib
import io
import json
import os
import signal
import struct
import subprocess
import sys
import time
import zipfile

import pytest
from pyspark.sql import functions as F

from lantern.functions import images
from lantern.sources import files, zips

JPEG = b"\xff\xd8\xff\xe0\x00\x10JFIF\0\1\1\0\0\1\0\1\0\0\xff\xdb\x00\x04\0\1\xff\xda\x00\x04\1\2" + bytes(range(200)) * 300 + b"\xff\xd9"


def car(taken, **geo):
    return json.dumps({"photoTakenTime": {"timestamp": str(int(dt.datetime(taken, 5, 1, tzinfo=dt.UTC).timestamp()))}, "geoData": geo}).encode()


def tree(root):
    return {os.path.relpath(os.path.join(d, f), root): open(os.path.join(d, f), "rb").read() for d, _, names in os.walk(root) for f in names}


@pytest.fixture
def export(tmp_path):
    one, two = tmp_path / "part-1.zip", tmp_path / "part-2.zip"
    shared = JPEG + b"shared"
    with zipfile.ZipFile(one, "w", zipfile.ZIP_DEFLATED) as z:
        z.writestr("Takeout/Google Photos/Photos from 2021/lonely.jpg", JPEG)
        z.writestr("Takeout/Google Photos/Photos from 2021/shared.jpg", shared)
        z.writestr("Takeout/Google Photos/Photos from 2021/SHARED.jpg", b"\xff\xd8 broken head")
        z.writestr("Takeout/Google Photos/Photos from 2021/IMG_20190203_040506.png", b"png" * 1000)
        z.writestr("Takeout/Google Photos/readme.txt", b"none")
    with zipfile.ZipFile(two, "w", zipfile.ZIP_STORED) as z:
        z.writestr("Takeout/Google Photos/Goa Trip /shared.jpg", shared)
        z.writestr("Takeout/Google Photos/Goa Trip /shared.jpg.supplemental-metadata.json", car(2020, latitude=15.5, longitude=-73.25))
        z.writestr("Takeout/Google Photos/Photos from 2021/lonely.jpg.json", car(2011))
        z.writestr("Takeout/Google Photos/Photos from 2021/clip é.mp4", os.urandom(3 << 20))
        z.writestr("Takeout/Google Photos/Photos from 2021/", b"")
    return [str(one), str(two)]


def test_entries_equal_zipfile(spark, export, tmp_path):
    (tmp_path / "no.zip").write_bytes(b"PK\5\6 too short")
    (tmp_path / "front.zip").write_bytes(b"#!/bin/sh\n" * 999 + open(export[0], "rb").read())
    old = io.BytesIO()
    with zipfile.ZipFile(old, "w") as z:
        z.writestr("plain.jpg", b"x" * 10)
        z.comment = b"PK\5\6 in a comment" * 20
    raw = old.getvalue().replace(b"plain.jpg", b"pl\x84in.jpg")
    (tmp_path / "old.zip").write_bytes(raw)
    paths = [*export, *(str(tmp_path / n) for n in ("no.zip", "front.zip", "old.zip", "gone.zip"))]
    got = zips.archive_entries(spark, paths).collect()
    assert {(os.path.basename(r["archive"]), r["error"]) for r in got if r["error"]} == {("no.zip", "BadZipFile"), ("gone.zip", "FileNotFoundError")}
    for path in (*export, paths[3]):
        with zipfile.ZipFile(path) as z:
            expected = {(i.filename, i.file_size, i.CRC, i.compress_size, i.header_offset) for i in z.infolist() if not i.is_dir()}
        assert {(r["name"], r["size"], r["crc"], r["packed"], r["header_at"]) for r in got if r["archive"] == path} == expected
    assert [r["name"] for r in got if r["archive"].endswith("old.zip")] == ["pläin.jpg"]
    assert zips.archive_entries(spark, []).count() == 0


def test_large_archive_is_not_read(spark, tmp_path):
    size, name = 5 << 30, b"Photos from 2020/long.mp4"
    path = tmp_path / "large.zip"
    with open(path, "wb") as f:
        wide = struct.pack("<HHQQ", 1, 16, size, size)
        f.write(struct.pack("<4s5H3L2H", b"PK\3\4", 45, 0x800, 0, 0, 0, 7, 0xFFFFFFFF, 0xFFFFFFFF, len(name), len(wide)) + name + wide)
        f.seek(size, os.SEEK_CUR)
        start = f.tell()
        for i in range(20_000):
            extra = struct.pack("<HHQQ", 1, 16, size, size) if i == 0 else b""
            label, long = (name, 0xFFFFFFFF) if i == 0 else (b"Photos from 2020/%06d.jpg" % i, i)
            f.write(struct.pack("<4s6H3L5H2L", b"PK\1\2", 45, 45, 0x800, 0, 0, 0, 7, long, long, len(label), len(extra), 3, 0, 0, 0, 0) + label + extra + b"abc")
        end = f.tell()
        f.write(struct.pack("<4sQ2H2L4Q", b"PK\6\6", 44, 45, 45, 0, 0, 20_000, 20_000, end - start, start) + struct.pack("<4sLQL", b"PK\6\7", 0, end, 1))
        f.write(struct.pack("<4s4H2LH", b"PK\5\6", 0, 0, 0xFFFF, 0xFFFF, 0xFFFFFFFF, 0xFFFFFFFF, 0))
    assert os.stat(path).st_blocks * 512 < 64 << 20
    got = zips.archive_entries(spark, [str(path)])
    assert got.count() == 20_000 and got.where("error is not null").count() == 0
    assert got.where("name like '%long.mp4'").select("size", "packed", "header_at").first() == (size, size, 0)


def test_import_mends_and_links(spark, export, tmp_path):
    plan = zips.import_plan(zips.archive_entries(spark, export))
    root = str(tmp_path / "out")
    counts = zips.extract(plan, root)
    assert (counts["written"], counts["linked"], counts["errors"], counts["repaired"], counts["undated"]) == (5, 1, 0, 2, 2)
    got = tree(root)
    assert set(got) == {"Photos from 2021/lonely.jpg", "Photos from 2021/SHARED.jpg", "Photos from 2021/shared (2).jpg", "Photos from 2021/IMG_20190203_040506.png", "Photos from 2021/clip é.mp4", "Goa Trip/shared.jpg"}
    year = f"{root}/Photos from 2021"
    lonely, both = images.exif_fields(got["Photos from 2021/lonely.jpg"]), images.exif_fields(got["Photos from 2021/shared (2).jpg"])
    assert lonely["datetime"].startswith("2011:05:01") and both["datetime"].startswith("2020:") and (round(both["lat"], 4), round(both["lon"], 4)) == (15.5, -73.25)
    assert os.path.samefile(f"{year}/shared (2).jpg", f"{root}/Goa Trip/shared.jpg")
    assert got["Photos from 2021/lonely.jpg"].endswith(JPEG[24:]) and os.stat(f"{year}/lonely.jpg").st_mtime == dt.datetime(2011, 5, 1, tzinfo=dt.UTC).timestamp()
    assert os.stat(f"{year}/IMG_20190203_040506.png").st_mtime == dt.datetime(2019, 2, 3, 4, 5, 6, tzinfo=dt.UTC).timestamp()
    assert sorted(tuple(r) for r in zips.album_items(plan).collect()) == [("Goa Trip", "Goa Trip/shared.jpg")]
    # a rerun writes nothing and changes nothing
    before = {p: os.stat(f"{root}/{p}").st_ino for p in got}
    again = zips.extract(plan, root)
    assert (again["written"], again["linked"], again["repaired"], again["errors"]) == (0, 0, 0, 0) and tree(root) == got and before == {p: os.stat(f"{root}/{p}").st_ino for p in got}
    # metadata that come with a later part reach the file and its link
    early = str(tmp_path / "early")
    zips.extract(zips.import_plan(zips.archive_entries(spark, export[:1])), early)
    assert "datetime" not in images.exif_fields(tree(early)["Photos from 2021/lonely.jpg"])
    zips.extract(plan, early)
    assert tree(early) == got


def test_faults_and_leftovers(spark, export, tmp_path):
    plan, root = zips.import_plan(zips.archive_entries(spark, export)), str(tmp_path / "out")
    zips.extract(plan, str(tmp_path / "good"))
    data = bytearray(open(export[1], "rb").read())
    at = data.index(b"clip") + 100
    data[at : at + 4] = b"\0\0\0\0" if data[at : at + 4] != b"\0\0\0\0" else b"\1\1\1\1"
    kept = open(export[1], "rb").read()
    open(export[1], "wb").write(data)
    counts = zips.extract(plan, root)
    assert counts["errors"] == 1 and not any("clip" in p or ".part-" in p for p in tree(root))
    os.truncate(f"{root}/Photos from 2021/lonely.jpg", 50)
    open(f"{root}/Photos from 2021/x.jpg.part-" + "0" * 32, "wb").write(b"left by a killed task")
    open(export[1], "wb").write(kept)
    counts = zips.extract(plan, root)
    assert counts["written"] == 2 and tree(root) == tree(tmp_path / "good")
    bad = plan.limit(1).withColumn("dest", F.lit("../out.jpg"))
    assert zips.extract(bad, str(tmp_path / "else"))["errors"] == 1 and not os.path.exists(tmp_path / "out.jpg")


KILLED = """
import sys, time
sys.path.insert(0, sys.argv[3])
from lantern.session import get_session
from lantern.sources import zips
slow = zips.mended
zips.mended = lambda *a: (time.sleep(0.05), slow(*a))[1]
spark = get_session("local[2]", 2, "killed")
zips.extract(zips.import_plan(zips.archive_entries(spark, [sys.argv[1]])), sys.argv[2])
"""


def test_killed_run_is_taken_up(spark, tmp_path):
    path, root = tmp_path / "many.zip", tmp_path / "out"
    with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as z:
        for i in range(400):
            z.writestr(f"T/Photos from 2020/{i:04}.jpg", os.urandom(2000) + bytes(20_000))
    run = subprocess.Popen([sys.executable, "-c", KILLED, str(path), str(root), os.getcwd()], start_new_session=True, stdout=subprocess.DEVNULL, stderr=subprocess.DEVNULL)
    began = time.time()
    while time.time() - began < 90 and not (root.exists() and len(tree(root)) >= 20):
        time.sleep(0.05)
    os.killpg(run.pid, signal.SIGKILL)
    run.wait()
    seen = None
    while seen != (seen := sorted(tree(root))):  # its workers end when they next speak to the driver
        time.sleep(1.5)
    there = {p: os.stat(root / p).st_ino for p in tree(root) if ".part-" not in p}
    assert 20 <= len(there) < 400
    counts = zips.extract(zips.import_plan(zips.archive_entries(spark, [str(path)])), str(root))
    assert counts["written"] == 400 - len(there) and counts["errors"] == 0
    with zipfile.ZipFile(path) as z:
        assert tree(root) == {f"Photos from 2020/{i:04}.jpg": z.read(f"T/Photos from 2020/{i:04}.jpg") for i in range(400)}
    assert all(os.stat(root / p).st_ino == n for p, n in there.items())


def test_exif_is_merged_by_absent_fields():
    block = b"II*\0\x08\0\0\0" + struct.pack("<H", 2) + struct.pack("<HHII", 0x010F, 2, 6, 38) + struct.pack("<HHIHH", 0x0112, 3, 1, 6, 0) + b"\0\0\0\0" + b"Maker\0"
    with_block = images.with_exif(JPEG, block)
    assert images.exif_fields(with_block) == {"make": "Maker", "orientation": 6}
    head, dated, at = images.repaired_head(io.BytesIO(with_block), dt.datetime(2001, 2, 3), -1.5, 2.25)
    fixed = head + with_block[at:]
    found = images.exif_fields(fixed)
    assert not dated and found == {"make": "Maker", "orientation": 6, "datetime": "2001:02:03 00:00:00", "lat": -1.5, "lon": 2.25}
    assert images.repaired_head(io.BytesIO(fixed), dt.datetime(1999, 1, 1), 5.0, 5.0)[:2] == (None, True)
    assert images.repaired_head(io.BytesIO(b"no jpeg"), dt.datetime(1999, 1, 1), None, None) == (None, False, 0)


def test_ranged_hashes_and_heads(spark, tmp_path):
    clip, still = bytes(3 << 20) + b"end", b"\xff\xd8" + b"01234567-89AB-CDEF-0123-456789ABCDEF" + bytes(300_000) + b"AAAAAAAA-89AB-CDEF-0123-456789ABCDEF"
    for name, data in (("a.mov", clip), ("b.JPG", still), ("c.webp", still), ("d.mp4", b"tiny")):
        (tmp_path / name).write_bytes(data)
    paths = spark.createDataFrame([(f"file:{tmp_path}/{n}",) for n in ("a.mov", "b.JPG", "c.webp", "d.mp4", "gone.jpg")], "path string")
    digest = lambda x: hashlib.blake2b(x, digest_size=32).hexdigest()
    got = {os.path.basename(r[0]): r[1] for r in files.fingerprints(paths).collect()}
    size = str(len(clip)).encode()
    assert got == {"a.mov": "q:" + digest(size + clip[: 1 << 20] + clip[-(1 << 20) :]), "b.JPG": digest(still), "c.webp": digest(still), "d.mp4": "q:" + digest(b"4tiny"), "gone.jpg": None}
    assert {os.path.basename(r[0]): r[1] for r in files.full_fingerprints(paths).collect()}["a.mov"] == digest(clip)
    assert [tuple(r) for r in files.head_identifiers(files.still_heads(paths)).select("content_id").collect()] == [("01234567-89AB-CDEF-0123-456789ABCDEF",)]


def test_tree_writer(spark, tmp_path):
    rows = spark.createDataFrame([("a/b.bin", b"1"), ("c.bin", b""), ("gone.bin", None)], "path string, content binary").repartition(2)
    assert zips.write_tree(rows, f"file://{tmp_path}/t") == {"bytes": 1, "written": 2, "left_out": 1}
    assert tree(tmp_path / "t") == {"a/b.bin": b"1", "c.bin": b""}
