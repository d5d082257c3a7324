"""Operators whose results SQL on the driver tables does not cover: small tables with known answers."""

import datetime as dt
import io
import math
import zipfile

import numpy as np
import pytest
from pyspark.sql import functions as F

from lantern.functions import dates, images, names
from lantern.operators import archives, changes, clusters, duplicates, filters, places, relations, sessions, timeline, vectors
from lantern.sources import files as sources
from lantern.sources.zips import archive_entries
from lantern.sources import media
from lantern.streaming import ranges, rescan


def values(frame, *columns):
    return sorted(tuple(r[c] for c in columns) for r in frame.select(*columns).collect())


def one(spark, *columns):
    return spark.range(1).select(*columns).head()


def test_filters_compose(spark):
    t = dt.datetime(2024, 1, 5, 12)
    files = spark.createDataFrame([(i, "photo" if i % 2 else "video", "missing" if i == 7 else "active", None if i == 6 else t) for i in range(1, 10)], "file_id long, media_type string, status string, taken_at timestamp_ntz")
    ids = lambda rows, s: spark.createDataFrame(rows, s)
    catalog = filters.Catalog(
        files, ids([(1,)], "file_id long"), ids([(2, "screenshot"), (3, "photo")], "file_id long, kind string"), ids([(5, 4), (9, None)], "file_id long, video_file_id long"),
        ids([(3, 1), (3, 2), (5, 1), (8, None)], "file_id long, person_id long"), ids([(3, "IN", "Pune"), (5, "IN", None)], "file_id long, country string, city string"), ids([(2, 10)], "file_id long, album_id long"),
    )
    seen = lambda **k: [r[0] for r in values(filters.apply_filter(catalog, filters.FilterSpec(**k)), "file_id")]
    assert seen() == [3, 5, 8, 9]  # 1 locked, 2 screenshot, 4 a clip, 6 undated, 7 missing
    assert seen(kind="any") == [2] and seen(kind="screenshot") == [2] and seen(kind="document") == []
    assert seen(album_id=10) == [2]  # curated grids show every kind
    assert seen(person_id=1) == [3, 5] and seen(person_id=1, solo=True) == [5]
    assert seen(country="IN") == [3, 5] and seen(country="IN", city="Pune") == [3] and seen(city="Pune") == [3, 5, 8, 9]
    assert seen(live=True) == [5, 9] and seen(media_type="video") == [8] and seen(media_type="other") == [3, 5, 8, 9]
    assert seen(day="2024-01-05") == [3, 5, 8, 9] and seen(day="2024-01-06") == []


def test_paths_have_no_wildcards(spark):
    roots = spark.createDataFrame([(1, 0, "a_b"), (2, 0, "a_b/c"), (3, 0, "")], "root_id long, volume_id long, rel_path string")
    files = spark.createDataFrame([(1, 0, "a_b/x.jpg"), (2, 0, "aXb/x.jpg"), (3, 0, "a_b/c/y.jpg")], "file_id long, volume_id long, rel_path string")
    assert values(relations.roots_of_files(files, roots), "file_id", "root_id") == [(1, 1), (1, 3), (2, 3), (3, 1), (3, 2), (3, 3)]
    assert values(relations.doomed_files(files, roots.where("root_id < 3"), 1), "file_id") == [(1,)]
    mounts = spark.createDataFrame([(1, "/"), (2, "/mnt/a")], "volume_id long, mount string").withColumn("mount", F.regexp_replace("mount", "/$", ""))
    paths = spark.createDataFrame([("/mnt/a/x",), ("/mnt/ab",)], "path string")
    assert values(relations.longest_prefix(paths, mounts), "path", "volume_id") == [("/mnt/a/x", 2), ("/mnt/ab", 1)]


def test_sessions_break_after_the_gap_only(spark):
    rows = [(1, 0), (2, 21600), (3, 43201), (4, 200000), (5, 200001), (6, 200002)]
    found = sessions.gap_sessions(spark.createDataFrame(rows, "file_id long, ts long"))
    assert values(found, "file_id", "session") == [(1, 0), (2, 0), (3, 43201), (4, 200000), (5, 200000), (6, 200000)]
    bounds = sessions.session_bounds(found.withColumn("k", F.lit(1)), ["k"])
    assert values(bounds, "session", "n", "cover") == [(200000, 3, 5)]


def test_near_groups_and_dismissals(spark):
    rows = [(1, 0), (2, 0), (3, 1), (4, 0b111), (5, -1), (6, -2), (7, 1 << 40)]
    hashes = spark.createDataFrame(rows, "file_id long, h long")
    assert values(duplicates.near_groups(hashes, 2), "file_id", "group_id") == [(1, 1), (2, 1), (3, 1), (4, 1), (5, 5), (6, 5), (7, 1)]
    dismissed = spark.createDataFrame([(5, 6)], "a long, b long")
    assert values(duplicates.near_groups(hashes, 1, dismissed), "file_id", "group_id") == [(1, 1), (2, 1), (3, 1), (7, 1)]
    rng = np.random.default_rng(5)
    h = np.unique(rng.integers(-(2**63), 2**63 - 1, 40))
    h = np.unique(np.concatenate([h, h ^ (1 << rng.integers(0, 62, len(h))), h ^ 0b1011]))
    brute = sorted((int(a), int(b), int(n)) for i, a in enumerate(h) for b in h[i + 1 :] if (n := int(np.bitwise_count(np.uint64(int(a) & (2**64 - 1)) ^ np.uint64(int(b) & (2**64 - 1))))) <= 8)
    assert values(duplicates.near_pairs(spark.createDataFrame([(int(x),) for x in h], "h long"), 8), "a", "b", "distance") == brute


def test_dismissals_among_copies_against_brute_force(spark):
    rng = np.random.default_rng(9)
    h = [int(x) for x in rng.choice([0, 1, 7, 1 << 20, 1 << 21, -1, -2], 40)]
    pairs = sorted({tuple(sorted(int(x) for x in rng.choice(40, 2, replace=False))) for _ in range(60)} | {(i, j) for i in range(40) for j in range(i) if h[i] == h[j] == 7 for i, j in [(j, i)]})
    root = list(range(40))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    linked = set()
    for i in range(40):
        for j in range(i + 1, 40):
            if ((h[i] ^ h[j]) & (2**64 - 1)).bit_count() <= 1 and (i, j) not in pairs:
                a, b = sorted((find(i), find(j)))
                root[b] = a
                linked |= {i, j}
    got = duplicates.near_groups(spark.createDataFrame(list(enumerate(h)), "file_id long, h long"), 1, spark.createDataFrame(pairs, "a long, b long"))
    assert values(got, "file_id", "group_id") == [(i, find(i)) for i in sorted(linked)]


def test_merged_clusters_keep_names_apart(spark):
    big = 1 << 60
    pairs = spark.createDataFrame([(1, 2, 0.9), (3, 2, 0.8), (3, 4, 0.7), (1, 2, 0.9), (big + 1, big + 3, 0.6), (5, 5, 1.0)], "a long, b long, similarity double")
    names = spark.createDataFrame([(1, "Ann"), (4, "Bob"), (2, None), (99, "Cy")], "cluster long, name string")
    assert values(vectors.merged_clusters(pairs, names), "cluster", "merged") == [(1, 1), (2, 1), (3, 1), (4, 4), (big + 1, big + 1), (big + 3, big + 1)]
    assert vectors.merged_clusters(pairs.limit(0), names).isEmpty()


def test_far_points_against_brute_force(spark):
    rng = np.random.default_rng(4)
    points = [(i, float(a), float(b)) for i, (a, b) in enumerate(zip(rng.uniform(-90, 90, 30), rng.uniform(-180, 180, 30), strict=True))]
    cities = [(i, float(a), float(b)) for i, (a, b) in enumerate(zip(rng.uniform(-90, 90, 40), rng.uniform(-180, 180, 40), strict=True))]
    cities += [(i + 100, a, b) for i, a, b in cities]
    km = lambda p, c: 2 * places.EARTH_KM * math.asin(math.sqrt(math.sin(math.radians(c[1] - p[1]) / 2) ** 2 + math.cos(math.radians(p[1])) * math.cos(math.radians(c[1])) * math.sin(math.radians(c[2] - p[2]) / 2) ** 2))
    expected = [(p[0], min((round(km(p, c), 6), c[0]) for c in cities)[1]) for p in points]
    frames = spark.createDataFrame(points, "id long, lat double, lon double"), spark.createDataFrame(cities, "city_id long, lat double, lon double")
    for size in (64 << 20, 480):
        assert values(places.nearest_city(*frames, size), "id", "city_id") == expected
    assert places.nearest_city(frames[0], frames[1].limit(0)).isEmpty()


def test_sidecar_rules(spark):
    media = ["T/P/a.jpg", "T/P/B.JPG", "T/P/c(1).jpg", "T/P/a_very_long_file_name.jpg", "T/P/none.jpg", "T/Trip/a.jpg"]
    cars = ["T/P/a.jpg.json", "T/P/b.jpg.suppl.json", "T/P/c.jpg(1).json", "T/P/a_very_long_fi.json", "T/X/none.jpg.json"]
    m = spark.createDataFrame([(n, 5 if n.endswith("/a.jpg") else i, 10) for i, n in enumerate(media)], "name string, crc long, size long")
    s = spark.createDataFrame([(n,) for n in cars], "name string")
    paired = archives.sidecar_cascade(m, s)
    assert values(paired, "name", "sidecar") == sorted(zip([media[0], media[1], media[2], media[3]], cars, strict=False))
    assert values(archives.adopted(m, s, paired), "name", "sidecar") == [(media[4], cars[4])]
    assert dict(values(archives.shared(m, paired), "name", "sidecar"))["T/Trip/a.jpg"] == cars[0]
    plan = {r["name"]: r for r in archives.extraction_plan(m).collect()}
    assert not plan["T/Trip/a.jpg"]["is_primary"] or not plan["T/P/a.jpg"]["is_primary"]


def test_names(spark):
    n = lambda f, x: one(spark, f(F.lit(x)).alias("x"))["x"]
    assert n(names.safe_name, "../a:b?.jpg ") == "a_b_.jpg" and n(names.safe_name, " .. ") == "file"
    assert n(names.safe_component, "con.txt") == "_con.txt" and n(names.safe_component, "cone") == "cone"
    assert n(names.media_type, "A.JPG") == "photo" and n(names.media_type, "x.mts") == "video" and n(names.media_type, ".jpg") is None
    assert n(names.shard, 257) == "01" and n(names.is_year_bucket, "Fotos von 2024 ") and not n(names.is_year_bucket, "Trip")
    k = lambda name, w, h, c: one(spark, names.kind(F.lit(name), F.lit(w), F.lit(h), F.lit(c)).alias("x"))["x"]
    assert k("Screenshot_1.png", 10, 10, "Canon")["confidence"] == 0.99 and k("a.png", 1179, 2556, "Canon") is None
    assert k("a.png", 2556, 1179, None)["confidence"] == 0.97 and k("a.png", 644, 1352, None)["confidence"] == 0.9
    assert k("my-scan.pdf", None, None, None)["kind"] == "document" and k("scanner.jpg", 10, 0, "") is None
    assert n(names.byte_label, 1536) == "1.5 KB" and n(names.duration_label, 3661.2) == "1:01:01"


def test_dates(spark):
    n = lambda f, x: one(spark, f(F.lit(x)).alias("x"))["x"]
    assert n(dates.exif_datetime, "2019:06:01 12:34:56") == dt.datetime(2019, 6, 1, 12, 34, 56) and n(dates.exif_datetime, "1970:01:01 00:00:00") is None
    assert n(dates.filename_datetime, "IMG_20190601_123456.jpg") == dt.datetime(2019, 6, 1, 12, 34, 56)
    assert n(dates.filename_datetime, "IMG-20190601-WA0001.jpg") == dt.datetime(2019, 6, 1) and n(dates.filename_datetime, "x20191399y") is None
    assert n(dates.iso6709, "+37.3349-122.0090+000.000/")["lon"] == -122.009 and n(dates.iso6709, "+0-0/") is None
    assert n(dates.video_datetime, "2020-01-01T02:00:00+02:00") == dt.datetime(2020, 1, 1) and n(dates.video_datetime, "junk") is None
    assert n(dates.exposure_label, 0.004) == "1/250" and n(dates.exposure_label, 2.5) == "2.5"
    assert n(dates.to_dms, 15.2993) == [15.0, 17.0, 57.48]
    assert one(spark, dates.from_dms(F.array(F.lit(10.0), F.lit(30.0), F.lit(0.0)), F.lit("S"), "S").alias("x"))["x"] == -10.5


def test_exif_round_trip():
    jpeg = b"\xff\xd8\xff\xe0\x00\x04ab\xff\xe1\x00\x08Exif\0\0\xff\xdb\x00\x03q\xff\xda\x00\x02scan\xff\xd9"
    out = images.with_exif(jpeg, images.exif_payload(dt.datetime(2011, 3, 13, 7, 6, 40), 15.2993, -74.124))
    found = images.exif_fields(out)
    assert found["datetime"] == "2011:03:13 07:06:40" and abs(found["lat"] - 15.2993) < 1e-6 and abs(found["lon"] + 74.124) < 1e-6
    assert out.endswith(jpeg[jpeg.index(b"\xff\xda") :]) and out.count(b"Exif\0\0") == 1 and out[2:4] == b"\xff\xe0"
    with pytest.raises(ValueError):
        images.with_exif(b"GIF89a", b"")


def test_pixels(spark):
    rng = np.random.default_rng(0)
    grey = rng.integers(0, 255, (32, 32)).astype(float)
    assert images.sharpness(grey) > images.sharpness(np.cumsum(np.cumsum(grey, 0), 1) / 1000) and images.sharpness(np.zeros((7, 9))) is None
    brighter = images.perceptual_hash(grey * 0.5 + 20)
    assert images.perceptual_hash(grey) == brighter
    frame = spark.createDataFrame([([int(x) for x in grey.ravel()], 32), (None, 3)], "pixels array<int>, width int")
    got = [r["s"] for r in frame.select(images.sharpness_column(F.col("pixels"), F.col("width")).alias("s")).collect()]
    assert abs(got[0] - images.sharpness(grey)) < 1 and got[1] is None


def test_sources(spark, tmp_path):
    (tmp_path / "lib/.hidden").mkdir(parents=True)
    (tmp_path / "lib/a.jpg").write_bytes(b"x" * 10 + b"01234567-89AB-CDEF-0123-456789ABCDEF")
    (tmp_path / "lib/b.mov").write_bytes(b"y")
    (tmp_path / "lib/.hidden/c.jpg").write_bytes(b"z")
    (tmp_path / "lib/d.txt").write_bytes(b"z")
    root = f"file://{tmp_path}/lib"
    assert values(sources.listing(spark, root), "rel_path", "media_type", "size_bytes") == [("a.jpg", "photo", 46), ("b.mov", "video", 1)]
    data = sources.contents(spark, root)
    assert values(sources.head_identifiers(data), "content_id") == [("01234567-89AB-CDEF-0123-456789ABCDEF",)]
    hashes = {p.rsplit("/", 1)[1]: h for p, h in values(sources.fingerprints(data), "path", "content_hash")}
    assert hashes["b.mov"].startswith("q:") and len(hashes["a.jpg"]) == 64
    with zipfile.ZipFile(tmp_path / "1.zip", "w") as z:
        z.writestr("T/P/a.jpg", b"abc")
        z.writestr("T/P/a.jpg.json", b"{}")
    (tmp_path / "2.zip").write_bytes(b"no")
    zips = [f"{tmp_path}/1.zip", f"{tmp_path}/2.zip"]
    found = {(r["archive"].rsplit("/", 1)[1], r["name"], r["size"], r["error"]) for r in archive_entries(spark, zips).collect()}
    assert found == {("1.zip", "T/P/a.jpg", 3, None), ("1.zip", "T/P/a.jpg.json", 2, None), ("2.zip", None, None, "BadZipFile")}
    text = '{"photoTakenTime":{"timestamp":"1600000000"},"geoData":{"latitude":0,"longitude":0},"geoDataExif":{"latitude":15.2993,"longitude":74.124}}'
    got = one(spark, sources.sidecar(F.lit(text)).alias("x"))["x"]
    assert got["taken_at"] == dt.datetime(2020, 9, 13, 12, 26, 40) and got["place"]["lat"] == 15.2993
    assert one(spark, sources.sidecar(F.lit("broken")).alias("x"))["x"]["taken_at"] is None
    assert bytes(one(spark, sources.byte_range(F.lit(b"abcdef"), 1, 3).alias("x"))["x"]) == b"bcd" and one(spark, sources.byte_range(F.lit(b"ab"), 2, None).alias("x"))["x"] is None


def test_hdbscan_finds_planted_clusters(spark):
    rng = np.random.default_rng(1)
    points = np.concatenate([rng.normal(c, 0.05, (20, 8)) for c in (0, 3, -3)] + [rng.uniform(-10, 10, (5, 8))])
    frame = spark.createDataFrame([(i, [float(x) for x in p]) for i, p in enumerate(points)], "vec_id long, embedding array<double>")
    labels = np.array([r[1] for r in values(clusters.hdbscan(frame), "vec_id", "cluster")])
    assert [len(set(labels[i : i + 20])) for i in (0, 20, 40)] == [1, 1, 1] and len(set(labels[:60])) == 3 and -1 not in labels[:60]
    near = clusters.reduced(frame, 5)
    assert near.select(F.size("embedding").alias("n")).distinct().collect()[0]["n"] == 5 and [r[1] for r in values(clusters.hdbscan(near), "vec_id", "cluster")][:60] == labels[:60].tolist()


def test_cluster_merging_respects_names():
    pairs = [(1, 2, 0.9), (2, 3, 0.8), (3, 4, 0.7)]
    assert vectors.merge_clusters(pairs, {1: "Ann", 4: "Bob"}) == {1: 1, 2: 1, 3: 1, 4: 4}


def test_polygons(spark):
    square = [(0.0, 0.0), (10.0, 0.0), (10.0, 10.0), (0.0, 10.0)]
    hole = [(4.0, 4.0), (6.0, 4.0), (6.0, 6.0), (4.0, 6.0)]
    points = spark.createDataFrame([(1, 5.0, 1.0), (2, 5.0, 5.0), (3, 50.0, 5.0)], "id long, lat double, lon double")
    assert values(places.points_in_polygons(points, [("S", [square, hole])]), "id", "name") == [(1, "S"), (2, None), (3, None)]


def test_changes(spark):
    t = spark.createDataFrame([(1, "a"), (2, "b")], "k long, v string")
    patch = spark.createDataFrame([(2, None), (1, "z")], "k long, v string")
    assert values(changes.patched(t, patch, ["k"]), "k", "v") == [(1, "z"), (2, "b")]
    items = spark.createDataFrame([(1, 5, 0), (1, 6, 1)], "album_id long, file_id long, position long")
    order = spark.createDataFrame([(1, [6, 5])], "album_id long, ids array<long>")
    assert values(changes.reordered(items, order, "album_id"), "file_id", "position") == [(5, 1), (6, 0)]
    persons = spark.createDataFrame([(1, "Ann"), (2, None), (3, None)], "person_id long, name string")
    faces = spark.createDataFrame([(1, 3), (2, None)], "face_id long, person_id long")
    assert values(changes.orphans(persons, faces), "person_id") == [(1,), (2,)] and values(changes.orphans(persons, faces, True), "person_id") == [(2,)]
    albums = spark.createDataFrame([(1, 5), (2, 9)], "album_id long, cover long")
    out = changes.cascade_delete(spark.createDataFrame([(5,)], "file_id long"), {"items": items}, {"albums": (albums, "cover")})
    assert values(out["items"], "file_id") == [(6,)] and values(out["albums"].na.fill(-1), "album_id", "cover") == [(1, -1), (2, 9)]


def test_stream_keeps_the_catalog(spark, tmp_path):
    schema = "k long, v long"
    seen = []
    for batch in ([(1, 1), (1, 2), (2, 1)], [(2, 5), (3, 1)]):
        spark.createDataFrame(batch, schema).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        query = rescan.keep_catalog(rescan.listing_stream(spark, f"{tmp_path}/in", schema), f"{tmp_path}/catalog", ["k"], "v", f"{tmp_path}/check", None)
        query.awaitTermination()
        seen.append(values(ranges.read_ranges(spark, f"{tmp_path}/catalog"), "k", "v"))
    assert seen == [[(1, 2), (2, 1)], [(1, 2), (2, 5), (3, 1)]]


def test_photo_and_face_records(spark):
    def decode(data):
        if len(data) < 100:
            raise ValueError("short")
        return np.frombuffer(data[-10_000:], np.uint8).reshape(100, 100)

    pixels = np.random.default_rng(0).integers(0, 256, 10_000, dtype=np.uint8).tobytes()
    jpeg = images.with_exif(b"\xff\xd8\xff\xda\x00\x02", images.exif_payload(dt.datetime(2011, 3, 13, 7, 6, 40), 15.0, 74.0)) + pixels
    frame = spark.createDataFrame([(1, pixels), (2, jpeg), (3, b"no"), (4, None)], "file_id long, content binary")
    got = {r["file_id"]: r for r in media.photo_records(frame, decode).collect()}
    assert got[1]["ok"] and got[1]["width"] == 100 and got[1]["phash"] == got[2]["phash"] and got[2]["datetime"] == "2011:03:13 07:06:40" and got[2]["lat"] == 15.0
    assert not got[3]["ok"] and got[3]["error"] == "ValueError: short" and got[3]["content_hash"] and not got[4]["ok"]
    load = lambda: lambda data: [{"x": 0.1, "y": 0.2, "w": 0.3, "h": 0.4, "det_score": 0.9, "embedding": [1.0, 0.0]}] * (len(data) > 100)
    assert values(media.detected_faces(frame, load), "file_id", "det_score") == [(1, 0.9), (2, 0.9)]
    boxes = np.array([[0, 0, 10, 10], [1, 0, 11, 10], [20, 20, 30, 30]], float)
    assert media.overlaps_left_out(boxes, np.array([0.5, 0.9, 0.1])).tolist() == [1, 2]
    assert np.allclose(images.shrunk(np.arange(16.0).reshape(4, 4), 2), [[2.5, 4.5], [10.5, 12.5]])


def test_archive_parts_settings_and_gazetteer(spark, tmp_path):
    files = spark.createDataFrame([(f"{i}.jpg", bytes([i]) * 100) for i in range(5)] + [("gone.jpg", None)], "name string, content binary").coalesce(1)
    parts = media.zip_parts(files, 250).collect()
    assert [r["n_files"] for r in parts] == [3, 2]
    found = {n: z.read(n) for r in parts for z in [zipfile.ZipFile(io.BytesIO(bytes(r["archive"])))] for n in z.namelist()}
    assert found == {f"{i}.jpg": bytes([i]) * 100 for i in range(5)}
    table = spark.createDataFrame([("gap", "5"), ("other", "1")], "key string, value string")
    assert media.settings(table, {"gap": "6", "day": "1"}) == {"gap": "5", "day": "1"}
    (tmp_path / "c.csv").write_text("lat,lon,name,admin1,admin2,cc\n28.6,77.2,Delhi,DL,,IN\n")
    assert values(media.gazetteer(spark, f"file://{tmp_path}/c.csv"), "city", "country_code") == [("Delhi", "IN")]
    assert values(media.folder_children(spark.createDataFrame([("a/b/x.jpg",), ("a/y.jpg",), ("a/c/z.jpg",), ("q.jpg",)], "rel_path string"), "a"), "name", "files") == [("b", 1), ("c", 1)]


def test_extraction_never_gives_two_media_one_place(spark):
    media = spark.createDataFrame([(n, i, 1) for i, n in enumerate(["T/Trip/a.jpg", "U/Trip/a.jpg", "V/Trip/a (2).jpg", "W/trip/A.jpg", "T/Photos from 2020/a.jpg"])], "name string, crc long, size long")
    got = [r["dest"] for r in archives.extraction_plan(media).collect()]
    assert len({g.lower() for g in got}) == 5 and "Trip/a.jpg" in got and "Trip/a (2).jpg" in got and "Photos from 2020/a.jpg" in got


def test_rail_ticks_keep_their_distance(spark):
    days = spark.sql("select explode(sequence(date'1950-03-01', date'2024-06-01', interval 100 days)) as day")
    got = [r["frac"] for r in timeline.rail_ticks(days).orderBy("frac").collect()]
    assert got[0] < 0.05 and all(b - a >= 0.045 for a, b in zip(got, got[1:], strict=False)) and len(got) > 10
    months = spark.sql("select explode(sequence(date'2024-01-15', date'2024-06-01', interval 1 day)) as day")
    assert [r["label"] for r in timeline.rail_ticks(months).orderBy("frac").collect()] == ["Jun", "May", "Apr", "Mar", "Feb", "Jan"]


def test_labels_of_six_digits(spark):
    values = [None, 0.0, 0.4, 0.004, 1.0, 1.3, 30.0, 123.4567891, 999999.5, 1e6, 1234567.0, 100000.0, 9.9999996, -2.5]
    got = [r["x"] for r in spark.createDataFrame([(v,) for v in values], "v double").select(dates.exposure_label(F.col("v")).alias("x")).collect()]
    assert got == [None if v is None else f"1/{round(1 / v)}" if 0 < v < 1 else f"{v:g}" for v in values]


def test_live_jobs_win_and_empty_searches_keep_all(spark):
    history = spark.createDataFrame([(1, "scan", "done"), (2, "scan", "done"), (3, "faces", "failed")], "id long, kind string, status string")
    live = spark.createDataFrame([(2, "scan", "running"), (4, "faces", "running")], history.schema)
    assert {tuple(r) for r in relations.latest_jobs(history, live).collect()} == {(2, "scan", "running"), (4, "faces", "running")}
    assert {tuple(r) for r in relations.latest_jobs(history, live.limit(0)).collect()} == {(2, "scan", "done"), (3, "faces", "failed")}
    summary = spark.createDataFrame([("Spain", 5, [("Cadiz", 3, 1)]), ("Chad", 2, None)], "country string, count long, cities array<struct<city:string,count:long,cover:long>>")
    assert filters.searched_places(summary, "  ").count() == 2
    assert [(r["country"], r["count"]) for r in filters.searched_places(summary, "cad").collect()] == [("Spain", 3)]
    assert [(r["country"], r["count"]) for r in filters.searched_places(summary, "CHA").collect()] == [("Chad", 2)]
