"""Queries that take an operator through all of its branches, with whole results, each with its SQL."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lantern.functions import dates
from lantern.operators import archives, changes, filters, library, places, relations
from lantern.plans.bindings import FILES_SQL, event_files, table
from lantern.plans.registry import query
from lantern.sources import media


def _text(*parts: Column | str) -> Column:
    """Columns as they are, strings as constants, joined."""
    return F.concat(*(F.lit(p) if isinstance(p, str) else p.cast("string") for p in parts))


# -- archives


# a folder for each document; residue 0 has a second sidecar that a later rule would take, 10 a stem too short, 11 two stems
@query(
    """WITH m AS (SELECT doc_id AS i, doc_id % 12 AS k, 'T/d' || doc_id || '/' AS f, 'Holiday_photo_' || doc_id || '(1).JPG' AS b,
 CASE doc_id % 3 WHEN 0 THEN '.supplemental-metadata.json' WHEN 1 THEN '.suppl.json' ELSE '.json' END AS s FROM documents)
 SELECT f || b AS name, CAST(k + 1 AS INTEGER) AS rule, CASE WHEN k < 3 THEN f || b || s WHEN k < 6 THEN f || upper(b || s) WHEN k < 9 THEN f || 'Holiday_photo_' || i || '.JPG(1)' || s ELSE f || 'HOLIDAY_PHOT.json' END AS sidecar
 FROM m WHERE k < 10"""
)
def sidecar_rules(spark: SparkSession, d: str) -> DataFrame:
    """All ten pairing rules, and what none of them pairs."""
    i = F.col("doc_id")
    k, folder, base = i % 12, _text("T/d", i, "/"), _text("Holiday_photo_", i, "(1).JPG")
    suffix = F.when(i % 3 == 0, ".supplemental-metadata.json").when(i % 3 == 1, ".suppl.json").otherwise(".json")
    moved = F.concat(_text("Holiday_photo_", i, ".JPG(1)"), suffix)
    own = (
        F.when(k < 3, F.concat(base, suffix))
        .when(k < 6, F.upper(F.concat(base, suffix)))
        .when(k < 9, moved)
        .when(k == 9, "HOLIDAY_PHOT.json")
        .when(k == 10, "Holiday_pho.json")
        .otherwise("Holiday_photo_.json")
    )
    more = F.when(k == 0, F.concat(base, F.lit(".json"))).when(k == 11, "Holiday_phot.json")
    rows = table(spark, d, "documents").select(F.concat(folder, base).alias("name"), F.array_compact(F.array(F.concat(folder, own), F.concat(folder, more))).alias("s"))
    return archives.sidecar_cascade(rows.select("name"), rows.select(F.explode("s").alias("name")))


@query(
    """WITH m AS (SELECT doc_id AS i, CASE WHEN doc_id % 3 = 0 THEN 'A' ELSE 'B' END AS root, CASE WHEN doc_id % 5 = 0 THEN 'Photos from ' || (2000 + doc_id % 20) ELSE 'Trip ' || doc_id % 7 END AS box,
 doc_id % 4 = 1 AS clip, doc_id % 90 AS crc, doc_id % 90 * 10 AS size FROM documents), u AS (SELECT DISTINCT crc, size FROM m)
 SELECT count(*) FILTER (NOT clip) AS photos, count(*) FILTER (clip) AS videos, count(DISTINCT box) AS containers, count(DISTINCT CASE WHEN box LIKE 'Trip%' THEN box END) AS albums,
 CAST((SELECT sum(size) FROM u) AS BIGINT) AS unique_bytes, count(*) - (SELECT count(*) FROM u) AS duplicate_paths, count(*) FILTER (i % 6 = 0) AS paired, count(*) FILTER (i % 6 <> 0) AS orphan_sidecars,
 (SELECT root FROM m GROUP BY root ORDER BY count(*) DESC, root DESC LIMIT 1) AS photos_root FROM m"""
)
def archive_figures(spark: SparkSession, d: str) -> DataFrame:
    """Totals of archives with photos, videos, year folders, albums and two roots."""
    i = F.col("doc_id")
    box = F.when(i % 5 == 0, _text("Photos from ", 2000 + i % 20)).otherwise(_text("Trip ", i % 7))
    name = F.concat(F.when(i % 3 == 0, "A/").otherwise("B/"), box, _text("/p", i), F.when(i % 4 == 1, ".mp4").otherwise(".jpg"))
    m = table(spark, d, "documents").select(i, name.alias("name"), (i % 90).alias("crc"), (i % 90 * 10).alias("size"), _text("S", i).alias("sidecar"))
    pairs = m.select("name", F.when(i % 6 == 0, F.col("sidecar")).alias("sidecar"))
    return archives.manifest_totals(m, pairs, m.select(F.col("sidecar").alias("name")))


# three names a group: x.jpg, X.JPG and the name that the second one's first counter would give
@query(
    """WITH f AS (SELECT page_id, page_id // 3 AS g, page_id % 3 AS v FROM pages), h AS (SELECT *, bool_or(v = 0) OVER (PARTITION BY g) AS first, bool_or(v = 2) OVER (PARTITION BY g) AS taken FROM f)
 SELECT page_id, CASE WHEN v = 0 THEN 'x' || g || '.jpg' WHEN v = 2 THEN 'x' || g || ' (2).jpg' WHEN NOT first THEN 'X' || g || '.JPG' WHEN taken THEN 'X' || g || ' (3).JPG' ELSE 'X' || g || ' (2).JPG' END AS unique_name FROM h"""
)
def clashing_names(spark: SparkSession, d: str) -> DataFrame:
    i = F.col("page_id")
    g = F.floor(i / 3)
    name = F.when(i % 3 == 0, _text("x", g, ".jpg")).when(i % 3 == 1, _text("X", g, ".JPG")).otherwise(_text("x", g, " (2).jpg"))
    return archives.unique_names(table(spark, d, "pages").select(i, name.alias("name")), "page_id", "name", "page_id").select("page_id", "unique_name")


@query("SELECT p_partkey, p_partkey % 200 > greatest(20, p_partkey * 7 % 5000 // 20) AS incomplete FROM part")
def incomplete_archives(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("p_partkey")
    return table(spark, d, "part").select(k, archives.looks_incomplete(k % 200, k * 7 % 5000).alias("incomplete"))


# -- places


PLACED_SQL = """p AS (SELECT c_custkey AS file_id, r_name AS country, CASE WHEN c_custkey % 9 <> 0 THEN n_name END AS city, c_custkey * 37 % 1009 AS taken_at
 FROM customer JOIN nation ON n_nationkey = c_nationkey JOIN region ON r_regionkey = n_regionkey),
 g AS (SELECT country, city, count(*) AS n, arg_max(file_id, (taken_at, file_id)) AS cover FROM p GROUP BY 1, 2)"""


def _summary(spark: SparkSession, d: str) -> DataFrame:
    c = table(spark, d, "customer").join(table(spark, d, "nation"), F.col("c_nationkey") == F.col("n_nationkey")).join(table(spark, d, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    k = F.col("c_custkey")
    return places.place_summary(c.select(k.alias("file_id"), F.col("r_name").alias("country"), F.when(k % 9 != 0, F.col("n_name")).alias("city"), (k * 37 % 1009).alias("taken_at")))


@query(
    f"""WITH {PLACED_SQL}, c AS (SELECT country, CAST(sum(n) AS BIGINT) AS count, arg_max(cover, (n, city IS NULL, cover)) AS cover FROM g GROUP BY 1)
 SELECT c.country, c.count, c.cover, row_number() OVER (PARTITION BY c.country ORDER BY g.n DESC, g.city) AS nth, g.city, g.n AS city_count, g.cover AS city_cover FROM c JOIN g ON g.country = c.country AND g.city IS NOT NULL"""
)
def place_city_lists(spark: SparkSession, d: str) -> DataFrame:
    """Every country with its whole list of cities, in order."""
    rows = _summary(spark, d).select("country", "count", "cover", F.posexplode("cities").alias("pos", "c"))
    return rows.select("country", "count", "cover", (F.col("pos") + 1).cast("long").alias("nth"), "c.city", F.col("c.count").alias("city_count"), F.col("c.cover").alias("city_cover"))


@query(
    f"""WITH {PLACED_SQL}, w AS (SELECT *, contains(lower(country), 'ia') AS whole FROM g)
 SELECT country, CAST(sum(n) AS BIGINT) AS count, string_agg(city, ',' ORDER BY n DESC, city) AS cities FROM w WHERE whole OR contains(lower(city), 'ia') GROUP BY country"""
)
def place_search(spark: SparkSession, d: str) -> DataFrame:
    """Countries that match whole, others with the cities that match and their count."""
    found = filters.searched_places(_summary(spark, d), "  IA ")
    return found.select("country", "count", F.array_join(F.transform("cities", lambda c: c["city"]), ",").alias("cities"))


@query(
    """WITH p AS (SELECT c_custkey, CAST(c_custkey * 37 % 179 - 89 AS DOUBLE) AS lat, CAST(c_custkey * 91 % 359 - 179 AS DOUBLE) AS lon, c_custkey % 50 AS n FROM customer),
 a AS (SELECT *, 2 * asin(sqrt(least(1, pow(sin(radians(48.0 - lat) / 2), 2) + cos(radians(lat)) * cos(radians(48.0)) * pow(sin(radians(11.5 - lon) / 2), 2)))) AS away FROM p)
 SELECT c_custkey, round(3.5 + sqrt(n / CAST((SELECT max(n) FROM p) AS DOUBLE)) * 9, 6) AS radius, round(least(1.0, greatest(0.15, (pi() / 2 - away) / 0.4)), 6) AS fade FROM a WHERE away <= pi() / 2 - 0.03"""
)
def globe_pins(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("c_custkey")
    points = table(spark, d, "customer").select(k, (k * 37 % 179 - 89).cast("double").alias("lat"), (k * 91 % 359 - 179).cast("double").alias("lon"), (k % 50).alias("n"))
    return places.visible_pins(points, 48.0, 11.5).select("c_custkey", F.round("radius", 6).alias("radius"), F.round("fade", 6).alias("fade"))


# -- details, jobs, persons, folders


@query(
    f"""WITH {FILES_SQL} SELECT f.file_id, CASE WHEN f.file_id % 3 = 0 THEN f.file_id % 100 END AS iso, CASE WHEN f.file_id % 3 = 0 THEN 'M' || f.file_id % 9 END AS make, CASE WHEN f.file_id % 4 = 1 THEN f.file_id + 1 END AS motion_file_id,
 CASE WHEN f.volume_id % 2 = 0 THEN 'V' || f.volume_id END AS label, CASE WHEN f.volume_id % 2 = 0 THEN f.volume_id % 4 = 0 END AS is_online, CASE WHEN f.file_id % 5 = 2 THEN 'c' || f.file_id % 6 END AS country FROM files f"""
)
def file_detail_full(spark: SparkSession, d: str) -> DataFrame:
    """A file's metadata, motion and volume beside its place and persons."""
    files = event_files(spark, d)
    i, v = F.col("file_id"), F.col("volume_id")
    metadata = files.where(i % 3 == 0).select(i, (i % 100).alias("iso"), _text("M", i % 9).alias("make"))
    motion = files.where(i % 4 == 1).select(i, (i + 1).alias("video_file_id"))
    volumes = files.select(v).distinct().where(v % 2 == 0).select(v, _text("V", v).alias("label"), F.lit("/mnt").alias("last_mount_path"), (v % 4 == 0).alias("is_online"))
    where = files.where(i % 5 == 2).select(i, _text("c", i % 6).alias("country"), F.lit("t").alias("city"))
    faces = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("file_id"), F.col("l_suppkey").alias("person_id"))
    persons = table(spark, d, "supplier").select(F.col("s_suppkey").alias("person_id"), F.col("s_name").alias("name"))
    out = library.full_detail(files.select("file_id", "volume_id"), where, faces, persons, metadata, motion, volumes)
    return out.select("file_id", "metadata.iso", "metadata.make", "motion_file_id", "volume.label", "volume.is_online", "place.country")


@query(
    """WITH j AS (SELECT event_id AS id, event_type AS kind, CASE WHEN event_id % 11 = 0 THEN 'running' ELSE 'done' END AS status FROM events UNION ALL SELECT event_id + 100000000, event_type, 'running' FROM events WHERE user_id % 97 = 1)
 SELECT max(id) AS id, kind, arg_max(status, id) AS status FROM j GROUP BY kind"""
)
def latest_jobs(spark: SparkSession, d: str) -> DataFrame:
    """History merged with live jobs: every eleventh job is in both, some are live only."""
    i = F.col("event_id")
    e = table(spark, d, "events")
    history = e.select(i.alias("id"), F.col("event_type").alias("kind"), F.lit("done").alias("status"))
    live = e.where(i % 11 == 0).select(i.alias("id"), F.col("event_type").alias("kind"), F.lit("running").alias("status"))
    late = e.where("user_id % 97 = 1").select((i + 100_000_000).alias("id"), F.col("event_type").alias("kind"), F.lit("running").alias("status"))
    return relations.latest_jobs(history, live.unionByName(late))


@query("SELECT l_orderkey AS file_id, count(*) AS faces, CAST(0 AS BIGINT) AS assigned, CAST(0 AS BIGINT) AS sources FROM lineitem GROUP BY 1")
def reset_faces(spark: SparkSession, d: str) -> DataFrame:
    faces = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("file_id"), F.col("l_suppkey").alias("person_id"), F.lit("manual").alias("assign_src"))
    freed, none = changes.reset_persons(faces, table(spark, d, "supplier"))
    left = none.agg(F.count("*").alias("_persons"))  # one row
    return freed.groupBy("file_id").agg(F.count("*").alias("faces"), F.count("person_id").alias("assigned"), F.count("assign_src").alias("sources")).crossJoin(left).select("file_id", "faces", (F.col("assigned") + F.col("_persons")).alias("assigned"), "sources")


LISTING_SQL = "l AS (SELECT page_id AS n, CASE page_id % 5 WHEN 0 THEN 'dir' || page_id % 50 || '/x.jpg' WHEN 1 THEN 'Sub' || page_id % 20 || '/y/z.mov' WHEN 2 THEN 'pic' || page_id || '.JPG' WHEN 3 THEN 'Arc' || page_id || '.ZIP' ELSE '.h' || page_id || '.zip' END AS p FROM pages)"


def _listing(spark: SparkSession, d: str) -> DataFrame:
    i = F.col("page_id")
    path = F.when(i % 5 == 0, _text("dir", i % 50, "/x.jpg")).when(i % 5 == 1, _text("Sub", i % 20, "/y/z.mov")).when(i % 5 == 2, _text("pic", i, ".JPG")).when(i % 5 == 3, _text("Arc", i, ".ZIP")).otherwise(_text(".h", i, ".zip"))
    return table(spark, d, "pages").select(F.concat(F.lit("Root/"), path).alias("rel_path"), i.alias("size_bytes"))


@query(
    f"""WITH {LISTING_SQL} SELECT DISTINCT 'dir' AS kind, string_split(p, '/')[1] AS name, 'Root/' || string_split(p, '/')[1] AS path, CAST(NULL AS BIGINT) AS size, lower(string_split(p, '/')[1]) AS sort_key FROM l WHERE contains(p, '/')
 UNION ALL SELECT 'zip', p, 'Root/' || p, n, lower(p) FROM l WHERE n % 5 = 3"""
)
def browse_folder(spark: SparkSession, d: str) -> DataFrame:
    """Folders and archives right below one, hidden names aside, with the key of the order whatever the case."""
    return media.browse(_listing(spark, d), "Root", zips=True)


@query(f"WITH {LISTING_SQL} SELECT count(*) FILTER (n % 5 = 2) AS media_count FROM l")
def media_in_folder(spark: SparkSession, d: str) -> DataFrame:
    return media.media_here(_listing(spark, d), "Root")


# -- dates, coordinates, sizes


AT_SQL = "o AS (SELECT o_orderkey, o_orderdate + to_seconds(o_orderkey % 86400) AS shot FROM orders)"


def _moments(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("o_orderkey")
    return table(spark, d, "orders").select(k, F.timestamp_seconds(F.unix_seconds(F.col("o_orderdate").cast("timestamp")) + k % 86400).alias("at"))


@query(f"WITH {AT_SQL} SELECT o_orderkey, CASE o_orderkey % 6 WHEN 2 THEN date_trunc('minute', shot) WHEN 4 THEN NULL WHEN 5 THEN NULL ELSE shot END AS taken_at FROM o")
def exif_forms(spark: SparkSession, d: str) -> DataFrame:
    """The four forms of a date, one with a fraction behind it, a year out of range and a month that is none."""
    k, at = F.col("o_orderkey") % 6, F.col("at")
    text = (
        F.when(k == 0, F.concat(F.date_format(at, "yyyy:MM:dd HH:mm:ss"), F.lit(".123")))
        .when(k == 1, F.date_format(at, "yyyy-MM-dd HH:mm:ss"))
        .when(k == 2, F.date_format(at, "yyyy:MM:dd HH:mm"))
        .when(k == 3, F.date_format(at, "yyyy-MM-dd'T'HH:mm:ss"))
        .when(k == 4, F.concat(F.lit("1979"), F.date_format(at, ":MM:dd HH:mm:ss")))
        .otherwise(F.date_format(at, "yyyy:13:dd HH:mm:ss"))
    )
    return _moments(spark, d).select("o_orderkey", dates.exif_datetime(text).cast("timestamp_ntz").alias("taken_at"))


@query(f"WITH {AT_SQL} SELECT o_orderkey, CASE WHEN o_orderkey % 6 < 2 THEN shot WHEN o_orderkey % 6 < 5 THEN date_trunc('day', shot) END AS taken_at FROM o")
def filename_forms(spark: SparkSession, d: str) -> DataFrame:
    """The four patterns of a file name, a bad match that falls to the next pattern, and a name without a date."""
    k, at = F.col("o_orderkey") % 6, F.col("at")
    name = (
        F.when(k == 0, F.date_format(at, "'IMG_'yyyyMMdd_HHmmss'.jpg'"))
        .when(k == 1, F.date_format(at, "'Shot 'yyyy-MM-dd HH.mm.ss'.png'"))
        .when(k == 2, F.date_format(at, "'IMG-'yyyyMMdd'-WA1.jpg'"))
        .when(k == 3, F.date_format(at, "'a 'yyyy-MM-dd' b.jpg'"))
        .when(k == 4, F.date_format(at, "'19999999_999999 'yyyy-MM-dd'.jpg'"))
        .otherwise(_text("IMG_", F.col("o_orderkey"), ".jpg"))
    )
    return _moments(spark, d).select("o_orderkey", dates.filename_datetime(name).cast("timestamp_ntz").alias("taken_at"))


@query("SELECT c_custkey, CASE WHEN c_custkey % 4 < 2 THEN CAST(c_custkey % 80 + 0.25 AS DOUBLE) END AS lat, CASE WHEN c_custkey % 4 < 2 THEN CAST(-(c_custkey % 170) - 0.5 AS DOUBLE) END AS lon FROM customer")
def coordinate_strings(spark: SparkSession, d: str) -> DataFrame:
    """Coordinates with and without an altitude, the null island, and a latitude out of range."""
    k = F.col("c_custkey")
    here = F.format_string("%+08.4f%+09.4f", (k % 80 + 0.25).cast("double"), (-(k % 170) - 0.5).cast("double"))
    text = F.when(k % 4 == 0, F.concat(here, F.lit("/"))).when(k % 4 == 1, F.concat(here, F.lit("+012.5/"))).when(k % 4 == 2, "+00.0000+000.0000/").otherwise("+95.0+010.0/")
    at = dates.iso6709(text)
    return table(spark, d, "customer").select("c_custkey", at["lat"].alias("lat"), at["lon"].alias("lon"))


@query("SELECT p_partkey, CASE WHEN p_partkey % 10 BETWEEN 5 AND 8 AND p_partkey % 11 <> 0 THEN p_partkey ELSE p_size END AS width, CASE WHEN p_partkey % 10 BETWEEN 5 AND 8 AND p_partkey % 11 <> 0 THEN p_size ELSE p_partkey END AS height FROM part")
def oriented_sizes(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("p_partkey")
    size = dates.oriented(F.col("p_size").cast("long"), k, F.when(k % 11 != 0, k % 10))
    return table(spark, d, "part").select("p_partkey", size["width"].alias("width"), size["height"].alias("height"))


@query(
    """SELECT o_orderkey, CASE o_orderkey % 5 WHEN 0 THEN '1/' || (o_orderkey % 900 + 2) WHEN 1 THEN (o_orderkey % 90 + 1) || '.25' WHEN 2 THEN CAST((o_orderkey % 9 + 1) * 100000 AS VARCHAR) WHEN 3 THEN (o_orderkey % 9 + 1) || 'e+06' END AS label FROM orders"""
)
def exposure_forms(spark: SparkSession, d: str) -> DataFrame:
    """Fractions, decimals, six whole digits, powers of ten and nulls."""
    k = F.col("o_orderkey")
    seconds = F.when(k % 5 == 0, 1 / (k % 900 + 2)).when(k % 5 == 1, k % 90 + 1.25).when(k % 5 == 2, (k % 9 + 1) * 100000.0).when(k % 5 == 3, (k % 9 + 1) * 1000000.0)
    return table(spark, d, "orders").select("o_orderkey", dates.exposure_label(seconds).alias("label"))
