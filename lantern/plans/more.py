"""Further queries of the catalogue: the rest of the filters, changes, joins, figures and string operators, each with its SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lantern.functions import dates, names
from lantern.operators import archives, changes, details, filters, library, places, relations, timeline, vectors
from lantern.plans.bindings import FILES_SQL, event_files, event_locked, table
from lantern.plans.registry import query
from lantern.sources import files as sources

# -- filters


@query(f"WITH {FILES_SQL} SELECT file_id FROM visible WHERE file_id % 10 = 4")
def filter_live(spark: SparkSession, d: str) -> DataFrame:
    files = event_files(spark, d)
    motion = files.where("file_id % 10 = 4").select("file_id", (F.col("file_id") + 1).alias("video_file_id"))
    return filters.apply_filter(filters.Catalog(files, event_locked(spark, d), motion=motion), filters.FilterSpec(live=True)).select("file_id")


@query(f"WITH {FILES_SQL} SELECT file_id FROM visible WHERE file_id % 4 = 0 AND file_id % 3 = 0")
def filter_any_special_kind(spark: SparkSession, d: str) -> DataFrame:
    files = event_files(spark, d)
    kinds = files.where("file_id % 4 = 0").select("file_id", F.when(F.col("file_id") % 3 == 0, "document").otherwise("photo").alias("kind"))
    return filters.apply_filter(filters.Catalog(files, event_locked(spark, d), kinds=kinds), filters.FilterSpec(kind="any")).select("file_id")


def _placed(spark: SparkSession, d: str) -> filters.Catalog:
    """event_files with every third a screenshot, places, albums and events by arithmetic."""
    files = event_files(spark, d)
    i = F.col("file_id")
    return filters.Catalog(
        files,
        event_locked(spark, d),
        kinds=files.where(i % 3 == 0).select("file_id", F.lit("screenshot").alias("kind")),
        places=files.where(i % 2 == 1).select("file_id", F.concat(F.lit("c"), (i % 5).cast("string")).alias("country"), F.concat(F.lit("t"), (i % 4).cast("string")).alias("city")),
        album_items=files.where(i % 6 < 4).select((i % 6).alias("album_id"), "file_id"),
        event_items=files.select((i % 9).alias("event_id"), "file_id"),
    )


# a place is a curated view: screenshots stay in it
@query(f"WITH {FILES_SQL} SELECT file_id FROM visible WHERE file_id % 2 = 1 AND file_id % 5 = 2 AND file_id % 4 = 3")
def filter_place(spark: SparkSession, d: str) -> DataFrame:
    return filters.apply_filter(_placed(spark, d), filters.FilterSpec(country="c2", city="t3")).select("file_id")


@query(f"WITH {FILES_SQL} SELECT file_id FROM visible WHERE file_id % 6 = 3")
def filter_album(spark: SparkSession, d: str) -> DataFrame:
    return filters.apply_filter(_placed(spark, d), filters.FilterSpec(album_id=3)).select("file_id")


# an event is no curated view: screenshots leave it
@query(f"WITH {FILES_SQL} SELECT file_id FROM visible WHERE file_id % 9 = 4 AND file_id % 3 <> 0 AND media_type = 'video'")
def filter_event(spark: SparkSession, d: str) -> DataFrame:
    return filters.apply_filter(_placed(spark, d), filters.FilterSpec(event_id=4, media_type="video")).select("file_id")


@query(f"WITH {FILES_SQL} SELECT file_id FROM files WHERE status = 'missing' AND file_id % 3 = 0")
def missing_subset(spark: SparkSession, d: str) -> DataFrame:
    files = event_files(spark, d)
    return filters.missing_files(files, files.where("file_id % 3 = 0").select("file_id")).select("file_id")


@query(f"WITH {FILES_SQL} SELECT file_id FROM files WHERE status = 'missing'")
def missing_all(spark: SparkSession, d: str) -> DataFrame:
    return filters.missing_files(event_files(spark, d)).select("file_id")


@query("SELECT c_custkey, c_name FROM customer WHERE contains(lower(c_name), '#00000001')")
def search_names(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "customer").where(filters.contains_text(F.col("c_name"), "  #00000001 ")).select("c_custkey", "c_name")


PATHS_SQL = "p AS (SELECT page_id, regexp_replace(url, '^https?://', '') AS path FROM pages)"


@query(f"WITH {PATHS_SQL} SELECT page_id FROM p WHERE path = string_split(path, '/')[1] || '/' || string_split(path, '/')[2] OR starts_with(path, string_split(path, '/')[1] || '/' || substr(string_split(path, '/')[2], 1, 3) || '/')")
def below_path(spark: SparkSession, d: str) -> DataFrame:
    p = table(spark, d, "pages").select("page_id", F.regexp_replace("url", "^https?://", "").alias("path"))
    host, first = F.split("path", "/")[0], F.split("path", "/")[1]
    at = filters.under_path(F.col("path"), F.concat_ws("/", host, F.substring(first, 1, 3)))
    return p.where(at | (F.col("path") == F.concat_ws("/", host, first))).select("page_id")


@query(f"WITH {FILES_SQL} SELECT file_id, taken_at FROM visible WHERE (taken_at, file_id) < (TIMESTAMP '2024-01-10 12:00:00', 5000) ORDER BY taken_at DESC, file_id DESC LIMIT 150")
def timeline_page_after(spark: SparkSession, d: str) -> DataFrame:
    seen = filters.visible_files(event_files(spark, d), event_locked(spark, d)).select("file_id", "taken_at")
    return timeline.page_after(seen, F.lit("2024-01-10 12:00:00").cast("timestamp_ntz"), F.lit(5000), 150)


@query(f"WITH {FILES_SQL}, b AS (SELECT DISTINCT CAST(taken_at AS DATE) AS day FROM visible) SELECT arg_min(day, (abs(day - DATE '2024-03-11'), day)) AS day FROM b")
def nearest_bucket(spark: SparkSession, d: str) -> DataFrame:
    buckets = timeline.day_buckets(filters.visible_files(event_files(spark, d), event_locked(spark, d)))
    return timeline.nearest_bucket(buckets, F.to_date(F.lit("2024-03-11")))


@query(
    """WITH e AS (SELECT max(CAST(o_orderdate AS DATE)) AS n, min(CAST(o_orderdate AS DATE)) AS o FROM orders),
 y AS (SELECT unnest(range(extract(year FROM o), extract(year FROM n) + 1)) AS y, n, o FROM e)
 SELECT CAST(y AS VARCHAR) AS label, round((n - greatest(o, make_date(y, 1, 1))) / CAST(n - o AS DOUBLE), 6) AS frac FROM y"""
)
def rail_ticks(spark: SparkSession, d: str) -> DataFrame:
    return timeline.rail_ticks(table(spark, d, "orders").select(F.to_date("o_orderdate").alias("day"))).withColumn("frac", F.round("frac", 6))


# -- changes


@query("SELECT o_orderkey AS k, CASE WHEN o_orderkey % 4 = 0 AND o_orderkey % 8 <> 0 THEN 'p' || o_custkey ELSE o_orderstatus END AS status, CASE WHEN o_orderkey % 4 = 0 THEN -o_totalprice ELSE o_totalprice END AS price FROM orders")
def patch_coalesce(spark: SparkSession, d: str) -> DataFrame:
    o = table(spark, d, "orders").select(F.col("o_orderkey").alias("k"), F.col("o_orderstatus").alias("status"), F.col("o_totalprice").alias("price"), "o_custkey")
    patch = o.where("k % 4 = 0").select("k", F.when(F.col("k") % 8 != 0, F.concat(F.lit("p"), F.col("o_custkey").cast("string"))).alias("status"), (-F.col("price")).alias("price"))
    return changes.patched(o.drop("o_custkey"), patch, ["k"])


@query(
    """WITH i AS (SELECT o_custkey AS album_id, o_orderkey AS file_id, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) - 1 AS position FROM orders)
 SELECT album_id, file_id, CASE WHEN album_id % 2 = 0 THEN row_number() OVER (PARTITION BY album_id ORDER BY file_id DESC) - 1 ELSE position END AS position FROM i"""
)
def reorder_positions(spark: SparkSession, d: str) -> DataFrame:
    lists = table(spark, d, "orders").groupBy(F.col("o_custkey").alias("album_id")).agg(F.array_sort(F.collect_list("o_orderkey")).alias("ids"))
    items = lists.select("album_id", F.posexplode("ids").alias("position", "file_id")).select("album_id", "file_id", F.col("position").cast("long").alias("position"))
    return changes.reordered(items, lists.where("album_id % 2 = 0").select("album_id", F.reverse("ids").alias("ids")), "album_id")


@query("SELECT o_custkey AS person_id, CASE WHEN o_orderkey % 10 <> 3 THEN o_orderkey END AS cover FROM orders")
def cascade_set_null(spark: SparkSession, d: str) -> DataFrame:
    o = table(spark, d, "orders")
    doomed = o.where("o_orderkey % 10 = 3").select(F.col("o_orderkey").alias("file_id"))
    persons = o.select(F.col("o_custkey").alias("person_id"), F.col("o_orderkey").alias("cover"))
    return changes.cascade_delete(doomed, {}, {"persons": (persons, "cover")})["persons"]


@query("SELECT c_custkey AS person_id, CASE WHEN c_custkey % 2 = 0 THEN c_name END AS name FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderkey % 3 <> 0 AND o_custkey % 5 <> 0) AND c_custkey % 2 = 1")
def orphan_persons(spark: SparkSession, d: str) -> DataFrame:
    persons = table(spark, d, "customer").select(F.col("c_custkey").alias("person_id"), F.when(F.col("c_custkey") % 2 == 0, F.col("c_name")).alias("name"))
    return changes.orphans(persons, table(spark, d, "orders").select(F.when((F.col("o_orderkey") % 3 != 0) & (F.col("o_custkey") % 5 != 0), F.col("o_custkey")).alias("person_id")), unnamed_only=True)


@query("SELECT o_orderkey AS face_id, CASE WHEN o_custkey = 5 THEN 7 ELSE o_custkey END AS person_id FROM orders")
def merge_persons(spark: SparkSession, d: str) -> DataFrame:
    faces = table(spark, d, "orders").select(F.col("o_orderkey").alias("face_id"), F.col("o_custkey").alias("person_id"))
    return changes.merged_persons(faces, 5, 7)


# -- joins


@query(
    """SELECT c_custkey AS id, CASE WHEN x >= 10 AND x < 40 AND y >= -20 AND y < 20 AND NOT (x >= 20 AND x < 30 AND y >= -5 AND y < 5) THEN 'ring' WHEN x > 50 AND y > 0 AND x + y < 90 THEN 'wedge' END AS name
 FROM (SELECT c_custkey, c_custkey * 91 % 181 - 90.5 AS x, c_custkey * 37 % 121 - 60.25 AS y FROM customer)"""
)
def polygon_names(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("c_custkey")
    points = table(spark, d, "customer").select(k.alias("id"), (k * 37 % 121 - 60.25).alias("lat"), (k * 91 % 181 - 90.5).alias("lon"))
    ring = [[(10, -20), (40, -20), (40, 20), (10, 20)], [(20, -5), (30, -5), (30, 5), (20, 5)]]
    return places.points_in_polygons(points, [("ring", ring), ("wedge", [[(50, 0), (90, 0), (50, 40)]])]).select("id", "name")


@query(
    f"""WITH {PATHS_SQL}, m AS (SELECT DISTINCT string_split(path, '/')[1] AS mount, 1 AS volume_id FROM p UNION ALL SELECT DISTINCT string_split(path, '/')[1] || '/' || string_split(path, '/')[2], 2 FROM p WHERE page_id % 2 = 0)
 SELECT path, CAST(arg_max(volume_id, (length(mount), volume_id)) AS INTEGER) AS volume_id FROM (SELECT DISTINCT path FROM p) JOIN m ON path = mount OR starts_with(path, mount || '/') GROUP BY path"""
)
def longest_mount(spark: SparkSession, d: str) -> DataFrame:
    p = table(spark, d, "pages").select("page_id", F.regexp_replace("url", "^https?://", "").alias("path"))
    host, first = F.split("path", "/")[0], F.split("path", "/")[1]
    mounts = p.select(host.alias("mount"), F.lit(1).alias("volume_id")).unionByName(p.where("page_id % 2 = 0").select(F.concat_ws("/", host, first).alias("mount"), F.lit(2).alias("volume_id"))).distinct()
    return relations.longest_prefix(p, mounts)


@query("WITH s AS (SELECT CASE WHEN doc_id % 3 = 0 THEN 'B/IMG_' || doc_id || '.jpg.json' ELSE 'B/same.jpg.json' END AS sidecar, doc_id FROM documents) SELECT 'A/IMG_' || doc_id || '.jpg' AS name, sidecar FROM s WHERE doc_id % 3 = 0 AND doc_id % 6 <> 0")
def adopted_sidecars(spark: SparkSession, d: str) -> DataFrame:
    i = F.col("doc_id")
    own = F.concat(F.lit("IMG_"), i.cast("string"), F.lit(".jpg"))
    rows = table(spark, d, "documents").select(i, F.concat(F.lit("A/"), own).alias("name"), F.when(i % 3 == 0, F.concat(F.lit("B/"), own, F.lit(".json"))).otherwise(F.lit("B/same.jpg.json")).alias("sidecar"))
    paired = rows.where("doc_id % 6 = 0").select("name", "sidecar")
    return archives.adopted(rows.select("name"), rows.select(F.col("sidecar").alias("name")).distinct(), paired)


@query(
    """WITH f AS (SELECT l_orderkey * 10 + l_linenumber AS face_id, l_orderkey AS file_id, CASE WHEN l_linenumber <> 4 THEN l_suppkey END AS person_id, l_discount + 0.5 AS det, l_quantity AS w, l_quantity * 4 AS h FROM lineitem),
 n AS (SELECT file_id, count(*) AS n FROM f GROUP BY 1)
 SELECT person_id, arg_max(face_id, (det * sqrt(w * h) * CASE WHEN n = 1 THEN 1.5 ELSE 1.0 END, -face_id)) AS cover_face_id FROM f JOIN n USING (file_id) WHERE person_id IS NOT NULL GROUP BY 1"""
)
def cover_faces(spark: SparkSession, d: str) -> DataFrame:
    faces = table(spark, d, "lineitem").select((F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("face_id"), F.col("l_orderkey").alias("file_id"), F.when(F.col("l_linenumber") != 4, F.col("l_suppkey")).alias("person_id"), (F.col("l_discount") + 0.5).alias("det_score"), F.col("l_quantity").alias("w"), (F.col("l_quantity") * 4).alias("h"))
    return vectors.cover_faces(faces)


# -- figures


@query(f"WITH {FILES_SQL} SELECT (SELECT count(*) FROM files WHERE file_id % 10 IN (4, 6)) AS live, (SELECT count(*) FROM files WHERE file_id % 3 = 0 AND (file_id - 1) % 10 NOT IN (4, 6)) AS unpaired, (SELECT count(*) FROM files WHERE file_id % 3 = 1) AS unchecked")
def motion_summary(spark: SparkSession, d: str) -> DataFrame:
    files = event_files(spark, d)
    i = F.col("file_id")
    motion = files.where(i % 2 == 0).select("file_id", F.when((i % 10).isin(4, 6), i + 1).alias("video_file_id"))
    pending = files.select("file_id", F.when(i % 3 == 0, "id").when(i % 3 == 2, "").alias("content_id"))
    return library.motion_summary(files, motion, pending)


@query(
    f"""WITH {FILES_SQL}, seen AS (SELECT * FROM files WHERE status = 'active' AND file_id NOT IN (SELECT file_id FROM locked)),
 motion AS (SELECT file_id, file_id + 1 AS clip FROM files WHERE file_id % 10 = 4), faces AS (SELECT l_orderkey AS file_id, CASE WHEN l_linenumber % 4 <> 0 THEN l_suppkey END AS person_id FROM lineitem)
 SELECT (SELECT count(*) FROM seen WHERE media_type = 'photo' AND file_id NOT IN (SELECT clip FROM motion)) AS photos, (SELECT count(*) FROM seen WHERE media_type = 'video' AND file_id NOT IN (SELECT clip FROM motion)) AS videos,
 (SELECT count(*) FROM files WHERE status = 'missing') AS missing, (SELECT count(*) FROM files WHERE status = 'active' AND media_type = 'photo' AND file_id % 3 <> 0) AS face_pending,
 (SELECT count(*) FROM customer WHERE c_acctbal > 0) AS with_gps, (SELECT count(*) FROM customer) AS geocoded, (SELECT count(*) FROM faces) AS faces, (SELECT count(*) FROM motion WHERE file_id IN (SELECT file_id FROM seen)) AS live,
 (SELECT count(*) FROM supplier WHERE s_suppkey % 4 = 0) AS persons, (SELECT count(*) FROM supplier WHERE s_suppkey % 5 <> 0 AND s_suppkey IN (SELECT person_id FROM faces WHERE file_id IN (SELECT file_id FROM seen))) AS people_visible,
 CAST((SELECT sum(p_size) FROM part WHERE p_partkey % 3 = 0) AS BIGINT) AS db_bytes, CAST((SELECT sum(p_size) FROM part WHERE p_partkey % 3 = 1) AS BIGINT) AS thumbs_bytes, CAST((SELECT sum(p_size) FROM part WHERE p_partkey % 3 = 2) AS BIGINT) AS previews_bytes, true AS face_model_ready"""
)
def full_stats(spark: SparkSession, d: str) -> DataFrame:
    files = event_files(spark, d).withColumn("face_scanned", F.col("file_id") % 3 == 0)
    motion = files.where("file_id % 10 = 4").select("file_id", (F.col("file_id") + 1).alias("video_file_id"))
    c = table(spark, d, "customer").select(F.when(F.col("c_acctbal") > 0, F.col("c_acctbal")).alias("gps_lat"))
    faces = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("file_id"), F.when(F.col("l_linenumber") % 4 != 0, F.col("l_suppkey")).alias("person_id"))
    persons = table(spark, d, "supplier").select(F.col("s_suppkey").alias("person_id"), F.when(F.col("s_suppkey") % 4 == 0, F.col("s_name")).alias("name"), (F.col("s_suppkey") % 5 == 0).alias("is_hidden"))
    areas = F.element_at(F.array(F.lit("db"), F.lit("thumbs"), F.lit("previews")), (F.col("p_partkey") % 3 + 1).cast("int"))
    sizes = table(spark, d, "part").select(areas.alias("area"), F.col("p_size").alias("bytes"))
    return library.full_stats(files, event_locked(spark, d), motion, c, c, faces, persons, sizes, ready=True)


@query(f"WITH {PATHS_SQL}, q AS (SELECT string_split(path, '/') AS s, page_id FROM p), x AS (SELECT array_to_string(s[1:n], '/') AS folder, page_id FROM q, range(0, 60) t(n) WHERE n < len(s)) SELECT folder, count(*) AS files, CAST(sum(page_id) AS BIGINT) AS bytes FROM x GROUP BY 1")
def folder_sizes(spark: SparkSession, d: str) -> DataFrame:
    return details.folder_sizes(table(spark, d, "pages").select(F.regexp_replace("url", "^https?://", "").alias("rel_path"), F.col("page_id").alias("size_bytes")))


# -- details and lists


@query(f"WITH {FILES_SQL} SELECT file_id, media_type, width, height, file_id * 7 % 1000 AS position FROM files WHERE status = 'active' AND file_id NOT IN (SELECT file_id FROM locked) AND file_id % 6 = 2")
def album_detail(spark: SparkSession, d: str) -> DataFrame:
    files = event_files(spark, d)
    items = files.select((F.col("file_id") % 6).alias("album_id"), "file_id", (F.col("file_id") * 7 % 1000).alias("position"))
    return details.album_items(items, files, event_locked(spark, d), 2)


@query(f"WITH {FILES_SQL} SELECT file_id, media_type, width, height, taken_at, CAST(taken_at AS DATE) AS day FROM files WHERE status = 'active' AND file_id IN (SELECT file_id FROM locked)")
def locked_items(spark: SparkSession, d: str) -> DataFrame:
    return details.locked_items(event_files(spark, d), event_locked(spark, d))


@query("SELECT n_nationkey AS root_id, n_regionkey AS volume_id, CASE WHEN n_nationkey % 4 = 0 THEN '' ELSE n_name END AS rel_path, CASE WHEN n_nationkey % 4 = 0 THEN m WHEN m = '/' THEN '/' || n_name ELSE m || '/' || n_name END AS abs_path FROM nation JOIN (SELECT r_regionkey, CASE r_regionkey WHEN 0 THEN '?' WHEN 1 THEN '/' ELSE '/mnt/' || r_name END AS m FROM region) ON r_regionkey = n_regionkey")
def root_paths(spark: SparkSession, d: str) -> DataFrame:
    roots = table(spark, d, "nation").select(F.col("n_nationkey").alias("root_id"), F.col("n_regionkey").alias("volume_id"), F.when(F.col("n_nationkey") % 4 == 0, "").otherwise(F.col("n_name")).alias("rel_path"))
    volumes = table(spark, d, "region").select(F.col("r_regionkey").alias("volume_id"), F.when(F.col("r_regionkey") == 1, "/").when(F.col("r_regionkey") > 1, F.concat(F.lit("/mnt/"), F.col("r_name"))).alias("mount"))
    return details.root_paths(roots, volumes)


@query("SELECT c_custkey, round(c_acctbal, 2) AS c_acctbal, row_number() OVER (ORDER BY c_mktsegment DESC, c_acctbal DESC, c_custkey) AS nth FROM customer ORDER BY nth LIMIT 50")
def people_sorted(spark: SparkSession, d: str) -> DataFrame:
    from pyspark.sql import Window

    top = details.sorted_list(table(spark, d, "customer"), ["c_mktsegment", "c_acctbal"], "c_custkey").limit(50)  # a first screen of the list
    nth = F.row_number().over(Window.orderBy(F.desc("c_mktsegment"), F.desc("c_acctbal"), "c_custkey"))
    return top.select("c_custkey", F.round("c_acctbal", 2).alias("c_acctbal"), nth.cast("long").alias("nth"))


@query("SELECT o_orderkey, array_to_string(CASE WHEN o_orderkey % 3 = 0 THEN [o_orderstatus] WHEN o_orderstatus = o_orderpriority[1:1] THEN [o_orderstatus] ELSE [o_orderstatus, o_orderpriority[1:1]] END, ',') AS names FROM orders")
def names_touched(spark: SparkSession, d: str) -> DataFrame:
    new = F.when(F.col("o_orderkey") % 3 != 0, F.substring("o_orderpriority", 1, 1))
    return table(spark, d, "orders").select("o_orderkey", F.array_join(details.names_touched(F.col("o_orderstatus"), new), ",").alias("names"))


@query("SELECT c_custkey, coalesce(CASE WHEN n_nationkey % 2 = 0 THEN n_name END, 'C' || c_nationkey) AS country FROM customer JOIN nation ON n_nationkey = c_nationkey")
def country_names(spark: SparkSession, d: str) -> DataFrame:
    code = lambda k: F.concat(F.lit("C"), F.col(k).cast("string")).alias("country_code")
    known = table(spark, d, "nation").where("n_nationkey % 2 = 0").select(code("n_nationkey"), F.col("n_name").alias("name"))
    return details.with_country_names(table(spark, d, "customer").select("c_custkey", code("c_nationkey")), known).select("c_custkey", "country")


@query(
    """WITH w AS (SELECT l_orderkey AS file_id, string_agg(DISTINCT l_suppkey || ':' || s_name, ',' ORDER BY l_suppkey || ':' || s_name) AS persons FROM lineitem JOIN supplier ON s_suppkey = l_suppkey WHERE l_linenumber % 4 <> 0 GROUP BY 1)
 SELECT o_orderkey AS file_id, CASE WHEN o_orderkey % 2 = 0 THEN o_orderstatus || '/' || o_orderpriority END AS place, coalesce(persons, '') AS persons FROM orders LEFT JOIN w ON file_id = o_orderkey"""
)
def file_detail(spark: SparkSession, d: str) -> DataFrame:
    o = table(spark, d, "orders").withColumnRenamed("o_orderkey", "file_id")
    where = o.where("file_id % 2 = 0").select("file_id", F.col("o_orderstatus").alias("country"), F.col("o_orderpriority").alias("city"))
    faces = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("file_id"), F.when(F.col("l_linenumber") % 4 != 0, F.col("l_suppkey")).alias("person_id"))
    persons = table(spark, d, "supplier").select(F.col("s_suppkey").alias("person_id"), F.col("s_name").alias("name"))
    out = library.file_detail(o.select("file_id"), where, faces, persons)
    listed = F.array_join(F.array_sort(F.transform("persons", lambda p: F.concat_ws(":", p["person_id"].cast("string"), p["name"]))), ",")
    return out.select("file_id", F.concat(F.col("place.country"), F.lit("/"), F.col("place.city")).alias("place"), listed.alias("persons"))


# -- strings, dates, labels


@query("SELECT c_custkey, round(CASE WHEN c_custkey % 3 = 0 THEN -1 ELSE 1 END * (c_custkey % 90 + (c_custkey % 60) / 60.0 + (c_custkey % 7) / 3600.0), 8) + 0.0 AS lat FROM customer")
def dms_decimal(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("c_custkey")
    parts = F.array((k % 90).cast("double"), (k % 60).cast("double"), (k % 7).cast("double"))
    return table(spark, d, "customer").select("c_custkey", (F.round(dates.from_dms(parts, F.when(k % 3 == 0, "S").otherwise("N"), "S"), 8) + F.lit(0.0)).alias("lat"))


@query("SELECT c_custkey, CAST(c_custkey % 180 AS DOUBLE) AS degrees, CAST((c_custkey % 4) * 15 AS DOUBLE) AS minutes, CAST(22.5 AS DOUBLE) AS seconds FROM customer")
def decimal_dms(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("c_custkey")
    value = -((k % 180) + (k % 4) * 0.25 + F.lit(0.00625))  # 0.00625 degrees are 22.5 seconds
    at = dates.to_dms(value)
    return table(spark, d, "customer").select("c_custkey", *(at[i].alias(n) for i, n in enumerate(("degrees", "minutes", "seconds"))))


@query("SELECT p_partkey, CASE WHEN p_partkey % 2 = 0 THEN '1/' || CAST(p_size * 10 AS BIGINT) ELSE CAST(p_size AS VARCHAR) || CASE WHEN p_partkey % 4 = 1 THEN '.5' ELSE '' END END AS label FROM part")
def exposure_labels(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("p_partkey")
    seconds = F.when(k % 2 == 0, 1 / (F.col("p_size") * 10)).otherwise(F.col("p_size") + F.when(k % 4 == 1, 0.5).otherwise(0.0))
    return table(spark, d, "part").select("p_partkey", dates.exposure_label(seconds).alias("label"))


@query("SELECT p_partkey, CASE WHEN p_partkey % 3 <> 0 THEN p_brand END AS text FROM part")
def cleaned_strings(spark: SparkSession, d: str) -> DataFrame:
    raw = F.when(F.col("p_partkey") % 3 == 0, F.lit(" \0 \t")).otherwise(F.concat(F.lit(" \0"), F.col("p_brand"), F.lit("\0\0 ")))
    return table(spark, d, "part").select("p_partkey", dates.cleaned(raw).alias("text"))


@query("SELECT o_orderkey, CASE WHEN o_orderkey % 5 <> 0 THEN o_orderdate END AS taken_at FROM orders")
def video_dates(spark: SparkSession, d: str) -> DataFrame:
    text = F.when(F.col("o_orderkey") % 5 == 0, "0000-00-00T00:00:00Z").otherwise(F.date_format("o_orderdate", " yyyy-MM-dd'T'HH:mm:ss'Z'"))
    return table(spark, d, "orders").select("o_orderkey", dates.video_datetime(text).cast("timestamp_ntz").alias("taken_at"))


@query("SELECT o_orderkey, CASE WHEN o_totalprice < 1024 THEN printf('%d B', CAST(floor(o_totalprice) AS BIGINT)) WHEN o_totalprice < 1048576 THEN printf('%.1f KB', floor(floor(o_totalprice) / 1024.0 * 10 + 0.5) / 10) ELSE printf('%.1f MB', floor(floor(o_totalprice) / 1048576.0 * 10 + 0.5) / 10) END AS bytes, CASE WHEN o_custkey >= 3600 THEN printf('%d:%02d:%02d', o_custkey // 3600, o_custkey // 60 % 60, o_custkey % 60) ELSE printf('%d:%02d', o_custkey // 60, o_custkey % 60) END AS duration, strftime(o_orderdate, '%a, %-d %b %Y') AS day FROM orders")
def display_labels(spark: SparkSession, d: str) -> DataFrame:
    size = F.col("o_totalprice").cast("long")
    return table(spark, d, "orders").select("o_orderkey", names.byte_label(size).alias("bytes"), names.duration_label(F.col("o_custkey").cast("double")).alias("duration"), names.day_label(F.col("o_orderdate")).alias("day"))


EXTENSIONS = (".JPG", ".mov", ".txt", ".heic", "", ".tar.mp4")


@query("SELECT p_partkey, CASE p_partkey % 6 WHEN 0 THEN 'photo' WHEN 1 THEN 'video' WHEN 3 THEN 'photo' WHEN 5 THEN 'video' END AS media_type FROM part")
def media_types(spark: SparkSession, d: str) -> DataFrame:
    ending = F.element_at(F.array(*map(F.lit, EXTENSIONS)), (F.col("p_partkey") % 6 + 1).cast("int"))
    return table(spark, d, "part").select("p_partkey", names.media_type(F.concat(F.col("p_brand"), ending)).alias("media_type"))


@query("SELECT p_partkey, CASE p_partkey % 4 WHEN 0 THEN '_con.txt' WHEN 1 THEN '_LPT1' WHEN 2 THEN 'a_b' ELSE 'file' END AS name FROM part")
def safe_components(spark: SparkSession, d: str) -> DataFrame:
    raw = F.element_at(F.array(F.lit("con.txt"), F.lit("x/LPT1"), F.lit(" a:b. "), F.lit(" . ")), (F.col("p_partkey") % 4 + 1).cast("int"))
    return table(spark, d, "part").select("p_partkey", names.safe_component(raw).alias("name"))


@query(
    """SELECT p_partkey, CASE p_partkey % 6 WHEN 0 THEN 'screenshot' WHEN 2 THEN 'screenshot' WHEN 3 THEN 'screenshot' WHEN 4 THEN 'document' END AS kind,
 CASE p_partkey % 6 WHEN 0 THEN 0.99 WHEN 2 THEN 0.97 WHEN 3 THEN 0.9 WHEN 4 THEN 0.85 END::DOUBLE AS confidence FROM part"""
)
def kind_verdicts(spark: SparkSession, d: str) -> DataFrame:
    """All branches: a name, a camera that overrules a screen, an exact screen, a tall shape, a document word, none."""
    pick = lambda *v: F.element_at(F.array(*map(F.lit, v)), (F.col("p_partkey") % 6 + 1).cast("int"))
    name = pick("Screen Shot 3.png", "IMG_1.png", "IMG_2.png", "IMG_3.png", "old-Receipt 4.jpg", "IMG_5.jpg")
    verdict = names.kind(name, pick(10, 1179, 2556, 500, 400, 4000), pick(10, 2556, 1179, 1000, 300, 3000), pick("", "Canon", "", "", "", ""))
    return table(spark, d, "part").select("p_partkey", verdict["kind"].alias("kind"), verdict["confidence"].cast("double").alias("confidence"))


@query("SELECT event_id, printf('%02x', event_id % 256) AS shard FROM events")
def artifact_shards(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "events").select("event_id", names.shard(F.col("event_id")).alias("shard"))


@query("SELECT page_id, CASE WHEN octet_length(encode(url)) > 8 THEN decode(encode(url)[9:20]) END AS part, CASE WHEN octet_length(encode(url)) > 30 THEN decode(encode(url)[31:]) END AS rest FROM pages")
def byte_ranges(spark: SparkSession, d: str) -> DataFrame:
    content = F.encode("url", "UTF-8")
    return table(spark, d, "pages").select("page_id", F.decode(sources.byte_range(content, 8, 19), "UTF-8").alias("part"), F.decode(sources.byte_range(content, 30, None), "UTF-8").alias("rest"))


@query(
    """SELECT o_orderkey, CASE WHEN o_orderkey % 7 <> 0 THEN o_orderdate END AS taken_at, CASE WHEN o_orderkey % 4 IN (0, 2) THEN CAST(o_custkey % 80 + 0.5 AS DOUBLE) END AS lat, CASE WHEN o_orderkey % 4 IN (0, 2) THEN CAST(-(o_custkey % 170) AS DOUBLE) END AS lon FROM orders"""
)
def sidecar_records(spark: SparkSession, d: str) -> DataFrame:
    k, c = F.col("o_orderkey"), F.col("o_custkey")
    seconds = F.unix_seconds(F.col("o_orderdate").cast("timestamp")).cast("string")
    at = F.when(k % 7 == 0, F.lit('"photoTakenTime":{"timestamp":"never"}')).when(k % 3 == 0, F.format_string('"creationTime":{"timestamp":"%s"}', seconds)).otherwise(F.format_string('"photoTakenTime":{"timestamp":"%s"}', seconds))
    here = F.format_string('{"latitude":%s,"longitude":%s}', (c % 80 + 0.5).cast("string"), (-(c % 170)).cast("string"))
    geo = F.when(k % 4 == 0, F.concat(F.lit(',"geoData":'), here)).when(k % 4 == 2, F.concat(F.lit(',"geoData":{"latitude":0.0,"longitude":0.0},"geoDataExif":'), here)).otherwise(F.lit(',"geoData":{"latitude":95.0,"longitude":1.0}'))
    record = sources.sidecar(F.concat(F.lit("{"), at, geo, F.lit("}")))
    return table(spark, d, "orders").select("o_orderkey", record["taken_at"].cast("timestamp_ntz").alias("taken_at"), record["place"]["lat"].alias("lat"), record["place"]["lon"].alias("lon"))


@query("SELECT o_orderkey, upper(md5(CAST(o_orderkey AS VARCHAR))[1:8] || '-1234-ABCD-0000-' || md5(CAST(o_orderkey AS VARCHAR))[1:12]) AS content_id, CAST(0 AS INTEGER) AS pos FROM orders WHERE o_orderkey % 3 = 0")
def head_identifiers(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("o_orderkey")
    h = F.upper(F.md5(k.cast("string")))
    uuid = F.concat(F.substring(h, 1, 8), F.lit("-1234-ABCD-0000-"), F.substring(h, 1, 12))
    text = F.when(k % 3 == 0, F.concat(F.lit("xmp "), uuid, F.lit(" and "), uuid)).otherwise(F.concat(F.repeat(F.lit("."), 300), uuid))
    files = table(spark, d, "orders").select(k.alias("path"), F.encode(text, "UTF-8").alias("content"))
    return sources.head_identifiers(files, 100).select(F.col("path").alias("o_orderkey"), "content_id", "pos")


@query("SELECT o_orderkey, CASE WHEN o_orderkey % 2 = 0 THEN coalesce(CASE WHEN o_orderkey % 3 = 0 THEN o_orderdate END, CASE WHEN o_orderkey % 5 = 0 THEN o_orderdate + INTERVAL 1 DAY END) END AS taken_at FROM orders")
def repaired_dates(spark: SparkSession, d: str) -> DataFrame:
    k, at = F.col("o_orderkey"), F.col("o_orderdate")
    fixed = archives.repaired(F.when(k % 2 != 0, at), F.when(k % 3 == 0, at), F.when(k % 5 == 0, at + F.expr("interval 1 day")))
    return table(spark, d, "orders").select("o_orderkey", fixed.cast("timestamp_ntz").alias("taken_at"))
