"""Queries of the wide joins, density clusters, person upkeep and the catalog in key ranges."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lantern.operators import clusters, duplicates, vectors
from lantern.plans.bindings import table
from lantern.plans.catalogue import CENTROID_SQL, SIGNS, _signs
from lantern.plans.registry import query
from lantern.session import remove, shared_dir
from lantern.streaming import ranges, rescan


@query(f"WITH s AS (SELECT DISTINCT CAST({SIGNS} AS BIGINT) AS h FROM embeddings) SELECT x.h, count(y.h) AS n_links FROM s x LEFT JOIN s y ON x.h <> y.h AND bit_count(xor(x.h, y.h)) <= 20 GROUP BY 1")
def near_dupe_counts(spark: SparkSession, d: str) -> DataFrame:
    return duplicates.near_counts(_signs(spark, d).select("h"), 20)


@query(f"WITH s AS (SELECT DISTINCT CAST({SIGNS} AS BIGINT) AS h FROM embeddings) SELECT x.h AS a, y.h AS b, CAST(bit_count(xor(x.h, y.h)) AS INTEGER) AS distance FROM s x JOIN s y ON x.h < y.h AND bit_count(xor(x.h, y.h)) <= 10")
def near_dupe_pairs_by_balls(spark: SparkSession, d: str) -> DataFrame:
    return duplicates.near_pairs(_signs(spark, d), 10)


@query()
def density_clusters(spark: SparkSession, d: str) -> DataFrame:
    """Density clusters of all embeddings; SQL can't express them, tests/test_clusters.py compares brute force."""
    return clusters.hdbscan(table(spark, d, "embeddings"))


# every tenth vector leaves its label, every ninth is new
@query(f"WITH {CENTROID_SQL.replace('FROM embeddings', 'FROM embeddings WHERE vec_id % 10 <> 3')} SELECT label, n, CAST(i AS INTEGER) AS axis, round(centroid[i + 1], 6) AS value FROM u, range(64) t(i)")
def person_sums_updated(spark: SparkSession, d: str) -> DataFrame:
    v, i = table(spark, d, "embeddings"), F.col("vec_id")
    was = vectors.vector_sums(v.where(i % 9 != 4), "label")
    now = vectors.updated_sums(was, v.where((i % 9 == 4) & (i % 10 != 3)), v.where((i % 9 != 4) & (i % 10 == 3)), "label")
    return vectors.summed_centroids(now, "label").select("label", "n", F.posexplode("centroid").alias("axis", "value")).withColumn("value", F.round("value", 6))


# vectors of every eleventh row are null, of every thirteenth zero
_HELD = "SELECT vec_id, CASE WHEN vec_id % 11 = 0 THEN NULL WHEN vec_id % 13 = 0 THEN list_transform(embedding, lambda v: 0.0) ELSE list_transform(embedding, lambda v: CAST(v AS DOUBLE)) END AS e FROM embeddings"


@query(
    f"""WITH {CENTROID_SQL}, v AS ({_HELD}), s AS (SELECT vec_id, label AS l, list_dot_product(e, centroid) / sqrt(list_dot_product(e, e)) AS sim FROM v, u WHERE vec_id % 11 <> 0 AND vec_id % 13 <> 0),
 b AS (SELECT vec_id, arg_max(l, sim) AS l, max(sim) AS sim FROM s GROUP BY 1) SELECT vec_id, CASE WHEN sim >= 0.25 THEN l END AS nearest_label, CASE WHEN sim >= 0.25 THEN round(sim, 6) END AS similarity FROM v LEFT JOIN b USING (vec_id)"""
)
def assign_nearest_without_direction(spark: SparkSession, d: str) -> DataFrame:
    e, i = table(spark, d, "embeddings"), F.col("vec_id")
    held = e.select("vec_id", F.when(i % 11 == 0, None).when(i % 13 == 0, F.transform("embedding", lambda v: v * 0)).otherwise(F.col("embedding")).alias("embedding"))
    out = vectors.assign_nearest(held, vectors.centroids(e, "label"), 0.25, "label")
    return out.select("vec_id", "nearest_label", F.round("similarity", 6).alias("similarity"))


# persons 0 to 6, the odd ones named; faces of every fifth row are by hand, of every fourth noise
@query(
    """WITH f AS (SELECT vec_id AS face_id, CASE WHEN vec_id % 4 <> 0 THEN CAST(label AS BIGINT) END AS cluster, CASE WHEN vec_id % 3 <> 0 THEN label % 7 END AS person_id, CASE WHEN vec_id % 5 = 0 THEN 'manual' ELSE 'cluster' END AS src FROM embeddings),
 z AS (SELECT cluster, count(*) AS size FROM f WHERE cluster IS NOT NULL GROUP BY 1), t AS (SELECT cluster, person_id, count(*) AS n FROM f WHERE cluster IS NOT NULL AND person_id % 2 = 1 GROUP BY 1, 2),
 c AS (SELECT person_id, arg_max(cluster, (n, -cluster)) AS cluster, max(n) AS n FROM t GROUP BY 1), k AS (SELECT cluster, CAST(arg_max(person_id, (n, -person_id)) AS BIGINT) AS p FROM c JOIN z USING (cluster) WHERE n * 3 > size GROUP BY 1),
 g AS (SELECT cluster, p FROM k UNION ALL SELECT cluster, 6 + row_number() OVER (ORDER BY cluster) FROM z WHERE cluster NOT IN (SELECT cluster FROM k))
 SELECT face_id, CASE WHEN src = 'manual' AND person_id IS NOT NULL THEN CAST(person_id AS BIGINT) ELSE p END AS person_id, CASE WHEN src = 'manual' AND person_id IS NOT NULL THEN src WHEN p IS NOT NULL THEN 'cluster' END AS assign_src FROM f LEFT JOIN g USING (cluster)"""
)
def relabelled_faces(spark: SparkSession, d: str) -> DataFrame:
    e, i = table(spark, d, "embeddings"), F.col("vec_id")
    person = F.when(i % 3 != 0, (F.col("label") % 7).cast("long"))
    faces = e.select(i.alias("face_id"), F.when(i % 4 != 0, F.col("label").cast("long")).alias("cluster"), person.alias("person_id"), F.when(i % 5 == 0, "manual").otherwise("cluster").alias("assign_src"))
    persons = e.select((F.col("label") % 7).cast("long").alias("person_id")).distinct()
    return vectors.relabelled_faces(faces, persons.select("person_id", F.when(F.col("person_id") % 2 == 1, F.concat(F.lit("p"), F.col("person_id").cast("string"))).alias("name")))


@query("SELECT c AS o_custkey, max(o) AS o_orderkey FROM (SELECT o_custkey AS c, o_orderkey AS o FROM orders) GROUP BY 1")
def ranged_catalog(spark: SparkSession, d: str) -> DataFrame:
    """All orders as listings in three files, streamed into the catalog in key ranges, the last order of a customer staying."""
    at = f"{shared_dir(spark)}/lantern-ranged-{uuid.uuid4().hex}"
    orders = table(spark, d, "orders").select("o_custkey", "o_orderkey")
    for part in range(3):
        orders.where(F.col("o_orderkey") % 3 == part).write.parquet(f"{at}/in{part}")
        stream = rescan.listing_stream(spark, f"{at}/in{part}", "o_custkey long, o_orderkey long")
        # later files may hold earlier orders: what is there already takes part
        held = ranges.read_ranges(spark, f"{at}/catalog")
        if held is not None:
            held.write.mode("append").parquet(f"{at}/in{part}")
        rescan.keep_catalog(stream, f"{at}/catalog", ["o_custkey"], "o_orderkey", f"{at}/check{part}", ranges=32).awaitTermination()
        remove(spark, f"{at}/in{part}")
    return ranges.read_ranges(spark, f"{at}/catalog")
