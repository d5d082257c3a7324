"""Queries that pack a table's texts into archives, list them by ranged reads, and extract them."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lantern.functions.names import shard
from lantern.plans.bindings import table
from lantern.plans.registry import query
from lantern.session import remove, shared_dir
from lantern.sources import files as sources
from lantern.sources import media, zips


def _archives(spark: SparkSession, d: str) -> tuple[str, list[str]]:
    """Folder and paths of archives of all documents, each begun anew beyond 8 MiB."""
    at = f"{shared_dir(spark)}/lantern-archives-{uuid.uuid4().hex}"
    texts = table(spark, d, "documents").select(F.format_string("Takeout/Photos from 2020/%d.jpg", "doc_id").alias("name"), F.coalesce("text", F.lit("")).cast("binary").alias("content"))
    parts = media.zip_parts(texts, 8 << 20)
    zips.write_tree(parts.select(F.format_string("part-%d.zip", F.monotonically_increasing_id()).alias("path"), F.col("archive").alias("content")), at)
    return at, [f"{at}/{r.dest}" for r in zips.present(spark, at).select("dest").collect()]  # a name for each 8 MiB


@query("SELECT 'Takeout/Photos from 2020/' || doc_id || '.jpg' AS name, strlen(coalesce(text, '')) AS size, CAST(NULL AS VARCHAR) AS error FROM documents")
def zip_directory(spark: SparkSession, d: str) -> DataFrame:
    return zips.archive_entries(spark, _archives(spark, d)[1]).select("name", "size", "error")


@query("SELECT 'Photos from 2020/' || doc_id || '.jpg' AS dest, strlen(coalesce(text, '')) AS size, md5(coalesce(text, '')) AS digest FROM documents")
def extracted_tree(spark: SparkSession, d: str) -> DataFrame:
    at, paths = _archives(spark, d)
    root = f"{shared_dir(spark)}/lantern-tree-{uuid.uuid4().hex}"
    plan = zips.import_plan(zips.archive_entries(spark, paths))
    zips.extract(plan, root)
    remove(spark, at)
    # by the plan's places: Spark's file source would list the tree on the driver and make a task of every 32 files
    found = sources.md5_digests(sources.spread(plan.select(F.concat(F.lit(f"{root}/"), "dest").alias("path"))))
    return found.where("digest is not null").select(F.regexp_extract("path", "([^/]+/[^/]+)$", 1).alias("dest"), "size", "digest")


# half of the places are there in full size, a sixth of them too short
@query(
    """SELECT doc_id AS header_at, 'd/' || doc_id AS dest FROM documents
 WHERE NOT (doc_id % 2 = 0 AND doc_id % 3 <> 0) OR (doc_id % 5 = 0)"""
)
def extraction_remaining(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents")
    i, size = F.col("doc_id"), F.octet_length(F.coalesce("text", F.lit(""))).cast("long")
    taken = F.when(i % 5 == 0, F.lit("2020-01-01").cast("timestamp"))
    plan = docs.select(i.alias("header_at"), F.concat(F.lit("d/"), i.cast("string")).alias("dest"), (size + 1).alias("size"), taken.alias("taken_at"), F.lit(None).cast("double").alias("lat"))
    there = docs.where(i % 2 == 0).select(F.concat(F.lit("d/"), i.cast("string")).alias("dest"), F.when(i % 3 == 0, size).otherwise(size + 1).alias("length"))
    return zips.remaining(plan, there).select("header_at", "dest")


@query("SELECT 'q' AS kind, count(*) AS n, count(DISTINCT coalesce(text, '')) AS different FROM documents UNION ALL SELECT 'full', count(*), count(DISTINCT coalesce(text, '')) FROM documents")
def ranged_fingerprints(spark: SparkSession, d: str) -> DataFrame:
    """Quick and whole hashes of all texts as files; equal hashes are equal texts."""
    at = f"{shared_dir(spark)}/lantern-clips-{uuid.uuid4().hex}"
    docs = table(spark, d, "documents")
    path = F.concat_ws("/", shard(F.col("doc_id")), F.format_string("%d.mov", "doc_id"))
    zips.write_tree(docs.select(path.alias("path"), F.coalesce("text", F.lit("")).cast("binary").alias("content")), at)
    # by the names given: Spark's file source would list the folder on the driver and make a task of every 32 files
    clips = sources.spread(docs.select(F.concat(F.lit(f"{at}/"), path).alias("path")))
    both = sources.fingerprints(clips).unionByName(sources.full_fingerprints(clips))
    kind = F.when(F.col("content_hash").startswith("q:"), "q").otherwise("full")
    return both.groupBy(kind.alias("kind")).agg(F.count("*").alias("n"), F.count_distinct("content_hash").alias("different"))
