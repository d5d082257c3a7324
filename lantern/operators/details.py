"""Projections of single things and sorted lists: albums, locked items, roots, folders' sizes, country names."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lantern.operators.timeline import newest


def album_items(items: DataFrame, files: DataFrame, locked: DataFrame, album_id: int) -> DataFrame:
    """The album's active, unlocked files in its order: file_id, media_type, width, height, position."""
    own = items.where(F.col("album_id") == album_id).select("file_id", "position")
    seen = files.where("status = 'active'").join(locked.select("file_id"), "file_id", "left_anti")
    return seen.join(own, "file_id").select("file_id", "media_type", "width", "height", "position").orderBy("position", "file_id")


def locked_items(files: DataFrame, locked: DataFrame) -> DataFrame:
    """The active locked files, newest first, with their capture day."""
    return files.where("status = 'active'").join(locked.select("file_id").distinct(), "file_id", "left_semi").select("file_id", "media_type", "width", "height", "taken_at", F.to_date("taken_at").alias("day")).orderBy(*newest())


def root_paths(roots: DataFrame, volumes: DataFrame) -> DataFrame:
    """roots(root_id, volume_id, rel_path) with abs_path: the volume's mount, '?' while it has none, and the path below it."""
    mount = F.coalesce(F.nullif("mount", F.lit("")), F.lit("?"))
    path = F.when(F.col("rel_path") == "", mount).otherwise(F.concat_ws("/", F.regexp_replace(mount, "/+$", ""), "rel_path"))
    return roots.join(volumes, "volume_id").select(*roots.columns, path.alias("abs_path"))


def sorted_list(rows: DataFrame, by: list[str], key: str) -> DataFrame:
    """rows with the largest values of `by` first and the smaller key first on ties, as lists of events, albums and people have them."""
    return rows.orderBy(*(F.desc_nulls_last(c) for c in by), F.asc(key))


def names_touched(old: Column, new: Column) -> Column:
    """The distinct names, nulls aside, that a change of name has to refresh."""
    return F.array_distinct(F.array_compact(F.array(old, new)))


def folder_sizes(listing: DataFrame) -> DataFrame:
    """(folder, files, bytes) of every folder with all that lies below it. listing(rel_path, size_bytes)."""
    parts = F.split("rel_path", "/")
    above = F.transform(F.sequence(F.lit(0), F.size(parts) - 1), lambda n: F.array_join(F.slice(parts, F.lit(1), n), "/"))
    return listing.select(F.explode(above).alias("folder"), "size_bytes").groupBy("folder").agg(F.count("*").alias("files"), F.sum("size_bytes").alias("bytes"))


def with_country_names(places: DataFrame, names: DataFrame) -> DataFrame:
    """places(country_code, ...) with country: the name that names(country_code, name) has, else the code itself."""
    return places.join(names.select("country_code", "name"), "country_code", "left").select(*places.columns, F.coalesce("name", "country_code").alias("country"))
