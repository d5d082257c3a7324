"""Library-wide figures: statistics, summaries and previews."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lantern.functions.names import kind_label


def library_stats(files: DataFrame, locked: DataFrame) -> DataFrame:
    """One row of counts and bytes in one pass: photos, videos, bytes and dated of the active, unlocked files; missing; locked; total."""
    flag = locked.select("file_id", F.lit(True).alias("_locked")).distinct()
    f = files.join(flag, "file_id", "left").withColumn("_seen", (F.col("status") == "active") & F.col("_locked").isNull())
    is_seen = lambda kind: F.col("_seen") & (F.col("media_type") == kind)
    return f.agg(
        F.count_if(is_seen("photo")).alias("photos"),
        F.count_if(is_seen("video")).alias("videos"),
        F.coalesce(F.sum(F.when(is_seen("photo"), F.col("size_bytes"))), F.lit(0)).alias("photo_bytes"),
        F.coalesce(F.sum(F.when(is_seen("video"), F.col("size_bytes"))), F.lit(0)).alias("video_bytes"),
        F.count_if(F.col("_seen") & F.col("taken_at").isNotNull()).alias("dated"),
        F.count_if(F.col("status") == "missing").alias("missing"),
        F.count_if(F.col("_locked").isNotNull()).alias("locked"),
        F.count("*").alias("total"),
    )


def full_stats(files: DataFrame, locked: DataFrame, motion: DataFrame, metadata: DataFrame, places: DataFrame, faces: DataFrame, persons: DataFrame, sizes: DataFrame, ready: bool = False) -> DataFrame:
    """One row of ten counts, three sizes and whether the face model is ready.

    files(file_id, media_type, status, face_scanned), metadata(gps_lat), persons(person_id, name, is_hidden); sizes(area,
    bytes) has the areas db, thumbs and previews. A live photo's clip is no video of its own; people_visible has a face
    on a file that can be seen.
    """
    clips = motion.where("video_file_id is not null").select(F.col("video_file_id").alias("file_id"))
    seen = files.where("status = 'active'").join(locked.select("file_id"), "file_id", "left_anti")
    shown = faces.where("person_id is not null").join(seen.select("file_id"), "file_id", "left_semi").select("person_id")
    counts = (
        seen.join(clips, "file_id", "left_anti").agg(F.count_if(F.col("media_type") == "photo").alias("photos"), F.count_if(F.col("media_type") == "video").alias("videos")),
        files.agg(F.count_if(F.col("status") == "missing").alias("missing"), F.count_if((F.col("status") == "active") & (F.col("media_type") == "photo") & ~F.col("face_scanned")).alias("face_pending")),
        metadata.agg(F.count("gps_lat").alias("with_gps")),
        places.agg(F.count("*").alias("geocoded")),
        faces.agg(F.count("*").alias("faces")),
        motion.join(seen.select("file_id"), "file_id", "left_semi").agg(F.count("*").alias("live")),
        persons.agg(F.count("name").alias("persons")),
        persons.where(~F.col("is_hidden")).join(shown, "person_id", "left_semi").agg(F.count("*").alias("people_visible")),
        sizes.agg(*(F.coalesce(F.sum(F.when(F.col("area") == a, F.col("bytes"))), F.lit(0)).alias(f"{a}_bytes") for a in ("db", "thumbs", "previews"))),
    )
    out = counts[0]
    for one in counts[1:]:  # one row each
        out = out.crossJoin(one)
    return out.withColumn("face_model_ready", F.lit(ready))


def kind_summary(kinds: DataFrame) -> DataFrame:
    """(kind, label, count) of the non-photos."""
    return kinds.where("kind <> 'photo'").groupBy("kind").agg(F.count("*").alias("count")).withColumn("label", kind_label(F.col("kind")))


def removal_preview(files: DataFrame, doomed: DataFrame, faces: DataFrame, locked: DataFrame) -> DataFrame:
    """One row: photos, videos, faces and locked files among the doomed."""
    d = doomed.select("file_id").distinct()
    own = files.join(d, "file_id", "left_semi").agg(F.count_if(F.col("media_type") == "photo").alias("photos"), F.count_if(F.col("media_type") == "video").alias("videos"))
    n_faces = faces.join(d, "file_id", "left_semi").agg(F.count("*").alias("faces"))
    n_locked = locked.join(d, "file_id", "left_semi").agg(F.count("*").alias("locked"))
    return own.crossJoin(n_faces).crossJoin(n_locked)


def motion_summary(files: DataFrame, motion: DataFrame, pending: DataFrame) -> DataFrame:
    """One row: live photos, movies with an identifier that no photo claims, videos not yet asked."""
    live = motion.agg(F.count_if(F.col("video_file_id").isNotNull()).alias("live"))
    claimed = motion.where("video_file_id is not null").select(F.col("video_file_id").alias("file_id"))
    unpaired = pending.where("content_id <> ''").join(claimed, "file_id", "left_anti").agg(F.count("*").alias("unpaired"))
    unchecked = pending.agg(F.count_if(F.col("content_id").isNull()).alias("unchecked"))
    return live.crossJoin(unpaired).crossJoin(unchecked)


def export_totals(files: DataFrame, chosen: DataFrame, online: DataFrame) -> DataFrame:
    """One row: count, bytes and offline files of an export's selection."""
    f = files.join(chosen.select("file_id").distinct(), "file_id", "left_semi").join(online.select("volume_id", F.lit(True).alias("_on")).distinct(), "volume_id", "left")
    return f.agg(F.count_if(F.col("_on").isNotNull()).alias("count"), F.coalesce(F.sum(F.when(F.col("_on").isNotNull(), F.col("size_bytes"))), F.lit(0)).alias("bytes"), F.count_if(F.col("_on").isNull()).alias("offline"))


def full_detail(files: DataFrame, places: DataFrame, faces: DataFrame, persons: DataFrame, metadata: DataFrame, motion: DataFrame, volumes: DataFrame) -> DataFrame:
    """file_detail's columns, with metadata and volume as structs and motion_file_id, the movie of a live photo.

    metadata(file_id, ...), motion(file_id, video_file_id), volumes(volume_id, label, last_mount_path, is_online): each
    key at most once. What a file lacks is null.
    """
    known = metadata.select("file_id", F.struct(*(c for c in metadata.columns if c != "file_id")).alias("metadata"))
    movie = motion.select("file_id", F.col("video_file_id").alias("motion_file_id"))
    kept = volumes.select("volume_id", F.struct("label", "last_mount_path", "is_online").alias("volume"))
    return file_detail(files, places, faces, persons).join(known, "file_id", "left").join(movie, "file_id", "left").join(kept, "volume_id", "left")


def file_detail(files: DataFrame, places: DataFrame, faces: DataFrame, persons: DataFrame) -> DataFrame:
    """files with place as a struct and persons as a sorted array of (person_id, name)."""
    who = faces.where("person_id is not null").select("file_id", "person_id").distinct().join(persons, "person_id").groupBy("file_id").agg(F.array_sort(F.collect_list(F.struct("person_id", "name"))).alias("persons"))
    where = places.select("file_id", F.struct("country", "city").alias("place"))
    return files.join(where, "file_id", "left").join(who, "file_id", "left").withColumn("persons", F.coalesce("persons", F.array().cast("array<struct<person_id:bigint,name:string>>")))
