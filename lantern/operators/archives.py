"""Archive reconciliation: sidecar pairing, sharing among copies, extraction plans and totals.

media(name, crc, size), sidecars(name): entries of an export's archives, one row per path.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lantern.functions.names import SIDECAR_SUFFIXES, VIDEO_EXTENSIONS, basename, container, extension, is_year_bucket, photos_root, safe_component, without_sidecar_suffix
from lantern.session import drop_written, written


def _folder(name: Column) -> Column:
    return F.regexp_extract(name, r"^(.*)/[^/]*$", 1)


def sidecar_cascade(media: DataFrame, sidecars: DataFrame) -> DataFrame:
    """(name, sidecar, rule) for every media entry that a rule pairs, the first rule that does.

    Rules 1-3: the exact name and a suffix. 4-6: the same, whatever the case. 7-9: "a(1).jpg" as "a.jpg(1)" and a
    suffix. 10: the only sidecar in the folder whose stem of 12 letters or more begins the name. Equi-joins on whole
    names, or on the folder and a beginning of the name, of the lengths that stems of that folder have, for the prefix rule.
    """
    suffix = F.explode(F.array(*(F.struct(F.lit(i).alias("nth"), F.lit(s).alias("suffix")) for i, s in enumerate(SIDECAR_SUFFIXES, 1))))
    m = media.select("name").distinct().withColumn("_s", suffix)
    moved = F.regexp_replace(basename(F.col("name")), r"^(.+?)\((\d+)\)(\.[^.]*)$", "$1$3($2)")
    folder = F.when(F.col("name").contains("/"), F.concat(_folder(F.col("name")), F.lit("/"))).otherwise(F.lit(""))
    exact = m.select("name", F.col("_s.nth").alias("rule"), F.concat("name", "_s.suffix").alias("key"))
    folded = m.select("name", (F.col("_s.nth") + 3).alias("rule"), F.lower(F.concat("name", "_s.suffix")).alias("key"))
    index = m.where(basename(F.col("name")).rlike(r"^.+?\(\d+\)\.[^.]*$")).select("name", (F.col("_s.nth") + 6).alias("rule"), F.lower(F.concat(folder, moved, "_s.suffix")).alias("key"))
    s = sidecars.select(F.col("name").alias("sidecar")).distinct()
    by_name = exact.join(s, F.col("key") == F.col("sidecar")).select("name", "rule", "sidecar")
    low = s.groupBy(_folder(F.col("sidecar")).alias("_f"), F.lower("sidecar").alias("key")).agg(F.max("sidecar").alias("sidecar"))
    by_case = folded.unionByName(index).withColumn("_f", _folder(F.col("name"))).join(low, ["_f", "key"]).select("name", "rule", "sidecar")
    stem = without_sidecar_suffix(basename(F.col("sidecar")))
    stems = s.select("sidecar", _folder(F.col("sidecar")).alias("folder"), F.lower(stem).alias("stem")).where(F.length("stem") >= 12)
    heads = media.select("name").distinct().select("name", _folder(F.col("name")).alias("folder"), F.lower(basename(F.col("name"))).alias("_b"))
    lengths = stems.groupBy("folder").agg(F.collect_set(F.length("stem")).alias("_lengths"))  # as many as a name has letters
    heads = heads.join(lengths, "folder").select("name", "folder", "_b", F.explode("_lengths").alias("_n")).where(F.col("_n") <= F.length("_b"))
    heads = heads.select("name", "folder", F.substring("_b", F.lit(1), F.col("_n")).alias("stem"))
    only = heads.join(stems, ["folder", "stem"]).groupBy("name").agg(F.count("*").alias("n"), F.min("sidecar").alias("sidecar")).where("n = 1").select("name", F.lit(10).alias("rule"), "sidecar")
    return by_name.unionByName(by_case).unionByName(only).groupBy("name").agg(F.min_by("sidecar", "rule").alias("sidecar"), F.min("rule").alias("rule"))


def adopted(media: DataFrame, sidecars: DataFrame, paired: DataFrame) -> DataFrame:
    """(name, sidecar): unpaired media whose base name is the stem of exactly one unmatched sidecar of any folder."""
    free = sidecars.select(F.col("name").alias("sidecar")).join(paired.select("sidecar"), "sidecar", "left_anti")
    index = free.groupBy(F.lower(without_sidecar_suffix(basename(F.col("sidecar")))).alias("key")).agg(F.count("*").alias("n"), F.min("sidecar").alias("sidecar")).where("n = 1")
    open_media = media.select("name").join(paired.select("name"), "name", "left_anti").withColumn("key", F.lower(basename(F.col("name"))))
    return open_media.join(index, "key").select("name", "sidecar")


def shared(media: DataFrame, paired: DataFrame) -> DataFrame:
    """(name, sidecar) of all media: their own, else that of the first copy by name with the same (crc, size), else null."""
    own = media.join(paired.select("name", "sidecar"), "name", "left")
    first = own.where("sidecar is not null").groupBy("crc", "size").agg(F.min_by("sidecar", "name").alias("_first"))
    return own.join(first, ["crc", "size"], "left").select("name", F.coalesce("sidecar", "_first").alias("sidecar"))


def extraction_plan(media: DataFrame) -> DataFrame:
    """(name, dest, is_primary, primary_dest): year folders first, then names; identical copies become links of the first.

    Destinations that clash, whatever their case, get a counter before the extension.
    """
    folder = safe_component(F.coalesce(container(F.col("name")), F.lit("Photos")))
    base = safe_component(basename(F.col("name")))
    album = F.coalesce(~is_year_bucket(container(F.col("name"))), F.lit(True))
    rows = media.select("name", "crc", "size", F.concat_ws("/", folder, base).alias("_path"), album.alias("_album")).withColumn("_order", F.concat(F.col("_album").cast("string"), F.lit(":"), "name"))
    named = unique_names(rows, "name", "_path", "_order").withColumnRenamed("unique_name", "dest")
    first = named.groupBy("crc", "size").agg(F.min_by(F.struct("name", "dest"), F.struct("_album", "name")).alias("_p"))
    return named.join(first, ["crc", "size"]).select("name", "dest", (F.col("name") == F.col("_p.name")).alias("is_primary"), F.col("_p.dest").alias("primary_dest"))


def unique_names(files: DataFrame, key: str, name: str, order: str) -> DataFrame:
    """files with unique_name: the name, or with a counter for its second and later uses, whatever the case.

    A counter that meets a name taken moves on: every round numbers the open files past their own last counter, and of
    each candidate that is free the first file by (order, key) takes it. Rounds are written tables. `key` is unique.
    """
    dot_at = F.regexp_extract(name, r"(?<=[^./])(\.[^./]*)$", 1)
    stem = F.substring(F.col(name), F.lit(1), F.length(name) - F.length(dot_at))
    w = Window.partitionBy(F.lower(name)).orderBy(order, key)
    kept = list(dict.fromkeys([key, name, order]))
    rows = written(files.select(*kept).withColumn("_n", F.row_number().over(w).cast("long")), "names")
    done = rows.where("_n = 1").select(key, F.col(name).alias("unique_name"))
    left = rows.where("_n > 1")
    while not left.isEmpty():
        label = F.concat(stem, F.lit(" ("), F.col("_n").cast("string"), F.lit(")"), dot_at)
        tried = left.withColumn("unique_name", label).withColumn("_low", F.lower("unique_name"))
        taken = done.select(F.lower("unique_name").alias("_low"), F.lit(True).alias("_taken")).distinct()
        first = F.row_number().over(Window.partitionBy("_low").orderBy(order, key)) == 1
        tried = written(tried.join(taken, "_low", "left").withColumn("_ok", first & F.col("_taken").isNull()), "names")
        kept_so_far, still = done, left
        done = written(done.unionByName(tried.where("_ok").select(key, "unique_name")), "named")
        again = tried.where("not _ok").withColumn("_k", F.row_number().over(w))
        last = tried.groupBy(F.lower(name).alias("_own")).agg(F.max("_n").alias("_last"))
        left = written(again.join(last, F.lower(name) == F.col("_own")).select(*kept, (F.col("_last") + F.col("_k")).alias("_n")), "names")
        for old in (kept_so_far, still, tried):  # both new tables are written
            drop_written(files.sparkSession, old)
    return files.join(done, key)


def manifest_totals(media: DataFrame, pairs: DataFrame, sidecars: DataFrame) -> DataFrame:
    """One row: photos, videos, containers, albums, unique_bytes, duplicate_paths, paired, orphan_sidecars, photos_root.

    pairs(name, sidecar) as shared() gives them.
    """
    video = extension(F.col("name")).isin(*VIDEO_EXTENSIONS)
    box = container(F.col("name"))
    files = media.agg(
        F.count_if(~video).alias("photos"),
        F.count_if(video).alias("videos"),
        F.count_distinct(box).alias("containers"),
        F.count_distinct(F.when(~is_year_bucket(box), box)).alias("albums"),
        F.count("*").alias("_n"),
    )
    unique = media.select("crc", "size").distinct().agg(F.coalesce(F.sum("size"), F.lit(0)).alias("unique_bytes"), F.count("*").alias("_u"))
    used = pairs.where("sidecar is not null")
    paired = used.agg(F.count("*").alias("paired"))
    orphans = sidecars.select(F.col("name").alias("sidecar")).join(used.select("sidecar"), "sidecar", "left_anti").agg(F.count("*").alias("orphan_sidecars"))
    root = media.select(photos_root(F.col("name")).alias("r")).where("r is not null").groupBy("r").agg(F.count("*").alias("n")).agg(F.max_by("r", F.struct("n", "r")).alias("photos_root"))
    out = files
    for one in (unique, paired, orphans, root):  # one row each
        out = out.crossJoin(one)
    return out.select("photos", "videos", "containers", "albums", "unique_bytes", (F.col("_n") - F.col("_u")).alias("duplicate_paths"), "paired", "orphan_sidecars", "photos_root")


def looks_incomplete(orphans: Column, total: Column) -> Column:
    return orphans > F.greatest(F.lit(20), F.floor(total / 20))


def repaired(existing: Column, sidecar: Column, filename: Column) -> Column:
    """What a repair writes: nothing where a value exists, else the sidecar's, else the file name's."""
    return F.when(existing.isNull(), F.coalesce(sidecar, filename))
