"""Joins with a shape of their own: flags, covers, membership counts, path prefixes, claims."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lantern.operators.ordered import scanned


def flagged(df: DataFrame, members: DataFrame, key: str, name: str) -> DataFrame:
    """df with a boolean: whether its key is among the members."""
    m = members.select(key).distinct().withColumn("_in", F.lit(True))
    return df.join(m, key, "left").withColumn(name, F.coalesce("_in", F.lit(False))).drop("_in")


def counted(df: DataFrame, members: DataFrame, key: str, name: str, distinct: str | None = None) -> DataFrame:
    """df with the number of its members (0 without any), or of their distinct values."""
    n = members.groupBy(key).agg((F.count_distinct(distinct) if distinct else F.count("*")).alias(name))
    return df.join(n, key, "left").withColumn(name, F.coalesce(name, F.lit(0)))


def covers(owners: DataFrame, members: DataFrame, visible: DataFrame, owner: str, stored: str, best: Column) -> DataFrame:
    """(owner, cover): the stored cover if it is visible, else the visible member with the largest `best`, lowest id on ties."""
    seen = members.join(visible, "file_id", "left_semi")
    top = seen.groupBy(owner).agg(F.max_by("file_id", F.struct(best, -F.col("file_id"))).alias("_best"))
    kept = visible.select(F.col("file_id").alias(stored), F.col("file_id").alias("_stored"))
    return owners.join(kept, stored, "left").join(top, owner, "left").select(owner, F.coalesce("_stored", "_best").alias("cover"))


def roots_of_files(files: DataFrame, roots: DataFrame) -> DataFrame:
    """(file_id, root_id) for every root that holds the file, by equi-joins on each path's ancestors, not a theta join.

    files(file_id, volume_id, rel_path), roots(root_id, volume_id, rel_path).
    """
    parts = F.split("rel_path", "/")
    ancestors = F.transform(F.sequence(F.lit(0), F.size(parts)), lambda n: F.array_join(F.slice(parts, F.lit(1), n), "/"))
    f = files.select("file_id", "volume_id", F.explode(F.array_distinct(ancestors)).alias("rel_path"))
    return f.join(roots.select("root_id", "volume_id", "rel_path"), ["volume_id", "rel_path"]).select("file_id", "root_id")


def doomed_files(files: DataFrame, roots: DataFrame, root_id: int) -> DataFrame:
    """Files that leave with a root: those below it and below no other root."""
    held = roots_of_files(files, roots)
    mine = held.where(F.col("root_id") == root_id).select("file_id")
    return mine.join(held.where(F.col("root_id") != root_id).select("file_id"), "file_id", "left_anti")


def longest_prefix(paths: DataFrame, mounts: DataFrame) -> DataFrame:
    """(path, volume_id) of the mount with the longest path that holds the path, by an equi-join on each path's ancestors."""
    parts = F.split("path", "/")
    ancestors = F.transform(F.sequence(F.lit(0), F.size(parts)), lambda n: F.array_join(F.slice(parts, F.lit(1), n), "/"))
    above = paths.select("path").distinct().select("path", F.explode(F.array_distinct(ancestors)).alias("mount"))
    return above.join(mounts.select("mount", "volume_id"), "mount").groupBy("path").agg(F.max_by("volume_id", F.struct(F.length("mount"), "volume_id")).alias("volume_id"))


def claim_once(candidates: DataFrame, targets: DataFrame, key: str) -> DataFrame:
    """(file_id, key, target): each key is claimed once, by the lowest file; of a file's keys the last one wins.

    candidates(file_id, key, pos); targets(key, target): of several targets of one key the highest counts.
    """
    target = targets.where(F.col(key).isNotNull() & (F.col(key) != "")).groupBy(key).agg(F.max("target").alias("target"))
    claims = candidates.join(target, key).groupBy(key).agg(F.min_by(F.struct("file_id", "pos", "target"), F.struct("file_id", "pos")).alias("c"))
    return claims.groupBy("c.file_id").agg(F.max_by(F.struct(F.col(key).alias("key"), F.col("c.target").alias("target")), F.struct("c.pos", F.col(key))).alias("x")).select("file_id", F.col("x.key").alias(key), "x.target")


def latest_per(df: DataFrame, key: str, order: str) -> DataFrame:
    """The row with the largest `order` of each key, by aggregation: no sort, and a hot key is reduced before the shuffle."""
    rest = [c for c in df.columns if c != key]
    return df.groupBy(key).agg(F.max_by(F.struct(*rest), order).alias("x")).select(key, "x.*")


def latest_jobs(history: DataFrame, live: DataFrame) -> DataFrame:
    """The job of the largest id of each kind; of a job both finished and live, the live row counts. Both have (id, kind, ...)."""
    rows = history.withColumn("_live", F.lit(False)).unionByName(live.withColumn("_live", F.lit(True)))
    rest = [c for c in history.columns if c != "id"]
    current = rows.groupBy("id").agg(F.max_by(F.struct(*rest), "_live").alias("x")).select("id", "x.*")  # the live row may have another kind
    return latest_per(current, "kind", "id").select(history.columns)


def evictions(cache: DataFrame, budget: int, target: float = 0.9) -> DataFrame:
    """The oldest cache entries to drop so that the rest fits target * budget; none while the total is within the budget.

    cache(path, size, mtime). The running sum is a prefix scan: no task holds more than its part of the order.
    """
    total = cache.agg(F.coalesce(F.sum("size"), F.lit(0)).alias("total"))
    freed = scanned(cache.select("path", F.col("size").alias("_size"), "mtime"), [], [F.col("mtime"), F.col("path")], sums={"_freed": F.col("_size")})
    rows = freed.withColumn("_freed", F.col("_freed") - F.coalesce("_size", F.lit(0))).crossJoin(total)  # total is one row
    return rows.where((F.col("total") > budget) & (F.col("total") - F.col("_freed") > target * budget)).select("path", F.col("_size").alias("size"), "mtime")
