"""Table changes as DataFrame rewrites: every function returns the new table, to be written over the old one atomically."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def last_of(rows: DataFrame, keys: list[str], order: str) -> DataFrame:
    """One row per key, that of the largest order."""
    rest = [c for c in rows.columns if c not in keys]
    return rows.groupBy(*keys).agg(F.max_by(F.struct(*rest), order).alias("_x")).select(*keys, "_x.*").select(rows.columns)


def insert_or_ignore(table: DataFrame, new: DataFrame, keys: list[str], order: str) -> DataFrame:
    """table and the new rows whose key it lacks; of new rows with one key the first by order."""
    rest = [c for c in new.columns if c not in keys]
    once = new.groupBy(*keys).agg(F.min_by(F.struct(*rest), order).alias("_x")).select(*keys, "_x.*")
    return table.unionByName(once.join(table.select(*keys), keys, "left_anti").select(table.columns))


def upsert(table: DataFrame, new: DataFrame, keys: list[str], order: str) -> DataFrame:
    """table with the new rows in place of those of their key; of new rows with one key the last by order."""
    once = last_of(new, keys, order)
    return table.join(once.select(*keys), keys, "left_anti").select(table.columns).unionByName(once.select(table.columns))


def patched(table: DataFrame, patch: DataFrame, keys: list[str]) -> DataFrame:
    """table with the patch's non-null values in place of its own."""
    columns = [c for c in patch.columns if c not in keys]
    p = patch.select(*keys, *(F.col(c).alias(f"_{c}") for c in columns))
    return table.join(p, keys, "left").select(*(F.coalesce(f"_{c}", c).alias(c) if c in columns else F.col(c) for c in table.columns))


def rebuilt(table: DataFrame, fresh: DataFrame, keys: list[str], manual: Column) -> DataFrame:
    """The table's manual rows, and the fresh ones for all other keys."""
    kept = table.where(manual)
    return kept.unionByName(fresh.join(kept.select(*keys), keys, "left_anti").select(table.columns))


def appended(items: DataFrame, new: DataFrame, owner: str) -> DataFrame:
    """items(owner, file_id, position) with new(owner, file_id, pos) behind the owner's last; items already there are left out but their place stays empty."""
    last = items.groupBy(owner).agg(F.max("position").alias("_last"))
    nth = F.row_number().over(Window.partitionBy(owner).orderBy("pos", "file_id"))
    placed = new.withColumn("_nth", nth).join(last, owner, "left").select(owner, "file_id", (F.coalesce("_last", F.lit(-1)) + F.col("_nth")).cast("long").alias("position"))
    first = placed.groupBy(owner, "file_id").agg(F.min("position").alias("position"))
    return items.unionByName(first.join(items.select(owner, "file_id"), [owner, "file_id"], "left_anti"))


def reordered(items: DataFrame, order: DataFrame, owner: str) -> DataFrame:
    """items with the positions of order(owner, ids array<long>); others keep theirs."""
    at = order.select(owner, F.posexplode("ids").alias("_at", "file_id"))
    return items.join(at, [owner, "file_id"], "left").select(owner, "file_id", F.coalesce(F.col("_at").cast("long"), "position").alias("position"))


def cascade_delete(doomed: DataFrame, children: dict[str, DataFrame], set_null: dict[str, tuple[DataFrame, str]]) -> dict[str, DataFrame]:
    """children without the doomed file_ids; set_null tables (frame, column) with the column emptied where it is doomed."""
    out = {name: t.join(doomed.select("file_id"), "file_id", "left_anti") for name, t in children.items()}
    for name, (t, column) in set_null.items():
        gone = doomed.select(F.col("file_id").alias(column), F.lit(True).alias("_gone"))
        out[name] = t.join(gone, column, "left").withColumn(column, F.when(F.col("_gone").isNull(), F.col(column))).select(t.columns)
    return out


def orphans(persons: DataFrame, faces: DataFrame, unnamed_only: bool = False) -> DataFrame:
    """Persons without a face; after a recluster only unnamed ones go."""
    lost = persons.join(faces.where("person_id is not null").select("person_id"), "person_id", "left_anti")
    return lost.where("name is null") if unnamed_only else lost


def merged_persons(faces: DataFrame, source: int, target: int) -> DataFrame:
    """faces with every face of source given to target."""
    return faces.withColumn("person_id", F.when(F.col("person_id") == source, F.lit(target)).otherwise(F.col("person_id")))


def reset_persons(faces: DataFrame, persons: DataFrame) -> tuple[DataFrame, DataFrame]:
    """faces without persons and without a source of assignment, and no person; detections and vectors stay."""
    empty = {c: F.lit(None).cast(faces.schema[c].dataType) for c in ("person_id", "assign_src")}
    return faces.withColumns(empty), persons.limit(0)


def scan_diff(catalog: DataFrame, listing: DataFrame, completed: bool = True) -> DataFrame:
    """(volume_id, rel_path, file_id, change): new, changed, incomplete, resurrected, unchanged or gone.

    catalog(volume_id, rel_path, file_id, size_bytes, mtime_ns, content_hash, status, has_thumb), listing(volume_id,
    rel_path, size_bytes, mtime_ns). Files that a scan cut short didn't see are unchanged, not gone.
    """
    old = catalog.select("volume_id", "rel_path", "file_id", F.col("size_bytes").alias("_size"), F.col("mtime_ns").alias("_mtime"), "content_hash", "status", "has_thumb", F.lit(True).alias("_old"))
    new = listing.select("volume_id", "rel_path", "size_bytes", "mtime_ns", F.lit(True).alias("_new"))
    both = old.join(new, ["volume_id", "rel_path"], "full_outer")
    change = (
        F.when(F.col("_old").isNull(), "new")
        .when(F.col("_new").isNull() & (F.col("status") == "active") & F.lit(completed), "gone")
        .when(F.col("_new").isNull(), "unchanged")
        .when((F.col("_size") != F.col("size_bytes")) | (F.col("_mtime") != F.col("mtime_ns")), "changed")
        .when(F.col("content_hash").isNull() | ~F.col("has_thumb"), "incomplete")
        .when(F.col("status") == "missing", "resurrected")
        .otherwise("unchanged")
    )
    return both.select("volume_id", "rel_path", "file_id", change.alias("change"))


def dismissed_pairs(groups: DataFrame, group_id: int) -> DataFrame:
    """(a, b) with a < b for one group's items; a group on screen, not a class of the corpus."""
    own = groups.where(F.col("group_id") == group_id).select("file_id").distinct()
    return own.select(F.col("file_id").alias("a")).join(own.select(F.col("file_id").alias("b")), F.col("a") < F.col("b"))


def fingerprint(files: DataFrame, prime: int = 1_000_000_007) -> DataFrame:
    """One row that changes when the catalog does: n, max_id, active, mtimes."""
    return files.agg(F.count("*").alias("n"), F.max("file_id").alias("max_id"), F.count_if(F.col("status") == "active").alias("active"), F.sum(F.pmod("mtime_ns", F.lit(prime))).alias("mtimes"))
