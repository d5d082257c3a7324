"""The filter algebra of every grid: composable predicates over a files table.

files(file_id, media_type, status, taken_at, ...); the other tables are optional and joined by file_id. Membership tests
are semi and anti joins on non-null keys, so Catalyst picks broadcast or sort-merge and no NOT IN null semantics apply.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SHARPNESS_CEILINGS = {"gentle": 100.0, "normal": 400.0, "aggressive": 1200.0}


@dataclass(frozen=True)
class FilterSpec:
    """What a grid shows. kind: 'any' for every non-photo, a name for one kind, None for ordinary photos unless curated."""

    person_id: int | None = None
    solo: bool = False
    country: str | None = None
    city: str | None = None
    album_id: int | None = None
    event_id: int | None = None
    day: str | None = None
    media_type: str | None = None
    kind: str | None = None
    live: bool = False

    @property
    def curated(self) -> bool:
        return self.album_id is not None or self.person_id is not None or self.country is not None


@dataclass(frozen=True)
class Catalog:
    """The tables the filters look at; a missing one stands for an empty one."""

    files: DataFrame
    locked: DataFrame | None = None
    kinds: DataFrame | None = None
    motion: DataFrame | None = None
    faces: DataFrame | None = None
    places: DataFrame | None = None
    album_items: DataFrame | None = None
    event_items: DataFrame | None = None


def visible_files(files: DataFrame, locked: DataFrame | None) -> DataFrame:
    """Active files with a capture time that nobody locked."""
    out = files.where("status = 'active' and taken_at is not null")
    return out if locked is None else out.join(locked.select("file_id"), "file_id", "left_anti")


def _members(table: DataFrame | None, condition: Column | str) -> DataFrame | None:
    return None if table is None else table.where(condition).select("file_id")


def _semi(df: DataFrame, members: DataFrame | None) -> DataFrame:
    return df.where(F.lit(False)) if members is None else df.join(members, "file_id", "left_semi")


def _anti(df: DataFrame, members: DataFrame | None) -> DataFrame:
    return df if members is None else df.join(members, "file_id", "left_anti")


def apply_filter(catalog: Catalog, spec: FilterSpec = FilterSpec()) -> DataFrame:
    """The visible files that satisfy every part of the spec."""
    out = visible_files(catalog.files, catalog.locked)
    special = _members(catalog.kinds, "kind <> 'photo'")
    if spec.kind == "any":
        out = _semi(out, special)
    elif spec.kind:
        out = _semi(out, _members(catalog.kinds, F.col("kind") == spec.kind))
    elif not spec.curated:
        out = _anti(out, special)
    if spec.live:
        out = _semi(out, _members(catalog.motion, F.lit(True)))
    if spec.media_type in ("photo", "video"):
        out = out.where(F.col("media_type") == spec.media_type)
    if spec.media_type != "photo" and not spec.live and catalog.motion is not None:
        clips = catalog.motion.where("video_file_id is not null").select(F.col("video_file_id").alias("file_id"))
        out = _anti(out, clips)
    if spec.person_id is not None:
        out = _semi(out, _members(catalog.faces, F.col("person_id") == spec.person_id))
        if spec.solo:
            out = _anti(out, _members(catalog.faces, F.col("person_id").isNotNull() & (F.col("person_id") != spec.person_id)))
    if spec.country is not None:
        at = F.col("country") == spec.country
        out = _semi(out, _members(catalog.places, at if spec.city is None else at & (F.col("city") == spec.city)))
    if spec.album_id is not None:
        out = _semi(out, _members(catalog.album_items, F.col("album_id") == spec.album_id))
    if spec.event_id is not None:
        out = _semi(out, _members(catalog.event_items, F.col("event_id") == spec.event_id))
    if spec.day is not None:
        day = F.to_date(F.lit(spec.day))
        out = out.where((F.col("taken_at") >= day) & (F.col("taken_at") < F.date_add(day, 1)))
    return out


def soft_photos(quality: DataFrame, files: DataFrame, tier: str = "normal", limit: int = 200) -> DataFrame:
    """The least sharp files under the tier's ceiling, softest first."""
    if tier not in SHARPNESS_CEILINGS:
        raise ValueError(f"tier is one of {sorted(SHARPNESS_CEILINGS)}")
    soft = quality.where(F.col("sharpness") < SHARPNESS_CEILINGS[tier]).join(files, "file_id")
    return soft.orderBy("sharpness", "file_id").limit(clamped(limit, 1000))


def without_row(files: DataFrame, derived: DataFrame) -> DataFrame:
    """The work-list of an incremental stage: files that have no row in its result yet."""
    return files.join(derived.select("file_id"), "file_id", "left_anti")


def missing_files(files: DataFrame, ids: DataFrame | None = None) -> DataFrame:
    """Files marked missing; ids=None means all of them, an empty table none."""
    gone = files.where("status = 'missing'")
    return gone if ids is None else gone.join(ids, "file_id", "left_semi")


def clamped(value: int, most: int) -> int:
    return max(1, min(int(value), most))


def checked_precision(value: int) -> int:
    if not 0 <= value <= 4:
        raise ValueError("precision is 0 .. 4")
    return value


def under_path(path: Column, prefix: Column) -> Column:
    """Whether path is the prefix or lies below it; an empty prefix holds everything. No wildcards."""
    return (prefix == "") | (path == prefix) | path.startswith(F.concat(prefix, F.lit("/")))


def searched_places(places: DataFrame, needle: str) -> DataFrame:
    """places(country, count, cities, ...) that a search finds: countries by name whole, others with the cities that match, recounted."""
    if not needle.strip():
        return places
    whole = contains_text(F.col("country"), needle)
    cities = F.filter("cities", lambda c: contains_text(c["city"], needle))
    count = F.aggregate(cities, F.lit(0).cast("long"), lambda n, c: n + c["count"])
    found = places.where(whole | (F.size(cities) > 0))
    return found.withColumns({"count": F.when(whole, F.col("count")).otherwise(count), "cities": F.when(whole, F.col("cities")).otherwise(cities)})


def contains_text(column: Column, needle: str) -> Column:
    """Case-insensitive substring search, the needle trimmed."""
    return F.lower(column).contains(needle.strip().lower())
