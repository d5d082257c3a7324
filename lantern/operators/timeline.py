"""Timeline aggregates, pages and neighbours."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lantern.operators.filters import clamped
from lantern.operators.ordered import scanned


def newest() -> list[Column]:
    """Timeline order."""
    return [F.desc("taken_at"), F.desc("file_id")]


def aspect(width: Column, height: Column) -> Column:
    """Width over height, 3 : 2 where either is unknown or the height 0."""
    return F.coalesce(width, F.lit(3)) / F.coalesce(F.nullif(height, F.lit(0)), F.lit(2))


def day_buckets(files: DataFrame) -> DataFrame:
    """(day, count, ar): files and summed aspect ratios per capture day."""
    return files.groupBy(F.to_date("taken_at").alias("day")).agg(F.count("*").alias("count"), F.round(F.sum(aspect(F.col("width"), F.col("height"))), 3).alias("ar"))


def items(files: DataFrame, motion: DataFrame) -> DataFrame:
    """Timeline items with their day and whether a motion clip belongs to them."""
    flag = motion.select("file_id", F.lit(True).alias("_live")).distinct()
    return files.join(flag, "file_id", "left").select("file_id", "media_type", "width", "height", F.to_date("taken_at").alias("day"), "taken_at", F.coalesce("_live", F.lit(False)).alias("live"))


def page(df: DataFrame, limit: int, offset: int = 0) -> DataFrame:
    """A page in timeline order, newest first."""
    if offset < 0:
        raise ValueError("offset is not negative")
    return df.orderBy(*newest()).offset(offset).limit(clamped(limit, 2000))


def page_after(df: DataFrame, taken_at: Column, file_id: Column, limit: int) -> DataFrame:
    """The page behind an item: keyset paging reads only what it returns, however deep."""
    behind = (F.col("taken_at") < taken_at) | ((F.col("taken_at") == taken_at) & (F.col("file_id") < file_id))
    return df.where(behind).orderBy(*newest()).limit(clamped(limit, 2000))


def neighbours(df: DataFrame) -> DataFrame:
    """Each item's previous and next file in timeline order, by a prefix scan: a day may hold any share of the items."""
    found = scanned(df.select("file_id", "taken_at"), [], newest(), before={"prev_id": F.col("file_id")}, behind={"next_id": F.col("file_id")})
    return found.select("file_id", "prev_id", "next_id")


def nearest_bucket(buckets: DataFrame, at: Column) -> DataFrame:
    """The bucket day nearest to a moment, the earlier one on ties."""
    gap = F.abs(F.datediff("day", at))
    return buckets.agg(F.min_by("day", F.struct(gap, F.col("day"))).alias("day"))


def rail_fraction(day: Column, newest_day: Column, oldest_day: Column) -> Column:
    """Where a day lies on the rail from the newest (0) to the oldest (1)."""
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.datediff(newest_day, day) / F.greatest(F.datediff(newest_day, oldest_day), F.lit(1))))


def rail_ticks(buckets: DataFrame, apart: float = 0.045) -> DataFrame:
    """(label, frac): a mark for each year of the buckets, or each month within one year, no two nearer than `apart`.

    Kept greedily from the newest on; there are at most 1 / apart + 1 of them, found over one row per year or month.
    """
    ends = buckets.agg(F.max("day").alias("new"), F.min("day").alias("old"))
    years = F.year("new") > F.year("old")
    unit = F.when(years, F.make_interval(years=F.lit(1))).otherwise(F.make_interval(months=F.lit(1)))
    start = F.when(years, F.trunc("old", "year")).otherwise(F.trunc("old", "month"))
    marks = ends.select("new", "old", years.alias("years"), F.explode(F.sequence(start, F.col("new"), unit)).alias("at"))
    inside = F.greatest("old", F.least("new", "at"))
    frac = rail_fraction(inside, F.col("new"), F.col("old"))
    label = F.when(F.col("years"), F.date_format("at", "yyyy")).otherwise(F.date_format("at", "MMM"))
    listed = marks.select(F.struct(frac.alias("frac"), label.alias("label")).alias("t")).agg(F.array_sort(F.collect_list("t")).alias("ticks"))  # a row per year or month
    kind = "array<struct<frac:double,label:string>>"
    spaced = F.aggregate("ticks", F.array().cast(kind), lambda out, t: F.when((F.size(out) == 0) | (t["frac"] - F.try_element_at(out, F.lit(-1))["frac"] >= apart), F.array_append(out, t)).otherwise(out))
    return listed.select(F.explode(spaced).alias("t")).select("t.label", "t.frac")
