"""Events: gap sessions, their bounds, titles and inherited titles."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lantern.operators.ordered import scanned

GAP_SECONDS, LEAST_FILES, SAMPLE = 6 * 3600, 3, 400


def gap_sessions(files: DataFrame, keys: list[str] = [], gap: int = GAP_SECONDS) -> DataFrame:  # noqa: B006
    """files(keys, file_id, ts in epoch seconds) with session, the start second of its run: a new one begins after more than `gap`.

    Without keys two prefix scans find the starts and carry them on, so no window holds the timeline or a day of it.
    """
    if keys:
        w = Window.partitionBy(*keys).orderBy("ts", "file_id")
        start = F.when(F.col("ts") - F.lag("ts").over(w) <= gap, None).otherwise(F.col("ts"))
        return files.withColumn("_start", start).withColumn("session", F.last("_start", ignorenulls=True).over(w)).drop("_start")
    order = [F.col("ts"), F.col("file_id")]
    seen = scanned(files, [], order, before={"_before": F.col("ts")}).select(*files.columns, "_before")
    start = F.when(F.col("ts") - F.col("_before") <= gap, None).otherwise(F.col("ts"))
    return scanned(seen, [], order, latest={"session": start}).select(*files.columns, "session")


def session_bounds(sessions: DataFrame, keys: list[str], least: int = LEAST_FILES) -> DataFrame:
    """(keys, session, n, start_ts, end_ts, cover): sessions of `least` files or more; the cover is the middle file by time."""
    w = Window.partitionBy(*keys, "session").orderBy("ts", "file_id")
    n = F.count("*").over(Window.partitionBy(*keys, "session"))
    ranked = sessions.withColumn("_nth", F.row_number().over(w) - 1).withColumn("n", n)
    return ranked.where(F.col("n") >= least).groupBy(*keys, "session").agg(
        F.max("n").alias("n"), F.min("ts").alias("start_ts"), F.max("ts").alias("end_ts"), F.max(F.when(F.col("_nth") == F.floor(F.col("n") / 2), F.col("file_id"))).alias("cover")
    )


def modal_place(sessions: DataFrame, places: DataFrame, keys: list[str], sample: int = SAMPLE) -> DataFrame:
    """(keys, session, city) where the most frequent city of the first `sample` files has the support of max(2, n // 4)."""
    w = Window.partitionBy(*keys, "session").orderBy("ts", "file_id")
    first = sessions.withColumn("_nth", F.row_number().over(w)).where(F.col("_nth") <= sample)
    n = first.groupBy(*keys, "session").agg(F.count("*").alias("_n"))
    top = (
        first.join(places.where("city is not null").select("file_id", "city", "country"), "file_id")
        .groupBy(*keys, "session", "city", "country")
        .agg(F.count("*").alias("_c"))
        .groupBy(*keys, "session")
        .agg(F.max(F.struct("_c", "city")).alias("_top"))
    )
    return top.join(n, [*keys, "session"]).where(F.col("_top._c") >= F.greatest(F.lit(2), F.floor(F.col("_n") / 4))).select(*keys, "session", "_top.city")


def titled(bounds: DataFrame, cities: DataFrame, keys: list[str]) -> DataFrame:
    """bounds with title: the dates, behind the city where there is one."""
    a, b = F.timestamp_seconds("start_ts"), F.timestamp_seconds("end_ts")
    full = "MMM d, yyyy"
    dates = (
        F.when(F.to_date(a) == F.to_date(b), F.date_format(a, full))
        .when(F.trunc(F.to_date(a), "month") == F.trunc(F.to_date(b), "month"), F.concat(F.date_format(a, "MMM d"), F.lit("–"), F.date_format(b, "d, yyyy")))
        .otherwise(F.concat(F.date_format(a, full), F.lit(" – "), F.date_format(b, full)))
    )
    return bounds.join(cities, [*keys, "session"], "left").withColumn("title", F.when(F.col("city").isNull(), dates).otherwise(F.concat("city", F.lit(" · "), dates))).drop("city")


def inherited_titles(old_items: DataFrame, new_items: DataFrame) -> DataFrame:
    """(new_id, title): the first old titled event, by id, at least half of whose files are in the new one.

    old_items(old_id, title, file_id), new_items(new_id, file_id). One old event may title two new ones.
    """
    size = old_items.groupBy("old_id").agg(F.count_distinct("file_id").alias("_size"))
    shared = old_items.join(new_items, "file_id").groupBy("old_id", "new_id").agg(F.count_distinct("file_id").alias("_shared"), F.first("title").alias("title"))
    return shared.join(size, "old_id").where(F.col("_shared") * 2 >= F.col("_size")).groupBy("new_id").agg(F.min_by("title", "old_id").alias("title"))
