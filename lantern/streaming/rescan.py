"""Streaming forms of the periodic rescan: listing files in, the catalog upserted per micro-batch."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery, StreamingQueryListener

from lantern.streaming.ranges import RANGES, change_ranges, fingerprint_of, pointer, read_ranges


def listing_stream(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Listings as they arrive, as Parquet files in a folder."""
    return spark.readStream.schema(schema).parquet(path)


def keep_catalog(stream: DataFrame, catalog_path: str, keys: list[str], order: str, checkpoint: str, downstream: Callable[[DataFrame], None] | None = None, versions: int = 3, ranges: int = RANGES) -> StreamingQuery:
    """Upsert each micro-batch into the catalog in key ranges at catalog_path; run downstream only if its fingerprint changed.

    A batch rewrites the ranges that it touches, behind one pointer. The catalog goes on from its newest state whatever
    the checkpoint; a batch that the same checkpoint replays is applied once. The last `versions` states (2 at least) can
    be read. Read the catalog with ranges.read_ranges().
    """

    def apply(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        before = fingerprint_of(pointer(spark, catalog_path))
        after = fingerprint_of(change_ranges(batch, catalog_path, keys, order, ranges, versions, [checkpoint, batch_id]))
        if downstream is not None and before != after:
            downstream(read_ranges(spark, catalog_path))

    return stream.writeStream.foreachBatch(apply).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def session_stream(events: DataFrame, key: str, gap: str = "6 hours", late: str = "1 day") -> DataFrame:
    """Event-time gap sessions per key with a watermark; an extension, the batch form is operators.sessions."""
    return events.withWatermark("ts", late).groupBy(F.session_window("ts", gap), key).agg(F.count("*").alias("n")).select(key, F.col("session_window.start").alias("start_ts"), "n")


class ProgressLog(StreamingQueryListener):
    """The last `most` progress reports of all queries, oldest dropped first."""

    def __init__(self, most: int = 500) -> None:
        self.most, self.reports = most, []

    def onQueryStarted(self, event) -> None:  # noqa: ANN001, N802
        self._add("started", str(event.id))

    def onQueryProgress(self, event) -> None:  # noqa: ANN001, N802
        self._add("progress", event.progress.json)

    def onQueryIdle(self, event) -> None:  # noqa: ANN001, N802
        self._add("idle", str(event.id))

    def onQueryTerminated(self, event) -> None:  # noqa: ANN001, N802
        self._add("ended", str(event.id))

    def _add(self, kind: str, what: str) -> None:
        self.reports = [*self.reports, (kind, what)][-self.most :]
