"""A catalog in key ranges: a change rewrites the ranges that it touches, and one small file says which folders count."""

from __future__ import annotations

import json
import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lantern.operators.changes import upsert
from lantern.session import remove

RANGES, RANGE = 256, "_range"


def _files(spark: SparkSession, path: str) -> list[str]:
    """Names in a folder, none where there is no folder."""
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    fs = p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    return sorted(f.getPath().getName() for f in fs.listStatus(p)) if fs.exists(p) else []


def pointer(spark: SparkSession, path: str) -> dict:
    """The newest state of a catalog: version, ranges in all, schema, and for each range with rows its folder's version and fingerprint; empty before the first change."""
    states = [n for n in _files(spark, f"{path}/state") if re.fullmatch(r"\d{12}\.json", n)]
    if not states:
        return {}
    return json.loads(spark.read.text(f"{path}/state/{states[-1]}", wholetext=True).first()[0])


def _set(spark: SparkSession, path: str, state: dict) -> None:
    """Make a state the newest: a whole file under another name, then a rename that fails if another writer was first."""
    jvm, at = spark.sparkContext._jvm, f"{path}/state/{state['version']:012d}.json"
    new, old = (jvm.org.apache.hadoop.fs.Path(x) for x in (at, f"{path}/state/_{state['version']:012d}.tmp"))
    fs = new.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    out = fs.create(old, True)
    out.write(bytearray(json.dumps(state).encode()))
    out.close()
    if fs.exists(new) or not fs.rename(old, new):
        raise RuntimeError(f"{at} was written by somebody else")


def read_ranges(spark: SparkSession, path: str, only: list[int] | None = None) -> DataFrame | None:
    """The catalog, or its ranges in `only`; None before the first change."""
    state = pointer(spark, path)
    if not state:
        return None
    folders = [f"{path}/data/version={v:012d}/{RANGE}={r}" for r, (v, *_) in sorted(state["ranges"].items()) if only is None or int(r) in only]
    found = spark.read.schema(state["schema"])
    return found.parquet(*folders) if folders else spark.createDataFrame([], state["schema"])


def _range_of(keys: list[str], ranges: int):
    return F.pmod(F.xxhash64(*keys), F.lit(ranges)).cast("int")


def change_ranges(batch: DataFrame, path: str, keys: list[str], order: str, ranges: int = RANGES, versions: int = 3, source: list | None = None) -> dict:
    """Upsert rows into the catalog and return its new state; a catalog keeps the number of ranges that it began with.

    Ranges are spans of the keys' hash. Those that the batch touches are read, merged and written under a new version;
    the others' folders are named again. A change with the `source` of the newest one (a stream and its batch) was
    applied before and does nothing. Folders that the last `versions` states don't name are removed.
    """
    spark = batch.sparkSession
    state = pointer(spark, path)
    if state and source is not None and state.get("source") == source:
        return state
    ranges = state.get("count", ranges)
    of = _range_of(keys, ranges)
    touched = sorted(r[0] for r in batch.select(of).distinct().collect())  # a number of each range at most
    version = state.get("version", -1) + 1
    new_state = {"version": version, "count": ranges, "schema": state.get("schema") or ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in batch.schema.fields), "ranges": dict(state.get("ranges", {})), "source": source}
    if touched:
        old = read_ranges(spark, path, touched)
        merged = upsert(batch.limit(0) if old is None else old, batch.select(batch.columns if old is None else old.columns), keys, order)
        out = f"{path}/data/version={version:012d}"
        merged.withColumn(RANGE, of).repartition(RANGE).write.mode("overwrite").partitionBy(RANGE).parquet(out)
        written = spark.read.option("basePath", out).parquet(out)
        for r in written.groupBy(RANGE).agg(F.count("*").alias("n"), F.sum(F.xxhash64(*merged.columns).cast("decimal(38,0)")).cast("string").alias("h")).collect():  # a row a range
            new_state["ranges"][str(r[RANGE])] = [version, r.n, r.h]
    _set(spark, path, new_state)
    _clean(spark, path, versions)
    return new_state


def _clean(spark: SparkSession, path: str, versions: int) -> None:
    states = [n for n in _files(spark, f"{path}/state") if re.fullmatch(r"\d{12}\.json", n)]
    for name in states[: -max(2, versions)]:
        remove(spark, f"{path}/state/{name}")
    named: dict[str, set[str]] = {}
    for name in states[-max(2, versions) :]:
        for r, (v, *_) in json.loads(spark.read.text(f"{path}/state/{name}", wholetext=True).first()[0])["ranges"].items():
            named.setdefault(f"version={v:012d}", set()).add(f"{RANGE}={r}")
    for folder in _files(spark, f"{path}/data"):
        if folder not in named:
            remove(spark, f"{path}/data/{folder}")
            continue
        for part in _files(spark, f"{path}/data/{folder}"):
            if part.startswith(f"{RANGE}=") and part not in named[folder]:
                remove(spark, f"{path}/data/{folder}/{part}")


def fingerprint_of(state: dict) -> tuple:
    """What differs when any row of the catalog does."""
    return tuple(sorted((r, n, h) for r, (_, n, h) in state.get("ranges", {}).items()))
