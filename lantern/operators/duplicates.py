"""Exact and near duplicates of files."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lantern.operators.components import connected_components
from lantern.session import written


def exact_groups(files: DataFrame, key: str, rank: list[Column], size: str) -> DataFrame:
    """(key, n, keeper, reclaimable): values held by two files or more; the keeper ranks highest, the lowest id on ties."""
    best = F.max_by("file_id", F.struct(*rank, -F.col("file_id")))
    kept = F.max_by(size, F.struct(*rank, -F.col("file_id")))
    return files.where(F.col(key).isNotNull()).groupBy(key).agg(F.count("*").alias("n"), best.alias("keeper"), (F.sum(size) - kept).alias("reclaimable")).where("n > 1")


WIDE, BLOCK, TASKS = 8, 4096, 4096


def near_pairs(hashes: DataFrame, threshold: int) -> DataFrame:
    """(a, b, distance), a < b, of distinct 64-bit hashes (column h) within the Hamming threshold; nothing is missed.

    Below WIDE by four indexes of 16 bits, one of which differs by a quarter of the threshold at most: one side asks with
    all keys of that small ball, so a key has few partners and Spark may split a hot one. From WIDE on a ball has hundreds
    of keys, and hashes that lie near each other share most of them: blocks of hashes are compared with each other by
    their bits, which costs less than a row for each shared key. Equal hashes are one row here.
    """
    known = hashes.select("h").where("h is not null").distinct()
    if threshold >= WIDE:
        return _blocked(known, threshold, _block_pairs, "a long, b long, distance int")
    q, rest = divmod(threshold, 4)
    keys = [F.shiftrightunsigned("h", 16 * i).bitwiseAND(F.lit(0xFFFF)).cast("int") for i in range(4)]
    held = known.select(F.col("h").alias("b"), F.posexplode(F.array(*keys)).alias("part", "key"))
    # with rest r, one of the first r + 1 indexes differs by q at most or one of the others by q - 1
    balls = [_ball(q) if i <= rest else _ball(q - 1) for i in range(4)]
    asked = known.select(F.col("h").alias("a"), F.explode(F.array(*(F.struct(F.lit(i).alias("part"), k.alias("own"), F.array(*map(F.lit, ball)).alias("ball")) for i, (k, ball) in enumerate(zip(keys, balls)) if ball))).alias("x"))
    asked = asked.select("a", "x.part", F.explode(F.transform("x.ball", lambda m: m.bitwiseXOR(F.col("x.own")))).alias("key"))
    distance = F.bit_count(F.col("a").bitwiseXOR(F.col("b"))).cast("int")
    # Spark's estimate doesn't know how many rows a ball makes: neither side is broadcast
    return asked.hint("merge").join(held, ["part", "key"]).where((F.col("a") < F.col("b")) & (distance <= threshold)).select("a", "b", distance.alias("distance")).distinct()


def _ball(radius: int) -> list[int]:
    """All 16-bit masks of at most `radius` bits."""
    return [sum(1 << i for i in bits) for n in range(radius + 1) for bits in combinations(range(16), n)]


def near_counts(hashes: DataFrame, threshold: int) -> DataFrame:
    """(h, n_links) of the distinct hashes: how many others lie within the threshold. No pair is listed."""
    known = hashes.select("h").where("h is not null").distinct()
    counts = _blocked(known, threshold, _block_counts, "h long, n long")
    return known.join(counts.groupBy("h").agg(F.sum("n").alias("n_links")), "h", "left").select("h", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"))


def near_links(hashes: DataFrame, threshold: int) -> DataFrame:
    """(a, b): links with the components of all pairs within the threshold; each pair of blocks gives a forest, not its pairs."""
    known = hashes.select("h").where("h is not null").distinct()
    if threshold < WIDE:
        return near_pairs(hashes, threshold).select("a", "b")
    return _blocked(known, threshold, _block_forest, "a long, b long")


def _blocked(known: DataFrame, threshold: int, work: Callable, schema: str) -> DataFrame:
    """work(p, q, distances, same) of every two blocks of about BLOCK hashes, each dealt as one row."""
    blocks = max(1, -(-known.count() // BLOCK))
    packed = known.groupBy(F.pmod(F.xxhash64("h"), F.lit(blocks)).cast("int").alias("block")).agg(F.sort_array(F.collect_list("h")).alias("hs"))  # about BLOCK a row
    packed = written(packed, "hash-blocks")
    left = packed.select(F.col("block").alias("a"), F.col("hs").alias("p")).withColumn("b", F.explode(F.sequence(F.col("a"), F.lit(blocks - 1))))
    pairs = left.join(packed.select(F.col("block").alias("b"), F.col("hs").alias("q")), "b").select("a", "b", "p", "q")
    # small rows that make long work: tasks of a given number, which Spark would else put together by their bytes
    pairs = pairs.repartition(min(TASKS, blocks * (blocks + 1)), "a", "b")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                one = batch.slice(i, 1)
                p, q = (one.column(c).flatten().to_numpy() for c in (2, 3))
                same = one.column(0)[0].as_py() == one.column(1)[0].as_py()
                near = np.empty((len(p), len(q)), np.uint8)
                for at in range(0, len(p), 32):  # as much as stays near the processor
                    near[at : at + 32] = np.bitwise_count((p[at : at + 32, None] ^ q[None]).view(np.uint64))  # of signed numbers it would count the absolute value's bits
                out = work(p, q, near, near <= threshold, same)
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in out], names=[x.split()[0] for x in schema.split(", ")])

    return pairs.mapInArrow(run, schema)


def _block_pairs(p: np.ndarray, q: np.ndarray, distance: np.ndarray, near: np.ndarray, same: bool) -> tuple:
    i, j = np.nonzero(np.triu(near, 1) if same else near)
    return np.minimum(p[i], q[j]), np.maximum(p[i], q[j]), distance[i, j].astype(np.int32)


def _block_counts(p: np.ndarray, q: np.ndarray, distance: np.ndarray, near: np.ndarray, same: bool) -> tuple:
    if same:
        return p, near.sum(axis=1).astype(np.int64) - 1
    return np.concatenate((p, q)), np.concatenate((near.sum(axis=1), near.sum(axis=0))).astype(np.int64)


def _block_forest(p: np.ndarray, q: np.ndarray, distance: np.ndarray, near: np.ndarray, same: bool) -> tuple:
    """Each hash and the first hash of those that it reaches inside the two blocks; a row of `near` is looked at once."""
    rows, columns = np.full(len(p), -1), np.full(len(q), -1)
    linked = near.sum(axis=1) > same  # in one block a hash is near itself
    for start in np.flatnonzero(linked).tolist():
        if rows[start] >= 0:
            continue
        rows[start] = start
        front = np.array([start])
        while len(front):
            reached = np.flatnonzero(near[front].any(axis=0) & (columns < 0))
            columns[reached] = start
            front = reached[rows[reached] < 0] if same else np.flatnonzero(near[:, reached].any(axis=1) & (rows < 0))
            rows[front] = start
    moved, other = np.flatnonzero((rows >= 0) & (rows != np.arange(len(p)))), np.flatnonzero(columns >= 0)
    if same:
        return p[moved], p[rows[moved]]
    return np.concatenate((p[moved], q[other])), np.concatenate((p[rows[moved]], p[columns[other]]))


def near_groups(files: DataFrame, threshold: int, dismissed: DataFrame | None = None) -> DataFrame:
    """(file_id, group_id) of near-duplicate groups of two files or more; group_id is the smallest file_id.

    files(file_id, h). dismissed(a, b) are file pairs, a < b, whose link is left out; they may still meet through others.
    Files with equal hashes link to one of them, so a large group of copies gives as many links as files. With dismissed
    pairs that one is a file of no such pair, which no link of it can leave out; only hashes all of whose files are in
    dismissed pairs link file by file, and those are as few as the pairs that a user has dismissed by hand.
    """
    first = files.where("h is not null").groupBy("h").agg(F.min("file_id").alias("first"))
    if dismissed is None:
        chain = files.join(first, "h").where("file_id <> first").select(F.col("first").alias("a"), F.col("file_id").alias("b"))
        x, y = first.select(F.col("h").alias("a"), F.col("first").alias("x")), first.select(F.col("h").alias("b"), F.col("first").alias("y"))
        pairs = near_links(files, threshold).join(x, "a").join(y, "b").select(F.col("x").alias("a"), F.col("y").alias("b"))
        links = chain.unionByName(pairs)
    else:
        marked = dismissed.select(F.col("a").alias("file_id")).unionByName(dismissed.select(F.col("b").alias("file_id"))).distinct()
        free = files.where("h is not null").join(marked, "file_id", "left_anti").groupBy("h").agg(F.min("file_id").alias("free"))
        chain = files.join(free, "h").where("file_id <> free").select(F.col("free").alias("a"), F.col("file_id").alias("b"))
        agents = files.select("h", "file_id").join(free, "h", "left_anti").unionByName(free.select("h", F.col("free").alias("file_id")))
        own = near_pairs(files.where("h is not null"), threshold).select("a", "b").unionByName(first.select(F.col("h").alias("a"), F.col("h").alias("b")))
        l, r = agents.select(F.col("h").alias("a"), F.col("file_id").alias("x")), agents.select(F.col("h").alias("b"), F.col("file_id").alias("y"))
        between = own.join(l, "a").join(r, "b").where("x <> y").select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct()
        links = chain.unionByName(between.join(dismissed.select("a", "b"), ["a", "b"], "left_anti"))
    roots = connected_components(links)
    return roots.select(F.col("node").alias("file_id"), F.col("root").alias("group_id"))
