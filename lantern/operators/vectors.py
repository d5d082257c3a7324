"""Vectors: centroids, nearest assignment, merging and relabelling of clusters."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lantern.operators.clusters import BLOCK, block_pairs, both, packed, rows_of, unpack
from lantern.operators.components import connected_components
from lantern.operators.ordered import scanned

KEYS = 4096  # sums that a task holds before it sends them


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def unit(a: Column) -> Column:
    n = norm(a)
    return F.when(n > 0, F.transform(a, lambda x: x.cast("double") / n))


def cosine(a: Column, b: Column) -> Column:
    return dot(a, b) / (norm(a) * norm(b))


def vector_sums(vectors: DataFrame, key: str, column: str = "embedding") -> DataFrame:
    """(key, n, total): the number of each key's vectors and their sum. Tasks add up first, so a hot key is a row a task; null keys and vectors count nowhere."""
    known = vectors.where(F.col(key).isNotNull() & F.col(column).isNotNull()).select(F.col(key).cast("long").alias(key), column)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, tuple[int, np.ndarray]] = {}

        def out() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(list(held), pa.int64()), pa.array([n for n, _ in held.values()], pa.int64()), pa.array([x.tolist() for _, x in held.values()], pa.list_(pa.float64()))], names=[key, "n", "total"])

        for batch in batches:
            x, keys = matrix(batch.column(1)), batch.column(0).to_numpy(zero_copy_only=False)
            order = np.argsort(keys, kind="stable")
            names, starts = np.unique(keys[order], return_index=True)
            for k, total, n in zip(names.tolist(), np.add.reduceat(x[order], starts, axis=0) if len(x) else [], np.diff([*starts, len(keys)]).tolist()):
                before = held.get(k, (0, 0.0))
                held[k] = (before[0] + n, before[1] + total)
            if len(held) > KEYS:
                yield out()
                held.clear()
        yield out()

    partial = known.mapInArrow(run, f"{key} long, n long, total array<double>")
    return _added(partial, key).select(F.col(key).cast(vectors.schema[key].dataType).alias(key), "n", "total")


def _added(sums: DataFrame, key: str) -> DataFrame:
    """Rows (key, n, total) of one key as one; there are as many as tasks and changes made, not as vectors."""
    start = F.transform(F.get("_all", F.lit(0)), lambda _: F.lit(0.0))
    grouped = sums.groupBy(key).agg(F.sum("n").alias("n"), F.collect_list("total").alias("_all"))
    return grouped.select(key, "n", F.aggregate("_all", start, lambda a, b: F.zip_with(a, b, lambda x, y: x + y)).alias("total"))


def updated_sums(sums: DataFrame, added: DataFrame, removed: DataFrame, key: str, column: str = "embedding") -> DataFrame:
    """vector_sums() after vectors came and went, by the changes alone; keys without vectors are gone. A vector that moves is removed under its old key and added under its new one."""
    less = vector_sums(removed, key, column).select(key, (-F.col("n")).alias("n"), F.transform("total", lambda x: -x).alias("total"))
    return _added(sums.unionByName(vector_sums(added, key, column)).unionByName(less), key).where("n > 0")


def summed_centroids(sums: DataFrame, key: str) -> DataFrame:
    """(key, n, centroid) of vector_sums(): the mean vector scaled to length 1, null where it is zero."""
    return sums.select(key, "n", unit(F.transform("total", lambda x: x / F.col("n"))).alias("centroid"))


def centroids(vectors: DataFrame, key: str, column: str = "embedding") -> DataFrame:
    """(key, n, centroid): the mean vector of each key, scaled to length 1."""
    return summed_centroids(vector_sums(vectors, key, column), key)


def matrix(column: pa.Array) -> np.ndarray:
    """A list column without nulls as rows of doubles."""
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), -1)


def assign_nearest(vectors: DataFrame, table: DataFrame, least: float, key: str, column: str = "embedding", most_bytes: int = 128 << 20) -> DataFrame:
    """vectors with key and similarity of the most similar centroid at cosine `least` or more, both null below it.

    Null and zero vectors have no direction: both are null for them, and zero or null centroids draw nobody. Passes over
    the vectors follow each other in the same tasks, one for each matrix of centroids of about `most_bytes`; rows keep
    their columns, so nothing is joined back. Ties, to nine places, go to the smallest key.
    """
    spark = vectors.sparkSession
    known = table.where(F.col("centroid").isNotNull())
    n, width = known.agg(F.count("*"), F.max(F.size("centroid"))).head()
    parts = max(1, -(-n * 8 * (width or 0) // most_bytes))
    at = vectors.columns.index(column)
    out = vectors.withColumns({"_sim": F.lit(None).cast("double"), "_key": F.lit(None).cast("long")})
    for part in range(parts):
        rows = known.where(F.pmod(F.xxhash64(key), F.lit(parts)) == part) if parts > 1 else known
        rows = rows.select(F.col(key).cast("long").alias("k"), F.col("centroid").cast("array<double>").alias("c")).orderBy("k").toArrow()  # about `most_bytes`
        if not rows.num_rows:
            continue
        m = matrix(rows["c"].combine_chunks())
        length = np.linalg.norm(m, axis=1)
        shared = spark.sparkContext.broadcast((rows["k"].to_numpy()[length > 0], m[length > 0] / length[length > 0, None]))

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:  # noqa: ANN001
            ids, m = shared.value
            for batch in batches:
                sim, best = (batch.column(i).to_numpy(zero_copy_only=False).astype(float) for i in (-2, -1))
                has = batch.column(-1).is_valid().to_numpy(zero_copy_only=False)
                keys = batch.column(-1).fill_null(0).to_numpy(zero_copy_only=False).copy()
                valid = np.flatnonzero(batch.column(at).is_valid().to_numpy(zero_copy_only=False))
                if len(valid) and len(ids):
                    x = matrix(batch.column(at).take(pa.array(valid)))
                    norm = np.linalg.norm(x, axis=1)
                    valid, x, norm = valid[norm > 0], x[norm > 0], norm[norm > 0]
                    own = np.round(x @ m.T / norm[:, None], 9)
                    first = own.argmax(axis=1) if len(x) else np.zeros(0, int)
                    value, name = own[np.arange(len(x)), first], ids[first]
                    better = ~has[valid] | (value > sim[valid]) | ((value == sim[valid]) & (name < keys[valid]))
                    sim[valid[better]], keys[valid[better]], has[valid[better]] = value[better], name[better], True
                yield pa.RecordBatch.from_arrays([*batch.columns[:-2], pa.array(sim, mask=~has), pa.array(keys, mask=~has)], names=batch.schema.names)

        out = out.mapInArrow(run, out.schema)
    sure = F.col("_sim") >= least
    return out.select(*vectors.columns, F.when(sure, F.col("_key")).cast(table.schema[key].dataType).alias(f"nearest_{key}"), F.when(sure, F.col("_sim")).alias("similarity"))


def similar_centroids(table: DataFrame, key: str, least: float, rows: int = BLOCK) -> DataFrame:
    """(a, b, similarity), a < b, of cluster centroids of length 1 at cosine `least` or more; null centroids have no pair.

    Centroids are packed into blocks around pivots; blocks too far apart for `least` by centres and radii never meet,
    and two that may are one matrix product.
    """
    known = table.where(F.col("centroid").isNotNull()).select(F.col(key).cast("long").alias("vec_id"), F.col("centroid").cast("array<double>").alias("centroid"))
    schema = "a long, b long, similarity double"
    if known.isEmpty():
        return table.sparkSession.createDataFrame([], schema)
    blocks = packed(known, "centroid", rows)
    n_blocks = blocks.agg(F.max("block")).first()[0] + 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for r in rows_of(batches):
            (p, x), (q, y) = unpack(r["a_ids"], r["a_x"]), unpack(r["b_ids"], r["b_x"])
            sim = x @ y.T
            i, j = np.nonzero((np.round(sim, 12) >= least) & ((p[:, None] < q[None]) | (r["a"] != r["b"])))
            yield pa.RecordBatch.from_arrays([pa.array(np.minimum(p[i], q[j])), pa.array(np.maximum(p[i], q[j])), pa.array(sim[i, j])], names=["a", "b", "similarity"])

    own = blocks.select(F.col("block").alias("a"), F.col("block").alias("b"))
    if n_blocks > 1:
        pairs = block_pairs(blocks.select("block", "centre", "radius"), n_blocks)
        apart = F.sqrt(F.aggregate(F.zip_with("a_centre", "b_centre", lambda u, v: (u - v) * (u - v)), F.lit(0.0), lambda s, v: s + v)) - F.col("a_radius") - F.col("b_radius")
        own = own.unionByName(pairs.where(apart <= math.sqrt(max(0.0, 2 - 2 * least)) + 1e-6).select("a", "b"))
    return both(own, blocks).mapInArrow(run, schema)


def merged_clusters(pairs: DataFrame, names: DataFrame) -> DataFrame:
    """(cluster, merged) of every cluster in pairs(a, b, similarity): merge_clusters() inside each component of the pairs.

    names(cluster, name) has the named clusters; null names count as none. Merges of different components never meet, so
    the components are independent tasks. Repeated pairs count once; an empty table gives an empty result.
    """
    links = pairs.select(F.least("a", "b").cast("long").alias("a"), F.greatest("a", "b").cast("long").alias("b"), F.col("similarity").cast("double").alias("similarity")).where("a < b")
    roots = connected_components(links.select("a", "b"))
    edges = links.join(roots, F.col("a") == F.col("node")).select("root", "a", "b", "similarity", F.lit(None).cast("string").alias("name"))
    own = roots.join(names.where("name is not null").select(F.col("cluster").cast("long").alias("node"), "name"), "node")
    named = own.select("root", F.col("node").alias("a"), F.col("node").alias("b"), F.lit(None).cast("double").alias("similarity"), "name")

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        one, carried = pdf[pdf["name"].isna()], pdf[pdf["name"].notna()]
        out = merge_clusters(list(zip(one["a"], one["b"], one["similarity"], strict=True)), dict(zip(carried["a"], carried["name"], strict=True)))
        return pd.DataFrame({"cluster": list(out), "merged": list(out.values())}, dtype="int64")

    return edges.unionByName(named).groupBy("root").applyInPandas(run, "cluster long, merged long")


def merge_clusters(pairs: list[tuple[int, int, float]], names: dict[int, str]) -> dict[int, int]:
    """cluster -> smallest cluster merged with it, most similar pairs first, never two that carry different names."""
    parent: dict[int, int] = {}
    name = dict(names)

    def find(x: int) -> int:
        while parent.get(x, x) != x:
            x = parent[x]
        return x

    for a, b, _ in sorted(pairs, key=lambda p: (-p[2], p[0], p[1])):
        a, b = sorted((find(a), find(b)))
        if a != b and not (a in name and b in name and name[a] != name[b]):
            parent[b] = a
            if b in name:
                name.setdefault(a, name[b])
    return {x: find(x) for p in pairs for x in p[:2]}


def relabelled(votes: DataFrame, parts: int = 3) -> DataFrame:
    """(cluster, person_id): a named person claims the cluster with most of its votes, if those pass 1 / parts of the cluster.

    votes(cluster, person_id): a row per member face, person_id null where it has none. A person claims one cluster and
    a cluster goes to one person, the one with more votes, the smaller id on ties.
    """
    size = votes.groupBy("cluster").agg(F.count("*").alias("size"))
    tally = votes.where("person_id is not null").groupBy("cluster", "person_id").agg(F.count("*").alias("n"))
    claim = tally.groupBy("person_id").agg(F.max_by(F.struct("cluster", "n"), F.struct("n", -F.col("cluster"))).alias("c")).select("person_id", "c.*")
    return claim.join(size, "cluster").where(F.col("n") * parts > F.col("size")).groupBy("cluster").agg(F.max_by("person_id", F.struct("n", -F.col("person_id"))).alias("person_id"))


def relabelled_faces(faces: DataFrame, persons: DataFrame) -> DataFrame:
    """(face_id, person_id, assign_src) of all faces after a new clustering.

    faces(face_id, cluster, person_id, assign_src), cluster null or below 0 for noise; persons(person_id, name). Faces
    assigned by hand stay as they are. A named person takes the cluster that relabelled() gives; every other cluster is a
    new person, numbered behind the largest id by rising cluster. Noise loses what was assigned automatically.
    """
    named = persons.where("name is not null").select(F.col("person_id").alias("_p"))
    member = faces.where("cluster >= 0")
    votes = member.join(named, F.col("person_id") == F.col("_p"), "left").select("cluster", F.col("_p").alias("person_id"))
    claims = relabelled(votes)
    last = persons.select("person_id").unionByName(faces.select("person_id")).agg(F.coalesce(F.max("person_id"), F.lit(0))).first()[0]
    free = member.select("cluster").distinct().join(claims, "cluster", "left_anti")
    new = scanned(free, [], [F.col("cluster")]).select("cluster", (F.col("pos") + F.lit(last + 1)).cast("long").alias("person_id"))
    given = claims.select("cluster", F.col("person_id").cast("long").alias("_new")).unionByName(new.select("cluster", F.col("person_id").alias("_new")))
    by_hand = F.coalesce((F.col("assign_src") == "manual") & F.col("person_id").isNotNull(), F.lit(False))
    out = faces.join(given, "cluster", "left")
    return out.select("face_id", F.when(by_hand, F.col("person_id")).otherwise(F.col("_new")).cast("long").alias("person_id"), F.when(by_hand, F.col("assign_src")).when(F.col("_new").isNotNull(), F.lit("cluster")).alias("assign_src"))


def cover_faces(faces: DataFrame) -> DataFrame:
    """(person_id, cover_face_id): detection score times the root of the area, half as much again if alone on the photo."""
    alone = faces.groupBy("file_id").agg(F.count("*").alias("_on"))
    score = F.col("det_score") * F.sqrt(F.col("w") * F.col("h")) * F.when(F.col("_on") == 1, 1.5).otherwise(1.0)
    return faces.join(alone, "file_id").where("person_id is not null").groupBy("person_id").agg(F.max_by("face_id", F.struct(score, -F.col("face_id"))).alias("cover_face_id"))
