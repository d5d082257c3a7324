"""Density clusters of vectors: HDBSCAN over mutual reachability, exact, in tasks of bounded size.

Vectors are packed into blocks around pivots. Every two groups of blocks are dealt to a task of their own. All pairs are
looked at twice, each time by a product of two blocks in single precision that tells which pairs can matter, its error
allowed for; only those get their distance in double precision.
1. Nearest vectors and core distances come from the own block, then from the other blocks that the bound of centres and
   radii leaves. They, the trees of the blocks and an edge between every two blocks span a first tree.
2. An edge heavier than all edges between its ends in any spanning tree is in no least one. The vectors are put in an order
   in which the heaviest edge between two of them is the largest gap on the way, and are packed anew in that order: then
   the bound of a pair is the larger of one number a vector. The pairs within it and the first tree hold the least tree.
Boruvka rounds contract those edges until `most` are left, which one task finishes. The merge tree is made by
halves: the lighter edges fall into components that are trees of their own, the heavier ones join what these contract to,
until no half has more than `most` edges. Sizes, births and masses are aggregates over the merge tree.

Weights tie often: edges are ordered by (weight, smaller id, larger id), so tree and clusters are unique.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from itertools import combinations, product

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lantern.operators.components import connected_components
from lantern.operators.ordered import scanned
from lantern.session import drop_written, written

BLOCK, MOST, PIVOTS, SIDE, GROUPS = 1024, 1_000_000, 256, 64, 16
STEP = 128  # rows of a product of blocks at a time
EDGES = 1 << 18  # that a task holds before it keeps their forest only


def distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Distances of all rows, the same to the last bit for the same two vectors in whatever blocks they are."""
    out = np.empty((len(a), len(b)))
    step = max(1, (1 << 17) // max(1, b.size))
    for i in range(0, len(a), step):
        gap = a[i : i + step, None, :] - b[None]
        out[i : i + step] = np.sqrt(np.square(gap, out=gap).sum(axis=-1))
    return out


def apart(x: np.ndarray, y: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Distances of rows i of x to rows j of y, the same to the last bit as by distances()."""
    out = np.empty(len(i))
    step = max(1, (1 << 18) // max(1, x.shape[1]))
    for k in range(0, len(i), step):
        gap = x[i[k : k + step]] - y[j[k : k + step]]
        out[k : k + step] = np.sqrt(np.square(gap, out=gap).sum(axis=-1))
    return out


def room(held: dict[str, np.ndarray], name: str, shape: tuple[int, int], kind: type) -> np.ndarray:
    """An array of `shape` in the memory that `held` has by this name: new pages cost more time than a product of blocks."""
    size = shape[0] * shape[1]
    if name not in held or held[name].size < size:
        held[name] = np.empty(size, kind)
    return held[name][:size].reshape(shape)


def within(x: np.ndarray, y: np.ndarray, upto_x: np.ndarray, upto_y: np.ndarray, held: dict[str, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """(i, j) of all pairs of rows at most max(upto_x[i], upto_y[j]) apart, and of a few others; a bound below 0 asks for nothing.

    Minus half the squared distances are one product in single precision around x's middle. `slack` is more than it can be
    wrong by: a rounding for each term, that of the shift in double precision, and what is too small for a float. `held`
    keeps memory from call to call.
    """
    width = x.shape[1]
    middle = x.mean(axis=0)
    a, b = (np.subtract(v, middle, out=room(held, n, v.shape, np.float64)) for n, v in (("a", x), ("b", y)))
    half_a, half_b = np.einsum("ij,ij->i", a, a) / 2, np.einsum("ij,ij->i", b, b) / 2
    most = half_a.max() + half_b.max()
    moved = (np.abs(middle).max(initial=0) + 2 * np.sqrt(most)) * (width + 1) * 2.0**-50
    slack = (width + 16) * 2.0**-22 * most + 4 * moved * np.sqrt(most) + moved**2 + 1e-35
    if not slack < 1e30:
        return tuple(k.ravel() for k in np.indices((len(x), len(y))))
    left, right = (room(held, n, (len(v), width + 2), np.float32) for n, v in (("left", x), ("right", y)))
    left[:, :width], left[:, width], left[:, width + 1] = a, half_a, 1
    right[:, :width], right[:, width], right[:, width + 1] = b, -1, -half_b
    with np.errstate(over="ignore"):
        low_x, low_y = (np.where(t < 0, np.inf, -np.square(t) / 2 - slack).astype(np.float32) for t in (upto_x, upto_y))
    halves, lows, near = (room(held, n, (STEP, len(y)), t) for n, t in (("halves", np.float32), ("lows", np.float32), ("near", bool)))
    out = []
    for k in range(0, len(x), STEP):  # what fits a core's cache
        n = min(STEP, len(x) - k)
        np.matmul(left[k : k + n], right.T, out=halves[:n])
        np.minimum(low_x[k : k + n, None], low_y, out=lows[:n])
        np.greater_equal(halves[:n], lows[:n], out=near[:n])
        if n % 8:
            out.append(np.flatnonzero(near[:n]) + k * len(y))
        else:
            eights = np.flatnonzero(near[:n].reshape(-1).view(np.uint64))
            at, bit = near[:n].reshape(-1, 8)[eights].nonzero()
            out.append(eights[at] * 8 + bit + k * len(y))
    return np.divmod(np.concatenate(out), len(y))


def tree_edges(reach: np.ndarray, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(a, b, weight), a < b, of the minimum spanning tree under the order (weight, a, b), by Prim's method."""
    n = len(ids)
    out = np.empty((3, n - 1))
    near, lo, hi = reach[0].copy(), np.minimum(ids[0], ids), np.maximum(ids[0], ids)
    left = np.arange(1, n)
    for step in range(n - 1):
        least = near[left].min()
        tied = left[near[left] == least]
        at = tied[np.lexsort((hi[tied], lo[tied]))[0]] if len(tied) > 1 else tied[0]
        out[:, step] = lo[at], hi[at], near[at]
        left = left[left != at]
        w, a, b = reach[at][left], np.minimum(ids[at], ids[left]), np.maximum(ids[at], ids[left])
        better = (w < near[left]) | ((w == near[left]) & ((a < lo[left]) | ((a == lo[left]) & (b < hi[left]))))
        near[left[better]], lo[left[better]], hi[left[better]] = w[better], a[better], b[better]
    return out[0].astype(np.int64), out[1].astype(np.int64), out[2]


def cross_edges(reach: np.ndarray, p: np.ndarray, q: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(a, b, weight), a < b, of the minimum spanning tree of the edges between rows p and columns q, in the order of tree_edges()."""
    n, m = reach.shape
    rows, columns = slice(0, n), slice(n, n + m)
    back = np.ascontiguousarray(reach.T)
    near, lo, hi = np.full(n + m, np.inf), np.zeros(n + m, np.int64), np.zeros(n + m, np.int64)
    out_a, out_b, out_w = np.empty(n + m - 1, np.int64), np.empty(n + m - 1, np.int64), np.empty(n + m - 1)
    free, at = np.ones(n + m, bool), 0
    for step in range(n + m - 1):
        free[at], near[at] = False, np.inf
        side, w, own, ids = (columns, reach[at], p[at], q) if at < n else (rows, back[at - n], q[at - n], p)
        a, b, held = np.minimum(own, ids), np.maximum(own, ids), near[side]
        better = w < held
        same = w == held
        if same.any():
            better |= same & ((a < lo[side]) | ((a == lo[side]) & (b < hi[side])))
        better &= free[side]
        held[better], lo[side][better], hi[side][better] = w[better], a[better], b[better]
        at = int(near.argmin())
        tied = np.flatnonzero(near == near[at])
        if len(tied) > 1:
            at = int(tied[np.lexsort((hi[tied], lo[tied]))[0]])
        out_a[step], out_b[step], out_w[step] = lo[at], hi[at], near[at]
    return out_a, out_b, out_w


# -- blocks


def packed(vectors: DataFrame, column: str, rows: int = BLOCK) -> DataFrame:
    """(block, ids, x, centre, radius): blocks of about `rows` vectors near one pivot, numbered from 0, written.

    Pivots are the vectors of the smallest hashes, PIVOTS at most. A cell of many vectors, equal ones too, is several blocks.
    """
    spark = vectors.sparkSession
    n = vectors.count()
    heads = vectors.orderBy(F.xxhash64("vec_id"), "vec_id").limit(max(1, min(PIVOTS, n // rows))).select(column).toArrow()[0].to_pylist()  # PIVOTS vectors at most
    pivots = spark.sparkContext.broadcast(np.array(heads, np.float64))

    def celled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = np.array(batch.column(1).to_pylist(), np.float64).reshape(batch.num_rows, -1)
            if len(x):
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([v.tobytes() for v in x], pa.binary()), pa.array(distances(x, pivots.value).argmin(axis=1).astype(np.int32))], names=["vec_id", "x", "cell"])

    cells = written(vectors.select("vec_id", column).mapInArrow(celled, "vec_id long, x binary, cell int"), "cells")
    sizes = {r.cell: -(-r["count"] // rows) for r in cells.groupBy("cell").count().collect()}  # a row a pivot
    starts = dict(zip(sizes, np.cumsum([0, *sizes.values()]).tolist()))
    split = F.create_map(*(F.lit(v) for c, k in sizes.items() for v in (c, k))) if sizes else F.lit(None)
    start = F.create_map(*(F.lit(v) for c, k in starts.items() for v in (c, k))) if sizes else F.lit(None)
    block = (start[F.col("cell")] + F.pmod(F.xxhash64("vec_id"), split[F.col("cell")])).cast("int") if sizes else F.lit(0)

    def pack(table: pa.Table) -> pa.Table:
        table = table.sort_by("vec_id")
        x = np.frombuffer(b"".join(table["x"].to_pylist())).reshape(table.num_rows, -1)
        centre = x.mean(axis=0)
        radius = float(np.sqrt(((x - centre) ** 2).sum(axis=1)).max())
        return pa.table({"block": [table["block"][0].as_py()], "ids": [table["vec_id"].to_numpy().astype(np.int64).tobytes()], "x": [x.tobytes()], "centre": [centre.tolist()], "radius": [radius]}, schema=pa.schema([("block", pa.int32()), ("ids", pa.binary()), ("x", pa.binary()), ("centre", pa.list_(pa.float64())), ("radius", pa.float64())]))

    out = written(cells.withColumn("block", block).groupBy("block").applyInArrow(pack, "block int, ids binary, x binary, centre array<double>, radius double"), "blocks")
    drop_written(spark, cells)
    return out


def group_side(n_blocks: int) -> int:
    """Blocks of a group: SIDE, fewer where there would be fewer than GROUPS groups."""
    return max(1, min(SIDE, -(-n_blocks // GROUPS)))


def dealt(blocks: DataFrame, n_blocks: int, work: Callable[[list[dict], list[dict] | None], pa.Table], schema: str) -> DataFrame:
    """work(rows of one group of blocks, rows of another one or None) for every two groups, and for each group alone; a task each.

    A group has group_side() blocks. The number of tasks is given, since small rows that make long work would be put
    together by their bytes.
    """
    side = group_side(n_blocks)
    groups = -(-n_blocks // side)
    own, other = F.floor(F.col("block") / side).cast("int"), F.col("_other")
    rows = blocks.withColumn("_other", F.explode(F.sequence(F.lit(0), F.lit(groups - 1)))).withColumn("_p", F.least(own, other)).withColumn("_q", F.greatest(own, other)).drop("_other")

    def run(key: tuple, table: pa.Table) -> pa.Table:
        p, q = (k.as_py() for k in key)
        packed = table.drop_columns(["_p", "_q"]).sort_by("block").to_pylist()  # 2 * SIDE blocks at most
        left, right = ([r for r in packed if r["block"] // side == g] for g in (p, q))
        return work(left, None if p == q else right)

    return rows.repartition(groups * (groups + 1), "_p", "_q").groupBy("_p", "_q").applyInArrow(run, schema)


def two_by_two(left: list[dict], right: list[dict] | None) -> Iterator[tuple[dict, dict]]:
    """Every two different blocks of a group, or of two groups."""
    return combinations(left, 2) if right is None else product(left, right)


def block_pairs(summaries: DataFrame, blocks: int) -> DataFrame:
    """(a, b) with a < b, each with the summaries' columns as a_ and b_: the grid is counted out, not joined."""
    names = [c for c in summaries.columns if c != "block"]
    left = summaries.select(F.col("block").alias("a"), *(F.col(c).alias(f"a_{c}") for c in names)).where(F.col("a") < blocks - 1)
    right = summaries.select(F.col("block").alias("b"), *(F.col(c).alias(f"b_{c}") for c in names))
    return left.withColumn("b", F.explode(F.sequence(F.col("a") + 1, F.lit(blocks - 1)))).join(right, "b")


def both(pairs: DataFrame, blocks: DataFrame) -> DataFrame:
    """The packed rows of both sides of (a, b), dealt by the pair."""
    carried = [c for c in blocks.columns if c in ("ids", "x", "cores")]
    left = blocks.select(F.col("block").alias("a"), *(F.col(c).alias(f"a_{c}") for c in carried))
    right = blocks.select(F.col("block").alias("b"), *(F.col(c).alias(f"b_{c}") for c in carried))
    return pairs.select("a", "b").join(left, "a").join(right, "b")


def unpack(ids: bytes, x: bytes) -> tuple[np.ndarray, np.ndarray]:
    i = np.frombuffer(ids, np.int64)
    return i, np.frombuffer(x).reshape(len(i), -1)


# -- core distances and the spanning tree


def rows_of(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
    """Rows with packed blocks, one at a time."""
    for batch in batches:
        for i in range(batch.num_rows):
            yield batch.slice(i, 1).to_pylist()[0]


def gain(near: np.ndarray, whose: np.ndarray, at: np.ndarray, d: np.ndarray, names: np.ndarray) -> None:
    """Take distances d of `names` to rows `at` into the rows' least distances and whose they are, both in order; in place."""
    better = d < near[at, -1]
    at, d, names = at[better], d[better], names[better]
    if not len(at):
        return
    order = np.lexsort((d, at))
    at, d, names = at[order], d[order], names[order]
    first = np.flatnonzero(np.concatenate(([True], at[1:] != at[:-1])))
    sizes = np.diff(np.append(first, len(at)))
    row, place = np.repeat(np.arange(len(first)), sizes), np.arange(len(at)) - np.repeat(first, sizes)
    few = place < near.shape[1]
    more, theirs = np.full((len(first), near.shape[1]), np.inf), np.full((len(first), near.shape[1]), -1)
    more[row[few], place[few]], theirs[row[few], place[few]] = d[few], names[few]
    rows = at[first]
    every, them = np.concatenate((near[rows], more), axis=1), np.concatenate((whose[rows], theirs), axis=1)
    least = np.argsort(every, axis=1, kind="stable")[:, : near.shape[1]]
    near[rows], whose[rows] = np.take_along_axis(every, least, 1), np.take_along_axis(them, least, 1)


def cored(blocks: DataFrame, n_blocks: int, least: int) -> DataFrame:
    """blocks with what is known of each vector in order of the ids; written.

    `cores` is the distance of its least-th nearest vector (the own one being the first), `near` and `whose` are its least - 1
    nearest others, infinite where there are fewer, one after the other. `ends` and `gaps` are an edge to each block dealt with it.
    """
    k = max(1, least - 1)
    schema = "block int, near array<double>, whose array<long>, ends array<long>, gaps array<double>"
    kinds = pa.schema([("block", pa.int32()), ("near", pa.list_(pa.float64())), ("whose", pa.list_(pa.int64())), ("ends", pa.list_(pa.int64())), ("gaps", pa.list_(pa.float64()))])

    def own(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for r in rows_of(batches):
            ids, x = unpack(r["ids"], r["x"])
            near, whose = np.full((len(ids), k), np.inf), np.zeros((len(ids), k), np.int64)
            some = distances(x, x[:STEP])  # the least of these bound the least of all
            np.fill_diagonal(some, np.inf)
            upto = np.partition(some, k - 1, axis=1)[:, k - 1] if some.shape[1] > k else np.full(len(ids), np.inf)
            i, j = within(x, x, upto, np.full(len(ids), -1.0), {})
            i, j = i[i != j], j[i != j]
            gain(near, whose, i, apart(x, x, i, j), ids[j])
            yield pa.RecordBatch.from_pylist([{"block": r["block"], "near": near.ravel(), "whose": whose.ravel(), "ends": [], "gaps": []}], schema=kinds)

    def others(left: list[dict], right: list[dict] | None) -> pa.Table:
        rows = [*left, *(right or [])]
        sets, starts, near, whose, held, edges = {}, {}, {}, {}, {}, {r["block"]: ([], []) for r in rows}
        for r in rows:
            sets[r["block"]], starts[r["block"]] = unpack(r["ids"], r["x"]), sum(len(s[0]) for s in sets.values())
            near[r["block"]] = np.array(r["near"]).reshape(-1, k)
            whose[r["block"]] = np.full(near[r["block"]].shape, -1)  # what is in the own block comes with the own row, and counts once
        for one, two in two_by_two(left, right):
            i, j = one["block"], two["block"]
            (p, x), (q, y) = sets[i], sets[j]
            # what a block can still gain is bounded by its own worst distance, infinite where it is too small for one
            far = np.sqrt(((np.array(one["centre"]) - np.array(two["centre"])) ** 2).sum()) - one["radius"] - two["radius"]
            u = np.zeros(0, np.int64)
            if not far * (1 - 1e-9) - 1e-9 > max(near[i][:, -1].max(), near[j][:, -1].max()):
                u, v = within(x, y, *(np.where(near[b][:, -1] > 0, near[b][:, -1], -1) for b in (i, j)), held)
            if not len(u):  # an edge all the same
                u, v = (np.array([((z - np.array(c["centre"])) ** 2).sum(axis=1).argmin()]) for z, c in ((x, two), (y, one)))
            d = apart(x, y, u, v)
            at = d.argmin()
            edges[i][0].extend((int(p[u[at]]), int(q[v[at]])))
            edges[i][1].append(float(d[at]))
            gain(near[i], whose[i], u, d, starts[j] + v)
            gain(near[j], whose[j], v, d, starts[i] + u)
        names = np.concatenate([s[0] for s in sets.values()])
        return pa.Table.from_pylist([{"block": b, "near": np.where(whose[b] < 0, np.inf, near[b]).ravel(), "whose": names[whose[b]].ravel(), "ends": edges[b][0], "gaps": edges[b][1]} for b in sets], schema=kinds)

    def least_of_all(table: pa.Table) -> pa.Table:
        every, them = (np.concatenate([np.array(v).reshape(-1, k) for v in table[c].to_pylist()], axis=1) for c in ("near", "whose"))
        at = np.argsort(every, axis=1, kind="stable")[:, :k]
        near, whose = np.take_along_axis(every, at, 1), np.take_along_axis(them, at, 1)
        cores = near[:, least - 2] if least > 1 else np.zeros(len(near))
        out = {"block": table["block"][:1], "cores": [cores], "near": [near.ravel()], "whose": [whose.ravel()]}
        out |= {c: [np.concatenate([np.array(v, t) for v in table[c].to_pylist()])] for c, t in (("ends", np.int64), ("gaps", np.float64))}
        return pa.table(out, schema=pa.schema([kinds.field("block"), ("cores", pa.list_(pa.float64())), *(kinds.field(c) for c in ("near", "whose", "ends", "gaps"))]))

    found = written(blocks.mapInArrow(own, schema), "near")
    if n_blocks > 1:
        found = found.unionByName(dealt(blocks.join(found.select("block", "near"), "block"), n_blocks, others, schema))
    known = found.groupBy("block").applyInArrow(least_of_all, schema.replace("near", "cores array<double>, near", 1))  # a row a group of blocks
    return written(blocks.join(known, "block"), "cored")


def first_tree(filled: DataFrame, most: int = MOST) -> DataFrame:
    """(a, b, w) of a spanning tree of cored() blocks by mutual reachability, a < b, near the least one; written."""

    def edges(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for r in rows_of(batches):
            ids, near, whose = np.frombuffer(r["ids"], np.int64), np.array(r["near"]), np.array(r["whose"], np.int64)
            ends = np.array(r["ends"], np.int64).reshape(-1, 2)
            a, b, d = np.repeat(ids, len(near) // len(ids)), whose, near
            a, b, d = (np.concatenate(c) for c in ((a[np.isfinite(d)], ends[:, 0]), (b[np.isfinite(d)], ends[:, 1]), (d[np.isfinite(d)], np.array(r["gaps"], np.float64))))
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in (np.minimum(a, b), np.maximum(a, b), d)], names=["a", "b", "d"])

    def trees(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for r in rows_of(batches):
            (ids, x), core = unpack(r["ids"], r["x"]), np.array(r["cores"])
            if len(ids) > 1:
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in tree_edges(np.maximum(np.maximum(core[:, None], core[None]), distances(x, x)), ids)], names=["a", "b", "w"])

    def cores(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for r in rows_of(batches):
            yield pa.RecordBatch.from_arrays([pa.array(np.frombuffer(r["ids"], np.int64)), pa.array(np.array(r["cores"]))], names=["id", "core"])

    core = filled.select("ids", "cores").mapInArrow(cores, "id long, core double")
    pairs = filled.select("ids", "near", "whose", "ends", "gaps").mapInArrow(edges, "a long, b long, d double").distinct()
    for end in ("a", "b"):
        pairs = pairs.join(core.select(F.col("id").alias(end), F.col("core").alias(f"_{end}")), end)
    inside = filled.select("ids", "x", "cores").mapInArrow(trees, "a long, b long, w double")
    return least_forest(written(pairs.select("a", "b", F.greatest("d", "_a", "_b").alias("w")).unionByName(inside).distinct(), "near-edges"), most)


def in_leaf_order(tree: DataFrame) -> DataFrame:
    """(id, pos, rank, w, a, b) of every vector of a merge_tree(): its place in an order, and the tree edge that is its gap to the one before it.

    The heaviest edge between two vectors in the tree is the gap of the highest rank behind one of them up to the other. A
    merge puts the side with the larger smallest id behind the other side, so a vector's place is a sum up a chain of merges.
    """
    first = F.col("low_left") < F.col("low_right")
    links = tree.select(F.greatest("low_left", "low_right").alias("id"), F.least("low_left", "low_right").alias("up"), F.when(first, F.col("n_left")).otherwise(F.col("n_right")).alias("pos"), F.col("node").alias("rank"), "w", "a", "b")
    root = tree.agg(F.min("a").alias("id")).select("id", F.col("id").alias("up"), F.lit(0).cast("long").alias("pos"), F.lit(-1).cast("long").alias("rank"), F.lit(float("-inf")).alias("w"), F.col("id").alias("a"), F.col("id").alias("b"))
    return doubled(links.unionByName(root), "id", "up", "pos").drop("up")


def repacked(filled: DataFrame, order: DataFrame, rows: int) -> DataFrame:
    """cored() blocks as blocks of `rows` vectors by in_leaf_order(), with their gaps, the highest of them as `top`, and `over`: the highest one between the own group of blocks and each later one; written."""
    gap = "struct<rank: bigint, w: double, a: bigint, b: bigint>"

    def points(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for r in rows_of(batches):
            ids, x = unpack(r["ids"], r["x"])
            yield pa.RecordBatch.from_arrays([pa.array(ids), pa.array([v.tobytes() for v in x], pa.binary()), pa.array(np.array(r["cores"]))], names=["id", "x", "core"])

    def pack(table: pa.Table) -> pa.Table:
        table = table.sort_by("pos")
        x = np.frombuffer(b"".join(table["x"].to_pylist())).reshape(table.num_rows, -1)
        centre = x.mean(axis=0)
        held = {c: table[n].to_numpy() for c, n in (("ids", "id"), ("cores", "core"), ("rank", "rank"), ("w", "w"), ("a", "a"), ("b", "b"))}
        top = int(held["rank"].argmax())
        out = {"block": [table["block"][0].as_py()], "x": [x.tobytes()], "centre": [centre.tolist()], "radius": [float(np.sqrt(((x - centre) ** 2).sum(axis=1)).max())]}
        out |= {c: [v.tobytes()] for c, v in held.items()} | {"top": [{c: held[c][top].item() for c in ("rank", "w", "a", "b")}]}
        kinds = [("block", pa.int32()), ("x", pa.binary()), ("centre", pa.list_(pa.float64())), ("radius", pa.float64()), *((c, pa.binary()) for c in held)]
        return pa.table(out, schema=pa.schema([*kinds, ("top", pa.struct([("rank", pa.int64()), ("w", pa.float64()), ("a", pa.int64()), ("b", pa.int64())]))]))

    dealt_by = filled.select("ids", "x", "cores").mapInArrow(points, "id long, x binary, core double").join(order, "id").withColumn("block", F.floor(F.col("pos") / rows).cast("int"))
    schema = f"block int, x binary, centre array<double>, radius double, ids binary, cores binary, rank binary, w binary, a binary, b binary, top {gap}"
    return written(dealt_by.groupBy("block").applyInArrow(pack, schema), "leaf-blocks")


def light_edges(blocks: DataFrame, n_blocks: int) -> DataFrame:
    """(a, b, w) of the pairs of repacked() blocks that are lighter than all edges between them in their tree, a < b: a forest of them by task."""
    side = group_side(n_blocks)
    groups = -(-n_blocks // side)
    group = F.floor(F.col("block") / side).cast("int")
    tops = blocks.groupBy(group.alias("block")).agg(F.max("top").alias("top"))  # rank comes first
    past = Window.partitionBy("a").orderBy("b").rowsBetween(Window.unboundedPreceding, -1)
    over = block_pairs(tops, groups).withColumn("over", F.max("b_top").over(past)).groupBy(F.col("a").alias("_group")).agg(F.map_from_entries(F.collect_list(F.struct("b", "over"))).alias("over"))  # a gap a group
    rows = blocks.withColumn("_group", group).join(over, "_group", "left").drop("_group")

    def light(left: list[dict], right: list[dict] | None) -> pa.Table:
        rows = [*left, *(right or [])]
        between = dict(left[0]["over"] or []).get(right[0]["block"] // side) if right else None
        sets = {r["block"]: (*unpack(r["ids"], r["x"]), np.frombuffer(r["cores"]), np.frombuffer(r["rank"], np.int64)) for r in rows}
        ranks, gap_w, gap_a, gap_b = (np.concatenate([np.frombuffer(r[c], t) for r in rows] + [np.array([between[c]] if between else [], t)]) for c, t in (("rank", np.int64), ("w", np.float64), ("a", np.int64), ("b", np.int64)))
        order = np.argsort(ranks)
        ranks, gap_w, gap_a, gap_b = ranks[order], gap_w[order], gap_a[order], gap_b[order]
        weight = lambda r: np.where(r < 0, -1.0, gap_w[np.searchsorted(ranks, r)])
        kept, size, held = [], 0, {}

        def forest() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
            a, b, w = (np.concatenate(c) for c in zip(*kept))
            at = kruskal(a, b, np.lexsort((b, a, w)))
            return a[at], b[at], w[at]

        def take(p: np.ndarray, q: np.ndarray, core: np.ndarray, rank: np.ndarray, measured: Callable[[np.ndarray], np.ndarray]) -> None:
            """Keep the edges between p and q that come before the gap of `rank`; only those whose cores do are measured."""
            nonlocal kept, size
            g, a, b = np.searchsorted(ranks, rank), np.minimum(p, q), np.maximum(p, q)

            def before(k: np.ndarray | slice, w: np.ndarray) -> np.ndarray:
                return (w < gap_w[g[k]]) | ((w == gap_w[g[k]]) & ((a[k] < gap_a[g[k]]) | ((a[k] == gap_a[g[k]]) & (b[k] < gap_b[g[k]]))))

            k = np.flatnonzero(before(slice(None), core))
            w = np.maximum(core[k], measured(k))
            light = before(k, w)
            kept.append((a[k[light]], b[k[light]], w[light]))
            size += int(light.sum())
            if size > EDGES:
                kept = [forest()]
                size = len(kept[0][0])

        if right is None:
            for ids, x, core, rank in sets.values():
                highest = np.where(np.tri(len(ids), dtype=bool), -1, rank)  # of the gaps behind i up to j
                highest = np.maximum.accumulate(highest, axis=1)
                i, j = within(x, x, weight(highest[:, -1]), np.full(len(ids), -1.0), held)
                i, j = i[i < j], j[i < j]
                take(ids[i], ids[j], np.maximum(core[i], core[j]), highest[i, j], lambda k, x=x, i=i, j=j: apart(x, x, i[k], j[k]))
        for one, two in two_by_two(left, right):
            (p, x, c, up), (q, y, e, down) = sets[one["block"]], sets[two["block"]]
            middle = max([between["rank"]] if between else [], default=-1)
            middle = max([middle, *(r["top"]["rank"] for r in rows if one["block"] < r["block"] < two["block"])])
            behind = np.maximum(np.append(np.maximum.accumulate(up[:0:-1])[::-1], -1), middle)
            upto = np.maximum.accumulate(down)
            far = np.sqrt(((np.array(one["centre"]) - np.array(two["centre"])) ** 2).sum()) - one["radius"] - two["radius"]
            bounds = weight(behind), weight(upto)
            if far * (1 - 1e-9) - 1e-9 > max(bounds[0].max(), bounds[1].max()):
                continue
            i, j = within(x, y, *bounds, held)
            if len(i):
                take(p[i], q[j], np.maximum(c[i], e[j]), np.maximum(behind[i], upto[j]), lambda k, x=x, y=y, i=i, j=j: apart(x, y, i[k], j[k]))
        a, b, w = forest() if kept else (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))
        return pa.table({"a": a, "b": b, "w": w})

    return dealt(rows, n_blocks, light, "a long, b long, w double")


def spanning_tree(filled: DataFrame, rows: int = BLOCK, most: int = MOST) -> DataFrame:
    """(a, b, w) of the minimum spanning tree of cored() blocks by mutual reachability, a < b; written."""
    spanned = first_tree(filled, most)
    blocks = repacked(filled, in_leaf_order(merge_tree(spanned, most)), rows)
    n_blocks = blocks.agg(F.max("block")).first()[0] + 1
    return least_forest(written(spanned.unionByName(light_edges(blocks, n_blocks)), "light-edges"), most)


def kruskal(a: np.ndarray, b: np.ndarray, order: np.ndarray) -> list[int]:
    """Positions of the forest's edges among edges (a, b) taken in `order`."""
    names, place = np.unique(np.concatenate((a, b)), return_inverse=True)
    up, left, right, out = list(range(len(names))), place[: len(a)].tolist(), place[len(a) :].tolist(), []
    for i in order.tolist():
        x, y = left[i], right[i]
        while up[x] != x:
            up[x] = x = up[up[x]]
        while up[y] != y:
            up[y] = y = up[up[y]]
        if x != y:
            up[x] = y
            out.append(i)
    return out


def least_forest(edges: DataFrame, most: int = MOST) -> DataFrame:
    """The minimum spanning forest of edges (a, b, w), under the order (w, a, b); written.

    While there are more than `most` edges, each component takes its least edge outward and components contract; then
    one task goes through what is left between components.
    """
    spark = edges.sparkSession
    now = edges.select("a", "b", "w", F.col("a").alias("p"), F.col("b").alias("q"))
    taken = None
    while now.count() > most:
        key = F.struct("w", "a", "b", "p", "q")
        least = now.select(F.explode(F.array("p", "q")).alias("c"), key.alias("e")).groupBy("c").agg(F.min("e").alias("e")).select("e.*").distinct()
        least = written(least, "least")
        taken = least.select("a", "b", "w") if taken is None else taken.unionByName(least.select("a", "b", "w"))
        roots = written(connected_components(least.select(F.col("p").alias("a"), F.col("q").alias("b"))), "roots")
        moved = now.join(roots.select(F.col("node").alias("p"), F.col("root").alias("_p")), "p").join(roots.select(F.col("node").alias("q"), F.col("root").alias("_q")), "q").where("_p <> _q")
        sides = moved.select("a", "b", "w", F.least("_p", "_q").alias("p"), F.greatest("_p", "_q").alias("q"))
        now = written(sides.groupBy("p", "q").agg(F.min(F.struct("w", "a", "b")).alias("e")).select("e.a", "e.b", "e.w", "p", "q"), "between")
        drop_written(spark, roots)

    def finish(table: pa.Table) -> pa.Table:
        a, b, w, p, q = (table[c].to_numpy() for c in ("a", "b", "w", "p", "q"))
        kept = kruskal(p, q, np.lexsort((b, a, w)))
        return pa.table({"a": a[kept], "b": b[kept], "w": w[kept]})

    last = now.groupBy(F.lit(0).alias("_all")).applyInArrow(finish, "a long, b long, w double")  # `most` edges at most
    return written(last if taken is None else taken.distinct().unionByName(last), "forest")


# -- the merge tree


def merge_tree(edges: DataFrame, most: int = MOST) -> DataFrame:
    """(node, w, a, b, left, right, n_left, n_right, low_left, low_right) of a spanning tree (a, b, w): its merges by rising (w, a, b), numbered from 0; written.

    A side is a vector's place in order of the ids (0 or more), or a merge m as -m - 1, with its number of vectors and
    their smallest id.
    """
    spark = edges.sparkSession
    places = scanned(edges.select(F.explode(F.array("a", "b")).alias("id")).distinct(), [], [F.col("id")]).select("id", F.col("pos").alias("p"))
    numbered = scanned(edges, [], [F.col("w"), F.col("a"), F.col("b")]).select(F.col("pos").alias("node"), "w", "a", "b", (F.col("size") - 1).alias("part"))
    numbered = numbered.join(places.select(F.col("id").alias("a"), F.col("p").alias("u")), "a").join(places.select(F.col("id").alias("b"), F.col("p").alias("v")), "b")
    now = written(numbered.select("part", "node", "w", "a", "b", "u", "v", F.lit(1).cast("long").alias("nu"), F.lit(1).cast("long").alias("nv"), F.col("a").alias("lu"), F.col("b").alias("lv")), "tree-edges")

    def merges(table: pa.Table) -> pa.Table:
        order = np.argsort(table["node"].to_numpy())
        node, w, a, b, u, v, nu, nv, lu, lv = (table[c].to_numpy()[order] for c in ("node", "w", "a", "b", "u", "v", "nu", "nv", "lu", "lv"))
        names, first, place = np.unique(np.concatenate((u, v)), return_index=True, return_inverse=True)
        held, low = np.concatenate((nu, nv))[first].tolist(), np.concatenate((lu, lv))[first].tolist()
        up, top = list(range(len(names))), names.tolist()
        left, right, sides = place[: len(u)].tolist(), place[len(u) :].tolist(), []
        for m, x, y in zip(node.tolist(), left, right):
            while up[x] != x:
                up[x] = x = up[up[x]]
            while up[y] != y:
                up[y] = y = up[up[y]]
            sides.append((top[x], top[y], held[x], held[y], low[x], low[y]))
            up[x] = y
            top[y], held[y], low[y] = -m - 1, held[x] + held[y], min(low[x], low[y])
        columns = [np.array(c, np.int64) for c in zip(*sides)]
        return pa.table(dict(zip(("node", "w", "a", "b", "left", "right", "n_left", "n_right", "low_left", "low_right"), (node, w, a, b, *columns))))

    done = []
    while True:
        sizes = now.groupBy("part").agg(F.count("*").alias("_k"))
        sized = now.join(sizes, "part")
        small, large = sized.where(F.col("_k") <= most), sized.where(F.col("_k") > most)
        done.append(written(small.drop("_k").groupBy("part").applyInArrow(merges, "node long, w double, a long, b long, left long, right long, n_left long, n_right long, low_left long, low_right long"), "merges"))  # `most` edges a group
        if large.isEmpty():
            break
        # the lighter half of each part falls into trees named by their last merge; the heavier half joins what they contract to
        cut = written(scanned(large, ["part"], [F.col("node")]).withColumn("low", F.col("pos") < F.floor(F.col("size") / 2)).drop("pos", "size", "_k"), "halves")
        low = cut.where("low")
        roots = written(connected_components(low.select(F.col("u").alias("a"), F.col("v").alias("b"))), "roots")
        of = low.join(roots.select(F.col("node").alias("u"), "root"), "u")
        tops = of.groupBy("root").agg(F.max("node").alias("top"))
        ends = of.select("root", F.explode(F.array(F.struct(F.col("u").alias("x"), F.col("nu").alias("n"), F.col("lu").alias("low")), F.struct(F.col("v").alias("x"), F.col("nv").alias("n"), F.col("lv").alias("low")))).alias("s")).select("root", "s.*").distinct()
        weight = ends.groupBy("root").agg(F.sum("n").alias("n"), F.min("low").alias("low"))
        fate = written(ends.select("root", "x").join(tops, "root").join(weight, "root").select("x", (-F.col("top") - 1).alias("to"), "n", "low"), "fates")
        high = cut.where("not low")
        for end, size, least in (("u", "nu", "lu"), ("v", "nv", "lv")):
            at = fate.select(F.col("x").alias(end), F.col("to").alias("_to"), F.col("n").alias("_n"), F.col("low").alias("_low"))
            high = high.join(at, end, "left").withColumn(end, F.coalesce("_to", end)).withColumn(size, F.coalesce("_n", size)).withColumn(least, F.coalesce("_low", least)).drop("_to", "_n", "_low")
        columns = ["part", "node", "w", "a", "b", "u", "v", "nu", "nv", "lu", "lv"]
        lower = of.join(tops, "root").withColumn("part", F.col("top")).select(columns)
        now = written(lower.unionByName(high.select(columns)), "tree-edges")
        for old in (cut, roots, fate):
            drop_written(spark, old)
    out = done[0]
    for more in done[1:]:
        out = out.unionByName(more)
    return out


def doubled(links: DataFrame, node: str, up: str, total: str | None = None) -> DataFrame:
    """links (node, up) with `up` replaced by the end of each chain, and `total` by its sum on the way, by pointer doubling; written. A link to itself ends a chain (its total is 0)."""
    spark = links.sparkSession
    now = written(links, "chains")
    while True:
        far = now.select(F.col(node).alias("_at"), F.col(up).alias("_far"), *([F.col(total).alias("_more")] if total else []))
        joined = now.join(far, F.col(up) == F.col("_at"), "left").withColumn("_new", F.coalesce("_far", up))
        if total:
            joined = joined.withColumn(total, F.col(total) + F.coalesce("_more", F.lit(0)))
        after = written(joined.withColumn("_moved", F.col("_new") != F.col(up)).withColumn(up, F.col("_new")).select(*links.columns, "_moved"), "chains")
        moved = not after.where("_moved").isEmpty()
        drop_written(spark, now)
        now = after.drop("_moved")
        if not moved:
            return now


def excess_of_mass(tree: DataFrame, least: int, most: int = MOST) -> DataFrame:
    """(node, cluster) of every merge of `least` vectors or more: the chosen cluster that it belongs to, -1 for none; written.

    A cluster begins at a merge both of whose sides are that large and shrinks along its one large side. Its mass is the
    sum over its vectors of 1 / w where they leave it, less where it began. Clusters are decided from the leaves of
    their own tree up, level by level while there are more than `most`, then in one task.
    """
    n = F.col("n_left") + F.col("n_right")
    large = tree.where(n >= least).select("node", "left", "right", "n_left", "n_right", n.alias("n"), (1 / F.greatest(F.col("w"), F.lit(1e-12))).alias("level"))
    sides = F.array(F.struct(F.col("left").alias("side"), F.col("n_left").alias("m")), F.struct(F.col("right").alias("side"), F.col("n_right").alias("m")))
    is_split = (F.col("n_left") >= least) & (F.col("n_right") >= least)
    below = large.select(F.col("node").alias("parent"), is_split.alias("split"), "level", F.explode(sides).alias("s")).where(F.col("s.m") >= least).select((-F.col("s.side") - 1).alias("node"), "parent", "split", F.col("level").alias("birth"))
    joined = large.join(below, "node", "left")
    chains = doubled(joined.select("node", F.when(F.col("split"), F.col("node")).otherwise(F.coalesce("parent", "node")).alias("top")), "node", "top")
    figures = written(joined.join(chains, "node"), "condensed")
    lost = F.when(is_split, F.col("n")).when((F.col("n_left") >= least) | (F.col("n_right") >= least), F.least("n_left", "n_right")).otherwise(F.col("n"))
    first = F.col("node") == F.col("top")
    masses = figures.groupBy("top").agg(F.sum(F.col("level") * lost).alias("_sum"), F.max(F.when(first, F.coalesce("birth", F.lit(0.0)))).alias("_birth"), F.max(F.when(first, F.col("n"))).alias("_n"), F.max(F.when(first, F.col("parent"))).alias("_parent"))
    above = figures.select(F.col("node").alias("_parent"), F.col("top").alias("parent"))
    table = masses.join(above, "_parent", "left").select(F.col("top").alias("cluster"), "parent", (F.col("_sum") - F.col("_birth") * F.col("_n")).alias("mass"))
    chosen = selected(written(table, "masses"), most)
    out = written(figures.select("node", "top").join(chosen.withColumnRenamed("cluster", "top"), "top").select("node", F.col("chosen").alias("cluster")), "chosen")
    drop_written(tree.sparkSession, figures)
    return out


def selected(table: DataFrame, most: int = MOST) -> DataFrame:
    """(cluster, chosen) from (cluster, parent, mass): the topmost cluster on its way up whose mass isn't below its parts', never the root; -1 for none."""

    def decide(part: pa.Table) -> pa.Table:
        ids, parents, mass, inner, known = (part[c].to_pylist() for c in ("cluster", "parent", "mass", "inner", "whole"))
        own, up, worth, keep = dict(zip(ids, mass)), dict(zip(ids, parents)), {}, {}
        total = {c: x for c, x in zip(ids, inner) if x is not None}
        for c in sorted(ids):  # a cluster's parts are earlier merges than it
            keep[c] = up[c] is not None and not total.get(c, float("-inf")) > own[c]
            worth[c] = own[c] if keep[c] else total.get(c, own[c])
            if up[c] in own:
                total[up[c]] = total.get(up[c], 0.0) + worth[c]
        chosen: dict = {}
        for c in sorted(ids, reverse=True):
            over = chosen.get(up[c], -1)
            chosen[c] = over if over != -1 else c if keep[c] else -1
        return pa.table({"cluster": pa.array(ids, pa.int64()), "chosen": pa.array([chosen[c] for c in ids], pa.int64())})

    rest = table.withColumn("inner", F.lit(None).cast("double")).withColumn("whole", F.lit(False))
    peeled = []
    while rest.count() > most:  # leaves are decided and handed to their parents
        parents = rest.select(F.col("parent").alias("_p")).where("_p is not null").distinct()
        leaves = written(rest.join(parents, F.col("cluster") == F.col("_p"), "left_anti").withColumn("keep", ~F.coalesce(F.col("inner") > F.col("mass"), F.lit(False))), "leaves")
        peeled.append(leaves)
        given = leaves.groupBy(F.col("parent").alias("_p")).agg(F.sum(F.when(F.col("keep"), F.col("mass")).otherwise(F.col("inner"))).alias("_more"))
        stays = rest.join(leaves.select(F.col("cluster").alias("_c")), F.col("cluster") == F.col("_c"), "left_anti")
        rest = written(stays.join(given, F.col("cluster") == F.col("_p"), "left").withColumn("inner", F.when(F.col("_more").isNull(), F.col("inner")).otherwise(F.coalesce("inner", F.lit(0.0)) + F.col("_more"))).select(rest.columns), "rest")
    out = rest.groupBy(F.lit(0).alias("_all")).applyInArrow(decide, "cluster long, chosen long")  # `most` clusters at most
    for leaves in reversed(peeled):
        over = out.select(F.col("cluster").alias("_p"), F.col("chosen").alias("_over"))
        mine = leaves.join(over, F.col("parent") == F.col("_p"), "left").select("cluster", F.when(F.col("_over") != -1, F.col("_over")).when(F.col("keep") & F.col("parent").isNotNull(), F.col("cluster")).otherwise(F.lit(-1)).cast("long").alias("chosen"))
        out = written(out.unionByName(mine), "chosen")
    return out


def hdbscan(vectors: DataFrame, column: str = "embedding", least: int = 4, rows: int = BLOCK, most: int = MOST) -> DataFrame:
    """(vec_id, cluster) of vectors (vec_id, column), clusters numbered from 0 by their smallest vec_id, -1 for noise.

    `rows` and `most` bound a task and change no result. All pairs are looked at, as exact trees in many dimensions
    need: work grows with the square of the vectors. Null vectors, and all of fewer than 2 * least, are
    noise; a vec_id is unique; an empty table gives an empty result.
    """
    known = vectors.where(F.col(column).isNotNull()).select("vec_id", column)
    if known.count() < 2 * least:
        return vectors.select("vec_id", F.lit(-1).cast("long").alias("cluster"))
    blocks = packed(known, column, rows)
    n_blocks = blocks.agg(F.max("block")).first()[0] + 1
    filled = cored(blocks, n_blocks, least)
    tree = merge_tree(spanning_tree(filled, rows, most), most)
    chosen = excess_of_mass(tree, least, most)
    n = F.col("n_left") + F.col("n_right")
    up = tree.select(F.explode(F.array("left", "right")).alias("side"), "node", n.alias("n"))
    at = up.where("side >= 0").select(F.col("side").alias("place"), "node", "n")
    for _ in range(least - 2):  # merges of fewer than `least` grow by one at least on the way up
        higher = up.where("side < 0").select((-F.col("side") - 1).alias("node"), F.col("node").alias("_node"), F.col("n").alias("_n"))
        at = at.join(higher, "node", "left").select("place", F.when(F.col("n") < least, F.col("_node")).otherwise(F.col("node")).alias("node"), F.when(F.col("n") < least, F.col("_n")).otherwise(F.col("n")).alias("n"))
    places = scanned(known.select("vec_id"), [], [F.col("vec_id")]).select("vec_id", F.col("pos").alias("place"))
    found = written(places.join(at, "place").join(chosen, "node").where("cluster >= 0").select("vec_id", "cluster"), "found")
    numbers = scanned(found.groupBy("cluster").agg(F.min("vec_id").alias("_low")), [], [F.col("_low")]).select("cluster", F.col("pos").alias("_number"))
    numbered = found.join(numbers, "cluster").select("vec_id", "_number")
    return vectors.select("vec_id").join(numbered, "vec_id", "left").select("vec_id", F.coalesce("_number", F.lit(-1)).cast("long").alias("cluster"))


def reduced(vectors: DataFrame, dimensions: int = 128, column: str = "embedding") -> DataFrame:
    """vectors with `column` on its leading principal axes, for density clusters of many long vectors; null vectors stay null.

    Not centred: distances are the same. The covariance is a sum over all vectors.
    """
    from pyspark.ml.feature import PCA
    from pyspark.ml.functions import array_to_vector, vector_to_array

    known = vectors.where(F.col(column).isNotNull()).withColumn("_v", array_to_vector(F.col(column).cast("array<double>")))
    model = PCA(k=dimensions, inputCol="_v", outputCol="_w").fit(known)
    out = model.transform(known).withColumn(column, vector_to_array("_w")).select(vectors.columns)
    return out.unionByName(vectors.where(F.col(column).isNull()).withColumn(column, F.lit(None).cast("array<double>")))
