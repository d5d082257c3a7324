"""SimHash near-duplicates by vantage-point trees over Hamming distance.

1. A document's fingerprint is the bitwise majority of the XXH64 hashes (seed 42) of its 3-word shingles.
2. Equal fingerprints collapse first, so copies cost one point.
3. A vantage-point tree, fitted on a bounded sample of fingerprints, parts them into shards: at each node a point
   goes inside (distance to the pivot at most mu) or outside. By the triangle inequality two points within `radius`
   that a node parts have the inner one within radius - 1 of the boundary, so inner points there also become members
   of the outer side. Hence every pair within the radius meets in some shard, whatever the sample was.
4. A shard goes on splitting by the same rule inside its task, and the leaves compare exactly. A leaf gives each
   linked point its local component, never the pairs.
5. The local components are joined to global ones by connected_components().
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lantern.operators.components import connected_components
from lantern.llm.words import chunks
from lantern.session import written

SHINGLE, SEED, RADIUS = 3, 42, 3
SAMPLE, SHARD, MOST_SHARDS, LEAF = 65_536, 4_096, 8_192, 1_024
BITS = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1).astype(np.int64)


def fingerprint(text: bytes, shingle: int = SHINGLE) -> int:
    """The unsigned 64-bit SimHash of one text; 0 without words."""
    words = text.lower().split()
    if not words:
        return 0
    body = b" ".join(words)
    digest = xxhash.xxh64_intdigest
    n = len(words) - shingle + 1
    if n <= 1:
        hashes = [digest(body, SEED)]
    else:
        ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1)
        starts = np.concatenate(([0], ends[: n - 1])).tolist()
        hashes = [digest(body[a:b], SEED) for a, b in zip(starts, (ends[shingle - 1 :] - 1).tolist(), strict=True)]
    return majority(np.array(hashes, np.uint64))


def majority(hashes: np.ndarray) -> int:
    """The unsigned 64-bit number of the bits that more than half of the hashes have."""
    octets = hashes.astype(">u8").view(np.uint8).reshape(-1, 8)
    at = octets + (np.arange(8) * 256)
    counts = np.einsum("pv,vb->pb", np.bincount(at.ravel(), minlength=2048).reshape(8, 256), BITS)
    return int.from_bytes(np.packbits(2 * counts.ravel() > len(hashes)).tobytes(), "big")


def fingerprints(documents: DataFrame, shingle: int = SHINGLE) -> DataFrame:
    """(doc_id, fp) per row, fp as a signed long."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, texts in chunks(batches):
            fp = np.array([fingerprint(t, shingle) for t in texts], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(batch.schema.get_field_index("doc_id")), pa.array(fp)], names=["doc_id", "fp"])

    return documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, "doc_id long, fp long")


def distances(points: np.ndarray, pivot: np.uint64) -> np.ndarray:
    return np.bitwise_count(points ^ pivot)


def choose_split(points: np.ndarray, radius: int, seed: int = 0) -> tuple[np.uint64, int] | None:
    """The pivot among a few points, and the distance mu, that part the points evenly with few at the boundary; None if no split helps."""
    best, n = None, len(points)
    rng = np.random.default_rng(seed + n)
    for pivot in points[rng.integers(0, n, 12)]:
        below = np.cumsum(np.bincount(distances(points, pivot), minlength=65))
        for mu in range(0, 64):
            inside = int(below[mu])
            shared = inside - (int(below[mu - radius]) if mu >= radius else 0)
            largest = max(inside, n - inside + shared)
            cost = largest * largest + min(inside, n - inside + shared) ** 2
            if inside and inside < n and largest < 0.9 * n and (best is None or cost < best[0]):
                best = (cost, pivot, mu)
    return best and (best[1], best[2])


def sides(points: np.ndarray, pivot: np.uint64, mu: int, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Masks of the inner and of the outer members: inner points within radius - 1 of the boundary belong to both."""
    d = distances(points, pivot).astype(np.int64)
    return d <= mu, d > mu - radius


def build_tree(sample: np.ndarray, shards: int, radius: int = RADIUS) -> list[tuple]:
    """Nodes (pivot, mu, inner, outer), leaves (shard,); node 0 is the root. At most `shards` leaves, of 8 sample points or more each."""
    nodes: list[tuple] = [(0,)]
    open_nodes = [(sample, 0)]
    leaves = 1
    while open_nodes and leaves < shards:
        open_nodes.sort(key=lambda x: len(x[0]))
        points, at = open_nodes.pop()
        split = choose_split(points, radius) if len(points) >= 16 else None
        if split is None:
            continue
        inner, outer = sides(points, *split, radius)
        nodes[at] = (*split, len(nodes), len(nodes) + 1)
        for mask in (inner, outer):
            open_nodes.append((points[mask], len(nodes)))
            nodes.append((0,))
        leaves += 1
    shard = 0
    for i, node in enumerate(nodes):
        if len(node) == 1:
            nodes[i] = (shard,)
            shard += 1
    return nodes


def route(points: np.ndarray, nodes: list[tuple], radius: int = RADIUS) -> tuple[np.ndarray, np.ndarray]:
    """(shard, index of the point) for every shard that each point is a member of."""
    found, todo = [], [(0, np.arange(len(points)))]
    while todo:
        at, index = todo.pop()
        if not len(index):
            continue
        node = nodes[at]
        if len(node) == 1:
            found.append((np.full(len(index), node[0], np.int32), index))
            continue
        pivot, mu, inner, outer = node
        a, b = sides(points[index], pivot, mu, radius)
        todo += [(inner, index[a]), (outer, index[b])]
    return (np.concatenate([x for x, _ in found]), np.concatenate([x for _, x in found])) if found else (np.zeros(0, np.int32), np.zeros(0, np.int64))


def _absorb(points: np.ndarray, radius: int) -> np.ndarray:
    """Index of each point's component representative: a component grows from a seed and takes in what its newest points reach.

    Points already taken are never compared again, so a dense cluster costs its size times what it doesn't reach.
    """
    label = np.arange(len(points))
    rest = np.arange(len(points))
    while len(rest):
        seed, rest = rest[0], rest[1:]
        front = np.array([seed])
        while len(front) and len(rest):
            block, front = front[:32], front[32:]
            hit = np.zeros(len(rest), bool)
            for p in points[block]:
                hit |= np.bitwise_count(points[rest] ^ p) <= radius
            new = rest[hit]
            label[new] = seed
            front, rest = np.concatenate((front, new)), rest[~hit]
    return label


def leaf_links(points: np.ndarray, radius: int = RADIUS, leaf: int = LEAF) -> tuple[np.ndarray, np.ndarray]:
    """(point, representative) links that join all of the shard's pairs within the radius; points are distinct."""
    links, todo = [], [points]
    while todo:
        own = todo.pop()
        split = choose_split(own, radius) if len(own) > leaf else None
        if split is not None:
            inner, outer = sides(own, *split, radius)
            todo += [own[inner], own[outer]]
            continue
        if len(own) <= 4 * leaf:  # drop the points that reach no other before growing components
            near = np.zeros(len(own), bool)
            for i in range(0, len(own), 128):
                near[i : i + 128] = (np.bitwise_count(own[i : i + 128, None] ^ own[None, :]) <= radius).sum(axis=1) > 1
            own = own[near]
        label = _absorb(own, radius)
        other = label != np.arange(len(own))
        links.append((own[other], own[label[other]]))
    return np.concatenate([a for a, _ in links]), np.concatenate([b for _, b in links])


def near_links(points: DataFrame, radius: int = RADIUS) -> DataFrame:
    """Links (a long, b long) between distinct fingerprints (fp) that join all pairs within the radius."""
    spark = points.sparkSession
    n = points.count()
    shards = int(min(MOST_SHARDS, max(1, n // SHARD)))
    # a hash threshold takes about SAMPLE of the points, whatever their number, and nothing else leaves the tasks
    share = F.shiftrightunsigned(F.xxhash64("fp"), 1) < F.lit(min(2**63 - 1, 2**63 * SAMPLE // max(n, 1)))
    sample = [r["fp"] for r in points.where(share).collect()]
    tree = spark.sparkContext.broadcast(build_tree(np.array(sample, np.int64).view(np.uint64), shards, radius))

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fp = batch.column(0).to_numpy(zero_copy_only=False)
            shard, index = route(fp.view(np.uint64), tree.value, radius)
            yield pa.RecordBatch.from_arrays([pa.array(shard), pa.array(fp[index])], names=["shard", "fp"])

    def link(table: pa.Table) -> pa.Table:
        a, b = leaf_links(np.unique(table.column("fp").to_numpy().view(np.uint64)), radius)
        return pa.table({"a": a.view(np.int64), "b": b.view(np.int64)})

    return points.mapInArrow(send, "shard int, fp long").groupBy("shard").applyInArrow(link, "a long, b long")


def near_duplicates(documents: DataFrame, radius: int = RADIUS, shingle: int = SHINGLE) -> DataFrame:
    """(doc_id, fp, component_id) per row: component_id is the smallest doc_id reachable over links of at most `radius` bits.

    Null text counts as empty; texts without words have fingerprint 0 and link like any other; repeated rows get equal
    results; an empty table gives an empty result; equal fingerprints are one point. component_id is null only where every
    doc_id of a group is.
    """
    docs = written(fingerprints(documents, shingle), "fingerprints")
    first = written(docs.groupBy("fp").agg(F.min("doc_id").alias("first")), "points")
    roots = written(connected_components(near_links(first.select("fp"), radius)), "roots")
    least = roots.join(first, roots["node"] == first["fp"]).groupBy("root").agg(F.min("first").alias("least"))
    named = roots.join(least, "root").select(F.col("node").alias("fp"), "least")
    known = written(first.join(named, "fp", "left").select("fp", F.coalesce("least", "first").alias("component_id")), "known")
    return docs.join(known, "fp").select("doc_id", "fp", "component_id")
