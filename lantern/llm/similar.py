"""Near copies by exact similarity: the Jaccard coefficient of five-word shingle sets, 4/5 or more.

1. Texts of equal sets collapse first.
2. SimHash (the tree of lantern.llm.simhash, over the same shingles) and the most usual head of a text's prefix lists
   propose one partner a text each, and each of its lists another, drawn by a hash; the proposals that pass the exact
   check are joined to components, which spares step 3 most pairs of a large group. Pairs of a large group that stay
   below 4/5 are not spared.
3. In any fixed order of the shingles, two sets of n shingles or more with a coefficient of 4/5 share one of the first
   n - ceil(4n/5) + 1 of each. All pairs of such a prefix list that are not yet in one component get the exact check,
   so no pair is lost. The order puts shingles that are frequent in a sample of the documents last, FREQUENT of them at
   most: the sample only shortens lists.
   Two long texts share many lists, so a list leaves a pair out where its members have one of their BEFORE lists before
   it in common: the first list that they share never does.
   The join itself leaves out pairs whose parity bits differ in more places than the sets may: a bit is the parity of
   the number of shingles that fall on it, so two sets differ in at least as many shingles as bits, and no pair is lost.
   1,024 bits are too few for long texts; what the join makes, and all proposals, meet as many bits as shingles next.
4. The components of all pairs that passed are the groups.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lantern.operators.components import connected_components
from lantern.llm.simhash import RADIUS, majority, near_links
from lantern.llm.words import chunks, free_names, prefix_hashes, released, small_batches, span_hashes, word_spans
from lantern.session import drop_written, written

SHINGLE, PART, OF = 5, 4, 5
SAMPLED, IN_SAMPLE, FREQUENT = 32, 3, 1 << 21
PARITY_LONGS, BEFORE = 16, 4


def shingle_set(text: bytes, shingle: int = SHINGLE) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the text's shingles; a text of fewer words is one shingle."""
    body = np.frombuffer(b" ".join(text.lower().split()), np.uint8)
    start, end = word_spans(body)
    last = max(0, min(shingle, len(start)) - 1)
    if not len(start):
        return np.zeros(1, np.uint64)
    return np.unique(span_hashes(prefix_hashes(body), start[: len(start) - last], end[last:]))


def signature(own: np.ndarray) -> int:
    value = xxhash.xxh3_64_intdigest(own.tobytes())
    return value - (1 << 64) if value >> 63 else value


def parity(own: np.ndarray) -> np.ndarray:
    """A power of two of bits as longs, PARITY_LONGS of them or as many bits as shingles: parities of the number of hashes on each."""
    size = max(64 * PARITY_LONGS, 1 << (len(own) - 1).bit_length())
    at = (own % np.uint64(size)).astype(np.int64)
    return np.packbits((np.bincount(at, minlength=size) & 1).astype(np.uint8)).view(np.int64)


def folded(wide: np.ndarray) -> np.ndarray:
    """The first PARITY_LONGS longs that parity() gives with that size, from those of a larger one."""
    return np.bitwise_xor.reduce(wide.reshape(-1, PARITY_LONGS), axis=0)


def prefix(own: np.ndarray, frequent: np.ndarray, rank: np.ndarray) -> np.ndarray:
    """The first n - ceil(4n/5) + 1 shingles: those not in `frequent` by hash, then the frequent ones by rank."""
    n = len(own)
    most = n - (PART * n + OF - 1) // OF + 1
    if not len(frequent):
        return own[:most]
    at = np.minimum(np.searchsorted(frequent, own), len(frequent) - 1)
    known = frequent[at] == own
    return own[np.lexsort((own, np.where(known, rank[at], -1)))[:most]]


def _sets(documents: DataFrame) -> DataFrame:
    """(key, sig, shingles) per row of documents (key, text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, texts in chunks(batches):
            sets = [shingle_set(t) for t in texts]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([signature(x) for x in sets], pa.int64()), pa.array([x.view(np.int64) for x in sets], pa.list_(pa.int64()))], names=["key", "sig", "shingles"])

    return documents.select("key", "text").mapInArrow(run, "key long, sig long, shingles array<long>")


def _prefixes(documents: DataFrame) -> DataFrame:
    """(key, doc_id, sig, fp, n, bits, wide, heads) per row of documents (key, doc_id, text): n shingles, of which heads are the prefix."""
    spark = documents.sparkSession
    n = documents.count()
    part = F.pmod("key", F.lit(max(1, min(SAMPLED, n // 4096)))) == 0
    counts = _sets(documents.where(part)).select(F.explode("shingles").alias("s")).groupBy("s").count().where(F.col("count") >= IN_SAMPLE)
    counts = written(counts, "counts")
    # each has a share of 1 / FREQUENT or more of the counts, so FREQUENT of them at most come to the driver
    total = counts.agg(F.sum("count")).head()[0] or 0
    rows = counts.where(F.col("count") >= total / FREQUENT).toPandas()
    drop_written(spark, counts)
    rows["s"] = rows["s"].to_numpy(np.int64).view(np.uint64)
    rows = rows.sort_values("s")
    order = spark.sparkContext.broadcast((rows["s"].to_numpy(np.uint64), rows["count"].to_numpy(np.int64)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, texts in chunks(batches):
            sets = [shingle_set(t) for t in texts]
            wide = [parity(x) for x in sets]
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0),
                    batch.column(1),
                    pa.array([signature(x) for x in sets], pa.int64()),
                    pa.array(np.array([majority(x) for x in sets], np.uint64).view(np.int64)),
                    pa.array([len(x) for x in sets], pa.int64()),
                    pa.array([folded(x) for x in wide], pa.list_(pa.int64())),
                    pa.array(wide, pa.list_(pa.int64())),
                    pa.array([prefix(x, *order.value).view(np.int64) for x in sets], pa.list_(pa.int64())),
                ],
                names=["key", "doc_id", "sig", "fp", "n", "bits", "wide", "heads"],
            )

    return documents.select("key", "doc_id", "text").mapInArrow(run, "key long, doc_id long, sig long, fp long, n long, bits array<long>, wide array<long>, heads array<long>")


def _shared(lists: DataFrame, n: int) -> DataFrame:
    """(s, sig, m, size) of the prefix lists (s, sig) with two signatures or more, m the list's least; n rows, some 262,144 a bucket."""

    def keep(table: pa.Table) -> pa.Table:
        s, sig = (table.column(c).to_numpy() for c in ("s", "sig"))
        at = np.lexsort((sig, s))
        s, sig = s[at], sig[at]
        new = np.ones(len(s), bool)
        new[1:] = (s[1:] != s[:-1]) | (sig[1:] != sig[:-1])
        s, sig = s[new], sig[new]
        start = np.flatnonzero(np.concatenate(([True], s[1:] != s[:-1])))
        size = np.diff(np.append(start, len(s)))
        more = np.repeat(size, size) > 1
        out = pa.table({"s": s[more], "sig": sig[more], "m": np.repeat(sig[start], size)[more], "size": np.repeat(size, size)[more]})
        del table, s, sig, at, new
        released()
        return out

    return lists.groupBy(F.pmod("s", F.lit(max(8, n >> 18))).cast("int").alias("bucket")).applyInArrow(keep, "s long, sig long, m long, size long")


def _possible(common: Column, n: Column, m: Column) -> Column:
    """False where two sets of n and m shingles, with `common` in both prefixes, can't have the coefficient.

    The set whose prefix ends first has all that is common so far in both prefixes, so the sets share at most common
    and the rest of that set.
    """
    rest = F.ceil(F.greatest(n, m) * PART / OF) - 1
    return (n * OF >= m * PART) & (m * OF >= n * PART) & ((common + rest) * (PART + OF) >= (n + m) * PART)


def _alike(n: Column, m: Column, x: Column, y: Column) -> Column:
    """False where the parity bits x and y of sets of n and m shingles differ in more places than the sets may."""
    apart = sum((F.bit_count(x[i].bitwiseXOR(y[i])) for i in range(PARITY_LONGS)), F.lit(0))
    return apart * (PART + OF) <= (n + m) * (OF - PART)


def _halved(wide: Column, other: Column) -> Column:
    """Longs of parity bits folded once where `other` has fewer; sizes of sets that may have the coefficient differ by one fold at most."""
    half = F.floor(F.size(wide) / 2).cast("int")
    once = F.zip_with(F.slice(wide, F.lit(1), half), F.slice(wide, half + 1, half), lambda p, q: p.bitwiseXOR(q))
    return F.when(F.size(wide) > F.size(other), once).otherwise(wide)


def _widely_alike(pairs: DataFrame, points: DataFrame) -> DataFrame:
    """The pairs (a, b) that their sizes and all their parity bits leave."""
    for side in ("a", "b"):
        pairs = pairs.join(points.select(F.col("sig").alias(side), F.col("n").alias(f"n_{side}"), F.col("wide").alias(f"wide_{side}")), side)
    n, m, x, y = (F.col(c) for c in ("n_a", "n_b", "wide_a", "wide_b"))
    differing = F.zip_with(_halved(x, y), _halved(y, x), lambda p, q: F.bit_count(p.bitwiseXOR(q)))
    apart = F.aggregate(differing, F.lit(0), lambda total, bits: total + bits)
    return pairs.where((n * OF >= m * PART) & (m * OF >= n * PART)).where(apart * (PART + OF) <= (n + m) * (OF - PART)).select("a", "b")


def _checked(pairs: DataFrame, documents: DataFrame, points: DataFrame) -> DataFrame:
    """The pairs (a, b) of signatures whose sets have the coefficient."""
    pairs = pairs.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    pairs = written(_widely_alike(pairs, points), "pairs")
    used = pairs.select(F.col("a").alias("sig")).unionByName(pairs.select(F.col("b").alias("sig"))).distinct()
    ids = written(points.join(used, "sig", "left_semi").select(F.col("first").alias("key"), "sig"), "ids")
    wanted = documents.join(ids.select("key"), "key", "left_semi")
    sets = written(_sets(wanted).join(ids.select("sig"), "sig", "left_semi").dropDuplicates(["sig"]).select("sig", "shingles"), "sets")
    both = pairs.join(sets.select(F.col("sig").alias("a"), F.col("shingles").alias("x")), "a").join(sets.select(F.col("sig").alias("b"), F.col("shingles").alias("y")), "b")
    common = F.size(F.array_intersect("x", "y"))
    links = written(both.where(common * (PART + OF) >= (F.size("x") + F.size("y")) * PART).select("a", "b"), "links")
    for old in (pairs, ids, sets):
        drop_written(pairs.sparkSession, old)
    return links


def keyed(documents: DataFrame) -> DataFrame:
    """(key, doc_id, text) of documents; key is a hash of doc_id and text."""
    doc_id, text = F.col("doc_id").cast("long"), F.col("text").cast("string")
    return documents.select(F.xxhash64(doc_id, text).alias("key"), doc_id.alias("doc_id"), text.alias("text"))


def _grouped(documents: DataFrame) -> tuple[DataFrame, DataFrame]:
    """rows (key, doc_id, sig) of keyed documents, and (sig, root, best): each set's group and its least (no doc_id, doc_id, key)."""
    with small_batches(documents.sparkSession):
        rows = written(_prefixes(documents), "prefixes")
    least_row = F.min(F.struct(F.col("doc_id").isNull().alias("unnamed"), "doc_id", "key")).alias("best")
    points = written(rows.groupBy("sig").agg(F.min("key").alias("first"), least_row, F.min("fp").alias("fp"), F.min("n").alias("n"), F.min("bits").alias("bits"), F.min("wide").alias("wide")), "points")
    firsts = rows.join(points.select("sig", F.col("first").alias("key")), ["sig", "key"], "left_semi")
    size = rows.agg(F.sum(F.size("heads"))).head()[0] or 0
    lists = written(_shared(firsts.select(F.explode("heads").alias("s"), "sig"), size), "lists")
    sizes = points.select(F.col("sig").alias("b"), F.col("n").alias("n_b"), F.col("bits").alias("bits_b"))
    usual = lists.where("sig <> m").groupBy("sig", "m").count().groupBy("sig").agg(F.max(F.struct("count", "m")).alias("top")).select(F.col("sig").alias("a"), F.col("top.m").alias("b"), F.col("top.count").alias("common"))
    prints = written(points.groupBy("fp").agg(F.min("sig").alias("b")), "prints")
    roots = written(connected_components(near_links(prints.select("fp"), RADIUS)), "roots").select(F.col("node").alias("fp"), "root")
    heads = points.join(roots, "fp", "left").select(F.col("sig").alias("a"), F.coalesce("root", "fp").alias("fp")).join(prints, "fp").where("a <> b")
    # SimHash's proposals come without a count of common heads, so all of like size are checked
    # and every list's members meet in random threes, so each has a partner from nearly all of its lists
    third = F.pmod(F.xxhash64("s", "sig"), F.greatest(F.lit(1), F.floor(F.col("size") / 3)))
    threes = lists.groupBy("s", third.alias("_third")).agg(F.min("sig").alias("a"), F.max("sig").alias("b"))
    met = threes.where("a <> b").select("a", "b").distinct().withColumn("common", F.lit(1 << 40))
    proposals = usual.unionByName(met).unionByName(heads.select("a", "b", F.lit(1 << 40).alias("common")))
    proposals = proposals.join(points.select(F.col("sig").alias("a"), F.col("n").alias("n_a"), F.col("bits").alias("bits_a")), "a").join(sizes, "b")
    proposals = proposals.where(_possible(F.col("common"), F.col("n_a"), F.col("n_b")) & _alike(F.col("n_a"), F.col("n_b"), F.col("bits_a"), F.col("bits_b"))).select("a", "b")
    links = _checked(proposals, documents, points)
    found = written(connected_components(links), "roots").select(F.col("node").alias("sig"), "root")
    named = written(lists.select("s", "sig").join(found, "sig", "left").select("s", "sig", F.coalesce("root", "sig").alias("root")), "lists")
    mixed = named.groupBy("s").agg(F.min("root").alias("_a"), F.max("root").alias("_b")).where("_a <> _b").select("s")
    before = F.collect_list("s").over(Window.partitionBy("sig").orderBy("s").rowsBetween(-BEFORE, -1))
    left = written(named.join(mixed, "s", "left_semi").join(points.select("sig", "n", "bits"), "sig").withColumn("before", before), "lists")
    x, y = left.alias("x"), left.alias("y")
    near = (F.col("x.sig") < F.col("y.sig")) & (F.col("x.root") != F.col("y.root")) & (F.col("x.n") * OF >= F.col("y.n") * PART) & (F.col("y.n") * OF >= F.col("x.n") * PART)
    near = near & ~F.arrays_overlap("x.before", "y.before") & _alike(F.col("x.n"), F.col("y.n"), F.col("x.bits"), F.col("y.bits"))
    rest = x.join(y, (F.col("x.s") == F.col("y.s")) & near).select(F.col("x.sig").alias("a"), F.col("y.sig").alias("b"))
    roots = written(connected_components(links.unionByName(_checked(rest, documents, points))), "roots").select(F.col("node").alias("sig"), "root")
    placed = written(points.join(roots, "sig", "left").select("sig", "best", F.coalesce("root", "sig").alias("root")), "placed")
    for old in (points, lists, prints, found, named, left, links):
        drop_written(documents.sparkSession, old)
    return rows.select("key", "doc_id", "sig"), placed


def similar_groups(documents: DataFrame) -> DataFrame:
    """(doc_id, component_id) per row: the smallest doc_id that links of coefficient 4/5 or more reach, null where none has one.

    Null text counts as empty, and texts without words are copies of each other; rows of one doc_id are told apart by
    their texts; repeated rows get equal results; an empty table gives an empty result; other columns are ignored.
    """
    rows, placed = _grouped(keyed(documents))
    known = placed.join(placed.groupBy("root").agg(F.min("best").alias("least")), "root").select("sig", F.col("least.doc_id").alias("component_id"))
    return rows.join(known, "sig").select("doc_id", "component_id")


def without_copies(documents: DataFrame) -> DataFrame:
    """documents with one row of each group of similar_groups(): that of the smallest doc_id, rows without one last, ties by a hash.

    Repeated rows become one.
    """
    rows, placed = _grouped(keyed(documents))
    key, named = free_names(documents, "_key", "_named")
    kept = placed.groupBy("root").agg(F.min("best").alias("least")).select(F.col("least.key").alias(key), F.col("least.doc_id").alias(named))
    own = documents.withColumn(key, F.xxhash64(F.col("doc_id").cast("long"), F.col("text").cast("string"))).withColumn(named, F.col("doc_id").cast("long"))
    out = own.alias("o").join(kept.alias("k"), (F.col(f"o.{key}") == F.col(f"k.{key}")) & F.col(f"o.{named}").eqNullSafe(F.col(f"k.{named}")), "left_semi")
    if rows.count() > rows.select("key", "doc_id").distinct().count():
        out = out.dropDuplicates([key, named])
    return out.select(documents.columns)
