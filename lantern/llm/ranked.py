"""Ranked lexical search: every item's best documents by whole-number term impacts, exact, by a threshold-seeded join.

Items are taken in blocks of a bounded number of terms. For a block, one pass over all documents keeps each one's length
and its counts of the block's terms; from them come the document frequencies and, for each term, its stored impacts: the
largest one and the kth largest. An item's kth score is at least the kth impact of any of its terms, since that many
documents score that much by this term alone. With the item's terms ordered by their largest impact, those at the low end
whose sum stays below this threshold can't bring a document up to it: only documents with another term are candidates,
and a candidate is scored exactly over all terms of the item. A task raises the threshold as it finds better documents.
Each task sends an item's best `k`; the best of them are the result, whatever the tasks were.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lantern.llm.words import chunks
from lantern.session import written

BEST, BLOCK_TERMS = 10, 100_000
SEGMENT, DENSE_BYTES = 4 << 20, 8 << 20
#: bytes of a term as they count (A-Z in lower case), all others as blanks
TERM = bytes(b if b > 127 or 48 <= b < 58 or 97 <= b < 123 else b + 32 if 65 <= b < 91 else 32 for b in range(256))


def term_counts(text: bytes) -> Counter[bytes]:
    """How often each term occurs in the whole text, which is split in segments that end between terms."""
    data, out, at = text.translate(TERM), Counter(), 0
    while at < len(data):
        end = len(data) if len(data) - at <= SEGMENT else data.find(b" ", at + SEGMENT)
        end = len(data) if end < 0 else end
        out.update(data[at:end].split())
        at = end
    return out


def ratio(tf, n, documents: int, length: int):
    """A term's share before its weight, for tf occurrences in a document of n terms; whole numbers, as columns or arrays."""
    return (1_000_000_000 * tf) // (1_000 * tf + 8 * (10 + (90 * n * documents) // length))


def item_terms(items: DataFrame) -> DataFrame:
    """(item_id, term), each once. Items without a term, and null texts, have no row; rows of one item_id are one item."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, texts in chunks(batches):
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([[x.decode() for x in term_counts(t)] for t in texts], pa.list_(pa.string()))], names=["item_id", "terms"])

    kind = items.schema["item_id"].dataType.simpleString()
    return items.select("item_id", F.col("text").cast("string").alias("text")).mapInArrow(run, f"item_id {kind}, terms array<string>").select("item_id", F.explode("terms").alias("term")).distinct()


def term_vectors(documents: DataFrame, terms: list[str]) -> DataFrame:
    """(doc_id, n, terms, counts) of every document with a term of any kind: its length, and what it holds of `terms`, by place."""
    shared = documents.sparkSession.sparkContext.broadcast({t.encode(): i for i, t in enumerate(terms)})  # of one block

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        place = shared.value
        for batch, texts in chunks(batches):
            lengths, ends, found, often = [], [0], [], []
            for text in texts:
                counts = term_counts(text)
                lengths.append(counts.total())
                for t in counts.keys() & place.keys():
                    found.append(place[t])
                    often.append(counts[t])
                ends.append(len(found))
            spans = pa.array(ends, pa.int32())
            columns = [batch.column(0), pa.array(lengths, pa.int64()), pa.ListArray.from_arrays(spans, pa.array(found, pa.int32())), pa.ListArray.from_arrays(spans, pa.array(often, pa.int64()))]
            made = pa.RecordBatch.from_arrays(columns, names=["doc_id", "n", "terms", "counts"])
            yield made.filter(pc.greater(made.column(1), 0))

    return documents.select("doc_id", "text").mapInArrow(run, "doc_id long, n long, terms array<int>, counts array<bigint>")


def stored_impacts(vectors: DataFrame, documents: int, length: int, k: int) -> DataFrame:
    """(term, df, most, kth): the largest ratio of each term and the kth largest, 0 where fewer documents hold it.

    Tasks keep `k` rows a term before the shuffle, so a term that every document holds is as small as any other.
    """
    held = vectors.select("n", F.explode(F.arrays_zip("terms", "counts")).alias("x")).select(F.col("x.terms").alias("term"), F.col("x.counts").alias("tf"), "n")
    shares = held.select("term", F.expr(f"(1000000000 * tf) div (1000 * tf + 8 * (10 + (90 * n * {documents}) div {length}))").alias("share"))
    best = shares.withColumn("at", F.row_number().over(Window.partitionBy("term").orderBy(F.desc("share")))).where(F.col("at") <= k)
    tops = best.groupBy("term").agg(F.max("share").alias("most"), F.max(F.when(F.col("at") == k, F.col("share")).otherwise(0)).alias("kth"))
    return tops.join(vectors.select(F.explode("terms").alias("term")).groupBy("term").agg(F.count("*").alias("df")), "term")


class Item:
    """One item's terms by rising largest impact, and its best documents so far."""

    def __init__(self, terms: np.ndarray, most: np.ndarray, threshold: int, k: int):
        order = np.argsort(most[terms], kind="stable")
        self.terms, self.k, self.threshold = terms[order], k, threshold
        self.bounds = np.cumsum(most[terms][order])
        self.cut = int(np.searchsorted(self.bounds, threshold, "left"))  # the terms before it stay below the threshold together
        self.scores, self.ids, self.missing = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, bool)

    def meet(self, impacts: np.ndarray, ids: np.ndarray, missing: np.ndarray) -> None:
        """Score the candidates of a block; impacts has a row for each term and a column for each document."""
        held = impacts[self.terms[self.cut :]]
        at = np.flatnonzero(held.any(axis=0))
        if not len(at):
            return
        scores = held[:, at].sum(axis=0) + impacts[self.terms[: self.cut][:, None], at].sum(axis=0)
        good = (scores > 0) & (scores >= self.threshold)
        if not good.any():
            return
        at = at[good]
        scores, ids, missing = np.concatenate((self.scores, scores[good])), np.concatenate((self.ids, ids[at])), np.concatenate((self.missing, missing[at]))
        first = np.lexsort((ids, missing, -scores))[: self.k]
        self.scores, self.ids, self.missing = scores[first], ids[first], missing[first]
        if len(first) == self.k and self.scores[-1] > self.threshold:
            self.threshold = int(self.scores[-1])
            self.cut = int(np.searchsorted(self.bounds, self.threshold, "left"))


def searched(vectors: DataFrame, items: list[np.ndarray], weights: np.ndarray, most: np.ndarray, kth: np.ndarray, documents: int, length: int, k: int) -> DataFrame:
    """(item, doc_id, score): each task's best `k` documents of every item, exactly scored; the arrays are those of one block of items."""
    shared = vectors.sparkSession.sparkContext.broadcast((items, weights, most, kth))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        items, weights, most, kth = shared.value
        asked = [Item(t, most, int(kth[t].max()), k) for t in items]
        width = max(1, DENSE_BYTES // (8 * len(weights)))
        impacts = np.zeros((len(weights), width), np.int64)
        for batch in batches:
            ids, n = batch.column(0).fill_null(0).to_numpy(zero_copy_only=False), batch.column(1).to_numpy()
            missing = batch.column(0).is_null().to_numpy(zero_copy_only=False)
            ends = batch.column(2).offsets.to_numpy()
            terms, tf = batch.column(2).values.to_numpy(), batch.column(3).values.to_numpy()
            for at in range(0, len(n), width):
                last = min(at + width, len(n))
                span = slice(ends[at], ends[last])
                row = np.repeat(np.arange(last - at), np.diff(ends[at : last + 1]))
                impacts[terms[span], row] = weights[terms[span]] * ratio(tf[span], n[at:last][row], documents, length)
                for item in asked:
                    item.meet(impacts[:, : last - at], ids[at:last], missing[at:last])
                impacts[terms[span], row] = 0
        for i, item in enumerate(asked):
            if len(item.ids):
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(item.ids), i, np.int32)), pa.array(item.ids, mask=item.missing), pa.array(item.scores)], names=["item", "doc_id", "score"])

    return vectors.mapInArrow(run, "item int, doc_id long, score long")


def search(documents: DataFrame, items: DataFrame, k: int = BEST, block_terms: int = BLOCK_TERMS) -> DataFrame:
    """(item_id, rank, doc_id, score): the `k` best documents with a score above 0 of every item, equal scores by ascending doc_id.

    Null texts have no terms; an item without terms, or whose terms no document holds, has no row; an empty table on
    either side gives an empty result. Rows of one doc_id are documents of their own, rows of one item_id one item; a
    null doc_id comes last among equals. Texts are split whole, in segments. Other columns take no part.
    """
    spark = documents.sparkSession
    docs = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    asked = written(item_terms(items), "item-terms")
    kind = asked.schema["item_id"].dataType
    found = []
    blocks = max(1, math.ceil(asked.count() / block_terms))
    for block in range(blocks):
        rows = asked.where(F.pmod(F.xxhash64("item_id"), F.lit(blocks)) == block).toArrow().to_pydict()  # `block_terms` or so, or one item
        if not rows["term"]:
            continue
        terms = sorted(set(rows["term"]))
        place = {t: i for i, t in enumerate(terms)}
        held: dict = {}
        for name, term in zip(rows["item_id"], rows["term"]):
            held.setdefault(name, []).append(place[term])
        names, of = list(held), [np.array(x) for x in held.values()]
        vectors = written(term_vectors(docs, terms), "vectors")
        n, length = vectors.agg(F.count("*"), F.sum("n")).first()
        if not n:
            continue
        weights, most, kth = (np.zeros(len(terms), np.int64) for _ in range(3))
        for r in stored_impacts(vectors, n, length, k).toLocalIterator():  # a row for each of the block's terms
            weights[r.term] = math.floor(1000 * math.log((2 * n + 2) / (2 * r.df + 1)))
            most[r.term], kth[r.term] = weights[r.term] * r.most, weights[r.term] * r.kth
        best = searched(vectors, of, weights, most, kth, n, length, k)
        numbered = spark.createDataFrame(list(enumerate(names)), f"item int, item_id {kind.simpleString()}")
        found.append(best.join(F.broadcast(numbered), "item").select("item_id", "doc_id", "score"))  # the block's items
    if not found:
        return spark.createDataFrame([], f"item_id {kind.simpleString()}, rank int, doc_id long, score long")
    place = F.row_number().over(Window.partitionBy("item_id").orderBy(F.desc("score"), F.asc_nulls_last("doc_id")))
    return reduce(DataFrame.union, found).withColumn("rank", place).where(F.col("rank") <= k).select("item_id", "rank", "doc_id", "score")
