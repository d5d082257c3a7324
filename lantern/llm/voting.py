"""Quality by nearest neighbours: labelled latent-semantic vectors are broadcast and vote by their similarity to each document.

A text is counted by hashed byte 4-grams and 3-grams of byte classes (lower, upper, digit, blank, each other sign),
weighted by log(1 + count) and by an inverse document frequency over all documents. Latent directions are the leading
eigenvectors of the labelled vectors' Gram matrix. At most `neighbours` labelled rows are kept, those of the smallest
hash of doc_id: a documented parameter, so neither the broadcast (64 short integers a row) nor the Gram matrix grows
with the input. Latent vectors are rounded to multiples of 1 / SCALE, so their products are exact in float32 whatever
the order of addition: every document meets every labelled vector in blocks, with equal results on every run.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lantern.llm.words import chunks
from lantern.session import drop_written, written

BYTE_BUCKETS = CLASS_BUCKETS = 1024
BUCKETS = BYTE_BUCKETS + CLASS_BUCKETS
NEIGHBOURS, DIMENSIONS, VOTERS, PREDICT_FROM = 8_192, 64, 15, 0.7
FOLDS, HELD_OUT = 4, 2
SCALE = 2048.0
ROWS, SEGMENT = 256, 1 << 20

#: a class for each byte: lower-case letters and all bytes beyond ASCII, upper case, digits, then each other byte its own
CLASSES = np.array([0 if b > 127 or 97 <= b < 123 else 1 if 65 <= b < 91 else 2 if 48 <= b < 58 else 3 + b for b in range(256)], np.uint32)
SPREAD, CLASS_SPREAD = np.uint32(2654435761), np.uint32(2246822519)


def gram_counts(text: bytes) -> np.ndarray:
    """How often each bucket's grams occur in the whole text, read in segments."""
    out = np.zeros(BUCKETS, np.int64)
    data = np.frombuffer(text, np.uint8)
    for at in range(0, len(data), SEGMENT):
        part = data[at : at + SEGMENT + 3]
        if len(part) > 3:
            x = part.astype(np.uint32)
            packed = x[:-3] | x[1:-2] << np.uint32(8) | x[2:-1] << np.uint32(16) | x[3:] << np.uint32(24)
            out[:BYTE_BUCKETS] += np.bincount(packed * SPREAD >> np.uint32(22), minlength=BYTE_BUCKETS)
        kinds = CLASSES[part[: SEGMENT + 2]]
        if len(kinds) > 2:
            packed = kinds[:-2] | kinds[1:-1] << np.uint32(8) | kinds[2:] << np.uint32(16)
            out[BYTE_BUCKETS:] += np.bincount(packed * CLASS_SPREAD >> np.uint32(22), minlength=CLASS_BUCKETS)
    return out


def log_counts(texts: list[bytes]) -> np.ndarray:
    return np.log1p(np.array([gram_counts(t) for t in texts], np.float32).reshape(-1, BUCKETS))


def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, np.ndarray]]:
    """Slices of at most ROWS rows, with the log counts of their texts."""
    for batch, texts in chunks(batches):
        for at in range(0, len(texts), ROWS):
            yield batch.slice(at, ROWS), log_counts(texts[at : at + ROWS])


def document_frequencies(documents: DataFrame) -> tuple[np.ndarray, int]:
    """In how many texts of all documents each bucket occurs, and how many rows there are. A row a bucket and task is shuffled."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(BUCKETS + 1, np.int64)
        for _, x in blocks(batches):
            total[:-1] += np.count_nonzero(x, axis=0)
            total[-1] += len(x)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(BUCKETS + 1), pa.int32()), pa.array(total)], names=["bucket", "n"])

    out = np.zeros(BUCKETS + 1, np.int64)
    for r in documents.select("text").mapInArrow(run, "bucket int, n long").groupBy("bucket").agg(F.sum("n").alias("n")).collect():  # BUCKETS + 1 rows
        out[r.bucket] = r.n
    return out[:-1], int(out[-1])


def labelled_sample(labels: DataFrame, rows: int = NEIGHBOURS) -> DataFrame:
    """(doc_id, label) of at most `rows` labelled rows outside the held-out fold, those of the smallest hash of doc_id.

    A doc_id with several labels counts once, by the lowest; null labels and null ids count nowhere.
    """
    good = labels.where("doc_id is not null and quality is not null").select(F.col("doc_id").cast("long").alias("doc_id"), F.col("quality").cast("int").alias("label"))
    train = good.where(~held_out()).groupBy("doc_id").agg(F.min("label").alias("label"))
    return train.orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows)


def held_out():
    """Whether crc32 of doc_id as text falls into the held-out fold; false for a null doc_id."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % FOLDS == HELD_OUT, F.lit(False))


def leading(gram: np.ndarray, dimensions: int, rounds: int = 16) -> np.ndarray:
    """The leading eigenvectors of a symmetric matrix, by subspace iteration from a fixed start."""
    start = np.random.default_rng(7).standard_normal((len(gram), dimensions + 32))
    for _ in range(rounds):
        start, _ = np.linalg.qr(gram @ start)
    _, turn = np.linalg.eigh(start.T @ gram @ start)
    return (start @ turn[:, ::-1])[:, :dimensions]


def latent(x: np.ndarray, weighting: np.ndarray) -> np.ndarray:
    """Latent vectors of unit length in steps of 1 / SCALE, as whole numbers in float32; zero where nothing is left."""
    z = x @ weighting
    length = np.linalg.norm(z, axis=1, keepdims=True)
    return np.rint(SCALE * np.divide(z, length, out=np.zeros_like(z), where=length > 0)).astype(np.float32)


def fit(documents: DataFrame, labels: DataFrame, neighbours: int = NEIGHBOURS, dimensions: int = DIMENSIONS) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(weighting, vectors, label of each): bucket weights times latent directions, and the labelled vectors in order of doc_id."""
    ids = F.broadcast(labelled_sample(labels, neighbours))  # `neighbours` rows at most

    def featured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, x in blocks(batches):
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array([r.tobytes() for r in x], pa.binary())], names=["doc_id", "label", "x"])

    # min: of rows with one doc_id one counts
    kept = documents.select("doc_id", "text").join(ids, "doc_id").select("doc_id", "label", "text").mapInArrow(featured, "doc_id long, label int, x binary")
    sample = written(kept.groupBy("doc_id").agg(F.min("label").alias("label"), F.min("x").alias("x")), "labelled")
    seen, n = document_frequencies(documents)
    idf = (np.log((n + 1) / (seen + 1)) + 0.05).astype(np.float32)

    def matrix(batch: pa.RecordBatch) -> np.ndarray:
        x = np.frombuffer(b"".join(batch.column(batch.schema.get_field_index("x")).to_pylist()), np.float32).reshape(-1, BUCKETS) * idf
        length = np.linalg.norm(x, axis=1, keepdims=True)
        return np.divide(x, length, out=np.zeros_like(x), where=length > 0)

    def gram(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((BUCKETS, BUCKETS), np.float32)
        for batch in batches:
            for at in range(0, batch.num_rows, ROWS):
                x = matrix(batch.slice(at, ROWS))
                total += x.T @ x
        yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()], pa.large_binary())], names=["gram"])

    def small(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, ROWS):
                part = batch.slice(at, ROWS)
                z = latent(matrix(part), directions).astype(np.int16)
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array([r.tobytes() for r in z], pa.binary())], names=["doc_id", "label", "z"])

    grams = np.zeros((BUCKETS, BUCKETS))
    for r in sample.coalesce(4).mapInArrow(gram, "gram binary").toLocalIterator():  # four matrices at most, one at a time
        grams += np.frombuffer(r.gram, np.float32).reshape(BUCKETS, BUCKETS)
    directions = leading(grams, dimensions).astype(np.float32)
    rows = sorted((r.doc_id, r.label, bytes(r.z)) for r in sample.coalesce(4).mapInArrow(small, "doc_id long, label int, z binary").collect())  # `neighbours` rows at most
    drop_written(documents.sparkSession, sample)
    vectors = np.frombuffer(b"".join(r[2] for r in rows), np.int16).reshape(-1, dimensions)
    return idf[:, None] * directions, vectors, np.array([r[1] for r in rows], np.float32)


def votes(z: np.ndarray, vectors: np.ndarray, labels: np.ndarray, voters: int = VOTERS) -> np.ndarray:
    """The labels of each row's nearest vectors, weighted by cosine; all vectors as near as the last voter vote too.

    Rows without a vector, and those none of whose voters is on their side, get the mean label (0.5 without labels).
    """
    prior = float(labels.mean()) if len(labels) else 0.5
    if not len(labels):
        return np.full(len(z), prior)
    p = vectors.astype(np.float32)
    length = np.linalg.norm(p.astype(np.float64), axis=1)
    cosine = (z @ p.T) * np.divide(1, length, out=np.zeros(len(p)), where=length > 0).astype(np.float32)
    last = np.partition(cosine, -min(voters, len(p)), axis=1)[:, -min(voters, len(p))]
    weight = np.where(cosine >= np.maximum(last, np.float32(1e-6))[:, None], cosine, np.float32(0))
    total, ones = weight.sum(1, dtype=np.float64), (weight * labels).sum(1, dtype=np.float64)
    return np.divide(ones, total, out=np.full(len(z), prior), where=total > 0)


def score_by_neighbours(documents: DataFrame, labels: DataFrame, neighbours: int = NEIGHBOURS, dimensions: int = DIMENSIONS, voters: int = VOTERS, predict_from: float = PREDICT_FROM) -> DataFrame:
    """(doc_id, held_out, score, predicted) of every row; score is the voters' share for label 1, rounded to nine places.

    Null texts count as empty, and texts without a gram get the mean label of the labelled rows (0.5 where there are
    none); very long texts are counted whole, in segments; repeated rows get equal results, an empty table an empty
    result; other columns, whatever their names, take no part.
    """
    spark = documents.sparkSession
    docs = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    shared = spark.sparkContext.broadcast(fit(docs, labels, neighbours, dimensions))  # bounded by the parameters

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weighting, vectors, marks = shared.value
        for batch, x in blocks(batches):
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(np.round(votes(latent(x, weighting), vectors, marks, voters), 9))], names=["doc_id", "score"])

    scored = docs.mapInArrow(run, "doc_id long, score double")
    return scored.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= predict_from).cast("int").alias("predicted"))
