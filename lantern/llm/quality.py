"""Quality rules: base text rules, then a hashed n-gram log-likelihood ratio of trusted target against raw corpus.

Both multinomials live on `buckets` hash buckets of byte n-grams. The raw one counts every document; the target one
counts a bounded sample of trusted documents (label quality 1 and toxic 0: the `trusted_rows` smallest hashes of
doc_id, a documented parameter). A document's score is the mean over its n-grams of log(p_target / p_raw), so length
does not matter, and it is kept if the score reaches `threshold`, a constant: the verdict on a document depends on
nothing but its text and the two multinomials.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lantern.llm.words import chunks, joined, mixed

NGRAM, BUCKETS, TRUSTED_ROWS, THRESHOLD = 3, 1 << 16, 20_000, -0.35
SYMBOLS = b"#*$%&|<>"
MIN_WORDS, REPEAT_PERCENT = 50, 50
BASE_SCHEMA = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean"


def gram_buckets(data: np.ndarray, n: int, buckets: int) -> np.ndarray:
    """The bucket of the byte n-gram that starts at each position."""
    size = max(0, len(data) - n + 1)
    packed = np.zeros(size, np.uint64)
    for i in range(n):
        packed = (packed << np.uint64(8)) | data[i : i + size]
    return (mixed(packed) % np.uint64(buckets)).astype(np.int64)


def _texts_grams(texts: list[bytes], n: int, buckets: int) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of all n-grams inside the texts (none crosses two), and the row of each."""
    data, offsets = joined(texts, b"\n" * n)
    grams = gram_buckets(np.frombuffer(data, np.uint8), n, buckets)
    sizes = np.maximum(np.diff(offsets) - 2 * n + 1, 0)
    row = np.repeat(np.arange(len(texts)), sizes)
    return grams[np.arange(len(row)) - np.repeat(np.cumsum(sizes) - sizes, sizes) + offsets[row]], row


def gram_counts(documents: DataFrame, trusted: DataFrame, n: int = NGRAM, buckets: int = BUCKETS) -> DataFrame:
    """(bucket, raw, target): n-gram counts over all documents and over the trusted ones. At most `buckets` rows.

    Every task adds up its own rows first, so the shuffle holds a row for each bucket and task at most.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        raw, target = np.zeros(buckets, np.int64), np.zeros(buckets, np.int64)
        for batch, texts in chunks(batches):
            grams, row = _texts_grams(texts, n, buckets)
            raw += np.bincount(grams, minlength=buckets)
            chosen = np.array(batch.column(batch.schema.get_field_index("trusted")).to_pylist(), bool)
            target += np.bincount(grams[chosen[row]], minlength=buckets)
        at = np.flatnonzero(raw)
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int32()), pa.array(raw[at]), pa.array(target[at])], names=["bucket", "raw", "target"])

    flagged = documents.select("doc_id", "text").join(F.broadcast(trusted), "doc_id", "left").select("text", F.coalesce("trusted", F.lit(False)).alias("trusted"))
    return flagged.mapInArrow(run, "bucket int, raw long, target long").groupBy("bucket").agg(F.sum("raw").alias("raw"), F.sum("target").alias("target"))


def trusted_sample(labels: DataFrame, rows: int = TRUSTED_ROWS) -> DataFrame:
    """(doc_id, trusted=true) of at most `rows` trusted labels, those of the smallest hash of doc_id. Repeated labels count once."""
    good = labels.where("doc_id is not null and quality = 1 and coalesce(toxic, 0) = 0").select(F.col("doc_id").cast("long").alias("doc_id")).distinct()
    return good.orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows).withColumn("trusted", F.lit(True))


def log_ratio_table(counts: DataFrame, buckets: int = BUCKETS) -> np.ndarray:
    """log(p_target / p_raw) per bucket, both with one pseudo-count spread by the raw distribution; 0 everywhere without trusted text."""
    raw, target = np.zeros(buckets), np.zeros(buckets)
    for r in counts.collect():  # a row for each bucket at most
        raw[r.bucket], target[r.bucket] = r.raw, r.target
    if not target.sum():
        return np.zeros(buckets)
    p_raw = (raw + 1) / (raw.sum() + buckets)
    strength = buckets / 16
    return np.log((target + strength * p_raw) / (target.sum() + strength) / p_raw)


def base_rules(text: bytes) -> tuple[int, int, int, int, int, bool]:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words and base_failed of one text."""
    words = text.split()
    n = len(words)
    chars = sum(map(len, words))
    if not text.isascii():
        chars -= sum(len(w) - len(w.decode()) for w in words if not w.isascii())
    symbols = len(text) - len(text.translate(None, SYMBOLS))
    lines = [x for x in text.split(b"\n") if x.strip()]
    duplicates = len(lines) - len(set(lines))
    repeated = 0
    grams = list(zip(words, words[1:], words[2:]))
    if len(set(grams)) < len(grams):
        counts = Counter(grams)
        marks = bytearray(n)
        for i, g in enumerate(grams):
            if counts[g] > 1:
                marks[i : i + 3] = b"\1\1\1"
        repeated = sum(marks)
    return n, chars, symbols, duplicates, repeated, n < MIN_WORDS or 100 * repeated > REPEAT_PERCENT * n


def score_quality(documents: DataFrame, labels: DataFrame, ngram: int = NGRAM, buckets: int = BUCKETS, threshold: float = THRESHOLD, trusted_rows: int = TRUSTED_ROWS) -> DataFrame:
    """documents with the base figures, base_failed, llr (null without n-grams) and kept.

    Null text counts as empty (and fails the base rules); repeated rows get equal results; an empty table gives an
    empty result; columns of the same names as the figures are replaced, all others pass through.
    """
    figures = BASE_SCHEMA + ", llr double, kept boolean"
    names = [x.split()[0] for x in figures.split(", ")]
    ids = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    table = log_ratio_table(gram_counts(ids, trusted_sample(labels, trusted_rows), ngram, buckets), buckets)
    shared = documents.sparkSession.sparkContext.broadcast(table.astype(np.float32))  # `buckets` floats, whatever the input
    others = [f for f in documents.schema.fields if f.name not in names]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weights = shared.value
        for batch, texts in chunks(batches):
            base = [base_rules(t) for t in texts]
            grams, row = _texts_grams(texts, ngram, buckets)
            total = np.bincount(row, weights[grams], minlength=len(texts))
            n = np.bincount(row, minlength=len(texts))
            llr = np.divide(total, n, out=np.full(len(texts), np.nan), where=n > 0)
            failed = np.array([b[5] for b in base])
            columns = [pa.array(c, pa.int64()) for c in list(zip(*base))[:5]] + [pa.array(failed), pa.array(llr, mask=n == 0), pa.array(~failed & ~(llr < threshold))]
            yield pa.RecordBatch.from_arrays([batch.column(batch.schema.get_field_index(f.name)) for f in others] + columns, names=[f.name for f in others] + names)

    text_as_string = documents if dict(documents.dtypes)["text"] == "string" else documents.withColumn("text", F.col("text").cast("string"))
    schema = ", ".join(chain((f"`{f.name}` {f.dataType.simpleString() if f.name != 'text' else 'string'}" for f in others), [figures]))
    return text_as_string.select([f.name for f in others]).mapInArrow(run, schema)


def kept_documents(documents: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of documents that score_quality() keeps, with their own columns, also those named like a figure."""
    taken = {x.split()[0] for x in BASE_SCHEMA.split(", ")} | {"llr", "kept"}
    away = {c: f"own_{i}_{c}" for i, c in enumerate(documents.columns) if c.lower() in taken}
    scored = score_quality(documents.withColumnsRenamed(away), labels).where("kept")
    return scored.select(*(F.col(away.get(c, c)).alias(c) for c in documents.columns))
