"""LM scoring with a log-frequency Bloom filter.

1. The documents are written in blocks of about BLOCK_BYTES of text, one row a block.
2. Every block sends its distinct words and n-gram keys, with their counts in its training texts, to their hash segments.
   Held-out texts send keys too, counted 0 times: what is sent is at once what is counted and what is asked.
3. A segment's task adds the counts up, quantises them on a log scale, q = 1 + floor(log_b c), and sets the bits of the
   events (key, 1) .. (key, q) in its part of the filter. An event's bits lie in one 64-bit word (a register-blocked
   filter). The task then probes (key, 1), (key, 2), ... up to the first miss for every key it was asked for.
4. The answers, a packed byte a key, go back to their blocks, which score their texts with the probed counts only:
   P_1(w) = (c(w) + 0.1) / (N + 0.1 * (V + 1)), P_n(w|h) = (c(hw) + STRENGTH * P_(n-1)(w|h')) / (c(h) + STRENGTH).

The filter grows with the corpus, so no worker gets it whole: each part meets its questions in one task, which holds
SEGMENT_CHARS of text's worth of keys. The driver holds two sums. An n-gram lies in the segment of its own hash, not of
its history's, so a hot key is one entry a block and no segment grows with it.

The base score needs exact word counts: the segments send them back beside the probed ones.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lantern.llm.words import chunks, joined, mixed, prefix_hashes, span_hashes, word_spans
from lantern.session import written

QUANT_BASE = 1.3
HASHES, BITS_PER_EVENT = 5, 16
KEY_BITS = 40
SEGMENT_CHARS = 6_000_000
BLOCK_BYTES = 3 << 20
ORDER, STRENGTH = 2, 40.0
END = np.uint64(0x5BD1E9955BD1E995)


def quantise(counts: np.ndarray, base: float = QUANT_BASE) -> np.ndarray:
    return 1 + np.floor(np.log(counts) / math.log(base) + 1e-9).astype(np.int64)


def expected_counts(base: float = QUANT_BASE, most: int = 256) -> np.ndarray:
    """The count that stands for each quantised value: the middle of the whole numbers that share it; 0 for 0."""
    low = np.ceil(base ** np.arange(most) - 1e-9)
    high = np.maximum(low, np.ceil(base ** np.arange(1, most + 1) - 1e-9) - 1)
    return np.concatenate(([0.0], (low + high) / 2))


def event_hashes(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Offset and stride of each key's double hashing; event (key, level) has the terms from level * HASHES on."""
    return mixed(keys, 1), mixed(keys, 2) | np.uint64(1)


def bit_patterns(hashes: int = HASHES, many: int = 1 << 15) -> np.ndarray:
    """Words of `hashes` set bits each, one in every equal part of the word."""
    edge = np.arange(hashes + 1) * 64 // hashes
    out = np.zeros(many, np.uint64)
    for i, (low, high) in enumerate(zip(edge[:-1].tolist(), edge[1:].tolist(), strict=True)):
        out |= np.uint64(1) << (np.uint64(low) + mixed(np.arange(many, dtype=np.uint64), 31 + i) % np.uint64(high - low))
    return out


PATTERNS = bit_patterns()


def event_bits(offset: np.ndarray, stride: np.ndarray, level: int, n_words: int) -> tuple[np.ndarray, np.ndarray]:
    """The word among n_words < 2**32 that holds each key's event at the level, and its bits there."""
    with np.errstate(over="ignore"):
        h = offset + np.uint64(level) * stride
    return ((h >> np.uint64(32)) * np.uint64(n_words) >> np.uint64(32)).astype(np.int64), PATTERNS[(h & np.uint64(len(PATTERNS) - 1)).astype(np.int64)]


def build_segment(keys: np.ndarray, counts: np.ndarray, bits_per_event: int = BITS_PER_EVENT) -> np.ndarray:
    """The filter part of one segment as 64-bit words: all events of its keys, whose counts are 1 or more."""
    levels = quantise(counts)
    words = np.zeros(max(1, (int(levels.sum()) * bits_per_event + 63) // 64), np.uint64)
    offset, stride = event_hashes(keys)
    for level in range(1, int(levels.max(initial=0)) + 1):
        on = levels >= level
        offset, stride, levels = offset[on], stride[on], levels[on]
        np.bitwise_or.at(words, *event_bits(offset, stride, level, len(words)))
    return words


def probe(words: np.ndarray, keys: np.ndarray, most: int = 120) -> np.ndarray:
    """Quantised counts: how many events in a row each key has in the filter part."""
    level = np.zeros(len(keys), np.uint8)
    live = np.arange(len(keys))
    offset, stride = event_hashes(keys)
    for at_level in range(1, most):
        at, bits = event_bits(offset, stride, at_level, len(words))
        hit = words[at] & bits == bits
        if not hit.all():
            live, offset, stride = live[hit], offset[hit], stride[hit]
        if not len(live):
            break
        level[live] = at_level
    return level


def text_keys(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """(word key, row) of every token in order; each text's last token is END."""
    data, offsets = joined(texts)
    data = np.frombuffer(data.lower(), np.uint8)
    start, end = word_spans(data)
    row = np.searchsorted(offsets, start, side="right") - 1
    n = np.bincount(row, minlength=len(texts)) + 1
    last = np.cumsum(n) - 1
    keys = np.empty(int(n.sum()), np.uint64)
    is_end = np.zeros(len(keys), bool)
    is_end[last] = True
    keys[is_end] = END
    keys[~is_end] = span_hashes(prefix_hashes(data), start, end) if len(start) else keys[:0]
    return keys, np.repeat(np.arange(len(texts)), n)


def gram_keys(keys: np.ndarray, row: np.ndarray, order: int) -> list[np.ndarray]:
    """For each length 2 .. order, the key of the n-gram that ends at each token; END stands before a text's first token."""
    out, gram = [], keys
    for n in range(2, order + 1):
        before = np.full(len(keys), END)
        if n <= len(keys):
            before[n - 1 :] = np.where(row[n - 1 :] == row[: len(row) - n + 1], keys[: len(keys) - n + 1], END)
        with np.errstate(over="ignore"):
            gram = mixed(gram + before * np.uint64(0xC2B2AE3D27D4EB4F), 11 + n)
        out.append(gram)
    return out


def segment_of(keys: np.ndarray, segments: int) -> np.ndarray:
    """Segments are ranges of the keys, so sorted keys are sorted by segment."""
    return ((keys >> np.uint64(32)) * np.uint64(segments) >> np.uint64(32)).astype(np.int64)


def block_keys(texts: list[bytes], order: int) -> tuple[np.ndarray, ...]:
    """(row of each token, distinct words, index of each token's word, distinct n-grams, index of each n-gram), by length in turn."""
    keys, row = text_keys(texts)
    words, index = np.unique(keys, return_inverse=True)
    grams, gram_index = np.unique(np.concatenate([keys[:0], *gram_keys(keys, row, order)]), return_inverse=True)
    return row, words, index, grams, gram_index


def unpacked(sizes: pa.Scalar, blob: pa.Scalar) -> list[bytes]:
    """A block's texts."""
    ends = np.cumsum(sizes.as_py(), dtype=np.int64)
    body = pa.decompress(blob.as_py(), int(ends[-1]), "zstd", asbytes=True)
    return [body[a:b] for a, b in zip([0, *ends[:-1].tolist()], ends.tolist(), strict=True)]


def packed(values: np.ndarray) -> bytes:
    """Numbers as a cell: counts and levels are mostly small, so their bytes take a fraction."""
    return np.int64(values.nbytes).tobytes() + pa.compress(values.tobytes(), "zstd", asbytes=True)


def numbers(cell: bytes, kind: type) -> np.ndarray:
    """The numbers of a packed() cell."""
    return np.frombuffer(pa.decompress(cell[8:], int(np.frombuffer(cell[:8], np.int64)[0]), "zstd", asbytes=True), kind)


def in_blocks(docs: DataFrame, most: int = BLOCK_BYTES) -> DataFrame:
    """(block, doc_id, held_out, sizes, blob) of docs (doc_id, text, held_out): a row for about `most` bytes of text, one document at least."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first = TaskContext.get().partitionId() << 32
        ids, held, texts, size, n = [], [], [], 0, 0

        def row() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([first + n]), pa.array([ids], pa.list_(pa.int64())), pa.array([held], pa.list_(pa.bool_())), pa.array([list(map(len, texts))], pa.list_(pa.int64())), pa.array([pa.compress(b"".join(texts), "zstd", asbytes=True)], pa.binary())], names=["block", "doc_id", "held_out", "sizes", "blob"])

        for batch, some in chunks(batches, most=1 << 16):
            ids += batch.column(0).to_pylist()
            held += batch.column(2).to_pylist()
            texts += some
            size += sum(map(len, some)) + 8 * len(some)
            if size >= most:
                yield row()
                ids, held, texts, size, n = [], [], [], 0, n + 1
        if ids:
            yield row()

    return docs.select("doc_id", "text", "held_out").mapInArrow(run, "block long, doc_id array<long>, held_out array<boolean>, sizes array<long>, blob binary")


def asked_counts(blocks: DataFrame, segments: int, order: int) -> DataFrame:
    """(segment, block, words, word_counts, grams, gram_counts): each block's distinct keys in order as their bytes, and packed() counts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block, held, sizes, blob in zip(*(batch.column(batch.schema.get_field_index(c)) for c in ("block", "held_out", "sizes", "blob")), strict=True):
                row, words, index, grams, gram_index = block_keys(unpacked(sizes, blob), order)
                train = ~np.array(held.as_py(), bool)[row]
                counts = np.bincount(index[train], minlength=len(words)).astype(np.uint32)
                gram_counts = np.bincount(gram_index[np.tile(train, order - 1)], minlength=len(grams)).astype(np.uint32)
                five = grams.view(np.uint8).reshape(-1, 8)[:, : KEY_BITS // 8]
                cuts, gram_cuts = (np.searchsorted(segment_of(k, segments), np.arange(segments + 1)) for k in (words, grams))
                rows = []
                for at in np.flatnonzero(np.diff(cuts) + np.diff(gram_cuts)):
                    w, g = slice(cuts[at], cuts[at + 1]), slice(gram_cuts[at], gram_cuts[at + 1])
                    rows.append((int(at), block.as_py(), words[w].tobytes(), packed(counts[w]), five[g].tobytes(), packed(gram_counts[g])))
                kinds = (pa.int32(), pa.int64(), *[pa.binary()] * 4)
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), kinds, strict=True)], names=["segment", "block", "words", "word_counts", "grams", "gram_counts"])

    return blocks.select("block", "held_out", "sizes", "blob").mapInArrow(run, "segment int, block long, words binary, word_counts binary, grams binary, gram_counts binary")


def answered(asked: DataFrame) -> DataFrame:
    """(block, segment, exact, levels, gram_levels, n_tokens, n_words): each question's answers, packed(); a segment's sums are in a row without a block."""

    def added(table: pa.Table, keys: str, counts: str, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Distinct keys, their counts, each asked key's place among them, and where each block's begin."""
        cells = table.column(keys).to_pylist()
        raw = np.frombuffer(b"".join(cells), np.uint8).reshape(-1, width)
        wide = np.zeros((len(raw), 8), np.uint8)
        wide[:, :width] = raw
        distinct, index = np.unique(wide.reshape(-1).view("<u8"), return_inverse=True)
        weights = np.concatenate([numbers(c, np.uint32) for c in table.column(counts).to_pylist()])
        return distinct, np.bincount(index, weights, len(distinct)).astype(np.int64), index, np.concatenate(([0], np.cumsum([len(c) // width for c in cells])))

    def run(table: pa.Table) -> pa.Table:
        words, counts, index, cuts = added(table, "words", "word_counts", 8)
        grams, gram_counts, gram_index, gram_cuts = added(table, "grams", "gram_counts", KEY_BITS // 8)
        grams = mixed(grams, 5)
        bits = build_segment(np.concatenate((words[counts > 0], grams[gram_counts > 0])), np.concatenate((counts[counts > 0], gram_counts[gram_counts > 0])))
        exact, levels, gram_levels = counts[index], probe(bits, words)[index], probe(bits, grams)[gram_index]
        segment = table.column("segment")[0].as_py()
        rows = [(None, segment, None, None, None, int(counts.sum()), int((counts > 0).sum()))]
        for i, block in enumerate(table.column("block").to_pylist()):
            w, g = slice(cuts[i], cuts[i + 1]), slice(gram_cuts[i], gram_cuts[i + 1])
            rows.append((block, segment, packed(exact[w]), packed(levels[w]), packed(gram_levels[g]), 0, 0))
        kinds = (pa.int64(), pa.int32(), *[pa.binary()] * 3, pa.int64(), pa.int64())
        return pa.table([pa.array(c, t) for c, t in zip(zip(*rows), kinds, strict=True)], names=["block", "segment", "exact", "levels", "gram_levels", "n_tokens", "n_words"])

    return asked.groupBy("segment").applyInArrow(run, "block long, segment int, exact binary, levels binary, gram_levels binary, n_tokens long, n_words long")


def score_documents(documents: DataFrame, order: int = ORDER, strength: float = STRENGTH, segment_chars: int = SEGMENT_CHARS, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score) per row, learned from the rows not held out.

    Null text counts as empty (one end token); a null doc_id counts as held out; repeated rows count each time in
    training and get equal results; an empty table gives an empty result; without training rows N and V are 0. Other
    columns are ignored, whatever their names. Words are told apart by 64-bit hashes, n-grams by their segment and 40 bits.
    A task holds one block (a very long document is one) or one segment.
    """
    docs = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).withColumn("held_out", F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(0)) % 10 == 0)
    chars = docs.agg(F.sum(F.octet_length("text")).alias("n")).head()["n"] or 0
    segments = max(1, -(-chars // segment_chars))
    blocks = written(in_blocks(docs, block_bytes), "blocks")
    answers = written(answered(asked_counts(blocks, segments, order)), "answers")
    sums = answers.where("block is null").agg(F.sum("n_tokens"), F.sum("n_words")).head()
    total, distinct = sums[0] or 0, sums[1] or 0
    scale = 1 / (total + 0.1 * (distinct + 1)) if total else 10.0
    middle = expected_counts()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for ids, held, sizes, blob, parts in zip(*(batch.column(batch.schema.get_field_index(c)) for c in ("doc_id", "held_out", "sizes", "blob", "parts")), strict=True):
                row, words, index, grams, gram_index = block_keys(unpacked(sizes, blob), order)
                parts = sorted(parts.as_py(), key=lambda p: p["segment"])
                exact = np.concatenate([numbers(p["exact"], np.int64) for p in parts])
                count = middle[np.concatenate([numbers(p["levels"], np.uint8) for p in parts])]
                gram_count = middle[np.concatenate([numbers(p["gram_levels"], np.uint8) for p in parts])][gram_index].reshape(order - 1, -1)
                starts = np.flatnonzero(np.diff(row, prepend=-1))
                context = count[index]
                p = (context + 0.1) * scale
                ends = count[np.searchsorted(words, END)]
                for own in gram_count:
                    before = np.concatenate(([ends], context[:-1]))  # the count of the n-gram's history
                    before[starts] = ends
                    p = (np.minimum(own, before) + strength * p) / (before + strength)
                    context = own
                n = len(ids)
                sums = (np.bincount(row, minlength=n), np.bincount(row, (exact > 0)[index], n).astype(np.int64), np.bincount(row, np.log10((exact + 0.1) * scale)[index], n), np.bincount(row, np.log10(p), n))
                yield pa.RecordBatch.from_arrays([ids.values, held.values, *map(pa.array, sums)], names=["doc_id", "held_out", "n_tokens", "n_known", "base_score", "score"])

    parts = answers.where("block is not null").groupBy("block").agg(F.collect_list(F.struct("segment", "exact", "levels", "gram_levels")).alias("parts"))
    scored = blocks.join(parts, "block").mapInArrow(run, "doc_id long, held_out boolean, n_tokens long, n_known long, base_score double, score double")
    return scored.select("doc_id", "held_out", "n_tokens", "n_known", F.lit(total).cast("long").alias("train_tokens"), "base_score", "score")
