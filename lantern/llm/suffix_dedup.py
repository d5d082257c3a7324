"""Suffix-array dedup by prefix-free parsing, to the depth that repeats of `length` bytes need.

Parsing: the trigger of a 100-byte window is its k-gram of least rolling hash (the leftmost one), so equal windows have
equal triggers wherever they stand. The windows that share one trigger make a phrase: their start positions are
consecutive, and the phrase's text is what they cover, at most 2 * length - k bytes. Phrases overlap by less than a
window, no phrase text is a prefix of another with the same trigger offset and length, and the text's phrases in order
are its parse.

Dictionary: occurrences with equal (trigger, text) are one dictionary entry. All but the earliest occurrence (document,
position) are repeats as a whole: their windows all start earlier too. An entry whose trigger k-gram has no second entry
holds no other repeats. What is left, entries that share a trigger but differ, goes to the suffix sort.

Suffix order: the window suffixes of those entries are sorted by their first `length` bytes inside the bucket of their
trigger (equal windows are always in one bucket); the parse breaks ties by (document, position). Neighbours in that
order with a common prefix of `length` bytes are one repeated string; all but its first occurrence are removed. Triggers
with very many entries would make one bucket large: their windows are dealt out one by one by a 128-bit digest instead.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lantern.llm.words import BASE_INVERSE, binary_column, joined, mixed, powers, prefix_hashes, span_hashes
from lantern.session import written

LENGTH, KGRAM = 100, 32
PIECE, FLUSH = 1 << 20, 8 << 20
BUCKET_BYTES = 16 << 20
GROUP = 4_000
LOCAL_HOT, HOT = 16, 2_000
PHRASES, RANGES, OPEN = 0, 1, 2


def parse(data: np.ndarray, ends: np.ndarray, length: int = LENGTH, kgram: int = KGRAM) -> tuple[np.ndarray, ...]:
    """Phrases of the concatenated pieces: first window, number of windows, trigger hash, text hash.

    ends: for each byte the end of its piece; windows do not cross it.
    """
    width = length - kgram + 1
    n = len(data) - length + 1
    if n <= 0:
        none = np.zeros(0, np.int64)
        return none, none, none.astype(np.uint64), none.astype(np.uint64)
    prefix = prefix_hashes(data)
    grams = len(data) - kgram + 1
    with np.errstate(over="ignore"):
        rolling = mixed((prefix[kgram:] - prefix[:-kgram]) * powers(grams, BASE_INVERSE)[:grams])
    least = (rolling >> np.uint64(32) << np.uint64(32)) | np.arange(grams, dtype=np.uint64)
    step = 1
    while 2 * step <= width:
        least = np.minimum(least[:-step], least[step:])
        step *= 2
    if step < width:
        least = np.minimum(least[:n], least[width - step : width - step + n])
    at = np.flatnonzero(np.arange(n) + length <= ends[:n])
    if not len(at):
        none = np.zeros(0, np.int64)
        return none, none, none.astype(np.uint64), none.astype(np.uint64)
    trigger = (least[at] & np.uint64(0xFFFFFFFF)).astype(np.int64)
    cut = np.flatnonzero(np.concatenate(([True], (trigger[1:] != trigger[:-1]) | (at[1:] != at[:-1] + 1))))
    first, trigger = at[cut], trigger[cut]
    count = np.diff(np.concatenate((cut, [len(at)])))
    text = mixed(span_hashes(prefix, first, first + count + length - 1) + (trigger - first).astype(np.uint64), 5)
    return first, count, rolling[trigger], text


def merged(order: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The maximal covered ranges of each document, in order."""
    by = np.lexsort((start, order))
    order, start, end = order[by], start[by], end[by]
    if not len(order):
        return order, start, end
    run = np.concatenate(([0], np.cumsum(order[1:] != order[:-1])))
    reach = np.maximum.accumulate(end + run * (int(end.max()) + 1)) - run * (int(end.max()) + 1)
    new = np.concatenate(([True], (order[1:] != order[:-1]) | (start[1:] > reach[:-1])))
    cut = np.flatnonzero(new)
    return order[cut], start[cut], reach[np.concatenate((cut[1:], [len(order)])) - 1]


def _pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[list[tuple[int, int, bytes]]]:
    """Lists of (ord, offset, bytes) of about FLUSH bytes, in order of (ord, offset); long texts come in overlapping pieces."""
    held: list[tuple[int, int, bytes]] = []
    size = 0
    for batch in batches:
        texts = binary_column(batch.column(1))
        for order, text in zip(batch.column(0).to_pylist(), texts, strict=True):
            body = text.as_py()
            for at in range(0, max(1, len(body) - LENGTH + 1), PIECE):
                held.append((order, at, body[at : at + PIECE + LENGTH - 1]))
                size += len(held[-1][2])
                if size >= FLUSH:
                    yield sorted(held, key=lambda x: x[:2])
                    held, size = [], 0
    if held:
        yield sorted(held, key=lambda x: x[:2])


def _parse_pieces(pieces: list[tuple[int, int, bytes]]) -> tuple[np.ndarray, ...]:
    """ord, position, windows, trigger, text of all phrases in order."""
    found: list[tuple[np.ndarray, ...]] = []
    at = 0
    while at < len(pieces):
        end, size = at, 0
        while end < len(pieces) and (end == at or size + len(pieces[end][2]) <= PIECE):
            size += len(pieces[end][2])
            end += 1
        part = pieces[at:end]
        data, offsets = joined([p[2] for p in part])
        piece_of = np.repeat(np.arange(len(part)), np.diff(offsets))
        first, count, trigger, text = parse(np.frombuffer(data, np.uint8), offsets[1:][piece_of] - 1)
        own = piece_of[first]
        found.append((np.array([p[0] for p in part])[own], first - offsets[own] + np.array([p[1] for p in part])[own], count, trigger, text))
        at = end
    return tuple(np.concatenate(c) for c in zip(*found, strict=True))


def phrase_blobs(documents: DataFrame, buckets: int) -> DataFrame:
    """(bucket, kind, a .. e): packed phrases by trigger bucket, and what a task could decide alone (ranges, open phrases)."""
    names = ["bucket", "kind", "a", "b", "c", "d", "e"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for pieces in _pieces(batches):
            order, position, count, trigger, text = _parse_pieces(pieces)
            rows: list[tuple] = []
            if len(order):
                by = np.lexsort((text, trigger))  # stable: equal phrases stay in corpus order
                order, position, count, trigger, text = (x[by] for x in (order, position, count, trigger, text))
                new_trigger = np.concatenate(([True], trigger[1:] != trigger[:-1]))
                first = new_trigger | np.concatenate(([True], text[1:] != text[:-1]))
                group = np.cumsum(new_trigger) - 1
                hot = (np.bincount(group[first]) > LOCAL_HOT)[group]
                gone = merged(order[~first], position[~first], (position + count + LENGTH - 1)[~first])
                home = int(pieces[0][0]) % buckets
                if len(gone[0]):
                    rows.append((home, RANGES, *(x.astype(np.int64).tobytes() for x in gone), None, None))
                if (now := first & hot).any():
                    rows.append((home, OPEN, *(x[now].astype(np.int64).tobytes() for x in (order, position, count)), trigger[now].tobytes(), None))
                kept = first & (~hot | new_trigger)
                order, position, trigger, text = (x[kept] for x in (order, position, trigger, text))
                count = np.where(hot, 0, count)[kept]  # 0 windows: a mark that the trigger has very many entries
                bucket = (trigger % np.uint64(buckets)).astype(np.int64)
                by = np.argsort(bucket, kind="stable")
                cuts = np.searchsorted(bucket[by], np.arange(buckets + 1))
                for b in np.flatnonzero(np.diff(cuts)):
                    x = by[cuts[b] : cuts[b + 1]]
                    rows.append((int(b), PHRASES, order[x].astype(np.int64).tobytes(), position[x].astype(np.int64).tobytes(), count[x].astype(np.uint8).tobytes(), trigger[x].tobytes(), text[x].tobytes()))
            kinds = (pa.int32(), pa.int32(), *[pa.binary()] * 5)
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(list(zip(*rows)) or [()] * 7, kinds, strict=True)], names=names)

    return documents.mapInArrow(run, "bucket int, kind int, a binary, b binary, c binary, d binary, e binary")


def _column(table: pa.Table, name: str, kind: str) -> np.ndarray:
    return np.concatenate([np.frombuffer(x, kind) for x in table.column(name).to_pylist()] or [np.zeros(0, kind)])


def _output(ranges: tuple[np.ndarray, ...], opened: tuple[np.ndarray, ...]) -> pa.Table:
    """Rows (kind, ord, start, n, trigger, hot): a range of n bytes, or an open phrase of n windows."""
    r, q = len(ranges[0]), len(opened[0])
    return pa.table(
        {
            "kind": pa.array(np.repeat(np.array([RANGES, OPEN], np.int32), [r, q])),
            "ord": np.concatenate((ranges[0], opened[0])).astype(np.int64),
            "start": np.concatenate((ranges[1], opened[1])).astype(np.int64),
            "n": np.concatenate((ranges[2] - ranges[1], opened[2])).astype(np.int64),
            "trigger": np.concatenate((np.zeros(r, np.int64), opened[3].view(np.int64))),
            "hot": np.concatenate((np.zeros(r, bool), opened[4])),
        }
    )


def dictionary_step(table: pa.Table) -> pa.Table:
    """One bucket: whole repeats as ranges, entries that share a trigger as open phrases."""
    kinds = np.array(table.column("kind").to_pylist())
    own = table.filter(pa.array(kinds == PHRASES))
    order, position = _column(own, "a", "<i8"), _column(own, "b", "<i8")
    count, trigger, text = _column(own, "c", "u1").astype(np.int64), _column(own, "d", "<u8"), _column(own, "e", "<u8")
    by = np.lexsort((position, order, text, trigger))
    order, position, count, trigger, text = (x[by] for x in (order, position, count, trigger, text))
    new_trigger = np.concatenate(([True], trigger[1:] != trigger[:-1]))[: len(trigger)]
    first = new_trigger | np.concatenate(([True], text[1:] != text[:-1]))[: len(text)]
    marked = count == 0
    group = np.cumsum(new_trigger) - 1
    entries = np.bincount(group[first & ~marked], minlength=int(group[-1]) + 1 if len(group) else 0)
    mark = np.bincount(group[marked], minlength=len(entries)) > 0
    open_now = first & ~marked & ((entries > 1) | mark)[group]
    hot = ((entries > HOT) | mark)[group]
    again = ~first & ~marked
    passed = table.filter(pa.array(kinds == RANGES))
    ranges = [_column(passed, c, "<i8") for c in "abc"]
    ranges = merged(np.concatenate((ranges[0], order[again])), np.concatenate((ranges[1], position[again])), np.concatenate((ranges[2], (position + count + LENGTH - 1)[again])))
    passed = table.filter(pa.array(kinds == OPEN))
    ready = [_column(passed, c, t) for c, t in zip("abcd", ("<i8", "<i8", "<i8", "<u8"), strict=True)]
    opened = (*(np.concatenate((x, y[open_now])) for x, y in zip(ready, (order, position, count, trigger), strict=True)), np.concatenate((np.ones(len(ready[0]), bool), hot[open_now])))
    return _output(ranges, opened)


def open_texts(joined_rows: DataFrame, groups: int) -> DataFrame:
    """(bucket, hot, ord, start, text): the open phrases' texts by trigger, or for hot triggers one digest per window."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = binary_column(batch.column(1))
            rows: list[tuple] = []
            for order, text, phrases in zip(batch.column(0).to_pylist(), texts, batch.column(2).to_pylist(), strict=True):
                body = text.as_py()
                for p in phrases:
                    at, n = p["start"], p["n"]
                    if not p["hot"]:
                        rows.append((p["trigger"] % groups, False, order, at, body[at : at + n + LENGTH - 1]))
                        continue
                    for i in range(at, at + n):
                        digest = hashlib.blake2b(body[i : i + LENGTH], digest_size=16).digest()
                        rows.append((int.from_bytes(digest[:7], "big") % groups, True, order, i, digest))
            kinds = (pa.int32(), pa.bool_(), pa.int64(), pa.int64(), pa.binary())
            for i in range(0, max(1, len(rows)), 20_000):
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(list(zip(*rows[i : i + 20_000])) or [()] * 5, kinds, strict=True)], names=["bucket", "hot", "ord", "start", "text"])

    return joined_rows.mapInArrow(run, "bucket int, hot boolean, ord long, start long, text binary")


def suffix_order(data: np.ndarray, at: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """The suffixes at the positions `at`, sorted by their first `length` bytes (ties as given), and where a new string begins."""
    heads = np.lib.stride_tricks.sliding_window_view(data, length)[at].copy().view(f"S{length}").ravel()
    by = np.argsort(heads, kind="stable")
    heads = heads[by]
    return by, np.concatenate(([True], heads[1:] != heads[:-1]))


def suffix_step(table: pa.Table) -> pa.Table:
    """One bucket of open phrases: sort their window suffixes; all but each string's first occurrence become ranges."""
    out = []
    for hot in (False, True):
        own = table.filter(pa.array(np.array(table.column("hot").to_pylist()) == hot))
        if not own.num_rows:
            continue
        order, start = own.column("ord").to_numpy(), own.column("start").to_numpy()
        by = np.lexsort((start, order))
        order, start = order[by], start[by]
        texts = own.column("text").to_pylist()
        texts = [texts[i] for i in by]
        length = 16 if hot else LENGTH
        sizes = np.array([len(t) for t in texts])
        n = sizes - length + 1
        offsets = np.cumsum(sizes) - sizes
        inner = np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n)
        ranked, new = suffix_order(np.frombuffer(b"".join(texts), np.uint8), np.repeat(offsets, n) + inner, length)
        again = np.sort(ranked[~new])
        out.append((np.repeat(order, n)[again], (np.repeat(start, n) + inner)[again]))
    none = np.zeros(0, np.int64)
    order, start = (np.concatenate(c) for c in zip(*out, strict=True)) if out else (none, none)
    return _output(merged(order, start, start + LENGTH), (none, none, none, none.astype(np.uint64), none.astype(bool)))


SCHEMA = "kind int, ord long, start long, n long, trigger long, hot boolean"


def repeated_ranges(documents: DataFrame, total_bytes: int) -> DataFrame:
    """(ord, start, n) of removed bytes for documents (ord long, distinct and not null; text)."""
    buckets = max(1, -(-total_bytes // BUCKET_BYTES))
    decided = written(phrase_blobs(documents, buckets).groupBy("bucket").applyInArrow(dictionary_step, SCHEMA), "phrases")
    opened = decided.where(F.col("kind") == OPEN)
    groups = max(1, -(-opened.count() // GROUP))
    phrases = opened.groupBy("ord").agg(F.collect_list(F.struct("start", "n", "trigger", "hot")).alias("phrases"))
    texts = open_texts(documents.join(phrases, "ord").select("ord", "text", "phrases"), groups)
    sorted_out = written(texts.groupBy("bucket").applyInArrow(suffix_step, SCHEMA), "suffixes")
    return decided.where(F.col("kind") == RANGES).unionByName(sorted_out).select("ord", "start", "n")


def dedup_suffixes(documents: DataFrame) -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept_sha256, kept) per row; kept is the remaining text as binary.

    Null text counts as empty. A null doc_id is smaller than any other; rows of one doc_id with different texts are
    different documents in a fixed order; repeated rows (same doc_id and text) are one document and get equal results.
    """
    spark = documents.sparkSession
    docs = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    facts = docs.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0)).alias("bytes"), F.count("*").alias("n"), F.count("doc_id").alias("known"), F.count_distinct("doc_id").alias("ids")).head()
    clean = facts["n"] == facts["known"] == facts["ids"]
    if clean:
        core = docs.withColumnRenamed("doc_id", "ord")
    else:
        keys = docs.select("doc_id", F.xxhash64("text").alias("place")).distinct().orderBy(F.col("doc_id").asc_nulls_first(), "place")
        ranked = written(spark.createDataFrame(keys.rdd.zipWithIndex().map(lambda x: (*x[0], x[1])), "doc_id long, place long, ord long"), "order")
        docs = docs.withColumn("place", F.xxhash64("text")).alias("d").join(ranked.alias("r"), F.col("d.doc_id").eqNullSafe(F.col("r.doc_id")) & (F.col("d.place") == F.col("r.place"))).select("d.doc_id", "d.text", "r.ord")
        core = written(docs.dropDuplicates(["ord"]).select("ord", "text"), "distinct")
    ranges = repeated_ranges(core, int(facts["bytes"]))
    cuts = ranges.groupBy("ord").agg(F.collect_list(F.struct("start", "n")).alias("cuts"))
    whole = docs.withColumn("ord", F.col("doc_id")) if clean else docs
    schema = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept binary"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for text, found in zip(binary_column(batch.column(1)), batch.column(2).to_pylist(), strict=True):
                body = text.as_py()
                start = np.array([c["start"] for c in found or ()], np.int64)
                end = start + np.array([c["n"] for c in found or ()], np.int64)
                _, start, end = merged(np.zeros(len(start), np.int64), start, end)
                pieces, at = [], 0
                for a, b in zip(start.tolist(), end.tolist(), strict=True):
                    pieces.append(body[at:a])
                    at = b
                kept = b"".join([*pieces, body[at:]])
                rows.append((len(body), len(body) - len(kept), len(start), hashlib.sha256(kept).hexdigest(), kept))
            kinds = (pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.binary())
            made = [pa.array(c, t) for c, t in zip(list(zip(*rows)) or [()] * 5, kinds, strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), *made], names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept"])

    return whole.join(cuts, "ord", "left").select("doc_id", "text", "cuts").mapInArrow(run, schema)
