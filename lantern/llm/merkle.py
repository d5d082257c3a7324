"""Merkle manifest of a table: a root over all rows, a proof for each row, and the check of a row against the root.

Leaves are digests of rows, ordered by doc_id within their source; every FANOUT consecutive nodes become their digest
until one is left, the source's subroot, and the subroots become the root likewise.

Ranks come from a range sort and the counts of its partitions, so no window holds a source. A tier cuts each tree into
aligned buckets of FANOUT ** LEVELS consecutive nodes; a task takes a slab of whole buckets as an Arrow table and runs
one DuckDB query a level over it, an ordered string_agg and its sha256. Each bucket's last node is a node of the next
tier: three tiers hold 387 million rows of a source, and only they are iterated. Outer paths are then joined to the
rows of each bucket, never more than FANOUT ** LEVELS of them a key, and proofs are hashed by Spark's own functions.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lantern.session import drop_written, written

FANOUT, LEVELS, SLAB = 3, 6, 8_192
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
PATH = "array<struct<before:string,after:string>>"
COLUMNS = ("tree", "pos", "size", "bucket", "digest", "doc_id", "changed", "path", "top")


def field(value: Column) -> Column:
    """`-` for null, else the UTF-8 byte count, a colon and the value, as binary."""
    raw = value.cast("string").cast("binary")
    return F.coalesce(F.concat(F.octet_length(raw).cast("string").cast("binary"), F.lit(":").cast("binary"), raw), F.lit("-").cast("binary"))


def leaf(columns: dict[str, Column]) -> Column:
    return F.sha2(F.concat(*(field(columns[c]) for c in FIELDS)), 256)


def tampered() -> Column:
    """Whether 2 divides crc32 of doc_id as decimal text; false for a null doc_id."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 2 == 0, F.lit(False))


def ranked(rows: DataFrame, group: str, order: list[str]) -> DataFrame:
    """rows, written, with `pos`, their place from 0 in their group by `order`, and `size`, the group's rows.

    A range sort is written with each partition's rows in order; a group's offset in a partition is the sum of its
    counts in the partitions before. A hot group is spread over many partitions like any other rows.
    """
    keys = [F.col(c).asc_nulls_first() for c in (group, *order)]
    kept = written(rows.repartitionByRange(*keys).sortWithinPartitions(*keys).withColumn("_at", F.monotonically_increasing_id()), "ordered").withColumn("_part", F.shiftright("_at", 33))
    counts = kept.groupBy(group, "_part").agg(F.count("*").alias("_n"), F.min("_at").alias("_first"))
    own = Window.partitionBy(group)
    before = F.coalesce(F.sum("_n").over(own.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    offsets = counts.select(F.col(group).alias("_group"), F.col("_part").alias("_of"), (before - F.col("_first")).alias("_offset"), F.sum("_n").over(own).alias("size"))
    found = kept.join(offsets, F.col(group).eqNullSafe(F.col("_group")) & (F.col("_part") == F.col("_of")))
    out = written(found.select(*rows.columns, (F.col("_at") + F.col("_offset")).alias("pos"), "size"), "ranked")
    drop_written(rows.sparkSession, kept)
    return out


def fold(slab: pa.Table, levels: int = LEVELS) -> pa.Table:
    """DuckDB's queries over whole buckets (tree, pos, size, bucket, digest, ...): the slab with each node's path in its bucket, and the bucket's last node as `top`.

    A level's query joins the digests of every FANOUT nodes in order and hashes them. Trees end where one node is left.
    """
    import duckdb

    with duckdb.connect(config={"threads": 1, "memory_limit": "400MB"}) as run:
        run.register("slab", slab)
        run.sql("CREATE TABLE node AS SELECT tree, bucket, pos AS spot, size AS width, digest FROM slab")
        run.sql("CREATE TABLE route AS SELECT *, pos AS spot, digest AS top, []::STRUCT(before VARCHAR, after VARCHAR)[] AS path FROM slab")
        for _ in range(levels):
            run.sql(
                f"CREATE OR REPLACE TABLE parent AS SELECT tree, bucket, spot // {FANOUT} AS spot, any_value(width) AS width, string_agg(digest, '' ORDER BY spot) AS run, sha256(string_agg(digest, '' ORDER BY spot)) AS digest "
                f"FROM node WHERE width > 1 GROUP BY tree, bucket, spot // {FANOUT}"
            )
            run.sql(
                f"CREATE OR REPLACE TABLE route AS SELECT r.* REPLACE (coalesce(p.spot, r.spot) AS spot, coalesce(p.digest, r.top) AS top, "
                f"CASE WHEN p.run IS NULL THEN path ELSE list_append(path, {{'before': substr(p.run, 1, 64 * (r.spot % {FANOUT})), 'after': substr(p.run, 64 * (r.spot % {FANOUT}) + 65)}}) END AS path) "
                f"FROM route r LEFT JOIN parent p ON r.tree = p.tree AND r.bucket = p.bucket AND r.spot // {FANOUT} = p.spot"
            )
            run.sql(f"CREATE OR REPLACE TABLE node AS SELECT tree, bucket, spot, (width + {FANOUT - 1}) // {FANOUT} AS width, digest FROM parent")
        return run.sql("SELECT * EXCLUDE spot FROM route ORDER BY tree, pos").to_arrow_table()


def slabs(batches: Iterator[pa.RecordBatch], levels: int = LEVELS) -> Iterator[pa.RecordBatch]:
    """fold() of the rows in slabs of whole buckets; rows of a bucket follow each other."""
    held: list[pa.Table] = []
    rows = 0

    def out(table: pa.Table) -> Iterator[pa.RecordBatch]:
        names = table["tree"].combine_chunks().dictionary_encode(null_encoding="encode")
        found = fold(table.set_column(table.schema.get_field_index("tree"), "tree", names.indices.cast(pa.int32())), levels)
        found = found.set_column(found.schema.get_field_index("tree"), "tree", names.dictionary.take(found["tree"].combine_chunks()))
        yield from found.select(COLUMNS).combine_chunks().to_batches()

    for batch in batches:
        held.append(pa.Table.from_batches([batch]))
        rows += batch.num_rows
        if rows >= SLAB:
            table = pa.concat_tables(held).combine_chunks()
            cut, tree, bucket = table.num_rows - 1, table["tree"], table["bucket"]
            while cut and (tree[cut - 1], bucket[cut - 1]) == (tree[-1], bucket[-1]):
                cut -= 1
            if cut:
                yield from out(table.slice(0, cut))
            held, rows = [table.slice(cut)], table.num_rows - cut
    if rows:
        yield from out(pa.concat_tables(held).combine_chunks())


def tier(nodes: DataFrame, levels: int) -> DataFrame:
    """nodes (tree, pos, size, digest, doc_id, changed) with their bucket, path in it, and the bucket's last node as `top`."""
    dealt = nodes.withColumn("bucket", F.floor(F.col("pos") / F.lit(FANOUT**levels)).cast("long")).repartition("tree", "bucket")
    return dealt.sortWithinPartitions("tree", "bucket", "pos").select(*COLUMNS[:-2]).mapInArrow(partial(slabs, levels=levels), f"tree string, pos long, size long, bucket long, digest string, doc_id long, changed string, path {PATH}, top string")


def climbed(nodes: DataFrame, widest: int, levels: int, name: str) -> tuple[list[DataFrame], DataFrame]:
    """The written tiers from the nodes up, and the last nodes (tree, top); `widest` is the number of nodes of the largest tree."""
    tiers, span = [], FANOUT**levels
    while True:
        tiers.append(written(tier(nodes, levels), f"{name}-{len(tiers)}"))
        tops = tiers[-1].groupBy("tree", "bucket").agg(F.max("top").alias("digest"), F.max("size").alias("size"))
        widest = -(-widest // span)
        if widest <= 1:
            return tiers, tops.select("tree", F.col("digest").alias("top"))
        nodes = tops.select("tree", F.col("bucket").alias("pos"), F.ceil(F.col("size") / F.lit(span)).cast("long").alias("size"), "digest", F.lit(None).cast("long").alias("doc_id"), F.lit(None).cast("string").alias("changed"))


def outward(tiers: list[DataFrame], above: DataFrame) -> DataFrame:
    """Rows of the lowest tier with their paths up to the root; above has a tree's path from its last node on, and columns of the tree.

    The highest tier has one bucket a tree; so no key here has more than FANOUT ** LEVELS rows.
    """
    more = [c for c in above.columns if c not in ("tree", "path")]
    outer = above.withColumn("pos", F.lit(0))
    for rows in reversed(tiers):
        outer = outer.select(F.col("tree").alias("_tree"), F.col("pos").alias("_pos"), F.col("path").alias("_path"), *more)
        outer = rows.join(outer, F.col("tree").eqNullSafe(F.col("_tree")) & (F.col("bucket") == F.col("_pos"))).select("tree", "pos", "digest", "doc_id", "changed", F.concat("path", "_path").alias("path"), *more)
    return outer


def folded(path: Column, digest: Column) -> Column:
    """The root that a leaf and its path give."""
    return F.aggregate(path, digest, lambda node, step: F.sha2(F.concat(step["before"], node, step["after"]).cast("binary"), 256))


def manifest(documents: DataFrame, levels: int = LEVELS) -> DataFrame:
    """(doc_id, leaf, subroot, root, proof_sha256, folded_root, verified) of every row of documents.

    Null fields count as `-`; rows with a null source form a source, and a null doc_id comes first in its own. Rows of
    one doc_id in a source go by their leaves, and equal rows are leaves of their own. An empty table gives an empty
    result. Texts are hashed whole, inside the JVM. Columns other than the five of a leaf take no part, whatever their
    names. Where 2 divides the crc32 of doc_id, the folded root is that of the text without its line ends.
    """
    spark = documents.sparkSession
    columns = {c: F.col(c) for c in FIELDS}
    text = F.col("text").cast("string")
    changed = F.when(tampered() & F.contains(text, F.lit("\n")), leaf(columns | {"text": F.replace(text, F.lit("\n"), F.lit(""))})).otherwise(leaf(columns))
    leaves = written(documents.select(F.col("source").cast("string").alias("tree"), F.col("doc_id").cast("long").alias("doc_id"), leaf(columns).alias("digest"), changed.alias("changed")), "leaves")
    placed = ranked(leaves, "tree", ["doc_id", "digest"])
    drop_written(spark, leaves)
    widest = placed.agg(F.max("size")).first()[0]
    if widest is None:
        return placed.selectExpr("doc_id", "digest leaf", "digest subroot", "digest root", "digest proof_sha256", "digest folded_root", "true verified")
    tiers, subroots = climbed(placed, widest, levels, "source")
    drop_written(spark, placed)
    sources = ranked(subroots.select(F.lit("").alias("tree"), F.col("tree").alias("changed"), F.col("top").alias("digest"), F.lit(None).cast("long").alias("doc_id")), "tree", ["changed"])
    tops, root = climbed(sources, sources.count(), levels, "root")
    end = spark.createDataFrame([("", [], root.first()["top"])], f"tree string, path {PATH}, root string")  # one row
    above = written(outward(tops, end).select(F.col("changed").alias("tree"), F.col("digest").alias("subroot"), "root", "path"), "above")
    found = outward(tiers, above)
    proof = F.sha2(F.array_join(F.transform("path", lambda s: F.concat(s["before"], s["after"])), "").cast("binary"), 256)
    out = found.select("doc_id", F.col("digest").alias("leaf"), "subroot", "root", proof.alias("proof_sha256"), folded(F.col("path"), F.col("changed")).alias("folded_root"))
    return out.withColumn("verified", F.col("folded_root") == F.col("root"))
