"""Connected components of an edge table by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lantern.session import drop_written, written


def _mark(edges: DataFrame) -> tuple:
    r = edges.agg(F.count("*").alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")).alias("h")).head()
    return r["n"], r["h"]


def connected_components(edges: DataFrame) -> DataFrame:
    """(node, root) for every node of the undirected edges (a long, b long); root is the component's smallest node.

    Each round keeps components and shortens paths, so a few rounds suffice: large stars link every node's larger
    neighbours to its smallest one, small stars link its smaller ones. The smallest neighbours are tables of their own,
    one row a node, so Spark can split the join of a node with very many edges. Nothing but a count and a checksum of
    the edges comes to the driver; each round's edges are a written table.
    """
    spark = edges.sparkSession
    now = written(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges")
    mark = _mark(now)
    while mark[0]:
        both = now.unionByName(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = written(both.groupBy("a").agg(F.least("a", F.min("b")).alias("m")), "least")
        large = written(both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct(), "large")
        least_small = written(large.groupBy("a").agg(F.min("b").alias("m")), "least")
        joined = large.join(least_small, "a")
        small = joined.select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(least_small.select("a", F.col("m").alias("b")))
        after = written(small.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges")
        for old in (now, least, large, least_small):
            drop_written(spark, old)
        now, before, mark = after, mark, _mark(after)
        if before == mark:
            break
    return now.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(now.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())
