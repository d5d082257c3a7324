"""Running sums, ranks and neighbours along one order, by a prefix scan in two passes.

Rows are range-sorted and written; each partition's figures are carried to the ones behind it, so a window holds what one
group has in one partition, never a whole group. A day, a key or a table without keys may hold any share of the rows.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lantern.session import written


def scanned(
    rows: DataFrame,
    group: list[str],
    order: list[Column],
    sums: dict[str, Column] | None = None,
    latest: dict[str, Column] | None = None,
    before: dict[str, Column] | None = None,
    behind: dict[str, Column] | None = None,
) -> DataFrame:
    """rows, in their groups by `order`, with pos (from 0) and size, and for each name in

    sums: the running sum up to and with the row, nulls as 0; latest: the last value up to and with the row that isn't null;
    before and behind: the value of the row before or behind it, null at the ends. Nulls in group columns are a group.
    Rows that are equal in `order` follow each other in any way: end the order with a key where that matters.
    """
    sums, latest, before, behind = (x or {} for x in (sums, latest, before, behind))
    names = [f"_scan_g{i}" for i in range(len(group))]
    wanted = {f"_scan_s_{n}": F.coalesce(c, F.lit(0)) for n, c in sums.items()} | {f"_scan_l_{n}": c for n, c in latest.items()} | {f"_scan_b_{n}": c for n, c in before.items()} | {f"_scan_h_{n}": c for n, c in behind.items()}
    keyed = rows.select("*", *(F.col(c).alias(g) for c, g in zip(group, names)), *(c.alias(n) for n, c in wanted.items()))
    keys = [*(F.col(g).asc_nulls_first() for g in names), *order]
    kept = written(keyed.repartitionByRange(*keys).sortWithinPartitions(*keys).withColumn("_scan_at", F.monotonically_increasing_id()), "ordered").withColumn("_scan_part", F.shiftright("_scan_at", 33))
    by_row = F.col("_scan_at")
    figures = [F.count("*").alias("_scan_n")]
    figures += [F.sum(f"_scan_s_{n}").alias(f"_scan_cs_{n}") for n in sums]
    figures += [F.max_by(f"_scan_l_{n}", F.when(F.col(f"_scan_l_{n}").isNotNull(), by_row)).alias(f"_scan_cl_{n}") for n in latest]
    figures += [F.max_by(f"_scan_b_{n}", by_row).alias(f"_scan_cb_{n}") for n in before] + [F.min_by(f"_scan_h_{n}", by_row).alias(f"_scan_ch_{n}") for n in behind]
    parts = kept.groupBy(*names, "_scan_part").agg(*figures)
    own = Window.partitionBy(*names)  # a row for each partition that the group is in
    past = own.orderBy("_scan_part").rowsBetween(Window.unboundedPreceding, -1)
    carried = [F.coalesce(F.sum("_scan_n").over(past), F.lit(0)).alias("_scan_cn"), F.sum("_scan_n").over(own).alias("_scan_size")]
    carried += [F.coalesce(F.sum(f"_scan_cs_{n}").over(past), F.lit(0)).alias(f"_scan_cs_{n}") for n in sums]
    carried += [F.last(f"_scan_cl_{n}", ignorenulls=True).over(past).alias(f"_scan_cl_{n}") for n in latest]
    carried += [F.lag(f"_scan_cb_{n}").over(own.orderBy("_scan_part")).alias(f"_scan_cb_{n}") for n in before]
    carried += [F.lead(f"_scan_ch_{n}").over(own.orderBy("_scan_part")).alias(f"_scan_ch_{n}") for n in behind]
    carry = parts.select(*(F.col(g).alias(f"_of{g}") for g in names), F.col("_scan_part").alias("_scan_cpart"), *carried)
    here = reduce(lambda a, b: a & b, [F.col(g).eqNullSafe(F.col(f"_of{g}")) for g in names] + [F.col("_scan_part") == F.col("_scan_cpart")])
    inside = Window.partitionBy(*names, "_scan_part").orderBy("_scan_at")
    so_far = inside.rowsBetween(Window.unboundedPreceding, 0)
    out = [(F.col("_scan_cn") + F.row_number().over(inside) - 1).cast("long").alias("pos"), F.col("_scan_size").alias("size")]
    out += [(F.col(f"_scan_cs_{n}") + F.sum(f"_scan_s_{n}").over(so_far)).alias(n) for n in sums]
    out += [F.coalesce(F.last(f"_scan_l_{n}", ignorenulls=True).over(so_far), f"_scan_cl_{n}").alias(n) for n in latest]
    first, last = F.row_number().over(inside) == 1, F.lead("_scan_at").over(inside).isNull()
    out += [F.when(first, F.col(f"_scan_cb_{n}")).otherwise(F.lag(f"_scan_b_{n}").over(inside)).alias(n) for n in before]
    out += [F.when(last, F.col(f"_scan_ch_{n}")).otherwise(F.lead(f"_scan_h_{n}").over(inside)).alias(n) for n in behind]
    return kept.join(carry, here).select(*rows.columns, *out)
