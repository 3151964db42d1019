"""Row positions and running sums that no single task has to compute.

A global row number over one window would send all rows to one task, and one window per coarse key all rows of a hot key. Here rows
are dealt by range over all columns of the order and sorted inside their range; the ranges are counted, and a row's place is
its place in its range plus the rows of all ranges before. A hot date spreads over as many ranges as its rows ask for.
"""

from __future__ import annotations

import json
from itertools import accumulate

from pyspark.sql import Column, DataFrame, Window, functions as F

from plinth.sources.scratch import settle

#: Keys of one group of the two-level running sum.
GROUP = 4096
#: Bits of monotonically_increasing_id that count rows of one partition; those above tell the partition.
ROW_BITS = 33


def with_positions(df: DataFrame, order: list[str], name: str = "position", ranges: int | None = None) -> DataFrame:
    """df with the place of each row (from 0) in the order by these columns, nulls first.

    Together the columns should be unique: the order of equal rows is open, and equal rows share a range. The sorted rows are
    written once, which fixes their ranges; what reaches the driver is one count per range (spark.sql.shuffle.partitions
    of them, unless `ranges` says otherwise).
    """
    n = ranges or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    by = [F.col(c).asc_nulls_first() for c in order]
    sorted_rows = settle(df.repartitionByRange(n, *by).sortWithinPartitions(*by).withColumn("_at", F.monotonically_increasing_id()), "sorted")
    part = F.shiftright("_at", ROW_BITS)
    counts = {r.part: r.n for r in sorted_rows.groupBy(part.alias("part")).agg(F.count(F.lit(1)).alias("n")).collect()}
    before = [0, *accumulate(counts.get(i, 0) for i in range(max(counts, default=0)))]
    starts = F.from_json(F.lit(json.dumps(before)), "array<bigint>")  # a constant, folded once
    place = F.element_at(starts, (part + 1).cast("int")) + F.col("_at").bitwiseAND(F.lit((1 << ROW_BITS) - 1))
    return sorted_rows.withColumn(name, place).drop("_at")


def running_sum(df: DataFrame, key: str, value: Column, name: str) -> DataFrame:
    """df (one row per key, a whole number) with the sum of value over all smaller keys, in two levels."""
    grouped = df.withColumn("_group", F.floor(F.col(key) / GROUP)).withColumn("_value", value)
    sums = grouped.groupBy("_group").agg(F.sum("_value").alias("_sum"))
    sums = sums.select(F.col("_group").alias("_g"), F.coalesce(F.sum("_sum").over(Window.orderBy("_group").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_base"))
    inner = F.coalesce(F.sum("_value").over(Window.partitionBy("_group").orderBy(key).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return grouped.withColumn("_inner", inner).join(sums, F.col("_group") == F.col("_g")).withColumn(name, F.col("_base") + F.col("_inner")).drop("_group", "_g", "_value", "_base", "_inner")
