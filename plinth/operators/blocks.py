"""Block indexes as DataFrames: zone maps, bitmaps, offsets, and which blocks a filter has to read."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from plinth.functions.predicates import Exact, Range
from plinth.operators.positions import running_sum

#: Rows of a block, and codes that a bitmap of one whole number tells apart.
BLOCK, CODES = 250, 63


def with_blocks(df: DataFrame, position: str = "position", size: int = BLOCK) -> DataFrame:
    return df.withColumn("block_id", F.floor(F.col(position) / size).cast("long"))


def zone_map(df: DataFrame, *columns: str) -> DataFrame:
    """One row per block: block_id, and min_<column>, max_<column> of each column."""
    ends = [f(c).alias(f"{name}_{c}") for c in columns for name, f in (("min", F.min), ("max", F.max))]
    return df.groupBy("block_id").agg(*ends)


def bitmap(df: DataFrame, code: str) -> DataFrame:
    """One row per block: block_id and bits, with bit c set if code c occurs (I3, I4). Codes from 0 to CODES - 1; others are an error, nulls set no bit."""
    c = F.col(code).cast("int")
    bit = F.when(c.between(0, CODES - 1), F.call_function("shiftleft", F.lit(1).cast("long"), c)).when(c.isNotNull(), F.raise_error(F.concat(F.lit("no bit for code "), c.cast("string"))).cast("long"))
    return df.groupBy("block_id").agg(F.coalesce(F.bit_or(bit), F.lit(0).cast("long")).alias("bits"))


def check_zone(low: Column, high: Column, r: Range) -> tuple[Column, Column]:
    """(skippable, qualified) of a block: disjoint needs no read and fails, contained needs no read and passes, else read."""
    meets = F.coalesce((low <= r.high) & (high >= r.low), F.lit(False))
    inside = F.coalesce((low >= r.low) & (high <= r.high), F.lit(False))
    return ~meets | inside, meets


def check_bits(bits: Column, e: Exact) -> tuple[Column, Column]:
    """(skippable, qualified) of a block: an absent code fails, the only code passes, both without a read."""
    if not 0 <= int(e.value) < CODES:
        raise ValueError(f"no bit for code {e.value}")
    bit = F.lit(1 << int(e.value)).cast("long")
    there = bits.bitwiseAND(bit) != 0
    return ~there | (bits == bit), there


def qualified(index: DataFrame, filter: Range | Exact) -> DataFrame:
    """Blocks that may hold rows of the filter: block_id, skippable. index: a zone map of the range's column, or a bitmap."""
    if isinstance(filter, Range):
        skip, ok = check_zone(F.col(f"min_{filter.column}"), F.col(f"max_{filter.column}"), filter)
    else:
        skip, ok = check_bits(F.col("bits"), filter)
    return index.where(ok).select("block_id", skip.alias("skippable"))


def block_range(index: DataFrame, filter: Range) -> DataFrame:
    """One row, first_block and last_block that qualify on a sorted column; -1 and -1 if none does."""
    found = qualified(index, filter)
    return found.agg(F.coalesce(F.min("block_id"), F.lit(-1).cast("long")).alias("first_block"), F.coalesce(F.max("block_id"), F.lit(-1).cast("long")).alias("last_block"))


def filter_order(indexes: list[tuple[str, DataFrame, Range | Exact]]) -> DataFrame:
    """The filters by ascending number of qualified blocks: filter, blocks, rank from 1, ties by name (T5). One row per filter."""
    rows = None
    for name, index, f in indexes:
        n = qualified(index, f).agg(F.lit(name).alias("filter"), F.count(F.lit(1)).alias("blocks"))
        rows = n if rows is None else rows.union(n)
    ordered = F.array_sort(F.collect_list(F.struct("blocks", "filter")))
    return rows.agg(ordered.alias("all")).select(F.posexplode("all").alias("at", "f")).select("f.filter", "f.blocks", (F.col("at") + 1).cast("int").alias("rank"))


def offsets(entries: DataFrame, width: int) -> DataFrame:
    """Byte offset of each block in its encoded column: block_id, entries, byte_offset. entries: (block_id, entries)."""
    return running_sum(entries, "block_id", F.col("entries") * width, "byte_offset")
