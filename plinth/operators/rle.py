"""Run-length coding inside blocks.

Runs are islands of equal neighbours; they end with their block, and after `cap` rows. The window of a block holds its rows
only, so every block decodes by itself.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

#: Longest run of a one-byte column.
CAP = 128


def encode(df: DataFrame, value: str, position: str = "position", cap: int | None = None) -> DataFrame:
    """Runs of df (block_id, position, value): block_id, start, run_length, value. Equal nulls form runs too."""
    by = Window.partitionBy("block_id").orderBy(position)
    rows = df.select("block_id", F.col(position).alias("_at"), F.col(value).alias("value"), F.lag(value).over(by).alias("_last"), F.row_number().over(by).alias("_n"))
    new = (F.col("_n") == 1) | ~F.col("value").eqNullSafe(F.col("_last"))
    runs = rows.withColumn("_run", F.sum(new.cast("int")).over(Window.partitionBy("block_id").orderBy("_at")))
    if cap:
        runs = runs.withColumn("_part", F.floor((F.col("_at") - F.min("_at").over(Window.partitionBy("block_id", "_run"))) / cap))
    else:
        runs = runs.withColumn("_part", F.lit(0))
    return runs.groupBy("block_id", "_run", "_part").agg(F.min("_at").alias("start"), F.count(F.lit(1)).alias("run_length"), F.first("value").alias("value")).select("block_id", "start", "run_length", "value")


def entries(runs: DataFrame) -> DataFrame:
    """Stored entries of each block: a single value takes one, a longer run its length and its value."""
    return runs.groupBy("block_id").agg(F.sum(F.when(F.col("run_length") == 1, 1).otherwise(2)).alias("entries"))


def decode(runs: DataFrame) -> DataFrame:
    """Rows of runs: block_id, position, value."""
    at = F.explode(F.sequence(F.col("start"), F.col("start") + F.col("run_length") - 1))
    return runs.select("block_id", at.alias("position"), "value")
