"""The clustered store: encoded records in Parquet, ordered by month and town.

The month is stored as a whole number, because Parquet statistics prune that type; town comes second, so that row groups of a
month hold few towns. Parquet's own dictionary and run-length pages do what a hand-made column format would.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from plinth.functions.dictionaries import decoders, encoders
from plinth.schema import FIELDS

#: Bytes of a row group, small enough that a month of one town is a few of them in large stores.
ROW_GROUP = 16 << 20


def encoded(records: DataFrame, unknown: int | None = None) -> DataFrame:
    """Typed records with coded columns as <column>_code; an unknown value is null, or 0 with unknown=0 (V4)."""
    codes = encoders(unknown)
    return records.select(*[codes[f.name].cast("int").alias(f.stored) if f.coded else F.col(f.name) for f in FIELDS])


def decoded(store: DataFrame) -> DataFrame:
    """Rows of the store as typed records."""
    values = decoders()
    return store.select(*[values[f.name].alias(f.name) if f.coded else F.col(f.name) for f in FIELDS])


def write(store: DataFrame, path: str, order: tuple[str, ...] = ("month_code", "town_code"), files: int | None = None, mode: str = "overwrite", row_group: int = ROW_GROUP) -> None:
    """Write rows clustered by `order`: one shuffle by range, then a sort inside each file.

    Files follow spark.sql.shuffle.partitions unless `files` says otherwise; a hot month spreads over several, as the range
    bounds take in all columns of the order.
    """
    ranged = store.repartitionByRange(files, *order) if files else store.repartitionByRange(*order)
    ranged.sortWithinPartitions(*order).write.mode(mode).option("parquet.block.size", row_group).parquet(path)


def read(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def build(spark: SparkSession, csv: str, path: str, unknown: int | None = None) -> None:
    """Delimited records to a clustered store, in one job."""
    from plinth.sources import records

    write(encoded(records.read(spark, csv), unknown), path)

