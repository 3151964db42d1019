"""Incremental ingest: each micro-batch of record files is validated, encoded, clustered and appended to the store.

A micro-batch is written under its own number, so a repeated batch replaces itself and no row comes twice.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from plinth.schema import RAW
from plinth.sources import records, store


def stream_raw(spark: SparkSession, directory: str) -> DataFrame:
    schema = T.StructType([*RAW.fields, T.StructField(records.CORRUPT, T.StringType())])
    options = {"header": True, "mode": "PERMISSIVE", "columnNameOfCorruptRecord": records.CORRUPT, "columnPruning": False}
    return spark.readStream.schema(schema).options(**options).csv(directory)


def ingest(spark: SparkSession, directory: str, path: str, checkpoint: str, unknown: int | None = None) -> StreamingQuery:
    """Start the ingest of all files that are there; it ends when they are in the store. Rerun it for later files."""

    def append(batch: DataFrame, number: int) -> None:
        store.write(store.encoded(records.validated(batch), unknown), f"{path}/batch={number}")

    return stream_raw(spark, directory).writeStream.foreachBatch(append).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
