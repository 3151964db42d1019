"""Delimited records: reading, validation, writing."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

from plinth.functions.formatting import as_fields
from plinth.schema import FIELDS, NUMERIC, RAW

#: Numbers as records may write them: no spaces around, no type suffix.
NUMBER = r"^[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?$"
CORRUPT = "_corrupt"


def read_raw(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """All records as text fields, with the whole line in _corrupt where it hasn't exactly ten fields.

    Without columnPruning=false an over-long line would pass unseen as soon as fewer columns are asked for.
    """
    schema = T.StructType([*RAW.fields, T.StructField(CORRUPT, T.StringType())])
    options = {"header": True, "mode": "PERMISSIVE", "columnNameOfCorruptRecord": CORRUPT, "columnPruning": False, "enforceSchema": True}
    return spark.read.schema(schema).options(**options).csv(path)


def number(text: Column) -> Column:
    """The finite double that a text writes; null for anything else."""
    value = F.when(text.rlike(NUMBER), text.try_cast("double"))
    return F.when(F.abs(value) < float("inf"), value)


def reject_reason(raw: DataFrame) -> Column:
    """Why a raw record is invalid, null if it is valid: arity, or a field that is no number of at least 0."""
    reason = F.when(F.col(CORRUPT).isNotNull(), "arity") if CORRUPT in raw.columns else F.when(F.lit(False), "arity")
    for name in NUMERIC:
        x = number(F.col(name))
        reason = reason.when(x.isNull() | (x < 0), name)
    return reason


def validated(raw: DataFrame) -> DataFrame:
    """The valid records, typed (V1)."""
    typed = [(number(F.col(f.name)) if f.name in NUMERIC else F.col(f.name)).alias(f.name) for f in FIELDS]
    return raw.where(reject_reason(raw).isNull()).select(*typed)


def rejects(raw: DataFrame) -> DataFrame:
    """Counts of invalid records: reason, records."""
    return raw.select(reject_reason(raw).alias("reason")).where("reason is not null").groupBy("reason").agg(F.count(F.lit(1)).alias("records"))


def read(spark: SparkSession, path: str | list[str]) -> DataFrame:
    return validated(read_raw(spark, path))


def write(records: DataFrame, path: str, mode: str = "overwrite") -> None:
    """Typed records as delimited text with a header, numbers in their short form."""
    records.select(*as_fields()).write.mode(mode).option("header", True).csv(path)
