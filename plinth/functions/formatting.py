"""Text forms of records."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from plinth.schema import FIELDS, NUMERIC


def short_float(x: Column) -> Column:
    """A number in at most two decimals: none if the tenths digit is 0, one if the hundredths digit is 0.

    Lossy on purpose (60.05 is written 60), as the text form that it reproduces; the store keeps full numbers.
    """
    two = F.format_string("%.2f", x)
    text = F.when(F.substring(two, -2, 1) == "0", F.format_string("%.0f", x)).when(F.substring(two, -1, 1) == "0", F.format_string("%.1f", x)).otherwise(two)
    return F.when(x.isNotNull(), text)


def as_fields() -> list[Column]:
    """The ten fields of a typed record as text."""
    return [(short_float(F.col(f.name)) if f.name in NUMERIC else F.col(f.name)).alias(f.name) for f in FIELDS]


def line_bytes(fields: list[Column]) -> Column:
    """Bytes of a delimited line of these fields: their UTF-8 lengths, the delimiters and the line end."""
    lengths = [F.octet_length(F.coalesce(c.cast("string"), F.lit(""))) for c in fields]
    return sum(lengths[1:], lengths[0]) + len(fields)
