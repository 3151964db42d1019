"""The record model: ten positional fields, their types, and which indexes each one has."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import types as T


@dataclass(frozen=True)
class Field:
    """One column of the store. coded: stored as a dictionary code. indexes: any of zone, bitmap; both imply an offset map."""

    name: str
    type: T.DataType
    coded: bool = False
    indexes: tuple[str, ...] = ()
    sorted: bool = False

    @property
    def stored(self) -> str:
        return f"{self.name}_code" if self.coded else self.name

    @property
    def width(self) -> int | None:
        """Bytes of an encoded entry; None for text, which has its own length."""
        return 1 if self.coded else 8 if isinstance(self.type, T.DoubleType) else None


FIELDS = (
    Field("month", T.StringType(), coded=True, indexes=("zone",), sorted=True),
    Field("town", T.StringType(), coded=True, indexes=("bitmap",)),
    Field("flat_type", T.StringType(), coded=True),
    Field("block", T.StringType()),
    Field("street_name", T.StringType()),
    Field("storey_range", T.StringType(), coded=True),
    Field("floor_area_sqm", T.DoubleType(), indexes=("zone",)),
    Field("flat_model", T.StringType(), coded=True),
    Field("lease_commence_date", T.StringType(), coded=True),
    Field("resale_price", T.DoubleType(), indexes=("zone",)),
)
#: Records as read, before any field is parsed.
RAW = T.StructType([T.StructField(f.name, T.StringType()) for f in FIELDS])
#: Validated records.
TYPED = T.StructType([T.StructField(f.name, f.type) for f in FIELDS])
NUMERIC = tuple(f.name for f in FIELDS if isinstance(f.type, T.DoubleType))


def field(name: str) -> Field:
    """A field by name; an unknown name is an error."""
    for f in FIELDS:
        if f.name == name:
            return f
    raise KeyError(f"no field {name!r}")
