"""Dictionary encoding of low-cardinality columns.

Small dictionaries are literal maps inside the plan; ordinals of months and years are arithmetic. A value outside its
dictionary encodes as null, or as 0 with unknown=0, which is what a lookup without a miss would give.
"""

from __future__ import annotations

from collections.abc import Sequence
from itertools import chain

from pyspark.sql import Column, functions as F

# The dictionaries of the coded columns, each value at the place of its code.
TOWNS = (
    "BEDOK", "BUKIT PANJANG", "CLEMENTI", "CHOA CHU KANG", "HOUGANG", "JURONG WEST", "PASIR RIS", "TAMPINES", "WOODLANDS",
    "YISHUN", "ANG MO KIO", "BISHAN", "BUKIT BATOK", "BUKIT MERAH", "BUKIT TIMAH", "CENTRAL AREA", "GEYLANG",
    "JURONG EAST", "KALLANG/WHAMPOA", "MARINE PARADE", "PUNGGOL", "QUEENSTOWN", "SEMBAWANG", "SENGKANG", "SERANGOON", "TOA PAYOH",
)
FLAT_TYPES = ("1 ROOM", "2 ROOM", "3 ROOM", "4 ROOM", "5 ROOM", "MULTI-GENERATION", "EXECUTIVE")
FLAT_MODELS = (
    "Improved", "New Generation", "Model A", "Simplified", "Premium Apartment", "Standard", "Model A-Maisonette", "Apartment",
    "Maisonette", "Model A2", "Terrace", "Adjoined flat", "DBSS", "Multi Generation", "Premium Maisonette",
    "Improved-Maisonette", "Type S1", "Type S2", "Premium Apartment Loft", "2-room", "3Gen",
)
FIRST_MONTH, MONTHS = (2014, 1), 121
FIRST_LEASE_YEAR, LEASE_YEARS = 1966, 57
STOREYS = tuple(f"{low:02d} TO {low + 2:02d}" for low in range(1, 50, 3))


def encode(value: Column, dictionary: Sequence[str], unknown: int | None = None) -> Column:
    """The code of a value: its place in the dictionary."""
    table = F.create_map(*chain.from_iterable((F.lit(v), F.lit(i)) for i, v in enumerate(dictionary)))
    code = F.try_element_at(table, value)
    return code if unknown is None else F.coalesce(code, F.lit(unknown))


def decode(code: Column, dictionary: Sequence[str]) -> Column:
    """The value of a code; null outside the dictionary."""
    held = F.when((code >= 0) & (code < len(dictionary)), code + 1)
    return F.try_element_at(F.array(*map(F.lit, dictionary)), held.cast("int"))


def encode_month(value: Column, unknown: int | None = None, first: tuple[int, int] = FIRST_MONTH, months: int = MONTHS) -> Column:
    """Months since the first one, of YYYY-MM text; an INT, since codes outgrow a signed byte."""
    year, month = value.substr(1, 4).try_cast("int"), value.substr(6, 2).try_cast("int")
    code = (year - first[0]) * 12 + month - first[1]
    code = F.when(value.rlike("^[0-9]{4}-(0[1-9]|1[0-2])$") & (code >= 0) & (code < months), code)
    return code if unknown is None else F.coalesce(code, F.lit(unknown))


def decode_month(code: Column, first: tuple[int, int] = FIRST_MONTH, months: int = MONTHS) -> Column:
    there = F.when((code >= 0) & (code < months), code + (first[1] - 1))
    year, month = F.floor(there / 12) + first[0], there % 12 + 1
    return F.when(there.isNotNull(), F.concat_ws("-", F.lpad(year.cast("string"), 4, "0"), F.lpad(month.cast("string"), 2, "0")))


def month_ordinal(when: Column, first: tuple[int, int]) -> Column:
    """Months since the first one, of a date or time."""
    return (F.year(when) - first[0]) * 12 + F.month(when) - first[1]


def encode_lease(value: Column, unknown: int | None = None) -> Column:
    year = F.when(value.rlike("^[0-9]{4}$"), value.try_cast("int"))
    code = F.when(year.between(FIRST_LEASE_YEAR, FIRST_LEASE_YEAR + LEASE_YEARS - 1), year - FIRST_LEASE_YEAR)
    return code if unknown is None else F.coalesce(code, F.lit(unknown))


def decode_lease(code: Column) -> Column:
    return F.when((code >= 0) & (code < LEASE_YEARS), (code + FIRST_LEASE_YEAR).cast("string"))


def encoders(unknown: int | None = None) -> dict[str, Column]:
    """Code expressions of all coded columns, by column."""
    small = {"town": TOWNS, "flat_type": FLAT_TYPES, "storey_range": STOREYS, "flat_model": FLAT_MODELS}
    out = {name: encode(F.col(name), values, unknown) for name, values in small.items()}
    return out | {"month": encode_month(F.col("month"), unknown), "lease_commence_date": encode_lease(F.col("lease_commence_date"), unknown)}


def decoders() -> dict[str, Column]:
    """Value expressions of all coded columns, by column, from <column>_code."""
    small = {"town": TOWNS, "flat_type": FLAT_TYPES, "storey_range": STOREYS, "flat_model": FLAT_MODELS}
    out = {name: decode(F.col(f"{name}_code"), values) for name, values in small.items()}
    return out | {"month": decode_month(F.col("month_code")), "lease_commence_date": decode_lease(F.col("lease_commence_date_code"))}
