"""Filters: inclusive ranges, exact matches, and their conjunction."""

from __future__ import annotations

import datetime as dt
from dataclasses import dataclass
from functools import reduce
from operator import and_

from pyspark.sql import Column, functions as F

#: The open upper end of a range over doubles.
LARGEST = 1.7976931348623157e308


@dataclass(frozen=True)
class Range:
    """low <= column <= high. Null and NaN never qualify, although Spark orders NaN above every number."""

    column: str
    low: float | int
    high: float | int = LARGEST

    def condition(self) -> Column:
        c = F.col(self.column)
        inside = c.between(F.lit(self.low), F.lit(self.high))
        return inside & ~F.isnan(c) if isinstance(self.high, float) else inside


@dataclass(frozen=True)
class Exact:
    """column = value; null never qualifies."""

    column: str
    value: int | str

    def condition(self) -> Column:
        return F.col(self.column) == F.lit(self.value)


@dataclass(frozen=True)
class Months:
    """A time in the calendar months first..last, inclusive, as ordinals since epoch (year, month).

    It compares the time itself with two constants, so it reaches the scan; an ordinal computed from the column would not.
    """

    column: str
    first: int
    last: int
    epoch: tuple[int, int]

    def condition(self) -> Column:
        at = lambda n: F.lit(dt.date(self.epoch[0] + (self.epoch[1] - 1 + n) // 12, (self.epoch[1] - 1 + n) % 12 + 1, 1)).cast("timestamp_ntz")
        return (F.col(self.column) >= at(self.first)) & (F.col(self.column) < at(self.last + 1))


def conjunction(filters: list) -> Column:
    """All filters at once; without any, true."""
    return reduce(and_, (f.condition() for f in filters), F.lit(True))
