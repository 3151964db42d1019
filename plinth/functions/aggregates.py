"""Aggregates of one shared scan: minimum, average, population standard deviation."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, functions as F

from plinth.functions.predicates import LARGEST

_FUNCTIONS = {"min": F.min, "avg": F.avg, "stddev_pop": F.stddev_pop}
#: What an aggregate of no rows is in sentinel mode.
SENTINELS = {"min": LARGEST, "avg": 0.0, "stddev_pop": 0.0}


@dataclass(frozen=True)
class Metric:
    """function (min, avg or stddev_pop) of a column or an expression, rounded if decimals are given. Any number of metrics share
    one scan and one aggregate."""

    name: str
    function: str
    of: str | Column
    decimals: int | None = None

    def column(self, empty: str = "null") -> Column:
        """empty: 'null' as in SQL, or 'sentinel'."""
        if self.function not in _FUNCTIONS:
            raise ValueError(f"unknown aggregate {self.function!r}")
        out = _FUNCTIONS[self.function](F.col(self.of) if isinstance(self.of, str) else self.of)
        if self.decimals is not None:
            out = F.round(out, self.decimals)
        if empty == "sentinel":
            out = F.coalesce(out, F.lit(SENTINELS[self.function]))
        elif empty != "null":
            raise ValueError(f"empty is 'null' or 'sentinel', not {empty!r}")
        return out.alias(self.name)
