"""A query: filters, then any number of metrics in one aggregate."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame, functions as F

from plinth.functions.aggregates import Metric
from plinth.functions.arithmetic import compute
from plinth.functions.predicates import Exact, Range, conjunction


@dataclass(frozen=True)
class Query:
    """Filters and metrics; empty says what metrics of no rows are: 'null', or 'sentinel'."""

    filters: list = field(default_factory=list)
    metrics: list[Metric] = field(default_factory=list)
    empty: str = "null"

    def rows(self, df: DataFrame) -> DataFrame:
        return df.where(conjunction(self.filters))

    def run(self, df: DataFrame) -> DataFrame:
        """One row. One scan of the columns that are named, one partial and one final aggregate."""
        return self.rows(df).agg(*[m.column(self.empty) for m in self.metrics])


def price_query(month: int, town: int, area: float, months: int = 2, empty: str = "null") -> Query:
    """Prices of a town over consecutive months, for areas from `area` up, against the store."""
    filters = [Range("month_code", month, month + months - 1), Exact("town_code", town), Range("floor_area_sqm", float(area))]
    per_area = compute("divide", F.col("resale_price"), F.col("floor_area_sqm"))
    metrics = [Metric("min_price", "min", "resale_price"), Metric("avg_price", "avg", "resale_price"), Metric("stddev_price", "stddev_pop", "resale_price"), Metric("min_price_per_area", "min", per_area)]
    return Query(filters, metrics, empty)
