"""Results in long form: one row per category, values in two decimals."""

from __future__ import annotations

import csv
from pathlib import Path

from pyspark.sql import DataFrame, functions as F

# The categories of the four metrics, in the order of a result file, and its header.
CATEGORIES = {
    "min_price": "Minimum Price",
    "avg_price": "Average Price",
    "stddev_price": "Standard Deviation of Price",
    "min_price_per_area": "Minimum Price per Square Meter",
}
HEADER = ("Year", "Month", "Town", "Category", "Value")


def long_form(result: DataFrame, metrics: list[str] | None = None) -> DataFrame:
    """A one-row result as rows (ordinal, metric, value)."""
    names = metrics or result.columns
    rows = F.array(*[F.struct(F.lit(i).alias("ordinal"), F.lit(n).alias("metric"), F.col(n).cast("double").alias("value")) for i, n in enumerate(names)])
    return result.select(F.inline(rows))


def write(values: dict[str, float], year: int, month: int, town: str, path: str) -> None:
    """The result file of one query. Four numbers: the driver writes them, and rounds them as exact binary values."""
    Path(path).parent.mkdir(parents=True, exist_ok=True)
    with open(path, "w", newline="", encoding="utf-8") as f:
        out = csv.writer(f, lineterminator="\n")
        out.writerow(HEADER)
        for name, category in CATEGORIES.items():
            out.writerow((f"{year:04d}", f"{month:02d}", town, category, f"{values[name]:.2f}"))
