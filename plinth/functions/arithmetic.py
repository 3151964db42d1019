"""Arithmetic between two columns."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

OPERATIONS = {
    "add": lambda x, y: x + y,
    "subtract": lambda x, y: x - y,
    "multiply": lambda x, y: x * y,
    "divide": lambda x, y: F.try_divide(x, y),  # null for a divisor of 0, where / would raise
}


def compute(operation: str, x: Column, y: Column) -> Column:
    """x operation y; an unknown operation is an error."""
    if operation not in OPERATIONS:
        raise ValueError(f"unknown operation {operation!r}; known are {', '.join(OPERATIONS)}")
    return OPERATIONS[operation](x, y)
