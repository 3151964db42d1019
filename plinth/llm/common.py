"""Small helpers that the operators of this subpackage share."""

from __future__ import annotations

import os
import re
import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

from plinth.sources.scratch import settle, spent

__all__ = ["WORD", "chunks", "fresh", "pieces", "settle", "ship", "sliced", "spent", "table"]

#: White space of every word rule in this subpackage: space, tab, line feed, vertical tab, form feed, return.
WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ship(spark: SparkSession) -> None:
    """Send this package to the executors through Spark, once per application; they need no copy of their own.

    Every operator that runs Python on executors calls it. Executors get the file from the driver, so it may lie on the driver's disk.
    """
    sc = spark.sparkContext
    if getattr(sc, "_plinth_shipped", False):
        return
    root = Path(__file__).resolve().parents[1]
    to = os.path.join(tempfile.mkdtemp(prefix="plinth-package-"), "plinth.zip")
    with zipfile.ZipFile(to, "w") as z:
        for p in sorted(root.rglob("*.py")):
            z.write(p, str(p.relative_to(root.parent)))
    sc.addPyFile(to)
    sc._plinth_shipped = True


def sliced(column, rows: int = 256):
    """The values of an Arrow column in lists of so many: a batch's texts are never all held as Python strings."""
    for i in range(0, len(column), rows):
        yield column.slice(i, rows).to_pylist()


def fresh(name: str, df: DataFrame) -> str:
    """A column name that df doesn't have."""
    taken = {c.lower() for c in df.columns}
    while name in taken:
        name = f"_{name}"
    return name


_BREAK = re.compile(r"[\x20\x09-\x0D]")


def pieces(text: str, limit: int):
    """(offset, piece) of a text: pieces of about limit characters that begin at white space, so that no word is cut."""
    if len(text) <= limit:
        yield 0, text
        return
    at = 0
    while at < len(text):
        m = _BREAK.search(text, at + limit)
        end = m.start() if m else len(text)
        yield at, text[at:end]
        at = end


def chunks(texts: list[str | None], limit: int):
    """(first, last) index ranges of texts whose characters sum to at most limit, one text at least."""
    first, total = 0, 0
    for i, t in enumerate(texts):
        n = len(t) if t else 0
        if i > first and total + n > limit:
            yield first, i
            first, total = i, 0
        total += n
    if first < len(texts):
        yield first, len(texts)
