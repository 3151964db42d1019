"""Command line: build the store from a record file, run the query of a code, write its result file."""

from __future__ import annotations

import argparse
import sys
import time

from pyspark.sql import SparkSession

from plinth.plans.params import parse
from plinth.plans.query import price_query
from plinth.sources import results, store


def main(argv: list[str] | None = None, spark: SparkSession | None = None) -> int:
    args = argparse.ArgumentParser(prog="plinth", description=__doc__)
    args.add_argument("--code", required=True, help="query code of at least nine characters")
    args.add_argument("--data", help="record file; without it the store is used as it is")
    args.add_argument("--store", default="column_store", help="folder of the store")
    args.add_argument("--results", default="results", help="folder of the result file")
    given = args.parse_args(argv)
    try:
        params = parse(given.code)
    except ValueError as e:
        print(e, file=sys.stderr)
        return 1
    spark = spark or SparkSession.builder.appName("plinth").getOrCreate()
    if given.data:
        store.build(spark, given.data, given.store)
    began = time.perf_counter()
    row = price_query(params.month_code, params.town_code, params.area, empty="sentinel").run(store.read(spark, given.store)).first().asDict()
    print(f"answered in {time.perf_counter() - began:.3f} s")
    path = f"{given.results}/ScanResult_{given.code}.csv"
    results.write(row, params.year, params.month, params.town, path)
    for name, category in results.CATEGORIES.items():
        print(f"{category} = {row[name]:.2f}")
    print(f"written: {path}")
    return 0
