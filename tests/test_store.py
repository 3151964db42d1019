import math

import pytest
from pyspark.sql import functions as F

from plinth import cli
from plinth.functions import dictionaries as d
from plinth.functions.formatting import short_float
from plinth.plans.params import parse
from plinth.plans.query import Query, price_query
from plinth.schema import FIELDS, field
from plinth.sources import records, store
from plinth.streaming.ingest import ingest
from tests.records_data import ANSWER, FILE, LINES, write_csv


def close(row, want=ANSWER):
    return all(math.isclose(row[k], v, rel_tol=1e-9) for k, v in want.items())


@pytest.fixture(scope="module")
def csv(tmp_path_factory):
    return write_csv(tmp_path_factory.mktemp("csv"))


@pytest.fixture(scope="module")
def built(spark, csv, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("store") / "s")
    store.build(spark, csv, path)
    return path


def test_validation_drops_every_kind_of_reject(spark, csv):
    raw = records.read_raw(spark, csv)
    assert records.validated(raw).count() == 7
    assert {r.reason: r.records for r in records.rejects(raw).collect()} == {"arity": 2, "floor_area_sqm": 4, "resale_price": 1}


def test_golden_query(spark, built):
    p = parse("Q0000071Z")
    assert (p.year, p.month, p.town, p.area) == (2021, 7, "TAMPINES", 80.0)
    assert close(price_query(p.month_code, p.town_code, p.area).run(store.read(spark, built)).first())


def test_pruned_store_and_plain_scan_agree(spark, built, csv):
    q = price_query(90, 7, 80)
    assert q.run(store.read(spark, built)).first() == q.run(store.encoded(records.read(spark, csv))).first()


def test_the_filters_reach_the_scan(spark, built):
    plan = price_query(90, 7, 80).run(store.read(spark, built))._jdf.queryExecution().executedPlan().toString()
    for name in ("month_code", "town_code", "floor_area_sqm"):
        assert f"GreaterThanOrEqual({name}" in plan or f"EqualTo({name}" in plan
    assert "street_name" not in plan


@pytest.mark.parametrize(("month", "want"), [(88, {"min_price": 300000.0}), (91, {"min_price": 300000.0}), (92, {"min_price": 300000.0})])
def test_months_at_the_borders(spark, built, month, want):
    assert close(price_query(month, 7, 80).run(store.read(spark, built)).first(), want)


def test_no_match(spark, built):
    nothing = store.read(spark, built)
    assert list(price_query(0, 3, 80).run(nothing).first()) == [None] * 4
    assert list(price_query(0, 3, 80, empty="sentinel").run(nothing).first()) == [1.7976931348623157e308, 0.0, 0.0, 1.7976931348623157e308]


def test_one_row_has_no_deviation(spark, built):
    assert price_query(92, 7, 80, months=1).run(store.read(spark, built)).first().stddev_price == 0.0


def test_header_only(spark, tmp_path):
    path = write_csv(tmp_path, [])
    store.build(spark, path, str(tmp_path / "s"))
    assert price_query(90, 7, 80).run(store.encoded(records.read(spark, path))).first().min_price is None


def test_decoding_gives_the_records_back(spark, built, csv):
    back, want = store.decoded(store.read(spark, built)), records.read(spark, csv)
    assert back.exceptAll(want).isEmpty() and want.exceptAll(back).isEmpty()
    assert back.columns == [f.name for f in FIELDS]


def test_store_is_sorted(spark, built):
    codes = [r.month_code for r in store.read(spark, built).withColumn("f", F.input_file_name()).orderBy("f").collect()]
    assert sorted(codes) == sorted(c for c in codes if c is not None)


def test_text_sink_round_trip(spark, csv, tmp_path):
    typed = records.read(spark, csv)
    records.write(typed, str(tmp_path / "out"))
    again = records.read(spark, str(tmp_path / "out"))
    assert again.exceptAll(typed).isEmpty() and again.count() == 7


def test_dictionaries_round_trip(spark):
    months = [f"{2014 + i // 12}-{i % 12 + 1:02d}" for i in range(d.MONTHS)]
    years = [str(d.FIRST_LEASE_YEAR + i) for i in range(d.LEASE_YEARS)]
    for values, enc, dec in [(v, lambda c, v=v: d.encode(c, v), lambda c, v=v: d.decode(c, v)) for v in (d.TOWNS, d.FLAT_TYPES, d.STOREYS, d.FLAT_MODELS)] + [(months, d.encode_month, d.decode_month), (years, d.encode_lease, d.decode_lease)]:
        df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, v string")
        out = df.select("i", "v", enc(F.col("v")).alias("c")).withColumn("back", dec(F.col("c"))).collect()
        assert all(r.c == r.i and r.back == r.v for r in out) and len(out) == len(values)


def test_unknown_values(spark):
    df = spark.createDataFrame([("NOWHERE", "2031-01", "1900"), (None, None, None), ("BEDOK", "2014-13", "abc")], "t string, m string, y string")
    null = df.select(d.encode(F.col("t"), d.TOWNS), d.encode_month(F.col("m")), d.encode_lease(F.col("y"))).collect()
    assert [tuple(r) for r in null] == [(None, None, None), (None, None, None), (0, None, None)]
    zero = df.select(d.encode(F.col("t"), d.TOWNS, 0), d.encode_month(F.col("m"), 0), d.encode_lease(F.col("y"), 0)).collect()
    assert all(tuple(r) == (0, 0, 0) for r in zero)
    assert spark.range(1).select(d.decode(F.lit(99), d.TOWNS), d.decode_month(F.lit(-1))).first() == (None, None)


def test_short_floats(spark):
    df = spark.createDataFrame([(60.0,), (60.5,), (60.25,), (60.05,), (60.10,), (None,)], "x double")
    assert [r[0] for r in df.select(short_float(F.col("x"))).collect()] == ["60", "60.5", "60.25", "60", "60.1", None]


def test_fields_by_name():
    assert field("town").stored == "town_code" and field("floor_area_sqm").width == 8
    with pytest.raises(KeyError):
        field("nothing")


@pytest.mark.parametrize("code", ["", "U123", "U22203x1G", "U222037xG"])
def test_bad_codes(code):
    with pytest.raises(ValueError):
        parse(code)


def test_october_and_years():
    assert (parse("U2220001G").month, parse("U2220001G").town_code) == (10, 0)
    assert [parse(f"U22203{y}{0}G"[:7] + f"{y}G").year for y in (3, 4, 9, 0)] == [2023, 2014, 2019, 2020]


def scanned(df):
    """Rows that left the scans of an executed query."""
    df.collect()
    plan, n, todo = df._jdf.queryExecution().executedPlan(), 0, []
    todo = [plan]
    while todo:
        p = todo.pop()
        name = p.nodeName()
        if name == "AdaptiveSparkPlan":
            todo.append(p.executedPlan())
            continue
        if name.endswith("QueryStage"):
            todo.append(p.plan())
            continue
        if name.startswith("Scan parquet"):
            n += p.metrics().apply("numOutputRows").value()
        todo += [p.children().apply(i) for i in range(p.children().size())]
    return n


def test_clustering_prunes_row_groups(spark, tmp_path):
    n = 40_000
    rows = spark.range(n).select(
        F.expr("concat(2014 + id % 10, '-', lpad(1 + (id div 10) % 12, 2, '0'))").alias("month"),
        F.element_at(F.array(*map(F.lit, d.TOWNS)), (F.col("id") * 7 % 26 + 1).cast("int")).alias("town"),
        *[F.lit(x).alias(c) for c, x in (("flat_type", "4 ROOM"), ("storey_range", "01 TO 03"), ("flat_model", "Model A"), ("lease_commence_date", "1990"), ("block", "1"), ("street_name", "S"))],
        (F.col("id") % 150).cast("double").alias("floor_area_sqm"),
        (F.col("id") * 1.0).alias("resale_price"),
    )
    path = str(tmp_path / "s")
    store.write(store.encoded(rows), path, files=6, row_group=8 << 10)
    q = price_query(60, 7, 80)
    got = q.run(store.read(spark, path))
    assert 0 < scanned(got) < n / 5
    assert got.first() == q.run(store.encoded(rows)).first()


def test_command_line(spark, csv, tmp_path, capsys):
    args = ["--code", "Q0000071Z", "--data", csv, "--store", str(tmp_path / "s"), "--results", str(tmp_path / "r")]
    assert cli.main(args, spark) == 0
    assert (tmp_path / "r/ScanResult_Q0000071Z.csv").read_text() == FILE
    assert "Average Price = 500000.00" in capsys.readouterr().out
    assert cli.main(["--code", "x"], spark) == 1


def test_streaming_ingest(spark, tmp_path):
    folder = tmp_path / "in"
    folder.mkdir()
    where = (str(folder), str(tmp_path / "s"), str(tmp_path / "c"))
    write_csv(folder, LINES[:4], "a.csv")
    ingest(spark, *where).awaitTermination()
    write_csv(folder, LINES[4:], "b.csv")
    ingest(spark, *where).awaitTermination()
    df = store.read(spark, where[1])
    assert df.count() == 7 and close(price_query(90, 7, 80).run(df).first())


def test_query_without_filters(spark, built):
    assert Query([], price_query(90, 7, 80).metrics).run(store.read(spark, built)).first().min_price == 200000.0
