"""One query per operator over the driver's tables, and its SQL.

lineitem plays the record table (month of l_shipdate, code of l_returnflag, l_quantity as area, l_extendedprice as price); orders, in
the order of (o_orderdate, o_orderkey), is used where positions matter.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from plinth.functions.aggregates import Metric
from plinth.functions.arithmetic import compute
from plinth.functions.dictionaries import FLAT_MODELS, FLAT_TYPES, STOREYS, TOWNS, decode, decode_lease, decode_month, encode, encode_lease, encode_month, month_ordinal
from plinth.functions.formatting import line_bytes, short_float
from plinth.functions.predicates import Exact, Months, Range
from plinth.operators import blocks, rle
from plinth.operators.positions import with_positions
from plinth.plans.params import parse_columns
from plinth.plans.query import Query
from plinth.schema import FIELDS
from plinth.sources import records, store
from plinth.sources.results import long_form
from plinth.sources.scratch import folder

EPOCH = (1995, 1)
MONTHS = Months("l_shipdate", 30, 31, EPOCH)
FLAG, AREA = Exact("l_returnflag", "R"), Range("l_quantity", 20.0)
FLAGS, STATUSES = ("A", "N", "R"), ("F", "O", "P")
#: The 25 brands, by their rule.
BRANDS = tuple(f"Brand#{i}" for i in range(1, 26))
#: Decimals that averages and deviations are compared in.
DECIMALS = 6

Q = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Q] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None) -> Callable[[Q], Q]:
    def add(f: Q) -> Q:
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


#: Types of the test tables, given to the reader so that no job has to look for them.
SCHEMAS = {
    "lineitem": "l_orderkey long, l_partkey long, l_suppkey long, l_linenumber int, l_quantity double, l_extendedprice double, l_discount double, l_tax double, l_returnflag string, l_linestatus string, l_shipdate timestamp_ntz",
    "orders": "o_orderkey long, o_custkey long, o_orderstatus string, o_totalprice double, o_orderdate timestamp_ntz, o_orderpriority string",
    "part": "p_partkey long, p_name string, p_brand string, p_type string, p_size int, p_retailprice double",
    "customer": "c_custkey long, c_name string, c_nationkey int, c_acctbal double, c_mktsegment string",
}


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.schema(SCHEMAS[name]).parquet(f"{sf_dir}/{name}.parquet")


def _lineitem(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _table(spark, sf_dir, "lineitem")


def _prices() -> list[Metric]:
    per_area = compute("divide", F.col("l_extendedprice"), F.col("l_quantity"))
    return [
        Metric("min_price", "min", "l_extendedprice"),
        Metric("avg_price", "avg", "l_extendedprice", DECIMALS),
        Metric("stddev_price", "stddev_pop", "l_extendedprice", DECIMALS),
        Metric("min_price_per_area", "min", per_area),
    ]


MONTH_SQL = "(year(l_shipdate) - 1995) * 12 + month(l_shipdate) - 1"
WHERE_SQL = f"{MONTH_SQL} BETWEEN 30 AND 31 AND l_returnflag = 'R' AND l_quantity >= 20"
PRICES_SQL = f"""min(l_extendedprice) AS min_price, round(avg(l_extendedprice), {DECIMALS}) AS avg_price,
  round(stddev_pop(l_extendedprice), {DECIMALS}) AS stddev_price, min(l_extendedprice / l_quantity) AS min_price_per_area"""


@query(f"SELECT {PRICES_SQL} FROM lineitem WHERE {WHERE_SQL}")
def flagship_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three filters, four metrics, one scan."""
    return Query([MONTHS, FLAG, AREA], _prices()).run(_lineitem(spark, sf_dir))


@query(f"SELECT l_orderkey, l_linenumber, l_extendedprice, ({MONTH_SQL})::INTEGER AS month_code FROM lineitem WHERE {MONTH_SQL} BETWEEN 30 AND 31")
def range_filter_int(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = Query([MONTHS]).rows(_lineitem(spark, sf_dir))
    return rows.select("l_orderkey", "l_linenumber", "l_extendedprice", month_ordinal(F.col("l_shipdate"), EPOCH).alias("month_code"))


@query("SELECT l_orderkey, l_linenumber, l_quantity FROM lineitem WHERE l_quantity >= 20 AND l_quantity <= 1.7976931348623157e308 AND NOT isnan(l_quantity)")
def range_filter_float(spark: SparkSession, sf_dir: str) -> DataFrame:
    return Query([AREA]).rows(_lineitem(spark, sf_dir)).select("l_orderkey", "l_linenumber", "l_quantity")


@query("SELECT l_orderkey, l_linenumber, l_returnflag FROM lineitem WHERE l_returnflag = 'R'")
def exact_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return Query([FLAG]).rows(_lineitem(spark, sf_dir)).select("l_orderkey", "l_linenumber", "l_returnflag")


@query(f"SELECT l_orderkey, l_linenumber, l_quantity, l_extendedprice FROM lineitem WHERE {WHERE_SQL}")
def conjunctive_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return Query([MONTHS, FLAG, AREA]).rows(_lineitem(spark, sf_dir)).select("l_orderkey", "l_linenumber", "l_quantity", "l_extendedprice")


@query("SELECT min(l_extendedprice) AS min_price FROM lineitem")
def agg_min(spark: SparkSession, sf_dir: str) -> DataFrame:
    return Query([], _prices()[:1]).run(_lineitem(spark, sf_dir))


@query(f"SELECT round(avg(l_extendedprice), {DECIMALS}) AS avg_price FROM lineitem")
def agg_avg(spark: SparkSession, sf_dir: str) -> DataFrame:
    return Query([], _prices()[1:2]).run(_lineitem(spark, sf_dir))


@query(f"SELECT round(stddev_pop(l_extendedprice), {DECIMALS}) AS stddev_price FROM lineitem")
def agg_stddev_pop(spark: SparkSession, sf_dir: str) -> DataFrame:
    return Query([], _prices()[2:3]).run(_lineitem(spark, sf_dir))


@query(f"SELECT {PRICES_SQL.rsplit(',', 1)[0]} FROM lineitem WHERE l_returnflag = 'R'")
def shared_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three aggregates of one column in one scan (A4, A5)."""
    return Query([FLAG], _prices()[:3]).run(_lineitem(spark, sf_dir))


@query(f"SELECT min(l_extendedprice / l_quantity) AS min_price_per_area FROM lineitem WHERE {WHERE_SQL}")
def min_derived(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An aggregate of what an operation gives."""
    return Query([MONTHS, FLAG, AREA], _prices()[3:]).run(_lineitem(spark, sf_dir))


def _operation(name: str, sign: str) -> None:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return _lineitem(spark, sf_dir).select("l_orderkey", "l_linenumber", "l_extendedprice", "l_tax", compute(name, F.col("l_extendedprice"), F.col("l_tax")).alias("result"))

    run.__name__ = f"op_{name}"
    right = "nullif(l_tax, 0)" if name == "divide" else "l_tax"
    query(f"SELECT l_orderkey, l_linenumber, l_extendedprice, l_tax, l_extendedprice {sign} {right} AS result FROM lineitem")(run)


for _name, _sign in (("add", "+"), ("subtract", "-"), ("multiply", "*"), ("divide", "/")):
    _operation(_name, _sign)



def _list(values: tuple[str, ...]) -> str:
    return "[" + ", ".join(f"'{v}'" for v in values) + "]"


@query(f"SELECT p_partkey, (list_position({_list(BRANDS)}, p_brand) - 1)::INTEGER AS brand_code FROM part")
def dictionary_encode(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _table(spark, sf_dir, "part").select("p_partkey", encode(F.col("p_brand"), BRANDS).alias("brand_code"))


@query(f"SELECT p_partkey, {_list(BRANDS)}[p_partkey % 30 + 1] AS brand FROM part")
def dictionary_decode(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Codes 25 to 29 are none of the dictionary."""
    return _table(spark, sf_dir, "part").select("p_partkey", decode(F.col("p_partkey") % 30, BRANDS).alias("brand"))


def _dictionary(name: str, values: tuple[str, ...], to_value: Callable[[Column], Column], to_code: Callable[[Column], Column]) -> None:
    """A query that decodes every code of a dictionary and two beyond it, and encodes the values again."""
    of = len(values) + 2

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        value = _table(spark, sf_dir, "customer").select("c_custkey", to_value((F.col("c_custkey") % of).cast("int")).alias("value"))
        return value.select("c_custkey", "value", to_code(F.col("value")).cast("int").alias("code"))

    run.__name__ = f"dictionary_{name}"
    query(f"SELECT c_custkey, {_list(values)}[c_custkey % {of} + 1] AS value, CASE WHEN c_custkey % {of} < {len(values)} THEN c_custkey % {of} END::INTEGER AS code FROM customer")(run)


#: Years of the lease dictionary, by their rule.
LEASES = tuple(str(y) for y in range(1966, 2023))
for _name, _values in (("town", TOWNS), ("flat_type", FLAT_TYPES), ("storey", STOREYS), ("flat_model", FLAT_MODELS)):
    _dictionary(_name, _values, lambda c, v=_values: decode(c, v), lambda c, v=_values: encode(c, v))
_dictionary("lease", LEASES, decode_lease, encode_lease)


@query("SELECT o_orderkey, ((year(o_orderdate) - 1995) * 12 + month(o_orderdate) - 1)::INTEGER AS month_code, strftime(o_orderdate, '%Y-%m') AS month FROM orders")
def month_dictionary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Months as text, encoded and decoded."""
    code = encode_month(F.date_format("o_orderdate", "yyyy-MM"), first=EPOCH)
    return _table(spark, sf_dir, "orders").select("o_orderkey", code.alias("month_code"), decode_month(code, first=EPOCH).alias("month"))


def _raw_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records as text, with numbers malformed by a rule on their key so that every kind of reject occurs."""
    o = _table(spark, sf_dir, "orders")
    k = F.col("o_orderkey") % 11
    area = F.when(k == 1, F.lit(" 80")).when(k == 2, "90d").when(k == 3, "-5").otherwise(F.col("o_custkey").cast("string"))
    price = F.when(k == 4, F.lit("1e400")).when(k == 5, "").when(k == 6, "abc").when(k == 7, ".5e1").otherwise((F.col("o_custkey") * 2).cast("string"))
    return o.select("o_orderkey", area.alias("floor_area_sqm"), price.alias("resale_price"))


@query("""
SELECT o_orderkey, CASE WHEN o_orderkey % 11 IN (1, 2, 3) THEN 'floor_area_sqm' WHEN o_orderkey % 11 IN (4, 5, 6) THEN 'resale_price' END AS reason FROM orders
""")
def row_validation(spark: SparkSession, sf_dir: str) -> DataFrame:
    raw = _raw_records(spark, sf_dir)
    return raw.select("o_orderkey", records.reject_reason(raw).alias("reason"))


@query("""
SELECT p_partkey, CASE WHEN substr(t, length(t) - 1, 1) = '0' THEN printf('%.0f', p_retailprice)
                       WHEN substr(t, length(t), 1) = '0' THEN printf('%.1f', p_retailprice) ELSE t END AS price
FROM (SELECT *, printf('%.2f', p_retailprice) AS t FROM part)
""")
def format_float(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _table(spark, sf_dir, "part").select("p_partkey", short_float(F.col("p_retailprice")).alias("price"))


_NOTHING = Months("l_shipdate", 600, 601, EPOCH)


@query(f"SELECT {PRICES_SQL} FROM lineitem WHERE l_shipdate >= TIMESTAMP '2045-01-01'")
def empty_match_null(spark: SparkSession, sf_dir: str) -> DataFrame:
    return Query([_NOTHING], _prices()).run(_lineitem(spark, sf_dir))


@query("SELECT 1.7976931348623157e308::DOUBLE AS min_price, 0.0::DOUBLE AS avg_price, 0.0::DOUBLE AS stddev_price, 1.7976931348623157e308::DOUBLE AS min_price_per_area")
def empty_match_sentinel(spark: SparkSession, sf_dir: str) -> DataFrame:
    return Query([_NOTHING], _prices(), empty="sentinel").run(_lineitem(spark, sf_dir))


def _positioned(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders by date and key, with position, block, month code, status code, steps of price and priority."""
    step = F.floor(F.col("o_totalprice") / 100_000) * 0.5
    o = _table(spark, sf_dir, "orders").select("o_orderkey", "o_orderdate", "o_totalprice", month_ordinal(F.col("o_orderdate"), EPOCH).alias("month_code"), encode(F.col("o_orderstatus"), STATUSES).alias("status_code"), step.alias("step"), "o_orderpriority")
    return blocks.with_blocks(with_positions(o, ["o_orderdate", "o_orderkey"]))


POSITIONED_SQL = """positioned AS (
  SELECT o_orderkey, o_orderdate, o_totalprice, ((year(o_orderdate) - 1995) * 12 + month(o_orderdate) - 1)::INTEGER AS month_code,
         (list_position(['F', 'O', 'P'], o_orderstatus) - 1)::INTEGER AS status_code, floor(o_totalprice / 100000) * 0.5 AS step, o_orderpriority, row_number() OVER (ORDER BY o_orderdate, o_orderkey) - 1 AS position
  FROM orders
), blocked AS (SELECT *, position // 250 AS block_id FROM positioned)"""
ZONES_SQL = POSITIONED_SQL + """, zones AS (
  SELECT block_id, min(month_code) AS min_month_code, max(month_code) AS max_month_code, min(o_totalprice) AS min_o_totalprice, max(o_totalprice) AS max_o_totalprice
  FROM blocked GROUP BY block_id
)"""
BITS_SQL = POSITIONED_SQL + """, maps AS (SELECT block_id, bit_or(1::BIGINT << status_code) AS bits FROM blocked GROUP BY block_id)"""
MONTH_RANGE = Range("month_code", 30, 31)
PRICE_RANGE = Range("o_totalprice", 400_000.0)
STATUS = Exact("status_code", 1)


@query(f"WITH {POSITIONED_SQL} SELECT position, o_orderkey, month_code FROM positioned")
def sort_by_month(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The sort by month as positions."""
    return _positioned(spark, sf_dir).select("position", "o_orderkey", "month_code")


@query(f"WITH {ZONES_SQL} SELECT * FROM zones")
def zone_map_build(spark: SparkSession, sf_dir: str) -> DataFrame:
    return blocks.zone_map(_positioned(spark, sf_dir), "month_code", "o_totalprice")


@query(f"""WITH {ZONES_SQL}
SELECT block_id, NOT (min_month_code <= 31 AND max_month_code >= 30) OR (min_month_code >= 30 AND max_month_code <= 31) AS skippable, min_month_code <= 31 AND max_month_code >= 30 AS qualified FROM zones""")
def zone_map_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    zones = blocks.zone_map(_positioned(spark, sf_dir), "month_code")
    skip, ok = blocks.check_zone(F.col("min_month_code"), F.col("max_month_code"), MONTH_RANGE)
    return zones.select("block_id", skip.alias("skippable"), ok.alias("qualified"))


@query(f"WITH {BITS_SQL} SELECT block_id, bits FROM maps")
def bitmap_build(spark: SparkSession, sf_dir: str) -> DataFrame:
    return blocks.bitmap(_positioned(spark, sf_dir), "status_code")


@query(f"WITH {BITS_SQL} SELECT block_id, (bits & 2) = 0 OR bits = 2 AS skippable, (bits & 2) <> 0 AS qualified FROM maps")
def bitmap_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    skip, ok = blocks.check_bits(F.col("bits"), STATUS)
    return blocks.bitmap(_positioned(spark, sf_dir), "status_code").select("block_id", skip.alias("skippable"), ok.alias("qualified"))


@query(f"WITH {ZONES_SQL} SELECT coalesce(min(block_id), -1) AS first_block, coalesce(max(block_id), -1) AS last_block FROM zones WHERE min_month_code <= 31 AND max_month_code >= 30")
def qualified_block_range(spark: SparkSession, sf_dir: str) -> DataFrame:
    return blocks.block_range(blocks.zone_map(_positioned(spark, sf_dir), "month_code"), MONTH_RANGE)


@query(f"WITH {ZONES_SQL} SELECT block_id, min_o_totalprice >= 400000 AS skippable FROM zones WHERE max_o_totalprice >= 400000")
def qualified_blocks_range(spark: SparkSession, sf_dir: str) -> DataFrame:
    return blocks.qualified(blocks.zone_map(_positioned(spark, sf_dir), "o_totalprice"), PRICE_RANGE)


@query(f"WITH {BITS_SQL} SELECT block_id, bits = 2 AS skippable FROM maps WHERE (bits & 2) <> 0")
def qualified_blocks_exact(spark: SparkSession, sf_dir: str) -> DataFrame:
    return blocks.qualified(blocks.bitmap(_positioned(spark, sf_dir), "status_code"), STATUS)


@query(f"""WITH {ZONES_SQL}, {BITS_SQL.split('), ', 1)[1].split('), ', 1)[1]}, counts AS (
  SELECT 'month' AS filter, count(*) AS blocks FROM zones WHERE min_month_code <= 31 AND max_month_code >= 30
  UNION ALL SELECT 'price', count(*) FROM zones WHERE max_o_totalprice >= 400000
  UNION ALL SELECT 'status', count(*) FROM maps WHERE (bits & 2) <> 0
) SELECT filter, blocks, row_number() OVER (ORDER BY blocks, filter)::INTEGER AS rank FROM counts""")
def filter_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = _positioned(spark, sf_dir)
    zones = blocks.zone_map(p, "month_code", "o_totalprice")
    return blocks.filter_order([("month", zones, MONTH_RANGE), ("price", zones, PRICE_RANGE), ("status", blocks.bitmap(p, "status_code"), STATUS)])


def _runs_sql(column: str, cap: str = "") -> str:
    """Runs of a column inside blocks; cap: what cuts a run by a row's place in it."""
    return POSITIONED_SQL + f""", marked AS (
  SELECT block_id, position, {column}, CASE WHEN lag({column}) OVER w IS DISTINCT FROM {column} THEN 1 ELSE 0 END AS new FROM blocked WINDOW w AS (PARTITION BY block_id ORDER BY position)
), islands AS (
  SELECT *, sum(new) OVER (PARTITION BY block_id ORDER BY position) AS run FROM marked
), parts AS (
  SELECT *, (position - min(position) OVER (PARTITION BY block_id, run)) {cap or "* 0"} AS part FROM islands
), runs AS (
  SELECT block_id, min(position) AS start, count(*) AS run_length, min({column}) AS value FROM parts GROUP BY block_id, run, part
), counted AS (SELECT block_id, sum(CASE WHEN run_length = 1 THEN 1 ELSE 2 END)::BIGINT AS entries FROM runs GROUP BY block_id)"""


RUNS_SQL = _runs_sql("status_code", "// 128")
OFFSETS_SQL = "coalesce(sum(entries) OVER (ORDER BY block_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT"


@query(f"WITH {RUNS_SQL} SELECT * FROM runs")
def rle_encode(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rle.encode(_positioned(spark, sf_dir), "status_code", cap=rle.CAP)


@query(f"WITH {_runs_sql('step')} SELECT * FROM runs")
def rle_encode_double(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Runs of a column of eight bytes, which only a block's end cuts."""
    return rle.encode(_positioned(spark, sf_dir), "step")


@query(f"WITH {_runs_sql('o_orderpriority')} SELECT * FROM runs")
def rle_encode_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rle.encode(_positioned(spark, sf_dir), "o_orderpriority")


@query(f"WITH {POSITIONED_SQL} SELECT block_id, position, status_code AS value FROM blocked")
def rle_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rle.decode(rle.encode(_positioned(spark, sf_dir), "status_code", cap=rle.CAP))


@query(f"WITH {RUNS_SQL} SELECT block_id, entries, {OFFSETS_SQL} AS byte_offset FROM counted")
def offset_map(spark: SparkSession, sf_dir: str) -> DataFrame:
    runs = rle.encode(_positioned(spark, sf_dir), "status_code", cap=rle.CAP)
    return blocks.offsets(rle.entries(runs), width=1)


@query(f"WITH {_runs_sql('step')} SELECT block_id, entries, 8 * {OFFSETS_SQL} AS byte_offset FROM counted")
def offset_map_double(spark: SparkSession, sf_dir: str) -> DataFrame:
    return blocks.offsets(rle.entries(rle.encode(_positioned(spark, sf_dir), "step")), width=8)


@query(f"WITH {POSITIONED_SQL} SELECT position, 'month_code' AS field, month_code::DOUBLE AS value FROM positioned UNION ALL SELECT position, 'o_totalprice', o_totalprice FROM positioned")
def column_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each column by itself, aligned by position (S14). Parquet stores them so; here they are rows."""
    pieces = F.array(*[F.struct(F.lit(c).alias("field"), F.col(c).cast("double").alias("value")) for c in ("month_code", "o_totalprice")])
    return _positioned(spark, sf_dir).select("position", F.inline(pieces))


@query(f"""WITH r AS (SELECT {PRICES_SQL} FROM lineitem WHERE {WHERE_SQL})
SELECT 0 AS ordinal, 'min_price' AS metric, min_price AS value FROM r UNION ALL SELECT 1, 'avg_price', avg_price FROM r
UNION ALL SELECT 2, 'stddev_price', stddev_price FROM r UNION ALL SELECT 3, 'min_price_per_area', min_price_per_area FROM r""")
def result_long_form(spark: SparkSession, sf_dir: str) -> DataFrame:
    return long_form(flagship_metrics(spark, sf_dir))


def _code() -> Column:
    return F.format_string("U%07dG", F.col("o_orderkey"))


@query("""WITH c AS (SELECT o_orderkey, printf('U%07dG', o_orderkey) AS code FROM orders), d AS (
  SELECT *, substr(code, length(code) - 1, 1)::INTEGER AS y, substr(code, length(code) - 2, 1)::INTEGER AS m FROM c
), e AS (SELECT *, CASE WHEN y >= 4 THEN y + 2010 ELSE y + 2020 END AS year, CASE WHEN m = 0 THEN 10 ELSE m END AS month FROM d)
SELECT o_orderkey, year, month, (year - 2014) * 12 + month - 1 AS month_code, m AS town_code FROM e""")
def code_to_params(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _table(spark, sf_dir, "orders").select("o_orderkey", _code().alias("code")).select("o_orderkey", *parse_columns(F.col("code")))


@query("SELECT p_partkey, (strlen(p_name) + strlen(p_brand) + strlen(p_type) + 3)::INTEGER AS bytes FROM part")
def record_width(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bytes of a record's line."""
    return _table(spark, sf_dir, "part").select("p_partkey", line_bytes([F.col(c) for c in ("p_name", "p_brand", "p_type")]).alias("bytes"))


@query(f"SELECT {PRICES_SQL} FROM lineitem WHERE {WHERE_SQL}")
def store_flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The flagship query over a store that is built first: encoded, clustered by month and flag, pruned when read."""
    rows = _lineitem(spark, sf_dir).select(month_ordinal(F.col("l_shipdate"), EPOCH).alias("month_code"), encode(F.col("l_returnflag"), FLAGS).alias("flag_code"), "l_quantity", "l_extendedprice")
    path = folder(spark, "lineitem")
    store.write(rows, path, order=("month_code", "flag_code"))
    return Query([Range("month_code", 30, 31), Exact("flag_code", 2), AREA], _prices()).run(store.read(spark, path))


def _fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as records of ten fields of text, with o_orderkey; every coded field takes all values of its dictionary."""
    o, c = F.col("o_orderkey"), F.col("o_custkey")
    month = F.date_format(F.make_date(F.year("o_orderdate") + 20, F.month("o_orderdate"), F.lit(1)), "yyyy-MM")
    fields = {
        "month": month, "town": decode(c % len(TOWNS), TOWNS), "flat_type": decode(o % len(FLAT_TYPES), FLAT_TYPES), "block": (o % 1000).cast("string"),
        "street_name": F.concat(F.lit("ÉST "), (c % 50).cast("string")), "storey_range": decode(c % len(STOREYS), STOREYS), "floor_area_sqm": (o % 480 / 4 + 30).cast("string"),
        "flat_model": decode(o % len(FLAT_MODELS), FLAT_MODELS), "lease_commence_date": (F.lit(1966) + c % 57).cast("string"), "resale_price": F.col("o_totalprice").cast("string"),
    }
    return _table(spark, sf_dir, "orders").select("o_orderkey", *[fields[f.name].alias(f.name) for f in FIELDS])


FIELDS_SQL = f"""fields AS (
  SELECT o_orderkey, strftime(o_orderdate + INTERVAL 20 YEAR, '%Y-%m') AS month, {_list(TOWNS)}[o_custkey % 26 + 1] AS town, {_list(FLAT_TYPES)}[o_orderkey % 7 + 1] AS flat_type,
         (o_orderkey % 1000)::VARCHAR AS block, 'ÉST ' || (o_custkey % 50) AS street_name, {_list(STOREYS)}[o_custkey % 17 + 1] AS storey_range, o_orderkey % 480 / 4.0::DOUBLE + 30 AS floor_area_sqm,
         {_list(FLAT_MODELS)}[o_orderkey % 21 + 1] AS flat_model, (1966 + o_custkey % 57)::VARCHAR AS lease_commence_date, o_totalprice AS resale_price, o_custkey, o_orderdate
  FROM orders
)"""
_NAMES = ", ".join(f.name for f in FIELDS)


def _record_files(spark: SparkSession, sf_dir: str) -> list[str]:
    """Folders of record files: good lines, lines with a bad number, and lines of nine and of eleven fields."""
    names, kind = [f.name for f in FIELDS], F.col("o_orderkey") % 13
    rows = _fields(spark, sf_dir).withColumn("floor_area_sqm", F.when(kind == 3, F.lit("-1")).when(kind == 4, F.lit("80 m")).otherwise(F.col("floor_area_sqm")))
    parts = [(kind > 2, names), (kind == 0, names), (kind == 1, names[:9]), (kind == 2, [*names, F.lit("more").alias("more")])]
    paths = []
    for keep, columns in parts:
        paths.append(folder(spark, "records"))
        rows.where(keep).select(*columns).write.option("header", True).csv(paths[-1])
    return paths


@query(f"WITH {FIELDS_SQL} SELECT {_NAMES} FROM fields WHERE o_orderkey % 13 NOT IN (1, 2, 3, 4)")
def record_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Record files read, headers skipped, malformed lines dropped, numbers typed."""
    return records.read(spark, _record_files(spark, sf_dir))


@query("SELECT CASE WHEN o_orderkey % 13 IN (1, 2) THEN 'arity' ELSE 'floor_area_sqm' END AS reason, count(*) AS records FROM orders WHERE o_orderkey % 13 IN (1, 2, 3, 4) GROUP BY 1")
def record_rejects(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Why lines were dropped: fields too few or too many, and numbers that are none (V1)."""
    return records.rejects(records.read_raw(spark, _record_files(spark, sf_dir)))


@query(f"""WITH {FIELDS_SQL}, written AS (SELECT *, printf('%.2f', floor_area_sqm) AS a, printf('%.2f', resale_price) AS p FROM fields)
SELECT concat_ws(',', month, town, flat_type, block, street_name, storey_range,
  CASE WHEN a[-2] = '0' THEN printf('%.0f', floor_area_sqm) WHEN a[-1] = '0' THEN a[:-2] ELSE a END, flat_model, lease_commence_date,
  CASE WHEN p[-2] = '0' THEN printf('%.0f', resale_price) WHEN p[-1] = '0' THEN p[:-2] ELSE p END) AS line FROM written""")
def record_sink(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Typed records written as delimited text, and the lines of the files."""
    path = folder(spark, "sink")
    rows = _fields(spark, sf_dir)
    records.write(rows.withColumns({c: F.col(c).cast("double") for c in ("floor_area_sqm", "resale_price")}), path)
    header = ",".join(f.name for f in FIELDS)
    return spark.read.text(path).where(F.col("value") != header).select(F.col("value").alias("line"))


def _built(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A store built from record files, and records appended to it afterwards."""
    raw, path = folder(spark, "records"), folder(spark, "store")
    rows = _fields(spark, sf_dir)
    first = F.col("o_orderkey") % 3 > 0
    rows.where(first).drop("o_orderkey").write.option("header", True).csv(raw)
    store.build(spark, raw, path)
    more = records.validated(rows.where(~first).drop("o_orderkey"))
    store.write(store.encoded(more), path, mode="append")
    return store.read(spark, path)


@query(f"""WITH {FIELDS_SQL} SELECT ((year(o_orderdate) + 6) - 2000) * 12 + month(o_orderdate) - 1 AS month_code, o_custkey % 26 AS town_code, o_orderkey % 7 AS flat_type_code, block, street_name,
  o_custkey % 17 AS storey_range_code, floor_area_sqm, o_orderkey % 21 AS flat_model_code, o_custkey % 57 AS lease_commence_date_code, resale_price FROM fields""")
def store_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a built and then extended store holds: codes, doubles and text."""
    return _built(spark, sf_dir).select(*[F.col(f.stored).cast("long").alias(f.stored) if f.coded else F.col(f.stored) for f in FIELDS])


@query(f"WITH {FIELDS_SQL} SELECT {_NAMES} FROM fields")
def store_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The records that a built and then extended store gives back."""
    return store.decoded(_built(spark, sf_dir))
