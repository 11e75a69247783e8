"""Bulk loaders: the public benchmarks' tables as the engine stores them, made by the executors or read from `!`-separated files."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..catalog import Engine
from .tables import read_separated, write_separated

# Tables, their columns in storage order, and primary keys.
TPCH = {
    "region": ("r_regionkey int, r_name char(25), r_comment char(152)", "r_regionkey"),
    "nation": ("n_nationkey int, n_name char(25), n_regionkey int, n_comment char(152)", "n_nationkey"),
    "part": ("p_partkey int, p_name char(55), p_mfgr char(25), p_brand char(10), p_type char(25), p_size int, p_container char(10), p_retailprice float, p_comment char(23)", "p_partkey"),
    "customer": ("c_mktsegment char(10), c_id int, c_nationkey int, c_custkey int, c_name char(25), c_address char(40), c_phone char(15), c_acctbal float, c_comment char(117)", "c_mktsegment, c_id"),
    "orders": ("o_orderdate char(10), o_id int, o_orderkey int, o_custkey int, o_orderstatus char(1), o_totalprice float, o_orderpriority char(15), o_clerk char(15), o_shippriority int, o_comment char(79)", "o_orderdate, o_id"),
    "supplier": ("s_nationkey int, s_suppkey int, s_name char(25), s_address char(40), s_phone char(15), s_acctbal float, s_comment char(101)", "s_nationkey, s_suppkey"),
    "partsupp": ("ps_partkey int, ps_suppkey int, ps_availqty int, ps_supplycost float, ps_comment char(199)", "ps_partkey, ps_suppkey"),
    "lineitem": ("l_shipdate char(10), l_id int, l_orderkey int, l_linenumber int, l_partkey int, l_suppkey int, l_quantity float, l_extendedprice float, l_discount float, l_tax float, l_returnflag char(1), l_linestatus char(1), l_commitdate char(11), l_receiptdate char(11), l_shipinstruct char(25), l_shipmode char(10), l_comment char(4)", "l_shipdate, l_id"),
}
STAR = {
    "customer": ("c_custkey int, c_name char(25), c_address char(25), c_city char(10), c_nation char(15), c_region char(12), c_phone char(15), c_mktsegment char(10), c_paymentcnt int", "c_custkey"),
    "supplier": ("s_suppkey int, s_name char(25), s_address char(25), s_city char(10), s_nation char(15), s_region char(12), s_phone char(15), s_ytd float", "s_suppkey"),
    "part": ("p_partkey int, p_name char(22), p_mfgr char(6), p_category char(7), p_brand1 char(9), p_color char(11), p_type char(25), p_size int, p_container char(10), p_price float", "p_partkey"),
    "date": ("d_datekey int, d_date char(18), d_dateofweek char(9), d_month char(9), d_year int, d_yearmonthnum int, d_yearmonth char(7), d_daynuminweek int, d_daynuminmonth int, d_daynuminyear int, d_monthnuminyear int, d_weeknuminyear int", "d_datekey"),
    "lineorder": ("lo_orderdate int, lo_orderkey int, lo_linenumber int, lo_custkey int, lo_partkey int, lo_suppkey int, lo_ordpriority char(15), lo_shippriority char(1), lo_quantity int, lo_extendedprice float, lo_discount int, lo_revenue float, lo_supplycost float, lo_tax int, lo_commitdate int, lo_shipmode char(10)", "lo_orderdate, lo_orderkey, lo_linenumber"),
}
TEST = {"test_table": ("id int, name char(4), score float", "id, name")}
SEGMENTS = ("AUTOMOBILE", "BUILDING", "FURNITURE", "HOUSEHOLD", "MACHINERY")
REGIONS = ("AFRICA", "AMERICA", "ASIA", "EUROPE", "MIDDLE EAST")


def drawn(name: str, most: int, key: Column | None = None) -> Column:
    """A number from 0 to most - 1 that follows from a column's name and a row's id."""
    return F.pmod(F.xxhash64(F.lit(name), F.col("id") if key is None else key), F.lit(most))


def month(name: str, key: Column | None = None) -> Column:
    """A first of a month from 1992-01 to 1998-12."""
    return F.date_format(F.add_months(F.to_date(F.lit("1992-01-01")), drawn(name, 84, key).cast("int")), "yyyy-MM-dd")


def one_of(values: tuple[str, ...], at: Column) -> Column:
    return F.element_at(F.array(*[F.lit(v) for v in values]), (at + 1).cast("int"))


def made(rows: DataFrame, spec: str, **given: Column) -> DataFrame:
    """Rows (id) as the spec's columns: those given, else numbers and words that follow from name and id."""
    out = []
    for text in re.split(r",\s*(?![^(]*\))", spec):
        name, kind = text.split()
        if name in given:
            c = given[name]
        elif kind.startswith("char"):
            c = F.concat(F.lit(f"{name.split('_', 1)[-1]}#"), F.col("id").cast("string"))
        else:
            c = drawn(name, 1000) / (1 if kind == "int" else 10)
        out.append((F.substring(c, 1, int(kind[5:-1])) if kind.startswith("char") else c.cast(kind)).alias(name))
    return rows.select(*out)


def tpch(spark: SparkSession, scale: float) -> dict[str, DataFrame]:
    """The eight tables: per unit of scale 200,000 parts, 150,000 customers, 1,500,000 orders and 10,000 suppliers; 4 suppliers a part, 4 lines an order."""
    parts, customers, orders, suppliers = (max(1, round(n * scale)) for n in (200_000, 150_000, 1_500_000, 10_000))
    i = F.col("id")
    given = {
        "region": dict(r_regionkey=i, r_name=one_of(REGIONS, i)),
        "nation": dict(n_nationkey=i, n_name=F.concat(F.lit("NATION_"), i), n_regionkey=i % 5),
        "part": dict(p_partkey=i + 1, p_size=drawn("p_size", 50) + 1, p_brand=F.concat(F.lit("Brand#"), drawn("brand", 25) + 11)),
        "customer": dict(c_mktsegment=one_of(SEGMENTS, drawn("segment", 5)), c_id=i + 1, c_custkey=i + 1, c_nationkey=drawn("c_nation", 25)),
        "orders": dict(o_orderdate=month("o_date"), o_id=i + 1, o_orderkey=i + 1, o_custkey=drawn("o_cust", customers) + 1, o_shippriority=F.lit(0)),
        "supplier": dict(s_nationkey=drawn("s_nation", 25), s_suppkey=i + 1),
        "partsupp": dict(ps_partkey=F.floor(i / 4) + 1, ps_suppkey=(F.floor(i / 4) + (i % 4) * max(1, suppliers // 4)) % suppliers + 1),
        "lineitem": dict(
            l_shipdate=month("l_date"), l_id=i + 1, l_orderkey=F.floor(i / 4) + 1, l_linenumber=i % 4 + 1, l_partkey=drawn("l_part", parts) + 1, l_suppkey=drawn("l_supp", suppliers) + 1,
            l_quantity=drawn("l_quantity", 50) + 1, l_discount=drawn("l_discount", 11) / 100, l_tax=drawn("l_tax", 9) / 100, l_returnflag=one_of(("A", "N", "R"), drawn("flag", 3)), l_linestatus=one_of(("F", "O"), drawn("status", 2)),
        ),
    }
    counts = {"region": 5, "nation": 25, "part": parts, "customer": customers, "orders": orders, "supplier": suppliers, "partsupp": parts * min(4, suppliers), "lineitem": orders * 4}
    return {name: made(spark.range(counts[name]), spec, **given[name]) for name, (spec, _) in TPCH.items()}


def star(spark: SparkSession, scale: float) -> dict[str, DataFrame]:
    """Customer, supplier, part, date (seven years of days) and lineorder (4 lines an order)."""
    parts, customers, orders, suppliers = (max(1, round(n * scale)) for n in (200_000, 30_000, 1_500_000, 2_000))
    i = F.col("id")
    day = F.date_add(F.to_date(F.lit("1992-01-01")), F.col("id").cast("int"))
    order_day = F.date_format(F.date_add(F.to_date(F.lit("1992-01-01")), drawn("lo_day", 2556, F.floor(i / 4)).cast("int")), "yyyyMMdd")
    where = lambda p: {f"{p}_region": one_of(REGIONS, drawn(p, 5)), f"{p}_nation": F.concat(F.lit("NATION_"), drawn(p, 25))}
    given = {
        "customer": dict(c_custkey=i + 1, c_mktsegment=one_of(SEGMENTS, drawn("segment", 5)), c_paymentcnt=F.lit(0), **where("c")),
        "supplier": dict(s_suppkey=i + 1, s_ytd=F.lit(0), **where("s")),
        "part": dict(p_partkey=i + 1, p_mfgr=F.concat(F.lit("MFGR#"), drawn("m", 5) + 1), p_category=F.concat(F.lit("MFGR#"), drawn("m", 5) + 1, drawn("c", 5) + 1)),
        "date": dict(
            d_datekey=F.date_format(day, "yyyyMMdd"), d_date=F.date_format(day, "MMMM d, yyyy"), d_dateofweek=F.date_format(day, "EEEE"), d_month=F.date_format(day, "MMMM"), d_year=F.year(day), d_yearmonthnum=F.date_format(day, "yyyyMM"),
            d_yearmonth=F.date_format(day, "MMMyyyy"), d_daynuminweek=F.dayofweek(day), d_daynuminmonth=F.dayofmonth(day), d_daynuminyear=F.dayofyear(day), d_monthnuminyear=F.month(day), d_weeknuminyear=F.weekofyear(day),
        ),
        "lineorder": dict(
            lo_orderdate=order_day, lo_orderkey=F.floor(i / 4) + 1, lo_linenumber=i % 4 + 1, lo_custkey=drawn("lo_cust", customers, F.floor(i / 4)) + 1, lo_partkey=drawn("lo_part", parts) + 1, lo_suppkey=drawn("lo_supp", suppliers) + 1,
            lo_quantity=drawn("lo_quantity", 50) + 1, lo_discount=drawn("lo_discount", 11), lo_tax=drawn("lo_tax", 9), lo_commitdate=order_day,
        ),
    }
    counts = {"customer": customers, "supplier": suppliers, "part": parts, "date": 2556, "lineorder": orders * 4}
    return {name: made(spark.range(counts[name]), spec, **given[name]) for name, (spec, _) in STAR.items()}


def test_table(spark: SparkSession, rows: int) -> dict[str, DataFrame]:
    """The transaction tests' table: ids, the id as a name of four digits, and a score of 100."""
    return {"test_table": made(spark.range(rows), TEST["test_table"][0], id=F.col("id"), name=F.lpad((F.col("id") % 10_000).cast("string"), 4, "0"), score=F.lit(100.0))}


def load(engine: Engine, specs: dict[str, tuple[str, str]], tables: dict[str, DataFrame]) -> None:
    """Create the tables and load them, all in one transaction if one is open."""
    for name, df in tables.items():
        spec, key = specs[name]
        engine.sql(f"create table {name} ({spec}, primary key({key}))")
        engine.insert_rows(name, df)


def dump(tables: dict[str, DataFrame], folder: str, separator: str = "!") -> None:
    for name, df in tables.items():
        write_separated(df, f"{folder}/{name}", separator)


def load_files(engine: Engine, specs: dict[str, tuple[str, str]], folder: str, separator: str = "!") -> None:
    """Create the tables and load a folder of separated files for each."""
    for name, (spec, key) in specs.items():
        engine.sql(f"create table {name} ({spec}, primary key({key}))")
        engine.insert_rows(name, read_separated(engine.spark, f"{folder}/{name}", engine.schema(engine.entry(name)[1]), separator))
