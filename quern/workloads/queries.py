"""Queries over the supplied tables, with the same in ANSI SQL.

Tier A runs through the engine's own language, or its DataFrame surface; tier B
is SQL beyond that language.  Dates are shifted to the supplied range.
"""

from __future__ import annotations

import contextlib
import re
import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from ..catalog import Engine
from ..errors import EngineError, TransactionAborted
from ..functions.render import render
from ..operators.frames import build, gather
from ..plans.analyze import Scope, bind
from ..plans.lang import parse
from ..resume.sql import Killed, SqlRun
from ..resume.units import ResumableQuery
from ..sources.tables import CORE, bounds, parquet_table, parquet_tables, read_separated, write_separated
from ..streaming.changelog import read_state, replay, replay_stream, table_state
from .transactions import NEW_ORDERS_SQL, PAYMENT_COUNTS_SQL, PAYMENTS_SQL, new_orders, payment_counts, payments

Query = Callable[[SparkSession, str], DataFrame]


def spj(spark: SparkSession, folder: str, text: str) -> DataFrame:
    """A select statement of the engine's language over Parquet tables."""
    query = parse(text)
    names = {n.lower() for n in query.tables}
    frames = parquet_tables(spark, folder, [n for n in CORE if n in names])
    schemas = {n: f.schema for n, f in frames.items()}
    return build(bind(query, schemas), frames, Scope(schemas))


#: Tier A: statements of the engine's language; DuckDB runs the same text.
STATEMENTS = {
    "scan_full": "select * from nation",
    "scan_project": "select p_partkey, p_name from part",
    "scan_pk_point": "select * from orders where o_orderkey = 77",
    "scan_pk_prefix": "select l_orderkey, l_linenumber, l_quantity from lineitem where l_orderkey = 5",
    "scan_range_closed": "select o_orderkey, o_totalprice from orders where o_orderkey >= 100 and o_orderkey <= 200",
    "scan_range_open": "select o_orderkey, o_totalprice from orders where o_orderkey > 100 and o_orderkey < 200",
    "scan_range_half": "select o_orderkey, o_totalprice from orders where o_orderkey >= 100 and o_orderkey < 200",
    "scan_residual": "select o_orderkey, o_orderstatus from orders where o_orderkey < 500 and o_totalprice > 100000.",
    "filter_eq": "select s_suppkey, s_name from supplier where s_nationkey = 3",
    "filter_ne": "select n_nationkey, n_name from nation where n_nationkey <> 3",
    "filter_lt": "select s_suppkey from supplier where s_acctbal < 1000.",
    "filter_gt": "select s_suppkey from supplier where s_acctbal > 1000.",
    "filter_le": "select r_regionkey from region where r_regionkey <= 2",
    "filter_ge": "select r_regionkey from region where r_regionkey >= 2",
    "filter_string": "select c_custkey, c_mktsegment from customer where c_mktsegment >= 'B' and c_mktsegment < 'F'",
    "filter_col_col": "select l_orderkey, l_partkey, l_suppkey from lineitem where l_partkey = l_suppkey",
    "join_equi2": "select c_custkey, n_name from customer, nation where c_nationkey = n_nationkey",
    "join_keyword": "select s_suppkey, r_name from supplier join nation join region where s_nationkey = n_nationkey and n_regionkey = r_regionkey",
    "join_multikey": "select c_custkey, s_suppkey from customer, supplier where c_nationkey = s_nationkey and c_custkey = s_suppkey",
    "join_multikey2": "select o_orderkey, l_linenumber from orders, lineitem where o_orderkey = l_orderkey and o_custkey = l_partkey",
    "join_cross": "select r_name, n_name from region, nation",
    "join_theta": "select r_name, n_name from region, nation where r_regionkey < n_regionkey",
    "join_theta_equi": "select s_suppkey, c_custkey from supplier, customer where s_nationkey = c_nationkey and s_acctbal > c_acctbal",
    "join_chain6": "select o_orderkey, l_linenumber, p_brand, s_name, n_name from orders, lineitem, part, supplier, nation, region where o_orderkey = l_orderkey and l_partkey = p_partkey and l_suppkey = s_suppkey and s_nationkey = n_nationkey and n_regionkey = r_regionkey and r_regionkey = 1",
    "q1_spj": "select l_returnflag, l_linestatus, l_quantity, l_extendedprice, l_discount, l_tax from lineitem where l_shipdate <= '1998-09-01' order by l_returnflag",
    "q3_spj": "select l_orderkey, l_extendedprice, l_discount, o_orderdate from customer, orders, lineitem where c_mktsegment = 'BUILDING' and c_custkey = o_custkey and l_orderkey = o_orderkey and o_orderdate < '1995-03-01' and l_shipdate > '1995-03-01' order by l_orderkey",
    "q5_spj": "select n_name, l_extendedprice, l_discount from region, nation, supplier, customer, orders, lineitem where c_custkey = o_custkey and l_orderkey = o_orderkey and l_suppkey = s_suppkey and c_nationkey = s_nationkey and s_nationkey = n_nationkey and n_regionkey = r_regionkey and r_name = 'ASIA' and o_orderdate >= '1995-01-01' and o_orderdate < '1996-01-01' order by l_extendedprice desc",
    "q6_spj": "select l_extendedprice, l_discount from lineitem where l_shipdate >= '1995-01-01' and l_shipdate < '1996-01-01'",
    "q7_spj": "select n_name, l_shipdate, l_extendedprice, l_discount from nation, supplier, lineitem, orders, customer where s_suppkey = l_suppkey and o_orderkey = l_orderkey and c_custkey = o_custkey and s_nationkey = n_nationkey and c_nationkey = 16 and s_nationkey = 9 and l_shipdate <= '1997-12-01' order by l_shipdate",
    "q10_spj": "select c_custkey, c_name, l_extendedprice, l_discount, c_acctbal, n_name from customer, orders, lineitem, nation where c_custkey = o_custkey and l_orderkey = o_orderkey and c_nationkey >= 1 and c_nationkey <= 24 and o_orderdate >= '1996-10-01' and o_orderdate < '1997-01-01' and l_shipdate >= '1996-01-01' and l_shipdate < '1997-03-01' and c_nationkey = n_nationkey order by n_name desc",
}


def duck(text: str) -> str:
    """DuckDB wants a condition or a comma where the language lets JOIN stand alone."""
    return text.replace(" join ", ", ")


#: Tier B, in SQL that Spark and DuckDB both run.
REV = "l_extendedprice * (1 - l_discount)"
YEAR = "CAST(year(o_orderdate) AS INT)"
STAR = "lineitem JOIN orders ON l_orderkey = o_orderkey"
DIMS = f"{STAR} JOIN customer ON o_custkey = c_custkey JOIN nation cn ON c_nationkey = cn.n_nationkey JOIN region cr ON cn.n_regionkey = cr.r_regionkey JOIN supplier ON l_suppkey = s_suppkey JOIN nation sn ON s_nationkey = sn.n_nationkey JOIN region sr ON sn.n_regionkey = sr.r_regionkey"
PARTS = f"{STAR} JOIN part ON l_partkey = p_partkey JOIN supplier ON l_suppkey = s_suppkey JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey"
SQL = {
    "q1": f"SELECT l_returnflag, l_linestatus, round(sum(l_quantity), 2) AS sum_qty, round(sum(l_extendedprice), 2) AS sum_base, round(sum({REV}), 4) AS sum_disc, round(sum({REV} * (1 + l_tax)), 2) AS sum_charge, round(avg(l_quantity), 4) AS avg_qty, round(avg(l_discount), 4) AS avg_disc, count(*) AS n FROM lineitem WHERE l_shipdate <= TIMESTAMP '1998-09-01 00:00:00' GROUP BY l_returnflag, l_linestatus",
    "q2": "WITH best AS (SELECT l_partkey, min(l_extendedprice / l_quantity) AS cost FROM lineitem GROUP BY l_partkey) SELECT s_acctbal, s_name, n_name, p_partkey, round(cost, 6) AS cost FROM part JOIN lineitem ON p_partkey = lineitem.l_partkey JOIN best ON best.l_partkey = lineitem.l_partkey AND l_extendedprice / l_quantity = cost JOIN supplier ON s_suppkey = l_suppkey JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey WHERE p_size = 15 AND p_type LIKE '%S%' ORDER BY s_acctbal DESC, n_name, s_name, p_partkey, cost LIMIT 100",
    "q3": f"SELECT l_orderkey, round(sum({REV}), 4) AS revenue, o_orderdate FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON c_custkey = o_custkey WHERE c_mktsegment = 'BUILDING' AND o_orderdate < TIMESTAMP '1995-03-15 00:00:00' AND l_shipdate > TIMESTAMP '1995-03-15 00:00:00' GROUP BY l_orderkey, o_orderdate",
    "q4": "SELECT o_orderpriority, count(*) AS order_count FROM orders WHERE o_orderdate >= TIMESTAMP '1996-07-01 00:00:00' AND o_orderdate < TIMESTAMP '1996-07-01 00:00:00' + INTERVAL 3 MONTH AND EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey AND l_shipdate > o_orderdate) GROUP BY o_orderpriority",
    "q5": f"SELECT n_name, round(sum({REV}), 4) AS revenue FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON c_custkey = o_custkey JOIN supplier ON l_suppkey = s_suppkey AND c_nationkey = s_nationkey JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey WHERE r_name = 'ASIA' AND o_orderdate >= TIMESTAMP '1995-01-01 00:00:00' AND o_orderdate < TIMESTAMP '1997-01-01 00:00:00' GROUP BY n_name",
    "q6": "SELECT round(sum(l_extendedprice * l_discount), 4) AS revenue FROM lineitem WHERE l_shipdate >= TIMESTAMP '1995-01-01 00:00:00' AND l_shipdate < TIMESTAMP '1996-01-01 00:00:00' AND l_discount BETWEEN 0.05 AND 0.07 AND l_quantity < 24",
    "q7": f"SELECT n1.n_name AS supp_nation, n2.n_name AS cust_nation, CAST(year(l_shipdate) AS INT) AS l_year, round(sum({REV}), 4) AS revenue FROM lineitem JOIN supplier ON s_suppkey = l_suppkey JOIN orders ON o_orderkey = l_orderkey JOIN customer ON c_custkey = o_custkey JOIN nation n1 ON s_nationkey = n1.n_nationkey JOIN nation n2 ON c_nationkey = n2.n_nationkey WHERE ((n1.n_name = 'NATION_6' AND n2.n_name = 'NATION_7') OR (n1.n_name = 'NATION_7' AND n2.n_name = 'NATION_6')) GROUP BY n1.n_name, n2.n_name, year(l_shipdate)",
    "q10": f"SELECT c_custkey, c_name, round(sum({REV}), 4) AS revenue, c_acctbal, n_name FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON c_custkey = o_custkey JOIN nation ON c_nationkey = n_nationkey WHERE o_orderdate >= TIMESTAMP '1996-10-01 00:00:00' AND o_orderdate < TIMESTAMP '1996-10-01 00:00:00' + INTERVAL 3 MONTH AND l_returnflag = 'R' GROUP BY c_custkey, c_name, c_acctbal, n_name",
    "ssb_q1_1": f"SELECT round(sum(l_extendedprice * l_discount), 4) AS revenue FROM {STAR} WHERE {YEAR} = 1996 AND l_discount BETWEEN 0.01 AND 0.03 AND l_quantity < 25",
    "ssb_q1_2": f"SELECT round(sum(l_extendedprice * l_discount), 4) AS revenue FROM {STAR} WHERE {YEAR} = 1996 AND month(o_orderdate) = 1 AND l_discount BETWEEN 0.04 AND 0.06 AND l_quantity BETWEEN 26 AND 35",
    "ssb_q1_3": f"SELECT round(sum(l_extendedprice * l_discount), 4) AS revenue FROM {STAR} WHERE {YEAR} = 1996 AND month(o_orderdate) = 2 AND dayofmonth(o_orderdate) <= 14 AND l_discount BETWEEN 0.05 AND 0.07 AND l_quantity BETWEEN 26 AND 35",
    "ssb_q2_1": f"SELECT {YEAR} AS d_year, p_brand, round(sum({REV}), 4) AS revenue FROM {PARTS} WHERE r_name = 'AMERICA' GROUP BY {YEAR}, p_brand",
    "ssb_q2_2": f"SELECT {YEAR} AS d_year, p_brand, round(sum({REV}), 4) AS revenue FROM {PARTS} WHERE p_brand BETWEEN 'Brand#2' AND 'Brand#4' AND r_name = 'ASIA' GROUP BY {YEAR}, p_brand",
    "ssb_q2_3": f"SELECT {YEAR} AS d_year, p_brand, round(sum({REV}), 4) AS revenue FROM {PARTS} WHERE p_brand LIKE 'Brand#1%' AND r_name = 'EUROPE' GROUP BY {YEAR}, p_brand",
    "ssb_q3_1": f"SELECT cn.n_name AS c_nation, sn.n_name AS s_nation, {YEAR} AS d_year, round(sum({REV}), 4) AS revenue FROM {DIMS} WHERE cr.r_name = 'ASIA' AND sr.r_name = 'ASIA' AND {YEAR} BETWEEN 1995 AND 1998 GROUP BY cn.n_name, sn.n_name, {YEAR}",
    "ssb_q3_2": f"SELECT c_mktsegment, sn.n_name AS s_nation, {YEAR} AS d_year, round(sum({REV}), 4) AS revenue FROM {DIMS} WHERE cn.n_name = 'NATION_8' AND sr.r_name = 'ASIA' GROUP BY c_mktsegment, sn.n_name, {YEAR}",
    "ssb_q3_3": f"SELECT cn.n_name AS c_nation, sn.n_name AS s_nation, {YEAR} AS d_year, round(sum({REV}), 4) AS revenue FROM {DIMS} WHERE (cn.n_name = 'NATION_8' OR cn.n_name = 'NATION_9') AND (sn.n_name = 'NATION_8' OR sn.n_name = 'NATION_9') GROUP BY cn.n_name, sn.n_name, {YEAR}",
    "ssb_q3_4": f"SELECT cn.n_name AS c_nation, sn.n_name AS s_nation, CAST(month(o_orderdate) AS INT) AS d_month, round(sum({REV}), 4) AS revenue FROM {DIMS} WHERE (cn.n_name = 'NATION_8' OR cn.n_name = 'NATION_9') AND sr.r_name = 'ASIA' AND {YEAR} = 1997 GROUP BY cn.n_name, sn.n_name, month(o_orderdate)",
    "ssb_q4_1": f"SELECT {YEAR} AS d_year, cn.n_name AS c_nation, round(sum({REV} - p_retailprice), 4) AS profit FROM {DIMS} JOIN part ON l_partkey = p_partkey WHERE cr.r_name = 'AMERICA' AND sr.r_name = 'AMERICA' AND (p_size < 10 OR p_size > 40) GROUP BY {YEAR}, cn.n_name",
    "ssb_q4_2": f"SELECT {YEAR} AS d_year, sn.n_name AS s_nation, p_brand, round(sum({REV} - p_retailprice), 4) AS profit FROM {DIMS} JOIN part ON l_partkey = p_partkey WHERE cr.r_name = 'AMERICA' AND sr.r_name = 'AMERICA' AND ({YEAR} = 1997 OR {YEAR} = 1998) GROUP BY {YEAR}, sn.n_name, p_brand",
    "ssb_q4_3": f"SELECT {YEAR} AS d_year, s_name, p_brand, round(sum({REV} - p_retailprice), 4) AS profit FROM {DIMS} JOIN part ON l_partkey = p_partkey WHERE sn.n_name = 'NATION_2' AND ({YEAR} = 1997 OR {YEAR} = 1998) GROUP BY {YEAR}, s_name, p_brand",
    "hat_distinct": "SELECT DISTINCT c_mktsegment FROM customer",
    "hat_max": "SELECT max(o_orderkey) AS last_order FROM orders",
    "hat_count_distinct": "SELECT count(DISTINCT l_orderkey) AS n_orders FROM lineitem JOIN orders ON l_orderkey = o_orderkey WHERE o_orderdate >= TIMESTAMP '1996-01-01 00:00:00'",
    "hat_payment": "SELECT c_custkey, coalesce(n, 0) + 1 AS paymentcnt FROM customer LEFT JOIN (SELECT o_custkey, count(*) AS n FROM orders GROUP BY o_custkey) t ON o_custkey = c_custkey",
    "hat_freshness": "SELECT user_id, max(event_id) AS last_txn, count(*) AS txns FROM events GROUP BY user_id",
    "tpcc_delivery": "SELECT o_custkey, min(o_orderkey) AS oldest, round(sum(o_totalprice), 2) AS amount FROM orders WHERE o_orderstatus = 'O' GROUP BY o_custkey",
    "tpcc_order_status": "SELECT c_custkey, c_name, o_orderkey, l_linenumber, l_quantity FROM (SELECT o_custkey, max(o_orderkey) AS last_order FROM orders GROUP BY o_custkey) t JOIN customer ON c_custkey = t.o_custkey JOIN orders ON o_orderkey = last_order JOIN lineitem ON l_orderkey = o_orderkey",
    "tpcc_stock_level": "SELECT count(DISTINCT l_partkey) AS low_stock FROM lineitem WHERE l_orderkey BETWEEN 100 AND 300 AND l_quantity < 15",
}


def tier_b(text: str) -> Query:
    named = [n for n in CORE if re.search(rf"\b{n}\b", text)]

    def run(spark: SparkSession, folder: str) -> DataFrame:
        for name, df in parquet_tables(spark, folder, named).items():
            df.createOrReplaceTempView(name)
        return spark.sql(text)

    return run


def places(spark: SparkSession, rows: DataFrame) -> DataFrame:
    """Rows with the places in which they are delivered: partitions in order, rows in order within."""
    path = place(spark, "sorted")
    rows.withColumn("at", F.monotonically_increasing_id()).write.parquet(path)
    held = spark.read.schema(T.StructType([*rows.schema.fields, T.StructField("at", T.LongType())])).parquet(path).withColumn("part", F.shiftright("at", 33))
    before, starts = 0, []
    for part, n in sorted(map(tuple, held.groupBy("part").count().collect())):  # a row a partition
        starts.append((part, before))
        before += n
    starts = F.broadcast(spark.createDataFrame(starts, "part long, before long"))
    return held.join(starts, "part").select(*rows.columns, (F.col("before") + F.col("at").bitwiseAND(F.lit((1 << 33) - 1)) + 1).alias("place"))


def delivered(desc: bool) -> Query:
    def run(spark: SparkSession, folder: str) -> DataFrame:
        return places(spark, spj(spark, folder, "select o_totalprice from orders order by o_totalprice" + " desc" * desc))

    return run


def gather_parallel(spark: SparkSession, folder: str) -> DataFrame:
    """A scan in four ranges of the key, with the order in which they are gathered."""
    rows = spj(spark, folder, "select o_orderkey, o_custkey from orders where o_totalprice > 1000.")
    return places(spark, gather(rows, "o_orderkey", 4))


def column_bounds(spark: SparkSession, folder: str) -> DataFrame:
    low, high = bounds(parquet_table(spark, f"{folder}/orders.parquet"), "o_orderkey")
    return spark.createDataFrame([(low, high)], "low long, high long")


def log_replay_latest(spark: SparkSession, folder: str) -> DataFrame:
    log = parquet_table(spark, f"{folder}/events.parquet").select("user_id", "event_id", "event_type", "value")
    return replay(log, ["user_id"], "event_id")


def place(spark: SparkSession, what: str) -> str:
    """A new folder under the one that driver and executors share; one of our own only where all run in one process."""
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not root:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir has to name a folder that all executors share")
        root = tempfile.mkdtemp(prefix="quern-")
    return f"{root.rstrip('/')}/{what}-{uuid.uuid4().hex[:12]}"


def region_engine(spark: SparkSession, folder: str) -> Engine:
    """A database with copies of region and nation."""
    engine = Engine.create(spark, place(spark, "db"))
    engine.sql("create table region (r_regionkey int, r_name char(25), primary key(r_regionkey))")
    engine.sql("create table nation (n_nationkey int, n_name char(25), n_regionkey int, primary key(n_nationkey))")
    for name in ("region", "nation"):
        engine.insert_rows(name, parquet_table(spark, f"{folder}/{name}.parquet"))
    return engine


def after(*statements: str, then: str = "select * from nation") -> Query:
    def run(spark: SparkSession, folder: str) -> DataFrame:
        engine = region_engine(spark, folder)
        for s in statements:
            engine.sql(s)
        return engine.sql(then)

    return run


def dml_log_state(spark: SparkSession, folder: str) -> DataFrame:
    """The state that replay of the engine's own log gives."""
    engine = region_engine(spark, folder)
    for s in ("update nation set n_name = 'RENAMED' where n_regionkey = 2", "delete from nation where n_nationkey < 3", "insert into nation values (99, 'NEW', 0)"):
        engine.sql(s)
    return table_state(engine.change_log(), "nation", "n_nationkey int, n_name string, n_regionkey int")


def snapshot_read(spark: SparkSession, folder: str) -> DataFrame:
    """An older version stays readable after later statements."""
    engine = region_engine(spark, folder)
    version = engine.version
    engine.sql("delete from nation where n_nationkey >= 0")
    return engine.table("nation", version)


def resume_units(spark: SparkSession, folder: str) -> DataFrame:
    """Killed after two of five units, resumed by a second run object; partial sums are merged."""
    def partial(df: DataFrame) -> DataFrame:
        return df.groupBy("l_returnflag").agg(F.sum("l_quantity").alias("q"), F.count("*").alias("n"))

    def merge(df: DataFrame) -> DataFrame:
        return df.groupBy("l_returnflag").agg(F.round(F.sum("q"), 2).alias("sum_qty"), F.sum("n").alias("n"))

    root, source = place(spark, "run"), parquet_table(spark, f"{folder}/lineitem.parquet")
    make = lambda: ResumableQuery(spark, root, "returnflag sums", source, "l_orderkey", partial, 5, merge)
    make().run(most=2)
    return make().result()


def resume_dates(spark: SparkSession, folder: str) -> DataFrame:
    root, source = place(spark, "run"), parquet_table(spark, f"{folder}/orders.parquet")
    query = lambda df: df.where("o_totalprice > 200000").select("o_orderkey", "o_totalprice")
    ResumableQuery(spark, root, "large orders", source, "o_orderdate", query, 4).run(most=1)
    return ResumableQuery(spark, root, "large orders", source, "o_orderdate", query, 4).result()


#: A statement of three joins and a sort, for runs that are cut off and gone on with.
LONG = "select l_orderkey, l_linenumber, l_quantity, n_name from lineitem, orders, customer, nation where l_orderkey = o_orderkey and o_custkey = c_custkey and c_nationkey = n_nationkey order by n_name"


def resumed(policy: dict, stop: tuple[int, int]) -> Query:
    """The driver is lost after an operator of a unit; another one opens the folder, with neither text nor plan in hand, and ends the run."""
    def run(spark: SparkSession, folder: str) -> DataFrame:
        root = place(spark, "run")
        with contextlib.suppress(Killed):
            SqlRun(spark, root, LONG, {"folder": folder}, 3, policy).run(stop)
        return SqlRun(spark, root).result().groupBy("n_name").agg(F.round(F.sum("l_quantity"), 2).alias("sum_qty"), F.count("*").alias("n"))

    return run


def resume_sort(spark: SparkSession, folder: str) -> DataFrame:
    """Lost after the sort; the second driver delivers the places that the first one wrote."""
    root = place(spark, "run")
    SqlRun(spark, root, "select o_totalprice, o_orderkey from orders where o_orderkey > 0 order by o_totalprice desc", {"folder": folder}, 2).result()
    return SqlRun(spark, root).result()


def resume_pinned(spark: SparkSession, folder: str) -> DataFrame:
    """The run reads the version it began with, whatever is committed between loss and resumption."""
    engine, root = region_engine(spark, folder), place(spark, "run")
    with contextlib.suppress(Killed):
        SqlRun(spark, root, "select n_nationkey, n_name, r_name from nation, region where n_regionkey = r_regionkey", {"database": engine.store.root}, 3).run((0, 1))
    engine.sql("delete from nation where n_nationkey >= 0")
    return SqlRun(spark, root).result()


#: Tables in the order in which a join tree takes them: (table, its key, the key it meets).
TREE = (("nation", "n_regionkey", "r_regionkey"), ("supplier", "s_nationkey", "n_nationkey"), ("lineitem", "l_suppkey", "s_suppkey"), ("orders", "o_orderkey", "l_orderkey"), ("customer", "c_custkey", "o_custkey"), ("part", "p_partkey", "l_partkey"))
#: Beyond those, tables with a unique key come round again and meet their own key.
AGAIN = (("region", "r_regionkey"), ("nation", "n_nationkey"), ("supplier", "s_suppkey"), ("orders", "o_orderkey"), ("customer", "c_custkey"), ("part", "p_partkey"))


def join_tree(frames: dict[str, DataFrame], joins: int, every: int = 8) -> DataFrame:
    """A left-deep tree of so many joins, region first, sorted by r_regionkey; after `every` joins a projection drops all but the keys."""
    keys = {k for _, a, b in TREE for k in (a, b)} | {"l_linenumber"}
    out = frames["region"]
    for k in range(joins):
        if k < len(TREE):
            table, key, met = TREE[k]
            on = F.col(key) == F.col(met)
            out = frames[table].join(out, on) if table == "lineitem" else out.join(frames[table], on)  # what is joined to the largest table is what a join builds
        else:
            table, key = AGAIN[(k - len(TREE)) % len(AGAIN)]
            again = frames[table].select(*[F.col(c).alias(f"{c}_{k}") for c in frames[table].columns])
            out = out.join(again, F.col(key) == F.col(f"{key}_{k}"))
        if (k + 1) % every == 0:
            out = out.select(*[c for c in out.columns if c in keys])
    return out.orderBy("r_regionkey")


def joins(count: int) -> Query:
    def run(spark: SparkSession, folder: str) -> DataFrame:
        frames = parquet_tables(spark, folder, ["region", *[t for t, _, _ in TREE]])
        return join_tree(frames, count).groupBy("r_regionkey").agg(F.count("*").alias("n"), F.sum("l_linenumber").alias("numbers"))

    return run


def log_after_failures(spark: SparkSession, folder: str) -> DataFrame:
    """Failed statements of a transaction leave no trace: the replayed log is the table."""
    engine = region_engine(spark, folder)
    engine.sql("begin")
    for text in ("update nation set n_nationkey = 2 where n_nationkey = 1", "insert into nation values (3, 'TWICE', 0)", "insert into nation values (200, 'a name that is longer than its column', 0)"):
        with contextlib.suppress(EngineError):
            engine.sql(text)
    engine.sql("insert into nation values (100, 'NEW', 4)")
    engine.sql("update nation set n_nationkey = n_nationkey + 300 where n_regionkey = 1")
    engine.sql("commit")
    with contextlib.suppress(EngineError):
        engine.sql("update nation set n_nationkey = 100 where n_nationkey = 0")
    return table_state(engine.change_log(), "nation", "n_nationkey int, n_name string, n_regionkey int")


def txn_resume(spark: SparkSession, folder: str) -> DataFrame:
    """The driver is lost inside a transaction; another one goes on from what the first had staged, and commits."""
    engine = region_engine(spark, folder)
    engine.sql("begin")
    engine.sql("delete from nation where n_regionkey = 3")
    ticket = engine.save()
    engine.sql("insert into nation values (100, 'NEW', 4)")
    second = Engine(spark, engine.store.root)
    second.resume(ticket)
    second.sql("update nation set n_name = 'LATE' where n_nationkey = 100")
    second.sql("commit")
    return second.sql("select * from nation")


def read_own_lsn(spark: SparkSession, folder: str) -> DataFrame:
    """A reader waits for the log sequence number of the writer's commit, then reads that version."""
    writer = region_engine(spark, folder)
    reader = Engine(spark, writer.store.root)
    writer.sql("delete from nation where n_regionkey = 0")
    return reader.table("nation", reader.wait_for(writer.last_lsn()))


def stream_replay(spark: SparkSession, folder: str) -> DataFrame:
    """The events as a log in three files, out of order, replayed as a stream: each user's last event, users whose last is a purchase deleted."""
    log, state, at = place(spark, "log"), place(spark, "state"), place(spark, "at")
    schema = "user_id long, event_id long, event_type string, value double"
    events = parquet_table(spark, f"{folder}/events.parquet").select("user_id", "event_id", "event_type", "value")
    for k in (2, 0, 1):
        events.where(F.pmod("event_id", F.lit(3)) == k).coalesce(2).write.mode("append").parquet(log)
        replay_stream(spark, log, state, at, ["user_id"], "event_id", schema).awaitTermination()
    return read_state(spark, state, schema, "event_type", "purchase")


def freshness(spark: SparkSession, folder: str) -> DataFrame:
    """How old what a replica lacks is, for a read at each event, where the log is replayed by hundreds; the nearest-rank p95, and the worst."""
    first = Window.partitionBy(F.floor(F.col("event_id") / 100)).orderBy("event_id").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    events = parquet_table(spark, f"{folder}/events.parquet").select("event_id", F.col("ts").cast("timestamp").alias("ts"))
    lags = events.select(F.greatest(F.unix_micros("ts") - F.min(F.unix_micros("ts")).over(first), F.lit(0)).alias("lag"))
    return lags.agg(F.expr("percentile_disc(0.95) WITHIN GROUP (ORDER BY lag)").cast("long").alias("p95_us"), F.max("lag").alias("worst_us"), F.count("*").alias("reads"))


#: Statements that have to fail, and how.
REFUSED = (
    ("insert into nation values (200, 'A', 'B')", "IncompatibleType"),
    ("insert into nation values (200, 'A')", "InvalidValueCount"),
    ("insert into nowhere values (1)", "TableNotFound"),
    ("insert into nation values (3, 'TWICE', 0)", "PrimaryKeyRepeat"),
    ("insert into nation values (200, 'twenty-six characters long', 0)", "StringOverflow"),
    ("update nation set n_nationkey = 2 where n_nationkey = 1", "PrimaryKeyRepeat"),
    ("update nation set n_name = 5", "IncompatibleType"),
    ("create table NATION (x int, primary key(x))", "TableExists"),
    ("create table t (x int)", "SyntaxFailure"),
    ("drop table nowhere", "TableNotFound"),
    ("create index nation(oops)", "ColumnNotFound"),
    ("drop index nation(n_name)", "IndexNotFound"),
    ("create index region(r_name)", None),
    ("create index region(r_name)", "IndexExists"),
    ("drop index region(r_name)", None),
    ("select oops from nation", "ColumnNotFound"),
    ("select n_name from nation, region where oops.n_name = r_name", "TableNotFound"),
    ("select n_name from nation where n_nationkey = 'x'", "IncompatibleType"),
    ("select n_name from nation where n_nationkey > 1.5", "IncompatibleType"),
    ("select n_name from nation, region where n_name = r_regionkey", "IncompatibleType"),
    ("select x from a, b", "TableNotFound"),
    ("select k from one, two", "AmbiguousColumn"),
    ("selec", "SyntaxFailure"),
    ("commit", "TransactionAborted"),
)


def refusals(spark: SparkSession, folder: str) -> DataFrame:
    """What each statement fails with, and the table that must be as it was."""
    engine = region_engine(spark, folder)
    for name in ("one", "two"):
        engine.sql(f"create table {name} (k int, primary key(k))")
    out = []
    for k, (text, _) in enumerate(REFUSED):
        try:
            engine.sql(text)
            out.append((k, None))
        except EngineError as e:
            out.append((k, type(e).__name__))
    left = engine.sql("select * from nation").count()
    return spark.createDataFrame([(*row, left) for row in out], "statement int, error string, left_rows long")


def conflict(spark: SparkSession, folder: str) -> DataFrame:
    """Two transactions change one table: the first to commit wins, the other is aborted; a third one on another table is not disturbed."""
    one = region_engine(spark, folder)
    two, three = Engine(spark, one.store.root), Engine(spark, one.store.root)
    for e in (one, two, three):
        e.sql("begin")
    one.sql("delete from nation where n_regionkey = 0")
    two.sql("delete from nation where n_regionkey = 1")
    three.sql("insert into region values (50, 'NEW')")
    one.sql("commit")
    with contextlib.suppress(TransactionAborted):
        two.sql("commit")
    three.sql("commit")
    return one.sql("select n_nationkey, r_name from nation, region where n_regionkey <> r_regionkey")


def rendered(spark: SparkSession, folder: str) -> DataFrame:
    text = render(spj(spark, folder, "select r_regionkey, r_name from region order by r_regionkey"))
    return spark.createDataFrame([(text,)], "reply string")


def separated(spark: SparkSession, folder: str) -> DataFrame:
    """Through comma-separated files with a header, then through `!`-separated ones into a table."""
    engine, path = region_engine(spark, folder), place(spark, "files")
    df = parquet_table(spark, f"{folder}/nation.parquet")
    write_separated(df, f"{path}/csv", header=True)
    write_separated(read_separated(spark, f"{path}/csv", df.schema, header=True), f"{path}/bulk", "!")
    engine.sql("create table again (n_nationkey int, n_name char(25), n_regionkey int, primary key(n_nationkey))")
    engine.insert_rows("again", read_separated(spark, f"{path}/bulk", df.schema, "!"))
    return engine.sql("select * from again")


_refused = ", ".join(f"({k}, {repr(e) if e else 'NULL'})" for k, (_, e) in enumerate(REFUSED))
RESUMED = "SELECT n_name, round(sum(l_quantity), 2) AS sum_qty, count(*) AS n FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey GROUP BY n_name"
MADE: dict[str, tuple[Query, str]] = {
    "sort_asc": (delivered(False), "SELECT o_totalprice, row_number() OVER (ORDER BY o_totalprice) AS place FROM orders"),
    "sort_desc": (delivered(True), "SELECT o_totalprice, row_number() OVER (ORDER BY o_totalprice DESC) AS place FROM orders"),
    "gather_parallel": (gather_parallel, "SELECT o_orderkey, o_custkey, row_number() OVER (ORDER BY o_orderkey) AS place FROM orders WHERE o_totalprice > 1000"),
    "column_bounds": (column_bounds, "SELECT min(o_orderkey) AS low, max(o_orderkey) AS high FROM orders"),
    "log_replay_latest": (log_replay_latest, "SELECT user_id, event_id, event_type, value FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) = 1"),
    "dml_insert": (after("insert into nation values (100, 'NEW', 4)"), "SELECT n_nationkey, n_name, n_regionkey FROM nation UNION ALL SELECT 100, 'NEW', 4"),
    "dml_update": (after("update nation set n_name = 'X', n_regionkey = 0 where n_nationkey >= 20"), "SELECT n_nationkey, CASE WHEN n_nationkey >= 20 THEN 'X' ELSE n_name END AS n_name, CASE WHEN n_nationkey >= 20 THEN 0 ELSE n_regionkey END AS n_regionkey FROM nation"),
    "dml_update_key": (after("update nation set n_nationkey = 500 where n_nationkey = 7"), "SELECT CASE WHEN n_nationkey = 7 THEN 500 ELSE n_nationkey END AS n_nationkey, n_name, n_regionkey FROM nation"),
    "dml_delete": (after("delete from nation where n_regionkey = 1"), "SELECT * FROM nation WHERE n_regionkey <> 1"),
    "txn_commit": (after("begin", "insert into nation values (100, 'NEW', 4)", "delete from nation where n_nationkey = 0", "commit"), "SELECT n_nationkey, n_name, n_regionkey FROM nation WHERE n_nationkey <> 0 UNION ALL SELECT 100, 'NEW', 4"),
    "txn_abort": (after("begin", "delete from nation where n_nationkey >= 0", "insert into nation values (1, 'A', 1)", "rollback"), "SELECT * FROM nation"),
    "ddl_tables": (after("create table t1 (num int, primary key(num))", then="show tables"), "SELECT unnest(['region', 'nation', 't1']) AS \"Tables\""),
    "ddl_drop": (after("create table gone (x int, primary key(x))", "drop table GONE", "drop table region", then="show tables"), "SELECT 'nation' AS \"Tables\""),
    "refusals": (refusals, f"SELECT statement, error, (SELECT count(*) FROM nation) AS left_rows FROM (VALUES {_refused}) t(statement, error)"),
    "txn_conflict": (conflict, "SELECT n_nationkey, r_name FROM nation, (SELECT r_regionkey, r_name FROM region UNION ALL SELECT 50, 'NEW') r WHERE n_regionkey <> 0 AND n_regionkey <> r_regionkey"),
    "render_reply": (rendered, "SELECT rule || head || rule || string_agg('| ' || lpad(r_regionkey::VARCHAR, 16, ' ') || ' | ' || lpad(r_name, 16, ' ') || ' |' || chr(10), '' ORDER BY r_regionkey) || rule || 'Total record(s): ' || count(*) || chr(10) AS reply FROM region, (SELECT '+' || repeat('-', 18) || '+' || repeat('-', 18) || '+' || chr(10) AS rule, '| ' || lpad('r_regionkey', 16, ' ') || ' | ' || lpad('r_name', 16, ' ') || ' |' || chr(10) AS head) GROUP BY rule, head"),
    "separated_files": (separated, "SELECT n_nationkey, n_name, n_regionkey FROM nation"),
    "ddl_desc": (after(then="desc nation"), "SELECT unnest(['n_nationkey', 'n_name', 'n_regionkey']) AS \"Field\", unnest(['INT', 'CHAR', 'INT']) AS \"Type\""),
    "dml_log_state": (dml_log_state, "SELECT n_nationkey, CASE WHEN n_regionkey = 2 THEN 'RENAMED' ELSE n_name END AS n_name, n_regionkey FROM nation WHERE n_nationkey >= 3 UNION ALL SELECT 99, 'NEW', 0"),
    "snapshot_read": (snapshot_read, "SELECT * FROM nation"),
    "resume_units": (resume_units, "SELECT l_returnflag, round(sum(l_quantity), 2) AS sum_qty, count(*) AS n FROM lineitem GROUP BY l_returnflag"),
    "resume_dates": (resume_dates, "SELECT o_orderkey, o_totalprice FROM orders WHERE o_totalprice > 200000"),
    "resume_join_chain": (resumed({"kind": "reward"}, (1, 1)), RESUMED),
    "resume_interval": (resumed({"kind": "interval", "seconds": 0.2}, (0, 2)), RESUMED),
    "resume_enumerative": (resumed({"kind": "enumerative"}, (2, 1)), RESUMED),
    "resume_sort": (resume_sort, "SELECT o_totalprice, o_orderkey FROM orders WHERE o_orderkey > 0"),
    "resume_pinned": (resume_pinned, "SELECT n_nationkey, n_name, r_name FROM nation JOIN region ON n_regionkey = r_regionkey"),
    "joins_of_all": (joins(6), "SELECT r_regionkey, count(*) AS n, sum(l_linenumber)::BIGINT AS numbers FROM region JOIN nation ON n_regionkey = r_regionkey JOIN supplier ON s_nationkey = n_nationkey JOIN lineitem ON l_suppkey = s_suppkey JOIN orders ON o_orderkey = l_orderkey JOIN customer ON c_custkey = o_custkey JOIN part ON p_partkey = l_partkey GROUP BY r_regionkey"),
    "joins_14": (joins(14), "SELECT r_regionkey, count(*) AS n, sum(l_linenumber)::BIGINT AS numbers FROM region JOIN nation ON n_regionkey = r_regionkey JOIN supplier ON s_nationkey = n_nationkey JOIN lineitem ON l_suppkey = s_suppkey JOIN orders ON o_orderkey = l_orderkey JOIN customer ON c_custkey = o_custkey JOIN part ON p_partkey = l_partkey GROUP BY r_regionkey"),
    "log_after_failures": (log_after_failures, "SELECT CASE WHEN n_regionkey = 1 THEN n_nationkey + 300 ELSE n_nationkey END AS n_nationkey, n_name, n_regionkey FROM nation UNION ALL SELECT 100, 'NEW', 4"),
    "txn_resume": (txn_resume, "SELECT n_nationkey, n_name, n_regionkey FROM nation WHERE n_regionkey <> 3 UNION ALL SELECT 100, 'LATE', 4"),
    "read_own_lsn": (read_own_lsn, "SELECT n_nationkey, n_name, n_regionkey FROM nation WHERE n_regionkey <> 0"),
    "stream_replay": (stream_replay, "SELECT user_id, event_id, event_type, value FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) = 1 AND event_type <> 'purchase'"),
    "hat_freshness_p95": (freshness, "SELECT quantile_disc(lag, 0.95)::BIGINT AS p95_us, max(lag)::BIGINT AS worst_us, count(*) AS reads FROM (SELECT greatest(epoch_us(ts) - epoch_us(min(ts) OVER (PARTITION BY event_id // 100 ORDER BY event_id)), 0) AS lag FROM events)"),
    "tpcc_new_order": (lambda spark, folder: new_orders(spark, folder, place(spark, "db")), NEW_ORDERS_SQL),
    "tpcc_payment": (lambda spark, folder: payments(spark, folder, place(spark, "db")), PAYMENTS_SQL),
    "hat_payment_txn": (lambda spark, folder: payment_counts(spark, folder, place(spark, "db")), PAYMENT_COUNTS_SQL),
}


def statement(text: str) -> Query:
    return lambda spark, folder: spj(spark, folder, text)


QUERIES: dict[str, Query] = {**{k: statement(v) for k, v in STATEMENTS.items()}, **{k: tier_b(v) for k, v in SQL.items()}, **{k: v[0] for k, v in MADE.items()}}
ORACLE_SQL: dict[str, str] = {**{k: duck(v) for k, v in STATEMENTS.items()}, **SQL, **{k: v[1] for k, v in MADE.items()}}
