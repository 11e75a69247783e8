"""Order-entry and payment transactions in the engine's own language, over databases loaded from the supplied tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..catalog import Engine
from ..sources.tables import parquet_table


def order_entry(spark: SparkSession, folder: str, root: str) -> Engine:
    """Warehouses from regions, districts from nations, customers, and a stock row for each part."""
    engine = Engine.create(spark, root)
    for text in (
        "create table warehouse (w_id int, w_ytd float, primary key(w_id))",
        "create table district (d_w_id int, d_id int, d_ytd float, d_next_o_id int, primary key(d_w_id, d_id))",
        "create table customer (c_d_id int, c_id int, c_name char(25), c_balance float, primary key(c_d_id, c_id))",
        "create table stock (s_i_id int, s_quantity int, primary key(s_i_id))",
        "create table item (i_id int, i_price float, primary key(i_id))",
        "create table orders (o_w_id int, o_d_id int, o_id int, o_c_id int, o_ol_cnt int, primary key(o_w_id, o_d_id, o_id))",
        "create table new_orders (no_w_id int, no_d_id int, no_o_id int, primary key(no_w_id, no_d_id, no_o_id))",
        "create table order_line (ol_w_id int, ol_d_id int, ol_o_id int, ol_number int, ol_i_id int, ol_quantity int, ol_amount float, primary key(ol_w_id, ol_d_id, ol_o_id, ol_number))",
        "create table history (h_id int, h_c_id int, h_d_id int, h_w_id int, h_amount float, primary key(h_id))",
    ):
        engine.sql(text)
    read = lambda name: parquet_table(spark, f"{folder}/{name}.parquet")
    engine.insert_rows("warehouse", read("region").select(F.col("r_regionkey").alias("w_id"), F.lit(300000.0).alias("w_ytd")))
    engine.insert_rows("district", read("nation").select(F.col("n_regionkey").alias("d_w_id"), F.col("n_nationkey").alias("d_id"), F.lit(30000.0).alias("d_ytd"), F.lit(3001).alias("d_next_o_id")))
    engine.insert_rows("customer", read("customer").select(F.col("c_nationkey").alias("c_d_id"), F.col("c_custkey").alias("c_id"), "c_name", F.col("c_acctbal").alias("c_balance")))
    engine.insert_rows("stock", read("part").select(F.col("p_partkey").alias("s_i_id"), F.col("p_size").alias("s_quantity")))
    engine.insert_rows("item", read("part").select(F.col("p_partkey").alias("i_id"), F.col("p_retailprice").alias("i_price")))
    return engine


def new_order(engine: Engine, w: int, d: int, c: int, lines: Sequence[tuple[int, int]]) -> int:
    """Enter an order of (item, quantity) lines: number from the district, stock taken down, one line each; returns the number.

    All of it commits or nothing does.
    """
    engine.sql("begin")
    try:
        number = engine.sql(f"select d_next_o_id from district where d_w_id = {w} and d_id = {d}").first()[0]
        engine.sql(f"update district set d_next_o_id = d_next_o_id + 1 where d_w_id = {w} and d_id = {d}")
        engine.sql(f"insert into orders values ({w}, {d}, {number}, {c}, {len(lines)})")
        engine.sql(f"insert into new_orders values ({w}, {d}, {number})")
        for k, (item, quantity) in enumerate(lines, 1):
            price = engine.sql(f"select i_price from item where i_id = {item}").first()[0]
            stock = engine.sql(f"select s_quantity from stock where s_i_id = {item}").first()[0]
            refill = 91 if stock < quantity + 10 else 0  # as the public benchmark refills
            engine.sql(f"update stock set s_quantity = s_quantity + {refill - quantity} where s_i_id = {item}")
            engine.sql(f"insert into order_line values ({w}, {d}, {number}, {k}, {item}, {quantity}, {quantity * price:.2f})")
        engine.sql("commit")
    except Exception:
        if engine.state == "GROWING":
            engine.sql("abort")
        raise
    return number


def payment(engine: Engine, number: int, w: int, d: int, c: int, amount: float) -> None:
    """Add an amount to a warehouse and a district, take it from a customer's balance, and note it."""
    engine.sql("begin")
    try:
        engine.sql(f"update warehouse set w_ytd = w_ytd + {amount:.2f} where w_id = {w}")
        engine.sql(f"update district set d_ytd = d_ytd + {amount:.2f} where d_w_id = {w} and d_id = {d}")
        engine.sql(f"update customer set c_balance = c_balance - {amount:.2f} where c_d_id = {d} and c_id = {c}")
        engine.sql(f"insert into history values ({number}, {c}, {d}, {w}, {amount:.2f})")
        engine.sql("commit")
    except Exception:
        if engine.state == "GROWING":
            engine.sql("abort")
        raise


def place_of(spark: SparkSession, folder: str, customer: int) -> tuple[int, int]:
    """A customer's warehouse and district, which are the region and nation here."""
    rows = parquet_table(spark, f"{folder}/customer.parquet").where(F.col("c_custkey") == customer).join(parquet_table(spark, f"{folder}/nation.parquet"), F.col("c_nationkey") == F.col("n_nationkey"))
    return tuple(rows.select("n_regionkey", "n_nationkey").first())


#: What the registered queries do: (customer, lines) and (customer, amount).
ORDERS = ((1, ((3, 4), (5, 1), (8, 10))), (1, ((3, 2),)), (2, ((7, 6), (3, 1))))
PAYMENTS = ((1, 12.5), (2, 100.0), (1, 7.25))


def new_orders(spark: SparkSession, folder: str, root: str) -> DataFrame:
    """The stock after some orders, with what was ordered of each item."""
    engine = order_entry(spark, folder, root)
    for customer, lines in ORDERS:
        new_order(engine, *place_of(spark, folder, customer), customer, lines)
    lines = engine.sql("select ol_i_id, ol_quantity, o_c_id from orders, order_line, new_orders where o_w_id = ol_w_id and o_d_id = ol_d_id and o_id = ol_o_id and no_w_id = o_w_id and no_d_id = o_d_id and no_o_id = o_id")
    sold = lines.groupBy("ol_i_id").agg(F.sum("ol_quantity").alias("sold"))
    stock = engine.sql("select s_i_id, s_quantity from stock")
    return stock.join(sold, F.col("s_i_id") == F.col("ol_i_id"), "left").select("s_i_id", "s_quantity", F.coalesce("sold", F.lit(0)).cast("long").alias("sold"))


def payments(spark: SparkSession, folder: str, root: str) -> DataFrame:
    """All customers' balances after some payments, with what their warehouse and district took in."""
    engine = order_entry(spark, folder, root)
    for k, (customer, amount) in enumerate(PAYMENTS):
        payment(engine, k, *place_of(spark, folder, customer), customer, amount)
    rows = engine.sql("select c_id, c_balance, d_ytd, w_ytd from customer, district, warehouse where c_d_id = d_id and d_w_id = w_id")
    return rows.select("c_id", *[F.round(F.col(c).cast("double"), 1).alias(c) for c in ("c_balance", "d_ytd", "w_ytd")])


def payment_counts(spark: SparkSession, folder: str, root: str) -> DataFrame:
    """The analytical benchmark's payment, by `SET c = c + 1`: how often each customer paid."""
    engine = Engine.create(spark, root)
    engine.sql("create table customer (c_custkey int, c_name char(25), c_paymentcnt int, primary key(c_custkey))")
    engine.sql("create table history (h_orderkey int, h_custkey int, h_amount float, primary key(h_orderkey))")
    engine.insert_rows("customer", parquet_table(spark, f"{folder}/customer.parquet").select("c_custkey", "c_name", F.lit(0).alias("c_paymentcnt")))
    for k, (customer, amount) in enumerate(PAYMENTS):
        for text in ("begin", f"update customer set c_paymentcnt = c_paymentcnt + 1 where c_custkey = {customer}", f"insert into history values ({k}, {customer}, {amount:.2f})", "commit"):
            engine.sql(text)
    return engine.sql("select c_custkey, c_paymentcnt from customer")


_SOLD = ", ".join(f"({i}, {q}, {k})" for k, (i, q) in enumerate(line for _, lines in ORDERS for line in lines))
_PAID = ", ".join(f"({c}, {a})" for c, a in PAYMENTS)
#: Stock goes down line by line, and up by 91 where less than ten more than the line would be left.
NEW_ORDERS_SQL = f"""
WITH RECURSIVE l(i, q, k) AS (VALUES {_SOLD}), n AS (SELECT i, q, row_number() OVER (PARTITION BY i ORDER BY k) AS t FROM l),
s AS (SELECT p_partkey AS i, 0 AS t, p_size AS stock, 0 AS sold FROM part
  UNION ALL SELECT s.i, s.t + 1, s.stock - n.q + CASE WHEN s.stock < n.q + 10 THEN 91 ELSE 0 END, s.sold + n.q FROM s JOIN n ON n.i = s.i AND n.t = s.t + 1)
SELECT i::INT AS s_i_id, arg_max(stock, t)::INT AS s_quantity, max(sold)::BIGINT AS sold FROM s GROUP BY i"""
PAYMENTS_SQL = f"""
WITH p(c, a) AS (VALUES {_PAID}), q AS (SELECT c, sum(a) AS a FROM p GROUP BY c),
x AS (SELECT c_custkey, c_nationkey, c_acctbal, coalesce(a, 0) AS a FROM customer LEFT JOIN q ON c = c_custkey),
d AS (SELECT n_nationkey, n_regionkey, 30000 + coalesce(sum(a), 0) AS d FROM nation LEFT JOIN x ON c_nationkey = n_nationkey GROUP BY ALL),
w AS (SELECT n_regionkey, 300000 + sum(d - 30000) AS w FROM d GROUP BY ALL)
SELECT c_custkey::INT AS c_id, round(CAST(CAST(c_acctbal AS FLOAT) - CAST(a AS FLOAT) AS DOUBLE), 1) AS c_balance, round(CAST(d AS DOUBLE), 1) AS d_ytd, round(CAST(w AS DOUBLE), 1) AS w_ytd
FROM x JOIN d ON c_nationkey = n_nationkey JOIN w USING (n_regionkey)"""
PAYMENT_COUNTS_SQL = f"WITH p(c, a) AS (VALUES {_PAID}) SELECT c_custkey::INT AS c_custkey, count(c)::INT AS c_paymentcnt FROM customer LEFT JOIN p ON c = c_custkey GROUP BY c_custkey"
