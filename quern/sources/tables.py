"""Sources and sinks: Parquet folders, CSV and `!`-separated bulk files, and small generated tables."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

CORE = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events")


_schemas: dict[tuple[str, int], T.StructType] = {}


def parquet_table(spark: SparkSession, path: str) -> DataFrame:
    """A Parquet file or folder; its schema is read from a footer once for each state of it, for that takes a job."""
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    key = (path, place.getFileSystem(spark._jsc.hadoopConfiguration()).getFileStatus(place).getModificationTime())
    if key not in _schemas:
        if len(_schemas) > 1000:
            _schemas.clear()
        _schemas[key] = spark.read.parquet(path).schema
    return spark.read.schema(_schemas[key]).parquet(path)


def parquet_tables(spark: SparkSession, folder: str, names: Iterable[str] = CORE) -> dict[str, DataFrame]:
    return {n: parquet_table(spark, f"{folder}/{n}.parquet") for n in names}


def read_separated(spark: SparkSession, path: str, schema: T.StructType | str, separator: str = ",", header: bool = False) -> DataFrame:
    """CSV, or bulk files with another separator such as `!`; the schema is given, never inferred."""
    return spark.read.schema(schema).option("sep", separator).option("header", header).option("mode", "FAILFAST").csv(path)


def write_separated(df: DataFrame, path: str, separator: str = ",", header: bool = False) -> None:
    df.write.mode("overwrite").option("sep", separator).option("header", header).csv(path)


def warehouses(spark: SparkSession, count: int, districts: int = 10, customers: int = 300) -> dict[str, DataFrame]:
    """warehouse, district and order-entry customer tables of `count` warehouses, made by the executors."""
    w = spark.range(1, count + 1).select(F.col("id").cast("int").alias("w_id"))
    warehouse = w.select("w_id", F.concat(F.lit("W"), F.lpad("w_id", 4, "0")).alias("w_name"), (F.pmod(F.xxhash64("w_id"), F.lit(2000)) / 10000).cast("float").alias("w_tax"), F.lit(300000.0).cast("float").alias("w_ytd"))
    d = w.select(F.col("w_id").alias("d_w_id"), F.explode(F.sequence(F.lit(1), F.lit(districts))).alias("d_id"))
    district = d.select("d_w_id", "d_id", F.lit(30000.0).cast("float").alias("d_ytd"), F.lit(3001).alias("d_next_o_id"))
    c = d.select(F.col("d_w_id").alias("c_w_id"), F.col("d_id").alias("c_d_id"), F.explode(F.sequence(F.lit(1), F.lit(customers))).alias("c_id"))
    customer = c.select("c_w_id", "c_d_id", "c_id", F.lit(-10.0).cast("float").alias("c_balance"), F.pmod(F.xxhash64("c_w_id", "c_d_id", "c_id"), F.lit(1000)).cast("int").alias("c_last"))
    return {"warehouse": warehouse, "district": district, "customer": customer}


def bounds(df: DataFrame, column: str) -> tuple:
    """Smallest and largest value of a column; Parquet answers from its footers."""
    return tuple(df.agg(F.min(column), F.max(column)).first())
