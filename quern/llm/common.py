"""What the operators share: scratch tables in the shared folder, rows carried whole, graph components."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: The white space that ends a word: space and 0x09-0x0D.
SPACES = " \t\n\x0b\x0c\r"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def shared_root(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, or one of our own where it is unset and all run in one process."""
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not root:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir has to name a folder that all executors share")
        root = tempfile.mkdtemp(prefix="quern-")
        spark.sparkContext.setCheckpointDir(root)
    return root.rstrip("/")


class Scratch:
    """Intermediate tables of one run, written as Parquet under the shared folder.

    A written table cuts the lineage: a task that is lost later rereads files
    and recomputes nothing before them.
    """

    def __init__(self, spark: SparkSession, what: str):
        self.spark, self.path = spark, f"{shared_root(spark)}/quern-{what}-{uuid.uuid4().hex[:12]}"

    def put(self, df: DataFrame, name: str) -> DataFrame:
        df.write.mode("overwrite").parquet(f"{self.path}/{name}")
        return self.spark.read.schema(df.schema).parquet(f"{self.path}/{name}")

    def drop(self, *names: str) -> None:
        for name in names:
            place = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}")
            place.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(place, True)


def ascii_lower(text: Column) -> Column:
    """A-Z become a-z; every other character stays.  lower() does that faster where all is ASCII."""
    return F.when(F.octet_length(text) == F.length(text), F.lower(text)).otherwise(F.translate(text, UPPER, LOWER))


def word_count(text: Column) -> Column:
    """Number of runs of other characters than white space; 0 for null."""
    bare = F.btrim(text, F.lit(SPACES))
    return F.coalesce(F.when(bare == "", 0).otherwise(F.size(F.split(bare, "[ \t-\r]+"))), F.lit(0)).cast("long")


def words(text: Column) -> Column:
    """The words of a text in order; an empty list for null."""
    bare = F.btrim(text, F.lit(SPACES))
    return F.when(bare != "", F.split(bare, "[ \t-\r]+")).otherwise(F.array().cast("array<string>"))


def column(name: str) -> Column:
    return F.col("`" + name.replace("`", "``") + "`")


def with_row(df: DataFrame, **named: str) -> DataFrame:
    """The input's columns as __in0, __in1, ... beside those an operator works on, so that no names clash."""
    return df.select(*[column(c).alias(f"__in{k}") for k, c in enumerate(df.columns)], *[column(c).alias(k) for k, c in named.items()])


def unfold(df: DataFrame, columns: Sequence[str], **new: Column) -> DataFrame:
    """The input's columns again, with `new` in place of those of the same name (in any case) or after them."""
    taken = {n.lower(): n for n in new}
    out = [new[taken[c.lower()]].alias(taken[c.lower()]) if c.lower() in taken else F.col(f"__in{k}").alias(c) for k, c in enumerate(columns)]
    there = {c.lower() for c in columns}
    return df.select(*out, *[v.alias(k) for k, v in new.items() if k.lower() not in there])


def fixed(df: DataFrame, **new: Column) -> DataFrame:
    """Columns that are computed once per row: the optimizer does not copy them into lambdas that use them."""
    return df.select("*", F.inline(F.array(F.struct(*[c.alias(k) for k, c in new.items()]))))


#: Rows of one key from which meet() broadcasts that key's row; at most MOST_HOT keys have so many.
HOT_ROWS, MOST_HOT = 1_000, 10_000


def meet(rows: DataFrame, table: DataFrame, on: list[str], count: str, how: str = "inner") -> DataFrame:
    """rows joined (inner or left) with table, which has one row for each key and in `count` how many of rows hold it; `count` is dropped.

    Keys of many rows are so few (at most MOST_HOT, whatever the input) that
    their rows are broadcast; the others are shuffled.  No task gets all rows of
    a hot key.
    """
    total = table.agg(F.sum(count)).first()[0] or 0
    least = max(HOT_ROWS, total // MOST_HOT)
    hot, cold = (table.where(c).drop(count) for c in (F.col(count) >= least, F.col(count) < least))
    rest = rows.join(F.broadcast(hot.select(*on)), on, "left_anti").join(cold, on, how)
    return rows.join(F.broadcast(hot), on).unionByName(rest)


def components(links: DataFrame, scratch: Scratch, name: str = "cc") -> DataFrame:
    """node and label (the smallest node it is joined with) for each end of links (a, b).

    Each round hooks every label to its smallest neighbour, follows two steps of
    those pointers and contracts the links; what is left shrinks to nothing in
    about as many rounds as the logarithm of the largest component.  Links and
    labels stay distributed; minima are taken map-side before each exchange.
    """
    edges = scratch.put(links.select("a", "b").where(F.col("a") != F.col("b")).distinct(), f"{name}-e0")
    both = edges.select(F.col("a").alias("node")).union(edges.select(F.col("b").alias("node"))).distinct()
    labels = scratch.put(both.withColumn("label", F.col("node")), f"{name}-l0")
    k = 0
    while not edges.isEmpty():
        k += 1
        turned = edges.union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        hooks = turned.groupBy(F.col("a").alias("label")).agg(F.min("b").alias("to")).select("label", F.least("label", "to").alias("to"))
        hooks = scratch.put(hooks, f"{name}-h{k}")
        jump = hooks
        for _ in range(2):
            jump = jump.join(hooks.select(F.col("label").alias("to"), F.col("to").alias("then")), "to").select("label", F.col("then").alias("to"))
        jump = scratch.put(jump, f"{name}-j{k}")
        labels = scratch.put(labels.join(jump, "label", "left").select("node", F.coalesce("to", "label").alias("label")), f"{name}-l{k}")
        a, b = (jump.select(F.col("label").alias(c), F.col("to").alias(f"t{c}")) for c in "ab")
        moved = edges.join(a, "a", "left").join(b, "b", "left").select(F.coalesce("ta", "a").alias("a"), F.coalesce("tb", "b").alias("b"))
        edges = scratch.put(moved.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), f"{name}-e{k}")
        scratch.drop(f"{name}-e{k - 1}", f"{name}-l{k - 1}", f"{name}-h{k}", f"{name}-j{k}")
    return labels
