"""Line dedup over levelled sorted runs of line hashes.

A run is a table of line keys (128-bit hashes) bucketed and sorted by the key,
one file a bucket, so a batch meets all runs in merge anti joins that neither
move nor sort them.  Each batch leaves one run on level 0; `fanout` runs of a
level are merged into one run of the next level before the next batch comes.
"""

from __future__ import annotations

import contextlib
import uuid
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import SPACES, Scratch, ascii_lower, column, fixed, unfold, with_row

KEY = ("h1", "h2")
#: Lets Spark use the order in which a bucket of one file was written.
ORDERED = "spark.sql.legacy.bucketedTableScan.outputOrdering"


@contextlib.contextmanager
def ordered_buckets(spark: SparkSession) -> Iterator[None]:
    before = spark.conf.get(ORDERED, None)
    spark.conf.set(ORDERED, "true")
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(ORDERED)
        else:
            spark.conf.set(ORDERED, before)


def line_key(line: Column) -> Column:
    return ascii_lower(F.btrim(line, F.lit(SPACES)))


class LineRuns:
    """The keys of all lines seen so far, as levelled runs.

    buckets: into how many buckets each run is dealt; one file each.
    fanout: how many runs a level holds before they are merged.
    """

    def __init__(self, spark: SparkSession, scratch: Scratch, buckets: int | None = None, fanout: int = 2, min_length: int = 10):
        self.spark, self.scratch, self.fanout, self.min_length = spark, scratch, fanout, min_length
        self.buckets = buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))
        self.levels: dict[int, list[str]] = {}
        self.name, self.count = f"quern_lines_{uuid.uuid4().hex[:12]}", 0

    def _write(self, keys: DataFrame, level: int) -> str:
        table = f"{self.name}_{self.count}"
        self.count += 1
        (
            keys.repartition(self.buckets, *KEY).write.bucketBy(self.buckets, *KEY).sortBy(*KEY)
            .option("path", f"{self.scratch.path}/{table}").format("parquet").saveAsTable(table)
        )
        self.levels.setdefault(level, []).append(table)
        return table

    def _drop(self, table: str) -> None:
        self.spark.sql(f"DROP TABLE IF EXISTS {table}")
        self.scratch.drop(table)

    def compact(self) -> None:
        """Merge the runs of each full level into one of the next."""
        level = 0
        while level in self.levels:
            if len(full := self.levels[level]) >= self.fanout:
                self.levels[level] = []
                merged = self.spark.table(full[0])
                for table in full[1:]:
                    merged = merged.unionByName(self.spark.table(table))
                self._write(merged, level + 1)
                for table in full:
                    self._drop(table)
            level += 1

    def keyed(self, batch: DataFrame) -> DataFrame:
        """__id, __text -> a row for each line with a long enough key: __id, th (the text's hash), pos, h1, h2."""
        lines = batch.select("__id", F.xxhash64("__text").alias("th"), F.posexplode(F.split("__text", "\n", -1)).alias("pos", "line"))
        key = line_key(F.col("line"))
        return lines.where(F.length(key) >= self.min_length).select("__id", "th", "pos", F.xxhash64(key).alias("h1"), F.xxhash64(F.lit("#"), key).alias("h2"))

    def ingest(self, batch: DataFrame) -> DataFrame:
        """Add a batch (__id, __text); returns its dropped lines: __id, th, pos.

        A line goes if its key is in a run, or if a smaller __id of the batch holds it.
        """
        self.compact()
        lines = self.scratch.put(self.keyed(batch), f"lines-{self.count}")  # split and hashed once, read twice
        fresh = lines.groupBy(*KEY).agg(F.min("__id").alias("owner"))
        for tables in self.levels.values():
            for table in tables:
                fresh = fresh.join(self.spark.table(table).select(*KEY).hint("merge"), list(KEY), "left_anti")
        with ordered_buckets(self.spark):
            run = self._write(fresh, 0)
        owners = self.spark.read.schema(fresh.schema).parquet(f"{self.scratch.path}/{run}").withColumn("new", F.lit(True))
        met = lines.join(owners.hint("merge"), list(KEY), "left")
        gone = met.where(F.col("new").isNull() | ~F.col("__id").eqNullSafe(F.col("owner"))).select("__id", "th", "pos")
        gone = self.scratch.put(gone, f"gone-{run}")
        self.scratch.drop(f"lines-{self.count - 1}")
        return gone

    def close(self) -> None:
        for tables in self.levels.values():
            for table in tables:
                self._drop(table)
        self.levels = {}


def dedup_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", batches: int = 4, fanout: int = 2, min_length: int = 10) -> DataFrame:
    """Drop every line whose key (stripped, A-Z lower-cased, of at least `min_length` code points) an earlier document holds.

    Ids have to be numbers.  Documents enter in `batches` ranges of them, so the smallest id of a
    key keeps its lines, all of them.  Returns the input's columns with the kept
    lines, joined by \\n, in place of the text, and n_lines (before) and
    n_dropped.  Null or empty text is one empty line.  A null id is larger than
    any other, and rows of one id are one document.  An empty table gives an
    empty table; input columns named n_lines or n_dropped are replaced.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark, "lines")
    rows = with_row(docs, __id=id_col, __text=text_col).withColumn("__text", F.coalesce("__text", F.lit("")))
    cuts = docs.agg(F.percentile_approx(column(id_col), [k / batches for k in range(1, batches)], 1000)).first()[0] if batches > 1 else None
    runs = LineRuns(spark, scratch, fanout=fanout, min_length=min_length)
    gone, low = None, None
    for high in [*sorted(set(cuts or [])), None]:
        inside = F.lit(True) if low is None else F.col("__id") > low
        inside = (inside | F.col("__id").isNull()) if high is None else inside & (F.col("__id") <= high)
        part = runs.ingest(rows.select("__id", "__text").where(inside))
        gone, low = part if gone is None else gone.unionByName(part), high
    runs.close()
    drops = gone.groupBy("__id", "th").agg(F.collect_set("pos").alias("drop")).withColumnsRenamed({"__id": "i", "th": "t"})
    met = rows.withColumn("th", F.xxhash64("__text")).join(drops.hint("shuffle_hash"), F.col("__id").eqNullSafe(F.col("i")) & (F.col("th") == F.col("t")), "left")
    met = fixed(met, lines=F.split("__text", "\n", -1))
    left = F.array_except(F.sequence(F.lit(0), F.size("lines") - 1), F.col("drop"))
    kept = F.when(F.col("drop").isNull(), F.col("__text")).otherwise(F.array_join(F.transform(left, lambda i: F.get(F.col("lines"), i)), "\n"))
    n_lines, n_dropped = F.size("lines").cast("long"), F.coalesce(F.size("drop"), F.lit(0)).cast("long")
    return unfold(met, docs.columns, **{text_col: kept, "n_lines": n_lines, "n_dropped": F.when(F.col("drop").isNull(), 0).otherwise(n_dropped).cast("long")})
