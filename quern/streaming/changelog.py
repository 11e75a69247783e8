"""Change logs: their rows, replay in batch, and replay of a stream of log files."""

from __future__ import annotations

import time
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..files import Folder

SCHEMA = "op string, table string, key string, row string, lsn long, txn long"


def change_rows(op: str, table: str, key: Sequence[str], columns: Sequence[str], rows: DataFrame) -> DataFrame:
    """op, table, key and row (both JSON) of changed rows."""
    return rows.select(F.lit(op).alias("op"), F.lit(table).alias("table"), F.to_json(F.struct(*key)).alias("key"), F.to_json(F.struct(*columns)).alias("row"))


def replay(log: DataFrame, key: Sequence[str], lsn: str, op: str | None = None, deleted: str = "DELETE") -> DataFrame:
    """The last row of each key in log order, without keys whose last row deletes them.

    One aggregation with map-side combine; no sort and no window.
    """
    rest = [c for c in log.columns if c not in key]
    last = log.groupBy(*key).agg(F.max_by(F.struct(*rest), F.col(lsn)).alias("__last")).select(*key, "__last.*")
    return last if op is None else last.where(F.col(op) != deleted)


def table_state(log: DataFrame, table: str, schema: str) -> DataFrame:
    """A table's rows after replay of the engine's own log; within one statement an insert follows a delete of its key."""
    mine = log.where((F.col("table") == table) & (F.col("op") != "UPDATE-BEFORE"))  # commit records name no table
    return replay(mine, ["key"], "lsn", "op").select(F.from_json("row", schema).alias("r")).select("r.*")


PARTS = 16


def replay_stream(spark: SparkSession, log_dir: str, state_dir: str, checkpoint_dir: str, key: Sequence[str], lsn: str, schema: str, parts: int = PARTS) -> StreamingQuery:
    """Follow a folder of log files and keep each key's last row, deletions included, under state_dir; read_state() reads it.

    The state is dealt into `parts` by the key's hash.  A micro-batch rewrites
    the parts it touches into `v=N` and then names them in _state.json, in one
    rename; parts that were replaced are removed a batch later.  Rows may come in any order:
    one with a smaller log sequence number than its key's state changes nothing.
    A batch that runs again after a failure is told by its number.
    """
    folder = Folder(spark, state_dir)

    def merge(batch: DataFrame, number: int) -> None:
        session = batch.sparkSession
        now = folder.get("_state.json") if folder.has("_state.json") else {"batch": -1, "lsn": None, "parts": {}, "gone": []}
        if number <= now["batch"]:
            return
        dealt = replay(batch, key, lsn).withColumn("part", F.pmod(F.xxhash64(*key), F.lit(parts)).cast("int")).persist()
        try:
            met = {r["part"]: r["last"] for r in dealt.groupBy("part").agg(F.max(lsn).alias("last")).collect()}  # at most `parts` rows
            old = [f"v={now['parts'][str(p)]}/part={p}" for p in met if str(p) in now["parts"]]
            merged = dealt.drop("part")
            if old:
                merged = merged.unionByName(session.read.schema(schema).parquet(*[f"{state_dir}/{x}" for x in old]).select(*merged.columns))
            merged = replay(merged, key, lsn).withColumn("part", F.pmod(F.xxhash64(*key), F.lit(parts)).cast("int"))
            merged.repartition("part").write.mode("overwrite").partitionBy("part").parquet(f"{state_dir}/v={number}")
        finally:
            dealt.unpersist()
        folder.put("_state.json", {"batch": number, "lsn": max([x for x in (now["lsn"], *met.values()) if x is not None], default=None), "parts": {**now["parts"], **{str(p): number for p in met}}, "gone": old})
        for path in now["gone"]:  # replaced a batch ago, so readers of the last state are not disturbed
            folder.delete(path)

    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 64).parquet(log_dir)
    return stream.writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint_dir).trigger(availableNow=True).start()


def read_state(spark: SparkSession, state_dir: str, schema: str, op: str | None = None, deleted: str = "DELETE", least: int | None = None, seconds: float = 30.0) -> DataFrame:
    """The rows that replay_stream() has come to, without deleted keys where `op` names the operation's column.

    least: wait until a row of this log sequence number or a later one is in; TimeoutError if none comes.
    """
    folder, ends = Folder(spark, state_dir), time.time() + seconds
    while True:
        now = folder.get("_state.json") if folder.has("_state.json") else {"lsn": None, "parts": {}}
        if least is None or (now["lsn"] is not None and now["lsn"] >= least):
            break
        if time.time() > ends:
            raise TimeoutError(f"{least} is not in the state after {seconds} seconds")
        time.sleep(0.1)
    paths = [f"{state_dir}/v={v}/part={p}" for p, v in now["parts"].items()]
    rows = spark.read.schema(schema).parquet(*paths) if paths else spark.createDataFrame([], schema)
    return rows if op is None else rows.where(F.col(op) != deleted)
