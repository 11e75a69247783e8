from pyspark.sql import functions as F

from quern.llm.common import LOWER, UPPER, ascii_lower, meet


def test_ascii_lower_changes_nothing_else(spark):
    chars = [chr(c) for c in range(1, 0x20000) if not 0xD800 <= c < 0xE000]
    texts = [*chars, *[f"Aa{c}Z b" for c in chars[:4000]], "\u0391\u03a3", "\u00c9a B", "\u00e9a B", "\u0130X", None, ""]
    rows = spark.createDataFrame([(t,) for t in texts], "t string")
    assert rows.where(~ascii_lower(F.col("t")).eqNullSafe(F.translate("t", UPPER, LOWER))).isEmpty()


def test_meet_joins_hot_and_cold_keys(spark):
    rows = spark.createDataFrame([("hot", k) for k in range(3000)] + [(f"k{k % 40}", k) for k in range(200)] + [(None, 1), ("alone", 2)], "k string, v int")
    table = rows.where("k <> 'alone'").groupBy("k").agg(F.count("*").alias("n"), F.max("v").alias("m"))
    plain = rows.join(table.drop("n"), "k", "left")
    for how in ("inner", "left"):
        got = meet(rows, table, ["k"], "n", how)
        assert sorted(got.collect(), key=str) == sorted((plain if how == "left" else plain.where("m is not null")).collect(), key=str)
    assert meet(rows.limit(0), table, ["k"], "n").isEmpty() and meet(rows.limit(0), table.limit(0), ["k"], "n", "left").isEmpty()
