import hashlib
import random

from pyspark.sql import functions as F

from quern.llm.common import Scratch
from quern.llm.lines import KEY, ORDERED, LineRuns, dedup_lines, ordered_buckets

WS = " \t\n\x0b\x0c\r"
LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def brute(rows):
    """(id, text) -> (id, kept text, n_lines, n_dropped) per row."""
    key = lambda line: line.strip(WS).translate(LOW)
    big = float("inf")
    owner = {}
    for i, text in rows:
        for line in (text or "").split("\n"):
            owner[key(line)] = min(owner.get(key(line), big), big if i is None else i)
    out = []
    for i, text in rows:
        lines = (text or "").split("\n")
        kept = [x for x in lines if len(key(x)) < 10 or owner[key(x)] == (big if i is None else i)]
        out.append((i, "\n".join(kept), len(lines), len(lines) - len(kept)))
    return out


def same(spark, rows, **options):
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = [(r.doc_id, r.text, r.n_lines, r.n_dropped) for r in dedup_lines(docs, **options).collect()]
    assert sorted(got, key=str) == sorted(brute(rows), key=str)


def test_random_lines(spark):
    rng = random.Random(3)
    pool = [f"common line number {k}" for k in range(12)] + ["short", "", "É capital Line \t", " é CAPITAL line"]
    rows = [(i, "\n".join(rng.choice(pool) if rng.random() < 0.5 else f"line {rng.random()}" for _ in range(rng.randint(0, 9)))) for i in range(120)]
    for batches, fanout in ((1, 2), (4, 2), (6, 3)):
        same(spark, rows, batches=batches, fanout=fanout)


def test_nulls_ties_and_repeats(spark):
    long = "the very same long line\n" * 300
    same(spark, [(1, None), (2, ""), (3, "a line of some length"), (3, "a line of some length"), (None, "a line of some length"), (None, "only nulls hold this"), (None, "only nulls hold this"), (4, long), (5, long), (6, " a LINE of some length \r\nx")])


def test_empty_table_and_clashing_columns(spark):
    docs = spark.createDataFrame([], "doc_id long, text string, n_lines string, h1 int, drop int")
    out = dedup_lines(docs)
    assert out.columns == ["doc_id", "text", "n_lines", "h1", "drop", "n_dropped"] and out.count() == 0
    docs = spark.createDataFrame([(2, "one long line here", "x", 1, 2), (1, "one long line here", "y", 3, 4)], "doc_id long, text string, n_lines string, h1 int, drop int")
    assert sorted(map(tuple, dedup_lines(docs).collect())) == [(1, "one long line here", 1, 3, 4, 0), (2, "", 1, 1, 2, 1)]


def test_query_digest(spark):
    from quern.llm.queries import op1_line_dedup

    got = {r.doc_id: r for r in op1_line_dedup(spark, "/root/testdata/sf0.001").collect()}
    rows = [tuple(r) for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text").collect()]
    for i, text, n, dropped in brute(rows):
        assert (got[i].kept_sha256, got[i].n_lines, got[i].n_dropped) == (hashlib.sha256(text.encode()).hexdigest(), n, dropped)


def test_runs_meet_without_exchange_or_sort(spark):
    runs = LineRuns(spark, Scratch(spark, "lines"), buckets=4)
    keys = spark.range(2000).select(F.xxhash64("id").alias("h1"), F.xxhash64("id", "id").alias("h2"))
    one, two = runs._write(keys, 0), runs._write(keys.where("h1 % 3 = 0"), 0)
    with ordered_buckets(spark):
        met = spark.table(one).join(spark.table(two).hint("merge"), list(KEY), "left_anti")
        plan = met._jdf.queryExecution().executedPlan().toString()
        assert "SortMergeJoin" in plan and "Sort [" not in plan and "Exchange" not in plan
        assert met.count() == keys.where("h1 % 3 <> 0").count()
    assert spark.conf.get(ORDERED, None) in (None, "false")
    runs.close()
