import pytest
from pyspark.sql import functions as F

from quern.catalog import Engine
from quern.sources import benchmarks as B
from quern.workloads.queries import place


@pytest.mark.parametrize(("specs", "make", "counts"), [(B.TPCH, B.tpch, {"part": 200, "orders": 1500, "lineitem": 6000, "partsupp": 800, "supplier": 10}), (B.STAR, B.star, {"date": 2556, "lineorder": 6000, "supplier": 2})])
def test_made_tables(spark, specs, make, counts):
    tables = make(spark, 0.001)
    assert list(tables) == list(specs)
    for name, df in tables.items():
        key = [k.strip() for k in specs[name][1].split(",")]
        rows, keys = df.agg(F.count("*"), F.count_distinct(*key)).first()
        assert rows == keys == counts.get(name, rows) and df.dropna().count() == rows
    assert sorted(map(str, make(spark, 0.001)["supplier"].collect())) == sorted(map(str, tables["supplier"].collect()))


def test_load_and_files(spark):
    tables = {k: v for k, v in B.tpch(spark, 0.0002).items() if k in ("region", "nation", "orders", "lineitem")}
    engine, folder = Engine.create(spark, place(spark, "db")), place(spark, "files")
    B.load(engine, B.TPCH, tables)
    got = engine.sql("select o_orderkey, l_linenumber from orders, lineitem where o_orderkey = l_orderkey and o_orderdate >= '1995-01-01'")
    assert got.count() == 4 * tables["orders"].where("o_orderdate >= '1995-01-01'").count() > 0
    B.dump(tables, folder)
    second = Engine.create(spark, place(spark, "db"))
    B.load_files(second, {k: B.TPCH[k] for k in tables}, folder)
    for name in tables:
        assert sorted(map(str, second.table(name).collect())) == sorted(map(str, engine.table(name).collect()))


def test_the_test_table(spark):
    engine = Engine.create(spark, place(spark, "db"))
    B.load(engine, B.TEST, B.test_table(spark, 50))
    assert engine.sql("select score from test_table where id = 7 and name = '0007'").first()[0] == 100.0
    assert engine.sql("select id from test_table where id >= 3 and id < 9").count() == 6
