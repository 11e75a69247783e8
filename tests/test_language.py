import pytest

from quern import errors as E
from quern.catalog import MOST_SMALL, Engine
from quern.functions.render import render
from quern.plans.lang import parse
from quern.streaming.changelog import table_state
from quern.workloads.queries import place

ROWS1 = [(0, 1, 1.1, "abc"), (2, 2, 2.2, "def"), (5, 3, 2.2, "xyz"), (4, 4, 2.2, "0123456789abcdef"), (2, 5, -1.11, "")]
ROWS2 = [(1, 2.0, "123", 0), (2, 3.0, "456", 1), (3, 1.0, "789", 2)]


@pytest.fixture(scope="module")
def engine(spark):
    out = Engine.create(spark, place(spark, "test-db"))
    out.sql("create table tb1 (s int, a int, b float, c char(16), primary key(a))")
    out.sql("create table tb2 (x int, y float, z char(16), s int, primary key(x))")
    out.sql("begin")
    for r in ROWS1:
        out.sql(f"insert into tb1 values ({r[0]}, {r[1]}, {r[2]}, '{r[3]}')")
    for r in ROWS2:
        out.sql(f"insert into tb2 values ({r[0]}, {r[1]}, '{r[2]}', {r[3]})")
    out.sql("commit")
    return out


def rows(engine, text):
    return sorted(tuple(round(v, 4) if isinstance(v, float) else v for v in r) for r in engine.sql(text).collect())


def test_selects(engine):
    assert rows(engine, "select * from tb1") == sorted(ROWS1)
    assert rows(engine, "select a, c from tb1 where b = 2.2 and s <> 5") == [(2, "def"), (4, "0123456789abcdef")]
    assert rows(engine, "select a from tb1 where s = 2") == [(2,), (5,)]
    assert rows(engine, "select tb1.a, x from tb1, tb2 where tb1.s = tb2.s") == [(1, 1), (2, 3), (5, 3)]
    assert rows(engine, "select a, x from tb1, tb2 where a < x") == [(1, 2), (1, 3), (2, 3)]
    assert len(rows(engine, "select * from tb1, tb2")) == 15
    assert [r.a for r in engine.sql("select a from tb1 order by a desc").collect()] == [5, 4, 3, 2, 1]
    assert [r.a for r in engine.sql("SELECT A FROM tb1 ORDER BY b").collect()][0] == 5
    assert rows(engine, "select a from tb1 where a <> 3 -- not three\n;") == [(1,), (2,), (4,), (5,)]


@pytest.mark.parametrize(
    ("text", "error"),
    [
        ("insert into tb1 values (0, 9, 1.0, 100)", E.IncompatibleType),
        ("insert into tb1 values (0, 9, 1.0, 'a', 5)", E.InvalidValueCount),
        ("insert into oops values (0)", E.TableNotFound),
        ("create table tb1 (x int, primary key(x))", E.TableExists),
        ("create index tb1(oops)", E.ColumnNotFound),
        ("drop index tb1(a)", E.IndexNotFound),
        ("insert into tb1 values (0, 9, 1.0, '0123456789abcdefg')", E.StringOverflow),
        ("select * from tb1 where c = '0123456789abcdefg'", E.StringOverflow),
        ("select x from tb1", E.ColumnNotFound),
        ("select s from tb1, tb2", E.AmbiguousColumn),
        ("select * from tb1, tb2 where s = 1", E.AmbiguousColumn),
        ("select * from tb1 where s = 'oops'", E.IncompatibleType),
        ("select * from tb1 where b > 3", E.IncompatibleType),
        ("select * from tb1, tb2 where tb1.c = tb2.y", E.IncompatibleType),
        ("insert into tb1 values (7, 1, 1.0, 'x')", E.PrimaryKeyRepeat),
        ("insert into tb1 values (7, 99, 1, 'x')", E.IncompatibleType),
        ("update tb1 set a = 2 where a = 1", E.PrimaryKeyRepeat),
        ("drop table oops", E.TableNotFound),
        ("select * from tb1 where a != 3", E.SyntaxFailure),
        ("create table t (x int)", E.SyntaxFailure),
        ("select * from tb1 where a = 99999999999", E.SyntaxFailure),
    ],
)
def test_errors(engine, text, error):
    with pytest.raises(error):
        engine.sql(text)
    assert rows(engine, "select * from tb1") == sorted(ROWS1)


def test_index_ddl_and_utilities(engine):
    engine.sql("create index tb1(s)")
    with pytest.raises(E.IndexExists):
        engine.sql("create index tb1(s)")
    engine.sql("drop index tb1(s)")
    assert [r[0] for r in engine.sql("show tables").collect()] == ["tb1", "tb2"]
    assert [tuple(r) for r in engine.sql("desc tb2").collect()] == [("x", "INT"), ("y", "FLOAT"), ("z", "CHAR"), ("s", "INT")]
    engine.sql("create table gone (x int, primary key(x))")
    engine.sql("drop table gone")
    with pytest.raises(E.TableNotFound):
        engine.sql("select * from gone")
    assert "SELECT" in engine.sql("help").first()[0] and engine.sql("exit") is None


def test_commit_and_abort_render(spark):
    engine = Engine.create(spark, place(spark, "test-db"))
    engine.sql("create table t1 (num int, primary key(num))")
    work = ["begin", "insert into t1 values(1)", "insert into t1 values(2)", "insert into t1 values(3)", "update t1 set num = 4 where num = 1", "delete from t1 where num = 3"]
    for s in [*work, "abort"]:
        engine.sql(s)
    head = "+------------------+\n|              num |\n+------------------+\n"
    assert render(engine.sql("select * from t1")) == head + "+------------------+\nTotal record(s): 0\n"
    for s in [*work, "commit"]:
        engine.sql(s)
    assert render(engine.sql("select * from t1 order by num desc")) == head + "|                4 |\n|                2 |\n+------------------+\nTotal record(s): 2\n"
    assert "... ..." in render(engine.sql("select * from t1"), most_bytes=10)


def test_first_committer_wins(spark):
    root = place(spark, "test-db")
    one = Engine.create(spark, root)
    one.sql("create table t (k int, v int, primary key(k))")
    one.sql("create table u (k int, primary key(k))")
    two, three = Engine(spark, root), Engine(spark, root)
    for e in (one, two, three):
        e.sql("begin")
    one.sql("insert into t values (1, 1)")
    two.sql("insert into t values (1, 2)")
    three.sql("insert into u values (5)")
    one.sql("commit")
    with pytest.raises(E.TransactionAborted):
        two.sql("commit")
    three.sql("commit")
    assert rows(one, "select * from t") == [(1, 1)] and rows(two, "select * from u") == [(5,)]
    with pytest.raises(E.DatabaseExists):
        Engine.create(spark, root)
    Engine.drop(spark, root)
    with pytest.raises(E.DatabaseNotFound):
        Engine(spark, root)


def small(spark):
    engine = Engine.create(spark, place(spark, "test-db"))
    engine.sql("create table t (k int, v int, c char(4), primary key(k))")
    engine.insert_rows("t", spark.createDataFrame([(1, 10, "a"), (2, 20, "b")], "k int, v int, c string"))
    return engine


def state(engine):
    return sorted(tuple(r) for r in table_state(engine.change_log(), "t", "k int, v int, c string").collect())


def test_failed_statements_leave_no_log_rows(spark):
    engine = small(spark)
    engine.sql("begin")
    with pytest.raises(E.PrimaryKeyRepeat):
        engine.sql("update t set k = 2 where k = 1")
    with pytest.raises(E.PrimaryKeyRepeat):
        engine.sql("insert into t values (2, 0, 'x')")
    engine.sql("insert into t values (3, 30, 'c')")
    engine.sql("commit")
    assert rows(engine, "select * from t") == state(engine) == [(1, 10, "a"), (2, 20, "b"), (3, 30, "c")]
    engine.sql("update t set k = k + 10, v = v - 1 where v > 10")
    engine.sql("delete from t where k = 1")
    assert rows(engine, "select * from t") == state(engine) == [(12, 19, "b"), (13, 29, "c")]
    ends = [r.lsn for r in engine.change_log().where("op = 'COMMIT'").collect()]
    assert len(ends) == 4 and max(ends) == engine.last_lsn() == max(r.lsn for r in engine.change_log().collect())


def test_log_rows_without_a_manifest_do_not_count(spark):
    engine = small(spark)
    engine.sql("begin")
    engine.sql("insert into t values (3, 30, 'c')")  # the driver is lost here
    assert state(Engine(spark, engine.store.root)) == [(1, 10, "a"), (2, 20, "b")]


@pytest.mark.parametrize(
    ("new", "error"),
    [([(None, 1, "x")], E.NullValue), ([(5, None, "x")], E.NullValue), ([(5, 1, "twelve chars")], E.StringOverflow), ([(5, 1, "x"), (5, 2, "y")], E.PrimaryKeyRepeat), ([(1, 1, "x"), (7, 1, "x")], E.PrimaryKeyRepeat)],
)
def test_insert_rows_checks_and_aborts(spark, new, error):
    engine = small(spark)
    frame = spark.createDataFrame(new, "k int, v int, c string")
    with pytest.raises(error):
        engine.insert_rows("t", frame)
    engine.sql("begin")
    with pytest.raises(error):
        engine.insert_rows("T", frame)
    engine.sql("insert into t values (9, 9, 'z')")
    engine.sql("commit")
    assert rows(engine, "select * from t") == state(engine) == [(1, 10, "a"), (2, 20, "b"), (9, 9, "z")]


def test_set_with_plus_and_minus(spark):
    engine = small(spark)
    engine.sql("update t set v = v + 1, c = 'q' where k = 1")
    engine.sql("update t set v = k -5 where k = 2")
    assert rows(engine, "select * from t") == [(1, 11, "q"), (2, -3, "b")]
    for text, error in (("update t set v = c + 1", E.IncompatibleType), ("update t set v = v + 1.5", E.IncompatibleType), ("update t set v = v", E.SyntaxFailure), ("update t set v = oops + 1", E.ColumnNotFound)):
        with pytest.raises(error):
            engine.sql(text)


def test_small_segments_are_merged(spark):
    engine = small(spark)
    engine.sql("begin")
    for k in range(3, MOST_SMALL + 3):
        engine.sql(f"insert into t values ({k}, {k}, 'x')")
    engine.sql("commit")
    assert len(engine.entry("t")[1]["segments"]) < 5
    assert [r[0] for r in rows(engine, "select k from t")] == list(range(1, MOST_SMALL + 3))
    engine.sql("update t set v = 0 where k > 2")
    assert sum(r[0] for r in rows(engine, "select v from t")) == 30 and len(state(engine)) == MOST_SMALL + 2


def test_transactions_go_on_in_another_driver(spark):
    engine = small(spark)
    engine.sql("begin")
    engine.sql("insert into t values (3, 30, 'c')")
    ticket = engine.save()
    engine.sql("delete from t where k = 1")
    second = Engine(spark, engine.store.root)
    second.resume(ticket)
    assert rows(second, "select k from t") == [(2,), (3,)]
    second.sql("commit")
    assert rows(second, "select k from t") == [(2,), (3,)] and len(state(second)) == 2
    with pytest.raises(E.TransactionAborted):
        Engine(spark, engine.store.root).resume(ticket)


def test_reads_wait_for_a_log_sequence_number(spark):
    engine = small(spark)
    assert engine.wait_for(engine.last_lsn()) == engine.store.latest()
    with pytest.raises(E.TransactionAborted):
        engine.wait_for(engine.last_lsn() + 1, 0.2)


def test_registered_tables_match_in_any_case(spark):
    engine = small(spark)
    engine.register("Other", spark.createDataFrame([(1, "o")], "k int, name string"))
    assert rows(engine, "select name, v from other, T where other.k = t.k") == [("o", 10)]
    with pytest.raises(E.TableExists):
        engine.sql("create table OTHER (x int, primary key(x))")


def test_parser_accepts():
    for text in ["create table t (a int, b float, c char(4), primary key (a, c));", "select t.a, b from t join u where t.a = u.a and b >= 1. order by b asc", "delete from t", "update t set a = -1, c = 'x' where b <> 2.5", "/* x */ rollback", "show tables", "desc t"]:
        parse(text)
