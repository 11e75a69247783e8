import pytest
from pyspark.sql import functions as F

from quern.catalog import Engine
from quern.errors import EngineError
from quern.resume.policies import EnumerativePolicy, IntervalPolicy, RewardPolicy, Step
from quern.resume.sql import Killed, SqlRun
from quern.resume.units import ResumableQuery, ranges, with_retries
from quern.sources.tables import parquet_tables, read_separated, warehouses, write_separated
from quern.streaming.changelog import read_state, replay_stream
from quern.workloads.queries import LONG, place, spj


def test_reward_policy_formula():
    policy = RewardPolicy()
    step = Step("j", "join", 1_000_000, 819_200, 10)
    assert policy.reward(step) == pytest.approx(1_000_000 / 5002)
    assert policy.should_checkpoint(step)
    assert not policy.should_checkpoint(Step("j", "join", 1_000_000, 819_200, 9))
    assert not policy.should_checkpoint(Step("j", "join", 400_000, 0, 10))
    assert policy.should_checkpoint(Step("j", "join", 400_000, 0, 10, child_us=200_000))


def test_interval_policy():
    policy, step = IntervalPolicy(5), Step("s", "sort", 0, 0)
    assert [policy.should_checkpoint(step, t) for t in (1, 5, 6, 9.9, 10)] == [False, True, False, False, True]


def test_enumerative_policy():
    policy = EnumerativePolicy()
    steps = [Step("scan", "scan", 5e6, 1), Step("join", "join", 60e6, 819_200), Step("sort", "sort", 5e6, 819_200 * 1000)]
    assert policy.choose(steps) == ["join"] and policy.choices == 4
    with pytest.raises(ValueError):
        policy.choose(steps * 8)


def test_ranges():
    assert ranges(0, 10, 5) == [2, 4, 6, 8] and ranges(None, None, 4) == [] and ranges(3, 3, 4) == [3]


@pytest.mark.parametrize("killed_after", [0, 1, 3])
def test_units_resume(spark, killed_after):
    source = spark.range(1000).select(F.when(F.col("id") % 10 > 0, F.col("id")).alias("k"), "id")
    root = place(spark, "run")
    make = lambda: ResumableQuery(spark, root, "q", source, "k", lambda df: df.where("id % 3 = 0"), 4)
    first = make()
    assert first.run(killed_after) == list(range(killed_after))
    again = make()
    assert again.done() == list(range(killed_after)) and again.run() == list(range(killed_after, 4))
    assert sorted(r.id for r in again.result().collect()) == list(range(0, 1000, 3))
    with pytest.raises(ValueError):
        ResumableQuery(spark, root, "other", source, "k", lambda df: df, 4)
    again.clear()
    assert make().done() == []


FOLDER = "/root/testdata/sf0.001"


@pytest.mark.parametrize("policy", [{"kind": "reward"}, {"kind": "reward", "threshold": 1e9}, {"kind": "interval", "seconds": 0.05}, {"kind": "enumerative", "write_rate": 1e9, "read_rate": 1e9}])
def test_another_driver_goes_on_from_the_folder_alone(spark, policy):
    root = place(spark, "sql")
    want = sorted(spj(spark, FOLDER, LONG).collect())
    for stop in ((0, 1), (1, 3), (2, 1)):
        with pytest.raises(Killed):
            SqlRun(spark, root, LONG, {"folder": FOLDER}, 3, policy).run(stop)
    last = SqlRun(spark, root)
    assert last.journal["text"] == LONG and [bool(last.done(u, 3)) for u in last.units()] == [True, True, False]
    steps = last.facts()
    assert all(s.elapsed_us > 0 and s.bytes > 0 for s in steps) and [s.kind for s in steps] == ["scan", "join", "join", "join"]
    got = last.result().collect()
    assert sorted(got) == want and [r.n_name for r in got] == sorted(r.n_name for r in got)
    assert last.read_from == ([(2, 1)] if 1 in last.chosen() else [])
    assert SqlRun(spark, root).result().collect() == got  # ties included
    with pytest.raises(ValueError):
        SqlRun(spark, root, "select r_name from region", {"folder": FOLDER})
    last.clear()
    with pytest.raises(ValueError):
        SqlRun(spark, root)


def test_a_state_of_another_run_is_not_taken(spark):
    root = place(spark, "sql")
    with pytest.raises(Killed):
        SqlRun(spark, root, LONG, {"folder": FOLDER}, 3).run((0, 2))
    run = SqlRun(spark, root)
    run.folder.put("done/0-2.json", run.folder.get("done/0-2.json") | {"digest": "another"})
    run.run()
    assert run.read_from[0] == (0, 1)


def test_policies_choose_from_measurements(spark):
    def chosen(**policy):
        run = SqlRun(spark, place(spark, "sql"), LONG, {"folder": FOLDER}, 2, policy)
        run.run()
        return run.chosen()

    assert chosen(kind="reward", threshold=1e9) == [] and chosen(kind="reward", threshold=0) == [0, 1, 2, 3]
    assert chosen(kind="interval", seconds=1e9) == []
    assert 0 not in chosen(kind="enumerative", write_rate=1e12, read_rate=1e12)  # a scan has no state


def test_a_run_reads_the_version_it_began_with(spark):
    engine = Engine.create(spark, place(spark, "db"))
    engine.sql("create table t (k int, v int, primary key(k))")
    engine.insert_rows("t", spark.range(40).selectExpr("cast(id as int) as k", "cast(id % 7 as int) as v"))
    root = place(spark, "sql")
    with pytest.raises(Killed):
        SqlRun(spark, root, "select k, v from T order by k desc", {"database": engine.store.root}, 4).run((1, 0))
    engine.sql("update t set v = v + 100 where k >= 0")
    assert [tuple(r) for r in SqlRun(spark, root).result().collect()] == [(k, k % 7) for k in reversed(range(40))]


def test_retries(spark, tmp_path):
    calls = []

    def flaky():
        calls.append(1)
        if len(calls) < 3:
            raise ConnectionError
        return "ok"

    assert with_retries(flaky) == "ok"
    with pytest.raises(ConnectionError):
        with_retries(lambda: (_ for _ in ()).throw(ConnectionError()), 2)
    mark = tmp_path / "failed"

    def breaks_once(batches):
        if not mark.exists():
            mark.write_text("")
            raise RuntimeError("a lost executor")
        yield from batches

    assert with_retries(lambda: spark.range(10).coalesce(1).mapInArrow(breaks_once, "id long").collect()) == spark.range(10).collect()
    for wrong in (lambda: spark.sql("select nothing from nowhere"), lambda: spark.sql("selec"), lambda: spj(spark, FOLDER, "select oops from region")):
        calls.clear()
        with pytest.raises(Exception) as e:  # noqa: PT011
            with_retries(lambda: (calls.append(1), wrong())[1])
        assert len(calls) == 1 and not isinstance(e.value, AssertionError)
    assert issubclass(EngineError, Exception)


def test_stream_replay_with_deletes_and_late_rows(spark):
    log, state, at = place(spark, "log"), place(spark, "state"), place(spark, "at")
    schema = "lsn long, k long, op string, v string"
    batches = [
        [(1, 1, "INSERT", "a"), (2, 1, "UPDATE", "b"), (3, 2, "INSERT", "c"), (9, 4, "INSERT", "x")],
        [(6, 2, "DELETE", "c"), (8, 3, "INSERT", "late"), (7, 4, "DELETE", "old")],
        [(5, 2, "UPDATE", "before the delete"), (10, 3, "DELETE", "late"), (11, 1, "UPDATE", "z")],
    ]
    want = [[(1, "b"), (2, "c"), (4, "x")], [(1, "b"), (3, "late"), (4, "x")], [(1, "z"), (4, "x")]]
    assert read_state(spark, state, schema).count() == 0
    for rows, here in zip(batches, want, strict=True):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(log)
        replay_stream(spark, log, state, at, ["k"], "lsn", schema).awaitTermination()
        assert sorted((r.k, r.v) for r in read_state(spark, state, schema, "op", least=max(r[0] for r in rows)).collect()) == here
    with pytest.raises(TimeoutError):
        read_state(spark, state, schema, least=12, seconds=0.2)
    # parts that were replaced go a batch later, so the state is bounded by its keys
    spark.createDataFrame([(12, 1, "UPDATE", "w")], schema).write.mode("append").parquet(log)
    replay_stream(spark, log, state, at, ["k"], "lsn", schema).awaitTermination()
    held = [r[0] for r in spark.read.schema(schema).option("recursiveFileLookup", "true").parquet(state).selectExpr("k").collect()]
    assert sorted(held) == [1, 1, 2, 3, 4]


def test_separated_files(spark):
    path = place(spark, "csv")
    df = warehouses(spark, 3)["district"]
    assert df.count() == 30
    write_separated(df, path, "!")
    assert sorted(read_separated(spark, path, df.schema, "!").collect()) == sorted(df.collect())
