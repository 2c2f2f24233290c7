import asyncio

import pytest
from pyspark.sql import functions as F

import tidewheel as tw
from tidewheel.operators.gather import with_sequence
from tidewheel.operators.lifecycle import map_with_hooks
from tidewheel.plans.schedule import on_workers, through_queue
from tidewheel.sources.tables import calls
from tidewheel.streaming.offload import offload_stream, run_to


def test_call_by_value_and_name(spark):
    df = calls(spark, [(3, 4), (5, 7)], "a long, b long")
    assert [r[0] for r in df.select(tw.call(lambda a, b: a + b, "a", "b", returns="long")).collect()] == [7, 12]
    registry = tw.worker(spark, {"times": (lambda a, b: a * b, "long")})
    assert [r[0] for r in df.select(tw.call("times", "a", "b", registry=registry)).collect()] == [12, 35]
    assert [r[0] for r in df.select(registry.proxy().times("a", "b")).collect()] == [12, 35]
    assert registry.methods() == ["methods", "run", "times"]


def test_bad_calls(spark):
    registry = tw.worker(spark)
    with pytest.raises(TypeError):
        tw.call(3, "a", returns="long")
    with pytest.raises(TypeError):
        tw.call(len, "a")
    with pytest.raises(KeyError):
        tw.call("absent", "a", registry=registry)
    with pytest.raises(AttributeError):
        registry.proxy().absent
    with pytest.raises(ValueError):
        registry.register("run", len, "long")


def test_envelope_keeps_errors_events_and_output(spark):
    def work(n):
        tw.emit({"foo": n})
        print("out", n)
        if n == 2:
            raise KeyError("two")
        return n

    rows = calls(spark, [(1,), (2,), (None,)], "n long").select(tw.call_safe(work, "n", returns="long", capture=True).alias("e")).collect()
    assert [r.e.value for r in rows] == [1, None, None]
    assert [r.e.error and r.e.error.name for r in rows] == [None, "KeyError", None]
    assert "KeyError" in rows[1].e.error.stack and rows[1].e.error.details is None
    assert rows[0].e.events[0].payload == '{"foo": 1}' and rows[0].e.stdout == "out 1\n"


def test_an_error_keeps_its_own_properties_and_need_not_have_a_stack(spark):
    def fails(n):
        error = ValueError("no")
        error.value = 42
        raise error

    e = spark.range(1).select(tw.call_safe(fails, "id", returns="long", stack=False).alias("e")).first().e
    assert e.error.details == '{"value": 42}' and e.error.stack is None


def test_coroutines_are_awaited(spark):
    async def slow_add(a, b):
        await asyncio.sleep(0.01)
        return a + b

    df = calls(spark, [(3.0, 4.1)], "a double, b double")
    assert df.select(tw.call(slow_add, "a", "b", returns="double")).first()[0] == 7.1


def test_is_main_thread(spark):
    assert tw.is_main_thread()
    assert spark.range(1).select(tw.call(lambda _: tw.is_main_thread(), "id", returns="boolean")).first()[0] is False
    with pytest.raises(RuntimeError):
        tw.emit(1)


def test_sequence_is_gapless_over_partitions(spark):
    df = spark.range(1000).select((F.lit(999) - F.col("id")).alias("k")).repartition(7)
    got = with_sequence(df, "k").orderBy("seq").collect()
    assert [(r.k, r.seq) for r in got] == [(i, i + 1) for i in range(1000)]
    assert with_sequence(df.where("k < 0"), "k").count() == 0


def test_hooks_run_even_after_an_error(spark, tmp_path):
    mark = str(tmp_path / "ended")

    def on_terminate(state):
        open(mark, "a").write(state)

    df = spark.range(0, 4, 1, 1)
    out = map_with_hooks(df, lambda state, rows: rows.assign(id=rows.id + len(state)), "id long", lambda: "ab", on_terminate)
    assert [r.id for r in out.collect()] == [2, 3, 4, 5]
    with pytest.raises(Exception, match="broken"):
        map_with_hooks(df, lambda state, rows: (_ for _ in ()).throw(ValueError("broken")), "id long", lambda: "c", on_terminate).collect()
    assert open(mark).read() == "abc"


def test_schedule_matches_a_plain_loop(spark):
    rows = [(i % 3, i, float((i * 7) % 5 + 1)) for i in range(60)]
    got = {r.call: (r.worker, r.start, r.finish, r.timed_out) for r in on_workers(spark.createDataFrame(rows, "p long, c long, d double"), "p", "c", "d", 2, limit=4.0).collect()}
    free = {p: [0.0, 0.0] for p in range(3)}
    for p, c, d in rows:
        w = min(range(2), key=lambda i: (free[p][i], i))
        start, run = free[p][w], min(d, 4.0)
        free[p][w] = start + run
        assert got[c] == (w, start, start + run, d > 4.0)


def test_bursts_through_queues(spark):
    rows = [(None, 1, 5.0), (None, 2, 0.0)] + [(1, i, p) for i, p in enumerate([5.0, 3.0, 1.0, None, 2.0, 9.0])]
    df = spark.createDataFrame(rows, "p long, c long, rank double")
    order = lambda **options: [r.call for r in through_queue(df, "p", "c", **options).where("pool = 1 and state <> 'rejected'").orderBy("run_order").collect()]
    assert order() == [0, 1, 2, 3, 4, 5] and order(strategy="lifo") == [0, 5, 4, 3, 2, 1]
    assert order(strategy="priority", priority=F.col("rank")) == [0, 2, 4, 1, 3, 5]
    assert order(strategy="lifo", workers=2, max_waiting=3) == [0, 1, 4, 3, 2]
    assert through_queue(df, "p", "c").where("pool is null").count() == 2 and through_queue(df.where("false"), "p", "c").count() == 0


def test_stream_goes_on_after_a_failing_call(spark, tmp_path):
    spark.range(6).write.parquet(str(tmp_path / "in"))
    seen = []

    def odd(n):
        if n % 2:
            raise ValueError("odd")
        return n

    stream = offload_stream(spark.readStream.schema("id long").parquet(str(tmp_path / "in")), odd, ["id"], "long")
    run_to(stream, lambda df, n: seen.extend(df.collect()), str(tmp_path / "state")).awaitTermination(60)
    assert sorted((r.id, r.envelope.value) for r in seen if r.envelope.error is None) == [(0, 0), (2, 2), (4, 4)]
    assert len(seen) == 6
