"""State machines: stream = batch, timers, time to live, and rules by hand."""

import random
import tempfile
import time

import pytest

from quirestack.streaming import jobs, keyed


@pytest.fixture
def store(spark):
    spark.conf.set(*keyed.STORE)
    yield
    spark.conf.unset(keyed.STORE[0])


def cases():
    rng = random.Random(4)
    calls = [(rng.randrange(4), i, f"e{rng.randrange(30)}", i * 10.0 + rng.random(), rng.random() < 0.8) for i in range(600)]
    queue = [(rng.randrange(4), i, rng.choice(["submit", "submit", "done", "cancel"])) for i in range(600)]
    parts = [(k, i, "".join(rng.choices("abkey ", k=rng.randrange(5))), "done" if i == 39 else None) for k in range(4) for i in range(40)]
    gate = [(c[0], c[1], c[3], c[4]) for c in calls]
    return [
        ("cache", keyed.Cache(300.0, 5), "k long, call long, entry string, at double, ok boolean", calls, "call"),
        ("queue", keyed.Queue(), "k long, seq long, kind string", queue, "seq"),
        ("held", keyed.HoldBack("key"), "k long, seq long, part string, ends string", parts, "seq"),
        ("gate", keyed.Gate(35.0, 100.0), "k long, call long, at double, ok boolean", gate, "call"),
    ]


@pytest.mark.parametrize("name, machine, schema, rows, order", cases(), ids=lambda x: x if isinstance(x, str) and len(x) < 6 else "")
def test_stream_equals_batch_equals_loop(spark, store, name, machine, schema, rows, order):
    want = []
    for k in sorted({r[0] for r in rows}):
        state = machine.start()
        for r in sorted((r for r in rows if r[0] == k), key=lambda r: r[1]):
            state, found = machine.step(state, tuple(r[1:]))
            want += [(k, *f) for f in found]
        want += [(k, *f) for f in machine.finish(state)]
    df = spark.createDataFrame(rows, schema)
    assert sorted(map(repr, want)) == sorted(repr(tuple(r)) for r in keyed.over_batch(df, "k", order, machine).collect())
    place = tempfile.mkdtemp(prefix="spark-")
    cuts = sorted(r[1] for r in rows)
    for part in range(3):  # three micro-batches
        lo, hi = cuts[len(cuts) * part // 3], cuts[len(cuts) * (part + 1) // 3] if part < 2 else 10**9
        df.where(f"{order} >= {lo} AND {order} < {hi}").coalesce(1).write.mode("append").json(f"{place}/in/{part}")
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", True).json(f"{place}/in")
    got = jobs.drain(keyed.over_stream(stream, "k", order, machine), f"stream_{name}", f"{place}/state", "append").collect()
    # Over a stream that goes on, what waits for a next row hasn't left.
    open_ = [(k, *f) for k in sorted({r[0] for r in rows}) for f in _finish(machine, rows, k)]
    assert sorted(repr(tuple(r)) for r in got) == sorted(map(repr, [w for w in want if w not in open_]))


def _finish(machine, rows, k):
    state = machine.start()
    for r in sorted((r for r in rows if r[0] == k), key=lambda r: r[1]):
        state, _ = machine.step(state, tuple(r[1:]))
    return machine.finish(state)


def test_idle_timer_finishes_a_stream(spark, store):
    place = tempfile.mkdtemp(prefix="spark-")
    schema = "k long, seq long, part string, ends string"
    spark.createDataFrame([(1, 0, "abc se", None)], schema).coalesce(1).write.json(f"{place}/in/0")
    stream = spark.readStream.schema(schema).option("recursiveFileLookup", True).json(f"{place}/in")
    out = keyed.over_stream(stream, "k", "seq", keyed.HoldBack("secret"), idle_ms=500)
    running = out.writeStream.outputMode("append").format("memory").queryName("idle").option("checkpointLocation", f"{place}/state").start()
    try:
        until = time.time() + 90
        while time.time() < until and spark.table("idle").count() < 2:
            time.sleep(1)
        assert [tuple(r) for r in spark.table("idle").orderBy("part").collect()] == [(1, 0, "a"), (1, 0, "bc se")]
    finally:
        running.stop()


def test_cache_rules():
    cache, state, seen = keyed.Cache(10.0, 2), {}, []
    for row in [(1, "a", 0.0, True), (2, "a", 9.9, True), (3, "a", 10.0, True), (4, "b", 11.0, False), (5, "b", 12.0, True), (6, "a", 15.0, True), (7, "c", 16.0, True), (8, "a", 17.0, True)]:
        state, out = cache.step(state, row)
        seen.append(out[0][1:])
    assert seen == [(False, 1, 0), (True, 1, 0), (False, 1, 0), (False, 1, 0), (False, 2, 0), (True, 2, 0), (False, 2, 1), (False, 2, 1)]


def test_hold_back_of_stopped_and_empty():
    machine = keyed.HoldBack("secret")
    state, out = machine.step(machine.start(), (0, "my sec", None))
    state, more = machine.step(state, (1, "ret is", "stopped"))
    assert (out[0][1] + more[0][1], state[0]) == ("my [REDACTED] is"[:-5], "")
    assert keyed.HoldBack("").step(["", None], (0, "all", None)) == (["", 0], [(0, "all")])


def test_conditional_merge(spark):
    from quirestack.operators import dml

    old = spark.createDataFrame([(1, "a", "one"), (2, "b", "two"), (3, "c", "three"), (5, None, "no digest")], "k int, digest string, place string")
    writes = spark.createDataFrame(
        [(1, 1, "search", "a", "a2", "found"), (1, 2, "search", "a", "a3", "late"), (2, 1, "edit", None, "b2", "edited"), (2, 2, "search", "b", "b3", "lost"), (3, 1, "delete", None, None, None),
         (3, 2, "search", "c", "c2", "gone"), (4, 1, "search", None, "d", "unknown"), (4, 2, "edit", None, "d2", "new"), (4, 3, "search", "d2", None, "failed")],
        "k int, n int, kind string, expected string, made string, place string",
    )
    table, log = dml.conditional_merge(old, writes, "k", "digest", "n")
    assert sorted(map(tuple, table.collect()), key=str) == [(1, "a2", "found"), (2, "b2", "edited"), (4, "d2", "new"), (5, None, "no digest")]
    assert [r["applied"] for r in log.orderBy("k", "n").collect()] == [True, False, True, False, True, False, False, True, False]


def test_saved_deletes_dependents_of_changed_rows(spark):
    from quirestack.operators import dml

    old = spark.createDataFrame([(1, "a"), (2, "b"), (3, None)], "k int, digest string")
    new = spark.createDataFrame([(1, "a"), (2, "B"), (3, None), (4, "d")], "k int, digest string")
    kids = spark.createDataFrame([(1, "x"), (2, "y"), (2, "z"), (3, "u"), (4, "v"), (None, "w")], "of int, name string")
    papers, left = dml.saved(old, new, kids, "k", "digest", "of")
    assert sorted(map(tuple, papers.collect())) == [(1, "a"), (2, "B"), (3, None), (4, "d")]
    assert sorted(r["name"] for r in left.collect()) == ["u", "v", "w", "x"]
