"""Streams with state: equal to the batch forms, over several batches and a restart, and forgetting."""

import random
import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from postura.operators import evidence
from postura.streaming import state

EVENTS = "pid long, event string, ts double"


def run(stream, folder, name):
    """All that has arrived, then stop; the next call goes on where this one ended."""
    sink = str(folder / f"{name}-out")
    stream.writeStream.format("parquet").option("path", sink).option("checkpointLocation", str(folder / f"{name}-state")).outputMode("append").trigger(availableNow=True).start().awaitTermination()
    return stream.sparkSession.read.parquet(sink)


def arrive(spark, folder, k, rows, schema):
    spark.createDataFrame(rows, schema).repartition(3).write.parquet(str(folder / "in" / f"b{k}"))


def source(spark, folder, schema):
    state.with_state_store(spark)
    return spark.readStream.schema(schema).option("recursiveFileLookup", "true").parquet(str(folder / "in"))


def trace(seed, n):
    r = random.Random(seed)
    return [(r.randrange(4), r.choice(["enter", "leave", "leave", "aes", "sha"]), float(i)) for i in range(n)]


@pytest.mark.parametrize("before", [0, 2])
def test_depth_equals_a_counter(before):
    r = random.Random(before)
    steps = np.array([r.choice([1, -1, -1, 0]) for _ in range(300)])
    depth, want = before, []
    for s in steps:
        depth = max(0, depth + s)
        want.append(depth)
    assert state.depths(steps, before).tolist() == want


def test_setups_over_a_restart_equal_the_batch_form(spark, tmp_path):
    rows = trace(1, 400)
    for k in range(2):  # a new query each time, from the same checkpoint
        arrive(spark, tmp_path, k, rows[k * 200 : k * 200 + 200], EVENTS)
        out = run(state.without_setup(source(spark, tmp_path, EVENTS), "enter", "leave"), tmp_path, "setups")
    got = {(r.pid, r.event): (r.c, r.i) for r in out.groupBy("pid", "event").agg(F.sum("counted").alias("c"), F.sum("ignored").alias("i")).collect()}
    batch = spark.createDataFrame([(p, e, t, i) for i, (p, e, t) in enumerate(rows)], "pid long, function string, ts double, event_id long")
    deep = evidence.setup_depth(batch, "enter", "leave").where("function not in ('enter', 'leave')")
    want = {(r.pid, r.function): (r.c, r.i) for r in deep.groupBy("pid", "function").agg(F.sum(F.when(F.col("depth") == 0, 1).otherwise(0)).alias("c"), F.sum(F.when(F.col("depth") > 0, 1).otherwise(0)).alias("i")).collect()}
    assert got == want


def test_a_thread_that_went_away_is_forgotten(spark, tmp_path):
    arrive(spark, tmp_path, 0, [(1, "enter", 1.0), (1, "aes", 2.0)], EVENTS)
    stream = lambda: state.without_setup(source(spark, tmp_path, EVENTS), "enter", "leave", idle=1)
    run(stream(), tmp_path, "idle")
    time.sleep(0.2)
    arrive(spark, tmp_path, 1, [(2, "aes", 3.0)], EVENTS)  # another thread's batch lets the timer go off
    run(stream(), tmp_path, "idle")
    arrive(spark, tmp_path, 2, [(1, "aes", 9.0)], EVENTS)
    rows = run(stream(), tmp_path, "idle").where("pid = 1").groupBy("event").agg(F.sum("counted").alias("c"), F.sum("ignored").alias("i")).collect()
    assert [tuple(r) for r in rows] == [("aes", 1, 1)]


def test_distinct_values_are_bounded(spark, tmp_path):
    schema = "k string, v string"
    batches = [[("a", f"v{i % 5}") for i in range(20)] + [("b", None)], [("a", f"v{i % 9}") for i in range(9)] + [("b", "x")]]
    for k, rows in enumerate(batches):
        arrive(spark, tmp_path, k, rows, schema)
        out = run(state.bounded_distinct(source(spark, tmp_path, schema), "k", "v", 3), tmp_path, "distinct")
    total = {r.key: (r.n, r.d, r.kinds) for r in out.groupBy("key").agg(F.sum("count").alias("n"), F.sum("dropped").alias("d"), F.countDistinct("value").alias("kinds")).collect()}
    assert total["a"] == (15, 14, 3) and total["b"] == (2, 0, 2)


def test_sessions_end_with_the_watermark(spark, tmp_path):
    schema = "k string, event string, at timestamp"
    from datetime import datetime, timedelta

    t = lambda s: datetime(2026, 1, 1) + timedelta(seconds=s)
    for k, rows in enumerate([[("a", "aes", t(0)), ("a", "aes", t(5)), ("a", "sha", t(9)), ("a", "aes", t(11))], [("z", "aes", t(100))], [("z", "aes", t(200))]]):
        arrive(spark, tmp_path, k, rows, schema)
        out = run(state.sessions(source(spark, tmp_path, schema), "k", 10), tmp_path, "sessions")
    rows = {tuple(r) for r in out.where("key = 'a'").collect()}
    assert rows == {("a", "aes", 2, 0), ("a", "sha", 1, 0), ("a", "aes", 0, 1)}
