"""Waiting rows: plain simulations, the batch walk and streams cut in several ways give the same rows."""

import random
import tempfile

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from quillspark.plans import indexed
from quillspark.sources.tables import load
from quillspark.streaming import timers
from tests.test_indexes import compare

ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def plain(rule, rows):
    """A clock that visits every due time: (at, n, first, last, text) of one key's rows (ms, text, flag)."""
    held, out = timers.Held([]), []
    for ms, text, flag in rows:
        while held.due is not None and held.due <= ms:
            out += rule.expire(held)
        out += rule.step(held, ms, text, flag)
    due = held.due
    while held.due is not None and held.due == due:
        out += rule.expire(held)
    return out + (held.flush(held.rows[-1][0] if due is None else due, rule.joiner) if held.rows and hasattr(rule, "joiner") else [])


def history(seed, n=60):
    r, ms, out = random.Random(seed), 0, []
    for _ in range(n):
        ms += r.choice([0, 1, 3, 10, 10, 40, 200])
        out.append((ms, r.choice(["a", "bb", "c" * 9, "d" * 30, " ", "e" * 50]), r.choice([None, None, None, "now", "media", "m1", "m2"])))
    return out


RULES = [timers.Debounce(12), timers.Debounce(0), timers.Coalesce(1, 40, 25), timers.Coalesce(12, 40, 25), timers.Coalesce(5, 20, 0), timers.Throttle(15), timers.Throttle(300)]


@pytest.mark.parametrize("rule", RULES, ids=str)
def test_batch(spark, rule):
    rows = {k: history(k) for k in range(6)} | {None: history(9, 5)}
    data = [(k, ms, i, text, flag) for k, h in rows.items() for i, (ms, text, flag) in enumerate(h)] + [(77, 5, 0, None, None)]
    df = spark.createDataFrame(data, "k long, ms long, i long, text string, flag string").repartition(5)
    got = timers.waiting(df, rule, "k", "ms", "i", "text", F.col("flag")).collect()
    want = [(None if k is None else str(k), *s) for k, h in (*rows.items(), (77, [(5, "", None)])) for s in plain(rule, h)]
    assert sorted(map(repr, map(tuple, got))) == sorted(map(repr, want))
    assert timers.waiting(df.limit(0), rule, "k", "ms", "i", "text").count() == 0


def test_rules_by_hand():
    d = timers.Debounce(10)
    assert plain(d, [(0, "a", None), (9, "b", None), (19, "c", None), (20, "x", "now")]) == [(19, 2, 0, 9, "a\nb"), (20, 1, 19, 19, "c"), (20, 1, 20, 20, "x")]
    c = timers.Coalesce(3, 10, 5, "-")
    assert plain(c, [(0, "ab", None), (9, "cd", None), (11, "efghi", None), (12, "z", "m1"), (13, "", "media")]) == [(11, 2, 0, 9, "ab-cd"), (12, 1, 11, 11, "efghi"), (13, 1, 12, 12, "z"), (13, 1, 13, 13, "")]
    t = timers.Throttle(10)
    assert plain(t, [(0, "a", None), (1, "b", None), (2, "c", None), (11, "d", None), (50, "e", None)]) == [(0, 1, 0, 0, "a"), (10, 1, 2, 2, "c"), (20, 1, 11, 11, "d"), (50, 1, 50, 50, "e")]
    assert plain(t, [(0, "a", None), (1, "b", None), (2, " ", None), (30, "d", None)]) == [(0, 1, 0, 0, "a"), (30, 1, 30, 30, "d")]


def streamed(spark, folder, rule, flag, schema):
    events = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(folder)
    rows = indexed.live(events).withColumn("none", F.lit(None).cast("string"))
    out = timers.waiting_stream(rows, rule, "user_id", "ms", "event_id", "text", F.col(flag))
    name = "sent_" + rule.__class__.__name__.lower()
    query = out.writeStream.format("memory").queryName(name).outputMode("append").option("checkpointLocation", tempfile.mkdtemp(prefix="spark-")).trigger(availableNow=True).start()
    query.awaitTermination()
    held = [p["stateOperators"][0]["numRowsTotal"] for p in query.recentProgress if p["stateOperators"]]
    return [tuple(r) for r in spark.table(name).collect()], held


@pytest.mark.parametrize("name", list(indexed.RULES))
def test_streams_give_the_batch_rows(spark, name):
    """Events of 30 users in five files by time, then one row a user far later, whose watermark fires the last timers."""
    rule, flag = indexed.RULES[name]
    if name == "waiting_blocks":
        rule = timers.Coalesce(1, 200, 12 * 3_600_000)  # a short block waits for ever on a stream
    events = load(spark, "/root/testdata/sf0.001", "events").where("user_id < 30")
    folder = tempfile.mkdtemp(prefix="spark-")
    events = events.withColumn("part", F.ntile(5).over(Window.orderBy("ts", "event_id")))
    for k in range(1, 6):
        events.where(F.col("part") == k).drop("part").coalesce(1).write.mode("append").parquet(folder)
    late = events.drop("part").limit(1).withColumn("ts", F.lit("2030-01-01").cast("timestamp_ntz")).withColumn("user_id", F.lit(-1).cast("long"))
    late.withColumn("event_id", F.lit(-13).cast("long")).coalesce(1).write.mode("append").parquet(folder)
    rows = indexed.live(spark.read.parquet(folder)).withColumn("none", F.lit(None).cast("string"))
    want = [tuple(r) for r in timers.waiting(rows.where("user_id >= 0"), rule, "user_id", "ms", "event_id", "text", F.col(flag)).collect()]
    was = spark.conf.get("spark.sql.streaming.stateStore.providerClass", None)
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKS)
    try:
        got, held = streamed(spark, folder, rule, flag, rows.sparkSession.read.parquet(folder).schema)
    finally:
        spark.conf.set("spark.sql.streaming.stateStore.providerClass", was) if was else spark.conf.unset("spark.sql.streaming.stateStore.providerClass")
    assert sorted(x for x in got if x[0] != "-1") == sorted(want)
    assert max(held) < rows.count() and held[-1] <= 4  # what was sent is gone; the late user's row may wait


@pytest.mark.parametrize("name", list(indexed.RULES))
def test_waiting_oracles(spark, name):
    compare(spark, name)
