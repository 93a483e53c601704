"""Operators on small inline rows."""

import json

from pyspark.sql import functions as F

from quillspark.operators import ordered, query_filter
from quillspark.sources import sinks, tables
from quillspark.streaming import events as live


def test_filter_terms():
    assert query_filter.terms('agent:x "two words" label:"a b" plain') == [("agent", "x"), (None, "two words"), ("label", "a b"), (None, "plain")]
    assert query_filter.number("$1.5k") == 1500 and query_filter.number("2m") == 2e6 and query_filter.number("x") is None


def test_unknown_keys_match_everything_and_warn(spark):
    df = spark.createDataFrame([("k1", "l", "s", 5), ("k2", None, "s", None)], "key string, label string, session_id string, total_tokens long")
    predicate, warnings = query_filter.compile_query("colour:red mintokens:many", df.columns)
    assert df.where(predicate).count() == 2 and len(warnings) == 2
    assert [r.key for r in query_filter.apply(df, "mintokens:3").collect()] == ["k1"]


def test_csv_guard(spark):
    df = spark.createDataFrame([("=1+1", 'say "hi"'), (None, "-2")], "a string, b string")
    assert [r.line for r in sinks.csv_lines(df, ["a", "b"]).collect()] == ['"\'=1+1","say ""hi"""', '"","\'-2"']


def test_keep_last_and_dead_letters(spark):
    df = spark.createDataFrame([("a", 1, 0), ("a", 2, 5), ("b", 1, 9)], "k string, t int, tries int")
    assert {(r.k, r.t) for r in sinks.keep_last(df, ["k"], ["t"], 1).collect()} == {("a", 2), ("b", 1)}
    assert [r.failed for r in sinks.dead_letters(df, "tries", 5, F.lit(None).cast("boolean")).orderBy("tries").collect()] == [False, True, True]


def test_mmr_prefers_what_differs(spark):
    df = spark.createDataFrame([("g", 1, 1.0, "a b c"), ("g", 2, 0.99, "a b c"), ("g", 3, 0.5, "x y z")], "g string, id long, score double, text string")
    rows = ordered.mmr(df, "g", "id", "score", "text", 0.5).orderBy("rank").collect()
    assert [r.id for r in rows] == [1, 3, 2]


def test_transcripts(spark, tmp_path):
    lines = [json.dumps({"type": "message", "message": {"role": "user", "content": "hi  there"}}), "", "{bad", json.dumps({"type": "message", "message": {"role": "system", "content": "no"}}),
             json.dumps({"type": "message", "message": {"role": "assistant", "content": [{"type": "text", "text": "yes"}]}})]
    (tmp_path / "s.jsonl").write_text("\n".join(lines))
    assert [(r.line, r.role, r.text) for r in tables.transcripts(spark, str(tmp_path)).orderBy("line").collect()] == [(1, "user", "hi there"), (5, "assistant", "yes")]


def test_stream_equals_batch(spark, tmp_path):
    sf = "/root/testdata/sf0.001/events.parquet"
    batch = spark.read.parquet(sf)
    batch.write.parquet(str(tmp_path / "in"))
    for name, twin in (("counters", live.counters), ("bursts", live.bursts)):
        query = twin(live.stream(spark, str(tmp_path / "in"), batch.schema)).writeStream.outputMode("complete" if name == "counters" else "append").format("memory").queryName(name).start()
        query.processAllAvailable()
        query.stop()
        got = {tuple(map(str, r)) for r in spark.table(name).collect()}
        want = {tuple(map(str, r)) for r in twin(batch.withColumn("ts", F.col("ts").cast("timestamp"))).collect()}
        assert got == want if name == "counters" else got <= want
