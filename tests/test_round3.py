"""Queries on rows that the given tables don't hold or hold only when they are large: against SQL or plain versions."""

import random
from datetime import datetime

import duckdb
import pytest
from pyspark.sql import functions as F

from quillspark.functions import numbers, places, tables, text
from quillspark.operators import chunking, matching, patches, relational, vectors
from quillspark.plans import catalogue


def compared(spark, name, folder, tables):
    con = duckdb.connect()
    for t in tables:
        con.execute(f"create view {t} as select * from '{folder}/{t}.parquet/*.parquet'")
    con.execute("set timezone='UTC'")
    df = catalogue.queries()[name](spark, str(folder))
    columns = ", ".join(f'"{c}"' for c in sorted(df.columns))
    got, want = sorted(map(repr, map(tuple, df.select(*sorted(df.columns)).collect()))), con.execute(f"select {columns} from ({catalogue.oracles()[name]})").fetchall()
    assert got == sorted(map(repr, want))


def test_worst_status_without_rows(spark):
    """A key without rows is missing, not the last status."""
    asked = spark.createDataFrame([(k,) for k in (1, 2, 3, 4)] + [(None,)], "k long")
    rows = spark.createDataFrame([(1, "P", "b"), (1, "F", "c"), (2, "O", "a"), (3, "P", "d")], "k long, s string, e string")
    got = relational.worst_status(asked, rows, "k", "s", ["F", "P"], "e").collect()
    assert {r.k: (r.status, r.expires) for r in got} == {1: ("F", "b"), 2: ("other", "a"), 3: ("P", "d"), 4: ("missing", None), None: ("missing", None)}


@pytest.fixture(scope="module")
def fine_events(spark, tmp_path_factory):
    """Events whose order and milliseconds hang on their microseconds."""
    folder = tmp_path_factory.mktemp("fine")
    at = lambda *x: datetime(2024, 1, *x)
    rows = [
        (9, at(1, 0, 0, 0, 100), 1, "view"), (3, at(1, 0, 0, 0, 300), 1, "view"), (6, at(1, 0, 0, 0, 200), 1, "view"), (1, at(1, 1, 0, 0, 99_700), 1, "view"), (2, at(1, 0, 0, 0, 300), 1, "error"), (7, at(1, 1, 0, 0, 400), 1, "view"),
        (12, at(2, 6, 29, 59, 999_700), 2, "click"), (13, at(2, 6, 44, 59, 999_700), 2, "click"), (16, at(2, 6, 44, 59, 999_499), 2, "click"), (15, at(2, 6, 30, 0, 300), 2, "view"), (18, at(2, 12, 30, 0, 100), 2, "view"), (19, at(2, 12, 30, 0, 0), 2, "error"),
    ]
    rows = [(i, t, u, kind, 1.0, '{"k": 1}') for i, t, u, kind in rows]
    spark.createDataFrame(rows, "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string").write.parquet(f"{folder}/events.parquet")
    return folder


@pytest.mark.parametrize("name", ["counted_window_limit", "fixed_window_limit", "persistent_dedupe", "sliding_lockout", "cron_next_runs", "mentioned_lately", "waiting_bursts", "waiting_blocks", "waiting_updates"])
def test_microseconds(spark, fine_events, name):
    compared(spark, name, fine_events, ["events"])


def test_nearest_ms(spark):
    said = ["2024-01-01 00:14:59.999500", "2024-01-01 00:14:59.999499", "1960-01-01 00:14:59.999500", "1960-01-01 00:14:59.999700"]
    got = spark.createDataFrame([(s,) for s in said], "s string").select(numbers.nearest_ms(F.col("s").cast("timestamp_ntz"))).collect()
    want = [duckdb.connect().execute(f"select epoch_ms(timestamp '{s}')").fetchone()[0] for s in said]
    assert [r[0] for r in got] == want


def test_cosine_scan(spark, tmp_path, monkeypatch):
    """Repeated ids and queries, copies, ties, zeros, nulls, nulls inside; any slices and blocks give the SQL's rows."""
    r = random.Random(4)
    v = lambda: [round(r.gauss(0, 1), 3) for _ in range(4)]
    rows = [(k, v()) for k in range(300)]
    rows += [(1000 + k, rows[k % 7][1]) for k in range(90)] + [(40, v()), (41, v()), (2000, [0.0] * 4), (2001, [0.0] * 4), (2020, None), (2002, None), (None, v())]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").repartition(3)
    df.write.parquet(f"{tmp_path}/embeddings.parquet")
    compared(spark, "cosine_topk", tmp_path, ["embeddings"])
    monkeypatch.setattr(vectors, "BLOCK_BYTES", 200)
    monkeypatch.setattr(vectors, "QUERY_SLICE", 2)
    monkeypatch.setattr(vectors, "ROW_SLICE", 5)
    compared(spark, "cosine_topk", tmp_path, ["embeddings"])
    few = spark.createDataFrame([(0, [1.0, 0.0]), (20, [1.0]), (1, [2.0, 0.0]), (2, [1.0, None]), (3, [5.0])], "vec_id long, embedding array<double>")
    got = vectors.nearest(few, "vec_id", "embedding", few.where("vec_id % 20 = 0"), 9).collect()
    assert sorted((x.query_id, x.place, x.id, x.score) for x in got if x.place == 1) == [(0, 1, 1, 1.0), (20, 1, 3, 1.0)] and len(got) == 8
    assert vectors.nearest(few, "vec_id", "embedding", few.limit(0), 9).count() == 0
    plan = catalogue.queries()["cosine_topk"](spark, str(tmp_path))._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "CartesianProduct" not in plan


def test_patches_keep_the_driver_small(spark, tmp_path):
    """No side that grows with the documents is broadcast, and the plan doesn't grow with the levels."""
    plans = []
    for depth in (2, 7):
        rows = [(k, 0, '{"a":' * depth + str(k) + "}" * depth) for k in range(5)] + [(k, 1, '{"a":{"b":null}}') for k in range(5)]
        done = patches.folded(spark.createDataFrame(rows, "doc long, seq long, json string"), "doc", "seq", "json", f"{tmp_path}/{depth}", True)
        plans.append(done._jdf.queryExecution().executedPlan().toString())
        assert done.count() == 5
    assert all("Broadcast" not in p for p in plans) and len(plans[1]) < 1.2 * len(plans[0])


def test_redaction_with_hints(spark):
    """A text without hints has no secret: the hints change nothing."""
    r = random.Random(8)
    parts = ["API_KEY=", "token: ", '"apiKey" : "', "--password ", "authorization = bearer ", "Bearer ", "sk-", "GHP_", "github_pat_", "xoxb-", "xapp-", "gsk_", "AIzA", "pplx-", "npm_", "bot", "123456:", "K", "İ", "x", " ", '"', "-----BEGIN PRIVATE KEY-----\n", "\n-----END PRIVATE KEY-----"]
    said = ["".join(r.choice(parts) + r.choice(["", " ", "Ab1_" * r.randrange(1, 9)]) for _ in range(r.randrange(1, 6))) for _ in range(600)] + [None, ""]
    df = spark.createDataFrame([(s,) for s in said], "t string")
    plain = F.col("t")
    for pattern in text.SECRETS:
        for found, by in text._mask_steps(pattern):
            plain = F.regexp_replace(plain, "(?i)" + found, by)
    got = df.select(text.redact_all(df.t).alias("a"), plain.alias("b"), df.t).collect()
    assert all(x.a == x.b for x in got) and sum(x.a != x.t for x in got) > 200


def test_texts_are_shaped_once(spark):
    """The documents' texts are folded in one place of the plan."""
    docs, items = spark.createDataFrame([(1, " Some  TEXT here ")], "d long, text string"), spark.createDataFrame([(1, "some text")], "i long, text string")
    df = matching.contained_either(docs, "d", items, "i", "text", 9)
    assert [tuple(x) for x in df.collect()] == [(1, 1, True, False)]
    plan = df._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("lower(trim(text") == 1


def test_pieces_and_tables_go_by_arrow(spark):
    """Neither a batch's texts nor its pieces are held as pandas columns."""
    df = spark.range(700).select("id", F.concat(F.lit("| a |\n|---|\n| "), F.col("id"), F.lit(" |")).alias("text")).union(spark.createDataFrame([(-1, None)], "id long, text string"))
    parts, told = chunking.byte_limited(df, "id", "text", 5), df.select("id", tables.tables_converted(F.col("text"), "bullets").alias("t"))
    assert "MapInPandas" not in parts._jdf.queryExecution().executedPlan().toString()
    joined = {}
    for x in parts.orderBy("id", "part").collect():
        joined[x.id] = joined.get(x.id, "") + x.text
    assert joined == {x.id: x.text for x in df.where("id >= 0").collect()}
    assert {x.id: x.t for x in told.collect()} == {-1: None} | {k: f"• {k}" for k in range(700)}


def test_probed_scores_are_sliced(spark, tmp_path, monkeypatch):
    """A cell's scores are made for some queries at a time; slices change nothing."""
    r = random.Random(5)
    rows = spark.createDataFrame([(k, [r.gauss(0, 1) for _ in range(4)]) for k in range(200)], "vec_id long, v array<double>")
    index = vectors.build(rows, "vec_id", "v", f"{tmp_path}/v", 4, 3)
    found = lambda: sorted(map(tuple, vectors.search(index, rows, "vec_id", "v", 3, 2).collect()))
    want = found()
    monkeypatch.setattr(vectors, "QUERY_SLICE", 7)
    assert found() == want and len(want) == 600


def test_first_looks_lose_no_character(spark):
    """The short ranges before the long classes change no text."""
    every = spark.range(1, 0x20000).where("id not between 55296 and 57343").select(F.expr("decode(unhex(lpad(hex(id), 8, '0')), 'UTF-32')").alias("c"))
    t = F.lower(F.concat(F.lit("a"), "c", F.lit("b")))
    plain = F.regexp_replace(F.regexp_replace(t, places.EMOJI, ""), places.SPACES, " ")
    assert every.where(~places.compared(t).eqNullSafe(plain)).count() == 0 and every.where(F.length(plain) == 2).count() > 500
