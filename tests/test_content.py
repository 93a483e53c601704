"""Chunking, fuzzy ranking, stateful operators and content functions against brute force and fixed cases."""

import hashlib

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from quillspark.functions import content, numbers, strings
from quillspark.operators import chunking, ordered, stateful
from quillspark.streaming import events as live
from quillspark.streaming import stateful as states

TEXTS = ["", "one", "a\n\nbb\n" + "x" * 100 + "\nend", "ü" * 50 + " " + "word " * 60, "\n\n", "a b\tc  d " * 40, None]


@pytest.fixture(scope="module")
def texts(spark):
    return spark.createDataFrame(list(enumerate(TEXTS)), "id long, text string").repartition(3)


def _by_id(df, *columns):
    out = {}
    for r in df.collect():
        out.setdefault(r["id"], []).append(tuple(r[c] for c in columns))
    return {k: sorted(v) for k, v in out.items()}


def test_chunks_hold_every_line(texts):
    got = _by_id(chunking.markdown(texts, "id", "text", 8, 2), "start_line", "end_line", "text", "hash")
    assert set(got) == {i for i, t in enumerate(TEXTS) if t is not None}
    for i, chunks in got.items():
        assert all(len(c) <= 32 + 8 + 32 and h == hashlib.sha256(c.encode()).hexdigest() for _, _, c, h in chunks)
        covered = {n for a, b, _, _ in chunks for n in range(a, b + 1)}
        assert covered == set(range(1, TEXTS[i].count("\n") + 2))


def test_chunks_without_overlap_join_to_the_text(spark):
    text = "\n".join(f"line {k}" for k in range(50))
    df = spark.createDataFrame([(1, text)], "id long, text string")
    rows = chunking.markdown(df, "id", "text", 8, 0).orderBy("start_line").collect()
    assert "\n".join(r.text for r in rows) == text and len(rows) > 5


@settings(max_examples=200, deadline=None)
@given(st.lists(st.integers(1, 40), max_size=30), st.integers(1, 60), st.integers(0, 30))
def test_ranges_cover_and_stay_small(sizes, most, overlap):
    runs = list(chunking.ranges(sizes, most, overlap))
    assert {k for a, b in runs for k in range(a, b)} == set(range(len(sizes)))
    assert all(x < y for (_, x), (_, y) in zip(runs, runs[1:]))
    if overlap == 0:
        assert all(b - a == 1 or sum(sizes[a:b]) <= most for a, b in runs)


@pytest.mark.parametrize("most", [1, 3, 7])
def test_byte_parts_join_to_the_text(texts, most):
    for i, parts in _by_id(chunking.byte_limited(texts, "id", "text", most), "part", "text").items():
        assert "".join(p for _, p in parts) == TEXTS[i] and all(len(p.encode()) <= max(most, 2) for _, p in parts)


def test_break_chunks_keep_words(texts):
    for i, parts in _by_id(chunking.at_breaks(texts, "id", "text", 60), "part", "text").items():
        words, want = " ".join(p for _, p in parts).split(), TEXTS[i].split()
        assert "".join(words) == "".join(want) and all(0 < len(p) <= 60 for _, p in parts)
        assert [w for w in words if len(w) < 30] == [w for w in want if len(w) < 30]  # only a word longer than a part is cut


def test_fuzzy_score(spark):
    df = spark.createDataFrame([("abc",), ("a-b-c",), ("xaxbxc",), ("cab",), (None,)], "label string")
    got = [r[0] for r in df.select(chunking.fuzzy_score("abc")("label")).collect()]
    # 0: run 1, start: -15; 1: run 2, +0.1 - 10; 2: run 3, +0.2 - 15
    assert got[0] == pytest.approx(-15 - 10 + 0.1 - 15 + 0.2) and got[2] is not None and got[3] is None and got[4] is None and got[0] < got[2]


def test_fixed_window_and_lockout(spark):
    rows = [("a", t, i) for i, t in enumerate([0, 10, 20, 99, 100, 150, 210])] + [(None, 5, 50), ("b", 0, 60)]
    df = spark.createDataFrame(rows, "k string, ms long, id long").repartition(4)
    got = {r.id: r.allowed for r in stateful.fixed_window(df, "k", "ms", "id", 100, 2).collect()}
    assert [got[i] for i in range(7)] == [True, True, False, False, True, True, True] and got[50] and got[60]
    got = {r.id: r.allowed for r in stateful.lockout(df, "k", "ms", "id", 3, 50, 100).collect()}
    assert [got[i] for i in range(7)] == [True, True, True, False, False, True, True]


def test_coalesced_blocks(spark):
    df = spark.createDataFrame([("a", i, n) for i, n in enumerate([4, 4, 4, 20, 1])], "k string, turn int, n int")
    assert [r.block for r in stateful.coalesce_blocks(df, "k", "turn", "n", 10).orderBy("turn").collect()] == [0, 0, 1, 2, 3]


def test_streams_equal_their_batch_twins(spark, tmp_path):
    batch = spark.read.parquet("/root/testdata/sf0.001/events.parquet")
    batch.orderBy("ts", "event_id").coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = live.stream(spark, str(tmp_path / "in"), batch.schema)
    hour, day = 3_600_000, 86_400_000
    query = states.refreshing_dedupe(stream, "user_id", day).writeStream.format("memory").queryName("deduped").start()
    query.processAllAvailable()
    query.stop()
    want = ordered.ttl_dedupe(batch, "user_id", "ts", "event_id", 86_400).select("event_id", "duplicate")
    assert {tuple(r) for r in spark.table("deduped").collect()} == {tuple(r) for r in want.collect()}
    query = states.anchored_limit(stream, "user_id", 48 * hour, 1).writeStream.format("memory").queryName("limited").start()
    query.processAllAvailable()
    query.stop()
    keyed = batch.select("event_id", "user_id", F.unix_millis(F.col("ts").cast("timestamp")).alias("ms"))
    want = stateful.fixed_window(keyed, "user_id", "ms", "event_id", 48 * hour, 1).select("event_id", "allowed")
    got = {tuple(r) for r in spark.table("limited").collect()}
    assert got == {tuple(r) for r in want.collect()} and {a for _, a in got} == {True, False}


def _one(spark, value, *columns):
    return tuple(spark.createDataFrame([(value,)], "c string").select(*columns).first())


def test_string_cases(spark):
    c = F.col("c")
    assert _one(spark, None, strings.hyphen_slug(c), strings.agent_id(c), strings.key_shape(c), strings.chat_type(c), strings.mask_api_key(c)) == ("", "main", "missing", "unknown", "missing")
    assert _one(spark, "agent::x", strings.key_rest(c), strings.key_shape(c)) == (None, "malformed_agent")
    assert _one(spark, "a:thread:b:topic:c", strings.thread_parent(c)) == ("a:thread:b",)
    assert _one(spark, "agent:a:subagent:x:subagent:subagent:y", strings.subagent_depth(c)) == (2,)
    assert _one(spark, "dentists, Ulm", strings.category_city(c)["city"]) == ("Ulm",)


def test_number_cases(spark):
    c = F.col("c")
    assert _one(spark, "1h30m", numbers.duration_ms(c)) == (5_400_000,) and _one(spark, "1h x", numbers.duration_ms(c)) == (None,)
    assert _one(spark, "UTC+5:30", numbers.offset_minutes(c)) == (330,) and _one(spark, "UTC+14:01", numbers.offset_minutes(c)) == (None,)
    assert _one(spark, "memory/2024-02-30.md", numbers.path_date(c)) == (None,) and _one(spark, "0 * * * *", numbers.stagger_ms(c)) == (300_000,)
    assert _one(spark, "nonsense", numbers.absolute_ms(c)) == (None,) and _one(spark, "1970-01-02", numbers.absolute_ms(c)) == (86_400_000,)


def test_content_cases(spark):
    c = F.col("c")
    assert _one(spark, "no block", F.size(content.front_matter(c))) == (0,)
    assert _one(spark, '{"custom_id":"a","response":{"body":{"data":[]}}}', content.batch_result(c)["error"]) == ("empty embedding",)
    assert _one(spark, 'noise [ {"a": 1}, {"b": 2} ] more', content.json_array_in(c)) == ('[ {"a": 1}, {"b": 2} ]',)
    assert _one(spark, "{bad", F.size(content.vector_of(c))) == (0,) and _one(spark, "[1, 2]", F.size(content.vector_of(c))) == (2,)
    assert _one(spark, "What is the API design", content.keywords(c)) == (["api", "design"],)
