"""Queues, search urls and emoji that SQL doesn't tell: against plain Python."""

import random
import unicodedata

import pytest
import regex
from pyspark.sql import functions as F

from quillspark.functions import places
from quillspark.operators import queues
from quillspark.plans import waiting

SF = "/root/testdata/sf0.001"


def _sends(updates, width, until):
    """A clock that ticks every ms: {time: text} of what goes out."""
    sent, last, due, pending = {}, None, None, ""
    for now in range(until):
        if due == now:
            due = None
            if pending.strip():
                sent[now], last = pending, now
            pending = ""
        for text in updates.get(now, []):
            pending = text
            if due is None and (last is None or now - last >= width):
                if pending.strip():
                    sent[now], last = pending, now
                pending = ""
            elif due is None:
                due = last + width
    return sent


def test_throttle_against_a_clock(spark):
    r, rows, want = random.Random(5), [], {}
    for key in range(6):
        updates = {}
        for n in range(60):
            at, text = r.randrange(400), r.choice(["", " ", f"u{n}", f"v{n}"])
            rows.append((key, at, len(rows), text))
            updates.setdefault(at, []).append(text)
        want[key] = _sends(updates, 10 + 5 * key, 1000)
        out = queues.throttled(spark.createDataFrame([x for x in rows if x[0] == key], "key int, ms long, tie long, text string"), "key", "ms", "tie", "text", 10 + 5 * key)
        assert {x.sent_at: x.text for x in out.where("sent").collect()} == want[key]


def _queue(rows, cap, policy):
    waits, dropped, lines = [], [], []
    for id_, drain in rows:
        if drain:
            waits, lines = [], []
        elif len(waits) < cap:
            waits.append(id_)
        elif policy == "new":
            dropped.append(id_)
        else:
            dropped.append(waits.pop(0))
            waits.append(id_)
    return set(dropped)


@pytest.mark.parametrize("policy", ["old", "new", "summarize"])
def test_queue_against_plain_steps(spark, policy):
    r = random.Random(7)
    rows = [(n, r.random() < 0.15) for n in range(80)]
    df = spark.createDataFrame([(None, n, d, f"  line\n{n} ") for n, d in rows], "key int, n int, drain boolean, text string")
    out = queues.bounded_queue(df, "key", ["n"], F.col("drain"), 3, policy, "text")
    assert {x.n for x in out.where("fate = 'dropped'").collect()} == _queue(rows, 3, policy)
    if policy == "summarize":
        assert all(x.summary == f"line {x.n}" for x in out.where("summary is not null").collect()) and out.where("summary is not null").count()
    assert queues.bounded_queue(df, "key", ["n"], F.col("drain"), 0, policy, "text").where("fate = 'dropped'").count() == 0


def test_search_urls(spark):
    got = {x.id: (x.page, x.split) for x in waiting.search_urls(spark, SF).collect()}
    assert got[1][0] == "https://h.test/p/?keywords=a%20b&geo=%5B%221%22%5D&page=3"
    assert got[1][1] == "https://h.test/p/?keywords=a%20b&geo=%5B%227%22%5D&page=2 https://h.test/p/?keywords=a%20b&geo=%5B%228%22%5D&page=2"
    assert [got[k][0] for k in (2, 3, 4, 5)] == ["https://h.test/p/?keywords=a%20b", "https://h.test/p/?page=2", "https://h.test/p/", "https://h.test/?k=(it's)!~*&page=5"]


def test_emoji_go_and_letters_stay(spark):
    """All that today's tables call emoji or pictographs goes. Older tables held more symbols, so further ones may go, but no letter, digit or mark."""
    points = [c for c in range(0x80, 0x1FFFE) if not 0xD800 <= c < 0xE000]
    gone = {x.c for x in spark.createDataFrame([(c, f"a{chr(c)}b") for c in points], "c int, t string").where(places.compared(F.col("t")) == "ab").collect()}
    want = {c for c in points if regex.match(r"\p{Emoji_Presentation}|\p{Extended_Pictographic}", chr(c).lower())}
    assert want <= gone and {unicodedata.category(chr(c)) for c in gone - want} <= {"So", "Sm", "Cn"}


def test_shaped_text_cuts_and_masks(spark):
    df = spark.createDataFrame([("x" * 50,), (None,), ("",)], "t string").select(places.shaped_text(F.col("t"), 10).alias("s")).select("s.*")
    assert [tuple(x) for x in df.collect()] == [("x" * 10 + "\n…(truncated)…", True, False), (None, False, False), ("", False, False)]
