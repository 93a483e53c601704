"""Rows that wait for a timer: debounced bursts, coalesced blocks, throttled updates, on streams and in batch.

A rule says what a row does to what waits under its key. ``Waiting`` runs it on a stream with ``transformWithState``: what
waits is list state, when it is due is value state, and a timer sends what no further row will. ``waiting`` runs the same rule over a table, dealt
by key and walked in order. Rows of a key are taken in the order of time in each micro-batch, and what was due before a row is
sent before the row is looked at, so a stream gives the batch's rows however it is cut, as long as its rows come in order.

With event time, timers fire when the watermark passes them. With processing time they fire by the clock; there ``ttl_ms`` also
lets what a key holds lapse by itself if its timer is lost. A key's state is at most what one burst, block or update holds, and is gone once sent (a throttle keeps the time
of what it sent until its window is over).

A sent row has key, at (ms when it is sent), n (rows in it), first and last (their ms) and text. Null texts count as empty; a null key is a
key of its own in batch and on streams.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from datetime import timedelta

import pandas as pd
from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

SENT = "key string, at long, n long, first long, last long, text string"
_sent = Row("key", "at", "n", "first", "last", "text")


@dataclass
class Held:
    """What waits under a key: (ms, text) of its rows, when they are due, and a note that the rule keeps (a conflict's id, the last time sent)."""

    rows: list[tuple[int, str]]
    due: int | None = None
    note: str | None = None
    sent: int | None = None

    def flush(self, at: int, joiner: str) -> list[tuple]:
        rows, self.rows, self.due = self.rows, [], None
        return [(at, len(rows), rows[0][0], rows[-1][0], joiner.join(t for _, t in rows))] if rows else []

    def empty(self) -> bool:
        return not self.rows and self.sent is None


@dataclass(frozen=True)
class Debounce:
    """A burst waits until its key is silent for ``gap`` ms; a row flagged ``now`` sends the burst, then itself."""

    gap: int
    joiner: str = "\n"

    def step(self, held: Held, ms: int, text: str, flag: str | None) -> Iterator[tuple]:
        if flag == "now" or self.gap <= 0:
            yield from held.flush(ms, self.joiner)
            yield ms, 1, ms, ms, text
        else:
            held.rows.append((ms, text))
            held.due = ms + self.gap

    def expire(self, held: Held) -> Iterator[tuple]:
        yield from held.flush(held.due, self.joiner)


@dataclass(frozen=True)
class Coalesce:
    """Texts are joined until they would pass ``most`` characters, another id is answered, media come or the key is idle.

    The flag is the id answered, or ``media``, which sends the block and itself at once. An idle block under ``least``
    characters waits for another ``idle`` ms each time, and is sent by whatever else sends it. Blank texts are dropped."""

    least: int
    most: int
    idle: int
    joiner: str = "\n"

    def _size(self, held: Held) -> int:
        return sum(len(t) for _, t in held.rows) + len(self.joiner) * (len(held.rows) - 1)

    def step(self, held: Held, ms: int, text: str, flag: str | None) -> Iterator[tuple]:
        if flag == "media":
            yield from held.flush(ms, self.joiner)
            yield ms, 1, ms, ms, text
            return
        if not text.strip():
            return
        if held.rows and flag and flag != held.note:
            yield from held.flush(ms, self.joiner)
        if held.rows and self._size(held) + len(self.joiner) + len(text) > self.most:
            yield from held.flush(ms, self.joiner)
        if not held.rows:
            held.note = flag
        held.rows.append((ms, text))
        held.due = ms + self.idle if self.idle > 0 else None
        if self._size(held) >= self.most:
            yield from held.flush(ms, self.joiner)

    def expire(self, held: Held) -> Iterator[tuple]:
        if self._size(held) < self.least:
            held.due += self.idle
        else:
            yield from held.flush(held.due, self.joiner)


@dataclass(frozen=True)
class Throttle:
    """The latest text goes out, at most one in ``width`` ms; a blank one takes the place of what waits and isn't sent."""

    width: int

    def step(self, held: Held, ms: int, text: str, flag: str | None) -> Iterator[tuple]:
        if held.due is None and (held.sent is None or ms - held.sent >= self.width):
            if text.strip():
                held.sent = ms
                yield ms, 1, ms, ms, text
            return
        held.rows = [(ms, text)]
        held.due = held.sent + self.width

    def expire(self, held: Held) -> Iterator[tuple]:
        at, (ms, text) = held.due, held.rows[-1]
        held.rows, held.due = [], None
        if text.strip():
            held.sent = at
            yield at, 1, ms, ms, text


def _advance(rule, held: Held, now: int, open_end: bool = False) -> Iterator[tuple]:
    """Sends what is due at ``now`` or before. A short block that only waits again isn't due for good: one more look is enough."""
    while held.due is not None and held.due <= now:
        due = held.due
        yield from rule.expire(held)
        if held.due is not None and held.due > due and not isinstance(rule, Throttle):
            held.due += -(-max(0, now - held.due + 1) // rule.idle) * rule.idle if held.due <= now else 0


def _taken(df: DataFrame, key: str, ms: str, tie: str, text: str, flag: Column | None) -> DataFrame:
    flag = F.lit(None) if flag is None else flag
    return df.select(F.col(key).cast("string").alias("key"), F.col(ms).cast("long").alias("ms"), F.col(tie).alias("tie"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text"), flag.cast("string").alias("flag"))


def waiting(df: DataFrame, rule, key: str, ms: str, tie: str, text: str, flag: Column | None = None) -> DataFrame:
    """The rows that ``rule`` sends over a whole table; what still waits at its end is sent when it is due, a short idle block at the end itself.

    A key is walked by one task, as each row needs what the one before left; memory is bounded by an Arrow batch and what waits."""

    def ended(held: Held) -> Iterator[tuple]:
        while held.due is not None:
            due = held.due
            yield from rule.expire(held)
            if held.due is not None and held.due > due and held.rows and isinstance(rule, Coalesce):
                yield from held.flush(due, rule.joiner)
        yield from held.flush(held.rows[-1][0] if held.rows else 0, getattr(rule, "joiner", ""))

    def run(frames):
        at, held = (), None
        for frame in frames:
            out = []
            for k, now, text_, flag_ in zip(frame["key"], frame["ms"].tolist(), frame["text"], frame["flag"]):
                k, flag_ = None if pd.isna(k) else k, None if pd.isna(flag_) else flag_
                if at != (k,):
                    if held:
                        out += [(at[0], *r) for r in ended(held)]
                    at, held = (k,), Held([])
                for sent in (*_advance(rule, held, now), *rule.step(held, now, text_, flag_)):
                    out.append((k, *sent))
            yield pd.DataFrame(out, columns=["key", "at", "n", "first", "last", "text"])
        if held:
            yield pd.DataFrame([(at[0], *r) for r in ended(held)], columns=["key", "at", "n", "first", "last", "text"])

    rows = _taken(df, key, ms, tie, text, flag)
    return rows.repartition("key").sortWithinPartitions("key", "ms", "tie").drop("tie").mapInPandas(run, SENT)


class Waiting(StatefulProcessor):
    """Runs a rule on a stream. State of a key: the rows that wait (list), and due time, note and last time sent (value)."""

    def __init__(self, rule, event_time: bool = True, ttl_ms: int | None = None):
        self.rule, self.event_time, self.ttl_ms = rule, event_time, ttl_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        ttl = {} if self.event_time or not self.ttl_ms else {"ttlDurationMs": self.ttl_ms}
        self.rows = handle.getListState("rows", "ms long, text string", **ttl)
        self.rest = handle.getValueState("rest", "due long, note string, sent long", **ttl)

    def _load(self) -> Held:
        due, note, sent = self.rest.get() if self.rest.exists() else (None, None, None)
        return Held([(r[0], r[1]) for r in self.rows.get()] if self.rows.exists() else [], due, note, sent)

    def _store(self, held: Held, was: int | None, timer: int | None) -> None:
        """Keep what waits, and one timer for when it is due (a throttle's state also goes by a timer, once its window is over)."""
        if was is not None and was != timer:
            self.handle.deleteTimer(was)
        if timer is not None and was != timer:
            self.handle.registerTimer(timer)
        if held.empty():
            self.rows.clear(), self.rest.clear()
            return
        if held.rows:
            self.rows.put(held.rows)
        elif self.rows.exists():
            self.rows.clear()
        self.rest.update((held.due, held.note, held.sent))

    def _timer(self, held: Held) -> int | None:
        return held.due if held.due is not None else held.sent + self.rule.width if held.sent is not None else None

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        held = self._load()
        was = self._timer(held)
        for r in sorted(rows, key=lambda r: (r["ms"], r["tie"])):
            now = r["ms"] if self.event_time else timerValues.getCurrentProcessingTimeInMs()
            for sent in (*_advance(self.rule, held, now), *self.rule.step(held, now, r["text"], r["flag"])):
                yield _sent(*key, *sent)
        self._store(held, was, self._timer(held))

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        at, held = expiredTimerInfo.getExpiryTimeInMs(), self._load()
        now = timerValues.getCurrentWatermarkInMs() if self.event_time else timerValues.getCurrentProcessingTimeInMs()
        if held.due is None and held.sent is not None and held.sent + self.rule.width <= at:
            held.sent = None  # the window is over and nothing waits
        for sent in _advance(self.rule, held, max(at, now)):
            yield _sent(*key, *sent)
        self._store(held, None, self._timer(held))


def waiting_stream(events: DataFrame, rule, key: str, ms: str, tie: str, text: str, flag: Column | None = None, late: str = "0 seconds", event_time: bool = True, ttl_ms: int | None = None) -> DataFrame:
    """The stream twin of ``waiting``; ``ms`` is the row's time in milliseconds. The session's state store must be RocksDB's."""
    rows = _taken(events, key, ms, tie, text, flag)
    if event_time:
        rows = rows.withColumn("ts", F.timestamp_millis("ms")).withWatermark("ts", late)
    return rows.groupBy("key").transformWithState(Waiting(rule, event_time, ttl_ms), SENT, "append", "eventTime" if event_time else "processingTime")


def minutes(n: float) -> int:
    return int(timedelta(minutes=n).total_seconds() * 1000)
