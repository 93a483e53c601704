"""Stateful stream operators: deduplication whose hits refresh the timer, and limits in windows anchored at the first request.

Rows of a key are taken in the order of time within each micro-batch; state is one small record for each key and goes when
the watermark passes its time to live. ``operators.ordered.ttl_dedupe`` and ``operators.stateful.fixed_window`` are the batch twins.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupStateTimeout


def _keyed(events: DataFrame, key: str, late: str) -> DataFrame:
    ms = F.unix_millis("ts")
    return events.withWatermark("ts", late).select(F.col(key).cast("string").alias("key"), "event_id", "ts", ms.alias("ms"))


def _sorted(frames) -> pd.DataFrame:
    return pd.concat(list(frames), ignore_index=True).sort_values(["ms", "event_id"], ignore_index=True)


def _expire(state, at: int) -> None:
    """The state goes when the watermark passes ``at``, or as soon as it can where it has passed already."""
    state.setTimeoutTimestamp(max(at, state.getCurrentWatermarkMs() + 1))


def refreshing_dedupe(events: DataFrame, key: str, ttl_ms: int, late: str = "1 day") -> DataFrame:
    """event_id and duplicate (within ``ttl_ms`` of the key's last event, duplicates counted)."""

    def step(_, frames, state):
        if state.hasTimedOut:
            state.remove()
            return
        rows = _sorted(frames)
        last = state.get[0] if state.exists else None
        before = rows["ms"].shift(1)
        if last is not None:
            before.iloc[0] = last
        newest = int(rows["ms"].iloc[-1]) if last is None else max(last, int(rows["ms"].iloc[-1]))
        state.update((newest,))
        _expire(state, newest + ttl_ms)
        yield pd.DataFrame({"event_id": rows["event_id"], "duplicate": (rows["ms"] - before) < ttl_ms})

    return _keyed(events, key, late).groupBy("key").applyInPandasWithState(
        step, "event_id long, duplicate boolean", "last long", "append", GroupStateTimeout.EventTimeTimeout)


def anchored_limit(events: DataFrame, key: str, width_ms: int, most: int, late: str = "1 day") -> DataFrame:
    """event_id and allowed (at most ``most`` in a window that the first event after the last window opens)."""

    def step(_, frames, state):
        if state.hasTimedOut:
            state.remove()
            return
        until, n = state.get if state.exists else (None, 0)
        rows, allowed = _sorted(frames), []
        for ms in rows["ms"]:
            if until is None or ms >= until:
                until, n = int(ms) + width_ms, 0
            n += 1
            allowed.append(n <= most)
        state.update((until, n))
        _expire(state, until)
        yield pd.DataFrame({"event_id": rows["event_id"], "allowed": allowed})

    return _keyed(events, key, late).groupBy("key").applyInPandasWithState(
        step, "event_id long, allowed boolean", "until long, n long", "append", GroupStateTimeout.EventTimeTimeout)
