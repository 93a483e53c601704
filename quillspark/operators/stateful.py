"""Operators whose next decision needs the last one: limits, lockouts, coalesced blocks.

``scan`` deals rows by key, sorts each partition by key and order, and walks it in Arrow batches with one state, that of the
key at hand: memory is bounded by a batch however long a key's history is. A key is walked by one task, since each decision
needs the one before. A null key is a key of its own; ties in the order go by the last order column.
"""

from __future__ import annotations

from collections import deque
from collections.abc import Callable

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DataType, StructType


def scan(df: DataFrame, key: str, order: list[str], name: str, kind: DataType | str, fresh: Callable, step: Callable, reads: list[str]) -> DataFrame:
    """Adds column ``name``: ``step(state, *reads)`` for each row in order, where ``fresh()`` makes a key's first state."""
    schema = StructType(list(df.schema.fields)).add(name, kind)

    def run(frames):
        at, state = (), None
        for frame in frames:
            out = []
            for k, *values in zip(frame[key], *(frame[c] for c in reads)):
                k = None if pd.isna(k) else k
                if at != (k,):
                    at, state = (k,), fresh()
                out.append(step(state, *values))
            frame[name] = out
            yield frame

    return df.repartition(key).sortWithinPartitions(key, *order).mapInPandas(run, schema)


def _names(c: str | list[str]) -> list[str]:
    return [c] if isinstance(c, str) else list(c)


def window_counts(df: DataFrame, key: str, ms: str, tie: str | list[str], width: int) -> DataFrame:
    """Adds ``n``: a row's number in a window that a key's first row after the last window opens. Rows over a limit count too.

    Rows of one ``ms`` go by ``tie``, which may name several columns, the finer time first."""

    def step(state, now):
        if state.get("until") is None or now >= state["until"]:
            state.update(until=now + width, n=0)
        state["n"] += 1
        return state["n"]

    return scan(df, key, [ms, *_names(tie)], "n", "integer", dict, step, [ms])


def fixed_window(df: DataFrame, key: str, ms: str, tie: str | list[str], width: int, most: int) -> DataFrame:
    """Adds ``allowed``: at most ``most`` rows in a window of ``window_counts``."""
    return window_counts(df, key, ms, tie, width).withColumn("allowed", F.col("n") <= most).drop("n")


def remembered(df: DataFrame, namespace: str, key: str, ms: str, tie: str | list[str], ttl: int, most: int) -> DataFrame:
    """Adds ``duplicate``: the key was recorded in its namespace less than ``ttl`` ms ago (at any time if ``ttl`` is 0).

    A hit doesn't record again. A namespace holds its ``most`` last recorded keys, so its rows are walked by one task with that many
    in memory; without a need of the limit, ``fixed_window`` by namespace and key spreads further. Keys are trimmed; null and
    blank ones are never duplicates, and a blank namespace is ``global``."""

    def step(held, name, now):
        name = (name or "").strip()
        if not name:
            return False
        if name in held and (ttl <= 0 or now - held[name] < ttl):
            return True
        held.pop(name, None)
        held[name] = now  # rows come in the order of time, so the first entry is the oldest
        while len(held) > most or (ttl > 0 and now - next(iter(held.values())) >= ttl):
            del held[next(iter(held))]
        return False

    space = F.coalesce(F.nullif(F.trim(namespace), F.lit("")), F.lit("global"))
    return scan(df.withColumn("_space", space), "_space", [ms, *_names(tie)], "duplicate", "boolean", dict, step, [key, ms]).drop("_space")


def lockout(df: DataFrame, key: str, ms: str, tie: str | list[str], most: int, width: int, locked: int) -> DataFrame:
    """Adds ``allowed``: the attempt that makes ``most`` within ``width`` locks its key for ``locked`` ms, after which it starts afresh."""

    def step(state, now):
        seen = state.setdefault("seen", deque(maxlen=most))
        if now < state.get("until", now):
            return False
        if "until" in state:
            del state["until"]
            seen.clear()
        while seen and seen[0] <= now - width:
            seen.popleft()
        seen.append(now)
        if len(seen) >= most:
            state["until"] = now + locked
        return True

    return scan(df, key, [ms, *_names(tie)], "allowed", "boolean", dict, step, [ms])


def coalesce_blocks(df: DataFrame, key: str, order: str, size: str, most: int) -> DataFrame:
    """Adds ``block`` (from 0): rows join the open block until it would exceed ``most`` characters."""

    def step(state, n):
        if state and state["used"] + n > most:
            state.update(block=state["block"] + 1, used=0)
        state.setdefault("block", 0)
        state["used"] = state.get("used", 0) + n
        return state["block"]

    return scan(df, key, [order, size], "block", "integer", dict, step, [size])
