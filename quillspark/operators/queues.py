"""Queues of waiting messages: bounded queues, entries that wait already, throttled updates, threads with a recent mention.

A queue is what a key gathers between two rows that drain it. All but ``throttled`` are windows: rows are dealt by key once
and sorted inside; a window's frame ends at the row at hand, so nothing of a key is held. ``throttled`` walks a key in order.
A null key is a key of its own.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillspark.operators.stateful import scan


def _round(df: DataFrame, key: str, order: list[str], drains: Column) -> DataFrame:
    """Adds _drain and _round, the number of drains up to a row (the drain itself counts)."""
    df = df.withColumn("_drain", F.coalesce(drains, F.lit(False)))
    return df.withColumn("_round", F.sum(F.col("_drain").cast("long")).over(Window.partitionBy(key).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)))


def short_line(text: Column, most: int = 160) -> Column:
    """A text on one line, cut to ``most`` characters with an ellipsis as the last; null as an empty line."""
    line = F.trim(F.regexp_replace(F.coalesce(text, F.lit("")), r"\s+", " "))
    return F.when(F.length(line) <= most, line).otherwise(F.concat(F.rtrim(F.substring(line, 1, most - 1)), F.lit("…")))


def bounded_queue(df: DataFrame, key: str, order: list[str], drains: Column, cap: int, policy: str = "old", text: str | None = None) -> DataFrame:
    """Adds ``fate``: drain, queued (it waits until the next drain) or dropped; a full queue loses its oldest entry (``old``,
    ``summarize``) or the new one (``new``). A cap of 0 or less drops nothing. ``summarize`` adds ``summary``, a line for each of
    the last ``cap`` dropped entries of a queue, null elsewhere."""
    df = _round(df, key, order, drains)
    of = Window.partitionBy(key, "_round", "_drain")
    place = F.row_number().over(of.orderBy(*order) if policy == "new" else of.orderBy(*[F.desc(c) for c in order]))
    df = df.withColumn("_place", place)
    fits = F.lit(cap <= 0) | (F.col("_place") <= cap)
    df = df.withColumn("fate", F.when(F.col("_drain"), "drain").when(fits, "queued").otherwise("dropped"))
    if policy == "summarize":
        df = df.withColumn("summary", F.when((F.col("fate") == "dropped") & (F.col("_place") <= 2 * cap), short_line(F.col(text))))
    return df.drop("_drain", "_round", "_place")


def waiting_already(df: DataFrame, key: str, order: list[str], drains: Column, route: list[str], message: str, prompt: str | None = None) -> DataFrame:
    """Adds ``again``: an entry of the same route and message id waits already. An entry without an id is never one, unless
    ``prompt`` is given: then it is one if an entry of its route waits with the same prompt. Drains are no entries."""
    df = _round(df, key, order, drains).withColumn("_id", F.nullif(F.trim(F.col(message).cast("string")), F.lit("")))
    past = lambda *by: Window.partitionBy(key, "_round", "_drain", *route, *by).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    df = df.withColumn("again", F.col("_id").isNotNull() & (F.count("*").over(past("_id")) > 0))
    if prompt:
        same = F.coalesce(F.count_if(~F.col("again")).over(past(prompt)), F.lit(0)) > 0
        df = df.withColumn("again", F.when(F.col("_id").isNull(), same).otherwise(F.col("again")))
    return df.withColumn("again", F.col("again") & ~F.col("_drain")).drop("_drain", "_round", "_id")


def throttled(df: DataFrame, key: str, ms: str, tie: str, text: str, width: int) -> DataFrame:
    """Adds ``sent_at`` (ms) and ``sent``: an update goes out at once if none did for ``width`` ms, else when they are over,
    and then only the latest does. A blank update takes the place of the one that waits but isn't sent."""

    def step(state, now, update):
        update = update.strip() if isinstance(update, str) else ""
        if "due" in state and now >= state["due"]:
            due = state.pop("due")
            if state["waits"]:
                state["sent"] = due
        if "due" not in state:
            if "sent" not in state or now - state["sent"] >= width:
                if update:
                    state["sent"] = now
                return now
            state["due"] = state["sent"] + width
        state["waits"] = update
        return state["due"]

    out = scan(df, key, [ms, tie], "sent_at", "long", dict, step, [ms, text])
    last = F.row_number().over(Window.partitionBy(key, "sent_at").orderBy(F.desc(ms), F.desc(tie))) == 1
    return out.withColumn("sent", last & (F.trim(F.coalesce(text, F.lit(""))) != ""))


def mentioned_lately(df: DataFrame, thread: list[str], ms: str, order: list[str], mention: Column, ttl: int) -> DataFrame:
    """Adds ``lately``: a mention stands in the thread at most ``ttl`` ms before a row (the row itself counts)."""
    last = F.max(F.when(mention, F.col(ms))).over(Window.partitionBy(*thread).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0))
    return df.withColumn("lately", F.coalesce(F.col(ms) - last <= ttl, F.lit(False)))
