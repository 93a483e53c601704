"""Window operators: budgets, expiry, suppression, as-of joins and re-ranking."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def ttl_dedupe(df: DataFrame, key: str, ts: str, tie: str, seconds: int) -> DataFrame:
    """Adds ``duplicate``: within the time to live of the key's last event, which a duplicate refreshes."""
    last = F.lag(ts).over(W.partitionBy(key).orderBy(ts, tie))
    return df.withColumn("duplicate", F.coalesce((F.unix_micros(F.col(ts).cast("timestamp")) - F.unix_micros(last.cast("timestamp"))) < seconds * 1_000_000, F.lit(False)))


def clamp_chars(df: DataFrame, key: str, order: list[str], text: str, budget: int) -> DataFrame:
    """Rows of each key until their texts fill the budget; the row that crosses it is cut."""
    before = F.coalesce(F.sum(F.length(text)).over(W.partitionBy(key).orderBy(*order).rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    out = df.withColumn("_before", before).where(F.col("_before") < budget)
    return out.withColumn(text, F.substring(F.col(text), F.lit(1), (F.lit(budget) - F.col("_before")).cast("int"))).drop("_before")


def evict_oldest(df: DataFrame, group: str, order: list[str], size: str, high: Column) -> DataFrame:
    """Adds ``evicted``: the oldest rows of a group go until the rest fits."""
    total = F.sum(size).over(W.partitionBy(group))
    before = F.coalesce(F.sum(size).over(W.partitionBy(group).orderBy(*order).rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    return df.withColumn("evicted", (total - before) > high)


def as_of(left: DataFrame, right: DataFrame, key: str, ts: str, value: str) -> DataFrame:
    """Adds to each left row the last right ``value`` at or before its time: one sort of both sides, no range join."""
    both = left.withColumn("_r", F.lit(1)).withColumn("_v", F.lit(None).cast(right.schema[value].dataType)).unionByName(
        right.select(key, ts, F.lit(0).alias("_r"), F.col(value).alias("_v")), allowMissingColumns=True)
    w = W.partitionBy(key).orderBy(ts, "_r").rowsBetween(W.unboundedPreceding, 0)
    return both.withColumn(value, F.last("_v", ignorenulls=True).over(w)).where("_r = 1").drop("_r", "_v")


def mmr(df: DataFrame, group: str, id_: str, score: str, text: str, weight: float = 0.7) -> DataFrame:
    """Maximal marginal relevance within each group of candidates (a bounded top-k): rank by weight * score (scaled to
    0..1) less (1 - weight) * the greatest Jaccard similarity of words with those ranked before."""
    schema = df.select(group, id_).schema.add("rank", "integer").add("mmr", "double")

    def run(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values([score, id_], ascending=[False, True], ignore_index=True)
        spread = frame[score].max() - frame[score].min()
        scaled = (frame[score] - frame[score].min()) / spread if spread > 0 else frame[score] * 0 + 1.0
        words = [set(t.lower().split()) for t in frame[text].fillna("")]
        left, near, out = list(frame.index), [0.0] * len(frame), []
        while left:
            best = max(left, key=lambda k: (weight * scaled[k] - (1 - weight) * near[k], frame[score][k], -k))
            out.append((frame[group][best], frame[id_][best], len(out) + 1, weight * scaled[best] - (1 - weight) * near[best]))
            left.remove(best)
            for k in left:
                union = len(words[k] | words[best])
                near[k] = max(near[k], len(words[k] & words[best]) / union if union else 1.0)
        return pd.DataFrame(out, columns=[group, id_, "rank", "mmr"])

    return df.select(group, id_, score, text).groupBy(group).applyInPandas(run, schema)
