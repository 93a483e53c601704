"""Benchmark decontamination: rare n-gram seeds, then Smith-Waterman alignment.

Words are runs of letters and digits in lower case. ``MATCH`` for a word, ``MISS`` for another word, ``GAP`` for a word more or less: the
score is the best local alignment over that of the item with itself; ``THRESHOLD`` and above is a leak.

Seeds are pairs of words, next to each other or with one word between, in the item as in the document. They lose no leak: an alignment
of m of an item's n words that scores a share T has e <= 2m - 2Tn words changed, added or left out. Of its m - 1 steps from a match to
the next, those with two or more of them are e / 2 at most, so Tn - 1 steps have one or none, and each is a seed from another position of
the item. So of an item's positions those whose seeds are the most common in the benchmark are left out (half of the steps that must be
there), and the rare ones must give the other half, all within a drift of e words. One pass joins documents to items on these
seeds; where enough meet, the passage around them, as far as an alignment over the threshold reaches, is aligned. Passages
that hold too few of the item's words for the threshold are not aligned, which loses none. A long document's seeds are joined in
stretches of ``STRETCH`` words that overlap by the longest alignment.

The items are broadcast in blocks of at most ``BLOCK_BYTES`` of text; a larger benchmark takes more blocks, each with its own
pass. Documents are never shuffled.

Nulls: a null or empty text holds no passage, and a null item or one of fewer than ``LEAST_WORDS`` words matches nothing.
Items with equal texts each get their rows, as do repeated rows of documents.
"""

from __future__ import annotations

import math
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillspark.llm.common import documents, keep_where, mixed, prefix_hash, rows_of, table

LEAST_WORDS, THRESHOLD, BLOCK_BYTES, STRETCH = 3, 0.5, 16 << 20, 1 << 15
MATCH, MISS, GAP = 2, -1, -1
_WORD = re.compile(r"\w+")
_ROWS = "doc_id long, item_id long, score double, seeds int, start_word int, end_word int"


def word_hashes(text: str | None) -> np.ndarray:
    """Hash of each word."""
    data = np.frombuffer(" ".join(_WORD.findall((text or "").lower())).encode("utf-8", "replace"), np.uint8)
    if not len(data):
        return np.zeros(0, np.uint64)
    space = np.flatnonzero(data == 32)
    starts, ends = np.concatenate(([0], space + 1)), np.concatenate((space, [len(data)]))
    sums, inverse = prefix_hash(data)
    return mixed((sums[ends] - sums[starts]) * inverse[starts])


def seeds_of(words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(position of its first word, hash) of each pair of words that are next to each other or have one between."""
    both = [words[: max(0, len(words) - d)] * np.uint64(0x9E3779B97F4A7C15) + words[d:] for d in (1, 2)]
    return np.concatenate([np.arange(len(x)) for x in both]), mixed(np.concatenate(both))


def align(item: np.ndarray, passage: np.ndarray) -> tuple[float, int, int]:
    """Smith-Waterman: (score over the item's own, first and last position of the passage in the best alignment)."""
    m = len(passage)
    ramp = np.arange(m + 1) * -GAP
    row, origin = np.zeros(m + 1, np.int64), np.arange(m + 1)
    best, where = 0, (0, 0)
    for word in item:
        step = np.where(passage == word, MATCH, MISS)
        fresh, came = np.zeros(m + 1, np.int64), np.arange(m + 1)
        diagonal, above = row[:-1] + step, row[1:] + GAP
        fresh[1:] = np.maximum(0, np.maximum(diagonal, above))
        came[1:] = np.where(fresh[1:] == 0, came[1:], np.where(diagonal >= above, origin[:-1], origin[1:]))
        level = np.maximum.accumulate(fresh + ramp)  # gaps along the passage: a score loses 1 for each word skipped
        source = np.maximum.accumulate(np.where(fresh + ramp == level, np.arange(m + 1), 0))
        row, origin = level - ramp, came[source]
        if (k := int(row.argmax())) and row[k] > best:
            best, where = int(row[k]), (int(origin[k]), k)
    return best / (MATCH * max(1, len(item))), *where


class Items:
    """A block of test items with a sorted table of the seeds at their rare positions."""

    def __init__(self, rows, threshold: float = THRESHOLD):
        self.ids, self.threshold = [r[0] for r in rows], threshold
        self.words = [word_hashes(r[1]) for r in rows]
        self.flat = np.concatenate([*self.words, np.zeros(0, np.uint64)])
        self.end = np.cumsum([len(w) for w in self.words], dtype=np.int64)
        sizes = np.array([len(w) for w in self.words], np.int64)
        steps = np.array([max(1, math.ceil(threshold * n - 1 - 1e-9)) for n in sizes.tolist()], np.int64)
        spare = (steps - 1) // 2  # positions that may be left out
        self.need, self.reach = steps - spare, np.ceil((2 - 2 * threshold) * sizes).astype(np.int64)
        self.span = int((sizes + self.reach).max(initial=0)) + 2
        both = [seeds_of(w if len(w) >= LEAST_WORDS else w[:0]) for w in self.words]
        at = np.concatenate([*(x for x, _ in both), np.zeros(0, np.int64)]).astype(np.int64)
        seeds = np.concatenate([*(x for _, x in both), np.zeros(0, np.uint64)])
        item_of = np.repeat(np.arange(len(rows)), [len(x) for x, _ in both])
        place = (self.end - sizes)[item_of] + at  # of the position among all items' words
        _, which, uses = np.unique(seeds, return_inverse=True, return_counts=True)
        common = np.zeros(len(self.flat), np.int64)
        np.maximum.at(common, place, uses[which])
        owner = np.repeat(np.arange(len(rows)), sizes)
        order = np.lexsort((-common, owner))
        nth = np.arange(len(order)) - (self.end - sizes)[owner[order]]
        rare = np.zeros(len(self.flat), bool)
        rare[order] = nth >= spare[owner[order]]
        kept = rare[place]
        item_of, at, seeds = item_of[kept], at[kept], seeds[kept]
        order = np.argsort(seeds, kind="stable")
        self.item_of, self.at = item_of[order], at[order]
        self.seeds, self.first = np.unique(seeds[order], return_index=True)
        self.first = np.append(self.first, len(seeds))
        bits = max(16, min(26, 4 + len(seeds).bit_length()))
        self.shift, self.maybe = np.uint64(64 - bits), np.zeros(1 << bits, bool)  # spares most searches in the table
        self.maybe[self.seeds >> self.shift] = True

    def hits(self, words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(item, where the item's first word would stand) of the seeds that meet in places dense enough for a leak, in that order."""
        places, seeds = seeds_of(words)
        likely = np.flatnonzero(self.maybe[seeds >> self.shift])
        none = np.zeros(0, np.int64)
        if not len(likely) or not len(self.seeds):
            return none, none
        places, seeds = places[likely], seeds[likely]
        k = np.minimum(np.searchsorted(self.seeds, seeds), len(self.seeds) - 1)
        found = np.flatnonzero(self.seeds[k] == seeds)
        places, k = places[found], k[found]
        n = self.first[k + 1] - self.first[k]
        rows = np.repeat(self.first[k] - np.concatenate(([0], np.cumsum(n)[:-1])), n) + np.arange(n.sum()) if len(k) else none
        item, start = self.item_of[rows], np.repeat(places, n) - self.at[rows]
        order = np.lexsort((start, item))
        item, start = item[order], start[order]
        a = np.arange(len(item))
        b = a + self.need[item] - 1
        a, b = a[b < len(item)], b[b < len(item)]
        dense = (item[a] == item[b]) & (start[b] - start[a] <= self.reach[item[a]])
        edge = np.zeros(len(item) + 1, np.int64)
        np.add.at(edge, a[dense], 1)
        np.add.at(edge, b[dense] + 1, -1)
        near = np.cumsum(edge[:-1]) > 0
        return item[near], start[near]

    def possible(self, items: np.ndarray, words: np.ndarray) -> np.ndarray:
        """Those of the items of which a share ``threshold`` of the words stands among ``words``: no other reaches that score."""
        n = np.array([len(self.words[i]) for i in items], np.int64)
        ends = np.cumsum(n)
        there = np.isin(self.flat[np.repeat(self.end[items] - ends, n) + np.arange(n.sum())], words)
        return items[np.add.reduceat(there, ends - n, dtype=np.int64) / n >= self.threshold]

    def leaks(self, words: np.ndarray):
        """(item's id, score, seeds, first and last word) of each item that leaked into a document."""
        best: dict[int, tuple[float, int, int, int]] = {}
        for at in range(0, max(1, len(words) - self.span), STRETCH):
            item, start = self.hits(words[at : at + STRETCH + self.span])
            if len(item):
                self._align(words, item, start + at, best)
        for k in sorted(best):
            yield self.ids[k], *best[k]

    def _align(self, words: np.ndarray, item: np.ndarray, start: np.ndarray, best: dict) -> None:
        likely = np.isin(item, self.possible(np.unique(item), words))
        item, start = item[likely], start[likely]
        if not len(item):
            return
        for own in np.split(np.arange(len(item)), np.flatnonzero(np.diff(item)) + 1):
            k = int(item[own[0]])
            target, reach = self.words[k], int(self.reach[k])
            size = len(target)
            for run in np.split(own, np.flatnonzero(np.diff(start[own]) > size) + 1):
                lo, hi = max(0, int(start[run[0]]) - reach), min(len(words), int(start[run[-1]]) + size + reach)
                for a in range(lo, hi, 16 * size):  # a long run in overlapping stretches, each of bounded size
                    passage = words[a : min(hi, a + 17 * size + reach)]
                    if np.isin(target, passage).sum() / size < self.threshold:
                        continue
                    score, x, y = align(target, passage)
                    if score >= self.threshold and score > best.get(k, (0.0,))[0]:
                        best[k] = score, len(own), a + x, a + y


def _block_leaks(docs: DataFrame, rows, threshold: float) -> DataFrame:
    sent = docs.sparkSession.sparkContext.broadcast(Items(rows, threshold))

    def find(batches):
        items = sent.value
        for batch in batches:
            out = []
            for doc_id, text in rows_of(batch):
                if text:
                    out += [(doc_id, *x) for x in items.leaks(word_hashes(text.decode("utf-8", "replace")))]
            kinds = (pa.int64(), pa.int64(), pa.float64(), pa.int32(), pa.int32(), pa.int32())
            yield pa.RecordBatch.from_arrays([pa.array([x[k] for x in out], t) for k, t in enumerate(kinds)], names=[x.split()[0] for x in _ROWS.split(", ")])

    return docs.mapInArrow(find, _ROWS)


def _blocks(benchmark: DataFrame, block_bytes: int):
    """The items, collected in blocks of at most about ``block_bytes`` of text, one at a time."""
    items = benchmark.select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("text")).where("text is not null")
    blocks = max(1, -(-(items.agg(F.sum(F.octet_length("text"))).first()[0] or 0) // block_bytes))
    for k in range(blocks):
        block = items if blocks == 1 else items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == k)
        yield sorted(map(tuple, block.collect()), key=str)


def leaks(docs: DataFrame, benchmark: DataFrame, threshold: float = THRESHOLD, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """A row for each document and item that it holds: doc_id, item_id, score, seeds, start_word, end_word (exclusive)."""
    docs, out = documents(docs), None
    for rows in _blocks(benchmark, block_bytes):
        found = _block_leaks(docs, rows, threshold)
        out = found if out is None else out.union(found)
    return out


def decontaminate(docs: DataFrame, benchmark: DataFrame, threshold: float = THRESHOLD, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """The rows whose own text holds no test item, with all their columns; a map without a shuffle, once for each block of items."""
    for rows in _blocks(benchmark, block_bytes):
        sent = docs.sparkSession.sparkContext.broadcast(Items(rows, threshold))

        def judge(sent=sent):
            items = sent.value
            return lambda text: not text or next(items.leaks(word_hashes(text.decode("utf-8", "replace"))), None) is None

        docs = keep_where(docs, judge)
    return docs


def op6_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


QUERIES, ORACLES = {"op6_decontaminate": op6_decontaminate}, {}
