"""Ranked lexical search by windowed bucket scoring.

A map over ``documents`` cuts each task's rows into windows of at most ``WINDOW`` documents (fewer when their texts pass
``WINDOW_BYTES``; a longer text is a window of its own), puts a window in the order of doc_id and writes its postings as one row: the window's terms, and for each term
the slots of the documents that hold it and its occurrences there. Texts are never shuffled. The corpus' figures (N, L, a term's
df) are summed over these rows for the terms that items ask for.

Scoring is a second map, over windows: a term's contributions are whole numbers, one for each posting; an item scatters
them into an array of ``WINDOW`` sums (32 KB), the ``or`` of its terms' bitsets says which buckets are occupied, and
these alone are harvested into the item's heap of the ``top`` best and cleared. A task sends its heaps; they meet in two steps, first
dealt to ``SALTS`` parts of each item. Sums and bounds are exact, so the result is that of scoring every pair.

Items are sent to the windows in blocks of some ``BLOCK_BYTES`` of terms, by a hash of the item; each block is one job
over the postings, and its broadcast is freed after it. No block's size depends on the corpus.

Nulls: a null text or one without terms isn't ranked and doesn't count; an item without known terms has no row. Rows that
repeat a doc_id are documents of their own; a null doc_id comes after others of its score. Items that repeat both id and text
are one; items that share an id alone, or have none, are ranked each for itself. Extra columns are not read. Empty tables give an
empty result.
"""

from __future__ import annotations

import heapq
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quillspark.llm.common import documents, materialize, rows_of, table

WINDOW, WINDOW_BYTES, BLOCK_BYTES, SALTS, TOP = 4096, 2 << 20, 8 << 20, 16, 50
TERM = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Bytes of a term, A-Z lower-cased; the others become spaces. Bytes from 0x80 on belong to characters that terms may hold.
_FOLD = bytes(b if chr(b) in LOWER + "0123456789" or b > 127 else b + 32 if chr(b) in UPPER else 32 for b in range(256))
WINDOWS = "docs array<long>, lengths array<long>, terms array<string>, counts array<int>, slots binary, tfs binary"


def term_counts(text: bytes, piece: int = 1 << 20) -> Counter:
    """Occurrences of each term, read piece by piece so that a long text's terms never stand in one list."""
    folded, out, at = text.translate(_FOLD), Counter(), 0
    while at < len(folded):
        end = folded.find(b" ", at + piece)
        end = len(folded) if end < 0 else end
        out.update(folded[at:end].split())
        at = end
    return out


def _window(rows: list[tuple[int | None, Counter]]) -> tuple:
    rows.sort(key=lambda r: (r[0] is None, r[0] or 0))
    ids: dict[bytes, int] = {}
    which = np.concatenate([np.fromiter((ids.setdefault(t, len(ids)) for t in counts), np.int32, len(counts)) for _, counts in rows])
    tfs = np.concatenate([np.fromiter(counts.values(), np.int64, len(counts)) for _, counts in rows])
    slots = np.repeat(np.arange(len(rows), dtype=np.uint16), [len(counts) for _, counts in rows])
    order = np.argsort(which, kind="stable")
    lengths = np.array([counts.total() for _, counts in rows], np.int64)
    counts = np.bincount(which, minlength=len(ids)).astype(np.int32)
    return [r[0] for r in rows], lengths, [t.decode("utf-8", "replace") for t in ids], counts, slots[order].tobytes(), tfs[order].astype(np.uint32).tobytes()


def windows(docs: DataFrame) -> DataFrame:
    """One row a window, written to the shared folder: its documents with their lengths, its terms with their postings."""

    def run(batches):
        rows, size = [], 0

        def flush():
            docs, lengths, terms, counts, slots, tfs = _window(rows)
            columns = [pa.array([docs], pa.list_(pa.int64())), pa.array([lengths], pa.list_(pa.int64())), pa.array([terms], pa.list_(pa.string())), pa.array([counts], pa.list_(pa.int32())), pa.array([slots], pa.binary()), pa.array([tfs], pa.binary())]
            rows.clear()
            return pa.RecordBatch.from_arrays(columns, names=["docs", "lengths", "terms", "counts", "slots", "tfs"])

        for batch in batches:
            for doc_id, text in rows_of(batch):
                if rows and size + len(text or b"") > WINDOW_BYTES:
                    yield flush()
                    size = 0
                if counts := term_counts(text or b""):
                    rows.append((doc_id, counts))
                    size += len(text)
                if len(rows) == WINDOW:
                    yield flush()
                    size = 0
        if rows:
            yield flush()

    return materialize(documents(docs).mapInArrow(run, WINDOWS))


def asked(items: DataFrame) -> DataFrame:
    """item_id, key (names the row), terms (distinct) of the items; equal rows are one."""
    text = F.translate(F.coalesce(F.col("text").cast("string"), F.lit("")), UPPER, LOWER)
    terms = F.array_sort(F.array_distinct(F.regexp_extract_all(text, F.lit(TERM), 0)))
    out = items.select(F.col("item_id").cast("long").alias("item_id"), terms.alias("terms"), F.sha2(F.coalesce(F.col("text").cast("string"), F.lit("")), 256).alias("text_name")).where(F.size("terms") > 0)
    return out.dropDuplicates(["item_id", "text_name"]).select("item_id", F.concat_ws(":", F.col("item_id"), F.lit(""), "text_name").alias("key"), "terms")


def weighed(index: DataFrame, wanted: DataFrame, corpus: tuple[int, int]) -> DataFrame:
    """The items' terms that some document holds, with their weights: item_id, key, terms, weights."""
    each = wanted.select("item_id", "key", F.explode("terms").alias("term"))
    pairs = index.select(F.explode(F.arrays_zip("terms", "counts")).alias("p")).select(F.col("p.terms").alias("term"), F.col("p.counts").alias("n"))
    held = pairs.join(each.select("term").distinct(), "term", "left_semi").groupBy("term").agg(F.sum("n").alias("df"))
    weight = F.floor(1000 * F.log((2.0 * corpus[0] + 2) / (2 * F.col("df") + 1)))
    known = each.join(held, "term").groupBy("key").agg(F.first("item_id").alias("item_id"), F.sort_array(F.collect_list(F.struct("term", weight.alias("w")))).alias("t"))
    return known.select("item_id", "key", F.col("t.term").alias("terms"), F.col("t.w").alias("weights"))


class Scorer:
    """Scores windows against a block of items; keeps each item's heap of the best."""

    def __init__(self, items: list[tuple[str, list[str], list[int]]], corpus: tuple[int, int], top: int):
        self.terms = {t: k for k, t in enumerate(sorted({t for _, terms, _ in items for t in terms}))}
        self.items = [(key, np.array([self.terms[t] for t in terms]), weights) for key, terms, weights in items]
        self.corpus, self.top = corpus, top
        self.heaps: list[list] = [[] for _ in items]
        self.sums = np.zeros(WINDOW, np.int64)

    def window(self, docs, lengths, terms, counts, slots, tfs) -> None:
        n, total = self.corpus
        slots, tfs, lengths = np.frombuffer(slots, np.uint16), np.frombuffer(tfs, np.uint32).astype(np.int64), np.array(lengths, np.int64)
        m = 50 + 50 * lengths * n // total
        ends = np.cumsum(counts)
        width = -(-len(docs) // 8)
        found: list[tuple | None] = [None] * len(self.terms)
        bits = np.zeros((len(self.terms), width), np.uint8)
        for k, term in enumerate(terms):
            if (at := self.terms.get(term)) is not None:
                part = slice(ends[k] - counts[k], ends[k])
                held, here = slots[part], np.zeros(width * 8, bool)
                here[held] = True
                bits[at] = np.packbits(here)
                found[at] = held, 1_000_000_000 * tfs[part] // (1000 * tfs[part] + 20 * m[held])
        for (key, mine, weights), heap in zip(self.items, self.heaps):
            occupied = np.flatnonzero(np.unpackbits(np.bitwise_or.reduce(bits[mine], axis=0)))
            if not len(occupied):
                continue
            for at, w in zip(mine, weights):
                if posting := found[at]:
                    self.sums[posting[0]] += w * posting[1]
            scores = self.sums[occupied]
            self.sums[occupied] = 0
            least = heap[0][0] if len(heap) == self.top else 1
            for k in np.flatnonzero(scores >= max(1, least)):
                doc = docs[occupied[k]]
                entry = int(scores[k]), doc is not None, -(doc or 0)
                if len(heap) < self.top:
                    heapq.heappush(heap, entry)
                elif entry > heap[0]:
                    heapq.heapreplace(heap, entry)


def _scored(index: DataFrame, items: list[tuple[str, list[str], list[int]]], corpus: tuple[int, int], top: int) -> DataFrame:
    """key, doc_id, score of each task's best documents of each item; written, so that the broadcast can go."""
    sent = index.sparkSession.sparkContext.broadcast(items)

    def run(batches):
        scorer = Scorer(sent.value, corpus, top)
        for batch in batches:
            for row in batch.to_pylist():
                scorer.window(**row)
        for (key, _, _), heap in zip(scorer.items, scorer.heaps):
            if heap:
                columns = [pa.array([key] * len(heap)), pa.array([-d if known else None for _, known, d in heap], pa.int64()), pa.array([s for s, _, _ in heap], pa.int64())]
                yield pa.RecordBatch.from_arrays(columns, names=["key", "doc_id", "score"])

    out = materialize(index.mapInArrow(run, "key string, doc_id long, score long"))
    sent.destroy()
    return out


def search(docs: DataFrame, items: DataFrame, top: int = TOP) -> DataFrame:
    """item_id, rank, doc_id, score of the ``top`` best documents of each item."""
    index = windows(docs)
    length = F.aggregate("lengths", F.lit(0).cast("long"), lambda a, b: a + b)
    n, total = index.select(F.size("docs").alias("n"), length.alias("l")).agg(F.coalesce(F.sum("n"), F.lit(0)), F.coalesce(F.sum("l"), F.lit(0))).first()
    wanted = materialize(weighed(index, asked(items), (n, total)))
    size = wanted.agg(F.coalesce(F.sum(F.aggregate(F.transform("terms", lambda t: F.length(t) + 8), F.lit(0), lambda a, b: a + b)), F.lit(0))).first()[0]
    blocks = 1 + size // BLOCK_BYTES
    best = None
    for k in range(blocks):
        block = wanted.where(F.pmod(F.xxhash64("key"), F.lit(blocks)) == k)
        part = _scored(index, [(r.key, r.terms, r.weights) for r in block.select("key", "terms", "weights").collect()], (n, total), top)
        best = part if best is None else best.unionByName(part)
    order = [F.col("score").desc(), F.col("doc_id").asc_nulls_last()]
    salted = best.withColumn("salt", F.pmod(F.xxhash64("doc_id"), F.lit(SALTS)))
    some = salted.withColumn("nth", F.row_number().over(W.partitionBy("key", "salt").orderBy(*order))).where(F.col("nth") <= top)
    ranked = some.withColumn("rank", F.row_number().over(W.partitionBy("key").orderBy(*order))).where(F.col("rank") <= top)
    return ranked.join(wanted.select("key", "item_id"), "key").select("item_id", "rank", "doc_id", "score")


def op13_ranked_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


SQL = rf"""
with t as (select doc_id, unnest(regexp_extract_all(translate(text, '{UPPER}', '{LOWER}'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) as term from documents where text is not null),
tf as (select doc_id, term, count(*) as tf from t group by all),
n as (select doc_id, sum(tf)::bigint as n from tf group by all),
c as (select count(*) as docs, sum(n)::bigint as l from n),
m as (select doc_id, 100 - 50 + ((50 * n * docs) // l) as m from n, c),
q as (select distinct item_id, unnest(regexp_extract_all(translate(text, '{UPPER}', '{LOWER}'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) as term from benchmark where text is not null),
w as (select term, floor(1000 * ln((2 * docs + 2)::double / (2 * count(*) + 1)::double))::bigint as w from tf, c group by term, docs),
s as (select item_id, doc_id, sum(w * ((1000000000 * tf) // (1000 * tf + 20 * m)))::bigint as score
  from q join w using (term) join tf using (term) join m using (doc_id) group by all),
r as (select item_id, row_number() over (partition by item_id order by score desc, doc_id)::int as rank, doc_id, score from s where score > 0)
select * from r where rank <= {TOP}"""

QUERIES, ORACLES = {"op13_ranked_search": op13_ranked_search}, {"op13_ranked_search": SQL}
