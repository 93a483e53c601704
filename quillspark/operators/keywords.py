"""A stored keyword index: postings by term in blocks, each with the most that it can add to a score.

``build`` reads a table once and shuffles nothing. A task takes its documents in segments of some ``WAIT`` words and packs a
segment's postings of a term, in the order of what they can add, ``BLOCK`` to a row; segments are dealt to ``SHARDS`` shards, so that a
word that most documents hold is many rows of many tasks. Rows are stored by a hash of the term (partitions) and sorted by
term in a file, so a query reads its words' partitions only; their headers, which need the corpus' mean length, are stored beside them. Terms are
runs of letters, digits and underscores, lower-cased; a document is a row, so rows that repeat an id are one document each.

``search`` takes queries as text: a document must hold all words of a query (``parsed``), and is scored by BM25. Shard 0 is
scored first; its ``top``-th score of a query is a score that the final ``top``-th can't be under, so in the other shards a
block goes unread that can't reach it even with the best blocks of the query's other words there. A word's bound comes from the block's headers, without its
postings. The result is that of scoring every document. Null texts hold no word; a query without words finds nothing.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

TERM, SHARDS, BLOCK, BUCKETS, K1, B, DIGITS = r"[\p{L}\p{N}_]+", 16, 128, 64, 1.2, 0.75, 6
WAIT = 1 << 21
HEAD = "term string, shard int, block bigint, most double, n int, bucket int"
SEGMENTS = "term string, shard int, block bigint, docs array<struct<row: bigint, id: bigint, tf: int, n: int>>, seen bigint, words bigint"
POSTINGS = "term string, shard int, block bigint, docs array<struct<row: bigint, id: bigint, tf: int, n: int>>, bucket int"


@dataclass(frozen=True)
class Index:
    """Stored tables: ``postings`` (a row a block), ``heads`` (the blocks without postings) and the corpus' documents and mean length."""

    path: str
    docs: int
    mean: float

    def postings(self, spark: SparkSession) -> DataFrame:
        return spark.read.schema(POSTINGS).parquet(f"{self.path}/postings").where("bucket >= 0")

    def heads(self, spark: SparkSession) -> DataFrame:
        return spark.read.schema(HEAD).parquet(f"{self.path}/heads")

    def part(self, d: Column) -> Column:
        """The share of its word's weight that a posting earns."""
        return saturated(d["tf"], d["n"], max(self.mean, 1e-9))


def words(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(text), F.lit(TERM), F.lit(0))


def parsed(text: Column) -> Column:
    """The words of a query, once each, all of which a document must hold."""
    return F.array_sort(F.array_distinct(F.coalesce(words(text), F.array().cast("array<string>"))))


def _bucket(term) -> Column:
    return F.pmod(F.xxhash64(term), F.lit(BUCKETS)).cast("int")


def saturated(tf: Column, n: Column, mean: float) -> Column:
    """The share of a word's weight that a document earns with ``tf`` occurrences among ``n`` words."""
    return tf * (K1 + 1) / (tf + K1 * (1 - B + B * n / mean))


def _segments(shards: int, block: int):
    """Blocks of postings of ``WAIT`` words at a time, and a row with the documents and words of the segment."""

    def run(batches):
        held, waiting, nth = [], 0, 0
        for batch in batches:
            held.append(batch)
            waiting += len(batch.column(2).flatten())
            if waiting >= WAIT:
                yield from _blocks(held, nth, shards, block)
                held, waiting, nth = [], 0, nth + 1
        if held:
            yield from _blocks(held, nth, shards, block)

    return run


def _blocks(batches, nth: int, shards: int, block: int):
    row, id_, t = (c.combine_chunks() for c in pa.Table.from_batches(batches).columns)
    if not len(row):
        return
    task = row[0].as_py() >> 33  # as Spark numbers rows
    n = np.diff(t.offsets.to_numpy())
    code = t.flatten().dictionary_encode()
    terms, many = code.dictionary, max(1, len(code.dictionary))
    key, tf = np.unique(np.repeat(np.arange(len(n)), n) * many + code.indices.to_numpy(zero_copy_only=False), return_counts=True)
    doc, term = key // many, key % many
    order = np.lexsort((-saturated(tf, n[doc], max(n.mean(), 1e-9)), term))
    doc, term, tf = doc[order], term[order], tf[order]
    start = np.flatnonzero(np.diff(term, prepend=-1))
    place = np.arange(len(term)) - np.repeat(start, np.diff(np.append(start, len(term))))
    first = np.flatnonzero(place % block == 0)
    fields = [row.take(pa.array(doc)), id_.take(pa.array(doc)), pa.array(tf.astype(np.int32)), pa.array(n[doc].astype(np.int32))]
    docs = pa.ListArray.from_arrays(pa.array(np.append(first, len(doc)).astype(np.int32)), pa.StructArray.from_arrays(fields, ["row", "id", "tf", "n"]))
    named, shard, none = terms.take(pa.array(term[first])).cast(pa.string()), np.full(len(first), (task + nth) % shards, np.int32), pa.nulls(len(first), pa.int64())
    names = ["term", "shard", "block", "docs", "seen", "words"]
    yield pa.RecordBatch.from_arrays([named, pa.array(shard), pa.array((task << 40) + (nth << 24) + place[first] // block), docs, none, none], names=names)
    yield pa.RecordBatch.from_arrays([*(pa.nulls(1, x) for x in (pa.string(), pa.int32(), pa.int64(), docs.type)), pa.array([len(n)], pa.int64()), pa.array([int(n.sum())], pa.int64())], names=names)


def build(df: DataFrame, id_: str, text: str, path: str) -> Index:
    spark = df.sparkSession
    read = df.where(F.col(text).isNotNull()).select(F.monotonically_increasing_id().alias("row"), F.col(id_).cast("long").alias("id"), words(F.col(text)).alias("t"))
    blocks = read.mapInArrow(_segments(SHARDS, BLOCK), SEGMENTS).withColumn("bucket", F.when(F.col("term").isNull(), -1).otherwise(_bucket("term")))
    blocks.sortWithinPartitions("bucket", "term").write.partitionBy("bucket").parquet(f"{path}/postings")
    seen = spark.read.schema(SEGMENTS + ", bucket int").parquet(f"{path}/postings").where("bucket = -1")
    docs, total = seen.agg(F.coalesce(F.sum("seen"), F.lit(0)), F.coalesce(F.sum("words"), F.lit(0))).first()
    index = Index(path, docs, total / docs if docs else 0.0)
    most = F.array_max(F.transform("docs", index.part)).alias("most")
    index.postings(spark).select("term", "shard", "block", most, F.size("docs").alias("n"), "bucket").sortWithinPartitions("bucket", "term").write.partitionBy("bucket").parquet(f"{path}/heads")
    return index


def _of(table: DataFrame, wanted: DataFrame, buckets: list[int]) -> DataFrame:
    """The rows of the wanted terms, from their partitions alone."""
    return table.where(F.col("bucket").isin(buckets)).join(wanted.select("bucket", "term").distinct(), ["bucket", "term"], "left_semi")


def weighed(index: Index, queries: DataFrame, query_id: str, text: str) -> tuple[DataFrame, list[int]]:
    """query_id, bucket, term, need (the query's words), weight, for queries whose words all occur; and the partitions to read."""
    spark = queries.sparkSession
    each = queries.select(F.col(query_id).cast("long").alias("query_id"), parsed(F.col(text)).alias("t")).dropDuplicates(["query_id"])
    each = each.select("query_id", F.size("t").alias("need"), F.explode("t").alias("term")).withColumn("bucket", _bucket("term"))
    buckets = sorted(r.bucket for r in each.select("bucket").distinct().collect())  # BUCKETS numbers at most
    weight = F.log(1 + (F.lit(float(index.docs)) - F.col("df") + 0.5) / (F.col("df") + 0.5))
    terms = _of(index.heads(spark), each, buckets).groupBy("bucket", "term").agg(F.sum("n").alias("df"))
    known = each.join(terms, ["bucket", "term"]).select("query_id", "need", "bucket", "term", weight.alias("weight"))
    whole = known.groupBy("query_id", "need").agg(F.count("*").alias("found")).where("found = need").select("query_id")
    return known.join(whole, "query_id", "left_semi"), buckets


def _scored(index: Index, postings: DataFrame, top: int) -> DataFrame:
    """query_id, row, id, score of the best rows among those whose words all stand in ``postings`` (columns of blocks, and query_id)."""
    each = postings.select("query_id", "need", "weight", F.explode("docs").alias("d")).select("query_id", "need", F.col("d.row").alias("row"), F.col("d.id").alias("id"), (F.col("weight") * index.part(F.col("d"))).alias("s"))
    score = F.round(F.aggregate(F.array_sort(F.collect_list("s")), F.lit(0.0), lambda a, b: a + b), DIGITS)  # a query's words at most
    hits = each.groupBy("query_id", "need", "row", "id").agg(F.count("*").alias("found"), score.alias("score")).where("found = need")
    place = F.row_number().over(W.partitionBy("query_id").orderBy(F.col("score").desc(), F.col("id").asc_nulls_last(), "row"))
    return hits.withColumn("place", place).where(F.col("place") <= top).select("query_id", "row", "id", "score", "place")


def readable(index: Index, queries: DataFrame, query_id: str, text: str, top: int, path: str) -> tuple[DataFrame, DataFrame]:
    """What the second pass reads: query_id, term, shard, block of the blocks that can hold one of the ``top``; and shard 0's best rows."""
    spark = queries.sparkSession
    wanted, buckets = weighed(index, queries, query_id, text)
    wanted.write.parquet(f"{path}/wanted")
    wanted = spark.read.parquet(f"{path}/wanted")
    first = _of(index.postings(spark).where("shard = 0"), wanted, buckets).join(wanted, ["bucket", "term"])
    _scored(index, first, top).write.parquet(f"{path}/first")
    first = spark.read.parquet(f"{path}/first")
    floor = first.where(F.col("place") == top).select("query_id", F.col("score").alias("floor"))
    heads = _of(index.heads(spark).where("shard > 0"), wanted, buckets).join(wanted, ["bucket", "term"]).withColumn("most", F.col("most") * F.col("weight"))
    best = heads.groupBy("query_id", "need", "shard", "term").agg(F.max("most").alias("best")).groupBy("query_id", "need", "shard").agg(F.sum("best").alias("all"), F.count("*").alias("held")).where("held = need")
    own = heads.groupBy("query_id", "shard", "term").agg(F.max("most").alias("best"))
    able = heads.join(own, ["query_id", "shard", "term"]).join(best.drop("need"), ["query_id", "shard"]).join(floor, "query_id", "left")
    able = able.where(F.col("all") - F.col("best") + F.col("most") >= F.coalesce(F.col("floor"), F.lit(-1.0)) - 10.0**-DIGITS)
    return able.select("query_id", "need", "weight", "bucket", "term", "shard", "block"), first


def search(index: Index, queries: DataFrame, query_id: str, text: str, top: int, path: str) -> DataFrame:
    """query_id, id, score, place of the ``top`` best documents of each query; ``path`` is a new folder for what is between the passes."""
    spark = queries.sparkSession
    able, first = readable(index, queries, query_id, text, top, path)
    able.write.parquet(f"{path}/able")
    able = spark.read.parquet(f"{path}/able")
    buckets = sorted(r.bucket for r in able.select("bucket").distinct().collect())
    rest = index.postings(spark).where(F.col("bucket").isin(buckets) & (F.col("shard") > 0)).select("bucket", "term", "shard", "block", "docs").join(able, ["bucket", "term", "shard", "block"])
    found = _scored(index, rest, top).unionByName(first).drop("place")
    place = F.row_number().over(W.partitionBy("query_id").orderBy(F.col("score").desc(), F.col("id").asc_nulls_last(), "row"))
    return found.withColumn("place", place).where(F.col("place") <= top).select("query_id", "id", "score", "place")


def with_snippets(found: DataFrame, docs: DataFrame, id_: str, text: str, most: int = 700) -> DataFrame:
    """The rows found with the first ``most`` characters of their text; only rows found are joined."""
    named = docs.select(F.col(id_).cast("long").alias("id"), F.substring(F.col(text), 1, most).alias("snippet"))
    return found.join(named, "id", "left")
