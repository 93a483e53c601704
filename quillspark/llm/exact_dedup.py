"""Exact dedup by content-defined chunk recipes.

A text loses its white space (``[\\x20\\x09-\\x0D]``) and is cut where its own bytes say so: after every 8-byte window
whose hash has ``AVERAGE_BITS`` leading zeros, but no chunk under ``LEAST`` or over ``MOST`` bytes. A chunk's digest is all 256
bits of its SHA-256, which stands for its bytes. Chunks are deduplicated: each different digest becomes one row of the
chunk store, and its identifier there is the place where it first occurs (row and position), so it takes 8 + 4 bytes, and the
bytes themselves stay where they are and can be looked up. A text's recipe is the ordered list of its chunks' identifiers; texts
are equal when their recipes are, and nothing else is compared. About 50 bytes move for a kilobyte of text; documents never do.

Nulls: a null text counts as empty, and its recipe is the empty list; a null ``doc_id`` takes part, and stays only if no other
row of its group has as many code points. Rows that repeat a ``doc_id`` are rows like any other: exactly one row of a
group is kept (of equal doc_id and length the one whose text has the smallest SHA-256, then any). Empty tables give empty results.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillspark.llm.common import documents, keep_rows, materialize, raw_name, rows_of, table

AVERAGE_BITS, LEAST, MOST = 10, 256, 16384
_SPACE = b" \t\n\x0b\x0c\r"
_RECIPES = "doc_id long, n_chars long, text_sha256 string, raw binary, digests array<binary>"


def cuts(data: bytes) -> list[int]:
    """Ends of the chunks of ``data``; the last is its length."""
    n = len(data)
    if n <= LEAST:
        return [n] if n else []
    hit = np.zeros(n - 7, bool)
    for k in range(8):
        words = np.frombuffer(data, "<u8", (n - k) // 8, k)
        hit[k::8] = (words * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - AVERAGE_BITS) == 0
    ends, last = [], 0
    for end in (np.flatnonzero(hit) + 8).tolist() + [n]:
        while end - last > MOST:
            last += MOST
            ends.append(last)
        if end - last >= LEAST or end == n and end > last:
            last = end
            ends.append(last)
    return ends


def digests_of(data: bytes) -> list[bytes]:
    last, out = 0, []
    for end in cuts(data):
        out.append(hashlib.sha256(data[last:end]).digest())
        last = end
    return out


def _recipes(batches):
    for batch in batches:
        out = []
        for doc_id, text in rows_of(batch):
            text = text or b""
            data = text.translate(None, _SPACE)
            chars = len(text.decode("utf-8", "replace"))
            out.append((doc_id, chars, hashlib.sha256(data).hexdigest(), raw_name(text), digests_of(data)))
        kinds = (pa.int64(), pa.int64(), pa.string(), pa.binary(), pa.list_(pa.binary()))
        yield pa.RecordBatch.from_arrays([pa.array([x[k] for x in out], t) for k, t in enumerate(kinds)], names=[x.split()[0] for x in _RECIPES.split(", ")])


def chunked(docs: DataFrame) -> DataFrame:
    """row (a number of its own), doc_id, n_chars, text_sha256, raw (names the text as it is), digests of each row; written."""
    rows = documents(docs).mapInArrow(_recipes, _RECIPES)
    return materialize(rows.withColumn("row", F.monotonically_increasing_id()))


def chunk_store(rows: DataFrame) -> DataFrame:
    """The distinct chunks: digest, chunk_id (row and at: where it first occurs), uses; written."""
    places = rows.select("row", F.posexplode("digests").alias("at", "digest"))
    return materialize(places.groupBy("digest").agg(F.min(F.struct("row", "at")).alias("chunk_id"), F.count("*").alias("uses")))


def recipes(rows: DataFrame, store: DataFrame) -> DataFrame:
    """row, recipe: the chunk ids of each row in order. A row without chunks isn't there.

    The store is written, so the join has an exchange of its own on either side and a chunk that very many rows hold can be split."""
    places = rows.select("row", F.posexplode("digests").alias("at", "digest"))
    named = places.join(store.select("digest", "chunk_id"), "digest")
    listed = F.array_sort(F.collect_list(F.struct("at", "chunk_id")))
    return named.groupBy("row").agg(listed.alias("r")).select("row", F.transform("r", lambda x: x["chunk_id"]).alias("recipe"))


def exact_groups(docs: DataFrame) -> DataFrame:
    """A row for each document: doc_id, keep_id, group_size, kept, text_sha256, n_chunks, raw."""
    rows = chunked(docs)
    none = F.array().cast("array<struct<row:bigint,at:int>>")
    own = materialize(
        rows.drop("digests").join(recipes(rows, chunk_store(rows)), "row", "left").withColumn("recipe", F.coalesce("recipe", none))
    )
    best = F.max_by(F.struct("row", "doc_id"), F.struct("n_chars", F.bitwise_not("doc_id").alias("id"), F.bitwise_not(F.expr("conv(hex(substring(raw, 1, 7)), 16, 10)").cast("long")).alias("raw"), F.bitwise_not("row").alias("row")))
    groups = materialize(own.groupBy("recipe").agg(best.alias("best"), F.count("*").alias("group_size")))
    return own.join(groups, "recipe").select(
        "doc_id", F.col("best.doc_id").alias("keep_id"), "group_size", (F.col("row") == F.col("best.row")).alias("kept"), "text_sha256", F.size("recipe").alias("n_chunks"), "raw",
    )


def exact_dedup(docs: DataFrame) -> DataFrame:
    """The documents that stay, with all their columns: one row of each group of equal texts.

    A verdict is for a doc_id with the text it has; of rows equal in both one is left."""
    return keep_rows(docs, exact_groups(docs).where("kept"))


def op5_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_groups(table(spark, sf_dir, "documents")).drop("n_chunks", "raw")


SQL = r"""
with n as (select doc_id, length(coalesce(text, '')) as n_chars,
                  sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g')) as text_sha256 from documents),
g as (select *, count(*) over (partition by text_sha256) as group_size,
             first_value(doc_id) over (partition by text_sha256 order by n_chars desc, doc_id) as keep_id from n)
select doc_id, keep_id, group_size, doc_id = keep_id as kept, text_sha256 from g
"""
QUERIES, ORACLES = {"op5_exact_dedup": op5_exact_dedup}, {"op5_exact_dedup": SQL}
