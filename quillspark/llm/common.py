"""Helpers shared by the training-data operators."""

from __future__ import annotations

import hashlib
import tempfile
import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: A word is a run of anything but these six ASCII characters; ``bytes.split()`` splits on exactly them.
WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


written: list[str] = []


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share. In local mode, where all share the disk, a session that names none gets one."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        found = "file://" + tempfile.mkdtemp(prefix="quillspark-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found


def materialize(df: DataFrame) -> DataFrame:
    """Cut the lineage: write ``df`` to the shared folder and read it back, so lost executors cost no recomputation.

    The table stays until ``release`` or ``keep_only`` deletes it; all lie in one folder named after the application."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{spark.sparkContext.applicationId}/{uuid.uuid4().hex}"
    df.write.parquet(path)
    written.append(path)
    return spark.read.schema(df.schema).parquet(path)


def _delete(spark: SparkSession, path: str) -> None:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def release(spark: SparkSession) -> None:
    """Delete all tables that this application's operators wrote; their DataFrames can't be read after it."""
    _delete(spark, f"{shared_dir(spark)}/{spark.sparkContext.applicationId}")
    written.clear()


def keep_only(df: DataFrame, mark: int) -> DataFrame:
    """Materialize ``df``, then delete the tables written before it since ``mark`` (a length of ``written``)."""
    out = materialize(df)
    for path in written[mark:-1]:
        _delete(df.sparkSession, path)
    del written[mark:-1]
    return out


def documents(df: DataFrame) -> DataFrame:
    """Only the two columns the operators read, so that extra columns can't clash with theirs."""
    return df.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))


def rows_of(batch: pa.RecordBatch):
    """(doc_id, UTF-8 bytes; None for null) of a batch of ``documents()``, one at a time."""
    ids, texts = batch.column(0), batch.column(1).cast(pa.large_binary())
    for k in range(batch.num_rows):
        yield ids[k].as_py(), texts[k].as_py()


def word_lists(text: bytes, size: int = 1 << 20):
    """The words of a text in lists, each of the words of some ``size`` bytes."""
    at = 0
    while at < len(text):
        end = at + size
        while end < len(text) and text[end] not in b" \t\n\x0b\x0c\r":
            end += 1
        yield text[at:end].split()
        at = end


def raw_name(text: bytes) -> bytes:
    """128 bits that name a text as it is; ``keep_rows`` tells rows of one doc_id apart by them."""
    return hashlib.sha256(text).digest()[:16]


def keep_rows(docs: DataFrame, keep: DataFrame) -> DataFrame:
    """The documents, with all their columns, that ``keep`` lists by doc_id and raw name; of rows equal in both one is left.

    The key is one string that is never null, so the join's exchange serves the window as well."""
    key = lambda raw: F.concat(F.coalesce(F.col("doc_id").cast("long").cast("string"), F.lit("none")), F.lit(":"), raw)
    text = F.coalesce(F.col("text").cast("string"), F.lit("")).cast("binary")
    left = docs.withColumn("__quill_key", key(F.substring(F.sha2(text, 256), 1, 32)))
    left = left.join(keep.select(key(F.lower(F.hex("raw"))).alias("__quill_key")), "__quill_key", "left_semi")
    nth = F.row_number().over(W.partitionBy("__quill_key").orderBy("__quill_key"))
    return left.withColumn("__quill_nth", nth).where("__quill_nth = 1").select(docs.columns)


def keep_where(docs: DataFrame, judge) -> DataFrame:
    """The documents, with all their columns, whose text ``judge()`` - called once a task for a function of bytes - accepts.

    A map: no row leaves its task, and each is judged by its own text, whatever other rows have its doc_id."""
    at = docs.columns.index("text")

    def run(batches):
        accepts = judge()
        for batch in batches:
            texts = batch.column(at).cast(pa.large_string()).cast(pa.large_binary())
            yield batch.filter(pa.array([accepts(texts[k].as_py()) for k in range(batch.num_rows)], pa.bool_()))

    return docs.mapInArrow(run, docs.schema)


def prefix_hash(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Running polynomial hash modulo 2**64 of bytes: (sums, inverse powers), so that
    ``(sums[e] - sums[s]) * inverse[s]`` hashes ``data[s:e]`` wherever it stands."""
    n = len(data)
    power, inverse = _powers(n + 1)
    sums = np.zeros(n + 1, np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(7)) * power[:n], out=sums[1:])
    return sums, inverse[: n + 1]


_BASE = 0x9E3779B97F4A7C15 | 5
_cache: list[np.ndarray] = []


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if not _cache or len(_cache[0]) < n:
        size = max(1 << 16, 1 << (n - 1).bit_length())
        _cache[:] = [_run(_BASE, size), _run(pow(_BASE, -1, 1 << 64), size)]
    return _cache[0][:n], _cache[1][:n]


def _run(base: int, n: int) -> np.ndarray:
    out = np.ones(n, np.uint64)
    out[1:] = np.uint64(base)
    return np.cumprod(out, dtype=np.uint64)


def mixed(h: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads every input bit (the polynomial's low bits alone are weak)."""
    h = h ^ (h >> np.uint64(32))
    h = h * np.uint64(0xD6E8FEB86659FD93)
    h = h ^ (h >> np.uint64(29))
    h = h * np.uint64(0xA0761D6478BD642F)
    return h ^ (h >> np.uint64(32))
