"""Sinks: guarded CSV, keyed upsert and delete, run-log pruning, merge patch, dead letters."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def shared_path(spark: SparkSession, name: str) -> str:
    """A new path in the folder that driver and executors share; in local mode, where all share the disk, one is made if none is set."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        root = "file://" + tempfile.mkdtemp(prefix="quillspark-")
        spark.conf.set("spark.checkpoint.dir", root)
    return f"{root}/{spark.sparkContext.applicationId}/{name}-{uuid.uuid4().hex}"


def guard(c: Column) -> Column:
    """A cell that a spreadsheet would run as a formula gets a leading apostrophe."""
    text = F.coalesce(c.cast("string"), F.lit(""))
    return F.when(text.rlike(r"^[=+\-@\t\r]"), F.concat(F.lit("'"), text)).otherwise(text)


def csv_lines(df: DataFrame, columns: list[str]) -> DataFrame:
    """One ``line`` for each row, every cell quoted and guarded."""
    cells = [F.concat(F.lit('"'), F.replace(guard(F.col(c)), F.lit('"'), F.lit('""')), F.lit('"')) for c in columns]
    return df.select(F.concat_ws(",", *cells).alias("line"))


def upsert(table: DataFrame, changes: DataFrame, key: str) -> DataFrame:
    """The table with changed rows replaced and new ones added."""
    return table.join(changes.select(key), key, "left_anti").unionByName(changes, allowMissingColumns=True)


def delete_keys(table: DataFrame, gone: DataFrame, key: str) -> DataFrame:
    return table.join(gone.select(key), key, "left_anti")


def keep_last(df: DataFrame, keys: list[str], order: list[str], n: int) -> DataFrame:
    """The last ``n`` rows of each key."""
    w = W.partitionBy(*keys).orderBy(*[F.col(c).desc() for c in order])
    return df.withColumn("_n", F.row_number().over(w)).where(F.col("_n") <= n).drop("_n")


def merge_patch(base: Column, patch: Column) -> Column:
    """Map ``base`` with the entries of ``patch`` over it; a null value deletes its key."""
    kept = F.map_filter(base, lambda k, _: ~F.map_contains_key(patch, k))
    return F.map_concat(kept, F.map_filter(patch, lambda _, v: v.isNotNull()))


def dead_letters(df: DataFrame, attempts: str, most: int, permanent: Column) -> DataFrame:
    """Adds ``failed``: over the retries or a permanent error."""
    return df.withColumn("failed", (F.col(attempts) >= most) | F.coalesce(permanent, F.lit(False)))


def publish(df: DataFrame, folder: str) -> int:
    """Replace the table of a folder: the rows go to a folder of their own, then one appended row makes them current. A write that
    fails leaves the table as it was. One writer at a time; gives the version."""
    spark = df.sparkSession
    name = f"rows-{uuid.uuid4().hex}"
    df.write.parquet(f"{folder}/{name}")
    version = 1 + (_current(spark, folder) or (0, ""))[0]
    spark.createDataFrame([(version, name)], "version int, name string").coalesce(1).write.mode("append").parquet(f"{folder}/published")
    return version


def _current(spark: SparkSession, folder: str) -> tuple[int, str] | None:
    try:
        row = spark.read.schema("version int, name string").parquet(f"{folder}/published").agg(F.max(F.struct("version", "name")).alias("r")).first()
    except AnalysisException:
        return None
    return tuple(row.r) if row.r else None


def published(spark: SparkSession, folder: str) -> DataFrame:
    """The rows last published to a folder."""
    return spark.read.parquet(f"{folder}/{_current(spark, folder)[1]}")


def sheet(df: DataFrame, source: str, order: str, sets: dict[str, list[tuple[str, str]]], default: str) -> DataFrame:
    """The columns (key, label) that the first row with a source calls for, as text: arrays joined by ``; ``, null or missing empty."""
    first = df.where(F.coalesce(F.col(source), F.lit("")) != "").agg(F.min_by(source, order)).first()[0]
    kinds = dict(df.dtypes)

    def cell(key):
        if key not in kinds:
            return F.lit("")
        c = F.array_join(key, "; ") if kinds[key].startswith("array") else F.col(key).cast("string")
        return F.coalesce(c, F.lit(""))

    return df.select(*[cell(key).alias(label) for key, label in sets.get(first, sets[default])])
