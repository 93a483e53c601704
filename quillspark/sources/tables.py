"""Sources: parquet tables, JSONL transcripts, Markdown folders, stores and run logs."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
MESSAGE = "type string, timestamp string, message struct<role: string, content: string, usage: struct<cost: struct<total: double>>>"


def load(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def numbered_lines(spark: SparkSession, path: str, glob: str) -> DataFrame:
    """file, line (from 1), value of text files below a folder. A file is read in splits, however large it is: a row's place in its
    split comes from the row ids, which rise by one within a task, and only one row a split is shuffled for the lines before it.
    """
    lines = spark.read.option("pathGlobFilter", glob).option("recursiveFileLookup", True).option("lineSep", "\n").text(path)
    lines = lines.select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("_at"), F.monotonically_increasing_id().alias("_id"), "value")
    splits = lines.groupBy("file", "_at").agg(F.min("_id").alias("_first"), F.count("*").alias("_n"))
    before = F.coalesce(F.sum("_n").over(W.partitionBy("file").orderBy("_at").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    splits = splits.select("file", "_at", (before - F.col("_first") + 1).alias("_shift"))
    return lines.join(splits, ["file", "_at"]).select("file", (F.col("_id") + F.col("_shift")).alias("line"), "value")


def transcripts(spark: SparkSession, path: str, glob: str = "*.jsonl") -> DataFrame:
    """Message rows of JSONL transcripts: file, line (from 1), role, text. Blank and malformed lines and other roles are skipped."""
    parsed = numbered_lines(spark, path, glob).select("file", "line", F.from_json("value", MESSAGE, {"mode": "PERMISSIVE"}).alias("row"))
    content = F.col("row.message.content")
    parts = F.from_json(content, "array<struct<type: string, text: string>>")
    text = F.when(content.startswith("["), F.array_join(F.transform(F.filter(parts, lambda x: x["type"] == "text"), lambda x: x["text"]), "\n")).otherwise(content)
    return parsed.where("row.type = 'message' and row.message.role in ('user', 'assistant')").select("file", "line", F.col("row.message.role").alias("role"), F.trim(F.regexp_replace(text, r"\s+", " ")).alias("text"))


def markdown_files(spark: SparkSession, path: str, glob: str = "*.md") -> DataFrame:
    """path, content, hash, size, mtime of the Markdown files below a folder; equal content once, by the first path."""
    found = spark.read.format("binaryFile").option("pathGlobFilter", glob).option("recursiveFileLookup", True).load(path)
    rows = found.select("path", F.col("content").cast("string").alias("content"), F.sha2("content", 256).alias("hash"), F.col("length").alias("size"), F.col("modificationTime").alias("mtime"))
    return rows.groupBy("hash").agg(F.min_by(F.struct("path", "content", "size", "mtime"), "path").alias("r")).select("r.path", "r.content", "hash", "r.size", "r.mtime")


def session_store(spark: SparkSession, path: str) -> DataFrame:
    """Rows of a session store (a JSON map), most recent first."""
    store = spark.read.text(path, wholetext=True).select(F.explode(F.from_json("value", "map<string, struct<sessionId: string, updatedAt: bigint>>")).alias("key", "v"))
    return store.select("key", F.col("v.sessionId").alias("session_id"), F.col("v.updatedAt").alias("updated_at")).orderBy(F.col("updated_at").desc_nulls_last(), "key")


def run_log(spark: SparkSession, path: str) -> DataFrame:
    """Finished runs of JSONL run logs; other lines are dropped."""
    row = F.from_json("value", "ts bigint, jobId string, action string, status string, durationMs bigint, model string, provider string, usage struct<input_tokens: bigint, output_tokens: bigint, total_tokens: bigint>")
    return spark.read.option("recursiveFileLookup", True).text(path).select(row.alias("r")).where("r.action = 'finished' and r.ts is not null and trim(r.jobId) <> ''").select("r.*")


def latest_log(spark: SparkSession, folder: str) -> DataFrame:
    """path and mtime of the newest ``*-YYYY-MM-DD.log`` of a folder; reads no content."""
    found = spark.read.format("binaryFile").option("pathGlobFilter", "*.log").load(folder).select("path", F.col("modificationTime").alias("mtime"))
    dated = found.where(F.col("path").rlike(r"-\d{4}-\d{2}-\d{2}\.log$"))
    return dated.agg(F.max(F.struct("mtime", "path")).alias("r")).where("r is not null").select("r.path", "r.mtime")


def log_stream(spark: SparkSession, folder: str, glob: str = "*.log") -> DataFrame:
    """Lines of the log files that arrive in a folder: the checkpoint is the cursor."""
    return spark.readStream.option("pathGlobFilter", glob).text(folder).select(F.col("value").alias("line"))


def pending_deliveries(spark: SparkSession, folder: str) -> DataFrame:
    """Queued deliveries (a JSON file each), oldest first; malformed files are skipped."""
    schema = "id string, channel string, to string, enqueuedAt bigint, retryCount int, _bad string"
    rows = spark.read.schema(schema).option("pathGlobFilter", "*.json").option("recursiveFileLookup", True).option("multiLine", True).option("columnNameOfCorruptRecord", "_bad").json(folder)
    return rows.where("_bad is null and id is not null and enqueuedAt is not null").drop("_bad").orderBy("enqueuedAt", "id")


def test_reports(spark: SparkSession, folder: str) -> DataFrame:
    """A row for each test of JSON test reports: file, title, status, ms."""
    schema = "testResults array<struct<name: string, assertionResults: array<struct<fullName: string, status: string, duration: double>>>>"
    files = spark.read.schema(schema).option("recursiveFileLookup", True).option("multiLine", True).json(folder).select(F.explode("testResults").alias("f"))
    return files.select(F.col("f.name").alias("file"), F.explode("f.assertionResults").alias("t")).select("file", F.col("t.fullName").alias("title"), F.col("t.status").alias("status"), F.col("t.duration").alias("ms"))


def cost_log(spark: SparkSession, path: str, provider: str) -> DataFrame:
    """Daily costs by model of one provider, from a JSON list (or one record) of provider logs: day, model, cost."""
    schema = "provider string, daily array<struct<date: string, modelBreakdowns: array<struct<modelName: string, cost: double>>>>"
    days = spark.read.schema(schema).option("recursiveFileLookup", True).option("multiLine", True).json(path).where(F.col("provider") == provider).select(F.explode("daily").alias("d"))
    return days.select(F.col("d.date").alias("day"), F.explode("d.modelBreakdowns").alias("m")).select("day", F.col("m.modelName").alias("model"), F.col("m.cost").alias("cost"))


def all_stores(spark: SparkSession, paths: list[str]) -> DataFrame:
    """Rows of several session stores, with the store each came from; most recent first."""
    parts = [session_store(spark, p).withColumn("store", F.lit(p)) for p in paths]
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts).orderBy(F.col("updated_at").desc_nulls_last(), "key")
