"""Queries of the file sources and of the sinks: tables are written to the shared folder in a source's format and read back through it."""

from __future__ import annotations

from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from quillspark.functions import content, places, strings
from quillspark.functions import text as T
from quillspark.sources import sinks, tables
from quillspark.sources.tables import load

C = F.col
ARRAYS = [(1, 'Sure: [{"a": 1}, {"a": 2}] done'), (2, "no records"), (3, "[]"), (4, 'x [ {"b": "y"} ] [ {"c": 3} ]'), (5, None), (6, "")]
VECTORS = [(1, "[1.5, 2]"), (2, "oops"), (3, None), (4, "[]"), (5, "[0.25]")]
POSTS = [(-1, "hr@acme.company and A@b.network, a@b.network"), (-2, "+971 50 123 4567 or 8146785224."), (-3, None), (-4, ""), (-5, "+91-98765 43210, Rs 50000, 7502588916743708672")]
PATTERNS = [(r"id-\d+", True), ("(ab)?c*", True), ("a{2,3}b+", True), ("(a|b)+", True), ("(a+)+", False), ("(a*)*b", False), ("((x|y+)z)*", False), ("(", False), ("(a{2,}){3}", False)]


def _lines(df, name, value, by=None):
    """The folder of text files that hold ``value`` a row, in a folder each for the values of ``by``."""
    path = sinks.shared_path(df.sparkSession, name)
    writer = df.select(value.alias("value"), *([by] if by else [])).write
    (writer.partitionBy(by) if by else writer).text(path)
    return path


def transcript_messages(spark, sf_dir):
    turns = load(spark, sf_dir, "conversations").select("conv_id", "turn", "role", F.coalesce("text", F.lit("")).alias("text"))
    parts = F.to_json(F.array(F.struct(F.lit("text").alias("type"), C("text").alias("text")), F.struct(F.lit("image").alias("type"), F.lit("zz").alias("text"))))
    said = F.when(C("turn") % 2 == 0, C("text")).otherwise(parts)
    line = F.to_json(F.struct(F.lit("message").alias("type"), F.struct(C("role"), said.alias("content")).alias("message")))
    other = F.when(C("turn") % 3 == 0, F.lit("\n{broken")).when(C("turn") % 3 == 1, F.lit('\n{"type":"session"}')).otherwise(F.lit("\n"))
    path = _lines(turns, "transcripts", F.concat(line, other))
    read = tables.transcripts(spark, path, "*.txt")
    return read.groupBy("role", "text").agg(F.count("*").alias("n"), F.count_if(C("line") % 2 == 1).alias("at_odd_lines"))


def notes(spark, sf_dir):
    path = _lines(load(spark, sf_dir, "nation"), "notes", F.concat(F.lit("# region "), C("n_regionkey"), F.lit("\nnote")), "n_nationkey")
    found = tables.markdown_files(spark, path, "*.txt")
    return found.select(F.regexp_extract("path", r"n_nationkey=(\d+)", 1).alias("first"), F.md5("content").alias("md5"), "hash", "size")


def stores(spark, sf_dir):
    entries = F.collect_list(F.struct("n_name", F.struct(F.concat(F.lit("s-"), C("n_nationkey")).alias("sessionId"), (C("n_nationkey") * 1000).cast("bigint").alias("updatedAt"))))
    nations = load(spark, sf_dir, "nation").groupBy("n_regionkey").agg(F.to_json(F.map_from_entries(entries)).alias("map"))
    path = _lines(nations, "stores", C("map"), "n_regionkey")
    every = tables.all_stores(spark, [f"{path}/n_regionkey={k}" for k in range(5)])
    return every.select("key", "session_id", "updated_at", F.regexp_extract("store", r"(\d+)$", 1).alias("store"))


def finished_runs(spark, sf_dir):
    e = load(spark, sf_dir, "events")
    action, job = F.when(C("event_type") == "view", "started").otherwise(F.lit("finished")), F.when(C("user_id") % 9 == 0, " ").otherwise(F.concat(F.lit("j"), C("user_id")))
    used = F.struct(C("event_id").alias("input_tokens"), (C("event_id") * 2).alias("total_tokens"))
    row = F.to_json(F.struct(C("event_id").alias("ts"), job.alias("jobId"), action.alias("action"), C("event_type").alias("status"), used.alias("usage")))
    runs = tables.run_log(spark, _lines(e, "runs", F.concat(row, F.lit("\nnot json\n"))))
    return runs.select("ts", "jobId", "status", C("usage.total_tokens").alias("tokens"))


def tailed_lines(spark, sf_dir):
    path = _lines(load(spark, sf_dir, "orders"), "log", F.concat_ws(" ", "o_orderpriority", "o_orderstatus"))
    out, cursor = sinks.shared_path(spark, "log-seen"), sinks.shared_path(spark, "log-cursor")
    tables.log_stream(spark, path, "*.txt").writeStream.option("checkpointLocation", cursor).trigger(availableNow=True).format("parquet").start(out).awaitTermination()
    return spark.read.schema("line string").parquet(out).groupBy("line").agg(F.count("*").alias("n"))


def provider_costs(spark, sf_dir):
    day = load(spark, sf_dir, "lineitem").groupBy("l_linestatus", F.to_date("l_shipdate").cast("string").alias("date"), "l_returnflag").agg(F.round(F.sum("l_extendedprice"), 2).alias("cost"))
    days = day.groupBy("l_linestatus", "date").agg(F.collect_list(F.struct(C("l_returnflag").alias("modelName"), "cost")).alias("modelBreakdowns"))
    log = days.groupBy("l_linestatus").agg(F.to_json(F.array(F.struct(C("l_linestatus").alias("provider"), F.collect_list(F.struct("date", "modelBreakdowns")).alias("daily")))).alias("log"))
    return tables.cost_log(spark, _lines(log, "costs", C("log"), "l_linestatus"), "F")


def reported_tests(spark, sf_dir):
    test = F.struct(C("n_name").alias("fullName"), F.when(C("n_nationkey") % 4 == 0, "failed").otherwise(F.lit("passed")).alias("status"), (C("n_nationkey") / 2).alias("duration"))
    suite = load(spark, sf_dir, "nation").groupBy("n_regionkey").agg(F.struct(F.first(F.concat(F.lit("f"), C("n_regionkey"))).alias("name"), F.collect_list(test).alias("assertionResults")).alias("s"))
    return tables.test_reports(spark, _lines(suite, "reports", F.to_json(F.struct(F.array("s").alias("testResults"))), "n_regionkey"))


def deliveries(spark, sf_dir):
    n = load(spark, sf_dir, "nation")
    path = sinks.shared_path(spark, "deliveries")
    id_ = F.when(C("n_nationkey") % 6 > 0, F.concat(F.lit("d"), C("n_nationkey")))
    n.select("n_nationkey", id_.alias("id"), C("n_name").alias("channel"), F.lit("x").alias("to"), (100 - C("n_nationkey")).cast("bigint").alias("enqueuedAt"), (C("n_nationkey") % 3).cast("int").alias("retryCount")).write.partitionBy("n_nationkey").json(path)
    tried = sinks.dead_letters(tables.pending_deliveries(spark, path), "retryCount", 2, C("channel") == "CHINA")
    return tried.select("id", "channel", C("enqueuedAt").alias("at"), "failed")


def deleted_keys(spark, sf_dir):
    o = load(spark, sf_dir, "orders")
    return sinks.delete_keys(o.select("o_orderkey", "o_custkey"), o.where("o_orderstatus = 'F'").select("o_orderkey"), "o_orderkey")


def last_runs(spark, sf_dir):
    return sinks.keep_last(load(spark, sf_dir, "events").select("user_id", "ts", "event_id"), ["user_id"], ["ts", "event_id"], 7).select("user_id", "event_id")


def user_redaction(spark, sf_dir):
    d = load(spark, sf_dir, "documents")
    return d.select("doc_id", F.md5(T.redact_with(C("text"), ["[0-9]{3}", "[Ll]icense"])).alias("md5"), F.md5(strings.truncate_line(C("text"), 160)).alias("line"))


def pattern_safety(spark, sf_dir):
    rows = spark.createDataFrame([(p,) for p, _ in PATTERNS], "pattern string")
    rows = rows.union(load(spark, sf_dir, "part").selectExpr("concat(p_name, ' ', p_partkey, case p_partkey % 3 when 0 then '(a+)+' when 1 then '[a-z]+' else '(' end)"))
    return rows.select("pattern", T.safe_patterns(C("pattern")).alias("safe"))


def noisy_arrays(spark, sf_dir):
    rows = spark.createDataFrame(ARRAYS, "id long, out string").union(load(spark, sf_dir, "events").selectExpr("1000 + event_id", "concat('log ', event_type, ' [{\"a\": ', event_id, '}] tail ]')"))
    return rows.select("id", content.json_array_in(C("out")).alias("records"))


def stored_vectors(spark, sf_dir):
    e = load(spark, sf_dir, "embeddings").select("vec_id", F.to_json("embedding").alias("stored"))
    rows = e.union(spark.createDataFrame([(-k, v) for k, v in VECTORS], "vec_id long, stored string"))
    v = rows.select("vec_id", content.vector_of(C("stored")).alias("v"))
    return v.select("vec_id", F.size("v").alias("n"), F.round(F.aggregate("v", F.lit(0.0), lambda a, x: a + x), 4).alias("total"))


def reindexed(spark, sf_dir):
    d = load(spark, sf_dir, "documents").select("doc_id", F.coalesce("source", F.lit("none")).alias("source"))
    folder = sinks.shared_path(spark, "index")
    sinks.publish(d, folder)
    try:  # a run that fails keeps the table as it was
        sinks.publish(d.withColumn("source", F.when(C("doc_id") >= 0, F.raise_error(F.lit("no vector")).cast("string"))), folder)
    except PySparkException:
        pass
    kept = sinks.published(spark, folder).groupBy("source").agg(F.count("*").alias("first"))
    sinks.publish(d.withColumn("source", F.upper("source")), folder)
    return kept.withColumn("source", F.upper("source")).join(sinks.published(spark, folder).groupBy("source").agg(F.count("*").alias("second")), "source")


def posts_sheet(spark, sf_dir):
    sets = {"posts": [("text", "Post"), ("tags", "Why"), ("gone", "Set Aside")], "maps": [("doc_id", "Id")]}
    d = load(spark, sf_dir, "documents").select("doc_id", F.md5("text").alias("text"), F.array("lang", "source").alias("tags"), F.when(C("doc_id") > 0, F.lit("posts")).alias("kind"))
    return sinks.sheet(d, "kind", "doc_id", sets, "maps")


def contacts(spark, sf_dir):
    rows = load(spark, sf_dir, "customer").selectExpr("c_custkey as id", "concat('mail ', c_name, '@acme.comto or ', 98765 + c_custkey % 9, ' 43210, id 12345678901', c_custkey, ', on 2024-01-', 10 + c_custkey % 10, ' fee ₹9876543210') as text")
    rows = rows.union(spark.createDataFrame(POSTS, "id long, text string"))
    return rows.select("id", F.array_join(places.emails_in(C("text")), " ").alias("emails"), F.array_join(places.phones_in(C("text")), "|").alias("phones"))


def _values(rows):
    cell = lambda x: "null" if x is None else str(x).lower() if isinstance(x, (bool, int, float)) else "'" + x.replace("'", "''") + "'"
    return "(values " + ", ".join("(" + ", ".join(map(cell, r)) + ")" for r in rows) + ")"


FRAMES = {
    "transcript_messages": (transcript_messages, "select role, trim(regexp_replace(coalesce(text, ''), '\\s+', ' ', 'g')) as text, count(*) as n, count(*) as at_odd_lines from conversations where role in ('user', 'assistant') group by 1, 2"),
    "markdown_notes": (notes, "with f as (select cast(n_nationkey as string) as k, '# region ' || n_regionkey || chr(10) || 'note' || chr(10) as t from nation) select min(k) as first, md5(t) as md5, sha256(t) as hash, cast(length(t) as bigint) as size from f group by t"),
    "session_stores": (stores, "select n_name as key, 's-' || n_nationkey as session_id, cast(n_nationkey * 1000 as bigint) as updated_at, cast(n_regionkey as string) as store from nation"),
    "finished_runs": (finished_runs, "select event_id as ts, 'j' || user_id as jobId, event_type as status, event_id * 2 as tokens from events where event_type <> 'view' and user_id % 9 <> 0"),
    "tailed_lines": (tailed_lines, "select o_orderpriority || ' ' || o_orderstatus as line, count(*) as n from orders group by 1"),
    "provider_costs": (provider_costs, "select cast(cast(l_shipdate as date) as string) as day, l_returnflag as model, round(sum(l_extendedprice), 2) as cost from lineitem where l_linestatus = 'F' group by 1, 2"),
    "reported_tests": (reported_tests, "select 'f' || n_regionkey as file, n_name as title, case when n_nationkey % 4 = 0 then 'failed' else 'passed' end as status, n_nationkey / 2.0 as ms from nation"),
    "pending_deliveries": (deliveries, "select 'd' || n_nationkey as id, n_name as channel, cast(100 - n_nationkey as bigint) as at, n_nationkey % 3 >= 2 or n_name = 'CHINA' as failed from nation where n_nationkey % 6 > 0"),
    "deleted_keys": (deleted_keys, "select o_orderkey, o_custkey from orders where o_orderkey not in (select o_orderkey from orders where o_orderstatus = 'F')"),
    "last_runs": (last_runs, "select user_id, event_id from events qualify row_number() over (partition by user_id order by ts desc, event_id desc) <= 7"),
    "user_redaction": (user_redaction, "select doc_id, md5(regexp_replace(text, '[0-9]{3}|[Ll]icense', '***', 'g')) as md5, md5(case when length(text) <= 160 then text else rtrim(text[1:160], ' ') || '...' end) as line from documents"),
    "pattern_safety": (pattern_safety, f"select * from {_values(PATTERNS)} t(pattern, safe) union all select p_name || ' ' || p_partkey || case p_partkey % 3 when 0 then '(a+)+' when 1 then '[a-z]+' else '(' end, p_partkey % 3 = 1 from part"),
    "atomic_reindex": (reindexed, "select upper(coalesce(source, 'none')) as source, count(*) as first, count(*) as second from documents group by 1"),
    "posts_sheet": (posts_sheet, "select coalesce(md5(text), '') as \"Post\", concat_ws('; ', lang, source) as \"Why\", '' as \"Set Aside\" from documents"),
    "contacts_in_posts": (contacts, "select c_custkey as id, regexp_extract(lower(c_name), '[a-z0-9._%+-]+$') || '@acme.com' as emails, (98765 + c_custkey % 9) || ' 43210' as phones from customer union all select * from (values (-1, 'hr@acme.company a@b.network', ''), (-2, '', '+971 50 123 4567|8146785224'), (-3, null, null), (-4, '', ''), (-5, '', '+91-98765 43210')) t(a, b, c)"),
    "noisy_arrays": (noisy_arrays, "select * from (values (1, '[{\"a\": 1}, {\"a\": 2}]'), (2, null), (3, '[]'), (4, '[ {\"b\": \"y\"} ]'), (5, null), (6, null)) t(id, records) union all select 1000 + event_id, '[{\"a\": ' || event_id || '}]' from events"),
    "stored_vectors": (stored_vectors, "select vec_id, len(embedding)::int as n, round(list_sum(embedding::double[]), 4) as total from embeddings union all select * from (values (-1, 2, 3.5), (-2, 0, 0.0), (-3, 0, 0.0), (-4, 0, 0.0), (-5, 1, 0.25)) t(a, b, c)"),
}
