"""Queries of queues, mentions, learned ids, collation, addresses, search urls and shaped history."""

from __future__ import annotations

from pyspark.sql import functions as F

from quillspark.functions import places
from quillspark.functions.numbers import nearest_ms
from quillspark.operators import queues, relational
from quillspark.sources.tables import load

ADDRESSES = [
    (1, "12, 2nd Ave, Anna Nagar, Chennai, Tamil Nadu 600040, India", "Chennai"), (2, "Chennai 600040, India", "chennai"), (3, "5 Main St, Springfield, IL 62701", ""),
    (4, "221B Baker St, Marylebone, London NW1 6XE", None), (5, "India, 600040", "Chennai"), (6, None, "x"), (7, "A, B", "Nowhere"),
]
URLS = [(1, "https://h.test/p/?keywords=a%20b&geo=%5B%221%22%5D&page=2", 3), (2, "https://h.test/p/?keywords=a+b&page=2#x", 1), (3, "https://h.test/p/", 2), (4, "https://h.test/p/?page=4", 0), (5, "https://h.test/?k=(it's)!~*", 5)]
PAIRS = [(1, "geo", "Theni  Town", "1"), (2, "geo", " theni town", "1"), (3, "geo", "Chennai", "7"), (4, "geo", "CHENNAI", "2"), (5, "geo", "Chennai", "2"), (6, "", "x", "3"), (7, "geo", None, "3"), (8, "org", "Chennai", "9"), (9, "geo", "Old", "5")]
HISTORY = [
    (1, [("text", "hello " * 10, None, None), ("image", None, None, "abcd")]), (2, [("thinking", "so", "sig", None)]), (3, []), (4, None), (5, [("text", "password: hunter2hunter2hunter2 ok", None, None), ("other", None, "s", "d")]),
]
LIVE = "select event_id, user_id, ts, event_type, event_type = 'error' as drain, sum((event_type = 'error')::int) over (partition by user_id order by ts, event_id) as round from events"


def _events(spark, sf_dir):
    return load(spark, sf_dir, "events").withColumn("ms", F.unix_millis(F.col("ts").cast("timestamp")))


def _fates(policy):
    return lambda s, d: queues.bounded_queue(load(s, d, "events"), "user_id", ["ts", "event_id"], F.col("event_type") == "error", 3, policy).select("event_id", "fate")


def _fate_sql(order):
    return f"select event_id, case when drain then 'drain' when row_number() over (partition by user_id, round, drain order by {order}) <= 3 then 'queued' else 'dropped' end as fate from ({LIVE})"


def summaries(spark, sf_dir):
    turns = load(spark, sf_dir, "conversations").groupBy("conv_id", "turn").agg(F.max("role").alias("role"), F.max("text").alias("text"))
    out = queues.bounded_queue(turns, "conv_id", ["turn"], F.lit(False), 1, "summarize", "text")
    return out.select("conv_id", "turn", "fate", F.md5("summary").alias("line"))


def again(spark, sf_dir):
    e = load(spark, sf_dir, "events").withColumn("message", F.expr("if(event_id % 3 = 0, ' ', concat('m', event_id % 4))")).withColumn("prompt", F.expr("event_id % 5"))
    drains = F.col("event_type") == "error"
    out = queues.waiting_already(e, "user_id", ["ts", "event_id"], drains, ["event_type"], "message")
    return queues.waiting_already(out.withColumnRenamed("again", "by_id"), "user_id", ["ts", "event_id"], drains, ["event_type"], "message", "prompt").select("event_id", "by_id", "again")


def throttle(spark, sf_dir):
    e = _events(spark, sf_dir).withColumn("text", F.expr("if(event_id % 7 = 0, ' ', event_type)"))
    return queues.throttled(e, "user_id", "ms", "event_id", "text", 6 * 3_600_000).select("event_id", "sent_at", "sent")


def learn(spark, sf_dir):
    c = load(spark, sf_dir, "customer")
    table = spark.createDataFrame([("geo", "Theni Town", "1"), ("geo", "Old", "4")], "facet string, label string, id string")
    table = table.union(c.where("c_custkey % 2 = 0").selectExpr("'name'", "c_name", "cast(c_custkey as string)"))
    pairs = spark.createDataFrame(PAIRS, "seq long, facet string, label string, id string")
    pairs = pairs.union(c.selectExpr("100 + c_custkey", "'name'", "concat(' ', upper(c_name))", "cast(c_custkey + if(c_custkey % 3 = 0, 0, 1000000) as string)"))
    return relational.learned(table, pairs, ["seq"])


def areas(spark, sf_dir):
    rows = spark.createDataFrame(ADDRESSES, "id long, address string, city string")
    return rows.union(load(spark, sf_dir, "customer").selectExpr("1000 + c_custkey", "concat(c_name, ', ', c_mktsegment, ', town ', c_nationkey, ', India')", "concat('Town', c_nationkey)")).select("id", places.area(F.col("address"), F.col("city")).alias("area"))


def search_urls(spark, sf_dir):
    u = spark.createDataFrame(URLS, "id long, url string, n int").union(load(spark, sf_dir, "pages").selectExpr("1000 + page_id", "url", "cast(page_id % 4 as int)"))
    return u.select("id", places.page_url(F.col("url"), F.col("n")).alias("page"), F.array_join(places.facet_urls(F.col("url"), "geo", F.array(F.lit("7"), F.lit("8"))), " ").alias("split"))


def kept_words(spark, sf_dir):
    return load(spark, sf_dir, "part").select("p_partkey", places.without_words(F.concat("p_name", F.lit(", in Theni ,x")), ["THENI", "", "widget"]).alias("keywords"))


def history(spark, sf_dir):
    empty = "cast(null as string)"
    given = load(spark, sf_dir, "conversations").selectExpr("1000 + conv_id * 1000 + turn", f"array(named_struct('type', 'text', 'text', text, 'signature', {empty}, 'data', {empty}), named_struct('type', 'image', 'text', {empty}, 'signature', {empty}, 'data', text))")
    h = spark.createDataFrame(HISTORY, "id long, content array<struct<type: string, text: string, signature: string, data: string>>").union(given)
    s = h.select("id", places.shaped_blocks(F.col("content"), 40).alias("s"))
    return s.select("id", F.array_size("s.blocks").alias("n"), F.array_join(F.transform("s.blocks", lambda b: F.coalesce(b["bytes"].cast("string"), F.lit("-"))), ",").alias("bytes"), "s.cut", "s.redacted")


FRAMES = {
    "queue_drops_oldest": (_fates("old"), _fate_sql("ts desc, event_id desc")),
    "queue_drops_newest": (_fates("new"), _fate_sql("ts, event_id")),
    "queue_summary_lines": (summaries, "with t as (select conv_id, turn, max(text) as x from conversations group by 1, 2), r as (select *, row_number() over (partition by conv_id order by turn desc) as k, trim(regexp_replace(x, '[ \\t\\n\\x0B\\f\\r]+', ' ', 'g'), ' ') as l from t) select conv_id, turn, case when k = 1 then 'queued' else 'dropped' end as fate, case when k = 2 then md5(case when length(l) <= 160 then l else rtrim(l[1:159], ' ') || '…' end) end as line from r"),
    "queue_waiting_already": (again, f"with e as (select *, case when event_id % 3 > 0 then event_id % 4 end as m, event_id % 5 as p from ({LIVE})), i as (select *, not drain and m is not null and row_number() over (partition by user_id, round, drain, event_type, m order by ts, event_id) > 1 as by_id from e) select event_id, by_id, not drain and case when m is null then coalesce(sum((not by_id)::int) over (partition by user_id, round, drain, event_type, p order by ts, event_id rows between unbounded preceding and 1 preceding), 0) > 0 else by_id end as again from i"),
    "throttled_updates": (throttle, None),
    "mentioned_lately": (lambda s, d: queues.mentioned_lately(load(s, d, "events").withColumn("ms", nearest_ms(F.col("ts"))), ["user_id"], "ms", ["ts", "event_id"], F.col("event_type") == "view", 43_200_000).select("event_id", "lately"), "select event_id, coalesce(epoch_ms(ts) - max(case when event_type = 'view' then epoch_ms(ts) end) over (partition by user_id order by ts, event_id) <= 43200000, false) as lately from events"),
    "learned_ids": (learn, "select * from (values ('geo', 'theni town', '1', 'Theni Town', false), ('geo', 'chennai', '2', 'CHENNAI', true), ('org', 'chennai', '9', 'Chennai', true), ('geo', 'old', '5', 'Old', true)) t(facet, key, id, label, changed) union all select 'name', lower(c_name), (c_custkey + case when c_custkey % 3 = 0 then 0 else 1000000 end)::varchar, case when c_custkey % 6 = 0 then c_name else upper(c_name) end, c_custkey % 6 <> 0 from customer"),
    "collated_names": (lambda s, d: relational.collated_rank(load(s, d, "part").withColumn("name", F.expr("if(p_partkey % 2 = 0, upper(p_name), p_name)")), ["p_brand"], "name", "p_partkey").select("p_partkey", "rank"), "select p_partkey, row_number() over (partition by p_brand order by lower(p_name), p_partkey)::int as rank from part"),
    "chunk_scan": (lambda s, d: relational.chunks_of(load(s, d, "documents").withColumn("model", F.col("lang")), "en", ["src1", "src3"]).select("doc_id"), "select doc_id from documents where lang = 'en' and source in ('src1', 'src3')"),
    "address_areas": (areas, "select * from (values (1, 'Anna Nagar'), (2, 'Chennai 600040'), (3, 'Springfield'), (4, 'Marylebone'), (5, ''), (6, ''), (7, 'B')) t(id, area) union all select 1000 + c_custkey, c_mktsegment from customer"),
    "engine_windows": (lambda s, d: load(s, d, "part").select("p_partkey", places.engine_days(F.expr("nullif(p_size % 4, 3)")).alias("days")), "select p_partkey, case when p_size % 4 in (0, 3) then 12 else p_size % 4 + 2 end as days from part"),
    "search_urls": (search_urls, None),
    "keywords_without_words": (kept_words, "select p_partkey, trim(regexp_replace(regexp_replace(p_name || ', in ,x', '\\bwidget\\b', ' ', 'gi'), '[ ,]+', ' ', 'g'), ' ') as keywords from part"),
    "shaped_history": (history, "select * from (values (1, 2, '-,4', true, false), (2, 1, '-', true, false), (3, 0, '', false, false), (4, null, null, false, false), (5, 2, '-,-', false, true)) t(id, n, bytes, cut, redacted) union all select 1000 + conv_id * 1000 + turn, 2, '-,' || coalesce(length(text)::varchar, '-'), text is not null, false from conversations"),
}
