"""Queries of the stored indexes, the log tail, waiting rows, patches, containment, trees and mergeable distributions."""

from __future__ import annotations

from pyspark.sql import functions as F

from quillspark.operators import closure, keywords, matching, patches, sketches, vectors
from quillspark.sources import tail
from quillspark.sources.sinks import shared_path
from quillspark.sources.tables import load
from quillspark.streaming import timers

DIM, TOP = 64, 6


def _vectors(exact):
    def query(spark, sf_dir):
        e = load(spark, sf_dir, "embeddings")
        index = vectors.build(e, "vec_id", "embedding", shared_path(spark, "vectors"), DIM)
        found = vectors.search(index, e.where("vec_id % 20 = 0"), "vec_id", "embedding", TOP, exact=exact)
        return found.select("query_id", F.col("id").alias("vec_id"), "score", "place")

    return query


def _keywords(spark, sf_dir, top=10):
    docs = load(spark, sf_dir, "documents")
    index = keywords.build(docs, "doc_id", "text", shared_path(spark, "keywords"))
    asked = load(spark, sf_dir, "benchmark").select("item_id", F.array_join(F.slice(F.split("text", " "), 1, 2), " ").alias("text"))
    found = keywords.search(index, asked, "item_id", "text", top, shared_path(spark, "keyword-search"))
    return keywords.with_snippets(found, docs, "doc_id", "text", 700).select(F.col("query_id").alias("item_id"), F.col("id").alias("doc_id"), "score", "place", F.md5("snippet").alias("snippet"))


def _logs(spark, sf_dir):
    folder = shared_path(spark, "logs")
    load(spark, sf_dir, "events").select(F.concat_ws(" ", "event_id", "event_type", "props").alias("line")).write.text(folder)
    spark.dataSource.register(tail.LogTail)
    lines = spark.read.format("logtail").option("path", folder).option("glob", "part-*").load()
    return lines.select(F.split("line", " ")[1].alias("kind"), "line", "reset", "truncated").groupBy("kind").agg(F.count("*").alias("n"), F.countDistinct("line").alias("lines"), F.bool_or("reset").alias("reset"))


def live(events):
    """The rows that wait: ms, a text, and a flag for each of the three rules."""
    id_ = F.col("event_id")
    return events.select("user_id", "event_id", F.struct(F.unix_micros(F.col("ts").cast("timestamp")).alias("us"), "event_id").alias("tie"), F.unix_millis(F.col("ts").cast("timestamp")).alias("ms"), F.concat_ws(" ", "event_type", "props").alias("text"),
        F.when(F.col("event_type") == "error", F.lit("now")).alias("now"), F.when(id_ % 13 == 0, F.lit("media")).when(id_ % 5 == 0, F.concat(F.lit("m"), id_ % 2)).alias("answers"))


#: name: (rule, column of the flag)
RULES = {
    "waiting_bursts": (timers.Debounce(6 * 3_600_000), "now"),
    "waiting_blocks": (timers.Coalesce(40, 200, 12 * 3_600_000), "answers"),
    "waiting_updates": (timers.Throttle(12 * 3_600_000), "none"),
}


def _waiting(name):
    def query(spark, sf_dir):
        rule, flag = RULES[name]
        rows = live(load(spark, sf_dir, "events")).withColumn("none", F.lit(None).cast("string"))
        sent = timers.waiting(rows, rule, "user_id", "ms", "tie", "text", F.col(flag))
        return sent.select(F.col("key").cast("long").alias("user_id"), "at", "n", "first", "last", F.md5("text").alias("text"))

    return query


def _patched(spark, sf_dir):
    orders, lines = load(spark, sf_dir, "orders"), load(spark, sf_dir, "lineitem")
    lines = lines.select("l_orderkey", "l_linenumber", "l_quantity").repartition("l_orderkey")  # both groupings and the join go by it
    parts = lines.groupBy("l_orderkey", "l_linenumber").agg(F.max("l_quantity").cast("int").alias("qty"))
    part = F.struct(F.col("l_linenumber").cast("string").alias("id"), F.col("qty"))
    parts = parts.groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.sort_array(F.collect_list(part)).alias("lines"))
    base = orders.join(parts, "o_orderkey", "left").select("o_orderkey", F.lit(0).alias("seq"), F.to_json(F.struct(
        F.struct(F.col("o_custkey").alias("key"), F.lit("a").alias("tier")).alias("buyer"), F.coalesce("lines", F.array()).alias("lines"), F.lit("x").alias("note"))).alias("json"))
    say = lambda seq, step, json: orders.where(F.col("o_orderkey") % step == 0).select("o_orderkey", F.lit(seq), F.lit(json))
    told = [
        say(1, 2, '{"buyer":{"tier":null,"name":"b"},"note":{"text":"n","__proto__":1},"lines":[{"id":"1","qty":0},{"id":"new","qty":null}]}'),
        say(2, 3, '{"buyer":7,"lines":[{"id":"new","more":[1,null]}]}'), say(3, 6, '{"buyer":{"again":true}}'), say(4, 5, "not json"),
    ]
    for t in told:
        base = base.unionByName(t.toDF(*base.columns))
    done = patches.folded(base, "o_orderkey", "seq", "json", by_id=True)
    return done.select(F.col("doc").cast("long").alias("o_orderkey"), "json")


PATCHED_SQL = """with l as (select l_orderkey as k, l_linenumber as n, max(l_quantity)::int as q from lineitem group by 1, 2),
a as (select k, string_agg('{"id":"' || n || '","qty":' || case when n = 1 and k % 2 = 0 then 0 else q end || '}', ',' order by n) as t, bool_or(n = 1) as one from l group by 1)
select o_orderkey, '{"buyer":' || case when o_orderkey % 6 = 0 then '{"again":true}' when o_orderkey % 3 = 0 then '7' when o_orderkey % 2 = 0 then '{"key":' || o_custkey || ',"name":"b"}' else '{"key":' || o_custkey || ',"tier":"a"}' end
 || ',"lines":[' || concat_ws(',', t, case when o_orderkey % 2 = 0 and not coalesce(one, false) then '{"id":"1","qty":0}' end,
   case when o_orderkey % 6 = 0 then '{"id":"new","more":[1,null]}' when o_orderkey % 3 = 0 then '{"id":"new","more":[1,null]}' when o_orderkey % 2 = 0 then '{"id":"new"}' end)
 || '],"note":' || case when o_orderkey % 2 = 0 then '{"text":"n"}' else '"x"' end || '}' as json from orders left join a on k = o_orderkey"""


def _either(spark, sf_dir):
    items = load(spark, sf_dir, "benchmark")
    docs = load(spark, sf_dir, "documents").select("doc_id", "text").union(items.select(-F.col("item_id") - 1, F.concat(F.lit("\t"), F.substring("text", 5, 60), F.lit("  "))))
    return matching.contained_either(docs, "doc_id", items, "item_id", "text")


FOREST = "case when o_orderkey % 100 > 0 then o_orderkey - 1 when o_orderkey // 100 % 10 = 3 then o_orderkey + 60 when o_orderkey % 300 = 0 then o_orderkey - 100 end"


def _forest(orders):
    """Chains of 100 orders; every third one hangs on the one before, every tenth runs in a circle."""
    return orders.select("o_orderkey", F.expr(FOREST.replace("//", "div")).alias("parent"))


def _rooted(spark, sf_dir):
    found = closure.pointers(_forest(load(spark, sf_dir, "orders")), "o_orderkey", "parent", shared_path(spark, "forest"))
    return found.select(F.col("key").alias("o_orderkey"), "root", "depth", "cyclic")


def _below(spark, sf_dir):
    orders = load(spark, sf_dir, "orders")
    return closure.descendants(_forest(orders), "o_orderkey", "parent", orders.where("o_orderkey % 130 = 7").select("o_orderkey"), shared_path(spark, "below"))


EDGES = f"e as (select o_orderkey as k, case when p in (select o_orderkey from orders) then p end as p from (select o_orderkey, {FOREST} as p from orders))"


def _sketched(spark, sf_dir):
    days = sketches.daily(load(spark, sf_dir, "events"), F.to_date("ts"), ["event_type"], "value")
    return sketches.merged(days, ["event_type"], {"p50": 0.5, "p95": 0.95, "p99": 0.99})


def _buckets(spark, sf_dir):
    days = sketches.histogram(load(spark, sf_dir, "events").withColumn("day", F.to_date("ts")), ["day", "event_type"], "value")
    return sketches.merged_histograms(days, ["event_type"])


COSINE_SQL = """with s as (select q.vec_id as query_id, e.vec_id, round(list_inner_product(e.embedding::double[], q.embedding::double[]) / sqrt(list_inner_product(e.embedding::double[], e.embedding::double[]) * list_inner_product(q.embedding::double[], q.embedding::double[])), 6) as score
 from embeddings e join embeddings q on q.vec_id % 20 = 0 and q.vec_id <> e.vec_id)
select query_id, vec_id, score, row_number() over (partition by query_id order by score desc, vec_id)::int as place from s qualify place <= 6"""
WORDS = "regexp_extract_all(lower({}), '[\\p{{L}}\\p{{N}}_]+')"
KEYWORD_SQL = f"""with d as (select doc_id, {WORDS.format('text')} as t from documents where text is not null), g as (select count(*) as docs, avg(len(t)) as mean from d),
q as (select item_id, list_distinct({WORDS.format("array_to_string(string_split(text, ' ')[1:2], ' ')")}) as t from benchmark), qw as (select item_id, len(t) as need, unnest(t) as word from q),
h as (select doc_id, len(t) as n, unnest(t) as word from d), f as (select doc_id, n, word, count(*) as tf from h where word in (select word from qw) group by all), df as (select word, count(*) as df from f group by 1),
s as (select item_id, need, doc_id, count(*) as found, round(sum(ln(1 + (docs - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * n / mean))), 6) as score from qw join f using (word) join df using (word), g group by 1, 2, 3),
r as (select item_id, doc_id, score, row_number() over (partition by item_id order by score desc, doc_id)::int as place from s where found = need)
select item_id, doc_id, score, place, md5(text[1:700]) as snippet from r join documents using (doc_id) where place <= 10"""
LIVE_SQL = "l as (select user_id, event_id, epoch_us(ts) // 1000 as ms, event_type || ' ' || props as text, event_type = 'error' as now, case when event_id % 13 = 0 then 'media' when event_id % 5 = 0 then 'm' || (event_id % 2) end as flag, row_number() over (partition by user_id order by ts, event_id) as rn from events)"
BURST_SQL = f"""with {LIVE_SQL}, b as (select *, coalesce(now or lag(now) over w or ms - lag(ms) over w >= 21600000, true)::int as fresh, lead(ms) over w as next_ms, lead(now) over w as next_now from l window w as (partition by user_id order by rn)),
g as (select *, sum(fresh) over (partition by user_id order by rn) as grp from b)
select user_id, case when bool_or(now) then max(ms) else least(max(ms) + 21600000, coalesce(arg_max(case when next_now then next_ms end, rn), 9e18::bigint)) end as "at", count(*) as n, min(ms) as first, max(ms) as last, md5(string_agg(text, chr(10) order by rn)) as text from g group by user_id, grp"""
BLOCKS_SQL = f"""with recursive {LIVE_SQL},
w as (select user_id, rn, ms, case when flag = 'media' then null else ms + 43200000 end as due, case when flag = 'media' then 0 else length(text) end as used, case when flag <> 'media' then flag end as note, 1 as block, 1 as next_block, null::bigint as sent_at from l where rn = 1
 union all
 select user_id, rn, ms, case when media or filled then null else ms + 43200000 end, case when media or filled then 0 when fresh then size else used + 1 + size end, case when fresh and not media then flag else note end,
  case when media or fresh then next_block + 1 else next_block end, case when media then next_block + 1 when fresh then next_block + 1 else next_block end, flushed from (
  select *, case when media then false else (case when fresh then size else used + 1 + size end) >= 200 end as filled from (
   select l.user_id, l.rn, l.ms, l.flag, w.used, w.note, w.next_block, length(l.text) as size, coalesce(l.flag = 'media', false) as media,
    w.used = 0 or (w.due <= l.ms and w.used >= 40) or coalesce(l.flag = 'media', false) or (l.flag is not null and l.flag is distinct from w.note) or w.used + 1 + length(l.text) > 200 as fresh,
    case when w.used > 0 and w.due <= l.ms and w.used >= 40 then w.due end as flushed
   from w join l on l.user_id = w.user_id and l.rn = w.rn + 1) x) y)
select user_id, count(*) as n, min(w.ms) as first, max(w.ms) as last, md5(string_agg(text, chr(10) order by rn)) as text from w join l using (user_id, rn) group by user_id, block"""
UPDATES_SQL = f"""with recursive {LIVE_SQL}, w as (select user_id, rn, ms, ms as due from l where rn = 1
 union all select l.user_id, l.rn, l.ms, case when l.ms >= w.due + 43200000 then l.ms when l.ms < w.due then w.due else w.due + 43200000 end from w join l on l.user_id = w.user_id and l.rn = w.rn + 1)
select user_id, due as "at", 1 as n, max(w.ms) as first, max(w.ms) as last, md5(arg_max(text, rn)) as text from w join l using (user_id, rn) group by user_id, due"""
EITHER_SQL = """with f as (select doc_id, text from documents union all select -item_id - 1, chr(9) || text[5:64] || '  ' from benchmark),
d as (select doc_id, trim(regexp_replace(lower(text), '\\s+', ' ', 'g')) as t from f), i as (select item_id, trim(regexp_replace(lower(text), '\\s+', ' ', 'g')) as t from benchmark)
select doc_id, item_id, contains(d.t, i.t) as holds, contains(i.t, d.t) as held from d join i on (contains(d.t, i.t) or contains(i.t, d.t)) and length(d.t) >= 10 and length(i.t) >= 10"""
FRAMES = {
    "cosine_indexed_topk": (_vectors(False), None),
    "cosine_indexed_exact": (_vectors(True), COSINE_SQL),
    "keyword_indexed_topk": (_keywords, KEYWORD_SQL),
    "log_tail_lines": (_logs, "select event_type as kind, count(*) as n, count(distinct event_id) as lines, false as reset from events group by 1"),
    "waiting_bursts": (_waiting("waiting_bursts"), BURST_SQL),
    "waiting_blocks": (lambda s, d: _waiting("waiting_blocks")(s, d).drop("at"), BLOCKS_SQL),
    "waiting_updates": (_waiting("waiting_updates"), UPDATES_SQL),
    "patched_documents": (_patched, PATCHED_SQL),
    "contained_either_way": (_either, EITHER_SQL),
    "forest_roots": (_rooted, f"with recursive {EDGES}, t as (select k, k as root, 0::bigint as depth from e where p is null union all select e.k, t.root, t.depth + 1 from t join e on e.p = t.k) select e.k as o_orderkey, root, depth, root is null as cyclic from e left join t on e.k = t.k"),
    "forest_descendants": (_below, f"with recursive {EDGES}, t as (select e.p as ancestor, k as key, 1::bigint as depth from e where p % 130 = 7 union select t.ancestor, e.k, t.depth + 1 from t join e on e.p = t.key where e.k <> t.ancestor) select * from t"),
    "latency_sketched": (_sketched, None),
    "latency_buckets": (_buckets, """with v as (select event_type, value as v, floor(log2(value) * 4)::int as g from events where value > 0),
b as (select event_type, 1 as sign, case when pow(2.0, g / 4.0) >= v then g - 1 when pow(2.0, (g + 1) / 4.0) < v then g + 1 else g end as bucket from v union all select event_type, sign(value)::int, null from events where value <= 0)
select event_type, sign, bucket, count(*) as n from b group by all"""),
}
