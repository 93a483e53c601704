"""All queries of the library, with an equivalent SQL statement where SQL can express one.

Most plans are one statement that Spark and the oracle both read, given the words on which their dialects differ.
"""

from __future__ import annotations

import re

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quillspark.functions import text as T
from quillspark.operators import matching, ordered, query_filter, vectors
from quillspark.plans import content, decisions, files, indexed, more, scalars, secondary, waiting
from quillspark.sources import sinks
from quillspark.sources.tables import TABLES, load
from quillspark.streaming import events as live

#: word: (Spark, oracle)
WORDS = {
    "K": ("cast(get_json_object(props, '$.k') as bigint)", "cast(json_extract_string(props, '$.k') as bigint)"),
    "US": ("unix_micros(cast(ts as timestamp))", "epoch_us(ts)"),
    "P95": ("percentile({}, 0.95D)", "quantile_cont({}, 0.95)"),
    "MEDIAN": ("percentile({}, 0.5D)", "quantile_cont({}, 0.5)"),
    "DAY": ("cast(cast(ts as date) as string)", "cast(cast(ts as date) as string)"),
}


def _say(text: str, side: int) -> str:
    return re.sub(r"@(\w+)(?:\((\w+)\))?", lambda m: WORDS[m[1]][side].replace("{}", m[2] or ""), text)


def _statement(text: str):
    def run(spark, sf_dir):
        for name in TABLES:
            if re.search(rf"\b{name}\b", text):
                load(spark, sf_dir, name).createOrReplaceTempView(name)
        return spark.sql(_say(text, 0))

    return run


SESSIONS = """select concat('u', cast(user_id as string)) as key, concat('user ', cast(user_id as string)) as label, concat('s-', cast(user_id as string)) as session_id,
 concat('agent', cast(user_id % 5 as string)) as agent, case user_id % 3 when 0 then 'web' when 1 then 'mail' else 'chat' end as channel,
 min(event_type) as model, cast(sum(@K) as bigint) as total_tokens, round(sum(value), 4) as total_cost, count(*) as messages, sum(case when event_type = 'error' then 1 else 0 end) as errors
 from events group by user_id"""

BOTH = {
    # aggregations
    "usage_daily_by_type": "select @DAY as day, event_type, count(*) as calls, cast(sum(@K) as bigint) as tokens, round(sum(value), 4) as cost from events group by 1, 2",
    "usage_daily_utc_offset": "select cast(cast(ts + interval '330' minute as date) as string) as day, count(*) as calls, round(sum(value), 4) as cost from events group by 1",
    "usage_mosaic_hour_weekday": "select extract(hour from ts) as hour, count(*) as calls, count(distinct user_id) as users from events group by 1",
    "top_cost_member_per_day": "with d as (select cast(cast(o_orderdate as date) as string) as day, o_orderpriority, round(sum(o_totalprice), 2) as cost from orders group by 1, 2), r as (select *, row_number() over (partition by day order by cost desc, o_orderpriority) as rn from d) select day, o_orderpriority, cost from r where rn = 1",
    "latest_day_cost": "with d as (select event_type, cast(ts as date) as day, sum(value) as cost from events group by 1, 2), r as (select *, row_number() over (partition by event_type order by day desc) as rn from d) select event_type, cast(day as string) as day, round(cost, 4) as cost from r where rn = 1",
    "median_by_type": "select event_type, round(@MEDIAN(value)) as median, count(*) as n from events group by 1",
    "severity_counts": "select o_orderpriority as severity, count(*) as n, sum(case when o_orderstatus = 'F' then 1 else 0 end) as closed from orders group by 1",
    "source_counts": "select source, lang, count(*) as files, count(distinct doc_id) as docs, sum(n_chars) as chars from documents group by 1, 2",
    # filters
    "sessions_active_recent": "with s as (select user_id, max(ts) as updated from events group by 1) select user_id, cast(updated as string) as updated from s where updated >= timestamp '2024-01-30 00:00:00' order by s.updated desc, user_id",
    "paged_read": "select doc_id, source, n_chars from documents order by doc_id limit 50 offset 100",
    # joins
    "seen_semi_join": "select c_custkey, c_mktsegment from customer where exists (select 1 from orders where o_custkey = c_custkey)",
    "unreferenced_check": "select d.doc_id, count(l.doc_id) as refs from documents d left join labels l on d.doc_id = l.doc_id group by 1 having count(l.doc_id) = 0",
    # windows
    "usage_timeseries_cumulative": "select event_id, user_id, cast(sum(@K) over w as bigint) as tokens, round(sum(value) over w, 4) as cost from events window w as (partition by user_id order by ts, event_id rows between unbounded preceding and current row)",
    "turn_gap_lag": "select event_id, user_id, @US - lag(@US) over (partition by user_id order by ts, event_id) as gap_us from events",
    "keep_most_recent_n": "select event_id, user_id from (select *, row_number() over (partition by user_id order by ts desc, event_id desc) as rn from events) r where rn <= 5",
    "suppress_consecutive_duplicates": "with l as (select event_id, user_id, ts, event_type, lag(event_type) over (partition by user_id order by ts, event_id) as before from events), k as (select *, row_number() over (partition by user_id order by ts desc, event_id desc) as rn from l where before is null or before <> event_type) select event_id, user_id, event_type from k where rn <= 20",
    "contiguous_prefix_depth": "select conv_id, count(*) as depth from (select distinct conv_id, turn, dense_rank() over (partition by conv_id order by turn) as dr from conversations) r where turn = dr - 1 group by 1",
    "newest_within_token_share": "select conv_id, turn from (select conv_id, turn, sum(ceil(length(text) / 4.0D)) over (partition by conv_id order by turn desc) as used from conversations) r where used <= 800",
    "repost_fold": "select doc_id, source from (select doc_id, source, row_number() over (partition by source, md5(lower(text)) order by doc_id desc) as rn from documents) r where rn = 1",
    "sequence_per_run": "select event_id, row_number() over (partition by user_id order by ts, event_id) as seq from events",
    "rate_window_sliding": "select event_id, count(*) over (partition by user_id order by @US range between 86400000000 preceding and current row) as in_window from events",
    # sets, top-k and extensions
    "session_sort_by_cost": "select user_id, cost from (select user_id, round(sum(value), 4) as cost, row_number() over (order by sum(value) desc, user_id) as rn from events group by 1) r where rn <= 25",
    "slowest_top_n": "select event_id, value from events order by value desc, event_id limit 20",
    "set_operations": "select o_custkey as k, 'both' as part from orders intersect select c_custkey, 'both' from customer union all (select c_custkey, 'new' from customer except select o_custkey, 'new' from orders)",
    "rollup_region_nation": "select r_name, n_name, count(*) as customers, round(sum(c_acctbal), 2) as balance from customer join nation on c_nationkey = n_nationkey join region on n_regionkey = r_regionkey group by rollup (r_name, n_name)",
    "pricing_summary": "select l_returnflag, l_linestatus, sum(l_quantity) as sum_qty, round(sum(l_extendedprice * (1 - l_discount)), 2) as revenue, count(*) as lines from lineitem where l_shipdate <= timestamp '1998-09-02' group by 1, 2",
    "intent_classify": "select doc_id, case when lower(text) like '%looking for%' then 'buyer' when text like '%?%' then 'question' when lower(text) like '%license%' then 'legal' else 'other' end as intent from documents",
    "temporal_decay_scores": "select doc_id, round(exp(-0.023104906018664842D * (doc_id % 365)) * n_chars / 1000.0D, 6) as score from documents",
}


def _sessions(query: str):
    return lambda spark, sf_dir: query_filter.apply(_statement(SESSIONS)(spark, sf_dir), query).select("key", "total_tokens", "messages")


def _filtered(where: str) -> str:
    return f"with s as ({_say(SESSIONS, 1)}) select key, total_tokens, messages from s where {where}"


def ttl_dedupe_refreshing(spark, sf_dir):
    return ordered.ttl_dedupe(load(spark, sf_dir, "events"), "user_id", "ts", "event_id", 3600).select("event_id", "duplicate")


def char_budget_clamp(spark, sf_dir):
    return ordered.clamp_chars(load(spark, sf_dir, "conversations").groupBy("conv_id", "turn").agg(F.min("text").alias("text")), "conv_id", ["turn"], "text", 400)


def evict_oldest_until_budget(spark, sf_dir):
    d = load(spark, sf_dir, "documents").select("doc_id", "source", "n_chars")
    return ordered.evict_oldest(d, "source", ["doc_id"], "n_chars", F.lit(60_000)).select("doc_id", "evicted")


def as_of_join(spark, sf_dir):
    e = load(spark, sf_dir, "events").select("event_id", "user_id", "ts", "event_type", "value")
    right = e.where("event_type = 'purchase'").groupBy("user_id", "ts").agg(F.max("value").alias("last_purchase"))
    return ordered.as_of(e.drop("value"), right, "user_id", "ts", "last_purchase").select("event_id", F.round("last_purchase", 6).alias("last_purchase"))


def cosine_topk(spark, sf_dir, asked="vec_id % 20 = 0"):
    """A stated query set against all rows."""
    e = load(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    return vectors.nearest(e, "vec_id", "embedding", e.where(asked), 6).select("query_id", F.col("id").alias("vec_id"), "score", "place")


def bm25(spark, sf_dir, words=("the", "tion", "license", "released")):
    d = load(spark, sf_dir, "documents").select("doc_id", T.tokens(F.col("text")).alias("t"))
    d = d.select("doc_id", F.size("t").alias("n"), F.filter("t", lambda x: x.isin(list(words))).alias("t"))
    whole = d.agg(F.count("*").alias("docs"), F.avg("n").alias("mean"))
    hits = d.select("doc_id", "n", F.explode("t").alias("word")).groupBy("doc_id", "n", "word").agg(F.count("*").alias("tf"))
    df = hits.groupBy("word").agg(F.count("*").alias("df"))
    w = F.log(1 + (F.col("docs") - F.col("df") + 0.5) / (F.col("df") + 0.5)) * F.col("tf") * 2.2 / (F.col("tf") + 1.2 * (0.25 + 0.75 * F.col("n") / F.col("mean")))
    return hits.join(F.broadcast(df), "word").join(F.broadcast(whole)).groupBy("doc_id").agg(F.sum(w).alias("s"))


def bm25_topk(spark, sf_dir):
    return bm25(spark, sf_dir).select("doc_id", F.round("s", 6).alias("score")).orderBy(F.col("score").desc(), "doc_id").limit(20)


def hybrid_fusion(spark, sf_dir):
    k = bm25(spark, sf_dir).select(F.col("doc_id").alias("id"), (F.col("s") / (1 + F.col("s"))).alias("text_score"))
    v = cosine_topk(spark, sf_dir, "vec_id = 0").select(F.col("vec_id").alias("id"), F.col("score").alias("vector_score"))
    score = 0.7 * F.coalesce("vector_score", F.lit(0.0)) + 0.3 * F.coalesce("text_score", F.lit(0.0))
    return v.join(k, "id", "full_outer").where(score >= 0.05).select("id", F.round(score, 6).alias("score"))


def mmr_rerank(spark, sf_dir, candidates=24):
    d = load(spark, sf_dir, "documents")
    top = W.partitionBy("lang").orderBy(F.col("n_chars").desc(), "doc_id")
    return ordered.mmr(d.withColumn("p", F.row_number().over(top)).where(F.col("p") <= candidates).withColumn("score", F.col("n_chars").cast("double")), "lang", "doc_id", "score", "text")


def containment_dedupe(spark, sf_dir):
    return matching.contained(load(spark, sf_dir, "documents"), "doc_id", load(spark, sf_dir, "benchmark"), "item_id", "text", 10)


def tokens_ascii(spark, sf_dir):
    found = load(spark, sf_dir, "documents").select(T.tokens(F.col("text")).alias("t"))
    # two narrow branches under one aggregation: a distinct count would shuffle every pair of token and document
    every = found.select(F.explode("t").alias("token"), F.lit(1).alias("n"), F.lit(0).alias("docs"))
    once = found.select(F.explode(F.array_distinct("t")), F.lit(0), F.lit(1))
    return every.union(once).groupBy("token").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))


def content_flags(spark, sf_dir):
    rows = load(spark, sf_dir, "documents").select("doc_id", "text").union(spark.createDataFrame([(-1, "Please ignore previous instructions"), (-2, "a​b")], "doc_id long, text string"))
    return rows.select("doc_id", T.has_injection(F.col("text")).alias("injection"), T.has_secret(F.col("text")).alias("secret"), (F.length("text") - F.length(T.visible(F.col("text")))).alias("invisible"))


def secret_redact_assignments(spark, sf_dir):
    return load(spark, sf_dir, "documents").where(T.has_secret(F.col("text"))).select("doc_id", F.md5(T.redact(F.col("text"))).alias("redacted_md5"))


def html_title_text(spark, sf_dir):
    return load(spark, sf_dir, "pages").select("page_id", F.regexp_extract("html", r"(?is)<title[^>]*>(.*?)</title>", 1).alias("title"), F.md5(T.html_text(F.col("html"))).alias("text_md5"))


def links_extract(spark, sf_dir):
    return load(spark, sf_dir, "pages").select("page_id", F.explode(F.array_distinct(F.regexp_extract_all("html", F.lit('href="([^"]*)"'), F.lit(1)))).alias("link"))


def email_extract(spark, sf_dir):
    found = F.regexp_extract_all(F.lower("text"), F.lit(r"(?<![a-z0-9._%+-])[a-z0-9._%+-]{1,64}+@[a-z0-9.-]{1,253}\.[a-z]{2,}"), F.lit(0))
    return load(spark, sf_dir, "documents").select("doc_id", F.explode(found).alias("email")).groupBy("doc_id", "email").agg(F.count("*").alias("n"))


def csv_guarded(spark, sf_dir):
    d = load(spark, sf_dir, "customer").select("c_custkey", F.when(F.col("c_custkey") % 7 == 0, F.concat(F.lit("="), "c_name")).otherwise(F.col("c_name")).alias("c_name"))
    return sinks.csv_lines(d, ["c_custkey", "c_name"])


def keyed_upsert(spark, sf_dir):
    c = load(spark, sf_dir, "customer").select("c_custkey", "c_mktsegment")
    changes = c.where("c_custkey % 10 = 0").select((F.col("c_custkey") + 5).alias("c_custkey"), F.lit("CHANGED").alias("c_mktsegment"))
    return sinks.upsert(c, changes, "c_custkey")


def merge_patch_maps(spark, sf_dir):
    e = load(spark, sf_dir, "nation")
    base = F.create_map(F.lit("name"), F.col("n_name"), F.lit("region"), F.col("n_regionkey").cast("string"))
    patch = F.create_map(F.lit("region"), F.lit(None).cast("string"), F.lit("key"), F.col("n_nationkey").cast("string"))
    m = sinks.merge_patch(base, patch)
    return e.select("n_nationkey", m["name"].alias("name"), F.map_contains_key(m, "region").alias("has_region"), m["key"].alias("key"))


DAY_SQL = "select strftime(date_trunc('day', ts), '%Y-%m-%d %H:%M:%S') as start, event_type, count(*) as calls, round(sum(value), 4) as total from events group by 1, 2"
FRAMES = {
    "ttl_dedupe_refreshing": (ttl_dedupe_refreshing, "select event_id, coalesce(epoch_us(ts) - lag(epoch_us(ts)) over (partition by user_id order by ts, event_id) < 3600000000, false) as duplicate from events"),
    "char_budget_clamp": (char_budget_clamp, "with c as (select conv_id, turn, min(text) as text from conversations group by 1, 2), b as (select *, coalesce(sum(length(text)) over (partition by conv_id order by turn rows between unbounded preceding and 1 preceding), 0) as before from c) select conv_id, turn, substr(text, 1, cast(400 - before as int)) as text from b where before < 400"),
    "evict_oldest_until_budget": (evict_oldest_until_budget, "select doc_id, sum(n_chars) over (partition by source) - coalesce(sum(n_chars) over (partition by source order by doc_id rows between unbounded preceding and 1 preceding), 0) > 60000 as evicted from documents"),
    "as_of_join": (as_of_join, "with r as (select user_id, ts, max(value) as v from events where event_type = 'purchase' group by 1, 2) select e.event_id, round(r.v, 6) as last_purchase from events e asof left join r on e.user_id = r.user_id and e.ts >= r.ts"),
    "cosine_topk": (cosine_topk, "with s as (select q.vec_id as query_id, e.vec_id, round(list_inner_product(e.embedding::double[], q.embedding::double[]) / sqrt(list_inner_product(e.embedding::double[], e.embedding::double[]) * list_inner_product(q.embedding::double[], q.embedding::double[])), 6) as score from embeddings e join embeddings q on q.vec_id % 20 = 0 and q.vec_id <> e.vec_id), r as (select *, row_number() over (partition by query_id order by score desc, vec_id) as place from s) select query_id, vec_id, score, place from r where place <= 6"),
    "bm25_topk": (bm25_topk, "with d as (select doc_id, regexp_extract_all(lower(text), '[a-z0-9_]+') as t from documents), n as (select doc_id, len(t) as n from d), h as (select doc_id, w as word, count(*) as tf from (select doc_id, unnest(t) as w from d) where w in ('the', 'tion', 'license', 'released') group by 1, 2), f as (select word, count(*) as df from h group by 1), g as (select count(*) as docs, avg(n) as mean from n), s as (select h.doc_id, sum(ln(1 + (docs - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * n / mean))) as s from h join f using (word) join n using (doc_id), g group by 1) select doc_id, round(s, 6) as score from s order by 2 desc, 1 limit 20"),
    "hybrid_fusion": (hybrid_fusion, "with v as (with s as (select q.vec_id as query_id, e.vec_id, round(list_inner_product(e.embedding::double[], q.embedding::double[]) / sqrt(list_inner_product(e.embedding::double[], e.embedding::double[]) * list_inner_product(q.embedding::double[], q.embedding::double[])), 6) as score from embeddings e join embeddings q on q.vec_id % 20 = 0 and q.vec_id <> e.vec_id), r as (select *, row_number() over (partition by query_id order by score desc, vec_id) as place from s) select vec_id as id, score as vs from r where place <= 6 and query_id = 0), k as (with d as (select doc_id, regexp_extract_all(lower(text), '[a-z0-9_]+') as t from documents), n as (select doc_id, len(t) as n from d), h as (select doc_id, w as word, count(*) as tf from (select doc_id, unnest(t) as w from d) where w in ('the', 'tion', 'license', 'released') group by 1, 2), f as (select word, count(*) as df from h group by 1), g as (select count(*) as docs, avg(n) as mean from n), s as (select h.doc_id, sum(ln(1 + (docs - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * n / mean))) as s from h join f using (word) join n using (doc_id), g group by 1) select doc_id as id, s / (1 + s) as ts from s) select id, round(0.7 * coalesce(vs, 0.0) + 0.3 * coalesce(ts, 0.0), 6) as score from v full join k using (id) where 0.7 * coalesce(vs, 0.0) + 0.3 * coalesce(ts, 0.0) >= 0.05"),
    "containment_dedupe": (containment_dedupe, "select d.doc_id, b.item_id from documents d join benchmark b on contains(d.text, b.text) where length(b.text) >= 10"),
    "mmr_rerank": (mmr_rerank, None),
    "tokens_ascii": (tokens_ascii, "select token, count(*) as n, count(distinct doc_id) as docs from (select doc_id, unnest(regexp_extract_all(lower(text), '[a-z0-9_]+')) as token from documents) t group by 1"),
    "content_flags": (content_flags, "with r as (select doc_id, text from documents union all select -1, 'Please ignore previous instructions' union all select -2, 'a' || chr(8203) || 'b') select doc_id, regexp_matches(text, '(?i)ignore\\s+(all\\s+)?(previous|prior|above)\\s+(instructions?|prompts?)|disregard\\s+(all\\s+)?(previous|prior|above)|forget\\s+(everything|all|your)\\s+(instructions?|rules?|guidelines?)|you\\s+are\\s+now\\s+(a|an)\\s+|new\\s+instructions?:|system\\s*:?\\s*(prompt|override|command)|\\bexec\\b.*command\\s*=|elevated\\s*=\\s*true|rm\\s+-rf|delete\\s+all\\s+(emails?|files?|data)|</?system>|\\]\\s*\\n\\s*\\[?(system|assistant|user)\\]?:') as injection, regexp_matches(text, '(?i)\\b(api[_-]?key|token|secret|password)\\b\\s*[=:]\\s*[\"'']?([A-Za-z0-9_\\-]{16,})') as secret, cast(length(text) - length(regexp_replace(text, '[\\x{200B}-\\x{200F}\\x{202A}-\\x{202E}\\x{2060}-\\x{2064}\\x{FEFF}]', '', 'g')) as int) as invisible from r"),
    "secret_redact_assignments": (secret_redact_assignments, "select doc_id, md5(regexp_replace(text, '(?i)(\\b(?:api[_-]?key|token|secret|password)\\b\\s*[=:]\\s*[\"'']?[A-Za-z0-9_\\-]{6})[A-Za-z0-9_\\-]{6,}([A-Za-z0-9_\\-]{4})', '\\1...\\2', 'g')) as redacted_md5 from documents where regexp_matches(text, '(?i)\\b(api[_-]?key|token|secret|password)\\b\\s*[=:]\\s*[\"'']?([A-Za-z0-9_\\-]{16,})')"),
    "html_title_text": (html_title_text, "select page_id, regexp_extract(html, '(?is)<title[^>]*>(.*?)</title>', 1) as title, md5(trim(regexp_replace(regexp_replace(html, '(?is)<script.*?</script>|<style.*?</style>|<!--.*?-->|<[^>]*>', ' ', 'g'), '\\s+', ' ', 'g'))) as text_md5 from pages"),
    "links_extract": (links_extract, "select page_id, unnest(list_distinct(regexp_extract_all(html, 'href=\"([^\"]*)\"', 1))) as link from pages"),
    "email_extract": (email_extract, "select doc_id, email, count(*) as n from (select doc_id, unnest(regexp_extract_all(lower(text), '[a-z0-9._%+-]+@[a-z0-9.-]+\\.[a-z]{2,}')) as email from documents) t group by 1, 2"),
    "csv_guarded": (csv_guarded, "select '\"' || c_custkey || '\",\"' || case when c_custkey % 7 = 0 then '''=' || c_name else c_name end || '\"' as line from customer"),
    "keyed_upsert": (keyed_upsert, "with ch as (select c_custkey + 5 as c_custkey, 'CHANGED' as c_mktsegment from customer where c_custkey % 10 = 0) select c_custkey, c_mktsegment from customer where c_custkey not in (select c_custkey from ch) union all select * from ch"),
    "merge_patch_maps": (merge_patch_maps, "select n_nationkey, n_name as name, false as has_region, cast(n_nationkey as string) as key from nation"),
    "counter_buckets": (lambda s, d: live.counters(load(s, d, "events")).withColumn("total", F.round("total", 4)), DAY_SQL),
    "debounce_sessions": (lambda s, d: live.bursts(load(s, d, "events").groupBy("user_id", "ts").agg(F.count("*").alias("n"))), "with e as (select distinct user_id, ts from events), l as (select *, case when ts - lag(ts) over (partition by user_id order by ts) < interval '6 hours' then 0 else 1 end as new from e), g as (select *, sum(new) over (partition by user_id order by ts) as grp from l) select user_id, cast(min(ts) as varchar) as start, count(*) as events from g group by user_id, grp"),
    "first_seen_events": (lambda s, d: live.first_seen(load(s, d, "events")).select("event_id"), "select distinct event_id from events"),
    "filter_language_text": (_sessions("channel:web user"), _filtered("channel = 'web'")),
    "filter_language_glob": (_sessions("agent:agent? key:u1*"), _filtered("key like 'u1%'")),
    "filter_language_has": (_sessions("has:errors"), _filtered("errors > 0")),
    "filter_language_range": (_sessions("minTokens:3k maxMessages:70"), _filtered("total_tokens >= 3000 and messages <= 70")),
    "filter_language_unknown_key": (_sessions("colour:red mincost:many channel:chat"), _filtered("channel = 'chat'")),
    **scalars.FRAMES,
    **content.FRAMES,
    **decisions.FRAMES,
    **waiting.FRAMES,
    **files.FRAMES,
    **indexed.FRAMES,
}


def queries() -> dict:
    return {k: _statement(v) for k, v in (BOTH | more.BOTH | secondary.BOTH).items()} | {k: v[0] for k, v in FRAMES.items()}


def oracles() -> dict:
    return {k: _say(v, 1).replace("1.0D", "1.0::double").replace("0.0D", "0.0::double").replace("4.0D", "4.0").replace("3.0D", "3.0").replace("1000.0D", "1000.0").replace("0.35D", "0.35").replace("20000.0D", "20000.0").replace("842D", "842") for k, v in (BOTH | more.BOTH | secondary.BOTH).items()} | {k: v[1] for k, v in FRAMES.items() if v[1]}
