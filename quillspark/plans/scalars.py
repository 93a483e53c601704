"""Queries over the scalar functions: strings, session keys, times, numbers, geometry. Each has an oracle."""

from __future__ import annotations

from pyspark.sql import functions as F

from quillspark.functions import numbers as N
from quillspark.functions import strings as S
from quillspark.sources.tables import load

C = F.col
#: Session keys of every shape; both engines read the expression.
KEY = """case event_id % 9 when 0 then concat('agent:a', user_id % 5, ':chat:group:', user_id) when 1 then concat('agent:a', user_id % 5, ':main')
 when 2 then concat('agent:a:cron:j', user_id, ':run:r', event_id % 7) when 3 then concat('agent:a:subagent:x:subagent:y', user_id)
 when 4 then concat(' discord:acc:guild-', user_id, ':channel-9') when 5 then concat('agent::', user_id) when 6 then concat('slack:dm:', user_id, ':thread:t:topic:', event_id)
 when 7 then 'ACP:x' else '' end"""


def session_key_parse(spark, sf_dir):
    k = C("k")
    return load(spark, sf_dir, "events").selectExpr("event_id", f"{KEY} as k").select(
        "event_id", S.key_agent(k).alias("agent"), S.key_rest(k).alias("rest"), S.key_shape(k).alias("shape"), S.chat_type(k).alias("chat"), S.is_cron(k).alias("cron"),
        S.is_cron_run(k).alias("cron_run"), S.is_subagent(k).alias("subagent"), S.is_acp(k).alias("acp"), S.subagent_depth(k).alias("depth"), S.thread_parent(k).alias("parent"))


KEY_SQL = rf"""with a as (select event_id, trim({KEY}) as k from events), b as (select *, list_filter(string_split(k, ':'), lambda p: p <> '') as p from a),
c as (select *, case when len(p) >= 3 and p[1] = 'agent' then array_to_string(p[3:], ':') end as rest from b), d as (select *, lower(coalesce(rest, k)) as s, lower(coalesce(rest, '')) as r from c)
select event_id, case when rest is not null then p[2] end as agent, rest, case when k = '' then 'missing' when rest is not null then 'agent' when lower(k) like 'agent:%' then 'malformed_agent' else 'legacy_or_alias' end as shape,
 case when list_contains(string_split(s, ':'), 'group') then 'group' when list_contains(string_split(s, ':'), 'channel') then 'channel' when list_contains(string_split(s, ':'), 'direct') or list_contains(string_split(s, ':'), 'dm') then 'direct'
  when regexp_full_match(s, 'discord:(?:[^:]+:)?guild-[^:]+:channel-[^:]+') then 'channel' else 'unknown' end as chat,
 r like 'cron:%' as cron, regexp_full_match(coalesce(rest, ''), 'cron:[^:]+:run:[^:]+') as cron_run, r like 'subagent:%' or lower(k) like 'subagent:%' as subagent, r like 'acp:%' or lower(k) like 'acp:%' as acp,
 cast(len(string_split(lower(k), ':subagent:')) - 1 as int) as depth, nullif(regexp_extract(k, '(?i)^(.+):(?:thread|topic):', 1), '') as parent from d"""


def peer_keys(spark, sf_dir):
    scope = F.element_at(F.array(*map(F.lit, ("main", "per-peer", "per-channel-peer", "per-account-channel-peer"))), (C("event_id") % 4 + 1).cast("int"))
    d = load(spark, sf_dir, "events").withColumn("kind", F.when(C("user_id") % 5 == 0, F.lit("group")))
    return d.select("event_id", S.peer_key(F.concat(F.lit(" Agent "), C("user_id") % 3), C("event_type"), F.concat(F.lit("P"), C("user_id")), C("kind"), scope, F.lit("Acc 1")).alias("key"))


PEER_SQL = """with e as (select event_id, event_type as c, 'agent:agent-' || (user_id % 3) as h, 'p' || user_id as p, user_id % 5 = 0 as g from events)
select event_id, case when g then h || ':' || c || ':group:' || p when event_id % 4 = 0 then h || ':main' when event_id % 4 = 1 then h || ':direct:' || p when event_id % 4 = 2 then h || ':' || c || ':direct:' || p
 else h || ':' || c || ':acc-1:direct:' || p end as key from e"""
KIND_KEY = "case event_id % 6 when 0 then 'main' when 1 then 'cron:x' when 2 then 'hook:y' when 3 then concat('node-', user_id) when 4 then concat('slack:channel:', user_id) else concat('web:', user_id) end"


def session_kinds(spark, sf_dir):
    d = load(spark, sf_dir, "events").selectExpr("event_id", f"{KIND_KEY} as k", "case when user_id % 4 = 0 then ' web ' end as c", "case when user_id % 3 = 0 then 'group' end as g")
    d = d.withColumn("kind", S.session_kind(C("k"), C("g")))
    return d.select("event_id", "kind", S.session_channel(C("k"), C("kind"), C("c"), F.lit(None).cast("string")).alias("channel"))


KIND_SQL = f"""with e as (select event_id, {KIND_KEY} as k, user_id % 4 = 0 as web, user_id % 3 = 0 as g from events),
f as (select *, case when k = 'main' then 'main' when k like 'cron:%' then 'cron' when k like 'hook:%' then 'hook' when k like 'node-%' then 'node' when g or k like '%:channel:%' then 'group' else 'other' end as kind from e)
select event_id, kind, case when kind in ('cron', 'hook', 'node') then 'internal' when web then 'web' when k like 'slack:channel:%' then 'slack' else 'unknown' end as channel from f"""


def slugs(spark, sf_dir):
    t = F.concat(F.lit("  #"), C("p_name"), F.lit(" !_"), C("p_type"), F.lit("--"))
    return load(spark, sf_dir, "part").select("p_partkey", S.hyphen_slug(t).alias("hyphen"), S.at_hash_slug(t).alias("at_hash"), S.channel_slug(t).alias("channel"), S.node_key(t).alias("node"), S.agent_id(t).alias("agent"))


SLUG_SQL = r"""with t as (select p_partkey, trim(lower('  #' || p_name || ' !_' || p_type || '--')) as t from part)
select p_partkey, regexp_replace(regexp_replace(regexp_replace(regexp_replace(t, '\s+', '-', 'g'), '[^a-z0-9#@._+-]+', '-', 'g'), '-{2,}', '-', 'g'), '^[-.]+|[-.]+$', '', 'g') as hyphen,
 regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(t, '^[@#]+', ''), '[\s_]+', '-', 'g'), '[^a-z0-9-]+', '-', 'g'), '-{2,}', '-', 'g'), '^-+|-+$', '', 'g') as at_hash,
 regexp_replace(regexp_replace(regexp_replace(t, '^#', ''), '[^a-z0-9]+', '-', 'g'), '^-+|-+$', '', 'g') as channel, regexp_replace(regexp_replace(t, '[^a-z0-9]+', '-', 'g'), '^-+|-+$', '', 'g') as node,
 substr(regexp_replace(regexp_replace(t, '[^a-z0-9_-]+', '-', 'g'), '^-+|-+$', '', 'g'), 1, 64) as agent from t"""


def masks_and_cuts(spark, sf_dir):
    t = F.coalesce("text", F.lit(""))
    id_ = F.when(C("doc_id") % 5 == 0, F.lit("  ")).otherwise(C("source"))
    short = F.left(F.md5(t), (C("doc_id") % 30).cast("int"))
    return load(spark, sf_dir, "documents").select(
        "doc_id", S.digest(t).alias("hash"), S.redact_identifier(id_).alias("id"), S.mask_token(short).alias("token"), S.mask_api_key(F.md5(t)).alias("api_key"),
        F.md5(S.csv_escape(t)).alias("cell"), F.md5(S.one_line(t)).alias("line"), F.md5(S.unicode_query(t)).alias("query"))


MASK_SQL = rf"""with d as (select doc_id, text, text as t, substr(md5(text), 1, cast(doc_id % 30 as int)) as s, case when doc_id % 5 = 0 then '' else source end as i from (select doc_id, source, coalesce(text, '') as text from documents))
select doc_id, sha256(text) as hash, case when i = '' then '-' else 'sha256:' || substr(sha256(i), 1, 12) end as id, case when length(s) < 18 then '***' else substr(s, 1, 6) || '…' || right(s, 4) end as token,
 substr(md5(t), 1, 8) || '...' || right(md5(t), 8) as api_key, md5(case when regexp_matches(t, '[",\n]') then '"' || replace(t, '"', '""') || '"' else t end) as cell,
 md5(trim(regexp_replace(text, '\s+', ' ', 'g'))) as line,
 md5(nullif(array_to_string(list_transform(regexp_extract_all(text, '[\p{{L}}\p{{N}}_]+'), lambda w: '"' || w || '"'), ' AND '), '')) as query from d"""


def envelopes_and_markdown(spark, sf_dir):
    c = load(spark, sf_dir, "conversations")
    head = F.when(C("turn") % 3 == 0, F.lit("[Telegram bot 12] ")).when(C("turn") % 3 == 1, F.lit("[2024-01-05 10:30 UTC]  ")).otherwise(F.lit("[note] "))
    noted = F.concat(C("role"), F.lit("\n [message_id: 7 ] \nend"))
    md = F.concat(F.lit("## "), C("role"), F.lit("\n* [link](http://a.b) `code` ![i](x)\n1. "), C("role"), F.lit("  \n\n\n\n```py\nx\n```"))
    return c.select("conv_id", "turn", F.md5(S.strip_envelope(F.concat(head, F.coalesce("text", F.lit(""))))).alias("body"), S.strip_message_ids(noted).alias("noted"), S.markdown_text(md).alias("plain"),
                    S.citation(F.lit("a.md"), C("turn"), C("turn") + C("conv_id") % 2).alias("cite"))


ENVELOPE_SQL = r"""select conv_id, turn, md5(case when turn % 3 = 2 then '[note] ' || coalesce(text, '') else regexp_replace(coalesce(text, ''), '^\s+', '') end) as body, role || chr(10) || 'end' as noted,
 role || chr(10) || 'link code' || chr(10) || role || chr(10) || chr(10) || 'x' as plain, 'a.md#L' || turn || case when conv_id % 2 = 1 then '-L' || (turn + 1) else '' end as cite from conversations"""


def record_keys(spark, sf_dir):
    c = load(spark, sf_dir, "customer")
    n = C("c_custkey")
    case = lambda k, v: F.when(n % 6 == k, v)
    return c.select(
        "c_custkey", S.record_key(case(0, F.concat(F.lit("x!1s0xAB"), n, F.lit(":0x1"))), case(1, F.concat(F.lit("+91 98765 "), F.lpad(n.cast("string"), 5, "0"))), case(2, F.concat(F.lit("7000000000000"), F.lpad(n.cast("string"), 6, "0"))),
                                  case(3, F.concat(F.lit("https://linkedin.com/in/Ann%20"), n, F.lit("/?x"))), F.when(n % 6 >= 4, C("c_name")), case(4, C("c_mktsegment"))).alias("key"),
        S.looks_like_phone(F.concat(F.lit("call +44 (20) 7946-0"), n % 10)).alias("phone"), S.rating(F.concat(F.lit("4,"), n % 10, F.lit(" stars 1,2"), n, F.lit(" Reviews"))).alias("r")).select("c_custkey", "key", "phone", "r.*")


RECORD_SQL = r"""select c_custkey, case c_custkey % 6 when 0 then 'fid:0xab' || c_custkey || ':0x1' when 1 then 'tel:98765' || lpad(c_custkey::varchar, 5, '0') when 2 then 'post:7000000000000' || lpad(c_custkey::varchar, 6, '0')
 when 3 then 'li:ann ' || c_custkey when 4 then 'name:' || regexp_replace(lower(c_name), '[^a-z0-9]+', '', 'g') || '@' || lower(c_mktsegment) else 'name:' || regexp_replace(lower(c_name), '[^a-z0-9]+', '', 'g') end as key,
 true as phone, '4.' || (c_custkey % 10) as rating, '12' || c_custkey as reviews from customer"""


def urls_and_batches(spark, sf_dir):
    p = load(spark, sf_dir, "pages")
    bare = F.regexp_replace("url", "^https?://", "")
    ask = F.concat(F.lit("https://s.x/?trk=1&q="), C("page_id"), F.lit("&Geo=B&sid=2&a=Z#f"))
    row = S.category_city(F.when(C("page_id") % 3 == 0, F.lit(" gyms, Ulm, Bavaria ")).when(C("page_id") % 3 == 1, F.lit("gyms in Ulm")).otherwise(F.lit("# none")))
    return p.select("page_id", S.clean_url(bare).alias("url"), S.query_identity(ask).alias("ask"), S.social_links(F.lit('<a href="https://x.com/share?u=1"><a href="https://x.com/ann/?s=1">'))["twitter"].alias("twitter"), row.alias("r")).select("page_id", "url", "ask", "twitter", "r.*")


URL_SQL = r"""select page_id, case when regexp_full_match('https://' || regexp_replace(url, '^https?://', ''), '(?i)https?://[^\s/?#:]+(:\d+)?([/?#]\S*)?') and url <> '' then 'https://' || regexp_replace(url, '^https?://', '') else '' end as url,
 'search:Geo=b&a=z&q=' || page_id as ask, 'https://x.com/ann' as twitter, case page_id % 3 when 2 then null else 'gyms' end as category, case page_id % 3 when 0 then 'Ulm, Bavaria' when 1 then 'Ulm' end as city from pages"""


def number_formats(spark, sf_dir):
    v, ms = F.pow(F.lit(10.0), C("event_id") % 8) * (C("user_id") % 9), C("event_id") * 7_777_777 % 900_000_000
    return load(spark, sf_dir, "events").select("event_id", N.token_count(v).alias("tokens"), N.token_short(v).alias("short"), N.usd(C("value") / 1000.7).alias("usd"), N.duration_compact(ms).alias("took"),
                                                 N.clamp_percent(C("value") - 20).alias("percent"), N.percent_used(C("value"), F.lit(7.0)).alias("used"))


FORMAT_SQL = """with e as (select event_id, pow(10.0, event_id % 8) * (user_id % 9) as v, event_id * 7777777 % 900000000 as ms, value, value / 1000.7::double as c from events),
m as (select *, greatest(1, cast(floor(ms / 60000 + 0.5) as bigint)) as n, cast(floor(v) as bigint) as f from e)
select event_id, case when v >= 1e6 then printf('%.1fm', v / 1e6) when v >= 1e4 then printf('%.0fk', v / 1e3) when v >= 1e3 then printf('%.1fk', v / 1e3) else cast(cast(floor(v + 0.5) as bigint) as varchar) end as tokens,
 case when v <= 0 then null when f < 1000 then cast(f as varchar) when f < 10000 then printf('%.1fk', f / 1e3) when f < 1000000 then cast(cast(floor(f / 1e3 + 0.5) as bigint) as varchar) || 'k' else printf('%.1fm', f / 1e6) end as short,
 case when c >= 0.01 then printf('$%.2f', c) else printf('$%.4f', c) end as usd,
 case when ms <= 0 then 'n/a' when n < 60 then n || 'm' when n < 1440 then (n // 60) || 'h' || case when n % 60 > 0 then (n % 60) || 'm' else '' end else (n // 1440) || 'd' || case when n // 60 % 24 > 0 then (n // 60 % 24) || 'h' else '' end end as took,
 greatest(0.0, least(100.0, value - 20)) as percent, least(999, cast(floor(value / 7.0 * 100 + 0.5) as bigint)) as used from m"""


def durations_and_offsets(spark, sf_dir):
    k = C("event_id")
    text = F.when(k % 4 == 0, F.concat(k, F.lit("ms"))).when(k % 4 == 1, F.concat(k % 50, F.lit(".5h"))).when(k % 4 == 2, F.concat(k % 9, F.lit("H30m1s"))).otherwise(F.lit("1h x"))
    offset = F.concat(F.lit("UTC-"), k % 16, F.lit(":"), F.lpad((k % 70).cast("string"), 2, "0"))
    cron = F.when(k % 3 == 0, F.lit("0 * * * *")).when(k % 3 == 1, F.lit("0 0 */2 * * *")).otherwise(F.lit("5 * * * *"))
    return load(spark, sf_dir, "events").select("event_id", N.duration_ms(text).alias("ms"), N.offset_minutes(offset).alias("offset"), N.offset_text((k % 1681 - 840).cast("int")).alias("offset_text"), N.stagger_ms(cron).alias("stagger"),
                                                 N.next_run_ms(k * 10, C("user_id"), F.lit(20_000)).alias("next_run"), N.delivery_wait_ms((k % 7).cast("int")).alias("wait"), N.backoff_ms(k % 9, 100, 2, 5000).alias("backoff"))


DURATION_SQL = """select event_id, case event_id % 4 when 0 then event_id when 1 then (event_id % 50) * 3600000 + 1800000 when 2 then (event_id % 9) * 3600000 + 1801000 end as ms,
 cast(case when event_id % 70 < 60 and event_id % 16 * 60 + event_id % 70 <= 840 then -(event_id % 16 * 60 + event_id % 70) end as int) as "offset",
 'UTC' || case when event_id % 1681 < 840 then '-' else '+' end || (abs(event_id % 1681 - 840) // 60) || case when abs(event_id % 1681 - 840) % 60 > 0 then ':' || lpad((abs(event_id % 1681 - 840) % 60)::varchar, 2, '0') else '' end as offset_text,
 case when event_id % 3 < 2 then 300000 end as stagger,
 case when event_id * 10 > 20000 then event_id * 10 else event_id * 10 + greatest(1, user_id) * greatest(1, cast(ceil((20000 - event_id * 10) / greatest(1, user_id)) as bigint)) end as next_run,
 case event_id % 7 when 0 then 0 when 1 then 5000 when 2 then 25000 when 3 then 120000 else 600000 end as wait, least(5000.0, 100.0 * pow(2.0, greatest(event_id % 9 - 1, 0))) as backoff from events"""


def times_from_text(spark, sf_dir):
    k, day = C("o_orderkey"), F.date_format("o_orderdate", "yyyy-MM-dd")
    text = F.when(k % 4 == 0, day).when(k % 4 == 1, F.concat(day, F.lit("T06:30:00"))).when(k % 4 == 2, F.concat(day, F.lit("T06:30:00+02:00"))).otherwise(k.cast("string"))
    path = F.when(k % 5 == 0, F.lit("x/memory/2024-02-31.md")).otherwise(F.concat(F.lit("memory/"), day, F.lit(".md")))
    return load(spark, sf_dir, "orders").select("o_orderkey", N.absolute_ms(text).alias("ms"), N.path_date(path).cast("string").alias("day"), N.id_time(F.shiftleft(k + 1_500_000_000_000, 22)).alias("posted"),
                                                 F.date_format(N.daily_reset(C("o_orderdate").cast("timestamp") + F.make_interval(hours=(k % 24).cast("int"))), "yyyy-MM-dd HH:mm:ss").alias("reset"))


TIME_SQL = """with o as (select o_orderkey as k, o_orderdate as d, strftime(o_orderdate, '%Y-%m-%d') as day from orders)
select k as o_orderkey, case k % 4 when 0 then epoch_ms(date_trunc('day', d)) when 1 then epoch_ms(date_trunc('day', d)) + 23400000 when 2 then epoch_ms(date_trunc('day', d)) + 16200000 else k end as ms,
 case when k % 5 <> 0 then day end as day, k + 1500000000000 as posted, strftime(date_trunc('day', d + to_hours(cast(k % 24 as int)) - interval 4 hours) + interval 4 hours, '%Y-%m-%d %H:%M:%S') as reset from o"""


def usage_records(spark, sf_dir):
    k = C("event_id")
    n = k % 1000
    record = F.when(k % 4 == 0, F.format_string('{"inputTokens": %d, "output_tokens": 5}', n)).when(k % 4 == 1, F.format_string('{"prompt_tokens": 7, "prompt_tokens_details": {"cached_tokens": %d}}', n)).when(
        k % 4 == 2, F.format_string('{"totalTokens": %d}', n)).otherwise(F.lit("{}"))
    d = load(spark, sf_dir, "events").select("event_id", N.usage(record).alias("u"))
    rates = F.struct(F.lit(3.0).alias("input"), F.lit(15.0).alias("output"), F.lit(0.3).alias("cache_read"), F.lit(3.75).alias("cache_write"))
    return d.select("event_id", "u.*", N.prompt_tokens(C("u")).alias("prompt"), N.session_tokens(C("u")).alias("tokens"), F.round(N.cost(C("u"), rates), 9).alias("cost"))


USAGE_SQL = """with e as (select event_id, cast(event_id % 1000 as double) as n, event_id % 4 as m from events),
u as (select event_id, case m when 0 then n when 1 then 7.0::double end as input, case m when 0 then 5.0::double end as output, case m when 1 then n end as cache_read, cast(null as double) as cache_write, case m when 2 then n end as total from e)
select *, nullif(coalesce(input, 0) + coalesce(cache_read, 0), 0) as prompt, nullif(coalesce(nullif(coalesce(input, 0) + coalesce(cache_read, 0), 0), total, input), 0) as tokens,
 round((coalesce(input, 0) * 3.0::double + coalesce(output, 0) * 15.0::double + coalesce(cache_read, 0) * 0.3::double) / 1000000.0::double, 9) as cost from u"""


def unit_vectors(spark, sf_dir):
    v = N.unit_vector(C("embedding"))
    return load(spark, sf_dir, "embeddings").select("vec_id", F.round(F.get(v, F.lit(0)), 6).alias("first"), F.round(F.aggregate(v, F.lit(0.0), lambda s, x: s + x), 5).alias("total"))


UNIT_SQL = """with e as (select vec_id, embedding::double[] as v from embeddings), n as (select vec_id, v, sqrt(list_inner_product(v, v)) as n from e)
select vec_id, round(v[1] / n, 6) as first, round(list_sum(list_transform(v, lambda x: x / n)), 5) as total from n"""


def word_jaccard_with_next(spark, sf_dir):
    words = F.array_distinct(F.filter(F.split(F.lower(F.coalesce("text", F.lit(""))), " "), lambda w: w != ""))
    c = load(spark, sf_dir, "conversations").groupBy("conv_id", "turn").agg(F.min("text").alias("text")).select("conv_id", "turn", words.alias("w"))
    after = c.select("conv_id", (C("turn") - 1).alias("turn"), C("w").alias("w2"))
    return c.join(after, ["conv_id", "turn"]).select("conv_id", "turn", F.round(N.jaccard(C("w"), C("w2")), 6).alias("similarity"))


JACCARD_SQL = """with c as (select conv_id, turn, list_distinct(list_filter(string_split(lower(coalesce(min(text), '')), ' '), lambda w: w <> '')) as w from conversations group by 1, 2)
select a.conv_id, a.turn, round(case when len(a.w) + len(b.w) = 0 then 1.0 else len(list_intersect(a.w, b.w)) / (len(a.w) + len(b.w) - len(list_intersect(a.w, b.w))) end, 6) as similarity from c a join c b on a.conv_id = b.conv_id and b.turn = a.turn + 1"""


def map_grid(spark, sf_dir):
    centres = load(spark, sf_dir, "nation").select("n_nationkey", (C("n_nationkey") * 5.0 - 60).alias("lat"), (C("n_nationkey") * 3.0).alias("lng"), (C("n_nationkey") * 5.0 - 60).alias("lat0"), (C("n_nationkey") * 3.0).alias("lng0"))
    g = N.grid(centres, 3, 9000.0)
    return g.select("n_nationkey", "row", "col", F.round("lat", 7).alias("lat"), F.round("lng", 7).alias("lng"), F.round(N.distance(C("lat0"), C("lng0"), C("lat"), C("lng")), 3).alias("metres"),
                    F.round(N.metres_per_pixel(C("lat0"), F.lit(12.0)), 6).alias("mpp"), N.zoom_for_span(C("lat0"), F.lit(3000.0), 1200).alias("zoom"))


GRID_SQL = """with c as (select n_nationkey, n_nationkey * 5.0::double - 60 as lat0, n_nationkey * 3.0::double as lng0 from nation), g as (select *, r.r as "row", k.k as col, (r.r - 1) * 3000.0::double as n, (k.k - 1) * 3000.0::double as e from c, range(3) r(r), range(3) k(k)),
p as (select *, lat0 + degrees(n / 6378137.0::double) as lat, lng0 + degrees(e / (6378137.0::double * cos(radians(lat0)))) as lng from g)
select n_nationkey, cast("row" as int) as "row", cast(col as int) as col, round(lat, 7) as lat, round(lng, 7) as lng,
 round(2 * 6378137.0::double * asin(least(1.0, sqrt(pow(sin(radians(lat - lat0) / 2), 2) + cos(radians(lat0)) * cos(radians(lat)) * pow(sin(radians(lng - lng0) / 2), 2)))), 3) as metres,
 round(156543.03392804097::double * cos(radians(lat0)) / 4096, 6) as mpp, floor(greatest(3.0, least(17.0, log2(156543.03392804097::double * cos(radians(lat0)) / 2.5))) * 10 + 0.5) / 10 as zoom from p"""

FRAMES = {
    "session_key_parse": (session_key_parse, KEY_SQL), "peer_keys": (peer_keys, PEER_SQL), "session_kinds": (session_kinds, KIND_SQL), "slugs": (slugs, SLUG_SQL), "masks_and_cuts": (masks_and_cuts, MASK_SQL),
    "envelopes_and_markdown": (envelopes_and_markdown, ENVELOPE_SQL), "record_keys": (record_keys, RECORD_SQL), "urls_and_batches": (urls_and_batches, URL_SQL), "number_formats": (number_formats, FORMAT_SQL),
    "durations_and_offsets": (durations_and_offsets, DURATION_SQL), "times_from_text": (times_from_text, TIME_SQL), "usage_records": (usage_records, USAGE_SQL), "unit_vectors": (unit_vectors, UNIT_SQL),
    "word_jaccard_with_next": (word_jaccard_with_next, JACCARD_SQL), "map_grid": (map_grid, GRID_SQL),
}
