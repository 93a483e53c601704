"""Statements of the secondary operators that Spark and the oracle both read; ``catalogue`` registers them."""

BOTH = {
    # Pages of a log, keyed reads, names without regard to case
    "run_log_page": "select event_id, user_id, event_type from events where event_type in ('purchase', 'click') and props like '%1%' order by ts desc, event_id limit 40 offset 20",
    "keyed_range_read": "select o_custkey, count(*) as records, min(o_orderkey) as first_key, max(o_orderkey) as last_key from orders where o_custkey between 10 and 400 group by 1",
    "names_folded": "select lower(n_name) as folded, min(n_name) as name, count(*) as spellings from (select n_name from nation union all select upper(r_name) from region union all select r_name from region) x group by 1",
    # Rows with defaults, usage sheets, delete then insert
    "rows_with_defaults": "select d.doc_id, coalesce(cast(l.quality as string), '') as quality, coalesce(l.toxic, 0) as toxic, coalesce(d.lang, 'und') as lang from documents d left join labels l on d.doc_id = l.doc_id",
    "session_sheet": "select user_id, min(cast(ts as string)) as first_at, count(*) as messages, sum(case when event_type = 'error' then 1 else 0 end) as errors, cast(sum(@K) as bigint) as tokens, round(sum(value), 4) as cost from events group by 1",
    "reindex_rows": "select vec_id, label from embeddings where vec_id not in (select doc_id from documents where doc_id % 3 = 0) union all select doc_id, -1 from documents where doc_id % 3 = 0",
    # F07, F15, F21, F27, F29, C14
    "value_suggestions": "select lang, source, place from (select lang, source, row_number() over (partition by lang order by source) as place from (select distinct lang, source from documents where source is not null) d) r where place <= 6",
    "score_threshold": "select doc_id, score from (select doc_id, round(n_chars / 20000.0D, 6) as score from documents where source <> 'src3') s where score >= 0.35D order by score desc, doc_id limit 6",
    "set_aside_reasons": "select doc_id, case when lang is null then 'no language' when n_chars < 200 then 'short' when copy > 1 then 'copy' when doc_id % 365 > 300 then 'old' else 'kept' end as reason from (select doc_id, lang, n_chars, row_number() over (partition by md5(text) order by doc_id) as copy from documents) d",
    # J12, J13, J14
    "select_exactly_one": "with a as (select 1 as ask, 'web' as label union all select 2, 'en' union all select 3, 'none') select ask, count(doc_id) as found, case when count(doc_id) = 1 then 'ok' when count(doc_id) = 0 then 'missing' else 'ambiguous' end as status, case when count(doc_id) = 1 then min(doc_id) end as doc_id from a left join documents on lang = label group by 1",
    "drop_orphan_results": "select a.conv_id, a.turn from conversations a where a.role <> 'assistant' or exists (select 1 from conversations b where b.conv_id = a.conv_id and b.turn = a.turn - 1 and b.role = 'user')",
    # A03, A06, A22, A26
    "daily_cost_of_model": "select cast(cast(l_shipdate as date) as string) as day, l_returnflag as model, round(sum(l_extendedprice), 2) as cost, count(*) as runs from lineitem group by 1, 2",
    "eleven_measures": "select l_linestatus, cast(sum(l_quantity) as bigint) as tokens, round(sum(l_extendedprice), 2) as cost, round(sum(l_extendedprice * l_tax), 2) as tax, round(sum(l_extendedprice * l_discount), 2) as discount, min(l_quantity) as lo, max(l_quantity) as hi, round(avg(l_quantity), 6) as mean, count(*) as n, count(distinct l_suppkey) as suppliers, sum(case when l_discount = 0 then 1 else 0 end) as undiscounted from lineitem group by 1",
    # Histories of the most recent keys
    # U02, U04, U06, U07, R01, R03, R04
    "bounded_union": "select k from (select k, min(seq) as first from (select o_custkey as k, o_orderkey as seq from orders union all select c_custkey, c_custkey + 1000000 from customer) a group by 1) b order by first desc, k desc limit 900",
    "suggestions_not_observed": "select distinct lower(p_type) as name, 'observed' as origin from part where p_size > 40 union all select distinct lower(p_type), 'standard' from part a where not exists (select 1 from part b where b.p_size > 40 and lower(b.p_type) = lower(a.p_type))",
    "task_grid": "select a.r_regionkey as region, b.n_nationkey as nation, row_number() over (order by a.r_regionkey, b.n_nationkey) as seq, (a.r_regionkey = b.n_regionkey) as done from region a join nation b on b.n_nationkey % 5 <= a.r_regionkey",
    # Y01 to Y22
    "oldest_newest": "select event_type, count(*) as n, min(cast(ts as string)) as oldest, max(cast(ts as string)) as newest from events group by 1",
    "scored_resolution": "with m as (select c_nationkey, c_custkey, (case when c_acctbal > 0 then 3 else 0 end) + (case when c_mktsegment <> 'BUILDING' then 2 else 0 end) + (case when c_custkey % 5 = 0 then 5 else 0 end) as score from customer), r as (select *, row_number() over (partition by c_nationkey order by score desc, c_custkey) as rn, count(*) over (partition by c_nationkey) as n from m) select c_nationkey, c_custkey, score, n > 1 as ambiguous from r where rn = 1",
    "last_vote_wins": "select user_id, vote from (select user_id, cast(@K % 5 as int) as vote, row_number() over (partition by user_id order by ts desc, event_id desc) as rn from events where @K % 5 < 4) r where rn = 1",
    "scan_order": "select p_partkey, p_size from part order by case when p_size > 30 then 0 else 1 end, case when p_retailprice > 900 then p_retailprice end nulls last, p_size desc, p_partkey limit 100",
    "ordinals": "select conv_id, turn, role, case when n > 1 then concat(role, ' ', cast(i as string), '/', cast(n as string)) else role end as label from (select conv_id, turn, role, row_number() over (partition by conv_id, role order by turn) as i, count(*) over (partition by conv_id, role) as n from (select distinct conv_id, turn, role from conversations) d) r",
    "recent_recipients": "with r as (select user_id, event_id, row_number() over (partition by user_id order by ts desc, event_id desc) as rn from events where event_type <> 'view') select user_id, event_id from r where rn = 1 and user_id in (select c_custkey from customer where c_acctbal > 0)",
    "history_oldest_first": "select conv_id, turn, role from conversations where trim(coalesce(text, '')) <> '' order by conv_id, turn, role, text limit 100",
    "every_nth_anomaly": "select event_id, n from (select event_id, row_number() over (partition by user_id, event_type order by ts, event_id) as n from events where value < 20) r where n % 5 = 1",
    "size_estimate": "select conv_id, cast(sum(case role when 'user' then length(coalesce(text, '')) when 'assistant' then length(coalesce(text, '')) + 16 else 256 end) as bigint) as chars from conversations group by 1",
    # G12, G14 as batch: runs of equal events
    "repeat_runs": "with l as (select event_id, user_id, event_type, ts, row_number() over (partition by user_id order by ts, event_id) - row_number() over (partition by user_id, event_type order by ts, event_id) as run from events), r as (select user_id, event_type, run, count(*) as n, min(event_id) as first_event from l group by 1, 2, 3) select user_id, event_type, n, first_event, case when n >= 4 then 'block' when n >= 3 then 'warn' else 'ok' end as verdict from r",
    "ping_pong": "with l as (select event_id, user_id, event_type as a, lag(event_type, 1) over w as b, lag(event_type, 2) over w as c, lag(event_type, 3) over w as d from events window w as (partition by user_id order by ts, event_id)) select event_id, user_id from l where a = c and b = d and a <> b",
    "stuck_sessions": "with l as (select user_id, event_type, ts, row_number() over (partition by user_id order by ts desc, event_id desc) as rn from events) select user_id, (event_type = 'click' and ts < timestamp '2024-01-30 12:00:00') as stuck from l where rn = 1",
    "reaper": "select user_id, max(cast(ts as string)) as last_at from events group by 1 having max(ts) < timestamp '2024-01-30 00:00:00'",
    "reindex_triggers": "select source, cast(floor(sum(n_chars) / 100000) as int) as by_size, cast(floor(count(*) / 50) as int) as by_count from documents group by 1",
    "debounce_precedence": "select event_id, coalesce(case when user_id % 7 = 0 then 50 end, case when event_type = 'view' then 200 end, case when user_id % 2 = 0 then 100 end, 0) as wait from events",
    # Preferred candidates, merged presence
    "preferred_candidate": "select c_nationkey, c_custkey from (select c_nationkey, c_custkey, row_number() over (partition by c_nationkey order by case when c_acctbal >= 0 then 0 else 1 end, case when c_mktsegment = 'BUILDING' then 1 else 0 end, c_custkey) as rn from customer) r where rn = 1",
    "presence_changes": "with e as (select event_id, user_id, event_type, lag(event_type) over w as before, lag(event_id) over w as prior from events window w as (partition by user_id order by ts, event_id)) select event_id, user_id, case when prior is null then 'new' when before <> event_type then 'changed' else 'same' end as change from e",
}
