"""Further statements that Spark and the oracle both read; ``catalogue`` registers them."""

BOTH = {
    # Totals by channel, daily latency, active totals, bound accounts
    "channel_totals": "select user_id % 7 as channel, count(*) as calls, round(sum(value), 4) as cost, row_number() over (order by sum(value) desc, user_id % 7) as place from events group by 1",
    "daily_latency_tail": "select @DAY as day, event_type, count(*) as n, round(min(value), 6) as lo, round(max(value), 6) as hi, round(avg(value), 6) as mean from events group by 1, 2",
    "bound_accounts": "select p_brand, count(distinct l_suppkey) as suppliers, min(l_suppkey) as first_supplier from lineitem join part on l_partkey = p_partkey group by 1",
    # Tool calls, errors, session counts
    "role_counts_per_conversation": "select conv_id, count(*) as messages, sum(case when role = 'user' then 1 else 0 end) as users, sum(case when role = 'assistant' then 1 else 0 end) as assistants, count(distinct role) as roles, min(turn) as first_turn, max(turn) as last_turn from conversations group by 1",
    "error_share_by_user": "select user_id, count(*) as calls, sum(case when event_type = 'error' then 1 else 0 end) as errors, round(sum(case when event_type = 'error' then 1.0D else 0.0D end) / count(*), 6) as share from events group by 1",
    # A16 fill-first, A17, A24, A25, A30
    "entity_merge_fill_first": "with r as (select lower(source) as entity, doc_id, lang, n_chars from documents), f as (select entity, min(doc_id) as first_id, max(n_chars) as longest, count(*) as rows_merged from r group by 1) select f.entity, f.first_id, r.lang as first_lang, f.longest, f.rows_merged from f join r on f.first_id = r.doc_id",
    "min_context_per_model": "select p_brand, min(p_size) as context, count(distinct p_size) as sizes from part group by 1",
    "max_quota_per_provider": "select n_name, c_acctbal from (select n_name, round(c_acctbal, 2) as c_acctbal, row_number() over (partition by n_name order by c_acctbal desc, c_custkey) as rn from customer join nation on c_nationkey = n_nationkey) r where rn = 1",
    # F10, F12, F14, F18 to F25, F28
    "last_days_by_day_key": "select event_id from events where cast(ts as date) >= (select max(cast(ts as date)) - interval '6' day from events)",
    # J01, J06, J11 to J14, J17, J18
    "vector_chunk_join": "select e.vec_id, e.label, d.source, d.n_chars from embeddings e join documents d on e.vec_id = d.doc_id",
    "label_lookup": "select d.doc_id, l.quality from documents d left join labels l on d.doc_id = l.doc_id",
    "orphan_replies": "select c.conv_id, c.turn from conversations c where c.role = 'assistant' and not exists (select 1 from conversations p where p.conv_id = c.conv_id and p.turn = c.turn - 1 and p.role = 'user' and length(p.text) > 150)",
    # W02, W07, W09, W15, W16
    "split_by_token_share": "select conv_id, turn, least(2, cast(floor(coalesce(sum(n) over (partition by conv_id order by turn rows between unbounded preceding and 1 preceding), 0) * 3.0D / sum(n) over (partition by conv_id)) as int)) as part from (select conv_id, turn, sum(length(text)) as n from conversations group by 1, 2) c",
    "protect_last_assistants": "select conv_id, turn, role, (later < 2) as protected from (select conv_id, turn, role, coalesce(sum(case when role = 'assistant' then 1 else 0 end) over (partition by conv_id order by turn desc rows between unbounded preceding and 1 preceding), 0) as later from (select distinct conv_id, turn, role from conversations) d) r",
    # T05 to T10
    "slowest_files_top_n": "select source, round(avg(n_chars), 4) as mean, max(n_chars) as most from documents group by 1 order by most desc, source limit 10",
    "sort_then_truncate": "select c_custkey, c_name from customer order by lower(c_name), c_custkey limit 200",
    "top_category_per_group": "select lang, source from (select lang, source, row_number() over (partition by lang order by count(*) desc, source) as rn from documents group by 1, 2) r where rn = 1",
    # text: keywords, line rules
    "rule_scan_findings": "select doc_id, case when text like '%All rights reserved%' then 'rights' when text like '%License%' then 'license' else 'secret' end as rule, length(text) as size from documents where text like '%All rights reserved%' or text like '%License%' or lower(text) like '%token = %'",
    "email_status": "select doc_id, case when text like '%@%.example.com%' then 'junk' when text like '%@%' then 'found' else 'missing' end as status from documents",
}
