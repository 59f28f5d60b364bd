"""The registered queries as SQL, written independently of the operators.

``VIEWS`` are shared common table expressions; each statement is their list followed by its own select.
"""

from __future__ import annotations

WINDOW_MS = 12 * 3_600_000
MAX_TXN = 4

VIEWS = {
    "fx_merchants": """
        select cast(s_suppkey as varchar) as merchant_id, s_name as name,
               case s_suppkey % 6 when 0 then 'RETAIL' when 1 then 'TRAVEL' when 2 then 'FOOD' when 3 then 'CRYPTO'
                                  when 4 then 'FUEL' else 'UNKNOWN' end as category,
               case s_suppkey % 6 when 1 then 'MEDIUM' when 3 then 'HIGH' when 5 then 'HIGH' else 'LOW' end
                   as risk_category,
               n_name as country
        from supplier join nation on s_nationkey = n_nationkey
        where s_suppkey % 7 <> 3""",
    "fx_accounts": """
        select cast(c_custkey as varchar) as account_id, c_name as owner_name,
               case c_custkey % 3 when 0 then 'STANDARD' when 1 then 'PREMIUM' else 'VIP' end as tier,
               case when c_nationkey < 15 then 'US' else n_name end as country,
               cast(1000 + c_custkey % 50 * 500 as double) as credit_limit,
               cast(c_custkey % 10 as double) / 10 as risk_score
        from customer join nation on c_nationkey = n_nationkey
        where c_custkey % 11 <> 5""",
    "fx_all": """
        select event_id as n, lpad(cast(event_id as varchar), 12, '0') as transaction_id,
               cast(user_id as varchar) as account_id,
               cast(event_id % (select count(*) from supplier) as varchar) as merchant_id,
               value as amount, 'USD' as currency,
               case when event_id % 20 = 0 then cast(0 as double)
                    else cast((user_id * 37) % 120 - 60 + case when event_id % 50 = 7 then 40 else 0 end as double)
                         + cast(event_id % 5 as double) / 100 end as latitude,
               case when event_id % 20 = 0 then cast(0 as double)
                    else cast((user_id * 53) % 300 - 150 as double) + cast(event_id % 7 as double) / 100 end
                   as longitude,
               epoch_us(ts) // 1000 as event_time_ms,
               case when event_id % 97 = 0 then 'd' when event_id % 41 = 0 then 'u' else 'c' end as op
        from events""",
    "txn": "select * from fx_all where op <> 'd'",
    "enriched": """
        select t.*, coalesce(m.name, 'Unknown') as merchant_name, coalesce(m.category, 'UNKNOWN') as merchant_category,
               coalesce(m.risk_category, 'MEDIUM') as merchant_risk, m.merchant_id is null as merchant_miss,
               coalesce(a.tier, 'STANDARD') as account_tier, coalesce(a.country, 'US') as account_country,
               coalesce(a.risk_score, 0.3) as account_risk, a.account_id is null as account_miss
        from txn t left join fx_merchants m on t.merchant_id = m.merchant_id
                   left join fx_accounts a on t.account_id = a.account_id""",
    "terms": """
        select *, least(ln(1 + amount) / ln(10001.0), 1.0) * 0.25 as score_amount,
               cast(case merchant_risk when 'HIGH' then 0.35 when 'MEDIUM' then 0.15 else 0.05 end as double)
                   as score_merchant_risk,
               account_risk * 0.20 as score_account_baseline,
               cast(case when (event_time_ms // 3600000) % 24 < 6 then 0.10 else 0 end as double) as score_time_of_day,
               cast(case when merchant_risk = 'HIGH' and account_country <> 'US' then 0.10 else 0 end as double)
                   as score_cross_border
        from enriched""",
    "scored": """
        select *, least(score_amount + score_merchant_risk + score_account_baseline + score_time_of_day
                        + score_cross_border, 1.0) as risk_score
        from terms""",
    "spend": """
        select event_time_ms - event_time_ms % width as window_start_ms,
               event_time_ms - event_time_ms % width + width as window_end_ms,
               dimension, dimension_value, sum(amount) as total_amount, count(*) as txn_count
        from (select event_time_ms, amount, 'CATEGORY' as dimension, merchant_category as dimension_value,
                     60000::bigint as width from scored
              union all
              select event_time_ms, amount, 'MERCHANT', merchant_id, 60000 from scored
              union all
              select event_time_ms, amount, 'ACCOUNT', account_id, 300000 from scored)
        group by all""",
    "velocity": f"""
        select *, count(*) over (partition by account_id order by event_time_ms
                                 range between {WINDOW_MS} preceding and current row)
                  - (count(*) over (partition by account_id, event_time_ms)
                     - row_number() over (partition by account_id, event_time_ms order by transaction_id))
                  as txn_count
        from txn""",
    "history": """
        select *, count(*) over w as prior_count, avg(amount) over w as prior_mean,
               coalesce(stddev_samp(amount) over w, 0) as prior_stddev
        from txn
        window w as (partition by account_id order by event_time_ms, transaction_id
                     rows between unbounded preceding and 1 preceding)""",
    "spikes": """
        select * from (select *, case when prior_stddev = 0 then 0 else (amount - prior_mean) / prior_stddev end as z
                       from history)
        where prior_count >= 5 and z > 3""",
    "legs": """
        select *, lag(latitude) over w as prev_lat, lag(longitude) over w as prev_lon,
               lag(event_time_ms) over w as prev_ms
        from txn where not (latitude = 0 and longitude = 0)
        window w as (partition by account_id order by event_time_ms, transaction_id)""",
    "trips": """
        select *, 6371.0 * 2 * atan2(sqrt(h), sqrt(1 - h)) as distance_km,
               greatest((event_time_ms - prev_ms) / 3600000.0, 1e-9) as hours
        from (select *, pow(sin(radians(latitude - prev_lat) / 2), 2)
                        + cos(radians(prev_lat)) * cos(radians(latitude))
                          * pow(sin(radians(longitude - prev_lon) / 2), 2) as h
              from legs where prev_ms is not null)""",
    "anomalies": f"""
        select transaction_id || ':' || reason_code as id, *
        from (select n, transaction_id, account_id, 'VELOCITY' as reason_code, event_time_ms as detected_at_ms
              from velocity where txn_count > {MAX_TXN}
              union all
              select n, transaction_id, account_id, 'AMOUNT_SPIKE', event_time_ms from spikes
              union all
              select n, transaction_id, account_id, 'GEO_TRAVEL', event_time_ms from trips
              where distance_km / hours > 900)""",
    "verdicts": """
        select 'verdict-' || id as id, id as anomaly_event_id, n, points >= 70 as is_fraud, points / 100.0 as confidence,
               points as ai_risk_score,
               case when points >= 85 then 'CONFIRMED_FRAUD' when points >= 70 then 'LIKELY_FRAUD'
                    when points >= 40 then 'SUSPICIOUS' when points >= 10 then 'LEGITIMATE' else 'UNKNOWN' end
                   as classification,
               'score ' || points as reasoning, detected_at_ms + 1000 as analyzed_at_ms
        from (select *, cast(n * 13 % 101 as integer) as points from anomalies where n % 3 <> 0)""",
    "actions": """
        select a.id || '#' || k as id, a.id as anomaly_event_id,
               case (n + k) % 4 when 0 then 'APPROVE' when 1 then 'DENY' when 2 then 'ESCALATE' else 'BLOCK_ACCOUNT' end
                   as action,
               'step ' || k as notes, detected_at_ms + k * 60000 as performed_at_ms
        from anomalies a, (values (1), (2), (3)) as steps(k)
        where k <= n % 4""",
    "last_action": """
        select anomaly_event_id, action as last_action
        from (select *, row_number() over (partition by anomaly_event_id order by performed_at_ms desc, id desc) as r
              from actions)
        where r = 1""",
    "cases": """
        select e.id, e.transaction_id, e.account_id, e.reason_code, e.detected_at_ms, s.merchant_id, s.amount,
               round(s.risk_score, 6) as rule_risk_score, t.currency, t.latitude, t.longitude, t.event_time_ms,
               a.owner_name, a.tier, a.country as account_country, a.credit_limit, a.risk_score as account_risk_score,
               m.name as merchant_name, m.category as merchant_category, m.risk_category as merchant_risk_category,
               m.country as merchant_country, v.id as ai_analysis_id, v.is_fraud, v.confidence, v.ai_risk_score, v.classification,
               v.reasoning, v.analyzed_at_ms, l.last_action
        from anomalies e
        left join scored s on e.transaction_id = s.transaction_id
        left join txn t on e.transaction_id = t.transaction_id
        left join fx_accounts a on e.account_id = a.account_id
        left join fx_merchants m on s.merchant_id = m.merchant_id
        left join verdicts v on e.id = v.anomaly_event_id
        left join last_action l on e.id = l.anomaly_event_id""",
    "txn_log": """
        select transaction_id, account_id, amount, 'c' as op, event_time_ms as ts_ms from fx_all
        union all
        select transaction_id, account_id, amount + 1, 'u', event_time_ms + 1000 from fx_all where n % 41 = 0
        union all
        select transaction_id, account_id, amount, 'd', event_time_ms + 2000 from fx_all where n % 97 = 0""",
    "arrivals": """
        select transaction_id, account_id, n as "offset",
               event_time_ms - case when n % 10 = 3 then 12000 when n % 10 = 6 then 900000 else 0 end as event_time_ms
        from txn""",
}


def _steps(time: str) -> str:
    """The half minutes at which a row lies in the last five minutes."""
    first = f"({time} // 30000 + 1) * 30000"
    return f"unnest(range({first}, {first} + 300000, 30000))"


def _late(partition: str) -> str:
    return f"""
        select *, case when lag_ms = 0 then 'on_time' when lag_ms <= 10000 then 'late' else 'dropped' end as lateness
        from (select *, coalesce(greatest(watermark_ms - event_time_ms, 0), 0) as lag_ms
              from (select *, max(event_time_ms) over ({partition} order by "offset"
                                rows between unbounded preceding and 1 preceding) - 5000 as watermark_ms
                    from arrivals))"""


def _top(dimension: str, name: str, k: int, counts: bool = False) -> str:
    extra = ", cast(sum(txn_count) as bigint) as transaction_count" if counts else ""
    return f"""
        select dimension_value as {name}, round(sum(total_amount), 6) as total_spend{extra}
        from spend
        where dimension = '{dimension}' and window_start_ms >= (select max(event_time_ms) from txn) - 86400000
        group by dimension_value order by sum(total_amount) desc, dimension_value limit {k}"""


def _spend(dimension: str) -> str:
    return f"select * replace (round(total_amount, 6) as total_amount) from spend where dimension = '{dimension}'"


def _profiles(table: str, key: str, changed: str) -> str:
    return f"""
        select * replace (case when k % 4 = 0 then {changed} || '+' else {changed} end as {changed}),
               case when k % 4 = 0 then 'u' else 'r' end as op,
               case when k % 4 = 0 then k + 2000 else 1000 end as ts_ms
        from (select *, cast({key} as bigint) as k from {table})
        where k % 13 <> 6"""


def _without(columns: str, body: str) -> str:
    return f"select * exclude ({columns}) from ({body})"


def _change_count(table: str, key: str, topic: str) -> str:
    return f"""
        select '{topic}' as topic,
               cast(sum(1 + case when k % 4 = 0 then 1 else 0 end + case when k % 13 = 6 then 1 else 0 end) as bigint)
                   as record_count
        from (select cast({key} as bigint) as k from {table})"""


SCORE_COLUMNS = (
    "transaction_id, account_id, merchant_id, amount, currency, latitude, longitude, event_time_ms, "
    "merchant_category, merchant_risk, account_tier, account_country"
)

SELECTS = {
    "cdc_unwrap": """
        select transaction_id, account_id, merchant_id, case when n % 23 = 1 then 0.0 else amount end as amount,
               currency, latitude, longitude,
               case when n % 7 <> 3 and n % 29 = 5 then event_time_ms + 250 else event_time_ms end as event_time_ms,
               case when n % 37 = 6 then 'c' else op end as op
        from fx_all
        where n % 53 <> 8 and n % 31 <> 4 and (n % 37 = 6 or op <> 'd')""",
    "cdc_first_versions": "select transaction_id, amount, op, ts_ms from txn_log where op = 'c'",
    "cdc_current_state": """
        select transaction_id, account_id, round(amount, 6) as amount, op, ts_ms
        from (select *, row_number() over (partition by transaction_id order by ts_ms desc) as r from txn_log)
        where r = 1 and op <> 'd'""",
    "snapshot_and_changes": "select account_id, tier, country, credit_limit, risk_score from ("
    + _profiles("fx_accounts", "account_id", "tier")
    + ")",
    "route_changes": "select 'transactions.raw' as topic, count(*) as record_count from events union all "
    + _change_count("fx_accounts", "account_id", "enrichment.accounts")
    + " union all "
    + _change_count("fx_merchants", "merchant_id", "enrichment.merchants"),
    "latest_merchants": _without("k", _profiles("fx_merchants", "merchant_id", "category")),
    "latest_accounts": _without("k", _profiles("fx_accounts", "account_id", "tier")),
    "profiles_of_topics": "select 'merchant' as kind, merchant_id as id, category as label, country from ("
    + _profiles("fx_merchants", "merchant_id", "category")
    + ") union all select 'account', account_id, tier, country from ("
    + _profiles("fx_accounts", "account_id", "tier")
    + ")",
    "enrich_transactions": "select * exclude (n) from enriched",
    "enrich_merchants_only": """
        select transaction_id, merchant_name, merchant_category, merchant_risk, merchant_miss from enriched""",
    "enrich_accounts_only": """
        select transaction_id, account_tier, account_country, account_risk, account_miss from enriched""",
    "enrich_asof_merchants": """
        select transaction_id, merchant_id, event_time_ms, risk_category, valid_from_ms
        from (select t.transaction_id, t.merchant_id, t.event_time_ms, v.risk_category, v.valid_from_ms,
                     row_number() over (partition by t.transaction_id order by v.valid_from_ms desc) as r
              from txn t
              left join (select merchant_id, risk_category || '/' || revision as risk_category,
                                epoch_ms(timestamp '2024-01-01') + revision * 864000000
                                + cast(merchant_id as bigint) % 5 * 86400000 as valid_from_ms
                         from fx_merchants, (values (0), (1), (2)) as revisions(revision)) v
                on t.merchant_id = v.merchant_id and v.valid_from_ms <= t.event_time_ms)
        where r = 1""",
    "enrichment_misses": """
        select 'MERCHANT' as kind, merchant_id as id, count(*) as miss_count from enriched where merchant_miss group by all
        union all
        select 'ACCOUNT', account_id, count(*) from enriched where account_miss group by all""",
    "score_terms": """
        select transaction_id, round(score_amount, 6) as score_amount,
               round(score_merchant_risk, 6) as score_merchant_risk,
               round(score_account_baseline, 6) as score_account_baseline,
               round(score_time_of_day, 6) as score_time_of_day, round(score_cross_border, 6) as score_cross_border
        from terms""",
    "score_transactions": f"select {SCORE_COLUMNS}, round(risk_score, 6) as risk_score from scored",
    "score_breakdowns": """
        select transaction_id, term, round(points, 6) as points
        from (select transaction_id, unnest(['amount', 'merchant_risk', 'account_baseline', 'time_of_day', 'cross_border']) as term,
                     unnest([score_amount, score_merchant_risk, score_account_baseline, score_time_of_day, score_cross_border])
                         as points
              from terms)""",
    "scored_summary": "select count(*) as scored_count, round(avg(risk_score), 6) as avg_risk_score from scored",
    "transaction_count": "select count(*) as transaction_count from txn",
    "score_bands": """
        select case when pct >= 80 then 'critical' when pct >= 60 then 'high' when pct >= 40 then 'medium'
                    else 'low' end as band, count(*) as txn_count
        from (select cast(round(risk_score * 100) as integer) as pct from scored)
        group by all""",
    "account_ema_feature": """
        select account_id, transaction_id, event_time_ms, round(ln(1 + ema), 6) as log_ema
        from (with recursive numbered as (
                  select *, row_number() over (partition by account_id order by event_time_ms, transaction_id) as r
                  from txn),
              chain as (
                  select account_id, transaction_id, event_time_ms, r, amount as ema from numbered where r = 1
                  union all
                  select b.account_id, b.transaction_id, b.event_time_ms, b.r, a.ema * 0.9 + b.amount * 0.1
                  from chain a join numbered b on a.account_id = b.account_id and b.r = a.r + 1)
              select * from chain)""",
    "velocity_flags": f"""
        select transaction_id || ':VELOCITY' as id, transaction_id, account_id, 'VELOCITY' as reason_code,
               event_time_ms as detected_at_ms, txn_count
        from velocity where txn_count > {MAX_TXN}""",
    "amount_spikes": """
        select transaction_id || ':AMOUNT_SPIKE' as id, transaction_id, account_id, 'AMOUNT_SPIKE' as reason_code,
               event_time_ms as detected_at_ms, amount, prior_count, round(ln(1 + prior_mean), 6) as log_mean,
               round(prior_stddev, 6) as prior_stddev, round(z, 6) as z
        from spikes""",
    "geo_travel": """
        select transaction_id || ':GEO_TRAVEL' as id, transaction_id, account_id, 'GEO_TRAVEL' as reason_code,
               event_time_ms as detected_at_ms, latitude, longitude, prev_lat, prev_lon,
               round(distance_km, 4) as distance_km, round(hours, 6) as hours, round(distance_km / hours, 3) as kmh
        from trips where distance_km / hours > 900""",
    "anomalies_all": """
        select id, transaction_id, account_id, reason_code, detected_at_ms,
               case reason_code when 'VELOCITY' then 3 when 'AMOUNT_SPIKE' then 5 else 8 end as evidence_keys
        from anomalies""",
    "anomaly_evidence": f"""
        select id, entry, number, case when entry = 'mean' then true end as close
        from (select transaction_id || ':VELOCITY' as id, unnest(['txn_count', 'window_ms', 'threshold']) as entry,
                     unnest([cast(txn_count as double), {WINDOW_MS}, {MAX_TXN}]) as number
              from velocity where txn_count > {MAX_TXN}
              union all
              select transaction_id || ':AMOUNT_SPIKE', unnest(['amount', 'mean', 'stddev', 'z_score', 'threshold']),
                     unnest([amount, null, round(prior_stddev, 2), round(z, 2), cast(3 as double)])
              from spikes
              union all
              select transaction_id || ':GEO_TRAVEL',
                     unnest(['distance_km', 'elapsed_hours', 'implied_speed_kmh', 'max_speed_kmh', 'prev_lat', 'prev_lon',
                             'curr_lat', 'curr_lon']),
                     unnest([round(distance_km, 1), ((event_time_ms - prev_ms) * 1000 + 1800000) // 3600000 / 1000.0,
                             round(distance_km / hours, 1), cast(900 as double), prev_lat, prev_lon, latitude, longitude])
              from trips where distance_km / hours > 900)""",
    "anomalies_by_reason": "select reason_code, count(*) as anomaly_count from anomalies group by all",
    "spend_by_category_1m": _spend("CATEGORY"),
    "spend_by_merchant_1m": _spend("MERCHANT"),
    "spend_by_account_5m": _spend("ACCOUNT"),
    "spend_union": "select * replace (round(total_amount, 6) as total_amount) from spend",
    "top_categories": _top("CATEGORY", "category", 20),
    "top_merchants": _top("MERCHANT", "merchant", 10),
    "top_accounts": _top("ACCOUNT", "account_id", 20, counts=True),
    "spend_timeseries": """
        select window_start_ms as time_ms, dimension_value as metric, round(total_amount, 6) as value
        from spend
        where dimension = 'CATEGORY' and window_start_ms >= (select max(event_time_ms) from txn) - 86400000
        order by 1, 2""",
    "case_view": "select * from cases",
    "case_page": "select * from cases order by detected_at_ms desc, id limit 100 offset 20",
    "case_detail": """
        select c.*, a.id as action_id, a.action, a.notes, a.performed_at_ms
        from cases c left join actions a on c.id = a.anomaly_event_id
        where c.id = (select id from anomalies where n % 4 = 3 order by detected_at_ms desc, id desc limit 1)""",
    "case_record": """
        select c.*, coalesce((select string_agg(concat_ws('|', cast(performed_at_ms as varchar), cast(id as varchar),
                                                          action, notes), ';' order by performed_at_ms desc, id desc)
                              from actions where anomaly_event_id = c.id), '') as actions_text
        from cases c
        where c.id = (select id from anomalies where n % 4 = 3 order by detected_at_ms desc, id desc limit 1)""",
    "action_history": """
        select * from actions
        where anomaly_event_id = (select id from anomalies where n % 4 = 3 order by detected_at_ms desc, id desc
                                  limit 1)""",
    "case_last_action": "select * from last_action",
    "pending_cases": "select * from cases where classification is null order by detected_at_ms, id limit 10",
    "case_stats": """
        select *, cast(case when total_events > 0 then round(analyzed_count / total_events * 100) else 0 end as integer)
                      as analyzed_pct
        from (select count(*) as total_events, count(*) filter (where v.ai_risk_score >= 70) as high_risk_count,
                     count(*) filter (where v.anomaly_event_id is null) as pending_review_count,
                     count(*) filter (where v.classification = 'CONFIRMED_FRAUD') as confirmed_fraud_count,
                     count(*) filter (where v.anomaly_event_id is not null) as analyzed_count
              from anomalies e left join verdicts v on e.id = v.anomaly_event_id)""",
    "case_search": """
        select * from cases
        where classification = 'SUSPICIOUS'
          and (lower(transaction_id) like '%spike%' or lower(owner_name) like '%spike%'
               or lower(merchant_name) like '%spike%' or lower(reason_code) like '%spike%')""",
    "case_search_index": """
        select * from cases
        where contains(lower(transaction_id), 'geo_tra') or contains(lower(owner_name), 'geo_tra')
           or contains(lower(merchant_name), 'geo_tra') or contains(lower(reason_code), 'geo_tra')""",
    "case_deep_page": """
        select * exclude (place)
        from (select *, row_number() over (order by detected_at_ms desc, id) as place from cases)
        where place > (select count(*) // 3 from anomalies) and place <= (select count(*) // 3 from anomalies) + 100""",
    "case_labels": """
        select id, coalesce(classification, 'pending') as verdict_label,
               case when ai_risk_score >= 80 then 'critical' when ai_risk_score >= 60 then 'high'
                    when ai_risk_score >= 40 then 'medium' when ai_risk_score is not null then 'low' end as verdict_band
        from cases""",
    "pct_of_limit": """
        select id, amount, credit_limit,
               round(case when coalesce(credit_limit, 0) = 0 then 0 else amount / credit_limit * 100 end, 8)
                   as pct_of_limit
        from cases""",
    "recent_anomalies": """
        select detected_at_ms, transaction_id, account_id, reason_code
        from anomalies order by detected_at_ms desc, id limit 50""",
    "verdict_counts": "select classification, count(*) as verdict_count from verdicts group by all",
    "verdict_validate": """
        select anomaly_event_id,
               case when n % 19 = 5 then 'not readable' when n % 17 = 4 then 'reasoning missing'
                    when n % 7 = 1 then 'confidence out of range' when n % 11 = 2 then 'ai_risk_score out of range'
                    when n % 13 = 3 then 'classification unknown' else 'accepted' end as outcome
        from verdicts""",
    "anomaly_counts_5m": """
        select detected_at_ms - detected_at_ms % 300000 as window_start_ms, count(*) as anomaly_count,
               count(*) filter (where reason_code = 'VELOCITY') as velocity_count,
               count(*) filter (where reason_code = 'AMOUNT_SPIKE') as amount_spike_count,
               count(*) filter (where reason_code = 'GEO_TRAVEL') as geo_travel_count
        from anomalies group by 1""",
    "anomaly_rate_1m": """
        select detected_at_ms - detected_at_ms % 60000 as window_start_ms, reason_code,
               round(count(*) / 60.0, 6) as per_second
        from anomalies group by 1, 2""",
    "reason_share_30m": """
        select window_start_ms, reason_code, anomaly_count,
               round(anomaly_count / sum(anomaly_count) over (partition by window_start_ms), 6) as share
        from (select detected_at_ms - detected_at_ms % 1800000 as window_start_ms, reason_code,
                     count(*) as anomaly_count
              from anomalies group by 1, 2)""",
    "fraud_rate_5m": """
        select window_start_ms, event_count, anomaly_count,
               round(anomaly_count / 300.0 * 100 / greatest(event_count / 300.0, 0.001), 6) as fraud_rate_pct
        from (select window_start_ms, coalesce(m, 0) as event_count, coalesce(k, 0) as anomaly_count
              from (select event_time_ms - event_time_ms % 300000 as window_start_ms, count(*) as m
                    from txn group by 1)
              full join (select detected_at_ms - detected_at_ms % 300000 as window_start_ms, count(*) as k
                         from anomalies group by 1) using (window_start_ms))""",
    "anomaly_rate_stepped": f"""
        select reason_code, at_ms, count(*) as row_count, round(count(*) / 300.0, 6) as per_second
        from (select reason_code, {_steps('detected_at_ms')} as at_ms from anomalies) group by all""",
    "fraud_rate_stepped": f"""
        select at_ms, coalesce(m, 0) as event_count, coalesce(k, 0) as anomaly_count,
               round(coalesce(k, 0) / 300.0 * 100 / greatest(coalesce(m, 0) / 300.0, 0.001), 6) as fraud_rate_pct
        from (select at_ms, count(*) as m from (select {_steps('event_time_ms')} as at_ms from txn) group by 1)
        full join (select at_ms, count(*) as k from (select {_steps('detected_at_ms')} as at_ms from anomalies) group by 1)
        using (at_ms)""",
    "miss_rate_1m": """
        select event_time_ms - event_time_ms % 60000 as window_start_ms, count(*) as event_count,
               count(*) filter (where merchant_miss) as merchant_misses,
               count(*) filter (where account_miss) as account_misses,
               round((count(*) filter (where merchant_miss) + count(*) filter (where account_miss)) / count(*), 6)
                   as misses_per_event
        from enriched group by 1""",
    "throughput_1m": """
        select event_time_ms - event_time_ms % 60000 as window_start_ms, count(*) as record_count,
               round(count(*) / 60.0, 6) as per_second, 'score' as stage
        from txn group by 1
        union all
        select detected_at_ms - detected_at_ms % 60000, count(*), round(count(*) / 60.0, 6), 'anomaly'
        from anomalies group by 1""",
    "stream_account_state": f"""
        select account_id, count(*) as amount_count, round(sum(amount), 2) as amount_sum,
               round(coalesce(stddev_samp(amount), 0), 6) as amount_stddev,
               arg_max(latitude, (event_time_ms, transaction_id)) filter (where located) as latitude,
               arg_max(longitude, (event_time_ms, transaction_id)) filter (where located) as longitude,
               max(event_time_ms) filter (where located) as located_ms,
               count(*) filter (where event_time_ms >= last_ms - {WINDOW_MS}) as recent_count
        from (select *, latitude <> 0 or longitude <> 0 as located,
                     max(event_time_ms) over (partition by account_id) as last_ms from txn)
        group by account_id""",
    "lateness_buckets": _late(""),
    "lateness_by_account": _late("partition by account_id"),
    "late_counts_1h": f"""
        select event_time_ms - event_time_ms % 3600000 as window_start_ms, lateness, count(*) as row_count
        from ({_late("")}) group by 1, 2""",
    "upsert_scored": """
        select transaction_id, round(case when n % 3 = 0 then amount + 1000 else amount end, 6) as amount,
               round(case when n % 2 = 0 then risk_score / 2 else risk_score end, 6) as risk_score, event_time_ms
        from scored where n % 3 <> 0 or n % 2 = 0""",
    "upsert_spend": _spend("CATEGORY"),
    "upsert_verdicts": """
        select anomaly_event_id, case when ai_risk_score % 2 = 0 then 100 - ai_risk_score else ai_risk_score end
                   as ai_risk_score,
               case when ai_risk_score % 2 = 0 then 'UNKNOWN' else classification end as classification,
               case when ai_risk_score % 2 = 0 then analyzed_at_ms + 60000 else analyzed_at_ms end as analyzed_at_ms
        from verdicts""",
    "append_anomalies": "select id, transaction_id, account_id, reason_code, detected_at_ms from anomalies",
    "append_case_actions": "select * from actions",
    "insert_absent": """
        select transaction_id, account_id, case when n % 3 = 0 then amount else -1.0 end as amount, event_time_ms
        from txn where n % 3 = 0 or n % 2 = 0""",
}

SELECTS["top_categories_stored"] = SELECTS["top_categories"]
SELECTS["case_page_lookup"] = SELECTS["case_page"]
SELECTS["stream_published_anomalies"] = """
    select account_id as key, 'transactions.anomalies' as topic, id, transaction_id, reason_code, detected_at_ms,
           case reason_code when 'VELOCITY' then 3 when 'AMOUNT_SPIKE' then 5 else 8 end as evidence_keys
    from anomalies"""
SELECTS["stream_score"] = SELECTS["score_transactions"]
SELECTS["stream_anomalies"] = SELECTS["anomalies_all"]
SELECTS["stream_spend"] = SELECTS["spend_union"]
SELECTS["stream_score_profiles"] = SELECTS["score_transactions"]
SELECTS["stream_asof_merchants"] = SELECTS["enrich_asof_merchants"]
SELECTS["stream_lateness"] = SELECTS["lateness_buckets"]
SELECTS["stream_ema"] = SELECTS["account_ema_feature"]
SELECTS["keyed_scored"] = SELECTS["upsert_scored"]
SELECTS["keyed_spend"] = SELECTS["upsert_spend"]
SELECTS["keyed_verdicts"] = SELECTS["upsert_verdicts"]


# Every third account counts as the same one.
HOT = {
    "txn": """
        select * replace (case when cast(account_id as bigint) % 3 = 0 then 'hot' else account_id end as account_id)
        from fx_all where op <> 'd'"""
}
SELECTS["anomalies_hot_account"] = "select id, transaction_id, account_id, reason_code, detected_at_ms from anomalies"
SELECTS["lateness_in_slots"] = SELECTS["lateness_buckets"]
# Some profiles have changed and others are deleted.
CHANGED = {
    "fx_merchants": f"""
        select * replace (category || case when cast(merchant_id as bigint) % 4 = 0 then '+' else '' end as category)
        from ({VIEWS["fx_merchants"]}) where cast(merchant_id as bigint) % 13 <> 6""",
    "fx_accounts": f"""
        select * replace (tier || case when cast(account_id as bigint) % 4 = 0 then '+' else '' end as tier)
        from ({VIEWS["fx_accounts"]}) where cast(account_id as bigint) % 13 <> 6""",
}
VARIANTS = {"anomalies_hot_account": HOT, "stream_score_profiles": CHANGED}


def statement(select: str, changed: dict[str, str]) -> str:
    views = ",\n".join(f"{name} as ({body})" for name, body in (VIEWS | changed).items())
    return f"with {views}\n{select}"


def statements() -> dict[str, str]:
    return {name: statement(select, VARIANTS.get(name, {})) for name, select in SELECTS.items()}
