"""SQL counterparts of the registered queries, written for DuckDB over the same tables.

They follow the definition of each query, not the Spark plan: peaks by row number,
percentiles by rank, expected validation results from the way the documents are damaged.
"""

from __future__ import annotations

# Bucket bounds, written out on their own.
REQUEST_SECONDS_BUCKETS = (0.005, 0.01, 0.025, 0.05, 0.1, 0.25, 0.5, 1.0, 2.5, 5.0, 10.0)
QUERY_SECONDS_BUCKETS = (0.001, 0.005, 0.01, 0.025, 0.05, 0.1, 0.25, 0.5, 1.0, 2.5, 5.0)
CONSUME_SECONDS_BUCKETS = (0.01, 0.05, 0.1, 0.25, 0.5, 1.0, 2.5, 5.0, 10.0)
BATCH_ROWS_BUCKETS = (1, 10, 50, 100, 500, 1000, 5000, 10000)
MESSAGE_BYTES_BUCKETS = (100, 500, 1000, 5000, 10000, 50000, 100000)

ONE_MATCH = "match-2024-01-05-1"
SEED = 7

# -- shared building blocks --------------------------------------------------------------

ME = """
me as (
  select event_id as seq, ts, user_id, value,
         printf('00000000-0000-4000-8000-%012x', event_id) as event_id,
         'match-' || cast(cast(ts as date) as varchar) || '-' || cast(user_id % 4 as varchar) as match_id,
         case event_type when 'click' then 'pass' when 'view' then 'shot' when 'purchase' then 'goal'
              when 'error' then 'yellow_card' when 'signup' then 'red_card' else event_type end as event_type,
         cast(1 + event_id % 2 as integer) as team_id,
         case when user_id % 23 = 0 then '' else 'p' || cast(user_id % 23 as varchar) end as player_id,
         replace(props, ' ', '') as metadata,
         date_trunc('minute', ts) as minute
  from events
)"""


def _rfc3339(ts: str) -> str:
    return f"regexp_replace(strftime({ts}, '%Y-%m-%dT%H:%M:%S.%f'), '\\.?0*$', '') || 'Z'"


ENVELOPE = f"""'{{"eventId":"' || event_id || '","matchId":"' || match_id || '","eventType":"' || event_type
  || '","timestamp":"' || {_rfc3339('ts')} || '","teamId":' || team_id || ',"playerId":"' || player_id
  || '","metadata":' || metadata || '}}'"""

# The order of checks, and so the first error, by kind of damage.
CHECKED = f"""{ME},
checked as (
  select *, seq % 16 as kind,
    seq % 16 in (5, 6, 7) as malformed,
    case seq % 16 when 0 then 'eventId' when 1 then 'matchId' when 2 then 'eventType'
         when 3 then 'timestamp' when 4 then 'teamId' when 10 then 'matchId' end as error_field,
    case seq % 16 when 0 then 'must be a valid UUID' when 1 then 'is required'
         when 2 then 'must be a valid event type' when 3 then 'must be a valid RFC3339 timestamp'
         when 4 then 'must be 1 or 2' when 10 then 'is required'
         when 5 then 'invalid JSON body' when 6 then 'invalid JSON body' when 7 then 'invalid JSON body'
    end as error_message
  from me
)"""

BY_MINUTE = "select match_id, minute, count(*) as event_count from me group by 1, 2"

METRICS = f"""{ME},
totals as (
  select match_id, count(*) as total_events,
         count(*) filter (where event_type = 'goal') as goals,
         count(*) filter (where event_type = 'yellow_card') as yellow_cards,
         count(*) filter (where event_type = 'red_card') as red_cards,
         min(ts) as first_event_at, max(ts) as last_event_at
  from me group by 1
),
types as (
  select match_id, '{{' || string_agg('"' || event_type || '":' || n, ',' order by event_type) || '}}' as events_by_type
  from (select match_id, event_type, count(*) as n from me group by 1, 2) group by 1
),
peaks as (
  select match_id, minute as peak_minute, event_count as peak_count
  from (select *, row_number() over (partition by match_id order by event_count desc, minute) as r
        from ({BY_MINUTE})) where r = 1
),
metrics as (
  select match_id, total_events, events_by_type, goals, yellow_cards, red_cards,
         first_event_at, last_event_at, peak_minute, peak_count
  from totals join types using (match_id) join peaks using (match_id)
)"""


def _percentiles(source: str, value: str, wanted: dict[str, int], by: str | None = None) -> str:
    """Rank-based percentile with linear interpolation, over a subquery."""
    keys = f"{by}, " if by else ""
    part = f"partition by {by} " if by else ""
    columns = []
    for name, p in wanted.items():
        pos = f"((cast({p} as double) / 100) * cast(n - 1 as double))"
        low = f"max(case when r = floor({pos}) then v end)"
        high = f"max(case when r = ceil({pos}) then v end)"
        part_of = f"(max({pos}) - floor(max({pos})))"
        columns.append(
            f"case when max(n) = 1 then max(v) when {part_of} = 0 then round({low} * 100) / 100 "
            f"else round(({low} + {part_of} * ({high} - {low})) * 100) / 100 end as {name}"
        )
    return f"""
select {keys}{', '.join(columns)} from (
  select *, row_number() over ({part}order by v) - 1 as r,
         count(*) over ({part.strip()}) as n
  from (select {keys}{value} as v from {source})
) {'group by ' + by if by else ''}"""


def _ranges() -> str:
    """What stands for the exact values of each rank: the middle of their logarithmic buckets of 1 %."""
    growth = "(cast(1.01 as double) / cast(0.99 as double))"
    columns = ", ".join(
        f"round(max(case when r = floor((cast({p} as double) / 100) * cast(n - 1 as double)) then "
        f"2 * pow({growth}, ceil(ln(v) / ln({growth}))) / ({growth} + 1) end), 6) as {name}"
        for name, p in (("p50", 50), ("p95", 95), ("p99", 99))
    )
    return f"""with ranges (since, until) as (values ('2024-01-01 00:00:00', '2024-01-08 00:00:00'),
          ('2024-01-09 10:17:00', '2024-01-20 18:43:00'), ('2024-01-01 00:00:00', '2024-02-01 00:00:00')),
        ranked as (
          select since, until, event_type, value as v, count(*) over g as n, row_number() over (g order by value) - 1 as r
          from ranges join events on ts >= cast(since as timestamp) and ts < cast(until as timestamp)
          window g as (partition by since, until, event_type))
        select since, until, event_type, n, {columns} from ranked group by 1, 2, 3, 4"""


LATENCY = {"p50": 50, "p95": 95, "p99": 99}

REQUESTS = """
requests as (
  select ts,
    case when event_type in ('click', 'view', 'purchase') then 'POST' else 'GET' end as method,
    case when event_type in ('click', 'view', 'purchase') then '/api/events'
         else '/api/matches/match-' || cast(cast(ts as date) as varchar) || '-' || cast(user_id % 4 as varchar)
              || '/metrics' end as path,
    cast(case when event_id % 10 = 0 then case when event_type in ('click', 'view', 'purchase') then 400 else 404 end
         when event_id % 10 = 1 then case when event_type in ('click', 'view', 'purchase') then 503 else 500 end
         else case when event_type in ('click', 'view', 'purchase') then 202 else 200 end end as integer) as status,
    value / 1000 as duration_s
  from events
)"""


def _histogram(source: str, value: str, bounds: tuple, by: str | None = None, sum_expr: str | None = None) -> str:
    keys = f"{by}, " if by else ""
    group = f"group by {by}" if by else ""
    total = sum_expr or f"round(sum({value}), 4)"
    rows = [(f"{value} <= {bound}", str(bound)) for bound in bounds] + [("true", "+Inf")]
    return " union all ".join(
        f"select {keys}'{le}' as le, count(*) filter (where {test}) as bucket_count, "
        f"{total} as value_sum, count({value}) as value_count from {source} {group}"
        for test, le in rows
    )


LEDGER = """
ledger as (
  select event_id as id, props as event_data, 'Network error' as failure_reason, ts as created_at,
         cast(event_id % 5 as integer) as retry_count
  from events where event_type = 'error'
),
answers as (
  select event_id as id, case user_id % 4 when 0 then 200 when 1 then 202 + 298 * (event_id % 2) end as status_code
  from events where event_type = 'error' and user_id % 4 <> 3
),
run as (
  select l.*, case when retry_count >= 3 then 'skipped'
                   when coalesce(status_code in (200, 202), false) then 'resent' else 'failed' end as result
  from ledger l left join answers a on l.id = a.id
)"""

PLAYERS = """
players as (
  select cast(c_nationkey % 2 + 1 as integer) as team_id, 'p' || cast(c_custkey as varchar) as id, c_name as name,
         case when c_custkey % 10 = 0 then 'gk' when c_custkey % 10 <= 4 then 'def'
              when c_custkey % 10 <= 7 then 'mid' else 'fwd' end as position
  from customer
)"""

QUOTAS = """
quotas as (
  select team_id, position, cast(ceil(count(*) / 10.0) as integer) as quota from players group by 1, 2
)"""

ROUTED = f"""{ME},
routed as (
  select *, cast(case when seq % 5 < 4 then seq % 5 else 0 end + 1 as integer) as retry_count,
         case when case when seq % 5 < 4 then seq % 5 else 0 end + 1 <= 3 then 'retry' else 'dead' end as route
  from me
)"""

STORED = """event_id, match_id, event_type, cast(team_id as varchar) as team_id,
  nullif(player_id, '') as player_id, metadata, ts as "timestamp", cast(ts as date) as event_date"""

FLAT = "select * from metrics"

ORACLES = {
    "match_summary": f"""with {ME}
        select match_id, count(*) as total_events, count(*) filter (where event_type = 'goal') as goals,
          count(*) filter (where event_type = 'yellow_card') as yellow_cards,
          count(*) filter (where event_type = 'red_card') as red_cards,
          min(ts) as first_event_at, max(ts) as last_event_at from me group by 1""",
    "match_summary_one": f"""with {ME}
        select match_id, count(*) as total_events, count(*) filter (where event_type = 'goal') as goals,
          count(*) filter (where event_type = 'yellow_card') as yellow_cards,
          count(*) filter (where event_type = 'red_card') as red_cards,
          min(ts) as first_event_at, max(ts) as last_event_at from me where match_id = '{ONE_MATCH}' group by 1""",
    "events_by_type": f"with {ME} select match_id, event_type, count(*) as event_count from me group by 1, 2",
    "events_by_type_one": f"""with {ME} select match_id, event_type, count(*) as event_count from me
        where match_id = '{ONE_MATCH}' group by 1, 2 order by event_count desc, event_type""",
    "events_by_type_map": f"with {METRICS} select match_id, events_by_type from types",
    "events_per_minute": f"""with {ME}
        select match_id, minute, event_type, count(*) as event_count from me group by 1, 2, 3""",
    "events_per_minute_one": f"""with {ME}
        select match_id, minute, event_type, count(*) as event_count from me
        where match_id = '{ONE_MATCH}' group by 1, 2, 3 order by minute, event_type""",
    "minute_totals": f"with {ME} {BY_MINUTE}",
    "peak_minute": f"""with {METRICS} select match_id, peak_minute as minute, peak_count as event_count from peaks""",
    "match_activity": f"""with {ME}
        select match_id, cast(sum(event_count) as bigint) as total_events,
          '[' || string_agg(cast(event_count as varchar), ',' order by minute) || ']' as events_per_minute,
          cast(sum(event_count) as double) / count(*) as average_per_minute
        from ({BY_MINUTE}) group by 1""",
    "match_metrics": f"with {METRICS} {FLAT}",
    "match_metrics_one": f"with {METRICS} {FLAT} where match_id = '{ONE_MATCH}'",
    "match_metrics_json": f"""with {METRICS}
        select match_id, '{{"matchId":"' || match_id || '","totalEvents":' || total_events
          || ',"eventsByType":' || events_by_type || ',"goals":' || goals || ',"yellowCards":' || yellow_cards
          || ',"redCards":' || red_cards || ',"firstEventAt":"' || {_rfc3339('first_event_at')}
          || '","lastEventAt":"' || {_rfc3339('last_event_at')} || '","peakMinute":{{"minute":"'
          || {_rfc3339('peak_minute')} || '","eventCount":' || peak_count || '}}}}' as body from metrics""",
    "match_metrics_with_latency": f"""with {METRICS}, recent as (
          select floor(value) as v from events order by ts desc, event_id desc limit 10000),
        latency as ({_percentiles('recent', 'v', LATENCY)})
        select * from metrics, latency""",
    "minute_rollup": f"""with {ME}
        select match_id, minute, event_type, count(*) as event_count, min(ts) as first_event_at,
          max(ts) as last_event_at from me group by 1, 2, 3""",
    "rollup_equals_base": f"with {METRICS} {FLAT}",
    "latency_percentiles": f"""with recent as (
          select floor(value) as v from events order by ts desc, event_id desc limit 5000)
        {_percentiles('recent', 'v', LATENCY)}""",
    "latency_percentiles_by_type": f"""with recent as (
          select event_type, floor(value) as v,
            row_number() over (partition by event_type order by ts desc, event_id desc) as age from events)
        {_percentiles('(select * from recent where age <= 1500)', 'v', LATENCY, 'event_type')}""",
    "percentile_exact": _percentiles(
        "events", "value", {"p25": 25, "p50": 50, "p75": 75, "p95": 95, "p99": 99}, "event_type"
    ),
    "percentile_exact_all": _percentiles("events", "value", LATENCY),
    "latest_n": """select event_id as seq, ts, event_type, value as duration_ms from events
        order by ts desc, event_id desc limit 5000""",
    "latest_n_per_key": """select seq, ts, event_type, duration_ms from (
          select event_id as seq, ts, event_type, value as duration_ms,
            row_number() over (partition by event_type order by ts desc, event_id desc) as age from events)
        where age <= 100""",
    "request_counters": f"with {REQUESTS} select method, path, status, count(*) as requests from requests group by 1, 2, 3",
    "request_counters_by_template": f"""with {REQUESTS}
        select method, case when path like '/api/matches/%' then '/api/matches/{{matchId}}/metrics' else path end
          as template, status, count(*) as requests from requests group by 1, 2, 3""",
    "ingest_counters": f"with {ME} select event_type, count(*) as events_ingested from me group by 1",
    "error_rate": f"""with {REQUESTS}
        select method, count(*) as requests, count(*) filter (where status >= 500) as errors,
          cast(count(*) filter (where status >= 500) as double) / count(*) as error_rate from requests group by 1""",
    "request_histogram": f"with {REQUESTS} {_histogram('requests', 'duration_s', REQUEST_SECONDS_BUCKETS, 'method')}",
    "query_histogram": f"with {REQUESTS} {_histogram('requests', 'duration_s', QUERY_SECONDS_BUCKETS)}",
    "batch_histograms": f"""with batches as (
          select event_id // 1000 as batch_id, count(*) as rows_, max(value) / 100 as duration_s from events group by 1)
        select 'rows' as measure, * from ({_histogram('batches', 'rows_', BATCH_ROWS_BUCKETS,
            sum_expr='round(cast(sum(rows_) as double), 4)')})
        union all
        select 'duration_s' as measure, * from ({_histogram('batches', 'duration_s', CONSUME_SECONDS_BUCKETS)})""",
    "message_size_histogram": f"""with {ME}, sizes as (select event_type, strlen({ENVELOPE}) as bytes from me)
        {_histogram('sizes', 'bytes', MESSAGE_BYTES_BUCKETS, 'event_type', 'cast(sum(bytes) as bigint)')}""",
    "validate_first_error": f"""with {CHECKED}
        select seq as doc_id, malformed, error_field, error_message from checked""",
    "validate_valid_rows": f"""with {CHECKED}
        select seq as doc_id, event_id, match_id, event_type, ts as "timestamp", team_id,
          case when kind = 11 then '' else player_id end as player_id,
          case when kind <> 8 then metadata end as metadata
        from checked where error_message is null""",
    "reject_counts": f"""with {CHECKED}
        select error_field, error_message, count(*) as documents from checked group by 1, 2""",
    "error_text": f"""with {CHECKED}
        select seq as doc_id,
          case when error_field is not null
               then 'validation error: field ''' || error_field || ''' ' || error_message end as error_text,
          '{{"error":"Bad Request","message":"' || error_message || '"'
            || case when error_field is null then '' else ',"field":"' || error_field || '"' end || '}}' as response
        from checked where error_message is not null""",
    "storage_projection": f"with {ME} select {STORED} from me",
    "metadata_json": f"""with {CHECKED}
        select event_id, case when kind = 8 then '{{}}' else metadata end as metadata
        from checked where error_message is null""",
    "envelope_encode": f"with {ME} select event_id, {ENVELOPE} as envelope from me",
    "envelope_roundtrip": f"with {ME} select {STORED} from me",
    "envelope_decode_errors": f"""with {CHECKED}
        select seq as doc_id, kind in (0, 3, 5, 6, 7, 9) as parse_error,
          case when kind not in (0, 5, 6, 7, 9) then event_id end as event_id,
          case when kind in (5, 6, 7, 9) then null when kind in (1, 10) then '' else match_id end as match_id,
          cast(case when kind in (5, 6, 7, 9) then null when kind in (4, 10) then 3 else team_id end as bigint) as team_id
        from checked""",
    "publish_rows": f"""with {ME}
        select match_id as key, {ENVELOPE} as value, event_type, event_id, 'events' as topic, ts as "timestamp" from
        me""",
    "acceptance_receipt": f"""with {CHECKED}
        select event_id, 'accepted' as status, timestamp '2024-02-01 12:00:00' as "timestamp"
        from checked where error_message is null""",
    "retry_route": f"with {ROUTED} select event_id, retry_count, route from routed",
    "route_without_outputs": f"""with {ROUTED}
        select 'no_retry' as "case", 'dead' as route, count(*) as rows from routed
        union all select 'neither', 'lost', count(*) from routed
        union all select 'no_dead', case route when 'dead' then 'lost' else route end, count(*) from routed group by 2""",
    "retry_rows": f"""with {ROUTED}
        select match_id as key, {ENVELOPE} as value, event_type, event_id, retry_count,
          {_rfc3339('ts')} as original_timestamp, 'retry' as topic from routed where route = 'retry'""",
    "retry_replay": f"""with {ROUTED}
        select event_id, cast(retry_count + 1 as integer) as retry_count,
          case when retry_count + 1 <= 3 then 'retry' else 'dead' end as route from routed where route = 'retry'""",
    "dead_letter_rows": f"""with {ROUTED}
        select match_id as key,
          '{{"event":' || {ENVELOPE} || ',"event_id":"' || event_id || '","event_type":"' || event_type
          || '","failed_at":"2024-02-01T12:00:00Z","match_id":"' || match_id
          || '","reason":"max_retries_exceeded_or_permanent_failure"}}' as value,
          event_type, event_id, '2024-02-01T12:00:00Z' as failed_at, 'dead' as topic
        from routed where route = 'dead'""",
    "batch_audit": f"""with {CHECKED}
        select seq // 1000 as batch_id,
          case when kind in (0, 3, 5, 6, 7, 9) then 'parse_error'
               when (seq // 1000) % 7 = 3 then 'retry' else 'success' end as outcome,
          count(*) as rows from checked group by 1, 2""",
    "consumer_lag": f"""with {ME}, topic as (select cast(user_id % 3 as integer) as partition, seq, ts from me),
        committed as (select partition, max(seq) + 1 as committed_offset from topic
          where day(ts) <= 21 and partition <> 2 group by 1),
        ends as (select partition, min(seq) as first_offset, max(seq) + 1 as next_offset from topic group by 1)
        select 'events' as topic, partition, next_offset, coalesce(committed_offset, first_offset) as committed_offset,
          next_offset - coalesce(committed_offset, first_offset) as lag
        from ends left join committed using (partition)""",
    "ledger_transition": f"""with {LEDGER}
        select id, event_data, failure_reason, created_at,
          cast(case when result = 'failed' then retry_count + 1 else retry_count end as integer) as retry_count
        from run where result <> 'resent'""",
    "ledger_summary": f"""with {LEDGER}
        select count(*) as found, count(*) filter (where result = 'resent') as resent,
          count(*) filter (where result <> 'resent') as still_failed,
          count(*) filter (where result <> 'resent') as remaining from run""",
    "ledger_eligible": f"with {LEDGER} select * from ledger where retry_count < 3 order by created_at, id",
    "ledger_append": f"""with {REQUESTS}
        select '{{"method":"' || method || '","path":"' || path || '"}}' as event_data,
          case when status >= 500 then 'HTTP ' || status || ': ' else 'Network error' end as failure_reason,
          timestamp '2024-02-01 12:00:00' as created_at, 0 as retry_count, count(*) as entries
        from requests where status >= 400 group by 1, 2""",
    "delivery_counts": f"""with {REQUESTS}
        select path, count(*) filter (where status in (200, 202)) as sent,
          count(*) filter (where status not in (200, 202)) as failed from requests group by 1""",
    "quota_sample": f"""with {PLAYERS}, {QUOTAS}
        select team_id, id, name, position from (
          select p.*, quota, row_number() over (partition by p.team_id, p.position
            order by md5('{SEED}:' || cast(p.team_id as varchar) || ':' || p.position || ':' || id), id) as draw
          from players p join quotas q on p.team_id = q.team_id and p.position = q.position)
        where draw <= quota""",
    "roster_position": f"with {PLAYERS} select * from players where position = 'gk'",
    "stream_ingest_counts": f"""with {CHECKED}
        select match_id, event_type, count(*) as event_count from checked where error_message is null group by 1, 2""",
    "stream_outcomes": f"""with {ROUTED}
        select route as outcome, count(*) as audited, count(*) as written from routed group by 1
        union all
        select 'parse_error', count(*), count(*) from routed where seq % 16 in (0, 3, 5, 6, 7, 9)""",
    "stream_minute_counts": f"""with {ME}
        select match_id, minute, event_type, count(*) as event_count, min(ts) as first_event_at,
          max(ts) as last_event_at from me group by 1, 2, 3""",
    "stream_distinct": f"with {ME} select match_id, event_type, count(*) as event_count from me group by 1, 2",
    "stream_distinct_committed": f"with {ME} select match_id, event_type, count(*) as event_count from me group by 1, 2",
    "stream_cell_deltas": f"""with {ME}
        select match_id, minute, event_type, cast(count(*) as bigint) as event_count, min(ts) as first_event_at,
          max(ts) as last_event_at from me group by 1, 2, 3""",
    "committed_repeat": f"with {ME} select event_type, count(*) as events, true as grown from me group by 1",
    "compacted_dates": f"with {ME} select cast(ts as date) as event_date, count(*) as events, true as packed from me group by 1",
    "stream_two_writers": f"with {ME} select match_id, event_type, count(*) as event_count from me group by 1, 2",
    "stream_audit_counters": f"""with {CHECKED}
        select case when kind in (0, 3, 5, 6, 7, 9) then 'parse_error' else 'success' end as outcome,
          cast(1 as bigint) as batches, count(*) as rows from checked group by 1""",
    "clustered_table": f"with {ME} select {STORED} from me",
    "topic_roundtrip": f"with {ME} select {STORED} from me",
    "raw_text_errors": f"""with {CHECKED}
        select error_field, error_message, count(*) as documents from checked group by 1, 2""",
    "latency_ranges": _ranges(),
    "stream_message_counters": f"""with {CHECKED}
        select case when kind in (0, 3, 5, 6, 7, 9) then 'unreadable' else 'match_events' end as topic,
          'success' as status, count(*) as messages, count(*) as audited from checked group by 1""",
    "roster_scan": f"with {PLAYERS} select team_id, id, name, position from players",
    "ledger_scan": f"""with {LEDGER}
        select id, retry_count, cast(row_number() over (order by created_at, id) as integer) as place from ledger""",
    "null_rows_skipped": f"with {ME} select event_id from me where seq % 3 <> 0",
    "unknown_match": f"with {METRICS} {FLAT} where match_id = 'match-of-nobody'",
    "percentile_epoch": _percentiles(
        "(select event_type, cast(epoch_us(ts) // 1000 as double) as millis from events)", "millis", LATENCY, "event_type"
    ),
    "match_metrics_json_with_latency": f"""with {METRICS}, recent as (
          select floor(value) as v from events order by ts desc, event_id desc limit 10000),
        latency as ({_percentiles('recent', 'v', LATENCY)})
        select match_id, '{{"matchId":"' || match_id || '","totalEvents":' || total_events
          || ',"eventsByType":' || events_by_type || ',"goals":' || goals || ',"yellowCards":' || yellow_cards
          || ',"redCards":' || red_cards || ',"firstEventAt":"' || {_rfc3339('first_event_at')}
          || '","lastEventAt":"' || {_rfc3339('last_event_at')} || '","peakMinute":{{"minute":"'
          || {_rfc3339('peak_minute')} || '","eventCount":' || peak_count || '}},"responseTimePercentiles":{{"p50":'
          || p50 || ',"p95":' || p95 || ',"p99":' || p99 || '}}}}' as body from metrics, latency""",
}

# What a stream or a store arrives at is what the batch query tells.
ORACLES |= {
    "ledger_versions": ORACLES["ledger_transition"],
    "stream_latest_n_per_key": ORACLES["latest_n_per_key"],
    "stream_latency_by_type": ORACLES["latency_percentiles_by_type"],
}
