"""Independent DuckDB SQL for every registered query (the correctness oracle).

The entity views of FIXTURES.md §3 and the rollup tiers are spelled out as
CTEs over the raw tables; each query text carries only the CTEs it uses.
"""

from __future__ import annotations

from vigil.functions.normalize import duckdb_normalize_sql
from vigil.operators.predicates import parse_rfc3339_ns
from vigil.plans import catalog as C

_NS = "epoch_us(ts) * 1000"
_DAYKEY = "cast(user_id as varchar) || '-' || strftime(ts, '%Y%m%d')"
_SERVICE = "'svc-' || cast(event_id % 8 as varchar)"
_EXACT = "decimal(24,6)"

CTES: dict[str, tuple[str, tuple[str, ...]]] = {}


def cte(name: str, body: str, *deps: str) -> None:
    CTES[name] = (body, deps)


cte("logs", f"""
select event_id as log_id, {_NS} as timestamp_ns, ts,
  case event_type when 'error' then 'error' when 'purchase' then 'warn' when 'signup' then 'info'
                  when 'click' then 'debug' else 'trace' end as level,
  case event_type when 'error' then 4 when 'purchase' then 3 when 'signup' then 2
                  when 'click' then 1 else 0 end as level_order,
  case event_id % 5
    when 0 then 'User ' || cast(user_id as varchar) || ' ' || event_type || ' took ' || cast(value as varchar) || 'ms'
    when 1 then 'Request to https://api.example.com/users/' || cast(user_id as varchar) || ' returned 500'
    when 2 then 'Connection to 10.0.0.' || cast(user_id % 256 as varchar) || ':5432 failed after ' || cast(value as varchar) || 'ms'
    when 3 then 'Cannot read /var/log/app-' || cast(user_id as varchar) || '.log'
    else 'Mail to user' || cast(user_id as varchar) || '@example.com bounced' end as message,
  {_SERVICE} as service,
  case when event_id % 7 = 0 then cast(null as bigint) else cast(json_extract_string(props, '$.k') as bigint) end as attr_k,
  event_type as attr_type, value as attr_value, event_type = 'error' as attr_failed,
  case when event_id % 3 = 0 then cast(null as varchar) else {_DAYKEY} end as trace_id,
  case when event_id % 3 = 0 then cast(null as varchar) else cast(event_id as varchar) end as span_id
from events""")

cte("metrics", f"""
select event_id as point_id, {_NS} as timestamp_ns, ts, event_type as name,
  case when event_type in ('purchase', 'signup') then 'counter' else 'gauge' end as metric_type,
  value, {_SERVICE} as service,
  'host=' || cast(user_id % 4 as varchar) || ',service=' || {_SERVICE} as labels_key
from events""")

cte("spans", f"""
select {_DAYKEY} as trace_id, cast(event_id as varchar) as span_id,
  case when event_id = min(event_id) over (partition by {_DAYKEY}) then cast(null as varchar)
       else cast(min(event_id) over (partition by {_DAYKEY}) as varchar) end as parent_span_id,
  event_type as name, event_type as operation, {_SERVICE} as service,
  case when event_id % 2 = 0 then 'server' else 'client' end as kind,
  case when event_type = 'error' then 'error' else 'ok' end as status,
  {_NS} as start_ns, {_NS} + cast(round(value * 1000000) as bigint) as end_ns,
  cast(round(value * 1000000) as bigint) as duration_ns, ts
from events""")

_BUCKET = {
    "1min": "date_trunc('minute', {c})",
    "5min": "time_bucket(interval '5 minutes', {c})",
    "1hour": "date_trunc('hour', {c})",
    "1day": "date_trunc('day', {c})",
}


def _metric_tier(tier: str) -> str:
    b = _BUCKET[tier].format(c="ts")
    return f"""
select {b} as timestamp, name, metric_type, service, labels_key,
  count(*) as count,
  cast(sum(cast(value as {_EXACT})) as double) as sum,
  min(value) as min, max(value) as max,
  cast(sum(cast(value as {_EXACT})) as double) / count(*) as avg,
  md5(labels_key) as labels_hash
from metrics group by all"""


def _log_tier(tier: str) -> str:
    b = _BUCKET[tier].format(c="ts")
    return f"""
select {b} as timestamp, level, service, {duckdb_normalize_sql('message')} as normalized_message,
  count(*) as count, min(message) as sample_message
from logs group by all"""


def _span_tier(tier: str) -> str:
    b = _BUCKET[tier].format(c="ts")
    pct = ",\n  ".join(
        f"round(quantile_cont(duration_ns, {p}), {C.PCT_ROUND}) as {name}"
        for name, p in C.rollups.SPAN_PERCENTILES.items()
    )
    return f"""
select {b} as timestamp, service, operation, kind as span_kind, status as status_code,
  count(*) as span_count,
  cast(sum(duration_ns) as double) / count(*) as avg_duration_ns,
  min(duration_ns) as min_duration_ns, max(duration_ns) as max_duration_ns,
  {pct}
from spans group by all"""


def _trace_tier(tier: str) -> str:
    b = _BUCKET[tier].format(c="ts")
    return f"""
select {b} as timestamp, service, count(distinct trace_id) as unique_traces, count(*) as total_spans
from spans group by all"""


for _t in ("1min", "5min", "1hour", "1day"):
    cte(f"metrics_{_t}", _metric_tier(_t), "metrics")
for _t in ("1hour", "1day"):
    cte(f"logs_{_t}_counts", _log_tier(_t), "logs")
    cte(f"spans_{_t}_stats", _span_tier(_t), "spans")
    cte(f"traces_{_t}_stats", _trace_tier(_t), "spans")

cte("trace_summary", """
select trace_id, count(*) as span_count, string_agg(distinct service, ',' order by service) as services,
  min(start_ns) as start_ns, max(end_ns) as end_ns, max(end_ns) - min(start_ns) as duration_ns,
  (max(end_ns) - min(start_ns)) // 1000000 as duration_ms,
  arg_min(span_id, start_ns) filter (where parent_span_id is null) as root_span_id,
  arg_min(name, start_ns) filter (where parent_span_id is null) as root_name,
  arg_min(service, start_ns) filter (where parent_span_id is null) as root_service,
  max(start_ns) as last_start_ns,
  bool_or(service = 'svc-3') as has_service,
  bool_or(status = 'error') as has_error
from spans group by trace_id""", "spans")


def sql(body: str, *deps: str) -> str:
    """Prefix ``body`` with the CTEs it needs, dependencies first."""
    order: list[str] = []

    def visit(name: str) -> None:
        if name in order:
            return
        for dep in CTES[name][1]:
            visit(dep)
        order.append(name)

    for d in deps:
        visit(d)
    if not order:
        return body.strip()
    parts = ",\n".join(f"{n} as ({CTES[n][0]}\n)" for n in order)
    return f"with {parts}\n{body.strip()}"


def _ts_ns(text: str) -> str:
    return f"(epoch_us(timestamptz '{text}') * 1000)"


_METRIC_COLS = "timestamp, name, metric_type, service, labels_key, count, sum, min, max, avg, labels_hash"
_LOG_COLS = "log_id, level, service, message"
_TRACE_COLS = "trace_id, span_count, services, start_ns, end_ns, duration_ms"
_SVC = C.SERVICE

ORACLE: dict[str, str] = {}

for _t in ("1min", "5min", "1hour", "1day"):
    ORACLE[f"q_metrics_{_t}"] = sql(f"select {_METRIC_COLS} from metrics_{_t}", f"metrics_{_t}")
ORACLE["q_metrics_tier_up"] = sql(f"select {_METRIC_COLS} from metrics_1day", "metrics_1day")
for _t in ("1hour", "1day"):
    ORACLE[f"q_logs_{_t}_counts"] = sql(f"select * from logs_{_t}_counts", f"logs_{_t}_counts")
    ORACLE[f"q_spans_{_t}_stats"] = sql(f"select * from spans_{_t}_stats", f"spans_{_t}_stats")
    ORACLE[f"q_traces_{_t}_stats"] = sql(f"select * from traces_{_t}_stats", f"traces_{_t}_stats")

_AGG = {
    "sum": f"coalesce(cast(sum(cast(value as {_EXACT})) as double), 0.0)",
    "avg": f"coalesce(cast(sum(cast(value as {_EXACT})) as double) / count(value), 0.0)",
    "min": "coalesce(min(value), 0.0)",
    "max": "coalesce(max(value), 0.0)",
    "count": "cast(count(value) as double)",
}
for _fn, _expr in _AGG.items():
    ORACLE[f"q_metric_agg_{_fn}"] = sql(
        f"select {_expr} as value, count(value) as count from metrics "
        f"where name = '{C.METRIC_NAME}' and metric_type <> 'histogram'",
        "metrics",
    )
ORACLE["q_metric_agg_windowed"] = sql(
    f"select date_trunc('hour', ts) as window_start, name, {_AGG['avg']} as value, count(value) as count "
    "from metrics group by all",
    "metrics",
)
ORACLE["q_entity_counts"] = sql(
    "select 'logs' as entity, count(*) as row_count from logs union all "
    "select 'metrics', count(*) from metrics union all select 'spans', count(*) from spans",
    "logs", "metrics", "spans",
)
ORACLE["q_trace_count"] = sql("select count(distinct trace_id) as trace_count from spans", "spans")
ORACLE["q_trace_summary"] = sql(
    "select trace_id, span_count, services, start_ns, end_ns, duration_ns, duration_ms, root_span_id, "
    "root_name, root_service from trace_summary",
    "trace_summary",
)
ORACLE["q_data_age"] = sql(
    """
select data_type, oldest, newest, count,
  ((epoch_us(a.as_of) - epoch_us(oldest)) // 1000000) / 86400.0 as oldest_age_days,
  coalesce(((epoch_us(a.as_of) - epoch_us(oldest)) // 1000000) / 86400.0 > ttl, false) as exceeds_ttl
from (
  select 'logs' as data_type, min(ts) as oldest, max(ts) as newest, count(*) as count, 30 as ttl from logs
  union all select 'metrics', min(ts), max(ts), count(*), 90 from metrics
  union all select 'traces', min(ts), max(ts), count(*), 30 from spans
) s, (select max(ts) as as_of from events) a""",
    "logs", "metrics", "spans",
)

_AND_OR = "(level = 'error' or lower(service) = 'svc-2') and contains(lower(message), 'took')"
ORACLE["q_log_filter_total"] = sql(f"select count(*) as total_count from logs where {_AND_OR}", "logs")

# reports
ORACLE["q_metric_tier_read"] = sql(
    f"select {_METRIC_COLS} from metrics_1hour where name = '{C.METRIC_NAME}' and service = '{_SVC}' "
    "order by timestamp desc, service, metric_type, labels_key limit 30",
    "metrics_1hour",
)
ORACLE["q_log_counts_by_level"] = sql(
    f"select timestamp, level, service, normalized_message, count, sample_message from logs_1hour_counts "
    f"where level = '{C.LOG_LEVEL}' order by count desc, timestamp desc, service, normalized_message limit 100",
    "logs_1hour_counts",
)
ORACLE["q_log_daily_totals"] = sql(
    f"select timestamp, service, normalized_message, cast(sum(count) as bigint) as total_count "
    f"from logs_1day_counts where service = '{_SVC}' group by all "
    "order by total_count desc, timestamp desc, normalized_message limit 30",
    "logs_1day_counts",
)
ORACLE["q_top_error_patterns"] = sql(
    f"""select normalized_message, cast(sum(count) as bigint) as occurrences, min(sample_message) as example
from logs_1day_counts
where level = '{C.LOG_LEVEL}'
  and timestamp >= (select max(timestamp) from logs_1day_counts) - interval 7 day
group by normalized_message order by occurrences desc, normalized_message limit 10""",
    "logs_1day_counts",
)
ORACLE["q_span_perf_ms"] = sql(
    f"""select timestamp, service, operation, span_kind, status_code, avg_ms, round(p95_ms, 8) as p95_ms, span_count
from (select *, avg_duration_ns / 1000000.0 as avg_ms, p95_raw / 1000000.0 as p95_ms from (
  select date_trunc('hour', ts) as timestamp, service, operation, kind as span_kind, status as status_code,
    count(*) as span_count, cast(sum(duration_ns) as double) / count(*) as avg_duration_ns,
    quantile_cont(duration_ns, 0.95) as p95_raw
  from spans group by all))
where service = '{_SVC}' order by timestamp desc, operation, span_kind, status_code limit 100""",
    "spans",
)
_LAST = "timestamp >= (select max(timestamp) from spans_1day_stats) - interval {n} day"
ORACLE["q_error_rate"] = sql(
    f"""select service, operation, error_count, total_count, error_count * 100.0 / total_count as error_rate_pct
from (select service, operation,
        cast(sum(case when status_code <> 'ok' then span_count else 0 end) as bigint) as error_count,
        cast(sum(span_count) as bigint) as total_count
      from spans_1day_stats where {_LAST.format(n=7)} group by all)
where error_count * 100.0 / total_count > 1.0""",
    "spans_1day_stats",
)


def _mean_ms(col: str) -> str:
    return f"round(avg({col}) / 1000000.0, {C.MS_ROUND})"


ORACLE["q_slowest_operations"] = sql(
    f"""select service, operation, {_mean_ms('p99_duration_ns')} as p99_ms,
  cast(sum(span_count) as bigint) as total_spans
from spans_1day_stats where {_LAST.format(n=7)}
group by all order by p99_ms desc, service, operation limit 10""",
    "spans_1day_stats",
)
ORACLE["q_latency_trend"] = sql(
    f"""select cast(timestamp as date) as date, service, operation,
  {_mean_ms('avg_duration_ns')} as avg_ms,
  {_mean_ms('p95_duration_ns')} as p95_ms,
  {_mean_ms('p99_duration_ns')} as p99_ms
from spans_1day_stats where {_LAST.format(n=30)} group by all""",
    "spans_1day_stats",
)
ORACLE["q_spans_per_trace"] = sql(
    f"""select timestamp, service, unique_traces, total_spans,
  cast(total_spans as double) / unique_traces as avg_spans_per_trace
from traces_1day_stats where service = '{_SVC}' order by timestamp desc, service limit 30""",
    "traces_1day_stats",
)
ORACLE["q_trace_complexity"] = sql(
    """select service, cast(sum(unique_traces) as bigint) as total_traces,
  cast(sum(total_spans) as double) / cast(sum(unique_traces) as double) as avg_complexity
from traces_1day_stats group by service""",
    "traces_1day_stats",
)
ORACLE["q_pattern_counts"] = sql(
    f"""select message, cnt, {duckdb_normalize_sql('message')} as normalized_message
from (select message, count(*) as cnt from logs group by message)
order by cnt desc, message limit 10""",
    "logs",
)

# sort / limit
ORACLE["q_logs_order_ts"] = sql(f"select {_LOG_COLS} from logs order by timestamp_ns desc, log_id limit 100", "logs")
ORACLE["q_logs_order_level"] = sql(f"select {_LOG_COLS} from logs order by level_order, log_id limit 50", "logs")
ORACLE["q_logs_order_service"] = sql(f"select {_LOG_COLS} from logs order by service desc, log_id limit 50", "logs")
ORACLE["q_logs_limit"] = sql(
    f"select {_LOG_COLS} from logs where level = '{C.LOG_LEVEL}' order by timestamp_ns desc, log_id limit 25", "logs"
)
ORACLE["q_logs_limit_offset"] = sql(
    f"select {_LOG_COLS} from logs where level = '{C.LOG_LEVEL}' order by timestamp_ns desc, log_id "
    "limit 20 offset 40",
    "logs",
)
ORACLE["q_traces_recent"] = sql(
    f"select {_TRACE_COLS} from trace_summary order by start_ns desc, trace_id desc limit 100", "trace_summary"
)

# scalar
ORACLE["q_normalize_message"] = sql(
    f"select log_id, {duckdb_normalize_sql('message')} as normalized_message from logs", "logs"
)
ORACLE["q_normalize_documents"] = sql(
    f"select doc_id as log_id, {duckdb_normalize_sql('text')} as normalized_message from documents"
)

# retention
_ASOF = "(select max(ts) from events)"
ORACLE["q_retention_logs"] = sql(
    f"select log_id from logs where ts >= {_ASOF} - interval {C.RETENTION_TTL['logs']} day", "logs"
)
ORACLE["q_retention_metrics"] = sql(
    f"select point_id from metrics where ts >= {_ASOF} - interval {C.RETENTION_TTL['metrics']} day", "metrics"
)
ORACLE["q_retention_spans"] = sql(
    f"select trace_id, span_id from spans where ts >= {_ASOF} - interval {C.RETENTION_TTL['traces']} day", "spans"
)

# predicates
_PRED_SQL = {
    "q_pred_string_eq": "lower(service) = lower('SVC-3')",
    "q_pred_string_ne_missing": "trace_id is null or lower(trace_id) <> '8-20240101'",
    "q_pred_string_range": "service > 'svc-5'",
    "q_pred_contains": "contains(lower(message), 'example.com')",
    "q_pred_starts_with": "starts_with(lower(message), 'request')",
    "q_pred_ends_with": "suffix(lower(message), 'ms')",
    "q_pred_level_ge": "level_order >= 3",
    "q_pred_ts_rfc3339": f"timestamp_ns >= {_ts_ns(C.TS_FROM)} and timestamp_ns < {_ts_ns(C.TS_TO)}",
    "q_pred_ts_epoch": f"timestamp_ns < cast({C.EPOCH_SECONDS} as bigint) * 1000000000",
    "q_pred_attr_string": "lower(attr_type) = 'error' or starts_with(lower(attr_type), 'pur')",
    "q_pred_attr_int": "attr_k is null or attr_k <> 50 or attr_k < 10",
    "q_pred_attr_float": "attr_value > 250.5 or coalesce(cast(attr_k as double) <= 3.0, false)",
    "q_pred_attr_bool": "attr_failed = false and coalesce(attr_k > 90, false)",
    "q_pred_and_or": _AND_OR,
}
for _name, _where in _PRED_SQL.items():
    ORACLE[_name] = sql(f"select {_LOG_COLS} from logs where {_where}", "logs")
ORACLE["q_log_filter_range_level_service_contains"] = sql(
    f"""select {_LOG_COLS} from logs
where timestamp_ns >= {_ts_ns(C.TS_FROM)} and timestamp_ns < {_ts_ns(C.TS_TO)}
  and level = '{C.LOG_LEVEL}' and service = '{_SVC}' and contains(lower(message), 'ms')""",
    "logs",
)
ORACLE["q_metric_list"] = sql(
    f"""select point_id, name, value, timestamp_ns from metrics where name = '{C.METRIC_NAME}'
order by timestamp_ns desc, point_id limit 100 offset 100""",
    "metrics",
)
ORACLE["q_metric_filter_labels"] = sql(
    f"select point_id, name, value, labels_key from metrics "
    f"where metric_type = 'gauge' and labels_key = 'host=1,service={_SVC}'",
    "metrics",
)

# traces
ORACLE["q_trace_by_service"] = sql(f"select {_TRACE_COLS} from trace_summary where has_service", "trace_summary")
ORACLE["q_trace_by_time"] = sql(
    f"select {_TRACE_COLS} from trace_summary "
    f"where last_start_ns >= {_ts_ns(C.TS_FROM)} and start_ns < {_ts_ns(C.TS_TO)}",
    "trace_summary",
)
ORACLE["q_trace_by_duration"] = sql(
    f"select {_TRACE_COLS} from trace_summary where duration_ms between 3600000 and 36000000", "trace_summary"
)
ORACLE["q_trace_by_status"] = sql(
    f"select {_TRACE_COLS} from trace_summary where has_error and has_service", "trace_summary"
)
ORACLE["q_trace_fetch_semi"] = sql(
    """select trace_id, span_id, parent_span_id, service, start_ns from spans
where trace_id in (select trace_id from trace_summary where has_service
                   order by start_ns desc, trace_id desc limit 100)""",
    "trace_summary",
)
ORACLE["q_trace_index"] = sql(
    """select trace_id, cast(ts as date) as day, count(*) as span_count, min(start_ns) as first_start_ns, max(start_ns) as last_start_ns,
  max(end_ns) as last_end_ns, string_agg(distinct service, ',' order by service) as services,
  string_agg(distinct status, ',' order by status) as statuses
from spans group by trace_id, cast(ts as date)""",
    "spans",
)
ORACLE["q_trace_search_indexed"] = sql(
    f"select {_TRACE_COLS} from trace_summary where has_service and has_error and duration_ms >= 1000 "
    f"and last_start_ns >= {_ts_ns(C.TS_FROM)} and start_ns < {_ts_ns(C.TS_TO)}",
    "trace_summary",
)
ORACLE["q_trace_fetch_indexed"] = sql(
    f"""select trace_id, span_id, service, start_ns from spans
where trace_id in (select trace_id from trace_summary where has_service and start_ns < {_ts_ns(C.TS_TO)}
                   order by start_ns desc, trace_id desc limit 100)""",
    "trace_summary",
)
ORACLE["q_trace_span_level"] = sql(
    f"select distinct trace_id from spans where service = '{_SVC}' and status = 'error' "
    "and duration_ns // 1000000 >= 100",
    "spans",
)
ORACLE["q_trace_by_id"] = sql(
    "select trace_id, span_id, parent_span_id, name, service, start_ns, end_ns from spans "
    "where trace_id = (select min(trace_id) from spans)",
    "spans",
)
ORACLE["q_log_trace_join"] = sql(
    """select l.log_id, l.trace_id, l.span_id, s.name as span_name, s.service as span_service,
  s.status as span_status, s.duration_ns
from logs l join spans s on l.trace_id = s.trace_id and l.span_id = s.span_id""",
    "logs", "spans",
)
ORACLE["q_span_parent_child"] = sql(
    """select s.trace_id, s.span_id, s.parent_span_id, s.service, s.name, s.duration_ns,
  coalesce(c.child_count, 0) as child_count, coalesce(c.child_duration_ns, 0) as child_duration_ns,
  s.duration_ns - coalesce(c.child_duration_ns, 0) as self_ns
from spans s left join (
  select trace_id, parent_span_id, count(*) as child_count, cast(sum(duration_ns) as bigint) as child_duration_ns
  from spans where parent_span_id is not null group by all
) c on s.trace_id = c.trace_id and s.span_id = c.parent_span_id""",
    "spans",
)


ORACLE["q_span_orphans"] = sql(
    """select c.trace_id, c.span_id, c.parent_span_id from spans c
where c.parent_span_id is not null
  and not exists (select 1 from spans p where p.trace_id = c.trace_id and p.span_id = c.parent_span_id)""",
    "spans",
)
ORACLE["q_log_orphans"] = sql(
    """select l.log_id, l.trace_id, l.span_id from logs l
where l.trace_id is not null and l.span_id is not null
  and not exists (select 1 from spans s where s.trace_id = l.trace_id and s.span_id = l.span_id)""",
    "logs", "spans",
)

ORACLE["q_sql_select_star"] = sql(
    f"""select log_id, level, service, message, timestamp_ns from logs
where level = '{C.LOG_LEVEL}' and lower(service) = '{_SVC}'
order by timestamp_ns desc, log_id limit 50""",
    "logs",
)
ORACLE["q_sql_rollup_read"] = sql(
    f"""select service, normalized_message, cast(sum(count) as bigint) as total_count, min(sample_message) as example
from logs_1day_counts where level = '{C.LOG_LEVEL}' group by service, normalized_message""",
    "logs_1day_counts",
)

# ingest round trips
_EVERY = C.wire.INVALID_EVERY
ORACLE["q_ingest_native_logs"] = sql(
    f"""select log_id, timestamp_ns, level, message, service, trace_id, span_id, attr_k as k, attr_type as type
from logs where log_id % {_EVERY} <> 0""",
    "logs",
)
ORACLE["q_ingest_native_log_rejects"] = sql(
    f"""select 'service must not be empty' as reject_reason, count(*) as rejected
from logs where log_id % {_EVERY} = 0 having count(*) > 0""",
    "logs",
)
ORACLE["q_ingest_native_spans"] = sql(
    """select trace_id, span_id, parent_span_id, name, service, kind, status, start_ns,
  start_ns + (duration_ns // 1000000) * 1000000 as end_ns
from spans""",
    "spans",
)
ORACLE["q_ingest_native_metrics"] = sql(
    "select name, metric_type, value, timestamp_ns, labels_key, service from metrics", "metrics"
)
ORACLE["q_ingest_otlp_logs"] = sql(
    """select log_id, timestamp_ns, level, message, service, lower(hex(trace_id)) as trace_id,
  lower(hex(span_id)) as span_id, attr_k as k, attr_type as type, attr_value as value, attr_failed as failed,
  'h-' || cast(log_id % 3 as varchar) as host
from logs""",
    "logs",
)
ORACLE["q_ingest_otlp_spans"] = sql(
    """select lower(hex(trace_id)) as trace_id, lower(hex(span_id)) as span_id,
  lower(hex(parent_span_id)) as parent_span_id, name, service, kind, status, start_ns, end_ns,
  greatest(end_ns - start_ns, 0) as duration_ns, operation
from spans""",
    "spans",
)
ORACLE["q_ingest_otlp_metrics"] = sql(
    "select name, metric_type, value, timestamp_ns, labels_key, service, '1' as unit from metrics", "metrics"
)


ORACLE["q_ingest_otlp_log_batches"] = sql(
    """select log_id, timestamp_ns, level, message, service, lower(hex(trace_id)) as trace_id, lower(hex(span_id)) as span_id
from logs""",
    "logs",
)
ORACLE["q_ingest_otlp_histograms"] = sql(
    """select point_id, name, 'histogram' as metric_type, value, cast(3 as bigint) as hist_count, service, 2 as n_buckets,
  cast(3 as bigint) as bucket_total, value + 1 as last_bound
from metrics""",
    "metrics",
)
ORACLE["q_metric_filter_time"] = sql(
    f"select point_id, name, value, timestamp_ns from metrics where name = '{C.METRIC_NAME}' "
    f"and timestamp_ns >= {parse_rfc3339_ns(C.TS_FROM)} and timestamp_ns < {parse_rfc3339_ns(C.TS_TO)}",
    "metrics",
)
ORACLE["q_attributes_text"] = sql(
    """select log_id, '"' || attr_type || '"' as type_text, cast(attr_failed as varchar) as failed_text, cast(attr_k as varchar) as k_text
from logs""",
    "logs",
)


def _rejects(entity: str, key: str, time_field: str, third: str) -> str:
    return sql(
        f"""select case {key} % 5 when 0 then 'request is not readable' when 1 then '{time_field} is not an integer'
  when 2 then '{third}' else 'accepted' end as reject_reason, count(*) as rejected
from {entity} group by 1""",
        entity,
    )


ORACLE["q_ingest_otlp_log_rejects"] = _rejects("logs", "log_id", "timeUnixNano", "attribute intValue is not an integer")
ORACLE["q_ingest_otlp_nested"] = sql(
    r"""select log_id, ts, 'tpl {} ' || message || ' [end]' as message,
  '[' || cast(to_json(message || ' {} "[{\') as varchar) || ',null,' || log_id || ',true,[],{"":' || (log_id % 7) || ',"a {} b":"' || service
    || '","stringValue":["{\"intValue\":\"1\"}"]}]' as list_text,
  repeat('[', 10) || log_id || repeat(']', 10) as deep_text, '"' || service || '"' as unnamed_text, '"' || service || '"' as resource_text,
  5 as n_attributes
from logs""",
    "logs",
)
ORACLE["q_ingest_metric_rejects"] = _rejects("metrics", "point_id", "timeUnixNano", "value must be present")
ORACLE["q_ingest_span_rejects"] = _rejects("spans", "(start_ns // 1000)", "startTimeUnixNano", "end time must not be before start time")


ORACLE["q_spans_1day_from_states"] = ORACLE["q_spans_1day_stats"]
ORACLE["q_traces_1day_from_states"] = ORACLE["q_traces_1day_stats"]
ORACLE["q_traces_distinct_sketch"] = sql(
    "select service, count(distinct trace_id) as traces, count(*) as total_spans, true as within_error from spans group by service", "spans"
)
ORACLE["q_logs_1day_by_dictionary"] = ORACLE["q_logs_1day_counts"]
_RANGE = "{c} >= %d and {c} < %d" % (parse_rfc3339_ns(C.RANGE_FROM), parse_rfc3339_ns(C.RANGE_TO))
ORACLE["q_metric_range"] = sql(
    f"select {_METRIC_COLS} from ({_metric_tier('1day').replace('from metrics', 'from metrics where ' + _RANGE.format(c='timestamp_ns'))})",
    "metrics",
)
ORACLE["q_span_range"] = sql(
    f"select * from ({_span_tier('1day').replace('from spans', 'from spans where ' + _RANGE.format(c='start_ns'))})", "spans"
)
ORACLE["q_logs_deep_page"] = sql(f"select {_LOG_COLS} from logs order by timestamp_ns desc, log_id limit 75 offset 640", "logs")
ORACLE["q_log_contains_by_grams"] = sql(
    f"""select {_LOG_COLS} from logs
where contains(lower(message), 'user1') and (contains(lower(message), 'bounced') or suffix(lower(message), '7ms'))""",
    "logs",
)
ORACLE["q_span_tree"] = sql(
    """select * from (
with recursive nodes as (
  select s.trace_id, s.span_id, s.parent_span_id, s.duration_ns, s.end_ns, p.span_id as parent
  from spans s left join spans p on p.trace_id = s.trace_id and p.span_id = s.parent_span_id
), last_child as (
  select trace_id, parent, arg_max(span_id, (end_ns, span_id)) as span_id from nodes where parent is not null group by trace_id, parent
), tree as (
  select trace_id, span_id, span_id as root_span_id, 0 as depth, true as on_critical_path from nodes where parent is null
  union all
  select n.trace_id, n.span_id, t.root_span_id, t.depth + 1, t.on_critical_path and n.span_id = l.span_id
  from nodes n join tree t on n.trace_id = t.trace_id and n.parent = t.span_id
    join last_child l on l.trace_id = n.trace_id and l.parent = n.parent
), below as (
  select trace_id, span_id as top, span_id from nodes
  union all
  select b.trace_id, b.top, n.span_id from below b join nodes n on n.trace_id = b.trace_id and n.parent = b.span_id
), sums as (
  select b.trace_id, b.top as span_id, count(*) as subtree_spans, cast(sum(n.duration_ns) as bigint) as subtree_ns
  from below b join nodes n on n.trace_id = b.trace_id and n.span_id = b.span_id group by b.trace_id, b.top
)
select n.trace_id, n.span_id, n.parent_span_id, t.root_span_id, t.depth, s.subtree_spans, s.subtree_ns, t.on_critical_path,
  t.span_id is null as in_cycle
from nodes n left join tree t using (trace_id, span_id) left join sums s using (trace_id, span_id))""",
    "spans",
)


def oracle_sql() -> dict[str, str]:
    return dict(ORACLE)
