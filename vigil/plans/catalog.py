"""The registered queries: ``q_*`` name -> callable(spark, base_dir) -> DataFrame.

Each query reads the deployment's tables through :mod:`vigil.sources.views`
and applies the library operators; output columns are scalar and aliased so
they line up with :mod:`vigil.plans.oracle`. Limits appear only where the
operator is a top-k or a page.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from vigil.functions.model import attributes_as_text, labels_key
from vigil.functions.normalize import normalize_message
from vigil.operators import (
    counts, deep_pages, logs as logops, metrics as metricops, pattern_dictionary, reports, rollups, span_tree, states, trace_index,
    traces,
)
from vigil.operators.predicates import And, Cond, Or, parse_rfc3339_ns, where_
from vigil.operators.retention import apply_retention
from vigil.plans import ranges, wire
from vigil.plans.sql import register_views
from vigil.session import configure
from vigil.sources import native_json, otlp, skip_index, views
from vigil.sources.validate import (
    bucket_total,
    log_reject_reason,
    metric_reject_reason,
    outcome_report,
    reject_report,
    span_reject_reason,
    split_valid,
)

Query = Callable[[SparkSession, str], DataFrame]
REGISTRY: dict[str, Query] = {}

# Parameters of the registered queries (chosen to select a real share of the data).
SERVICE = "svc-3"
METRIC_NAME = "purchase"
LOG_LEVEL = "error"
TS_FROM = "2024-01-08T00:00:00Z"
TS_TO = "2024-01-21T12:30:00.5+02:00"
EPOCH_SECONDS = 1704931200  # 2024-01-11T00:00:00Z
RANGE_FROM, RANGE_TO = "2024-01-08T03:17:29.25Z", "2024-01-21T22:41:07.5Z"  # off the borders of every tier
NEEDLES = And(Cond("message", "contains", "User1"), Or(Cond("message", "contains", "BOUNCED"), Cond("message", "ends_with", "7ms")))
BLOCK = 64  # logs of a block of the gram index
RETENTION_TTL = {"logs": 7, "metrics": 14, "traces": 10}
MS_ROUND = 5  # means of milliseconds are compared at 0.01 µs
PCT_ROUND = 2  # percentile-derived ns values are compared at 0.01 ns


def query(fn: Query) -> Query:
    def wrapped(spark: SparkSession, base_dir: str) -> DataFrame:
        configure(spark)
        return fn(spark, base_dir)

    wrapped.__name__ = fn.__name__
    wrapped.__doc__ = fn.__doc__
    REGISTRY[fn.__name__] = wrapped
    return wrapped


def _comparable(total: Column) -> Column:
    """A DOUBLE sum of values with few decimals, freed of the rounding that summation order leaves.

    For the comparison with the oracle only; the operators sum in DOUBLE.
    """
    return total.cast("decimal(38,6)").cast("double")


def _metric_cols(df: DataFrame) -> DataFrame:
    total = _comparable(F.col("sum"))
    return df.select(*rollups.METRIC_KEYS, "count", total.alias("sum"), "min", "max", (total / F.col("count")).alias("avg"),
                     "labels_hash")


def _comparable_value(df: DataFrame, function: str) -> DataFrame:
    value = F.col("value")
    if function == "sum":
        return df.withColumn("value", _comparable(value))
    if function == "avg":
        return df.withColumn("value", F.when(F.col("count") > 0, _comparable(value * F.col("count")) / F.col("count")).otherwise(value))
    return df


def _span_cols(df: DataFrame) -> DataFrame:
    rounded = [F.round(c, PCT_ROUND).alias(c) for c in rollups.SPAN_PERCENTILES]
    return df.select(
        "timestamp", "service", "operation", "span_kind", "status_code", "span_count",
        "avg_duration_ns", "min_duration_ns", "max_duration_ns", *rounded,
    )


def _log_cols(df: DataFrame) -> DataFrame:
    return df.select("log_id", "level", "service", "message")


def _trace_cols(df: DataFrame) -> DataFrame:
    return df.select(
        "trace_id", "span_count", F.array_join("services", ",").alias("services"), "start_ns", "end_ns", "duration_ms"
    )


# --- rollups A1–A11 --------------------------------------------------------------------------

@query
def q_metrics_1min(spark, d):
    """A1"""
    return _metric_cols(rollups.metric_rollup(views.metrics(spark, d), "1min"))


@query
def q_metrics_5min(spark, d):
    """A2"""
    return _metric_cols(rollups.metric_rollup(views.metrics(spark, d), "5min"))


@query
def q_metrics_1hour(spark, d):
    """A3"""
    return _metric_cols(rollups.metric_rollup(views.metrics(spark, d), "1hour"))


@query
def q_metrics_1day(spark, d):
    """A4"""
    return _metric_cols(rollups.metric_rollup(views.metrics(spark, d), "1day"))


@query
def q_metrics_tier_up(spark, d):
    """The 1-day tier rebuilt from the 1-minute tier."""
    return _metric_cols(rollups.tier_up(rollups.metric_rollup(views.metrics(spark, d), "1min"), "1day"))


@query
def q_logs_1hour_counts(spark, d):
    """A5"""
    return rollups.log_count_rollup(views.logs(spark, d), "1hour")


@query
def q_logs_1day_counts(spark, d):
    """A6"""
    return rollups.log_count_rollup(views.logs(spark, d), "1day")


@query
def q_spans_1hour_stats(spark, d):
    """A7"""
    return _span_cols(rollups.span_stats_rollup(views.spans(spark, d), "1hour"))


@query
def q_spans_1day_stats(spark, d):
    """A8"""
    return _span_cols(rollups.span_stats_rollup(views.spans(spark, d), "1day"))


@query
def q_traces_1hour_stats(spark, d):
    """A9"""
    return rollups.trace_stats_rollup(views.spans(spark, d), "1hour")


@query
def q_traces_1day_stats(spark, d):
    """A10"""
    return rollups.trace_stats_rollup(views.spans(spark, d), "1day")


@query
def q_spans_1day_from_states(spark, d):
    """A8 + M2: the day tier merged from hourly states of the spans."""
    return _span_cols(states.span_stats(states.span_values(views.spans(spark, d), "1hour"), "1day"))


@query
def q_traces_1day_from_states(spark, d):
    """A10 + M2: the day tier merged from hourly states of the traces."""
    return states.trace_stats(states.trace_members(views.spans(spark, d), "1hour"), "1day").drop("traces_sketch")


@query
def q_traces_distinct_sketch(spark, d):
    """A9 + A19 + D14: traces of a service over all hours by the union of the hours' sketches, held against the exact count."""
    spans = views.spans(spark, d)
    merged = states.distinct_traces(rollups.trace_stats_rollup(spans, "1hour", sketch=True), ["service"])
    exact = spans.groupBy("service").agg(F.count_distinct("trace_id").alias("traces"))
    near = F.abs(F.col("unique_traces") - F.col("traces")) <= states.SKETCH_ERROR * F.col("traces")
    return exact.join(merged, "service").select("service", "traces", "total_spans", near.alias("within_error"))


@query
def q_logs_1day_by_dictionary(spark, d):
    """A6 + M8: the day tier from message counts and the dictionary of distinct messages."""
    logs = views.logs(spark, d)
    dictionary = logs.select("message").distinct().withColumn("normalized_message", normalize_message("message"))
    return pattern_dictionary.counts_by_pattern(pattern_dictionary.message_counts(logs, "1day"), dictionary)


@query
def q_metric_range(spark, d):
    """A12 + A23 + E1: metrics by day over a range off all borders, stitched from the tiers and raw points."""
    raw = views.metrics(spark, d)
    tiers = {t: rollups.metric_rollup(raw, t) for t in ("1min", "5min", "1hour", "1day")}
    return _metric_cols(ranges.read_range("metrics", raw, tiers, parse_rfc3339_ns(RANGE_FROM), parse_rfc3339_ns(RANGE_TO)))


@query
def q_span_range(spark, d):
    """A7 + A12: span statistics by day over the same range, stitched from hourly states and raw spans."""
    raw = views.spans(spark, d)
    values = ranges.read_range("spans", raw, {"1hour": states.span_values(raw, "1hour")}, parse_rfc3339_ns(RANGE_FROM), parse_rfc3339_ns(RANGE_TO))
    return _span_cols(states.span_stats(values, "1day"))


# --- raw aggregates A13–A23 ------------------------------------------------------------------

def _metric_agg(fn: str):
    def run(spark, d):
        return _comparable_value(metricops.aggregate_metrics(views.metrics(spark, d), fn, name=METRIC_NAME), fn)

    run.__name__ = f"q_metric_agg_{fn}"
    run.__doc__ = f"A13–A17: {fn} over the simple points of one metric"
    return query(run)


for _fn in metricops.AGG_FUNCTIONS:
    _metric_agg(_fn)


@query
def q_metric_agg_windowed(spark, d):
    """Hourly average per metric name."""
    return _comparable_value(metricops.aggregate_metrics_windowed(views.metrics(spark, d), "avg", "1 hour", by=["name"]), "avg")


@query
def q_entity_counts(spark, d):
    """A18"""
    return counts.entity_counts(views.logs(spark, d), views.metrics(spark, d), views.spans(spark, d))


@query
def q_trace_count(spark, d):
    """A19"""
    return counts.trace_count(views.spans(spark, d))


@query
def q_trace_summary(spark, d):
    """A22"""
    s = traces.trace_summary(views.spans(spark, d))
    return s.select(
        "trace_id", "span_count", F.array_join("services", ",").alias("services"), "start_ns", "end_ns",
        "duration_ns", "duration_ms", F.col("root.span_id").alias("root_span_id"),
        F.col("root.name").alias("root_name"), F.col("root.service").alias("root_service"),
    )


@query
def q_data_age(spark, d):
    """A21 / M7"""
    ttl = {"logs": 30, "metrics": 90, "traces": 30}
    return counts.data_age(
        {"logs": (views.logs(spark, d), "ts"), "metrics": (views.metrics(spark, d), "ts"),
         "traces": (views.spans(spark, d), "ts")},
        ttl,
    )


def _pred_and_or():
    return And(Or(Cond("level", "=", "ERROR"), Cond("service", "=", "svc-2")), Cond("message", "contains", "TOOK"))


@query
def q_log_filter_total(spark, d):
    """Total matches of a search, before its page is cut."""
    return logops.total_count(views.logs(spark, d), _pred_and_or())


# --- reports E1–E11 --------------------------------------------------------------------------

@query
def q_metric_tier_read(spark, d):
    """E1"""
    tier = rollups.metric_rollup(views.metrics(spark, d), "1hour")
    return _metric_cols(reports.metric_tier_read(tier, METRIC_NAME, SERVICE, limit=30))


@query
def q_log_counts_by_level(spark, d):
    """E2"""
    return reports.log_counts_by_level(rollups.log_count_rollup(views.logs(spark, d), "1hour"), LOG_LEVEL, 100)


@query
def q_log_daily_totals(spark, d):
    """E3"""
    return reports.log_daily_totals(rollups.log_count_rollup(views.logs(spark, d), "1day"), SERVICE, 30)


@query
def q_top_error_patterns(spark, d):
    """E4 — also the flagship ``entry()`` query."""
    return reports.top_error_patterns(rollups.log_count_rollup(views.logs(spark, d), "1day"), days=7, limit=10)


@query
def q_span_perf_ms(spark, d):
    """E5"""
    out = reports.span_perf_ms(rollups.span_stats_rollup(views.spans(spark, d), "1hour"), SERVICE, 100)
    return out.withColumn("p95_ms", F.round("p95_ms", 8))


@query
def q_error_rate(spark, d):
    """E6"""
    stats = rollups.span_stats_rollup(views.spans(spark, d), "1day", percentiles=False)
    return reports.error_rate(stats, days=7, min_rate_pct=1.0)


def _rounded_day_stats(spark, d):
    stats = rollups.span_stats_rollup(views.spans(spark, d), "1day")
    for c in rollups.SPAN_PERCENTILES:
        stats = stats.withColumn(c, F.round(c, PCT_ROUND))
    return stats


@query
def q_slowest_operations(spark, d):
    """E7"""
    newest = reports.newest_bucket(views.spans(spark, d), "1day")
    out = reports.slowest_operations(_rounded_day_stats(spark, d), days=7, limit=10, as_of=newest)
    return out.withColumn("p99_ms", F.round("p99_ms", MS_ROUND))


@query
def q_latency_trend(spark, d):
    """E8"""
    newest = reports.newest_bucket(views.spans(spark, d), "1day")
    out = reports.latency_trend(_rounded_day_stats(spark, d), days=30, as_of=newest)
    return out.withColumns({c: F.round(c, MS_ROUND) for c in ("avg_ms", "p95_ms", "p99_ms")})


@query
def q_spans_per_trace(spark, d):
    """E9"""
    return reports.spans_per_trace(rollups.trace_stats_rollup(views.spans(spark, d), "1day"), SERVICE, 30)


@query
def q_trace_complexity(spark, d):
    """E10"""
    return reports.trace_complexity(rollups.trace_stats_rollup(views.spans(spark, d), "1day"))


@query
def q_pattern_counts(spark, d):
    """E11"""
    return reports.pattern_counts(views.logs(spark, d), limit=10)


# --- sort / limit L1–L7 ----------------------------------------------------------------------

@query
def q_logs_order_ts(spark, d):
    """L1: newest 100 logs."""
    return _log_cols(logops.search_logs(views.logs(spark, d), order=logops.OrderBy("timestamp"), limit=100))


@query
def q_logs_order_level(spark, d):
    """L2: least severe first."""
    return _log_cols(logops.search_logs(views.logs(spark, d), order=logops.OrderBy("level", False), limit=50))


@query
def q_logs_order_service(spark, d):
    """L3"""
    return _log_cols(logops.search_logs(views.logs(spark, d), order=logops.OrderBy("service", True), limit=50))


@query
def q_logs_limit(spark, d):
    """L4"""
    return _log_cols(logops.search_logs(views.logs(spark, d), Cond("level", "=", LOG_LEVEL), limit=25))


@query
def q_logs_limit_offset(spark, d):
    """L5"""
    return _log_cols(logops.search_logs(views.logs(spark, d), Cond("level", "=", LOG_LEVEL), limit=20, offset=40))


@query
def q_logs_deep_page(spark, d):
    """A page far from the start, from the hours that hold it."""
    return _log_cols(deep_pages.page_at(views.logs(spark, d), offset=640, limit=75))


@query
def q_traces_recent(spark, d):
    """L7"""
    return _trace_cols(traces.recent_traces(traces.find_traces(views.spans(spark, d)), 100))


# --- scalar N1 -------------------------------------------------------------------------------

@query
def q_normalize_message(spark, d):
    """N1 over every log message."""
    return views.logs(spark, d).select("log_id", normalize_message("message").alias("normalized_message"))


@query
def q_normalize_documents(spark, d):
    """N1 over whole document texts (long multilingual messages)."""
    return views.doc_logs(spark, d).select("log_id", normalize_message("message").alias("normalized_message"))


# --- retention M4 ----------------------------------------------------------------------------

def _retained(df: DataFrame, ttl: int) -> DataFrame:
    return apply_retention(df, ttl, df.select(F.max("ts")).scalar())


@query
def q_retention_logs(spark, d):
    """M4"""
    return _retained(views.logs(spark, d), RETENTION_TTL["logs"]).select("log_id")


@query
def q_retention_metrics(spark, d):
    """M4"""
    return _retained(views.metrics(spark, d), RETENTION_TTL["metrics"]).select("point_id")


@query
def q_retention_spans(spark, d):
    """M4"""
    return _retained(views.spans(spark, d), RETENTION_TTL["traces"]).select("trace_id", "span_id")


# --- predicates F1–F15 -----------------------------------------------------------------------

def _pred_query(name: str, pred, doc: str):
    def run(spark, d):
        return _log_cols(where_(views.logs(spark, d), pred))

    run.__name__ = name
    run.__doc__ = doc
    return query(run)


PREDICATES = {
    "q_pred_string_eq": (Cond("service", "=", "SVC-3"), "F1: case-insensitive equality"),
    "q_pred_string_ne_missing": (Cond("trace_id", "!=", "8-20240101"), "F1/F14: != keeps rows without the field"),
    "q_pred_string_range": (Cond("service", ">", "svc-5"), "F2: case-sensitive ordering"),
    "q_pred_contains": (Cond("message", "contains", "EXAMPLE.COM"), "F3"),
    "q_pred_starts_with": (Cond("message", "starts_with", "request"), "F4"),
    "q_pred_ends_with": (Cond("message", "ends_with", "MS"), "F5"),
    "q_pred_level_ge": (Cond("level", ">=", "Warn"), "F7: severity order"),
    "q_pred_ts_rfc3339": (
        And(Cond("timestamp", ">=", TS_FROM), Cond("timestamp", "<", TS_TO)), "F8: RFC 3339 bounds"
    ),
    "q_pred_ts_epoch": (Cond("timestamp", "<", EPOCH_SECONDS), "F9: epoch seconds"),
    "q_pred_attr_string": (Or(Cond("type", "=", "ERROR"), Cond("type", "starts_with", "Pur")), "F10"),
    "q_pred_attr_int": (Or(Cond("k", "!=", 50), Cond("k", "<", 10)), "F11/F14: missing k matches !="),
    "q_pred_attr_float": (
        Or(Or(Cond("value", ">", 250.5), Cond("value", "=", 100)), Cond("k", "<=", 3.0)),
        "F12: float compare; integer literal vs float attribute is FALSE",
    ),
    "q_pred_attr_bool": (
        Or(And(Cond("failed", "=", False), Cond("k", ">", 90)), Cond("failed", "contains", True)),
        "F13: boolean = / != only; other operators are FALSE",
    ),
    "q_pred_and_or": (_pred_and_or(), "F15: (a OR b) AND c"),
}

for _name, (_pred, _doc) in PREDICATES.items():
    _pred_query(_name, _pred, _doc)


@query
def q_log_contains_by_grams(spark, d):
    """F3 + F19: substrings looked for in the blocks of logs whose grams allow them."""
    logs = views.logs(spark, d).withColumn("block", F.call_function("div", F.col("log_id"), F.lit(BLOCK)))
    index = skip_index.gram_rows(logs, "message", "block")
    able = skip_index.holding(index, skip_index.wanted_grams(spark, skip_index.needles(NEEDLES, "message")), "block")
    return _log_cols(where_(logs.join(able, "block", "left_semi"), NEEDLES))


@query
def q_log_filter_range_level_service_contains(spark, d):
    """The store filter."""
    return _log_cols(
        logops.filter_logs(
            views.logs(spark, d),
            start_ns=parse_rfc3339_ns(TS_FROM),
            end_ns=parse_rfc3339_ns(TS_TO),
            level=LOG_LEVEL,
            service=SERVICE,
            message_contains="MS",
        )
    )


@query
def q_metric_list(spark, d):
    """F20 + D1/D2: one page of a metric's points, newest first."""
    m = metricops.list_metrics(views.metrics(spark, d), limit=logops.effective_limit(100, logops.METRIC_DEFAULT_LIMIT, logops.METRIC_MAX_LIMIT),
                               offset=100, name=METRIC_NAME)
    return m.select("point_id", "name", "value", "timestamp_ns")


@query
def q_metric_filter_labels(spark, d):
    """F20–F22"""
    m = metricops.filter_metrics(views.metrics(spark, d), metric_type="gauge", labels={"host": "1", "service": SERVICE})
    return m.select("point_id", "name", "value", "labels_key")


# --- traces T1–T7, J1–J3 ---------------------------------------------------------------------

@query
def q_trace_by_service(spark, d):
    """T1"""
    return _trace_cols(traces.find_traces(views.spans(spark, d), service=SERVICE))


@query
def q_trace_by_time(spark, d):
    """T2"""
    return _trace_cols(
        traces.find_traces(views.spans(spark, d), start_ns=parse_rfc3339_ns(TS_FROM), end_ns=parse_rfc3339_ns(TS_TO))
    )


@query
def q_trace_by_duration(spark, d):
    """T3"""
    return _trace_cols(traces.find_traces(views.spans(spark, d), min_duration_ms=3_600_000, max_duration_ms=36_000_000))


@query
def q_trace_by_status(spark, d):
    """T4"""
    return _trace_cols(traces.find_traces(views.spans(spark, d), status="error", service=SERVICE))


@query
def q_trace_fetch_semi(spark, d):
    """All spans of the newest page of traces touching a service."""
    sp = views.spans(spark, d)
    page = traces.recent_traces(traces.find_traces(sp, service=SERVICE), 100)
    return traces.fetch_spans(sp, page, bounded=True).select("trace_id", "span_id", "parent_span_id", "service", "start_ns")


@query
def q_trace_span_level(spark, d):
    """T6"""
    return traces.find_trace_ids_span_level(views.spans(spark, d), service=SERVICE, status="error", min_duration_ms=100)


@query
def q_trace_by_id(spark, d):
    """The trace with the smallest id."""
    sp = views.spans(spark, d)
    first = sp.select(F.min("trace_id")).scalar()
    return traces.trace_by_id(sp, first).select(
        "trace_id", "span_id", "parent_span_id", "name", "service", "start_ns", "end_ns"
    )


def _indexed(spark, d):
    index = trace_index.index_rows(views.spans(spark, d)).withColumn("dt", F.to_date("timestamp"))
    return index, trace_index.long_rows(index.drop("dt"))


@query
def q_trace_index(spark, d):
    """T1–T4 index: one row for each trace and day."""
    index, _ = _indexed(spark, d)
    return index.select("trace_id", F.col("dt").alias("day"), "span_count", "first_start_ns", "last_start_ns", "last_end_ns",
                        F.array_join("services", ",").alias("services"), F.array_join("statuses", ",").alias("statuses"))


@query
def q_trace_search_indexed(spark, d):
    """T1–T4 together, answered from the index."""
    return _trace_cols(trace_index.search(
        *_indexed(spark, d), service=SERVICE, status="error", start_ns=parse_rfc3339_ns(TS_FROM), end_ns=parse_rfc3339_ns(TS_TO),
        min_duration_ms=1000))


@query
def q_trace_fetch_indexed(spark, d):
    """All spans of the newest page of the index, from the traces' days."""
    page = traces.recent_traces(trace_index.search(*_indexed(spark, d), service=SERVICE, end_ns=parse_rfc3339_ns(TS_TO)), 100)
    return trace_index.fetch_spans(views.spans(spark, d), page).select("trace_id", "span_id", "service", "start_ns")


@query
def q_log_trace_join(spark, d):
    """J2"""
    return traces.correlate_logs(views.logs(spark, d), views.spans(spark, d)).select(
        "log_id", "trace_id", "span_id", "span_name", "span_service", "span_status", "duration_ns"
    )


@query
def q_span_parent_child(spark, d):
    """J3"""
    return traces.span_tree(views.spans(spark, d))


@query
def q_span_tree(spark, d):
    """Root, depth, subtree and critical path of every span."""
    return span_tree.whole_tree(views.spans(spark, d))


@query
def q_span_orphans(spark, d):
    """Spans whose parent is missing from their trace (left anti join)."""
    return traces.orphan_spans(views.spans(spark, d)).select("trace_id", "span_id", "parent_span_id")


@query
def q_log_orphans(spark, d):
    """Logs carrying span ids that match no span (left anti join)."""
    return traces.correlate_logs(views.logs(spark, d), views.spans(spark, d), "left_anti").select(
        "log_id", "trace_id", "span_id"
    )


# --- Spark SQL over the registered views (F23, D24) -------------------------------------------

@query
def q_sql_select_star(spark, d):
    """``SELECT *`` with WHERE / ORDER BY / LIMIT, written as Spark SQL on the logs view."""
    register_views(spark, d, ["logs"])
    return spark.sql(
        f"SELECT * FROM logs WHERE level = '{LOG_LEVEL}' AND lower(service) = '{SERVICE}' "
        "ORDER BY timestamp_ns DESC, log_id LIMIT 50"
    ).select("log_id", "level", "service", "message", "timestamp_ns")


@query
def q_sql_rollup_read(spark, d):
    """A documented rollup query (grouped read of a tier view) as Spark SQL."""
    register_views(spark, d, ["logs_1day_counts"])
    return spark.sql(
        "SELECT service, normalized_message, sum(count) AS total_count, min(sample_message) AS example "
        f"FROM logs_1day_counts WHERE level = '{LOG_LEVEL}' GROUP BY service, normalized_message"
    )


# --- ingest I1–I8, O1–O7 (requests derived from the tables, one per row) ----------------------

def _variant(col: str, key: str, typ: str):
    return F.try_variant_get(F.col("attributes")[key], "$", typ).alias(col)


@query
def q_ingest_native_logs(spark, d):
    """I1 + I7 + I14: native log requests parsed, defaulted and validated."""
    valid, _ = split_valid(native_json.normalize_logs(wire.native_log_requests(views.logs(spark, d))),
                           log_reject_reason())
    return valid.select(_variant("log_id", "log_id", "bigint"), "timestamp_ns", "level", "message", "service",
                        "trace_id", "span_id", _variant("k", "k", "bigint"), _variant("type", "type", "string"))


@query
def q_ingest_native_log_rejects(spark, d):
    """I7 + I8: the quarantine report of the same requests."""
    _, rejected = split_valid(native_json.normalize_logs(wire.native_log_requests(views.logs(spark, d))),
                              log_reject_reason())
    return reject_report(rejected)


@query
def q_ingest_otlp_log_batches(spark, d):
    """I4 + O5/O6: requests of many records under several resources."""
    valid, _ = split_valid(otlp.flatten_logs(wire.otlp_log_batches(views.logs(spark, d))), log_reject_reason())
    return valid.select(_variant("log_id", "log_id", "bigint"), "timestamp_ns", "level", "message", "service", "trace_id", "span_id")


@query
def q_ingest_otlp_histograms(spark, d):
    """I5 + I15: histogram points with bounds and counts."""
    valid, _ = split_valid(otlp.flatten_metrics(wire.otlp_histogram_requests(views.metrics(spark, d))), metric_reject_reason())
    return valid.select(
        F.col("labels")["point_id"].cast("bigint").alias("point_id"), "name", "metric_type", "value", "hist_count", "service",
        F.size("buckets").alias("n_buckets"), bucket_total("buckets").alias("bucket_total"),
        F.element_at("buckets", -1)["upper_bound"].alias("last_bound"),
    )


@query
def q_metric_filter_time(spark, d):
    """one metric's points in a time range."""
    m = metricops.filter_metrics(views.metrics(spark, d), name=METRIC_NAME, start_ns=parse_rfc3339_ns(TS_FROM), end_ns=parse_rfc3339_ns(TS_TO))
    return m.select("point_id", "name", "value", "timestamp_ns")


@query
def q_attributes_text(spark, d):
    """Attributes as JSON text."""
    text = attributes_as_text("attributes")
    return views.logs(spark, d).select("log_id", text["type"].alias("type_text"), text["failed"].alias("failed_text"), text["k"].alias("k_text"))


@query
def q_ingest_otlp_log_rejects(spark, d):
    """I4 + I7 + I8: requests of which some are cut short or hold a malformed time."""
    raw = wire.otlp_log_requests(views.logs(spark, d), damaged=True)
    return outcome_report(otlp.tag_requests(raw, otlp.flatten_logs(raw), log_reject_reason()))


@query
def q_ingest_metric_rejects(spark, d):
    """I5 + I7 + I8: also points without a value."""
    raw = wire.otlp_metric_requests(views.metrics(spark, d), damaged=True)
    return outcome_report(otlp.tag_requests(raw, otlp.flatten_metrics(raw), metric_reject_reason()))


@query
def q_ingest_span_rejects(spark, d):
    """I6 + I7 + I8: also spans that end before they start."""
    raw = wire.otlp_span_requests(views.spans(spark, d), damaged=True)
    return outcome_report(otlp.tag_requests(raw, otlp.flatten_spans(raw), span_reject_reason()))


@query
def q_ingest_native_spans(spark, d):
    """Native span requests (end = start + duration_ms)."""
    valid, _ = split_valid(native_json.normalize_spans(wire.native_span_requests(views.spans(spark, d))),
                           span_reject_reason())
    return valid.select("trace_id", "span_id", "parent_span_id", "name", "service", "kind", "status",
                        "start_ns", "end_ns")


@query
def q_ingest_native_metrics(spark, d):
    """Native metric requests."""
    valid, _ = split_valid(native_json.normalize_metrics(wire.native_metric_requests(views.metrics(spark, d))),
                           metric_reject_reason())
    return valid.select("name", "metric_type", "value", "timestamp_ns", labels_key("labels").alias("labels_key"),
                        "service")


@query
def q_ingest_otlp_logs(spark, d):
    """I4 + O1–O7: OTLP log requests flattened (severity, hex ids, typed attributes, resource.*)."""
    valid, _ = split_valid(otlp.flatten_logs(wire.otlp_log_requests(views.logs(spark, d))), log_reject_reason())
    return valid.select(
        _variant("log_id", "log_id", "bigint"), "timestamp_ns", "level", "message", "service", "trace_id", "span_id",
        _variant("k", "k", "bigint"), _variant("type", "type", "string"), _variant("value", "value", "double"),
        _variant("failed", "failed", "boolean"), _variant("host", "resource.host", "string"),
    )


@query
def q_ingest_otlp_nested(spark, d):
    """O1–O3 + O6 + N3: strings with brackets and escapes, wire-like and missing keys, values nested ten deep."""
    valid, _ = split_valid(otlp.flatten_logs(wire.otlp_nested_requests(views.logs(spark, d))), log_reject_reason())
    text = F.col("text")  # a column of its own, so the map is made once and not per key
    return valid.withColumn("text", attributes_as_text("attributes")).select(
        _variant("log_id", "log_id", "bigint"), "ts", "message", text["list"].alias("list_text"), text["deep"].alias("deep_text"),
        text[""].alias("unnamed_text"), text["resource."].alias("resource_text"), F.size("attributes").alias("n_attributes"),
    )


@query
def q_ingest_otlp_spans(spark, d):
    """I6 + O5/O7: OTLP span requests flattened."""
    valid, _ = split_valid(otlp.flatten_spans(wire.otlp_span_requests(views.spans(spark, d))), span_reject_reason())
    return valid.select("trace_id", "span_id", "parent_span_id", "name", "service", "kind", "status", "start_ns",
                        "end_ns", "duration_ns", _variant("operation", "operation", "string"))


@query
def q_ingest_otlp_metrics(spark, d):
    """I5 + O3/O5/O7: OTLP gauge and monotonic-sum points flattened."""
    valid, _ = split_valid(otlp.flatten_metrics(wire.otlp_metric_requests(views.metrics(spark, d))),
                           metric_reject_reason())
    return valid.select("name", "metric_type", "value", "timestamp_ns", labels_key("labels").alias("labels_key"),
                        "service", "unit")


def registry() -> dict[str, Query]:
    return dict(REGISTRY)
