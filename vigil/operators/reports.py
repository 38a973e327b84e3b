"""The documented analytics over the rollup tiers.

``now() - INTERVAL n DAY`` predicates take an explicit ``as_of`` Column; the
default is the newest bucket in the tier (a scalar subquery), which keeps the
reports reproducible. Every top-k has a unique tie-break so the cut is
deterministic.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vigil.functions.model import is_error_status
from vigil.functions.normalize import normalize_message
from vigil.functions.timefn import bucket_start

NS_PER_MS = 1_000_000.0


def _as_of(tier: DataFrame, as_of: Column | None) -> Column:
    return as_of if as_of is not None else tier.select(F.max("timestamp")).scalar()


def _since(tier: DataFrame, days: int | None, as_of: Column | None) -> DataFrame:
    if days is None:
        return tier
    return tier.where(F.col("timestamp") >= _as_of(tier, as_of) - F.make_interval(days=F.lit(days)))


def newest_bucket(entities: DataFrame, tier: str, ts: str = "ts") -> Column:
    """The newest bucket of a tier, from the raw rows it is built of.

    A report whose tier is computed rather than stored should take its ``as_of``
    from here: the default plans the whole tier once more for its newest bucket.
    """
    return entities.select(bucket_start(F.max(ts), tier)).scalar()


def metric_tier_read(tier: DataFrame, name: str, service: str | None = None, limit: int = 30) -> DataFrame:
    """Newest buckets of one metric (optionally one service)."""
    out = tier.where(F.col("name") == F.lit(name))
    if service is not None:
        out = out.where(F.col("service") == F.lit(service))
    return out.orderBy(
        F.col("timestamp").desc(), "service", "metric_type", "labels_key"
    ).limit(limit)


def log_counts_by_level(hour_counts: DataFrame, level: str, limit: int = 100) -> DataFrame:
    """The largest hourly pattern counts of one level."""
    return (
        hour_counts.where(F.col("level") == F.lit(level))
        .select("timestamp", "level", "service", "normalized_message", "count", "sample_message")
        .orderBy(F.col("count").desc(), F.col("timestamp").desc(), "service", "normalized_message")
        .limit(limit)
    )


def log_daily_totals(day_counts: DataFrame, service: str, limit: int = 30) -> DataFrame:
    """Daily totals by service and pattern, largest first."""
    return (
        day_counts.where(F.col("service") == F.lit(service))
        .groupBy("timestamp", "service", "normalized_message")
        .agg(F.sum("count").alias("total_count"))
        .orderBy(F.col("total_count").desc(), F.col("timestamp").desc(), "normalized_message")
        .limit(limit)
    )


def top_error_patterns(
    day_counts: DataFrame, days: int = 7, limit: int = 10, level: str = "error", as_of: Column | None = None
) -> DataFrame:
    """Most frequent patterns of a level in the last ``days`` days."""
    return (
        _since(day_counts, days, as_of)
        .where(F.col("level") == F.lit(level))
        .groupBy("normalized_message")
        .agg(F.sum("count").alias("occurrences"), F.min("sample_message").alias("example"))
        .orderBy(F.col("occurrences").desc(), "normalized_message")
        .limit(limit)
    )


def span_perf_ms(hour_stats: DataFrame, service: str, limit: int = 100) -> DataFrame:
    """E5: span latency of a service in milliseconds, newest first."""
    return (
        hour_stats.where(F.col("service") == F.lit(service))
        .orderBy(F.col("timestamp").desc(), "operation", "span_kind", "status_code")
        .limit(limit)
        .select(
            "timestamp",
            "service",
            "operation",
            "span_kind",
            "status_code",
            (F.col("avg_duration_ns") / NS_PER_MS).alias("avg_ms"),
            (F.col("p95_duration_ns") / NS_PER_MS).alias("p95_ms"),
            "span_count",
        )
    )


def error_rate(
    day_stats: DataFrame, days: int | None = 7, min_rate_pct: float = 1.0, as_of: Column | None = None
) -> DataFrame:
    """Error share of spans per service and operation, above a threshold.

    Errors are *spans* with a non-ok status, weighted by span_count (D10, D11).
    """
    return (
        _since(day_stats, days, as_of)
        .groupBy("service", "operation")
        .agg(
            F.sum(F.when(is_error_status("status_code"), F.col("span_count")).otherwise(F.lit(0))).alias(
                "error_count"
            ),
            F.sum("span_count").alias("total_count"),
        )
        .withColumn("error_rate_pct", F.col("error_count") * F.lit(100.0) / F.col("total_count"))
        .where(F.col("error_rate_pct") > F.lit(min_rate_pct))
    )


def slowest_operations(
    day_stats: DataFrame, days: int | None = 7, limit: int = 10, as_of: Column | None = None
) -> DataFrame:
    """Operations with the highest mean daily p99."""
    return (
        _since(day_stats, days, as_of)
        .groupBy("service", "operation")
        .agg((F.avg("p99_duration_ns") / NS_PER_MS).alias("p99_ms"), F.sum("span_count").alias("total_spans"))
        .orderBy(F.col("p99_ms").desc(), "service", "operation")
        .limit(limit)
    )


def latency_trend(day_stats: DataFrame, days: int | None = 30, as_of: Column | None = None) -> DataFrame:
    """Daily mean of avg / p95 / p99 latency per service and operation."""
    return (
        _since(day_stats, days, as_of)
        .groupBy(F.to_date("timestamp").alias("date"), "service", "operation")
        .agg(
            (F.avg("avg_duration_ns") / NS_PER_MS).alias("avg_ms"),
            (F.avg("p95_duration_ns") / NS_PER_MS).alias("p95_ms"),
            (F.avg("p99_duration_ns") / NS_PER_MS).alias("p99_ms"),
        )
    )


def spans_per_trace(day_traces: DataFrame, service: str | None = None, limit: int = 30) -> DataFrame:
    """Spans per trace by day (and service)."""
    out = day_traces if service is None else day_traces.where(F.col("service") == F.lit(service))
    return (
        out.orderBy(F.col("timestamp").desc(), "service")
        .limit(limit)
        .select(
            "timestamp",
            "service",
            "unique_traces",
            "total_spans",
            (F.col("total_spans") / F.col("unique_traces")).alias("avg_spans_per_trace"),
        )
    )


def trace_complexity(day_traces: DataFrame) -> DataFrame:
    """Services ranked by spans per trace over all days."""
    return day_traces.groupBy("service").agg(
        F.sum("unique_traces").alias("total_traces"),
        (F.sum("total_spans") / F.sum("unique_traces")).alias("avg_complexity"),
    )


def pattern_counts(logs: DataFrame, limit: int | None = 10) -> DataFrame:
    """Raw messages next to their pattern, most frequent first.

    Grouped by message first, so each distinct message is normalised once.
    """
    out = (
        logs.groupBy("message")
        .agg(F.count(F.lit(1)).alias("cnt"))
        .withColumn("normalized_message", normalize_message("message"))
        .orderBy(F.col("cnt").desc(), "message")
    )
    return out.limit(limit) if limit is not None else out
