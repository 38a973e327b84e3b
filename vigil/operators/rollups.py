"""Rollups A1–A11: the ten continuous aggregates plus tier-up merging.

Each rollup is the materialised view's SELECT over the full data (D12/D13):
a ``groupBy`` whose partial aggregate runs map-side, so the shuffle carries
one row per (map task, group) rather than raw rows.

Metric values are summed in their own type (DOUBLE), so small, huge and
non-finite values come through; the last bits of a sum depend on the order in
which Spark merges partial sums.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vigil.functions.model import labels_hash, labels_key
from vigil.functions.normalize import normalize_message
from vigil.functions.timefn import TIERS, bucket_start
from vigil.operators.quantiles import grouped_percentiles

# ---------------------------------------------------------------------------
# FIXED VALUES — tier retention in days, as configured by the reference.
# ---------------------------------------------------------------------------
ROLLUP_RETENTION_DAYS = {
    "metrics_1min": 30,
    "metrics_5min": 90,
    "metrics_1hour": 365,
    "metrics_1day": 730,
    "logs_1hour_counts": 365,
    "logs_1day_counts": 730,
    "spans_1hour_stats": 365,
    "spans_1day_stats": 730,
    "traces_1hour_stats": 365,
    "traces_1day_stats": 730,
}
SPAN_PERCENTILES = {"p50_duration_ns": 0.5, "p95_duration_ns": 0.95, "p99_duration_ns": 0.99}

METRIC_KEYS = ["timestamp", "name", "metric_type", "service", "labels_key"]


def _check_tier(tier: str) -> None:
    if tier not in TIERS:
        raise ValueError(f"unknown tier {tier!r}; expected one of {sorted(TIERS)}")


def metric_rollup(metrics: DataFrame, tier: str) -> DataFrame:
    """A1–A4: per bucket, name, type, service and label set — count/sum/min/max/avg."""
    _check_tier(tier)
    src = metrics
    if "labels_key" not in src.columns:
        src = src.withColumn("labels_key", labels_key("labels"))
    grouped = src.groupBy(
        bucket_start("ts", tier).alias("timestamp"), "name", "metric_type", "service", "labels_key"
    ).agg(
        F.count(F.lit(1)).alias("count"),
        F.sum("value").alias("_sum"),
        F.min("value").alias("min"),
        F.max("value").alias("max"),
        F.any_value("labels").alias("labels"),
    )
    return _finish_metric(grouped)


def _finish_metric(grouped: DataFrame) -> DataFrame:
    return grouped.select(
        *METRIC_KEYS,
        "count",
        F.col("_sum").alias("sum"),
        "min",
        "max",
        (F.col("_sum") / F.col("count")).alias("avg"),
        labels_hash("labels_key").alias("labels_hash"),
        "labels",
    )


def tier_up(rollup: DataFrame, tier: str) -> DataFrame:
    """Build a coarser metric tier from a finer one.

    count and sum add, min/max reduce, avg = sum / count: the direct rollup of
    the raw points, to the rounding of the sums.
    """
    _check_tier(tier)
    grouped = rollup.groupBy(
        bucket_start("timestamp", tier).alias("timestamp"), "name", "metric_type", "service", "labels_key"
    ).agg(
        F.sum("count").alias("count"),
        F.sum("sum").alias("_sum"),
        F.min("min").alias("min"),
        F.max("max").alias("max"),
        F.any_value("labels").alias("labels"),
    )
    return _finish_metric(grouped)


def log_count_rollup(logs: DataFrame, tier: str) -> DataFrame:
    """Counts per bucket, level, service and normalised message.

    ``sample_message`` is ``min(message)`` — a deterministic stand-in for the
    reference's ``any`` (D16). The pattern is computed in the projection below
    the partial aggregate, i.e. before the shuffle.
    """
    _check_tier(tier)
    src = logs if "normalized_message" in logs.columns else logs.withColumn(
        "normalized_message", normalize_message("message")
    )
    return src.groupBy(
        bucket_start("ts", tier).alias("timestamp"), "level", "service", "normalized_message"
    ).agg(F.count(F.lit(1)).alias("count"), F.min("message").alias("sample_message"))


def log_tier_up(rollup: DataFrame, tier: str) -> DataFrame:
    """Build a coarser log tier from a finer one: counts add, the sample is the least message."""
    _check_tier(tier)
    return rollup.groupBy(
        bucket_start("timestamp", tier).alias("timestamp"), "level", "service", "normalized_message"
    ).agg(F.sum("count").alias("count"), F.min("sample_message").alias("sample_message"))


def span_stats_rollup(spans: DataFrame, tier: str, percentiles: bool = True) -> DataFrame:
    """Span count, avg/min/max and exact p50/p95/p99 of duration_ns.

    Percentiles come from the sort-based :func:`grouped_percentiles`, which
    splits hot groups across range partitions instead of holding a whole group
    in one task. ``percentiles=False`` builds the tier without them — a plain
    partial aggregate — for readers that only need counts and means.
    """
    _check_tier(tier)
    keys = ["timestamp", "service", "operation", "span_kind", "status_code"]
    src = spans.select(
        bucket_start("ts", tier).alias("timestamp"),
        "service",
        "operation",
        F.col("kind").alias("span_kind"),
        F.col("status").alias("status_code"),
        "duration_ns",
    )
    if not percentiles:
        stats = src.groupBy(*keys).agg(
            F.count("duration_ns").alias("n"),
            F.sum("duration_ns").alias("sum_v"),
            F.min("duration_ns").alias("min_v"),
            F.max("duration_ns").alias("max_v"),
        )
        return stats.select(
            *keys,
            F.col("n").alias("span_count"),
            (F.col("sum_v").cast("double") / F.col("n")).alias("avg_duration_ns"),
            F.col("min_v").alias("min_duration_ns"),
            F.col("max_v").alias("max_duration_ns"),
        )
    return span_columns(grouped_percentiles(src, keys, "duration_ns", SPAN_PERCENTILES))


def span_columns(stats: DataFrame) -> DataFrame:
    """Grouped statistics of durations under the names of the span tiers."""
    return stats.select(
        "timestamp", "service", "operation", "span_kind", "status_code",
        F.col("n").alias("span_count"),
        (F.col("sum_v").cast("double") / F.col("n")).alias("avg_duration_ns"),
        F.col("min_v").alias("min_duration_ns"),
        F.col("max_v").alias("max_duration_ns"),
        *SPAN_PERCENTILES.keys(),
    )


def trace_stats_rollup(spans: DataFrame, tier: str, approximate: bool = False, sketch: bool = False) -> DataFrame:
    """Distinct traces and span count per bucket and service; ``sketch`` adds the traces'
    mergeable sketch (:mod:`vigil.operators.states`), as stored tiers have it.

    Batch uses an exact distinct count (D14); Spark plans it as a two-level
    aggregate keyed first by (group, trace_id), so a hot service is spread by
    trace id. ``approximate=True`` uses HyperLogLog++ (needed on streams).
    """
    _check_tier(tier)
    if sketch:
        from vigil.operators.states import trace_members, trace_stats

        return trace_stats(trace_members(spans, tier), tier)
    distinct = F.approx_count_distinct("trace_id") if approximate else F.count_distinct("trace_id")
    return spans.groupBy(bucket_start("ts", tier).alias("timestamp"), "service").agg(
        distinct.alias("unique_traces"), F.count(F.lit(1)).alias("total_spans")
    )


# Which rollups each entity feeds, by table name pattern.
ROLLUPS_BY_KIND = {
    "logs": {"logs_{tier}_counts": log_count_rollup},
    "metrics": {"metrics_{tier}": metric_rollup},
    "spans": {"spans_{tier}_stats": span_stats_rollup, "traces_{tier}_stats": trace_stats_rollup},
}
TIERS_BY_KIND = {"logs": ("1hour", "1day"), "metrics": ("1min", "5min", "1hour", "1day"), "spans": ("1hour", "1day")}


# How a coarser tier of a kind follows from a finer one (percentiles and distinct counts do not).
TIER_UP = {"metrics": tier_up, "logs": log_tier_up}


def overwrite_days(table: DataFrame, path: str) -> None:
    """Replace exactly the ``dt`` partitions that ``table`` holds, whatever the session's overwrite mode."""
    table.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("dt").parquet(path)


def write_rollups(df: DataFrame, kind: str, out_root: str, tiers=None, policy=None) -> list[str]:
    """Materialise the rollup tiers fed by ``df`` (an entity frame of ``kind``).

    Each tier goes to ``<out_root>/<table>`` partitioned by ``dt`` with dynamic
    partition overwrite, so a re-run replaces exactly the days it recomputes. Raw
    metrics and logs are read for the finest tier only; a coarser one is built from
    the stored days of the finer one just written (A11).
    ``policy`` (an ``AggregationPolicy``) switches tiers off (M6). Returns the
    tables written.
    """
    if kind not in ROLLUPS_BY_KIND:
        raise ValueError(f"unknown entity kind {kind!r}")
    written = []
    finer = None  # the stored finer tier that a coarser one can be built from
    days = (df if "dt" in df.columns else df.withColumn("dt", F.to_date("ts"))).select("dt").distinct()
    for tier in sorted(tiers or TIERS_BY_KIND[kind], key=list(TIERS).index):
        for pattern, fn in ROLLUPS_BY_KIND[kind].items():
            name = pattern.format(tier=tier)
            if policy is not None and not policy.is_enabled(name):
                continue
            out = f"{out_root.rstrip('/')}/{name}"
            if finer is not None and kind in TIER_UP:
                stored = df.sparkSession.read.parquet(finer).join(days, "dt", "left_semi")
                table = TIER_UP[kind](stored, tier)
            else:
                table = fn(df, tier, sketch=True) if fn is trace_stats_rollup else fn(df, tier)
            overwrite_days(table.withColumn("dt", F.to_date("timestamp")), out)
            finer = out
            written.append(name)
    return written
