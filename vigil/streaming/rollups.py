"""M1: rollups maintained incrementally with Structured Streaming.

Tumbling event-time windows with a watermark, emitted in append mode to a
Parquet file sink (exactly-once through the sink's metadata log and the
query checkpoint). Data later than the watermark is dropped here and counted
(:func:`late_rows_dropped`) — use
:mod:`vigil.streaming.ingest` (M2) when every late row must count, as it
does in the reference's materialised views.

State is bounded per window group: count/sum/min/max, HyperLogLog++ for
distinct traces (exact distinct is not supported on streams, D14) and a
``percentile_approx`` sketch for latency percentiles.
"""

from __future__ import annotations

import json

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from vigil.functions.model import labels_hash, labels_key
from vigil.functions.normalize import normalize_message
from vigil.operators.rollups import SPAN_PERCENTILES
from vigil.session import stream_checkpoint

# Tier -> tumbling window width for event-time windows.
WINDOWS = {"1min": "1 minute", "5min": "5 minutes", "1hour": "1 hour", "1day": "1 day"}
PERCENTILE_ACCURACY = 10_000


def _window(tier: str):
    if tier not in WINDOWS:
        raise ValueError(f"unknown tier {tier!r}")
    return F.window("ts", WINDOWS[tier])


def stream_metric_rollup(metrics: DataFrame, tier: str, watermark: str = "10 minutes") -> DataFrame:
    if "labels_key" not in metrics.columns:  # as ingested
        metrics = metrics.withColumn("labels_key", labels_key("labels"))
    out = (
        metrics.withWatermark("ts", watermark)
        .groupBy(_window(tier).alias("w"), "name", "metric_type", "service", "labels_key")
        .agg(
            F.count(F.lit(1)).alias("count"),
            F.sum("value").alias("_sum"),
            F.min("value").alias("min"),
            F.max("value").alias("max"),
        )
    )
    return out.select(
        F.col("w.start").alias("timestamp"), "name", "metric_type", "service", "labels_key", "count",
        F.col("_sum").alias("sum"), "min", "max",
        (F.col("_sum") / F.col("count")).alias("avg"), labels_hash("labels_key").alias("labels_hash"),
    )


def stream_log_counts(logs: DataFrame, tier: str, watermark: str = "10 minutes") -> DataFrame:
    out = (
        logs.withWatermark("ts", watermark)
        .groupBy(_window(tier).alias("w"), "level", "service", normalize_message("message").alias("normalized_message"))
        .agg(F.count(F.lit(1)).alias("count"), F.min("message").alias("sample_message"))
    )
    return out.select(F.col("w.start").alias("timestamp"), "level", "service", "normalized_message", "count",
                      "sample_message")


def stream_span_stats(spans: DataFrame, tier: str, watermark: str = "10 minutes") -> DataFrame:
    pct = [
        F.percentile_approx("duration_ns", p, PERCENTILE_ACCURACY).cast("double").alias(name)
        for name, p in SPAN_PERCENTILES.items()
    ]
    out = (
        spans.withWatermark("ts", watermark)
        .groupBy(_window(tier).alias("w"), "service", "operation", F.col("kind").alias("span_kind"),
                 F.col("status").alias("status_code"))
        .agg(F.count(F.lit(1)).alias("span_count"), F.sum("duration_ns").alias("_sum"),
             F.min("duration_ns").alias("min_duration_ns"), F.max("duration_ns").alias("max_duration_ns"), *pct)
    )
    return out.select(
        F.col("w.start").alias("timestamp"), "service", "operation", "span_kind", "status_code", "span_count",
        (F.col("_sum").cast("double") / F.col("span_count")).alias("avg_duration_ns"),
        "min_duration_ns", "max_duration_ns", *SPAN_PERCENTILES,
    )


def stream_trace_stats(spans: DataFrame, tier: str, watermark: str = "10 minutes") -> DataFrame:
    out = (
        spans.withWatermark("ts", watermark)
        .groupBy(_window(tier).alias("w"), "service")
        .agg(F.approx_count_distinct("trace_id").alias("unique_traces"), F.count(F.lit(1)).alias("total_spans"))
    )
    return out.select(F.col("w.start").alias("timestamp"), "service", "unique_traces", "total_spans")


def start_parquet_sink(
    rollup: DataFrame,
    path: str,
    name: str,
    available_now: bool = False,
    processing_time: str | None = None,
    checkpoint: str | None = None,
) -> StreamingQuery:
    """Append a streaming rollup to a ``dt``-partitioned Parquet table.

    The checkpoint defaults to ``<spark.checkpoint.dir>/<name>`` (shared storage
    on a cluster), so a restarted or relocated driver resumes where it stopped.
    """
    location = stream_checkpoint(rollup.sparkSession, name, checkpoint)
    writer = (
        rollup.withColumn("dt", F.to_date("timestamp"))
        .writeStream.format("parquet")
        .outputMode("append")
        .option("checkpointLocation", location)
        .partitionBy("dt")
        .queryName(name)
    )
    if available_now:
        writer = writer.trigger(availableNow=True)
    elif processing_time:
        writer = writer.trigger(processingTime=processing_time)
    return writer.start(path)


def late_rows_dropped(query: StreamingQuery) -> int:
    """Rows the watermark has dropped, as far as the query's recent progress tells."""
    return sum(
        int(state.get("numRowsDroppedByWatermark", 0))
        for progress in query.recentProgress
        for state in (progress if isinstance(progress, dict) else json.loads(progress.json)).get("stateOperators", [])
    )
