"""Build small entity frames from literal rows for golden tests."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vigil.functions.model import level_order
from vigil.functions.timefn import ns_to_ts

BASE_NS = 1_700_000_000_000_000_000


def logs_df(spark: SparkSession, rows: list[dict]) -> DataFrame:
    """rows: dicts with level, message, service and optional ts_ns, attributes, trace_id, span_id."""
    data = [
        (
            i,
            r.get("ts_ns", BASE_NS + i * 1_000_000_000),
            r.get("level", "info"),
            r["message"],
            r["service"],
            json.dumps(r.get("attributes", {})),
            r.get("trace_id"),
            r.get("span_id"),
        )
        for i, r in enumerate(rows)
    ]
    df = spark.createDataFrame(
        data,
        "log_id long, timestamp_ns long, level string, message string, service string, attrs string, "
        "trace_id string, span_id string",
    )
    return (
        df.withColumn("attributes", F.from_json("attrs", "map<string, variant>"))
        .drop("attrs")
        .withColumn("ts", ns_to_ts("timestamp_ns"))
        .withColumn("level_order", level_order("level"))
        .withColumn("dt", F.to_date("ts"))
    )


def metrics_df(spark: SparkSession, rows: list[dict]) -> DataFrame:
    data = [
        (
            i,
            r.get("ts_ns", BASE_NS + i * 1_000_000_000),
            r["name"],
            r.get("metric_type", "gauge"),
            float(r["value"]),
            r.get("labels", {}),
        )
        for i, r in enumerate(rows)
    ]
    df = spark.createDataFrame(
        data, "point_id long, timestamp_ns long, name string, metric_type string, value double, labels map<string,string>"
    )
    return (
        df.withColumn("ts", ns_to_ts("timestamp_ns"))
        .withColumn("service", F.coalesce(F.col("labels")["service"], F.lit("unknown")))
        .withColumn("dt", F.to_date("ts"))
    )


def spans_df(spark: SparkSession, rows: list[dict]) -> DataFrame:
    data = [
        (
            r["trace_id"],
            r["span_id"],
            r.get("parent_span_id"),
            r.get("name", "op"),
            r.get("service", "svc"),
            r.get("kind", "internal"),
            r.get("status", "ok"),
            r.get("start_ns", BASE_NS),
            r.get("start_ns", BASE_NS) + r.get("duration_ms", 0) * 1_000_000,
        )
        for r in rows
    ]
    df = spark.createDataFrame(
        data,
        "trace_id string, span_id string, parent_span_id string, name string, service string, kind string, "
        "status string, start_ns long, end_ns long",
    )
    return (
        df.withColumn("operation", F.col("name"))
        .withColumn("duration_ns", F.greatest(F.col("end_ns") - F.col("start_ns"), F.lit(0)))
        .withColumn("ts", ns_to_ts("start_ns"))
        .withColumn("dt", F.to_date("ts"))
    )
