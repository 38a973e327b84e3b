"""Metric operators: filters (F20–F22) and scalar aggregates."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vigil.operators.logs import time_range

AGG_FUNCTIONS = ("sum", "avg", "min", "max", "count")


def filter_metrics(
    metrics: DataFrame,
    name: str | None = None,
    metric_type: str | None = None,
    start_ns: int | None = None,
    end_ns: int | None = None,
    labels: dict[str, str] | None = None,
) -> DataFrame:
    """F20–F22. Every requested label must be present with an equal value."""
    cond = time_range("timestamp_ns", start_ns, end_ns, "dt" if "dt" in metrics.columns else None)
    if name is not None:
        cond = cond & (F.col("name") == F.lit(name))
    if metric_type is not None:
        cond = cond & (F.col("metric_type") == F.lit(metric_type))
    if labels:
        matches = [F.coalesce(F.col("labels")[k] == F.lit(v), F.lit(False)) for k, v in labels.items()]
        cond = cond & reduce(lambda a, b: a & b, matches)
    return metrics.where(cond)


def list_metrics(
    metrics: DataFrame, limit: int | None = None, offset: int | None = None, id_col: str = "point_id", **filters
) -> DataFrame:
    """F20–F22 + D1: matching points newest first (unique ``id_col`` tie-break).

    ``limit`` is taken as given; :func:`vigil.operators.logs.page` has the API's page sizes (D2).
    """
    out = filter_metrics(metrics, **filters).orderBy(F.col("timestamp_ns").desc(), F.col(id_col).asc())
    if offset:
        out = out.offset(offset)
    return out if limit is None else out.limit(limit)


def _agg_column(function: str):
    fn = function.lower()
    if fn not in AGG_FUNCTIONS:
        raise ValueError(f"unknown aggregation {function!r}; expected one of {AGG_FUNCTIONS}")
    if fn == "sum":
        return F.coalesce(F.sum("value"), F.lit(0.0))
    if fn == "avg":
        return F.coalesce(F.avg("value"), F.lit(0.0))
    if fn == "min":
        return F.coalesce(F.min("value"), F.lit(0.0))
    if fn == "max":
        return F.coalesce(F.max("value"), F.lit(0.0))
    return F.count("value").cast("double")


def aggregate_metrics(
    metrics: DataFrame, function: str, include_histograms: bool = False, **filters
) -> DataFrame:
    """One row ``(value, count)`` over all matching points.

    Simple points only unless ``include_histograms`` (then a histogram
    contributes its sum). No limit/offset is applied; empty input gives (0.0, 0).
    """
    src = filter_metrics(metrics, **filters)
    if not include_histograms and "metric_type" in src.columns:
        src = src.where(F.col("metric_type") != F.lit("histogram"))
    return src.agg(_agg_column(function).alias("value"), F.count("value").alias("count"))


def aggregate_metrics_windowed(
    metrics: DataFrame, function: str, window: str, by: list[str] | None = None, **filters
) -> DataFrame:
    """The same aggregate per tumbling time window (and optional keys)."""
    src = filter_metrics(metrics, **filters)
    keys = [F.window("ts", window).start.alias("window_start")] + [F.col(k) for k in (by or [])]
    return src.groupBy(*keys).agg(_agg_column(function).alias("value"), F.count("value").alias("count"))
