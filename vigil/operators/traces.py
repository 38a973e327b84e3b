"""Trace operators: assembly (A22), trace-level filters (T1–T4), fetch (T5/J1),
span-level search (T6), lookup (T7), log/trace correlation (J2), span tree (J3)
and newest-first listing (L7).

Everything keyed by ``trace_id`` is an aggregate with a map-side partial
step, so a trace with millions of spans is pre-combined before the shuffle;
joins back to spans rely on AQE skew-join splitting for hot traces.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vigil.functions.timefn import ns_to_ms
from vigil.operators.logs import time_range


def trace_summary(spans: DataFrame) -> DataFrame:
    """One row per trace — span count, sorted distinct services, time bounds,
    duration and the root span (earliest span without a parent)."""
    root_order = F.when(F.col("parent_span_id").isNull(), F.struct("start_ns", "span_id"))
    root = F.struct(F.col("span_id").alias("span_id"), F.col("name").alias("name"), F.col("service").alias("service"))
    return (
        spans.groupBy("trace_id")
        .agg(
            F.count(F.lit(1)).alias("span_count"),
            F.array_sort(F.collect_set("service")).alias("services"),
            F.min("start_ns").alias("start_ns"),
            F.max("end_ns").alias("end_ns"),
            F.min_by(root, root_order).alias("root"),
        )
        .withColumn("duration_ns", F.col("end_ns") - F.col("start_ns"))
        .withColumn("duration_ms", ns_to_ms("duration_ns"))
    )


def find_traces(
    spans: DataFrame,
    service: str | None = None,
    start_ns: int | None = None,
    end_ns: int | None = None,
    min_duration_ms: int | None = None,
    max_duration_ms: int | None = None,
    status: str | None = None,
    prefilter: bool = True,
) -> DataFrame:
    """T1–T4 at trace level (D7): each predicate may be met by a different span;
    duration is the whole trace's, truncated to ms, inclusive bounds.

    Candidate trace ids come first: those with a span that meets the predicate,
    for each of service, status and time range (a trace that overlaps the range has
    a span that starts at or after ``start_ns``, and one before ``end_ns``). These
    filters are pushed to the scan, with ``dt`` bounds for the range; a semi join
    then leaves only the candidates' spans to shuffle and aggregate, all of them, so
    the summaries stay whole-trace. ``prefilter=False`` aggregates every trace.
    A stored deployment searches :mod:`vigil.operators.trace_index` instead, which reads
    no span outside the days of the range.
    """
    tests = [F.col(c) == F.lit(v) for c, v in (("service", service), ("status", status)) if v is not None]
    day = "dt" if "dt" in spans.columns else None
    # both bounds of a range: either alone leaves all older or all newer traces as candidates
    if start_ns is not None:
        tests.append(time_range("start_ns", start_ns, None, day))
    if end_ns is not None:
        tests.append(time_range("start_ns", None, end_ns, day))
    if prefilter and tests:
        source = spans
        for test in tests:
            ids = source.where(test).select("trace_id").distinct()
            spans = spans.join(ids, "trace_id", "left_semi")
    flags = []
    if service is not None:
        flags.append(F.bool_or(F.col("service") == F.lit(service)).alias("_svc"))
    if status is not None:
        flags.append(F.bool_or(F.col("status") == F.lit(status)).alias("_status"))
    summary_cols = [
        F.count(F.lit(1)).alias("span_count"),
        F.array_sort(F.collect_set("service")).alias("services"),
        F.min("start_ns").alias("start_ns"),
        F.max("start_ns").alias("last_start_ns"),
        F.max("end_ns").alias("end_ns"),
    ]
    traces = spans.groupBy("trace_id").agg(*summary_cols, *flags).withColumn(
        "duration_ms", ns_to_ms(F.col("end_ns") - F.col("start_ns"))
    )
    cond = F.lit(True)
    if service is not None:
        cond = cond & F.col("_svc")
    if status is not None:
        cond = cond & F.col("_status")
    if start_ns is not None:
        cond = cond & (F.col("last_start_ns") >= F.lit(start_ns))
    if end_ns is not None:
        cond = cond & (F.col("start_ns") < F.lit(end_ns))
    if min_duration_ms is not None:
        cond = cond & (F.col("duration_ms") >= F.lit(min_duration_ms))
    if max_duration_ms is not None:
        cond = cond & (F.col("duration_ms") <= F.lit(max_duration_ms))
    keep = ["trace_id", "span_count", "services", "start_ns", "end_ns", "duration_ms"]
    return traces.where(cond).select(*keep)


def recent_traces(traces: DataFrame, limit: int = 100) -> DataFrame:
    """Newest first by earliest start, ``trace_id`` tie-break (page sizes are the API's, D2)."""
    return traces.orderBy(F.col("start_ns").desc(), F.col("trace_id").desc()).limit(limit)


def fetch_spans(spans: DataFrame, trace_ids: DataFrame, bounded: bool = False, most: int = 10_000) -> DataFrame:
    """All spans of the given traces as one left-semi join.

    With ``bounded`` the ids are counted first, up to ``most``; only if they are no
    more are they broadcast. Otherwise AQE chooses from the measured size.
    """
    ids = trace_ids.select("trace_id").distinct()
    if bounded and ids.limit(most + 1).count() <= most:
        ids = F.broadcast(ids)
    return spans.join(ids, "trace_id", "left_semi")


def find_trace_ids_span_level(
    spans: DataFrame,
    service: str | None = None,
    start_ns: int | None = None,
    end_ns: int | None = None,
    min_duration_ms: int | None = None,
    max_duration_ms: int | None = None,
    status: str | None = None,
) -> DataFrame:
    """The span-level variant — one span must satisfy every predicate."""
    cond = F.lit(True)
    if service is not None:
        cond = cond & (F.col("service") == F.lit(service))
    if status is not None:
        cond = cond & (F.col("status") == F.lit(status))
    if start_ns is not None:
        cond = cond & (F.col("start_ns") >= F.lit(start_ns))
    if end_ns is not None:
        cond = cond & (F.col("start_ns") < F.lit(end_ns))
    ms = ns_to_ms("duration_ns")
    if min_duration_ms is not None:
        cond = cond & (ms >= F.lit(min_duration_ms))
    if max_duration_ms is not None:
        cond = cond & (ms <= F.lit(max_duration_ms))
    return spans.where(cond).select("trace_id").distinct()


def trace_by_id(spans: DataFrame, trace_id: str | Column) -> DataFrame:
    """The spans of one trace (an id or a scalar column) ordered by start (empty frame = not found)."""
    return spans.where(F.col("trace_id") == (trace_id if isinstance(trace_id, Column) else F.lit(trace_id))).orderBy("start_ns", "span_id")


def correlate_logs(logs: DataFrame, spans: DataFrame, how: str = "inner") -> DataFrame:
    """Logs joined to the span they were written in, by (trace_id, span_id).

    ``how='left_anti'`` returns orphan logs (ids that match no span).
    """
    if how not in ("inner", "left", "left_anti", "left_semi"):
        raise ValueError(f"unsupported join type {how!r}")
    right = spans.select(
        "trace_id",
        "span_id",
        F.col("name").alias("span_name"),
        F.col("service").alias("span_service"),
        F.col("status").alias("span_status"),
        "duration_ns",
    )
    lhs = logs.where(F.col("trace_id").isNotNull() & F.col("span_id").isNotNull()) if how != "left" else logs
    return lhs.join(right, ["trace_id", "span_id"], how)


def span_tree(spans: DataFrame) -> DataFrame:
    """Per span its direct-child count, summed child duration and self time.

    Children are pre-aggregated by (trace_id, parent_span_id) — partial
    aggregation absorbs a parent with a huge fan-out — then joined to their
    parent on the unique (trace_id, span_id).
    """
    children = (
        spans.where(F.col("parent_span_id").isNotNull())
        .groupBy("trace_id", F.col("parent_span_id").alias("span_id"))
        .agg(F.count(F.lit(1)).alias("child_count"), F.sum("duration_ns").alias("child_duration_ns"))
    )
    out = spans.select("trace_id", "span_id", "parent_span_id", "service", "name", "duration_ns").join(
        children, ["trace_id", "span_id"], "left"
    )
    return out.select(
        "trace_id",
        "span_id",
        "parent_span_id",
        "service",
        "name",
        "duration_ns",
        F.coalesce("child_count", F.lit(0)).alias("child_count"),
        F.coalesce("child_duration_ns", F.lit(0)).alias("child_duration_ns"),
        (F.col("duration_ns") - F.coalesce("child_duration_ns", F.lit(0))).alias("self_ns"),
    )


def orphan_spans(spans: DataFrame) -> DataFrame:
    """Spans whose parent id names no span of the same trace."""
    parents = spans.select("trace_id", F.col("span_id").alias("parent_span_id"))
    return spans.where(F.col("parent_span_id").isNotNull()).join(parents, ["trace_id", "parent_span_id"], "left_anti")
