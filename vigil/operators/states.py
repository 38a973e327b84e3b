"""Mergeable states of the rollup tiers: what a batch adds to a tier, so that a tier is a merge of states.

Counts, sums, minima and maxima merge as they are (metrics, logs). Percentiles and distinct
counts don't, so spans keep what does: the exact state of the percentiles is one row per
group and duration with its count, and of the distinct traces one row per group and trace.
Equal rows of two states add up; a tier follows from the merged rows of any number of states,
in any order, exactly as from all spans at once. States hold a few narrow columns, no
attributes or events, and never more rows than the batch has spans.

Beside the exact count the trace tiers can carry an HLL sketch of the trace ids
(``traces_sketch``), which merges over any buckets: days from hours and weeks from days,
counting a trace that lasts over several buckets once.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vigil.functions.timefn import bucket_start
from vigil.operators import rollups, trace_index
from vigil.operators.quantiles import grouped_percentiles

SPAN_KEYS = ["timestamp", "service", "operation", "span_kind", "status_code"]
SKETCH_LOG_K = 12  # 4,096 registers: a standard error of 1.6 % after a union, exact for a few hundred traces
SKETCH_ERROR = 0.05  # three standard errors


def span_values(spans: DataFrame, tier: str) -> DataFrame:
    """Rows per bucket, group and duration: the state of the span tiers."""
    return spans.groupBy(
        bucket_start("ts", tier).alias("timestamp"), "service", "operation", F.col("kind").alias("span_kind"),
        F.col("status").alias("status_code"), "duration_ns",
    ).agg(F.count(F.lit(1)).alias("n"))


def merge_span_values(values: DataFrame, tier: str) -> DataFrame:
    return values.groupBy(bucket_start("timestamp", tier).alias("timestamp"), *SPAN_KEYS[1:], "duration_ns").agg(F.sum("n").alias("n"))


def span_stats(values: DataFrame, tier: str) -> DataFrame:
    """A7/A8 from states of the same or a finer tier; equal to :func:`rollups.span_stats_rollup` of all spans."""
    rows = values.withColumn("timestamp", bucket_start("timestamp", tier))
    return rollups.span_columns(grouped_percentiles(rows, SPAN_KEYS, "duration_ns", rollups.SPAN_PERCENTILES, weight="n"))


def trace_members(spans: DataFrame, tier: str) -> DataFrame:
    """Spans per bucket, service and trace: the state of the trace tiers."""
    return spans.groupBy(bucket_start("ts", tier).alias("timestamp"), "service", "trace_id").agg(F.count(F.lit(1)).alias("n"))


def merge_trace_members(members: DataFrame, tier: str) -> DataFrame:
    return members.groupBy(bucket_start("timestamp", tier).alias("timestamp"), "service", "trace_id").agg(F.sum("n").alias("n"))


def trace_stats(members: DataFrame, tier: str) -> DataFrame:
    """A9/A10 from states of the same or a finer tier, with the sketch of the traces."""
    whole = merge_trace_members(members, tier)  # spread by trace first, so a hot service is not one task's
    return whole.groupBy("timestamp", "service").agg(
        F.count("trace_id").alias("unique_traces"), F.sum("n").alias("total_spans"), trace_sketch("trace_id").alias("traces_sketch")
    )


def trace_sketch(trace_id: Column | str) -> Column:
    return F.hll_sketch_agg(trace_id, SKETCH_LOG_K)


def trace_tier_up(tier_rows: DataFrame, tier: str) -> DataFrame:
    """A coarser trace tier from a stored finer one: spans add, traces are the union of the sketches.

    ``unique_traces`` is the estimate of the union (D14: a sum would count a trace once for
    each bucket it touches); its error is within ``SKETCH_ERROR`` but for one case in hundreds.
    """
    return distinct_traces(tier_rows, [bucket_start("timestamp", tier).alias("timestamp"), F.col("service")])


def distinct_traces(tier_rows: DataFrame, by: Sequence[Column | str]) -> DataFrame:
    """E9/E10 over any buckets of a stored trace tier: traces counted once, and their spans."""
    return tier_rows.groupBy(*by).agg(
        F.hll_sketch_estimate(F.hll_union_agg("traces_sketch")).alias("unique_traces"),
        F.sum("total_spans").alias("total_spans"),
        F.hll_union_agg("traces_sketch").alias("traces_sketch"),
    )


@dataclass(frozen=True)
class State:
    """How batches add to one tier table: ``rows`` of a batch, ``merge`` of rows, ``finish`` to the table's rows.

    A ``table`` that does not name its tier is built once, whatever the tiers.
    """

    table: str
    partials: str
    rows: Callable[[DataFrame, str], DataFrame]
    merge: Callable[[DataFrame, str], DataFrame]
    finish: Callable[[DataFrame, str], DataFrame]


STATES: dict[str, tuple[State, ...]] = {
    "metrics": (State("metrics_{tier}", "metrics_{tier}", rollups.metric_rollup, rollups.tier_up, rollups.tier_up),),
    "logs": (State("logs_{tier}_counts", "logs_{tier}_counts", rollups.log_count_rollup, rollups.log_tier_up, rollups.log_tier_up),),
    "spans": (
        State("spans_{tier}_stats", "spans_{tier}_values", span_values, merge_span_values, span_stats),
        State("traces_{tier}_stats", "traces_{tier}_members", trace_members, merge_trace_members, trace_stats),
        State(trace_index.DAYS, "traces_index_rows", trace_index.index_rows, trace_index.merge_index, trace_index.merge_index),
    ),
}
