"""Entities and rollup tiers as temporary views for Spark SQL.

The reference's SQL-like language only reaches ``logs``; here every entity
and every rollup tier is a view, and N1 is a SQL function, so the queries of
its README and examples run as plain Spark SQL (no custom parser).
"""

from __future__ import annotations

from pyspark.sql import SparkSession

from vigil.functions.normalize import register_normalize_function
from vigil.operators import rollups
from vigil.session import configure
from vigil.sources import views

METRIC_TIERS = ("1min", "5min", "1hour", "1day")
LOG_TIERS = ("1hour", "1day")


def register_views(spark: SparkSession, base_dir: str, names: list[str] | None = None) -> list[str]:
    """Register ``logs``, ``metrics``, ``spans`` and the ten rollups (or just ``names``).

    Views are lazy: a SQL query over a rollup view plans the rollup's
    aggregate over the base tables, so filters on the base columns still
    reach the scan. Building a view costs driver-side analysis, so callers that
    need a few views name them.
    """
    configure(spark)
    register_normalize_function(spark)
    base = {
        "logs": lambda: views.logs(spark, base_dir),
        "metrics": lambda: views.metrics(spark, base_dir),
        "spans": lambda: views.spans(spark, base_dir),
    }
    builders = dict(base)
    for tier in METRIC_TIERS:
        builders[f"metrics_{tier}"] = lambda t=tier: rollups.metric_rollup(base["metrics"](), t)
    for tier in LOG_TIERS:
        builders[f"logs_{tier}_counts"] = lambda t=tier: rollups.log_count_rollup(base["logs"](), t)
        builders[f"spans_{tier}_stats"] = lambda t=tier: rollups.span_stats_rollup(base["spans"](), t)
        builders[f"traces_{tier}_stats"] = lambda t=tier: rollups.trace_stats_rollup(base["spans"](), t)
    wanted = list(builders) if names is None else list(names)
    unknown = set(wanted) - set(builders)
    if unknown:
        raise ValueError(f"unknown views {sorted(unknown)}")
    for name in wanted:
        builders[name]().createOrReplaceTempView(name)
    return wanted
