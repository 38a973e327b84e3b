"""Entity frames (logs, metrics, spans) derived from the deployment's tables.

The mapping from the ``events`` / ``documents`` tables to the three entity
schemas is fixed by FIXTURES.md §3 so that every operator has an independent
SQL oracle. All columns are plain Catalyst expressions; the only shuffle is
the per-trace root lookup of :func:`spans`, written as an aggregate + join
(partial aggregation and AQE skew-join splitting keep a hot trace from landing
in one task, which a window partitioned by trace would do).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vigil.functions.model import LEVELS, level_order
from vigil.sources.tables import read_table

_NS = "unix_micros(cast(ts as timestamp)) * 1000"
_DAYKEY = "cast(user_id as string) || '-' || date_format(cast(ts as timestamp), 'yyyyMMdd')"
_K = "cast(get_json_object(props, '$.k') as bigint)"
_SERVICE = "'svc-' || cast(event_id % 8 as string)"


def logs_from_events(events: DataFrame) -> DataFrame:
    """LogEntry rows: one per event (FIXTURES.md view ``logs``)."""
    base = events.selectExpr(
        "event_id as log_id",
        f"{_NS} as timestamp_ns",
        "cast(ts as timestamp) as ts",
        """case event_type when 'error' then 'error' when 'purchase' then 'warn'
             when 'signup' then 'info' when 'click' then 'debug' else 'trace' end as level""",
        """case event_id % 5
             when 0 then 'User ' || cast(user_id as string) || ' ' || event_type || ' took ' || cast(value as string) || 'ms'
             when 1 then 'Request to https://api.example.com/users/' || cast(user_id as string) || ' returned 500'
             when 2 then 'Connection to 10.0.0.' || cast(user_id % 256 as string) || ':5432 failed after ' || cast(value as string) || 'ms'
             when 3 then 'Cannot read /var/log/app-' || cast(user_id as string) || '.log'
             else 'Mail to user' || cast(user_id as string) || '@example.com bounced' end as message""",
        f"{_SERVICE} as service",
        # attributes: k (integer, absent for every 7th event), type, value, failed.
        # A SQL NULL map value means "key absent" (a JSON null would be a VARIANT
        # null). A literal map() lets Catalyst fold attributes['type'] to the
        # value expression itself, so predicates never build the map.
        f"""map('k', cast(case when event_id % 7 = 0 then cast(null as bigint) else {_K} end as variant),
                'type', cast(event_type as variant),
                'value', cast(value as variant),
                'failed', cast(event_type = 'error' as variant)) as attributes""",
        f"case when event_id % 3 = 0 then cast(null as string) else {_DAYKEY} end as trace_id",
        "case when event_id % 3 = 0 then cast(null as string) else cast(event_id as string) end as span_id",
    )
    return base.withColumn("level_order", level_order("level")).withColumn("dt", F.to_date("ts"))


def metrics_from_events(events: DataFrame) -> DataFrame:
    """Metric points: simple values only (FIXTURES.md view ``metrics``)."""
    return events.selectExpr(
        "event_id as point_id",
        f"{_NS} as timestamp_ns",
        "cast(ts as timestamp) as ts",
        "event_type as name",
        "case when event_type in ('purchase', 'signup') then 'counter' else 'gauge' end as metric_type",
        "value",
        f"{_SERVICE} as service",
        f"'host=' || cast(user_id % 4 as string) || ',service=' || {_SERVICE} as labels_key",
    ).withColumn("labels", F.expr("str_to_map(labels_key, ',', '=')")).withColumn("dt", F.to_date("ts"))


def spans_from_events(events: DataFrame, with_parents: bool = True) -> DataFrame:
    """Spans: one trace per user-day, rooted at its first event (view ``spans``).

    ``with_parents=False`` leaves ``parent_span_id`` NULL and skips the per-trace
    root lookup — the form a stream can compute (the lookup is an aggregate
    joined back, which needs the whole trace).
    """
    keyed = events.selectExpr(f"{_DAYKEY} as trace_id", "event_id", "ts", "event_type", "value")
    if with_parents:
        roots = keyed.groupBy("trace_id").agg(F.min("event_id").alias("_root_id"))
        # Left join on a unique-key aggregate: when a query does not use
        # parent_span_id, Catalyst removes the join and the aggregate entirely.
        joined = keyed.join(roots, "trace_id", "left")
    else:
        joined = keyed.withColumn("_root_id", F.lit(None).cast("bigint"))
    return joined.selectExpr(
        "trace_id",
        "cast(event_id as string) as span_id",
        "case when _root_id is null or event_id = _root_id then cast(null as string) "
        "else cast(_root_id as string) end as parent_span_id",
        "event_type as name",
        "event_type as operation",
        f"{_SERVICE} as service",
        "case when event_id % 2 = 0 then 'server' else 'client' end as kind",
        "case when event_type = 'error' then 'error' else 'ok' end as status",
        f"{_NS} as start_ns",
        f"{_NS} + cast(round(value * 1000000) as bigint) as end_ns",
        "cast(round(value * 1000000) as bigint) as duration_ns",
        "cast(ts as timestamp) as ts",
    ).withColumn("dt", F.to_date("ts"))


def logs_from_documents(documents: DataFrame) -> DataFrame:
    """Second log source with long multilingual text (whole documents as messages)."""
    level_case = " ".join(f"when {i} then '{name}'" for i, name in enumerate(LEVELS))
    base = documents.selectExpr(
        "doc_id as log_id",
        "timestamp'2024-01-01 00:00:00' + make_interval(0, 0, 0, 0, 0, cast(doc_id as int), 0) as ts",
        f"case doc_id % {len(LEVELS)} {level_case} end as level",
        "text as message",
        "source as service",
        "cast(map() as map<string, variant>) as attributes",
        "cast(null as string) as trace_id",
        "cast(null as string) as span_id",
    )
    return (
        base.withColumn("timestamp_ns", F.unix_micros("ts") * 1000)
        .withColumn("level_order", level_order("level"))
        .withColumn("dt", F.to_date("ts"))
    )


def logs(spark: SparkSession, base_dir: str) -> DataFrame:
    return logs_from_events(read_table(spark, base_dir, "events"))


def metrics(spark: SparkSession, base_dir: str) -> DataFrame:
    return metrics_from_events(read_table(spark, base_dir, "events"))


def spans(spark: SparkSession, base_dir: str) -> DataFrame:
    return spans_from_events(read_table(spark, base_dir, "events"))


def doc_logs(spark: SparkSession, base_dir: str) -> DataFrame:
    return logs_from_documents(read_table(spark, base_dir, "documents"))
