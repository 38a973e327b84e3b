"""Physical-plan properties of the registered queries (the scale contract)."""

import re

import pytest

import __spark_entry__ as E

SF = "/root/testdata/sf0.001"
PYTHON_NODES = ("BatchEvalPython", "ArrowEvalPython", "FlatMapGroupsInPandas", "MapInPandas", "PythonUDF")


def plan(spark, name):
    df = E.queries()[name](spark, SF)
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", sorted(E.queries()))
def test_no_python_on_the_data_path(spark, name):
    text = plan(spark, name)
    assert not any(node in text for node in PYTHON_NODES), name


def test_column_pruning_reaches_the_scan(spark):
    df = E.queries()["q_metrics_1min"](spark, SF)
    scans = df._jdf.queryExecution().executedPlan().toString()
    assert "props" not in scans  # metrics never read the JSON properties column
    text = plan(spark, "q_pred_string_eq")
    assert "props" not in text


def test_span_root_join_is_removed_when_unused(spark):
    # span stats do not need parent_span_id, so the per-trace root aggregate and
    # its join disappear from the plan
    assert "trace_id" not in plan(spark, "q_spans_1hour_stats")
    assert "trace_id" in plan(spark, "q_span_parent_child")


def test_normalisation_runs_before_the_shuffle(spark):
    text = plan(spark, "q_logs_1hour_counts")
    lines = text.splitlines()
    exchange = max(i for i, line in enumerate(lines) if "Exchange" in line)
    regex = [i for i, line in enumerate(lines) if "regexp_replace" in line]
    assert regex and min(regex) > exchange  # deeper in the tree = map side
    assert "partial_count" in text


def test_bounded_trace_page_is_broadcast(spark):
    text = plan(spark, "q_trace_fetch_semi")
    assert "BroadcastHashJoin" in text and "LeftSemi" in text


def test_percentiles_are_spread_by_value_not_by_group(spark):
    text = plan(spark, "q_spans_1day_stats")
    # the shuffle of the rows is keyed by the value too, after a partial count
    assert any("hashpartitioning" in line and "_v#" in line for line in text.splitlines())
    assert "partial_count" in text
    assert "percentile" not in text.lower().replace("p50_duration_ns", "").replace("p95_duration_ns", "").replace(
        "p99_duration_ns", "")


def test_bucketed_spans_need_no_shuffle_for_trace_work(spark, tmp_dir):
    from vigil.operators import traces
    from vigil.sources import views
    from vigil.sources.sinks import write_bucketed_table

    spans = views.spans(spark, SF)
    write_bucketed_table(spans, "vigil_test_spans", f"{tmp_dir}/spans_b", 8)
    stored = spark.table("vigil_test_spans")
    summary = traces.trace_summary(stored)
    text = summary._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in text  # per-trace aggregate runs bucket-local
    assert summary.count() == spans.select("trace_id").distinct().count()
    spark.sql("DROP TABLE vigil_test_spans")


def test_hot_span_join_is_split_by_aqe(spark):
    """A third+ of all logs in one span: AQE splits that join partition (skew join)."""
    from pyspark.sql import functions as F

    from vigil.operators import traces

    logs = spark.range(60_000).select(
        F.col("id").alias("log_id"),
        F.when(F.col("id") % 3 != 0, F.lit("hot")).otherwise(F.concat(F.lit("t"), (F.col("id") % 997).cast("string")))
        .alias("trace_id"),
        F.when(F.col("id") % 3 != 0, F.lit("s")).otherwise(F.lit("s")).alias("span_id"),
        F.lit("m").alias("message"),
    )
    spans = spark.range(1000).select(
        F.when(F.col("id") == 0, F.lit("hot")).otherwise(F.concat(F.lit("t"), F.col("id").cast("string")))
        .alias("trace_id"),
        F.lit("s").alias("span_id"), F.lit("op").alias("name"), F.lit("svc").alias("service"),
        F.lit("ok").alias("status"), F.lit(1).cast("bigint").alias("duration_ns"),
    )
    conf = {
        "spark.sql.autoBroadcastJoinThreshold": "-1",
        "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "1k",
        "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "2",
        "spark.sql.adaptive.advisoryPartitionSizeInBytes": "16k",
    }
    old = {k: spark.conf.get(k, None) for k in conf}
    try:
        for k, v in conf.items():
            spark.conf.set(k, v)
        joined = traces.correlate_logs(logs, spans)
        rows = joined.collect()
        assert len(rows) == 40_000 + len([i for i in range(0, 60_000, 3) if 0 < i % 997 < 1000])
        plan = joined._jdf.queryExecution().executedPlan().toString()
        assert "isSkewJoin=true" in plan or "skew=true" in plan.lower(), plan
    finally:
        for k, v in old.items():
            if v is None:
                spark.conf.unset(k)
            else:
                spark.conf.set(k, v)


def test_exact_distinct_traces_shuffle_by_trace_first(spark):
    import re

    text = plan(spark, "q_traces_1hour_stats")
    keys = re.findall(r"hashpartitioning\(([^)]*)\)", text)
    # first level spreads a hot (bucket, service) by trace id; second carries partial counts
    assert any("trace_id" in k for k in keys) and any("trace_id" not in k for k in keys), keys


def test_stored_logs_prune_partitions_and_push_filters(spark, tmp_dir):
    from vigil.operators.logs import filter_logs
    from vigil.operators.predicates import parse_rfc3339_ns
    from vigil.sources import views
    from vigil.sources.sinks import read_stored, write_table

    write_table(views.logs(spark, SF).drop("attributes"), f"{tmp_dir}/logs", "logs")
    stored = read_stored(spark, f"{tmp_dir}/logs")
    page = filter_logs(
        stored, start_ns=parse_rfc3339_ns("2024-01-10T00:00:00Z"), end_ns=parse_rfc3339_ns("2024-01-12T00:00:00Z"),
        service="svc-3", level="error",
    ).select("log_id", "message")
    text = page._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(dt" in text and "dt#" in text.split("PartitionFilters:")[1].split("]")[0]
    pushed = text.split("PushedFilters: [")[1].split("]")[0]
    assert "timestamp_ns" in pushed and "service" in pushed and "level" in pushed
    schema = text.split("ReadSchema: ")[1].split("\n")[0]
    assert "trace_id" not in schema and "attributes" not in schema
    assert page.count() == views.logs(spark, SF).where(
        "service = 'svc-3' and level = 'error' and ts >= '2024-01-10' and ts < '2024-01-12'").count()
