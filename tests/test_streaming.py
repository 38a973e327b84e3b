"""M1–M3: streaming rollups equal batch rollups on closed windows; streaming
ingest with recompute equals the batch rollup of everything ingested."""

import os
import shutil

import pytest
from pyspark.sql import functions as F

from vigil.operators import rollups
from vigil.sources import native_json
from vigil.sources.views import logs_from_events, metrics_from_events
from vigil.streaming import ingest, rollups as srollups

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def landing(tmp_path_factory):
    d = tmp_path_factory.mktemp("landing")
    shutil.copy(f"{SF}/events.parquet", d / "part-0.parquet")
    return str(d)


def _stream(spark, landing):
    schema = spark.read.parquet(f"{SF}/events.parquet").schema
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(landing)


def _cols(df, cols):
    return df.select(*cols)


def test_streaming_metric_rollup_equals_batch(spark, landing, tmp_dir):
    events = _stream(spark, landing)
    q = srollups.start_parquet_sink(
        srollups.stream_metric_rollup(metrics_from_events(events), "1hour", watermark="1 hour"),
        f"{tmp_dir}/m1h", "m1h_test", available_now=True, checkpoint=f"{tmp_dir}/ck")
    q.awaitTermination(300)
    streamed = spark.read.parquet(f"{tmp_dir}/m1h").drop("dt")
    batch = rollups.metric_rollup(metrics_from_events(spark.read.parquet(f"{SF}/events.parquet")), "1hour")
    cols = ["timestamp", "name", "metric_type", "service", "labels_key", "count", "sum", "min", "max", "avg"]
    # append mode emits a window once the watermark passes it: compare closed windows
    last = streamed.agg(F.max("timestamp")).first()[0]
    closed = batch.where(F.col("timestamp") <= F.lit(last))
    assert streamed.count() > 0
    assert _cols(streamed, cols).exceptAll(_cols(closed, cols)).count() == 0
    assert _cols(closed, cols).exceptAll(_cols(streamed, cols)).count() == 0


def test_streaming_log_counts_equals_batch(spark, landing, tmp_dir):
    events = _stream(spark, landing)
    q = srollups.start_parquet_sink(
        srollups.stream_log_counts(logs_from_events(events), "1hour", watermark="1 hour"),
        f"{tmp_dir}/l1h", "l1h_test", available_now=True, checkpoint=f"{tmp_dir}/ck2")
    q.awaitTermination(300)
    streamed = spark.read.parquet(f"{tmp_dir}/l1h").drop("dt")
    batch = rollups.log_count_rollup(logs_from_events(spark.read.parquet(f"{SF}/events.parquet")), "1hour")
    last = streamed.agg(F.max("timestamp")).first()[0]
    closed = batch.where(F.col("timestamp") <= F.lit(last))
    assert streamed.exceptAll(closed.select(streamed.columns)).count() == 0
    assert closed.select(streamed.columns).exceptAll(streamed).count() == 0


def test_streaming_ingest_recompute_is_exact(spark, tmp_dir):
    inbox = f"{tmp_dir}/inbox"
    os.makedirs(inbox)
    rows = [
        '{"message": "Payment failed for user 1", "service": "pay", "level": "error", "timestamp": "2024-01-02T10:00:00Z"}',
        '{"message": "Payment failed for user 2", "service": "pay", "level": "error", "timestamp": "2024-01-02T11:00:00Z"}',
        '{"message": "", "service": "pay"}',
    ]
    with open(f"{inbox}/a.json", "w") as fh:
        fh.write("\n".join(rows))
    late = ['{"message": "Payment failed for user 3", "service": "pay", "level": "error", "timestamp": "2024-01-02T10:30:00Z"}']

    def validate(batch):
        from vigil.sources.validate import log_reject_reason, split_valid
        return split_valid(native_json.normalize_logs(batch), log_reject_reason())

    def run(name):
        stream = spark.readStream.schema(native_json.schemas.NATIVE_LOG).json(inbox)
        q = ingest.start_ingest(stream, "logs", validate, f"{tmp_dir}/raw", f"{tmp_dir}/quarantine",
                                f"{tmp_dir}/rollups", name, available_now=True, checkpoint=f"{tmp_dir}/ck")
        q.awaitTermination(300)

    run("ingest_test")
    with open(f"{inbox}/b.json", "w") as fh:  # a late row for an already-rolled-up day
        fh.write("\n".join(late))
    run("ingest_test")
    day = spark.read.parquet(f"{tmp_dir}/rollups/logs_1day_counts").collect()
    assert [(r.normalized_message, r["count"]) for r in day] == [("Payment failed for user <NUM>", 3)]
    assert spark.read.parquet(f"{tmp_dir}/quarantine").count() == 1
    assert spark.read.parquet(f"{tmp_dir}/raw").count() == 3


def test_streaming_span_and_trace_stats(spark, landing, tmp_dir):
    from vigil.sources.views import spans_from_events

    events = _stream(spark, landing)
    spans = spans_from_events(events, with_parents=False)
    q1 = srollups.start_parquet_sink(srollups.stream_span_stats(spans, "1day", watermark="1 hour"),
                                     f"{tmp_dir}/s1d", "s1d_test", available_now=True, checkpoint=f"{tmp_dir}/ck3")
    q2 = srollups.start_parquet_sink(srollups.stream_trace_stats(spans, "1day", watermark="1 hour"),
                                     f"{tmp_dir}/t1d", "t1d_test", available_now=True, checkpoint=f"{tmp_dir}/ck4")
    q1.awaitTermination(300)
    q2.awaitTermination(300)
    raw = spans_from_events(spark.read.parquet(f"{SF}/events.parquet"))
    s_stream = spark.read.parquet(f"{tmp_dir}/s1d").drop("dt")
    last = s_stream.agg(F.max("timestamp")).first()[0]
    s_batch = rollups.span_stats_rollup(raw, "1day").where(F.col("timestamp") <= F.lit(last))
    keys = ["timestamp", "service", "operation", "span_kind", "status_code"]
    exact = keys + ["span_count", "avg_duration_ns", "min_duration_ns", "max_duration_ns"]
    assert s_stream.select(exact).exceptAll(s_batch.select(exact)).count() == 0
    assert s_batch.select(exact).exceptAll(s_stream.select(exact)).count() == 0
    # percentile sketches return a sample value between the exact min and max
    joined = s_stream.alias("s").join(s_batch.alias("b"), keys)
    assert joined.where("s.p50_duration_ns < b.min_duration_ns or s.p50_duration_ns > b.max_duration_ns").count() == 0
    t_stream = spark.read.parquet(f"{tmp_dir}/t1d").drop("dt")
    t_batch = rollups.trace_stats_rollup(raw, "1day").where(F.col("timestamp") <= F.lit(last))
    got = {(r.timestamp, r.service): (r.total_spans, r.unique_traces) for r in t_stream.collect()}
    want = {(r.timestamp, r.service): (r.total_spans, r.unique_traces) for r in t_batch.collect()}
    assert got.keys() == want.keys()
    for k, (spans_n, uniq) in want.items():
        assert got[k][0] == spans_n
        assert abs(got[k][1] - uniq) <= max(1, 0.1 * uniq)  # HyperLogLog++ estimate


def test_streaming_otlp_span_ingest(spark, tmp_dir):
    import json

    from vigil import schemas
    from vigil.sources import otlp
    from vigil.sources.validate import span_reject_reason, split_valid

    inbox = f"{tmp_dir}/otlp_inbox"
    os.makedirs(inbox)

    def request(trace, spans):
        return {"resourceSpans": [{"resource": {"attributes": [
            {"key": "service.name", "value": {"stringValue": "checkout"}}]},
            "scopeSpans": [{"scope": {"name": "x"}, "spans": [
                {"traceId": trace, "spanId": sid, "name": "op", "kind": 2,
                 "startTimeUnixNano": str(start), "endTimeUnixNano": str(start + dur)}
                for sid, start, dur in spans]}]}]}

    day = 1704110400 * 10**9  # 2024-01-01T12:00:00Z
    with open(f"{inbox}/r1.json", "w") as fh:
        json.dump(request("AA01", [("0001", day, 5_000_000), ("0002", day + 1, 7_000_000)]), fh)
    with open(f"{inbox}/r2.json", "w") as fh:
        json.dump(request("AA02", [("0003", day + 2, 9_000_000), ("", day, 1)]), fh)

    def validate(batch):
        return split_valid(otlp.flatten_spans(batch), span_reject_reason())

    stream = ingest.read_json_stream(spark, inbox, schemas.OTLP_SPANS, multi_line=True)
    q = ingest.start_ingest(stream, "spans", validate, f"{tmp_dir}/raw_spans", f"{tmp_dir}/q_spans",
                            f"{tmp_dir}/span_rollups", "otlp_ingest_test", available_now=True,
                            tiers=("1day",), checkpoint=f"{tmp_dir}/ck5")
    q.awaitTermination(300)
    traces = spark.read.parquet(f"{tmp_dir}/span_rollups/traces_1day_stats").collect()
    assert [(r.service, r.unique_traces, r.total_spans) for r in traces] == [("checkout", 2, 3)]
    stats = spark.read.parquet(f"{tmp_dir}/span_rollups/spans_1day_stats").first()
    assert (stats.span_count, stats.min_duration_ns, stats.max_duration_ns, stats.p50_duration_ns) == (
        3, 5_000_000, 9_000_000, 7_000_000.0)
    quarantined = spark.read.parquet(f"{tmp_dir}/q_spans").collect()
    assert len(quarantined) == 1 and quarantined[0].source_file.endswith("/r2.json")
    assert (quarantined[0].resource_index, quarantined[0].scope_index, quarantined[0].record_index) == (0, 0, 1)


def test_recompute_respects_aggregation_policy(spark, tmp_dir):
    from vigil.operators.retention import AggregationPolicy
    from vigil.sources.views import logs_from_events

    raw = logs_from_events(spark.read.parquet(f"{SF}/events.parquet")).drop("attributes")
    raw.write.partitionBy("dt").parquet(f"{tmp_dir}/raw_logs")
    days = [r.dt for r in raw.select("dt").distinct().limit(2).collect()]
    policy = AggregationPolicy(enabled={"logs_1hour_counts": False})
    ingest.recompute_days(spark, f"{tmp_dir}/raw_logs", f"{tmp_dir}/roll", "logs", days, policy=policy)
    assert os.path.exists(f"{tmp_dir}/roll/logs_1day_counts")
    assert not os.path.exists(f"{tmp_dir}/roll/logs_1hour_counts")
    assert spark.read.parquet(f"{tmp_dir}/roll/logs_1day_counts").select("dt").distinct().count() == 2
