"""Values and layouts off the main path: tiny, huge and non-finite metrics, bucket edges, unreadable input,
deep attributes, tables of several streams, plans on stored tables."""

import hashlib
import json
import os

import pytest
from pyspark.sql import functions as F

from helpers import BASE_NS, logs_df, metrics_df, spans_df
from test_ingest import kv, write
from vigil import schemas
from vigil.functions.model import labels_key
from vigil.functions.timefn import ns_to_ms, ns_to_ts
from vigil.operators import logs as logops
from vigil.operators import metrics as metricops
from vigil.operators import retention, rollups, traces
from vigil.operators.predicates import Cond, where_
from vigil.operators.quantiles import grouped_percentiles
from vigil.session import checkpoint_dir
from vigil.sources import native_json, otlp
from vigil.sources.sinks import read_stored, write_table
from vigil.sources.validate import log_reject_reason, reject_details, reject_report, split_valid
from vigil.streaming import ingest, rollups as srollups

DAY = 86_400_000_000_000


@pytest.mark.parametrize("values,total,mean", [
    ([2e-7] * 3, 6e-7, 2e-7), ([2e18, 2e18], 4e18, 2e18), ([float("nan"), 4.0], float("nan"), float("nan")),
    ([float("inf"), 1.0], float("inf"), float("inf")), ([float("inf"), float("-inf")], float("nan"), float("nan")),
])
def test_metric_sums_keep_small_huge_and_non_finite_values(spark, values, total, mean):
    m = metrics_df(spark, [dict(name="m", value=v) for v in values])
    for df in (rollups.metric_rollup(m, "1day"), rollups.tier_up(rollups.metric_rollup(m, "1min"), "1day")):
        row = df.first()
        assert row["sum"] == pytest.approx(total, nan_ok=True) and row["avg"] == pytest.approx(mean, nan_ok=True)
    assert metricops.aggregate_metrics(m, "sum").first()["value"] == pytest.approx(total, nan_ok=True)
    assert metricops.aggregate_metrics(m, "avg").first()["value"] == pytest.approx(mean, nan_ok=True)


def test_nanoseconds_stay_in_their_day(spark):
    df = spark.createDataFrame([(1704067199999999999,), (1704067200000000000,), (-1,), (9_007_199_254_740_993_000_000,)][:3], "ns long")
    rows = df.select(ns_to_ts("ns").cast("string").alias("t"), ns_to_ms("ns").alias("ms")).collect()
    assert [r.t for r in rows] == ["2023-12-31 23:59:59.999999", "2024-01-01 00:00:00", "1969-12-31 23:59:59.999999"]
    assert [r.ms for r in rows] == [1704067199999, 1704067200000, 0]
    assert df.limit(1).select(ns_to_ms(F.lit(9_223_372_036_854_775_807))).first()[0] == 9_223_372_036_854


def test_label_sets_never_share_a_key(spark):
    maps = [{"a": "1,b=2"}, {"a": "1", "b": "2"}, {"a": "1\\", "b": "2"}, {"a=1,b": "2"}, {"a": "1\\,b=2"}]
    df = spark.createDataFrame([(m,) for m in maps], "labels map<string,string>")
    keys = [r[0] for r in df.select(labels_key("labels")).collect()]
    assert len(set(keys)) == len(maps) and keys[1] == "a=1,b=2"


def test_limits_are_the_callers(spark):
    spans = spans_df(spark, [dict(trace_id=f"t{i}", span_id="s", start_ns=BASE_NS + i) for i in range(300)])
    assert traces.recent_traces(traces.find_traces(spans), 300).count() == 300
    logs = logs_df(spark, [dict(message=f"m{i}", service="s") for i in range(1200)])
    assert logops.search_after(logs, limit=1100).count() == 1100
    metrics = metrics_df(spark, [dict(name="m", value=i) for i in range(1200)])
    assert metricops.list_metrics(metrics).count() == 1200
    assert logops.page(logs, logops.OrderBy().columns(), 5000, None).count() == 1000


def test_percentiles_do_not_depend_on_plan_choices(spark):
    df = spark.range(200_000).select(
        F.when(F.col("id") % 3 == 0, F.lit("hot")).when(F.col("id") % 7 == 0, F.lit(None)).otherwise((F.col("id") % 40).cast("string")).alias("k"),
        F.when(F.col("id") % 5 == 0, F.lit(77)).otherwise((F.hash("id") % 1_000_000).cast("long")).alias("v"),
    )
    want = {r.k: tuple(r)[1:] for r in df.groupBy("k").agg(
        F.count("v"), F.sum("v"), F.min("v"), F.max("v"), F.percentile("v", 0.5), F.percentile("v", 0.99)).collect()}
    for reuse in ("true", "false"):
        for adaptive in ("true", "false"):
            spark.conf.set("spark.sql.exchange.reuse", reuse)
            spark.conf.set("spark.sql.adaptive.enabled", adaptive)
            try:
                got = {r.k: tuple(r)[1:] for r in grouped_percentiles(df, ["k"], "v", {"p50": 0.5, "p99": 0.99}).collect()}
            finally:
                spark.conf.set("spark.sql.exchange.reuse", "true")
                spark.conf.set("spark.sql.adaptive.enabled", "true")
            assert got.keys() == want.keys()
            for k in want:
                assert got[k] == pytest.approx(want[k])


def test_unreadable_native_records_are_quarantined(spark, tmp_dir):
    os.makedirs(f"{tmp_dir}/in")
    with open(f"{tmp_dir}/in/a.json", "w") as fh:
        fh.write('{"message":"ok","service":"s"}\n{"message":"cut","serv\n{"message":"t","service":"s","timestamp":"not-a-time"}\n')
    valid, rejected = native_json.ingest_logs(spark, f"{tmp_dir}/in", multi_line=False)
    assert [r.message for r in valid.collect()] == ["ok"]
    rows = {r.reject_reason: r for r in reject_details(rejected).collect()}
    assert set(rows) == {"record is not readable", "timestamp is not an RFC 3339 time"}
    assert rows["record is not readable"].raw_body == '{"message":"cut","serv'
    assert "not-a-time" in rows["timestamp is not an RFC 3339 time"].raw_body
    metrics = write(f"{tmp_dir}/m", "m.json", [{"name": "a", "value": 1}, {"name": "b"}, {"name": "c", "value": "x"},
                                              {"name": "d", "value": 1, "metric_type": "odd"}], lines=True)
    valid, rejected = native_json.ingest_metrics(spark, metrics, multi_line=False)
    assert [r.name for r in valid.collect()] == ["a"]
    assert {r.reject_reason: r.rejected for r in reject_report(rejected).collect()} == {
        "value must be present": 1, "record is not readable": 1, "unknown metric_type": 1}


def _log_request(**record):
    return {"resourceLogs": [{"resource": {"attributes": [kv("service.name", stringValue="s")]}, "scopeLogs": [{"logRecords": [record]}]}]}


def test_unreadable_requests_and_malformed_numbers(spark, tmp_dir):
    path = write(f"{tmp_dir}/l", "a.json", [
        _log_request(timeUnixNano="1700000000000000000", body={"stringValue": "good"}),
        _log_request(timeUnixNano="abc", body={"stringValue": "bad time"}),
    ], lines=True)
    with open(f"{path}/b.json", "w") as fh:
        fh.write('{"resourceLogs": [{"resource"')
    valid, rejected = otlp.ingest_otlp_logs(spark, path, multi_line=False)
    assert [r.message for r in valid.collect()] == ["good"]
    rows = {r.reject_reason: r for r in rejected.collect()}
    assert set(rows) == {"timeUnixNano is not an integer", "request is not readable"}
    assert rows["request is not readable"].raw_body == '{"resourceLogs": [{"resource"'
    assert "bad time" in rows["timeUnixNano is not an integer"].raw_body


def test_points_that_cannot_be_converted_are_quarantined(spark, tmp_dir):
    metric = lambda name, **kind: {"name": name, **kind}
    request = {"resourceMetrics": [{"scopeMetrics": [{"metrics": [
        metric("ok", gauge={"dataPoints": [{"asInt": "3"}, {"asInt": "x"}, {}]}),
        metric("h", histogram={"dataPoints": [{"count": "2", "sum": 1.0, "bucketCounts": ["1", "b"], "explicitBounds": [1.0]}]}),
        metric("e", exponentialHistogram={"dataPoints": [{"count": "1"}, {"count": "2"}]}), metric("s", summary={"dataPoints": [{}]}),
    ]}]}]}
    valid, rejected = otlp.ingest_otlp_metrics(spark, write(f"{tmp_dir}/m", "m.json", [request], lines=True), multi_line=False)
    assert [(r.name, r.value) for r in valid.collect()] == [("ok", 3.0)]
    assert {r.reject_reason: r.rejected for r in reject_report(rejected).collect()} == {
        "asInt is not an integer": 1, "value must be present": 1, "bucketCounts is not an integer": 1,
        "exponential histogram points are not supported": 2, "summary points are not supported": 1}


def test_attributes_nest_without_bound(spark):
    def deep(n):
        if n == 0:
            return {"stringValue": "end"}
        if n % 2:
            return {"arrayValue": {"values": [deep(n - 1), {"intValue": "5"}, {}]}}
        return {"kvlistValue": {"values": [
            {"key": "stringValue", "value": deep(n - 1)}, {"key": "none"}, {"key": 'q"[{', "value": {"stringValue": '{"stringValue":"a"}]'}}]}}

    def plain(v):
        for k, x in v.items():
            if k == "arrayValue":
                return [plain(y) for y in x.get("values", [])]
            if k == "kvlistValue":
                return {y["key"]: plain(y["value"]) for y in x.get("values", []) if "value" in y}
            return int(x) if k == "intValue" else x
        return None

    values = [deep(10), deep(1), {"arrayValue": {}}, {"kvlistValue": {"values": []}}, {"kvlistValue": {"values": [{"key": "a"}]}},
              {"arrayValue": {"values": [{"doubleValue": 1.5}, {"boolValue": False}, {"kvlistValue": {}}]}}]
    df = spark.createDataFrame([(i, json.dumps(v)) for i, v in enumerate(values)], "i int, j string")
    out = df.select("i", F.to_json(otlp.any_value(F.from_json("j", schemas.ANY_VALUE))).alias("o")).collect()
    assert all(json.loads(r.o) == plain(values[r.i]) for r in out)


def _plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def test_predicates_reach_the_scan(spark, tmp_dir):
    logs = logs_df(spark, [dict(message=f"m{i}", service="s", level="error" if i % 2 else "info", ts_ns=BASE_NS + i * DAY) for i in range(6)])
    write_table(logs, f"{tmp_dir}/logs", "logs")
    stored = read_stored(spark, f"{tmp_dir}/logs", "logs")
    pred = Cond("timestamp", ">=", "2023-11-16T00:00:00Z") & Cond("level", ">=", "error") & Cond("level", "=", "ERROR")
    text = _plan(where_(stored, pred))
    assert "dt#" in text.split("PartitionFilters: [")[1].split("]")[0]
    pushed = text.split("PushedFilters: [")[1].split("]")[0]
    assert "timestamp_ns" in pushed and "level" in pushed
    assert sorted(r.message for r in where_(stored, pred).collect()) == ["m3", "m5"]


def test_trace_search_prunes_its_candidates(spark, tmp_dir):
    spans = spans_df(spark, [dict(trace_id=f"t{i}", span_id=f"s{i}{j}", service="a" if j else "b", start_ns=BASE_NS + i * DAY + j)
                             for i in range(5) for j in range(2)])
    write_table(spans, f"{tmp_dir}/spans", "spans")
    stored = read_stored(spark, f"{tmp_dir}/spans", "spans")
    kwargs = dict(service="b", start_ns=BASE_NS + 3 * DAY)
    found = traces.find_traces(stored, **kwargs)
    text = _plan(found)
    assert "EqualTo(service,b)" in text
    assert any("dt#" in part.split("]")[0] for part in text.split("PartitionFilters: [")[1:])
    assert sorted(r.trace_id for r in found.collect()) == ["t3", "t4"]
    assert sorted(map(str, found.collect())) == sorted(map(str, traces.find_traces(stored, prefilter=False, **kwargs).collect()))
    big = traces.fetch_spans(stored, stored.select("trace_id"), bounded=True, most=2)
    assert big.count() == 10 and "BroadcastExchange" not in _plan(big).split("LeftSemi")[0]


def _stream(spark, tmp_dir, source, checkpoint):
    raw = ingest.read_json_stream(spark, source, schemas.NATIVE_LOG)
    return ingest.start_ingest(
        raw, "logs", lambda b: split_valid(native_json.normalize_logs(b), log_reject_reason()), f"{tmp_dir}/raw", f"{tmp_dir}/bad",
        f"{tmp_dir}/tiers", "edge", available_now=True, checkpoint=f"{tmp_dir}/{checkpoint}",
    )


def test_streams_with_new_checkpoints_keep_each_others_rows_and_expire(spark, tmp_dir):
    checkpoint_dir(spark)
    for i, checkpoint in enumerate(("ck1", "ck2")):
        source = write(f"{tmp_dir}/in{i}", "a.json", [
            {"message": f"new {i}", "service": "s", "timestamp": "2024-01-15T10:30:00Z"},
            {"message": f"old {i}", "service": "s", "timestamp": "2024-01-10T10:30:00Z"},
            {"message": f"edge {i}", "service": "s", "timestamp": "2024-01-13T0{i}:30:00Z".replace("{i}", str(i))},
            {"message": f"far {i}", "service": "s", "timestamp": "1970-01-01T00:00:00Z"},
        ], lines=True)
        _stream(spark, tmp_dir, source, checkpoint).awaitTermination()
    raw = f"{tmp_dir}/raw"
    assert sorted(r.message for r in spark.read.parquet(raw).collect()) == ["edge 0", "edge 1", "new 0", "new 1", "old 0", "old 1"]
    assert spark.read.parquet(f"{tmp_dir}/bad").filter("reject_reason = 'event time out of range'").count() == 2
    done = retention.enforce_retention(
        spark, {"logs": raw}, f"{tmp_dir}/tiers", "2024-01-16 01:00:00", retention.RetentionPolicy({"logs": 3}),
        retention.AggregationPolicy({"logs_1hour_counts": 1, "logs_1day_counts": 700}),
    )
    assert sorted(r.message for r in spark.read.parquet(raw).collect()) == ["edge 1", "new 0", "new 1"]
    assert done["logs"] == {"dropped_days": 1, "rewritten_days": 1}
    assert spark.read.parquet(f"{tmp_dir}/tiers/logs_1hour_counts").filter("dt < '2024-01-15'").count() == 0
    assert spark.read.parquet(f"{tmp_dir}/tiers/logs_1day_counts").filter("dt = '2024-01-10'").count() > 0
    again = retention.enforce_retention(spark, {"logs": raw}, f"{tmp_dir}/tiers", "2024-01-16 01:45:00", retention.RetentionPolicy({"logs": 3}))
    assert again["logs"]["dropped_days"] == 0 and spark.read.parquet(raw).count() == 2


def test_stored_metric_tiers_keep_their_labels(spark, tmp_dir):
    m = metrics_df(spark, [dict(name="m", value=1, labels={"host": "a", "service": "s"})])
    rollups.write_rollups(m, "metrics", f"{tmp_dir}/tiers")
    assert spark.read.parquet(f"{tmp_dir}/tiers/metrics_1day").first().labels == {"host": "a", "service": "s"}


def test_metric_stream_takes_ingested_rows(spark, tmp_dir):
    source = write(f"{tmp_dir}/m", "m.json", [{"name": "m", "value": v, "timestamp": f"2024-01-0{d}T00:00:00Z"} for d, v in ((1, 1), (1, 2), (3, 5))],
                   lines=True)
    raw = ingest.read_json_stream(spark, source, schemas.NATIVE_METRIC)
    out = srollups.stream_metric_rollup(native_json.normalize_metrics(raw), "1day", "1 hour")
    query = srollups.start_parquet_sink(out, f"{tmp_dir}/out", "edge_metrics", available_now=True, checkpoint=f"{tmp_dir}/ck")
    query.awaitTermination()
    assert srollups.late_rows_dropped(query) == 0
    assert [(r["count"], r["sum"]) for r in spark.read.parquet(f"{tmp_dir}/out").filter("dt = '2024-01-01'").collect()] == [(2, 3.0)]


def test_compaction_keeps_rows_and_merges_files(spark, tmp_dir):
    from vigil.sources.sinks import compact_days

    path = f"{tmp_dir}/logs"
    for i in range(4):
        write_table(logs_df(spark, [dict(message=f"m{i}{j}", service="s", ts_ns=BASE_NS + j * 1000) for j in range(20)]), path, "logs")
    files = lambda: [f for f in os.listdir(f"{path}/dt=2023-11-14") if f.endswith(".parquet")]
    before = len(files())
    compact_days(spark, path, "logs", ["2023-11-14"])
    assert read_stored(spark, path).count() == 80 and len(files()) < before
    assert not [f for f in os.listdir(path) if "staging" in f]  # nothing is stored twice


def test_compaction_completes_a_broken_one(spark, tmp_dir):
    from vigil.sources.sinks import COMPACTION, compact_days

    path = f"{tmp_dir}/logs"
    rows = logs_df(spark, [dict(message=f"m{j}", service="s", ts_ns=BASE_NS + j * 1000) for j in range(20)])
    write_table(rows, path, "logs")
    read_stored(spark, path).write.partitionBy("dt").parquet(f"{path}/{COMPACTION}")  # staged, then the day was lost
    os.rename(f"{path}/dt=2023-11-14", f"{tmp_dir}/lost")
    write_table(logs_df(spark, [dict(message="later", service="s", ts_ns=BASE_NS + DAY)]), path, "logs")
    compact_days(spark, path, "logs", ["2023-11-15"])
    assert read_stored(spark, path).count() == 21


def test_writing_tasks_of_a_day_follow_its_bytes(spark, tmp_dir):
    rows = [dict(message="".join(hashlib.md5(f"{i}-{j}".encode()).hexdigest() for j in range(6)), service=f"s{i % 5}", ts_ns=BASE_NS + i * 1000) for i in range(4000)]
    rows += [dict(message="small day", service="s", ts_ns=BASE_NS + DAY + i) for i in range(5)]
    logs = logs_df(spark, rows).repartition(16)
    files = lambda path, day: [f for f in os.listdir(f"{path}/dt={day}") if f.endswith(".parquet")]
    write_table(logs, f"{tmp_dir}/large", "logs")
    before = spark.conf.get("spark.sql.adaptive.advisoryPartitionSizeInBytes", None)
    try:
        spark.conf.set("spark.sql.adaptive.advisoryPartitionSizeInBytes", "64k")
        write_table(logs, f"{tmp_dir}/small", "logs")
    finally:
        if before is None:
            spark.conf.unset("spark.sql.adaptive.advisoryPartitionSizeInBytes")
        else:
            spark.conf.set("spark.sql.adaptive.advisoryPartitionSizeInBytes", before)
    assert len(files(f"{tmp_dir}/large", "2023-11-14")) == 1
    many = files(f"{tmp_dir}/small", "2023-11-14")
    assert len(many) >= 4 and len(files(f"{tmp_dir}/small", "2023-11-15")) == 1
    for f in many:  # each file is sorted by the table's keys
        got = [(r.service, r.level, r.timestamp_ns) for r in spark.read.parquet(f"{tmp_dir}/small/dt=2023-11-14/{f}").collect()]
        assert got == sorted(got)
    assert read_stored(spark, f"{tmp_dir}/small").count() == len(rows)


def test_stored_coarse_tiers_equal_direct_rollups(spark, tmp_dir):
    logs = logs_df(spark, [dict(message=f"user {i % 3} failed", service="s", ts_ns=BASE_NS + i * DAY // 9) for i in range(30)])
    rollups.write_rollups(logs, "logs", f"{tmp_dir}/t")
    stored = spark.read.parquet(f"{tmp_dir}/t/logs_1day_counts").drop("dt")
    assert sorted(map(str, stored.collect())) == sorted(map(str, rollups.log_count_rollup(logs, "1day").collect()))
    later = logs.filter("ts >= '2023-11-16'")
    rollups.write_rollups(later.limit(1), "logs", f"{tmp_dir}/t")  # replaces one day in both tiers, the others stay
    assert spark.read.parquet(f"{tmp_dir}/t/logs_1day_counts").agg(F.countDistinct("dt")).first()[0] == 5


def test_second_batch_does_not_read_the_days_raw_rows(spark, tmp_dir):
    source = write(f"{tmp_dir}/in", "a.json", [
        {"message": f"user {i} failed", "service": "s", "timestamp": "2024-01-15T10:30:00Z"} for i in range(3)], lines=True)
    _stream(spark, tmp_dir, source, "ck").awaitTermination()
    # the raw rows of the first batch become unreadable: only partial rows can tell of them
    for folder, _, files in os.walk(f"{tmp_dir}/raw/dt=2024-01-15"):
        for f in files:
            os.truncate(f"{folder}/{f}", 0)
    write(source, "b.json", [{"message": "user 9 failed", "service": "s", "timestamp": "2024-01-15T10:45:00Z"}], lines=True)
    _stream(spark, tmp_dir, source, "ck").awaitTermination()
    for tier in ("1hour", "1day"):
        rows = spark.read.parquet(f"{tmp_dir}/tiers/logs_{tier}_counts").collect()
        assert [(r.normalized_message, r["count"]) for r in rows] == [("user <NUM> failed", 4)]


def test_streams_do_without_scratch_checkpoints(spark):
    from vigil.session import stream_checkpoint

    assert stream_checkpoint(spark, "q", "/given") == "/given"
    assert stream_checkpoint(spark, "q", None) == f"{spark.conf.get('spark.checkpoint.dir')}/q"

    class Bare:
        class conf:  # noqa: N801
            get = staticmethod(lambda key, default: default)

    with pytest.raises(ValueError):
        stream_checkpoint(Bare, "q", None)
