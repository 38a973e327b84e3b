"""Native JSON and OTLP/JSON ingest with validation."""

import json
import os

import pytest
from pyspark.sql import functions as F

from vigil.sources import native_json, otlp
from vigil.sources.validate import bucket_total, buckets_ascending, reject_report, zip_buckets


def write(dirname, name, payload, lines=False):
    os.makedirs(dirname, exist_ok=True)
    with open(os.path.join(dirname, name), "w") as fh:
        if lines:
            fh.write("\n".join(json.dumps(p) for p in payload))
        else:
            json.dump(payload, fh)
    return dirname


def kv(key, **value):
    return {"key": key, "value": value}


def test_native_logs(spark, tmp_dir):
    batch = [
        {"message": "Server started", "service": "api", "level": "INFO", "timestamp": "2024-01-15T10:30:00.123456789Z"},
        {"message": "Disk full", "service": "db", "level": "error", "attributes": {"disk": "/dev/sda", "pct": 99, "x": 1.5}},
        {"message": "", "service": "api"},
        {"message": "no service", "service": ""},
        {"message": "odd level", "service": "api", "level": "verbose", "trace_id": ""},
    ]
    path = write(f"{tmp_dir}/logs", "batch.json", batch)
    valid, rejected = native_json.ingest_logs(spark, path)
    rows = {r.message: r for r in valid.collect()}
    assert set(rows) == {"Server started", "Disk full"}
    assert rows["Server started"].timestamp_ns == 1705314600123456789
    assert rows["Server started"].level == "info"
    assert rows["Disk full"].trace_id is None
    attrs = valid.where("message = 'Disk full'").select(
        F.schema_of_variant(F.col("attributes")["pct"]).alias("t"),
        F.variant_get(F.col("attributes")["disk"], "$", "string").alias("d"),
    ).first()
    assert (attrs.t, attrs.d) == ("BIGINT", "/dev/sda")
    reasons = {r.reject_reason: r.rejected for r in reject_report(rejected).collect()}
    assert reasons == {"message must not be empty": 1, "service must not be empty": 1, "unknown level": 1}
    with pytest.raises(ValueError):
        native_json.ingest_logs(spark, path, on_error="fail")


def test_native_single_object_and_spans(spark, tmp_dir):
    path = write(f"{tmp_dir}/one", "one.json", {"message": "solo", "service": "api"})
    valid, _ = native_json.ingest_logs(spark, path)
    assert valid.count() == 1
    spans = [
        {"trace_id": "t", "span_id": "a", "name": "GET", "service": "api", "kind": "server", "duration_ms": 1000,
         "start_time": "2024-01-01T00:00:00Z"},
        {"trace_id": "t", "span_id": "b", "parent_span_id": "a", "name": "DB", "service": "db", "duration_ms": 900,
         "status": "error", "start_time": "2024-01-01T00:00:00.05Z"},
        {"trace_id": "", "span_id": "c", "name": "x", "service": "y"},
        {"trace_id": "t", "span_id": "d", "name": "neg", "service": "y", "duration_ms": -5},
    ]
    valid, rejected = native_json.ingest_spans(spark, write(f"{tmp_dir}/spans", "s.json", spans))
    got = {r.span_id: r for r in valid.collect()}
    assert set(got) == {"a", "b"}
    assert got["a"].duration_ns == 1_000_000_000 and got["a"].kind == "server" and got["b"].kind == "internal"
    assert got["b"].status == "error"
    assert sorted(r.reject_reason for r in rejected.collect()) == [
        "end time must not be before start time", "trace_id must not be empty"]


def test_native_metrics(spark, tmp_dir):
    rows = [
        {"name": "cpu", "value": 0.5, "labels": {"service": "api"}},
        {"name": "reqs", "value": 3, "metric_type": "counter"},
        {"name": "", "value": 1},
        {"name": "lat", "value": 2, "metric_type": "histogram",
         "buckets": [{"upper_bound": 1.0, "count": 1}, {"upper_bound": 0.5, "count": 2}]},
    ]
    valid, rejected = native_json.ingest_metrics(spark, write(f"{tmp_dir}/m", "m.json", rows))
    got = {r.name: r for r in valid.collect()}
    assert got["cpu"].metric_type == "gauge" and got["cpu"].service == "api" and got["reqs"].service == "unknown"
    assert sorted(r.reject_reason for r in rejected.collect()) == [
        "histogram buckets must be sorted", "name must not be empty"]


OTLP_LOGS = {
    "resourceLogs": [{
        "resource": {"attributes": [kv("service.name", stringValue="checkout"), kv("host.name", stringValue="h1"),
                                    kv("pid", intValue="4242")]},
        "scopeLogs": [{
            "scope": {"name": "lib"},
            "logRecords": [
                {"timeUnixNano": "1700000000000000001", "severityNumber": 17, "body": {"stringValue": "boom"},
                 "attributes": [kv("http.status", intValue="500"), kv("ratio", doubleValue=0.25),
                                kv("tags", arrayValue={"values": [{"stringValue": "a"}, {"intValue": "2"}]}),
                                kv("nested", kvlistValue={"values": [kv("k", boolValue=True)]}),
                                {"key": "novalue"}, kv("host.name", stringValue="overridden")],
                 "traceId": "5B8EFFF798038103D269B633813FC60C", "spanId": "EEE19B7EC3C1B174"},
                {"timeUnixNano": "0", "severityNumber": 10, "body": {"kvlistValue": {"values": [kv("a", intValue="1")]}}},
                {"severityNumber": "SEVERITY_NUMBER_WARN", "body": {"stringValue": "warned"}},
                {"body": {"stringValue": ""}},
            ],
        }],
    }, {
        "resource": {"attributes": []},
        "scopeLogs": [{"scope": {"name": "scoped"}, "logRecords": [{"severityNumber": 3, "body": {"stringValue": "s"}}]}],
    }]
}


def test_otlp_logs(spark, tmp_dir):
    valid, rejected = otlp.ingest_otlp_logs(spark, write(f"{tmp_dir}/ol", "l.json", OTLP_LOGS))
    rows = valid.select(
        "message", "level", "service", "trace_id", "span_id", "timestamp_ns",
        F.to_json(F.col("attributes")["tags"]).alias("tags"),
        F.to_json(F.col("attributes")["nested"]).alias("nested"),
        F.schema_of_variant(F.col("attributes")["http.status"]).alias("status_t"),
        F.variant_get(F.col("attributes")["resource.host.name"], "$", "string").alias("host"),
        F.variant_get(F.col("attributes")["resource.pid"], "$", "bigint").alias("pid"),
        F.map_contains_key("attributes", "novalue").alias("has_novalue"),
    ).collect()
    by = {r.message: r for r in rows}
    boom = by["boom"]
    assert (boom.level, boom.service, boom.timestamp_ns) == ("error", "checkout", 1700000000000000001)
    assert boom.trace_id == "5b8efff798038103d269b633813fc60c" and boom.span_id == "eee19b7ec3c1b174"
    assert boom.tags == '["a",2]' and boom.nested == '{"k":true}' and boom.status_t == "BIGINT"
    assert boom.host == "h1" and boom.pid == 4242 and boom.has_novalue is False
    assert by['{"a":1}'].level == "info" and by['{"a":1}'].timestamp_ns > 1700000000000000001
    assert by["warned"].level == "warn"
    assert by["s"].service == "scoped" and by["s"].level == "trace"
    assert [r.reject_reason for r in rejected.collect()] == ["message must not be empty"]


def test_otlp_spans(spark, tmp_dir):
    req = {"resourceSpans": [{
        "resource": {"attributes": [kv("service.name", stringValue="frontend")]},
        "scopeSpans": [{"scope": {"name": "x"}, "spans": [
            {"traceId": "5B8EFFF798038103D269B633813FC60C", "spanId": "EEE19B7EC3C1B174", "name": "GET /",
             "kind": 2, "startTimeUnixNano": "1700000000000000000", "endTimeUnixNano": "1700000000250000000",
             "status": {"code": 2, "message": "bad"},
             "events": [{"timeUnixNano": "1700000000100000000", "name": "retry", "attributes": [kv("n", intValue="1")]}]},
            {"traceId": "5B8EFFF798038103D269B633813FC60C", "spanId": "EEE19B7EC3C1B175",
             "parentSpanId": "EEE19B7EC3C1B174", "name": "", "kind": "SPAN_KIND_CLIENT",
             "startTimeUnixNano": "1700000000010000000", "endTimeUnixNano": "1700000000020000000"},
            {"traceId": "", "spanId": "AA", "name": "bad"},
        ]}],
    }]}
    valid, rejected = otlp.ingest_otlp_spans(spark, write(f"{tmp_dir}/os", "s.json", req))
    got = {r.span_id: r for r in valid.collect()}
    root, child = got["eee19b7ec3c1b174"], got["eee19b7ec3c1b175"]
    assert (root.kind, root.status, root.status_message, root.duration_ns) == ("server", "error", "bad", 250_000_000)
    assert root.events[0].name == "retry" and root.events[0].ts_ns == 1700000000100000000
    assert (child.name, child.kind, child.status, child.parent_span_id) == ("unknown", "client", "ok", "eee19b7ec3c1b174")
    assert child.service == "frontend"
    assert [r.reject_reason for r in rejected.collect()] == ["trace_id must not be empty"]


def test_otlp_metrics(spark, tmp_dir):
    req = {"resourceMetrics": [{
        "resource": {"attributes": [kv("service.name", stringValue="api")]},
        "scopeMetrics": [{"metrics": [
            {"name": "cpu", "unit": "1", "gauge": {"dataPoints": [
                {"asDouble": 0.5, "timeUnixNano": "1700000000000000000",
                 "attributes": [kv("host", stringValue="h"), kv("core", intValue="3")]},
                {"timeUnixNano": "1700000000000000000"}]}},
            {"name": "reqs", "sum": {"isMonotonic": True, "dataPoints": [{"asInt": "1523", "timeUnixNano": "1"}]}},
            {"name": "temp", "sum": {"isMonotonic": False, "dataPoints": [{"asDouble": 20.5, "timeUnixNano": "1"}]}},
            {"name": "latency", "histogram": {"dataPoints": [{
                "count": "100", "sum": 50.0, "bucketCounts": ["10", "20", "30", "40", "0"],
                "explicitBounds": [0.1, 0.5, 1.0, 5.0], "timeUnixNano": "1"}]}},
            {"name": "exp", "exponentialHistogram": {"dataPoints": [{"count": "1"}]}},
            {"name": "sum", "summary": {"dataPoints": [{"count": "1"}, {"count": "2"}]}},
        ]}],
    }]}
    path = write(f"{tmp_dir}/om", "m.json", req)
    valid, rejected = otlp.ingest_otlp_metrics(spark, path)
    got = {r.name: r for r in valid.collect()}
    assert set(got) == {"cpu", "reqs", "temp", "latency"}
    assert got["cpu"].labels == {"host": "h", "service": "api"} and got["cpu"].unit == "1"
    assert (got["reqs"].metric_type, got["reqs"].value) == ("counter", 1523.0)
    assert got["temp"].metric_type == "gauge"
    lat = got["latency"]
    assert (lat.metric_type, lat.value, lat.hist_count, len(lat.buckets)) == ("histogram", 50.0, 100, 4)
    assert {r.reject_reason: r.rejected for r in reject_report(rejected).collect()} == {
        "value must be present": 1, "exponential histogram points are not supported": 1, "summary points are not supported": 2}
    sent = [json.loads(r.raw_body) for r in rejected.collect() if "not supported" in r.reject_reason]
    assert sorted(s["summaryPoint"]["count"] for s in sent if "summaryPoint" in s) == ["1", "2"]  # as sent


def test_bucket_helpers(spark):
    df = spark.createDataFrame([([1.0, 2.0, 3.0], ["5", "6"]), ([], []), ([2.0, 1.0], ["1", "1"])],
                               "b array<double>, c array<string>")
    rows = df.select(zip_buckets("b", "c").alias("z")).select(
        "z", buckets_ascending("z").alias("asc"), bucket_total("z").alias("n")).collect()
    assert [len(r.z) for r in rows] == [2, 0, 2]
    assert [r.asc for r in rows] == [True, True, False]
    assert [r.n for r in rows] == [11, 0, 2]


def test_model_helpers(spark):
    from vigil.functions.model import attributes_as_text, is_root

    df = spark.createDataFrame([("p",), (None,)], "parent string").select(
        is_root("parent").alias("root"),
        attributes_as_text(F.from_json(F.lit('{"a": "x", "b": 2.0, "c": [1]}'), "map<string, variant>")).alias("t"),
    )
    rows = df.collect()
    assert [r.root for r in rows] == [False, True]
    assert rows[0].t == {"a": '"x"', "b": "2", "c": "[1]"} or rows[0].t["a"] == '"x"'


def test_otlp_anyvalue_nesting_and_empty(spark, tmp_dir):
    deep = {"arrayValue": {"values": [
        {"kvlistValue": {"values": [kv("a", arrayValue={"values": [{"intValue": "1"}, {"doubleValue": 2.5}, {}]}),
                                    {"key": "skip"}]}},
        {"boolValue": False},
    ]}}
    five = {"arrayValue": {"values": [{"arrayValue": {"values": [{"arrayValue": {"values": [
        {"arrayValue": {"values": [{"arrayValue": {"values": [{"intValue": "9"}]}}]}}]}}]}}]}}
    req = {"resourceLogs": [{"scopeLogs": [{"scope": {"name": "s"}, "logRecords": [
        {"body": {"stringValue": "x"},
         "attributes": [kv("deep", **deep), kv("empty"), kv("five", **five), kv("nan", doubleValue="NaN"),
                        kv("bytes", bytesValue="aGVsbG8=")]}]}]}]}
    valid, _ = otlp.ingest_otlp_logs(spark, write(f"{tmp_dir}/deep", "d.json", req))
    r = valid.select(
        F.to_json(F.col("attributes")["deep"]).alias("deep"),
        F.to_json(F.col("attributes")["empty"]).alias("empty"),
        F.to_json(F.col("attributes")["five"]).alias("five"),
        F.col("attributes")["nan"].isNull().alias("nan_null"),
        F.variant_get(F.col("attributes")["bytes"], "$", "string").alias("bytes"),
    ).first()
    assert r.deep == '[{"a":[1,2.5,null]},false]'
    assert r.empty == "null"  # present without a value -> JSON null (not absent)
    assert r.five == "[[[[[9]]]]]"
    assert r.nan_null is True and r.bytes == "aGVsbG8="


def test_otlp_base64_ids(spark, tmp_dir):
    import base64

    tid = base64.b64encode(bytes.fromhex("5b8efff798038103d269b633813fc60c")).decode()
    sid = base64.b64encode(bytes.fromhex("eee19b7ec3c1b174")).decode()
    req = {"resourceSpans": [{"scopeSpans": [{"scope": {"name": "x"}, "spans": [
        {"traceId": tid, "spanId": sid, "name": "n", "startTimeUnixNano": "1", "endTimeUnixNano": "2"}]}]}]}
    valid, _ = otlp.ingest_otlp_spans(spark, write(f"{tmp_dir}/b64", "s.json", req), id_encoding="base64")
    r = valid.first()
    assert (r.trace_id, r.span_id, r.service) == ("5b8efff798038103d269b633813fc60c", "eee19b7ec3c1b174", "x")


def test_reject_details_locate_bad_records(spark, tmp_dir):
    from vigil.sources.validate import reject_details

    valid, rejected = otlp.ingest_otlp_logs(spark, write(f"{tmp_dir}/loc", "l.json", OTLP_LOGS))
    rows = reject_details(rejected).collect()
    assert len(rows) == 1
    r = rows[0]
    assert r.source_file.endswith("/loc/l.json")
    assert (r.resource_index, r.scope_index, r.record_index) == (0, 0, 3)  # the 4th record has an empty body
    assert r.reject_reason == "message must not be empty"
    batch = [{"message": "ok", "service": "a"}, {"message": "", "service": "a"}]
    _, bad = native_json.ingest_logs(spark, write(f"{tmp_dir}/nat", "n.json", batch))
    assert [x.source_file.endswith("/nat/n.json") for x in reject_details(bad).collect()] == [True]


def test_valid_rows_keep_the_entity_schema(spark, tmp_dir):
    valid, _ = otlp.ingest_otlp_logs(spark, write(f"{tmp_dir}/schema", "l.json", OTLP_LOGS))
    assert not {"source_file", "record_index"} & set(valid.columns)


def any_values(spark, tmp_dir, *values, resource=()):
    """The attribute ``v`` of one log for each value, as JSON text, and the rejected records."""
    records = [{"timeUnixNano": "1", "body": {"stringValue": f"m{i}"}, "attributes": [{"key": "v", "value": v}]} for i, v in enumerate(values)]
    req = {"resourceLogs": [{"resource": {"attributes": list(resource)}, "scopeLogs": [{"scope": {"name": "s"}, "logRecords": records}]}]}
    valid, rejected = otlp.ingest_otlp_logs(spark, write(f"{tmp_dir}/any", "v.json", req))
    got = {r.message: r.v for r in valid.select("message", F.to_json(F.col("attributes")["v"]).alias("v")).collect()}
    return [got.get(f"m{i}") for i in range(len(values))], rejected


@pytest.mark.parametrize("text", [
    "user {} failed", "[]", "{", "}", "]", '"', "\\", '\\"', '{"stringValue":"x"}', '{"key":"a","value":{}}', "\x01\x02\x0e", "é{}日本", "{}" * 5000,
    '"values":[{}]', "", "a\nb\tc",
])
def test_strings_in_nested_values_are_opaque(spark, tmp_dir, text):
    string = {"stringValue": text}
    listed = {"arrayValue": {"values": [string, {"kvlistValue": {"values": [kv("k " + text, **string), kv("z", arrayValue={"values": [string]})]}}]}}
    (found,), rejected = any_values(spark, tmp_dir, listed)
    assert json.loads(found) == [text, {"k " + text: text, "z": [text]}]
    assert rejected.count() == 0


def test_missing_keys_and_values(spark, tmp_dir):
    nested = {"kvlistValue": {"values": [{"value": {"intValue": "1"}}, {"key": "none"}, kv("case"), kv("twice", intValue="1"), kv("twice", intValue="2")]}}
    resource = [{"value": {"stringValue": "x"}}, kv("service.name", stringValue="api"), {"key": "none"}]
    req = {"resourceLogs": [{"resource": {"attributes": resource}, "scopeLogs": [{"logRecords": [
        {"timeUnixNano": "1", "body": {"stringValue": "m"}, "attributes": [{"value": {"boolValue": True}}, kv("n", **nested), {"key": "none"}, {}]}]}]}]}
    valid, _ = otlp.ingest_otlp_logs(spark, write(f"{tmp_dir}/keys", "k.json", req))
    r = valid.select("service", F.transform_values("attributes", lambda _, v: F.to_json(v)).alias("a")).first()
    assert r.service == "api" and set(r.a) == {"", "n", "resource."}
    assert json.loads(r.a["n"]) == {"": 1, "case": None, "twice": 2} and r.a["resource."] == '"x"'
    point = {"attributes": [{"value": {"stringValue": "h"}}, kv("k", stringValue="v")], "timeUnixNano": "1", "asDouble": 1.0}
    req = {"resourceMetrics": [{"scopeMetrics": [{"metrics": [{"name": "m", "gauge": {"dataPoints": [point]}}]}]}]}
    valid, _ = otlp.ingest_otlp_metrics(spark, write(f"{tmp_dir}/keys_m", "m.json", req))
    assert valid.first().labels == {"": "h", "k": "v"}


def test_integers_that_are_none_are_rejected(spark, tmp_dir):
    bad = {"arrayValue": {"values": [{"intValue": "99999999999999999999"}]}}
    found, rejected = any_values(
        spark, tmp_dir, {"intValue": "12"}, {"intValue": "abc"}, {"intValue": "99999999999999999999"}, bad,
        {"arrayValue": {"values": [{"stringValue": '{"intValue":"abc"}'}, {"intValue": "-7"}]}}, {"intValue": str(-(2**63))},
    )
    assert found == ["12", None, None, None, '["{\\"intValue\\":\\"abc\\"}",-7]', str(-(2**63))]
    assert {r.reject_reason: r.rejected for r in reject_report(rejected).collect()} == {"attribute intValue is not an integer": 3}
    _, rejected = any_values(spark, f"{tmp_dir}/res", {"intValue": "1"}, resource=[kv("pid", intValue="x")])
    assert [r.reject_reason for r in rejected.collect()] == ["resource attribute intValue is not an integer"]


def test_quarantined_points_are_kept_as_sent(spark, tmp_dir):
    exp = {"count": "4", "sum": 2.5, "scale": 3, "positive": {"offset": 1, "bucketCounts": ["1", "3"]}, "attributes": [kv("host", stringValue="h {}")]}
    gauge = {"attributes": [], "timeUnixNano": "soon", "asDouble": 1.0}
    req = {"resourceMetrics": [{"scopeMetrics": [{"metrics": [
        {"name": "e", "gauge": {"dataPoints": [gauge]}, "exponentialHistogram": {"dataPoints": [{"count": "1"}, exp]}}]}]}]}
    _, rejected = otlp.ingest_otlp_metrics(spark, write(f"{tmp_dir}/exp", "e.json", req))
    rows = [json.loads(r.raw_body) for r in rejected.collect()]
    assert [r["exponentialHistogramPoint"] for r in rows if "exponentialHistogramPoint" in r][1] == exp
    assert [r["gaugePoint"]["timeUnixNano"] for r in rows if "gaugePoint" in r] == ["soon"] and {r["name"] for r in rows} == {"e"}


@pytest.mark.parametrize("text,ns", [
    ("12:30", None), ("2024", None), ("2024-01-01", None), ("2024-01-01 10:00", None), ("2024-01-01T10:00:00", None), ("now", None),
    ("2024-13-01T10:00:00Z", None), (" 2024-01-01T10:00:00Z", None), ("2024-01-01T10:00:00Z", 1704103200 * 10**9),
    ("2024-01-01t10:00:00z", 1704103200 * 10**9), ("2024-01-01 10:00:00.123456789+02:00", 1704096000123456789),
])
def test_request_times_are_rfc3339(spark, text, ns):
    got = spark.createDataFrame([(text,)], "t string").select(native_json.rfc3339_to_ns(F.col("t")).alias("ns")).first()
    assert got.ns == ns


def test_deep_values_are_converted_in_one_go(spark, monkeypatch):
    """The way of one pass for each level is for odd text only, and both ways agree."""
    inner = '{"kvlistValue":{"values":[{"key":"]}}","value":{"stringValue":"}]}}"}},{"key":"gone"},{"value":{"arrayValue":{}}}]}}'
    odd = '{"arrayValue":{"values":[{"intValue":"1}2"},{"foo":[1]}]}}'
    texts = ['{"arrayValue":{"values":[' * n + inner + "]}}" * n for n in (1, 10, 200)] + [odd]
    df = spark.createDataFrame(list(enumerate(texts)), "i int, t string").orderBy("i")
    both = df.select(F.to_json(otlp.nested_value(F.col("t"))).alias("v"), otlp._at_once(F.col("t")).alias("fast")).collect()
    monkeypatch.setattr(otlp, "_at_once", lambda text: F.lit(None).cast("string"))
    slow = df.select(F.to_json(otlp.nested_value(F.col("t"))).alias("v")).collect()
    assert [r.v for r in both] == [r.v for r in slow]
    assert [r.fast is None for r in both] == [False, False, False, True]
    assert json.loads(both[1].fast) == json.loads("[" * 10 + '{"]}}":"}]}}","":[]}' + "]" * 10)
