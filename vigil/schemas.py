"""Schemas: stored entities (§1.2) and the JSON inputs, as DDL strings.

Explicit schemas everywhere — no inference on read. OTLP 64-bit integers
arrive as JSON strings, so they are declared STRING and cast; every AnyValue
is read as VARIANT and unwrapped by :mod:`vigil.sources.otlp`.
"""

LOG = (
    "timestamp_ns bigint, ts timestamp, level string, message string, service string, "
    "attributes map<string, variant>, trace_id string, span_id string"
)
BUCKET = "struct<upper_bound: double, count: bigint>"
METRIC = (
    "timestamp_ns bigint, ts timestamp, name string, metric_type string, value double, "
    f"buckets array<{BUCKET}>, hist_count bigint, labels map<string, string>, service string, "
    "description string, unit string"
)
SPAN_EVENT = "struct<ts_ns: bigint, name: string, attributes: map<string, variant>>"
SPAN = (
    "trace_id string, span_id string, parent_span_id string, name string, operation string, service string, "
    "kind string, status string, status_message string, start_ns bigint, end_ns bigint, duration_ns bigint, "
    f"ts timestamp, attributes map<string, variant>, events array<{SPAN_EVENT}>"
)

# What a reader could not fit into its schema, as it stood in the file (readers add it to every request).
CORRUPT = "_corrupt_record"

# When a batch of a stream was received (streams add it to every request): stands for absent times, the same on a replay.
RECEIVED = "received_at"

# Native JSON request bodies (one object, an array of objects, or JSON lines).
NATIVE_LOG = (
    "timestamp string, level string, message string, service string, attributes map<string, variant>, "
    "trace_id string, span_id string"
)
NATIVE_METRIC = (
    "name string, metric_type string, value double, labels map<string, string>, description string, "
    "unit string, timestamp string, buckets array<struct<upper_bound: double, count: bigint>>"
)
NATIVE_SPAN = (
    "trace_id string, span_id string, parent_span_id string, name string, service string, kind string, "
    "status string, attributes map<string, variant>, duration_ms bigint, start_time string"
)

# OTLP/JSON export requests. An AnyValue reads as a struct of its scalar
# cases (plain columns, code-generated); only nested arrays / kvlists stay
# VARIANT and are unwrapped recursively.
ANY_VALUE = (
    "struct<stringValue: string, boolValue: boolean, intValue: string, doubleValue: double, "
    "bytesValue: string, arrayValue: variant, kvlistValue: variant>"
)
KV = f"array<struct<key: string, value: {ANY_VALUE}>>"
RESOURCE = f"struct<attributes: {KV}>"
SCOPE = "struct<name: string, version: string>"
OTLP_LOGS = (
    f"resourceLogs array<struct<resource: {RESOURCE}, scopeLogs: array<struct<scope: {SCOPE}, "
    "logRecords: array<struct<timeUnixNano: string, observedTimeUnixNano: string, severityNumber: string, "
    f"severityText: string, body: {ANY_VALUE}, attributes: {KV}, traceId: string, spanId: string>>>>>>"
)
OTLP_SPANS = (
    f"resourceSpans array<struct<resource: {RESOURCE}, scopeSpans: array<struct<scope: {SCOPE}, "
    "spans: array<struct<traceId: string, spanId: string, parentSpanId: string, name: string, kind: string, "
    f"startTimeUnixNano: string, endTimeUnixNano: string, attributes: {KV}, "
    f"events: array<struct<timeUnixNano: string, name: string, attributes: {KV}>>, "
    "status: struct<code: string, message: string>>>>>>>"
)
_NUMBER_POINT = f"struct<attributes: {KV}, timeUnixNano: string, asDouble: double, asInt: string>"
_HIST_POINT = (
    f"struct<attributes: {KV}, timeUnixNano: string, count: string, sum: double, "
    "bucketCounts: array<string>, explicitBounds: array<double>>"
)
OTLP_METRICS = (
    f"resourceMetrics array<struct<resource: {RESOURCE}, scopeMetrics: array<struct<scope: {SCOPE}, "
    "metrics: array<struct<name: string, unit: string, description: string, "
    f"gauge: struct<dataPoints: array<{_NUMBER_POINT}>>, "
    f"sum: struct<dataPoints: array<{_NUMBER_POINT}>, isMonotonic: boolean, aggregationTemporality: string>, "
    f"histogram: struct<dataPoints: array<{_HIST_POINT}>>, "
    "exponentialHistogram: struct<dataPoints: array<variant>>, summary: struct<dataPoints: array<variant>>>>>>>>"
)
