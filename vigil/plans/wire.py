"""Wire-format requests derived from the test tables, for the ingest queries.

Each entity row becomes one JSON request body (native JSON or OTLP/JSON) in a
string column — one request per row, so nothing is grouped and the work grows
linearly with the tables. The ingest queries then parse these bodies with the
same explicit schemas and flattening code that ``spark.read.json`` feeds in
production (:mod:`vigil.sources.native_json`, :mod:`vigil.sources.otlp`).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vigil import schemas
from vigil.functions.timefn import ns_to_ms
from vigil.sources.otlp import unnest

# severity number sent for each level (the first number of its OTLP range)
LEVEL_SEVERITY = {"trace": 1, "debug": 5, "info": 9, "warn": 13, "error": 17, "fatal": 21}
KIND_CODE = {"internal": 1, "server": 2, "client": 3, "producer": 4, "consumer": 5}
INVALID_EVERY = 97  # every 97th native log is sent without a service (a reject)


def _any(string=None, integer=None, double=None, boolean=None) -> Column:
    return F.struct(
        (string if string is not None else F.lit(None)).cast("string").alias("stringValue"),
        (integer if integer is not None else F.lit(None)).cast("string").alias("intValue"),
        (double if double is not None else F.lit(None)).cast("double").alias("doubleValue"),
        (boolean if boolean is not None else F.lit(None)).cast("boolean").alias("boolValue"),
    )


def _kv(key: str, value: Column) -> Column:
    return F.struct(F.lit(key).alias("key"), value.alias("value"))


def _hex(col: str) -> Column:
    return F.upper(F.hex(F.col(col)))


def _rfc3339(ts: str) -> Column:
    return F.date_format(F.col(ts), "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'")


def _map_case(col: str, table: dict[str, int]) -> Column:
    out = None
    for name, code in table.items():
        out = F.when(F.col(col) == name, F.lit(code)) if out is None else out.when(F.col(col) == name, F.lit(code))
    return out


def _damaged(body: Column, key: Column, time_field: str, *edit: str) -> Column:
    """Three fifths of the bodies damaged by ``key``: cut short, with a time that is no number, and with
    ``edit`` (a pattern and its replacement, if given) applied."""
    kind = key % 5
    out = F.when(kind == 0, F.substring(body, F.lit(1), F.length(body) - 2)).when(
        kind == 1, F.regexp_replace(body, rf'"{time_field}":"[0-9]+"', f'"{time_field}":"12x"')
    )
    if edit:
        out = out.when(kind == 2, F.regexp_replace(body, *edit))
    return out.otherwise(body)


def _spread(entities: DataFrame) -> DataFrame:
    """The rows over all cores: requests come from many senders, the test table is one small file."""
    return entities.repartition(entities.sparkSession.sparkContext.defaultParallelism)


def _parsed(bodies: DataFrame, schema: str) -> DataFrame:
    """Parse each body once with the ingest schema, keeping what cannot be read as the readers do.

    The parse sits under a generator, so predicates (validation) cannot be
    pushed below it and re-inline ``from_json`` once per referenced field.
    """
    request = F.from_json("body", f"{schema}, {schemas.CORRUPT} string", {"columnNameOfCorruptRecord": schemas.CORRUPT})
    return unnest(bodies.select(F.array(request).alias("_request")), "_request", [])


RECORDS_PER_REQUEST = 50


def otlp_log_batches(logs: DataFrame) -> DataFrame:
    """Requests of up to RECORDS_PER_REQUEST records, with a resource for each service in them."""
    record = _log_record()
    per_service = _spread(logs).groupBy("service", F.call_function("div", F.col("log_id"), F.lit(RECORDS_PER_REQUEST)).alias("_request")).agg(
        F.collect_list(record).alias("records")
    )
    resource = F.struct(
        F.struct(F.array(_kv("service.name", _any(string=F.col("service")))).alias("attributes")).alias("resource"),
        F.array(F.struct(F.struct(F.lit("vigil").alias("name")).alias("scope"), F.col("records").alias("logRecords"))).alias("scopeLogs"),
    )
    requests = per_service.groupBy("_request").agg(F.collect_list(resource).alias("resourceLogs"))
    return _parsed(requests.select(F.to_json(F.struct("resourceLogs")).alias("body")), schemas.OTLP_LOGS)


def otlp_histogram_requests(metrics: DataFrame) -> DataFrame:
    """Each value as a histogram of three observations around it: one below, two up to one above."""
    point = F.struct(
        F.array(_kv("point_id", _any(string=F.col("point_id").cast("string")))).alias("attributes"),
        F.col("timestamp_ns").cast("string").alias("timeUnixNano"),
        F.lit("3").alias("count"), F.col("value").alias("sum"),
        F.array(F.lit("1"), F.lit("2"), F.lit("0")).alias("bucketCounts"),
        F.array(F.col("value"), F.col("value") + 1).alias("explicitBounds"),
    )
    metric = F.struct(F.col("name").alias("name"), F.struct(F.array(point).alias("dataPoints")).alias("histogram"))
    body = F.to_json(F.struct(F.array(F.struct(
        F.struct(F.array(_kv("service.name", _any(string=F.col("service")))).alias("attributes")).alias("resource"),
        F.array(F.struct(F.array(metric).alias("metrics"))).alias("scopeMetrics"),
    )).alias("resourceMetrics")))
    return _parsed(_spread(metrics).select(body.alias("body")), schemas.OTLP_METRICS)


def otlp_log_requests(logs: DataFrame, damaged: bool = False) -> DataFrame:
    record = _log_record()
    resource = F.struct(F.array(
        _kv("service.name", _any(string=F.col("service"))),
        _kv("host", _any(string=F.concat(F.lit("h-"), (F.col("log_id") % 3).cast("string")))),
    ).alias("attributes"))
    body = F.to_json(F.struct(F.array(F.struct(
        resource.alias("resource"),
        F.array(F.struct(F.struct(F.lit("vigil").alias("name")).alias("scope"), F.array(record).alias("logRecords")))
        .alias("scopeLogs"),
    )).alias("resourceLogs")))
    if damaged:
        body = _damaged(body, F.col("log_id"), "timeUnixNano", r'"intValue":"[0-9]+"', '"intValue":"99999999999999999999"')
    return _parsed(_spread(logs).select(body.alias("body")), schemas.OTLP_LOGS)


def _log_record() -> Column:
    attr = lambda key: F.col("attributes")[key]
    k = F.try_variant_get(attr("k"), "$", "bigint")
    always = [
        _kv("log_id", _any(integer=F.col("log_id"))),
        _kv("type", _any(string=F.try_variant_get(attr("type"), "$", "string"))),
        _kv("value", _any(double=F.try_variant_get(attr("value"), "$", "double"))),
        _kv("failed", _any(boolean=F.try_variant_get(attr("failed"), "$", "boolean"))),
    ]
    return F.struct(
        F.col("timestamp_ns").cast("string").alias("timeUnixNano"),
        _map_case("level", LEVEL_SEVERITY).alias("severityNumber"),
        F.struct(F.col("message").alias("stringValue")).alias("body"),
        # only k can be absent: two literal arrays under CASE (no per-row lambda)
        F.when(k.isNull(), F.array(*always)).otherwise(F.array(_kv("k", _any(integer=k)), *always))
        .alias("attributes"),
        _hex("trace_id").alias("traceId"),
        _hex("span_id").alias("spanId"),
    )


def _text(value: Column) -> Column:
    """A string as JSON text."""
    return F.regexp_replace(F.to_json(F.struct(value.alias("s"))), r'^\{"s":|\}$', "")


def otlp_nested_requests(logs: DataFrame, depth: int = 10) -> DataFrame:
    """Log requests whose strings and keys hold brackets, escapes and names of wire fields, with nested values,
    entries without key or value, and arrays nested ``depth`` deep."""
    number = F.concat(F.lit('{"intValue":"'), F.col("log_id").cast("string"), F.lit('"}'))
    service = F.concat(F.lit('{"stringValue":'), _text(F.col("service")), F.lit("}"))
    small = F.concat(F.lit('{"intValue":'), (F.col("log_id") % 7).cast("string"), F.lit("}"))
    listed = F.concat(
        F.lit('{"arrayValue":{"values":[{"stringValue":'), _text(F.concat("message", F.lit(' {} "[{\\'))), F.lit("},{},"), number,
        F.lit(',{"boolValue":true},{"arrayValue":{}},{"kvlistValue":{"values":[{"key":"a {} b","value":'), service,
        F.lit('},{"key":"dropped"},{"value":'), small,
        F.lit('},{"value":{"arrayValue":{"values":[{"stringValue":"{\\"intValue\\":\\"1\\"}"}]}},"key":"stringValue"}]}}]}}'),
    )
    deep = F.concat(F.lit('{"arrayValue":{"values":[' * depth), number, F.lit("]}}" * depth))
    body = F.concat(
        F.lit('{"resourceLogs":[{"resource":{"attributes":[{"key":"service.name","value":'), service, F.lit('},{"value":'), service,
        F.lit('}]},"scopeLogs":[{"logRecords":[{"timeUnixNano":"'), F.col("timestamp_ns").cast("string"),
        F.lit('","body":{"stringValue":'), _text(F.concat(F.lit("tpl {} "), "message", F.lit(" [end]"))),
        F.lit('},"attributes":[{"key":"log_id","value":'), number, F.lit('},{"key":"list","value":'), listed,
        F.lit('},{"key":"deep","value":'), deep, F.lit('},{"value":'), service, F.lit('},{"key":"valueless"}]}]}]}]}'),
    )
    return _parsed(_spread(logs).select(body.alias("body")), schemas.OTLP_LOGS)


def otlp_span_requests(spans: DataFrame, damaged: bool = False) -> DataFrame:
    span = F.struct(
        _hex("trace_id").alias("traceId"),
        _hex("span_id").alias("spanId"),
        _hex("parent_span_id").alias("parentSpanId"),
        F.col("name").alias("name"),
        _map_case("kind", KIND_CODE).alias("kind"),
        F.col("start_ns").cast("string").alias("startTimeUnixNano"),
        F.col("end_ns").cast("string").alias("endTimeUnixNano"),
        F.array(_kv("operation", _any(string=F.col("operation")))).alias("attributes"),
        F.struct(F.when(F.col("status") == "error", F.lit(2)).otherwise(F.lit(1)).alias("code")).alias("status"),
    )
    resource = F.struct(F.array(_kv("service.name", _any(string=F.col("service")))).alias("attributes"))
    body = F.to_json(F.struct(F.array(F.struct(
        resource.alias("resource"),
        F.array(F.struct(F.struct(F.lit("vigil").alias("name")).alias("scope"), F.array(span).alias("spans")))
        .alias("scopeSpans"),
    )).alias("resourceSpans")))
    if damaged:
        body = _damaged(body, F.unix_micros("ts"), "startTimeUnixNano", r'"endTimeUnixNano":"[0-9]+"', '"endTimeUnixNano":"1"')
    return _parsed(_spread(spans).select(body.alias("body")), schemas.OTLP_SPANS)


def otlp_metric_requests(metrics: DataFrame, damaged: bool = False) -> DataFrame:
    point = F.struct(
        F.array(_kv("host", _any(string=F.col("labels")["host"]))).alias("attributes"),
        F.col("timestamp_ns").cast("string").alias("timeUnixNano"),
        F.col("value").alias("asDouble"),
    )
    is_counter = F.col("metric_type") == "counter"
    metric = F.struct(
        F.col("name").alias("name"),
        F.lit("1").alias("unit"),
        F.when(~is_counter, F.struct(F.array(point).alias("dataPoints"))).alias("gauge"),
        F.when(is_counter, F.struct(F.array(point).alias("dataPoints"), F.lit(True).alias("isMonotonic"))).alias("sum"),
    )
    resource = F.struct(F.array(_kv("service.name", _any(string=F.col("service")))).alias("attributes"))
    body = F.to_json(F.struct(F.array(F.struct(
        resource.alias("resource"),
        F.array(F.struct(F.array(metric).alias("metrics"))).alias("scopeMetrics"),
    )).alias("resourceMetrics")))
    if damaged:
        body = _damaged(body, F.col("point_id"), "timeUnixNano", r',"asDouble":[-0-9.E]+', "")
    return _parsed(_spread(metrics).select(body.alias("body")), schemas.OTLP_METRICS)


def native_log_requests(logs: DataFrame) -> DataFrame:
    invalid = F.col("log_id") % INVALID_EVERY == 0
    body = F.to_json(F.struct(
        _rfc3339("ts").alias("timestamp"),
        F.upper("level").alias("level"),
        F.col("message").alias("message"),
        F.when(invalid, F.lit("")).otherwise(F.col("service")).alias("service"),
        F.map_concat(F.col("attributes"), F.create_map(F.lit("log_id"), F.col("log_id").cast("variant")))
        .alias("attributes"),
        F.col("trace_id").alias("trace_id"),
        F.col("span_id").alias("span_id"),
    ))
    return _parsed(_spread(logs).select(body.alias("body")), schemas.NATIVE_LOG)


def native_span_requests(spans: DataFrame) -> DataFrame:
    body = F.to_json(F.struct(
        "trace_id", "span_id", "parent_span_id", "name", "service", "kind", "status",
        ns_to_ms("duration_ns").alias("duration_ms"),
        _rfc3339("ts").alias("start_time"),
    ))
    return _parsed(_spread(spans).select(body.alias("body")), schemas.NATIVE_SPAN)


def native_metric_requests(metrics: DataFrame) -> DataFrame:
    body = F.to_json(F.struct(
        "name", "metric_type", "value", "labels", _rfc3339("ts").alias("timestamp"),
    ))
    return _parsed(_spread(metrics).select(body.alias("body")), schemas.NATIVE_METRIC)


__all__ = [
    "native_log_requests",
    "native_metric_requests",
    "native_span_requests",
    "otlp_histogram_requests",
    "otlp_log_batches",
    "otlp_log_requests",
    "otlp_metric_requests",
    "otlp_nested_requests",
    "otlp_span_requests",
]
