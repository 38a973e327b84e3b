"""OTLP/JSON ingest (I4–I6) with the conversion rules O1–O7.

``spark.read.schema(...).json`` parses export requests with each AnyValue as a
struct of its scalar cases (nested arrays / kvlists as VARIANT); :func:`unnest`
flattens resource -> scope -> record, computing resource-level fields once per
resource; each conversion rule is a column expression. A request file in
``multiLine`` mode is one task (request bodies are bounded, 10 MB in the
reference); JSON-lines files (one request per line, as written by file
exporters) split like any text input.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from vigil import schemas
from vigil.functions.model import level_order
from vigil.functions.timefn import ns_to_ts
from vigil.session import configure
from vigil.sources.validate import LOCATION as VALIDATE_LOCATION
from vigil.sources.validate import (
    INPUT_ERROR,
    first_error,
    log_reject_reason,
    metric_reject_reason,
    received_ns,
    span_reject_reason,
    split_valid,
    tag,
    unreadable_requests,
    zip_buckets,
)

# ---------------------------------------------------------------------------
# FIXED VALUES — OTLP enumerations as the reference maps them.
# severity_number ranges -> level; anything else is info.
# ---------------------------------------------------------------------------
SEVERITY_RANGES = ((1, 4, "trace"), (5, 8, "debug"), (13, 16, "warn"), (17, 20, "error"), (21, 24, "fatal"))
SPAN_KIND_CODES = {2: "server", 3: "client", 4: "producer", 5: "consumer"}  # else internal
STATUS_ERROR_CODE = 2  # else ok
SERVICE_NAME_KEY = "service.name"
RESOURCE_PREFIX = "resource."


# A string of compact JSON, and text without brackets (of masked JSON text)
_STR = r'"[^"\\]*+(?:\\.[^"\\]*+)*+"'
_FLAT = r"[^\[\]{}]*+"
# Brackets inside strings are masked before any conversion: compact JSON holds no bare control
# characters, so what a user wrote is never taken for structure.
_BRACKETS, _MASKS = "{}[]", "\x0e\x0f\x10\x11"
# One conversion pass, innermost values first. Converted objects and arrays get control
# characters for brackets, so user keys that look like wire fields are not converted twice;
# \x01 marks an entry without a value, \x06 a value without a case (JSON null).
_PASS = (
    (rf'\{{"(?:stringValue|bytesValue)":({_STR})\}}', "$1"),
    (r'\{"boolValue":(true|false)\}', "$1"),
    (r'\{"intValue":"?(-?[0-9]+)"?\}', "$1"),
    (r'\{"doubleValue":(-?[0-9][0-9.eE+-]*)\}', "$1"),
    (r'\{"doubleValue":"?[A-Za-z-]+"?\}|\{\}|\{"(?:string|bool|int|double|bytes)Value":null\}', "\x06"),
    (r'\{"arrayValue":(?:null|\x06)\}|\{"arrayValue":\{"values":null\}\}', "\x04\x05"),
    (r'\{"kvlistValue":(?:null|\x06)\}|\{"kvlistValue":\{"values":null\}\}', "\x02\x03"),
    (rf'\{{"key":{_STR},"value":null\}}|\{{"key":{_STR}\}}|\{{"value":null\}}', "\x01"),
    (rf'\{{"key":({_STR}),"value":({_FLAT})\}}', "$1:$2"),
    (rf'\{{"value":({_FLAT})\}}', '"":$1'),
    (rf'\{{"arrayValue":\{{"values":\[({_FLAT})\]\}}\}}', "\x04$1\x05"),
    (rf'\{{"kvlistValue":\{{"values":\[({_FLAT})\]\}}\}}', "\x02$1\x03"),
)


def masked(text: Column) -> Column:
    """Compact JSON text with the brackets inside its strings masked, in one pass over the text."""
    parts = F.regexp_extract_all(text, F.lit(rf'({_STR}|[^"]++)'))
    return F.array_join(
        F.transform(parts, lambda p: F.when(p.startswith('"'), F.translate(p, _BRACKETS, _MASKS)).otherwise(p)), ""
    )


def _nesting(text: Column) -> Column:
    """How deep the brackets of masked JSON text nest."""
    brackets = F.regexp_replace(text, r"[^\[\]{}]++", "")
    start = F.struct(F.lit(0).alias("at"), F.lit(0).alias("most"))

    def step(acc: Column, c: Column) -> Column:
        at = acc["at"] + F.when(c.isin("[", "{"), 1).when(c.isin("]", "}"), -1).otherwise(0)
        return F.struct(at.alias("at"), F.greatest(acc["most"], at).alias("most"))

    return F.aggregate(F.split(brackets, ""), start, step, lambda acc: acc["most"])


# The same conversion in one go, for text that is an AnyValue throughout. No string of compact JSON
# holds {" and a name, so what begins with them needs no mask. Once scalars, empty values and what
# opens a value are converted, the other brackets tell what they are by themselves: "]}}" ends an
# array or a kvlist, any other "}" ends an entry, and only kvlists end behind an entry. \x07 and \x08
# stand around the key of an entry, \x0e behind its value; \x0b and \x0c are an empty array and kvlist.
_LEAVES = (
    (rf'\{{"(?:(?:stringValue|bytesValue)":({_STR})|boolValue":(true|false)|intValue":"?(-?[0-9]+)"?'
     r'|doubleValue":(-?[0-9][0-9.eE+-]*))\}', "$1$2$3$4"),
    (r'\{"(?:doubleValue":"?[A-Za-z-]+"?|(?:string|bool|int|double|bytes)Value":null)\}', "\x06"),
    (r'\{"arrayValue":(?:null|\{(?:"values":(?:null|\[\]))?\})\}', "\x0b"),
    (r'\{"kvlistValue":(?:null|\{(?:"values":(?:null|\[\]))?\})\}', "\x0c"),
    (rf'\{{(?:"key":{_STR}(?:,"value":null)?|"value":null)\}}', "\x01"),
    (rf'\{{"key":({_STR}),"value":', "\x07$1\x08"),
)
_OPENED = (('{"arrayValue":{"values":[', "\x04"), ('{"kvlistValue":{"values":[', "\x02"), ('{"value":', '\x07""\x08'))
# brackets outside strings: each match takes the strings before it
_CLOSED = tuple(
    (rf'\G((?:{_STR}|[^"\{found[0]}]++)*+)' + "".join("\\" + c for c in found), "$1" + to)
    for found, to in (("{}", "\x06"), ("]}}", "\x05"), ("}", "\x0e"))
)
# What follows what in such text: values in arrays, entries in kvlists, one value in an entry. As the text was
# JSON, its brackets match, and an object with more members would show a colon.
_VALUE = r"(?=[^,:{}\[\]\x01\x03\x05\x07\x08\x0e])"
_WELL_FORMED = (
    rf"^(?:\x04{_VALUE}|\x02(?=[\x07\x01])|\x07{_STR}\x08{_VALUE}"
    rf'|(?:{_STR}|[^\x01-\x0f",:{{}}\[\]]++|[\x03\x05\x06\x0b\x0c])(?=[,\x05\x0e]|\z)'
    rf"|[\x0e\x01](?=[,\x03])|(?<=[\x0e\x01]),(?=[\x07\x01])|(?<![\x0e\x01]),{_VALUE})++\z"
)
_SHOWN = (("\x02", "{"), ("\x03", "}"), ("\x04", "["), ("\x05", "]"), ("\x06", "null"), ("\x07", ""), ("\x08", ":"), ("\x0e", ""),
          ("\x0b", "[]"), ("\x0c", "{}"))


def _replaced(text: Column, *pairs: tuple[str, str]) -> Column:
    for found, to in pairs:
        text = F.replace(text, F.lit(found), F.lit(to))
    return text


def _at_once(text: Column) -> Column:
    """Compact AnyValue text with all its levels converted; NULL if some part of it is no AnyValue."""
    for pattern, to in _LEAVES:
        text = F.regexp_replace(text, pattern, to)
    text = _replaced(text, *_OPENED)
    for pattern, to in _CLOSED:
        text = F.regexp_replace(text, pattern, to)
    text = _replaced(text, ("\x0e\x05", "\x0e\x03"), ("\x01\x05", "\x01\x03"))

    def finish(t: Column) -> Column:
        dropped = F.regexp_replace(t, r"(?<=\x02)(?:\x01,?)++|,\x01", "")
        return F.when(t.rlike(_WELL_FORMED), _replaced(F.when(t.contains("\x01"), dropped).otherwise(t), *_SHOWN))

    return _once(text, finish)


def _once(value: Column, use) -> Column:
    """``use(value)`` with the value computed once and not per use: as the one element of an array."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def _level_by_level(safe: Column) -> Column:
    """Masked text with every AnyValue in it converted, innermost first, in as many passes as brackets nest."""
    def one_pass(t: Column, _: Column) -> Column:
        for pattern, to in _PASS:
            t = F.regexp_replace(t, pattern, to)
        return t

    plain = F.aggregate(F.sequence(F.lit(1), F.greatest(_nesting(safe), F.lit(1))), safe, one_pass)
    plain = F.regexp_replace(F.regexp_replace(plain, r"(?<=[\x02\x04])(?:\x01,?)+|,\x01", ""), r"\x06", "null")
    return F.translate(plain, "\x02\x03\x04\x05" + _MASKS, "{}[]" + _BRACKETS)


def nested_value(text: Column) -> Column:
    """An array or kvlist AnyValue as compact OTLP JSON text -> its plain JSON value, at any depth.

    Strings are opaque: what they hold never counts as structure. The work grows with the
    text, not with its depth; only text with parts that are no AnyValue is converted level
    by level. Text that is no well-formed AnyValue stays text.
    """
    def convert(t: Column) -> Column:
        plain = F.coalesce(_at_once(t), _once(masked(t), _level_by_level))
        return F.coalesce(F.try_parse_json(plain), t.cast("variant"))

    return _once(text, convert)


def _nested_text(av: Column) -> Column:
    """The array or kvlist of an AnyValue as compact OTLP JSON text."""
    array, kvlist = av["arrayValue"], av["kvlistValue"]
    nested = F.concat(
        F.when(array.isNotNull(), F.lit('{"arrayValue":')).otherwise(F.lit('{"kvlistValue":')),
        F.to_json(F.coalesce(array, kvlist)), F.lit("}"),
    )
    return F.regexp_replace(nested, r'^\{"(arrayValue|kvlistValue)":\{\}\}$', '{"$1":null}')


def not_integer(av: Column) -> Column:
    """TRUE if an AnyValue, or one inside it, was sent as an integer that does not read as one."""
    # in compact JSON no string holds {" and a name, so nothing needs to be masked; short integers need no further look
    def bad(text: Column) -> Column:
        found = F.regexp_extract_all(text, F.lit(r'\{"intValue":"?((?<=")[^"]*+|(?<!")[^"}]*+)"?\}'))
        doubtful = text.rlike(r'\{"intValue":(?!"-?[0-9]{1,18}"|-?[0-9]{1,18}\})')
        return doubtful & F.exists(found, lambda n: (n != "null") & n.try_cast("bigint").isNull())

    holds = av["arrayValue"].isNotNull() | av["kvlistValue"].isNotNull()
    own = av["intValue"].isNotNull() & av["intValue"].try_cast("bigint").isNull()
    return F.coalesce(own, F.lit(False)) | F.when(holds, bad(_nested_text(av))).otherwise(F.lit(False))


def any_not_integer(kvs: Column) -> Column:
    """TRUE if the value of some attribute is such an integer."""
    return F.exists(F.coalesce(kvs, F.array()), lambda kv: F.coalesce(not_integer(kv["value"]), F.lit(False)))


def any_value(av: Column, empty_is_null: bool = False) -> Column:
    """O1: an OTLP AnyValue struct -> its plain JSON value as VARIANT.

    string/bool/int/double/bytes map to scalars (int64 arrives as a JSON string;
    non-finite doubles become null; bytes stay base64 text); arrays and kvlists
    recurse without bound. A value with no case set is JSON null, or SQL NULL with
    ``empty_is_null`` (a log body).
    """
    d = av["doubleValue"]
    finite = ~(F.isnan(d) | (F.abs(d) == F.lit(float("inf"))))
    out = (
        F.when(av["stringValue"].isNotNull(), av["stringValue"].cast("variant"))
        .when(av["boolValue"].isNotNull(), av["boolValue"].cast("variant"))
        .when(av["intValue"].isNotNull(), av["intValue"].try_cast("bigint").cast("variant"))
        .when(d.isNotNull(), F.when(finite, d.cast("variant")))
        .when(av["bytesValue"].isNotNull(), av["bytesValue"].cast("variant"))
        .when(av["arrayValue"].isNotNull() | av["kvlistValue"].isNotNull(), nested_value(_nested_text(av)))
    )
    return out if empty_is_null else out.otherwise(F.when(av.isNotNull(), F.parse_json(F.lit("null"))))


def _key(kv: Column) -> Column:
    """The key of an attribute; JSON leaves out empty strings."""
    return F.coalesce(kv["key"], F.lit(""))


def attributes_map(kvs: Column) -> Column:
    """O2: KeyValue list -> MAP<STRING, VARIANT>, valueless keys dropped, a missing key is empty, last key wins."""
    present = F.filter(F.coalesce(kvs, F.array()), lambda kv: kv["value"].isNotNull())
    entries = F.transform(present, lambda kv: F.struct(_key(kv).alias("key"), any_value(kv["value"]).alias("value")))
    return F.map_from_entries(entries)


def string_attributes(kvs: Column) -> Column:
    """O3: metric labels keep string-valued attributes only."""
    strs = F.transform(
        F.coalesce(kvs, F.array()),
        lambda kv: F.struct(_key(kv).alias("key"), kv["value"]["stringValue"].alias("value")),
    )
    return F.map_from_entries(F.filter(strs, lambda kv: kv["value"].isNotNull()))


def resource_service(resource: Column) -> Column:
    """The resource's ``service.name`` when it is a string, else NULL."""
    named = F.filter(F.coalesce(resource["attributes"], F.array()), lambda kv: kv["key"] == F.lit(SERVICE_NAME_KEY))
    return F.try_element_at(named, F.lit(-1))["value"]["stringValue"]


def resource_attributes(resource: Column) -> Column:
    """Other resource attributes as ``resource.<key>``."""
    others = F.filter(
        F.coalesce(resource["attributes"], F.array()),
        lambda kv: (_key(kv) != F.lit(SERVICE_NAME_KEY)) & kv["value"].isNotNull(),
    )
    return F.map_from_entries(
        F.transform(
            others,
            lambda kv: F.struct(F.concat(F.lit(RESOURCE_PREFIX), _key(kv)).alias("key"), any_value(kv["value"]).alias("value")),
        )
    )


def _records(requests: DataFrame, resources: str, scopes: str, records: str) -> DataFrame:
    """resource -> scope -> record rows, with the resource- and scope-level fields
    (service, ``resource.*`` attributes) computed once per resource / scope, not
    once per record: a request usually carries many records per resource.

    O5: service = the resource's ``service.name`` string, else the scope name,
    else ``unknown``.
    """
    src = _passthrough(requests)
    res = unnest(requests, resources, src, "resource_index").select(
        *src,
        "resource_index",
        resource_service(F.col("resource")).alias("_res_service"),
        resource_attributes(F.col("resource")).alias("_res_attrs"),
        any_not_integer(F.col("resource.attributes")).alias("_res_bad"),
        scopes,
    )
    scoped = unnest(res, scopes, [*src, "resource_index", "_res_service", "_res_attrs", "_res_bad"], "scope_index").select(
        *src, "resource_index", "scope_index",
        F.coalesce("_res_service", F.col("scope.name"), F.lit("unknown")).alias("_service"), "_res_attrs", "_res_bad", records,
    )
    return unnest(scoped, records, [*src, "resource_index", "scope_index", "_service", "_res_attrs", "_res_bad"], "record_index")


def _id(col: Column, encoding: str) -> Column:
    """Ids as lower hex; empty -> NULL. OTLP/JSON carries hex; pbjson-style base64 optional."""
    if encoding == "base64":
        col = F.hex(F.unbase64(col))
    elif encoding != "hex":
        raise ValueError("id_encoding must be 'hex' or 'base64'")
    return F.nullif(F.lower(col), F.lit(""))


def _nanos(col: Column, absent: Column | None = None) -> Column:
    """Wire time -> ns; a zero reads as ``absent``, and so does a malformed one, which :func:`_not_integer` reports."""
    ns = col.try_cast("bigint")
    return F.coalesce(ns, F.lit(0)) if absent is None else F.coalesce(F.nullif(ns, F.lit(0)), absent)


def _not_integer(col: Column, name: str) -> tuple[Column, str]:
    """A 64-bit integer that was sent but does not read as one."""
    return col.isNotNull() & col.try_cast("bigint").isNull(), f"{name} is not an integer"


def _bad_attributes(kvs: Column) -> list[tuple[Column, str]]:
    return [(any_not_integer(kvs), "attribute intValue is not an integer"),
            (F.col("_res_bad"), "resource attribute intValue is not an integer")]


def _readable(requests: DataFrame) -> DataFrame:
    """Without the requests that could not be read; those are quarantined whole (``unreadable_requests``)."""
    if schemas.CORRUPT not in requests.columns:
        return requests
    return requests.where(F.col(schemas.CORRUPT).isNull()).drop(schemas.CORRUPT)


def severity_level(sev: Column) -> Column:
    """Severity number (or its enum name) -> level."""
    num = sev.try_cast("int")
    out = None
    for lo, hi, name in SEVERITY_RANGES:
        cond = num.between(lo, hi) | (num.isNull() & sev.rlike(f"^SEVERITY_NUMBER_{name.upper()}[0-9]?$"))
        out = F.when(cond, F.lit(name)) if out is None else out.when(cond, F.lit(name))
    return out.otherwise(F.lit("info"))


def span_kind(kind: Column) -> Column:
    num = kind.try_cast("int")
    out = None
    for code, name in SPAN_KIND_CODES.items():
        cond = (num == code) | (kind == F.lit(f"SPAN_KIND_{name.upper()}"))
        out = F.when(cond, F.lit(name)) if out is None else out.when(cond, F.lit(name))
    return out.otherwise(F.lit("internal"))


def span_status(code: Column) -> Column:
    is_error = (code.try_cast("int") == STATUS_ERROR_CODE) | (code == F.lit("STATUS_CODE_ERROR"))
    return F.when(F.coalesce(is_error, F.lit(False)), F.lit("error")).otherwise(F.lit("ok"))


def unnest(df: DataFrame, array_col: str, keep: list[str], position: str | None = None) -> DataFrame:
    """One row per element of ``array_col`` (struct fields expanded), empty arrays dropped.

    Written with ``posexplode_outer`` + a position filter rather than ``inline``:
    the result is the same, but no ``size(...) > 0`` filter is inferred and pushed
    below the input's projection (which would evaluate a computed request twice).
    ``position`` keeps the element's index under that name.
    """
    out = df.select(*keep, F.posexplode_outer(array_col).alias("_pos", "_elem"))
    pos = [F.col("_pos").alias(position)] if position else []
    return out.where(F.col("_pos").isNotNull()).select(*keep, *pos, "_elem.*")


def _passthrough(df: DataFrame) -> list[str]:
    """Row provenance and time of receipt, carried along when the reader supplied them."""
    return [c for c in ("source_file", schemas.RECEIVED) if c in df.columns]


# I8: a rejected record is located by its file and its position in the request.
LOCATION = list(VALIDATE_LOCATION)


def read_otlp(spark: SparkSession, path: str, schema: str, multi_line: bool = True) -> DataFrame:
    """Read OTLP/JSON export requests with ``source_file`` provenance (I8)."""
    configure(spark)
    raw = (
        spark.read.schema(f"{schema}, {schemas.CORRUPT} string")
        .option("multiLine", str(multi_line).lower())
        .option("columnNameOfCorruptRecord", schemas.CORRUPT)
        .json(path)
    )
    return raw.select("*", F.col("_metadata.file_path").alias("source_file"))


def flatten_logs(requests: DataFrame, id_encoding: str = "hex") -> DataFrame:
    """I4: ExportLogsServiceRequest rows -> LogEntry rows (+ ``reject_reason``)."""
    recs = _records(_readable(requests), "resourceLogs", "scopeLogs", "logRecords")
    body_text = F.coalesce(
        F.col("body.stringValue"), F.to_json(any_value(F.col("body"), empty_is_null=True)), F.lit("")
    )
    ts_ns = _nanos(F.col("timeUnixNano"), received_ns(recs))
    location = [c for c in LOCATION if c in recs.columns]
    out = recs.select(
        *location,
        F.to_json(F.struct("timeUnixNano", "severityNumber", "severityText", "body", "attributes", "traceId", "spanId")).alias("raw_body"),
        first_error(
            _not_integer(F.col("timeUnixNano"), "timeUnixNano"), *_bad_attributes(F.col("attributes")),
            (F.coalesce(not_integer(F.col("body")), F.lit(False)), "body intValue is not an integer"),
        ).alias(INPUT_ERROR),
        ts_ns.alias("timestamp_ns"),
        ns_to_ts(ts_ns).alias("ts"),
        severity_level(F.col("severityNumber")).alias("level"),
        body_text.alias("message"),
        F.col("_service").alias("service"),
        F.map_concat(attributes_map(F.col("attributes")), F.col("_res_attrs")).alias("attributes"),
        _id(F.col("traceId"), id_encoding).alias("trace_id"),
        _id(F.col("spanId"), id_encoding).alias("span_id"),
    )
    return out.withColumn("level_order", level_order("level")).withColumn("dt", F.to_date("ts"))


def flatten_spans(requests: DataFrame, id_encoding: str = "hex") -> DataFrame:
    """ExportTraceServiceRequest rows -> Span rows."""
    recs = _records(_readable(requests), "resourceSpans", "scopeSpans", "spans")
    start = _nanos(F.col("startTimeUnixNano"))
    end = _nanos(F.col("endTimeUnixNano"))
    name = F.when(F.coalesce(F.length("name"), F.lit(0)) == 0, F.lit("unknown")).otherwise(F.col("name"))
    events = F.transform(
        F.coalesce(F.col("events"), F.array()),
        lambda e: F.struct(
            _nanos(e["timeUnixNano"]).alias("ts_ns"),
            e["name"].alias("name"),
            attributes_map(e["attributes"]).alias("attributes"),
        ),
    )
    location = [c for c in LOCATION if c in recs.columns]
    bad_event = F.exists(
        F.coalesce(F.col("events"), F.array()),
        lambda e: e["timeUnixNano"].isNotNull() & e["timeUnixNano"].try_cast("bigint").isNull(),
    )
    out = recs.select(
        *location,
        F.to_json(F.struct("traceId", "spanId", "parentSpanId", "name", "kind", "startTimeUnixNano", "endTimeUnixNano", "attributes",
                           "events", "status")).alias("raw_body"),
        first_error(
            _not_integer(F.col("startTimeUnixNano"), "startTimeUnixNano"), _not_integer(F.col("endTimeUnixNano"), "endTimeUnixNano"),
            (bad_event, "event timeUnixNano is not an integer"), *_bad_attributes(F.col("attributes")),
            (F.exists(F.coalesce(F.col("events"), F.array()), lambda e: any_not_integer(e["attributes"])),
             "event attribute intValue is not an integer"),
        ).alias(INPUT_ERROR),
        _id(F.col("traceId"), id_encoding).alias("trace_id"),
        _id(F.col("spanId"), id_encoding).alias("span_id"),
        _id(F.col("parentSpanId"), id_encoding).alias("parent_span_id"),
        name.alias("name"),
        name.alias("operation"),
        F.col("_service").alias("service"),
        span_kind(F.col("kind")).alias("kind"),
        span_status(F.col("status.code")).alias("status"),
        F.col("status.message").alias("status_message"),
        start.alias("start_ns"),
        end.alias("end_ns"),
        F.greatest(end - start, F.lit(0)).alias("duration_ns"),
        ns_to_ts(start).alias("ts"),
        F.map_concat(attributes_map(F.col("attributes")), F.col("_res_attrs")).alias("attributes"),
        events.alias("events"),
    )
    return out.withColumn("dt", F.to_date("ts"))


_POINT = (
    f"struct<metric_type: string, attributes: {schemas.KV}, timeUnixNano: string, value: double, "
    f"buckets: array<{schemas.BUCKET}>, hist_count: bigint, error: string>"
)


def _points(points: Column, to_point) -> Column:
    return F.transform(F.coalesce(points, F.array()), to_point)


def flatten_metrics(requests: DataFrame) -> DataFrame:
    """Gauge / sum / histogram points -> Metric rows.

    The three point kinds of a metric are mapped to one struct and exploded
    together, so each request is read once. Exponential histogram and summary
    points are not converted; they come out as records with an input error, as do
    malformed numbers, so they reach the quarantine.
    """
    requests = _readable(requests)
    src = _passthrough(requests)
    res = unnest(requests, "resourceMetrics", src, "resource_index").select(
        *src, "resource_index", resource_service(F.col("resource")).alias("_res_service"), "scopeMetrics"
    )
    scopes = unnest(res, "scopeMetrics", [*src, "resource_index", "_res_service"], "scope_index")
    keep = [*src, "resource_index", "scope_index", "_res_service"]
    metrics = unnest(scopes.select(*keep, "metrics"), "metrics", keep, "record_index").select(
        *keep, "record_index",
        F.struct("name", "unit", "description", "gauge", "sum", "histogram", "exponentialHistogram", "summary").alias("m"),
    )
    no_buckets = F.lit(None).cast(f"array<{schemas.BUCKET}>")
    no_count = F.lit(None).cast("bigint")

    def bad_label(p: Column) -> tuple[Column, str]:
        return any_not_integer(p["attributes"]), "attribute intValue is not an integer"

    def number(kind: Column):
        return lambda p: F.struct(
            kind.alias("metric_type"), p["attributes"].alias("attributes"), p["timeUnixNano"].alias("timeUnixNano"),
            F.coalesce(p["asDouble"], p["asInt"].try_cast("bigint").cast("double")).alias("value"), no_buckets.alias("buckets"),
            no_count.alias("hist_count"), first_error(_not_integer(p["asInt"], "asInt"), bad_label(p)).alias("error"),
        )

    monotonic = F.coalesce(F.col("m.sum.isMonotonic"), F.lit(False))
    histogram = lambda p: F.struct(
        F.lit("histogram").alias("metric_type"), p["attributes"].alias("attributes"),
        p["timeUnixNano"].alias("timeUnixNano"), F.coalesce(p["sum"], F.lit(0.0)).alias("value"),
        zip_buckets(F.coalesce(p["explicitBounds"], F.array().cast("array<double>")),
                    F.coalesce(p["bucketCounts"], F.array().cast("array<string>"))).alias("buckets"),
        p["count"].try_cast("bigint").alias("hist_count"),
        first_error(
            _not_integer(p["count"], "count"),
            (F.exists(F.coalesce(p["bucketCounts"], F.array().cast("array<string>")), lambda n: n.try_cast("bigint").isNull()),
             "bucketCounts is not an integer"),
            bad_label(p),
        ).alias("error"),
    )

    def unsupported(reason: str):
        return lambda p: F.struct(
            F.lit(None).cast("string").alias("metric_type"), F.lit(None).cast(schemas.KV).alias("attributes"),
            F.lit(None).cast("string").alias("timeUnixNano"), F.lit(None).cast("double").alias("value"), no_buckets.alias("buckets"),
            no_count.alias("hist_count"), F.lit(reason).alias("error"),
        )
    points = F.concat(
        _points(F.col("m.gauge.dataPoints"), number(F.lit("gauge"))),
        _points(F.col("m.sum.dataPoints"), number(F.when(monotonic, F.lit("counter")).otherwise(F.lit("gauge")))),
        _points(F.col("m.histogram.dataPoints"), histogram),
        _points(F.col("m.exponentialHistogram.dataPoints"), unsupported("exponential histogram points are not supported")),
        _points(F.col("m.summary.dataPoints"), unsupported("summary points are not supported")),
    ).cast(f"array<{_POINT}>")
    rows = (
        metrics.select(*keep, "record_index", "m", F.posexplode_outer(points).alias("_pos", "p"))
        .where(F.col("_pos").isNotNull())
    )
    # the point as it was sent, found again by its position among the metric's points; read for rejected rows only
    sent_points, before = [], F.lit(0)
    for kind in ("gauge", "sum", "histogram", "exponentialHistogram", "summary"):
        own = F.col(f"m.{kind}.dataPoints")
        at = F.col("_pos") - before
        sent_points.append(F.when(at >= 0, F.get(own, at)).alias(f"{kind}Point"))
        before = before + F.greatest(F.coalesce(F.size(own), F.lit(0)), F.lit(0))
    ts_ns = _nanos(F.col("p.timeUnixNano"), received_ns(rows))
    svc = F.col("_res_service")
    labels = F.map_concat(
        string_attributes(F.col("p.attributes")),
        F.when(svc.isNotNull(), F.map_from_arrays(F.array(F.lit("service")), F.array(svc))).otherwise(
            F.create_map().cast("map<string,string>")
        ),
    )
    out = rows.select(
        *[c for c in LOCATION if c in rows.columns],
        F.to_json(F.struct(F.col("m.name").alias("name"), F.col("m.unit").alias("unit"), *sent_points)).alias("raw_body"),
        F.coalesce(F.col("p.error"), first_error(_not_integer(F.col("p.timeUnixNano"), "timeUnixNano"))).alias(INPUT_ERROR),
        ts_ns.alias("timestamp_ns"),
        ns_to_ts(ts_ns).alias("ts"),
        F.col("m.name").alias("name"),
        F.col("p.metric_type").alias("metric_type"),
        F.col("p.value").alias("value"),
        F.col("p.buckets").alias("buckets"),
        F.col("p.hist_count").alias("hist_count"),
        labels.alias("labels"),
        F.nullif(F.col("m.description"), F.lit("")).alias("description"),
        F.nullif(F.col("m.unit"), F.lit("")).alias("unit"),
    )
    return out.withColumn("service", F.coalesce(F.col("labels")["service"], F.lit("unknown"))).withColumn(
        "dt", F.to_date("ts")
    )


def tag_requests(raw: DataFrame, flat: DataFrame, reason: Column) -> DataFrame:
    """All records of ``flat`` with their ``reject_reason``, and the requests of ``raw`` that could not be read."""
    kept = tag(flat, reason).select("raw_body", "reject_reason", *_passthrough(flat))
    return kept.unionByName(unreadable_requests(raw), allowMissingColumns=True)


def split_requests(raw: DataFrame, flat: DataFrame, reason: Column) -> tuple[DataFrame, DataFrame]:
    """The records of ``flat`` split, with the requests of ``raw`` that could not be read among the rejected."""
    valid, rejected = split_valid(flat, reason)
    return valid, rejected.unionByName(unreadable_requests(raw), allowMissingColumns=True)


def ingest_otlp_logs(spark: SparkSession, path: str, multi_line: bool = True, id_encoding: str = "hex"):
    """I4 + I7: returns ``(valid, rejected)`` — row-by-row partial success."""
    raw = read_otlp(spark, path, schemas.OTLP_LOGS, multi_line)
    return split_requests(raw, flatten_logs(raw, id_encoding), log_reject_reason())


def ingest_otlp_spans(spark: SparkSession, path: str, multi_line: bool = True, id_encoding: str = "hex"):
    """I6 + I7"""
    raw = read_otlp(spark, path, schemas.OTLP_SPANS, multi_line)
    return split_requests(raw, flatten_spans(raw, id_encoding), span_reject_reason())


def ingest_otlp_metrics(spark: SparkSession, path: str, multi_line: bool = True):
    """I5 + I7"""
    raw = read_otlp(spark, path, schemas.OTLP_METRICS, multi_line)
    return split_requests(raw, flatten_metrics(raw), metric_reject_reason())
