"""Native JSON ingest (I1–I3): one object, an array of objects, or JSON lines.

Defaults follow the reference's request types: level ``info``, timestamp
now, attributes ``{}``, metric type ``gauge``, span kind ``internal`` and
status ``ok``; a span's end is start + ``duration_ms``. A default stands for an
absent field only: a time that does not parse, an unknown enumeration name, a
metric without a value or a body that is no JSON is rejected. Rows are validated
(D32: metrics and spans too) and split into ``(valid, rejected)``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from vigil import schemas
from vigil.functions.model import (
    DEFAULT_KIND,
    DEFAULT_LEVEL,
    DEFAULT_METRIC_TYPE,
    DEFAULT_STATUS,
    LEVELS,
    METRIC_TYPES,
    SPAN_KINDS,
    SPAN_STATUSES,
    decode_enum,
    empty_to_null,
    level_order,
)
from vigil.functions.timefn import RFC3339, ns_to_ts
from vigil.session import configure
from vigil.sources.validate import (
    INPUT_ERROR,
    UNREADABLE,
    first_error,
    log_reject_reason,
    metric_reject_reason,
    received_ns,
    sent,
    span_reject_reason,
    split_valid,
    unreadable,
)


def rfc3339_to_ns(text: Column) -> Column:
    """RFC 3339 text -> epoch ns, keeping the sub-microsecond digits; NULL for any other text.

    A cast alone would read a time of day as today's and fill in missing parts.
    """
    micros = F.unix_micros(F.when(text.rlike(RFC3339), F.upper(text)).try_cast("timestamp"))
    extra = F.regexp_extract(text, r"\.\d{6}(\d{1,3})", 1)
    extra_ns = F.when(extra == "", F.lit(0)).otherwise(F.rpad(extra, 3, "0").cast("bigint"))
    return micros * F.lit(1000) + extra_ns


def read_json(spark: SparkSession, path: str, schema: str, multi_line: bool = True) -> DataFrame:
    """Read request bodies with ``source_file`` provenance for the quarantine (I8)."""
    configure(spark)
    raw = (
        spark.read.schema(f"{schema}, {schemas.CORRUPT} string")
        .option("multiLine", str(multi_line).lower())
        .option("columnNameOfCorruptRecord", schemas.CORRUPT)
        .json(path)
    )
    return raw.select("*", F.col("_metadata.file_path").alias("source_file"))


def _source(raw: DataFrame, *checks: tuple[Column, str]) -> list[Column]:
    """Provenance of a record, the record as sent, and why it cannot be read as sent."""
    file = [F.col("source_file")] if "source_file" in raw.columns else []
    return [*file, sent(raw).alias("raw_body"), first_error((unreadable(raw), UNREADABLE), *checks).alias(INPUT_ERROR)]


def _bad_time(column: str) -> tuple[Column, str]:
    return F.col(column).isNotNull() & rfc3339_to_ns(F.col(column)).isNull(), f"{column} is not an RFC 3339 time"


def _unknown(column: str, allowed: tuple[str, ...]) -> tuple[Column, str]:
    return F.col(column).isNotNull() & ~F.lower(F.col(column)).isin(*allowed), f"unknown {column}"


def normalize_logs(raw: DataFrame) -> DataFrame:
    """Native log requests -> LogEntry rows."""
    ts_ns = F.coalesce(rfc3339_to_ns(F.col("timestamp")), received_ns(raw))
    out = raw.select(
        *_source(raw, _bad_time("timestamp"), _unknown("level", LEVELS)),
        ts_ns.alias("timestamp_ns"),
        ns_to_ts(ts_ns).alias("ts"),
        decode_enum(F.coalesce("level", F.lit(DEFAULT_LEVEL)), LEVELS, DEFAULT_LEVEL).alias("level"),
        "message",
        "service",
        F.coalesce("attributes", F.create_map().cast("map<string,variant>")).alias("attributes"),
        empty_to_null("trace_id").alias("trace_id"),
        empty_to_null("span_id").alias("span_id"),
    )
    return out.withColumn("level_order", level_order("level")).withColumn("dt", F.to_date("ts"))


def normalize_metrics(raw: DataFrame) -> DataFrame:
    """Native metric requests -> Metric rows (simple values; optional buckets)."""
    ts_ns = F.coalesce(rfc3339_to_ns(F.col("timestamp")), received_ns(raw))
    labels = F.coalesce("labels", F.create_map().cast("map<string,string>"))
    return raw.select(
        *_source(raw, _bad_time("timestamp"), _unknown("metric_type", METRIC_TYPES)),
        ts_ns.alias("timestamp_ns"),
        ns_to_ts(ts_ns).alias("ts"),
        "name",
        decode_enum(F.coalesce("metric_type", F.lit(DEFAULT_METRIC_TYPE)), METRIC_TYPES, DEFAULT_METRIC_TYPE).alias(
            "metric_type"
        ),
        "value",
        "buckets",
        F.lit(None).cast("bigint").alias("hist_count"),
        labels.alias("labels"),
        F.coalesce(labels["service"], F.lit("unknown")).alias("service"),
        "description",
        "unit",
    ).withColumn("dt", F.to_date("ts"))


def normalize_spans(raw: DataFrame) -> DataFrame:
    """Native span requests -> Span rows."""
    start = F.coalesce(rfc3339_to_ns(F.col("start_time")), received_ns(raw))
    end = start + F.coalesce(F.col("duration_ms"), F.lit(0)) * F.lit(1_000_000)
    return raw.select(
        *_source(raw, _bad_time("start_time"), _unknown("kind", SPAN_KINDS), _unknown("status", SPAN_STATUSES)),
        "trace_id",
        "span_id",
        empty_to_null("parent_span_id").alias("parent_span_id"),
        "name",
        F.col("name").alias("operation"),
        "service",
        decode_enum(F.coalesce("kind", F.lit(DEFAULT_KIND)), SPAN_KINDS, DEFAULT_KIND).alias("kind"),
        decode_enum(F.coalesce("status", F.lit(DEFAULT_STATUS)), SPAN_STATUSES, DEFAULT_STATUS).alias("status"),
        F.lit(None).cast("string").alias("status_message"),
        start.alias("start_ns"),
        end.alias("end_ns"),
        F.greatest(end - start, F.lit(0)).alias("duration_ns"),
        ns_to_ts(start).alias("ts"),
        F.coalesce("attributes", F.create_map().cast("map<string,variant>")).alias("attributes"),
        F.array().cast(f"array<{schemas.SPAN_EVENT}>").alias("events"),
    ).withColumn("dt", F.to_date("ts"))


def ingest_logs(spark: SparkSession, path: str, multi_line: bool = True, on_error: str = "split"):
    """I1 + I7. ``on_error="fail"`` reproduces the all-or-nothing batch."""
    return split_valid(normalize_logs(read_json(spark, path, schemas.NATIVE_LOG, multi_line)), log_reject_reason(), on_error)


def ingest_metrics(spark: SparkSession, path: str, multi_line: bool = True, on_error: str = "split"):
    """I2 + I7"""
    return split_valid(
        normalize_metrics(read_json(spark, path, schemas.NATIVE_METRIC, multi_line)), metric_reject_reason(), on_error
    )


def ingest_spans(spark: SparkSession, path: str, multi_line: bool = True, on_error: str = "split"):
    """I3 + I7"""
    return split_valid(
        normalize_spans(read_json(spark, path, schemas.NATIVE_SPAN, multi_line)), span_reject_reason(), on_error
    )
