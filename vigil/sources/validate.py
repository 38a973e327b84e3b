"""Row validation and quarantine (I7, I8), row decoding (I14) and histogram
encoding (I15).

Every input record ends up in one of the two frames: each gets a ``reject_reason``
(an input error found while reading it, else the first failing rule, NULL when
valid) and is split into ``(valid, rejected)``; the rejected ones keep the record as
it was sent and where it came from.
Callers that want the reference's all-or-nothing log batches pass
``on_error="fail"``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vigil.schemas import CORRUPT, RECEIVED


def _nonempty(c: str) -> Column:
    return F.col(c).isNotNull() & (F.length(F.col(c)) > 0)


def _first_failure(rules: list[tuple[Column, str]]) -> Column:
    out = F.lit(None).cast("string")
    for ok, reason in reversed(rules):
        out = F.when(~F.coalesce(ok, F.lit(False)), F.lit(reason)).otherwise(out)
    return out


def buckets_ascending(buckets: Column | str) -> Column:
    """Strictly ascending ``upper_bound`` (TRUE for 0 or 1 bucket).

    ``sequence(1, 0)`` would count down, so sizes below 2 short-circuit first.
    """
    b = F.col(buckets) if isinstance(buckets, str) else buckets
    pairs = F.forall(
        F.sequence(F.lit(1), F.size(b) - 1),
        lambda i: F.get(b, i)["upper_bound"] > F.get(b, i - 1)["upper_bound"],
    )
    return F.when(b.isNull() | (F.size(b) < 2), F.lit(True)).otherwise(pairs)


# Row provenance columns the readers add (I8); see sources/otlp.py.
LOCATION = ("source_file", "resource_index", "scope_index", "record_index", "raw_body")
# Why a record could not be read as sent (NULL: it could), set by the normalising functions.
INPUT_ERROR = "input_error"
UNREADABLE = "record is not readable"


def first_error(*checks: tuple[Column, str]) -> Column:
    """The reason of the first check that is TRUE, else NULL."""
    return F.coalesce(*[F.when(bad, F.lit(reason)) for bad, reason in checks])


def unreadable(raw: DataFrame) -> Column:
    """TRUE for a record that the reader could not fit into its schema."""
    return F.col(CORRUPT).isNotNull() if CORRUPT in raw.columns else F.lit(False)


def received_ns(raw: DataFrame) -> Column:
    """The time that stands for an absent one, in ns: when the batch was received, if the reader knows, else now."""
    when = F.col(RECEIVED) if RECEIVED in raw.columns else F.current_timestamp()
    return F.unix_micros(when) * F.lit(1000)


def sent(raw: DataFrame) -> Column:
    """The record as it was sent: the reader's text if it is unreadable, else its fields as JSON."""
    fields = F.to_json(F.struct(*[c for c in raw.columns if c not in (CORRUPT, RECEIVED, "source_file")]))
    return F.coalesce(F.col(CORRUPT), fields) if CORRUPT in raw.columns else fields


def unreadable_requests(raw: DataFrame) -> DataFrame:
    """The requests that could not be read, as quarantine rows."""
    where = ["source_file"] if "source_file" in raw.columns else []
    if CORRUPT not in raw.columns:
        raw = raw.withColumn(CORRUPT, F.lit(None).cast("string"))
    # the reader refuses a query on the corrupt text alone, so the (always true) size test names a field as well
    fields = next(c for c in raw.columns if c not in (CORRUPT, RECEIVED, "source_file"))
    return raw.where(F.col(CORRUPT).isNotNull() & (F.coalesce(F.size(fields), F.lit(-1)) >= -1)).select(
        *where, F.col(CORRUPT).alias("raw_body"), F.lit("request is not readable").alias("reject_reason")
    )

LOG_RULES = [("message", "message must not be empty"), ("service", "service must not be empty")]
SPAN_RULES = [
    ("trace_id", "trace_id must not be empty"),
    ("span_id", "span_id must not be empty"),
    ("name", "name must not be empty"),
    ("service", "service must not be empty"),
]


def log_reject_reason() -> Column:
    return _first_failure([(_nonempty(c), msg) for c, msg in LOG_RULES])


def metric_reject_reason() -> Column:
    return _first_failure(
        [(_nonempty("name"), "name must not be empty"), (F.col("value").isNotNull(), "value must be present"),
         (buckets_ascending("buckets"), "histogram buckets must be sorted")]
    )


def span_reject_reason() -> Column:
    rules = [(_nonempty(c), msg) for c, msg in SPAN_RULES]
    rules.append((F.col("end_ns") >= F.col("start_ns"), "end time must not be before start time"))
    return _first_failure(rules)


def tag(df: DataFrame, reason: Column) -> DataFrame:
    """Rows with ``reject_reason``: an input error found while reading, else the first failing rule, NULL when valid."""
    if INPUT_ERROR in df.columns:
        reason = F.coalesce(F.col(INPUT_ERROR), reason)
    return df.withColumn("reject_reason", reason).drop(INPUT_ERROR)


def split_valid(df: DataFrame, reason: Column, on_error: str = "split") -> tuple[DataFrame, DataFrame]:
    """Tag rows with ``reject_reason`` and split them.

    ``on_error="fail"`` raises if any row is invalid (one small aggregate
    action); otherwise both frames are returned lazily.
    """
    tagged = tag(df, reason)
    # provenance (file, positions) is kept for the quarantine only
    location = [c for c in LOCATION if c in df.columns]
    valid = tagged.where(F.col("reject_reason").isNull()).drop("reject_reason", *location)
    rejected = tagged.where(F.col("reject_reason").isNotNull())
    if on_error == "fail":
        first = rejected.select("reject_reason").limit(1).collect()
        if first:
            raise ValueError(f"invalid rows in batch: {first[0]['reject_reason']}")
    elif on_error != "split":
        raise ValueError("on_error must be 'split' or 'fail'")
    return valid, rejected


def outcome_report(tagged: DataFrame) -> DataFrame:
    """I8: tagged rows counted by outcome, accepted ones too: the counts add up to what was sent, in one pass."""
    outcome = F.coalesce("reject_reason", F.lit("accepted"))
    return tagged.groupBy(outcome.alias("reject_reason")).agg(F.count(F.lit(1)).alias("rejected"))


def reject_report(rejected: DataFrame) -> DataFrame:
    """I8: rejected row counts per reason."""
    return rejected.groupBy("reject_reason").agg(F.count(F.lit(1)).alias("rejected"))


def reject_details(rejected: DataFrame) -> DataFrame:
    """I8: one row per rejected record — where it came from (file and, for OTLP,
    its resource / scope / record position in the request), as it was sent, and why."""
    where = [c for c in LOCATION if c in rejected.columns]
    return rejected.select(*where, "reject_reason")


def zip_buckets(bounds: Column | str, counts: Column | str) -> Column:
    """Parallel arrays -> ``array<struct<upper_bound, count>>``, truncated to the
    shorter array (like a zip; ``arrays_zip`` alone pads with NULL)."""
    b = F.col(bounds) if isinstance(bounds, str) else bounds
    c = F.col(counts) if isinstance(counts, str) else counts
    n = F.least(F.size(b), F.size(c))
    zipped = F.arrays_zip(b.alias("upper_bound"), F.transform(c, lambda x: x.try_cast("bigint")).alias("count"))
    return F.when(n > 0, F.slice(zipped, 1, n)).otherwise(F.array().cast("array<struct<upper_bound:double,count:bigint>>"))


def unzip_buckets(buckets: Column | str) -> tuple[Column, Column]:
    """I15 (write side): ``buckets`` -> (bounds, counts) parallel arrays."""
    b = F.col(buckets) if isinstance(buckets, str) else buckets
    return F.transform(b, lambda x: x["upper_bound"]), F.transform(b, lambda x: x["count"])


def bucket_total(buckets: Column | str) -> Column:
    """I15 (read side): histogram count = sum of bucket counts."""
    b = F.col(buckets) if isinstance(buckets, str) else buckets
    return F.aggregate(b, F.lit(0).cast("bigint"), lambda acc, x: acc + x["count"])
