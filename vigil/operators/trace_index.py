"""A maintained index of traces: searches read it, and only the days of what they found.

The index has one row for each trace and day: span count, first and last start, last end,
services and statuses. Rows of a day follow from that day's spans alone, so the index is
kept like a tier: merged from the batches' states, replaced day by day, expired by day.
Traces that last over midnight have a second, whole row among the *long* traces, a small
table that is refreshed for the traces of the days that change.

A trace that starts and ends within a day is judged on its day's row, a long one on its whole
row, so every trace-level predicate (T1–T4) has the meaning it has over all spans, also for a
trace that lies around a time range without a span in it. Index rows are read from the days
of the range only, spans from the days of the traces found.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from vigil.functions.timefn import ns_to_ms, ns_to_ts

DAYS, LONG = "trace_index", "trace_index_long"
FOUND = ["trace_id", "span_count", "services", "start_ns", "end_ns", "duration_ms"]


def index_rows(spans: DataFrame, tier: str = "1day") -> DataFrame:
    """The index rows of some spans, by trace and day (``timestamp`` is the day's start)."""
    return spans.groupBy("trace_id", F.date_trunc("day", "ts").alias("timestamp")).agg(
        F.count(F.lit(1)).alias("span_count"), F.min("start_ns").alias("first_start_ns"), F.max("start_ns").alias("last_start_ns"),
        F.max("end_ns").alias("last_end_ns"), F.array_sort(F.collect_set("service")).alias("services"),
        F.array_sort(F.collect_set("status")).alias("statuses"),
    ).withColumn("last_ts", ns_to_ts("last_start_ns"))


def _union(column: str) -> Column:
    return F.array_sort(F.array_distinct(F.flatten(F.collect_list(column)))).alias(column)


def _merged(rows: DataFrame, *keys: str) -> DataFrame:
    return rows.groupBy(*keys).agg(
        F.sum("span_count").alias("span_count"), F.min("first_start_ns").alias("first_start_ns"),
        F.max("last_start_ns").alias("last_start_ns"), F.max("last_end_ns").alias("last_end_ns"), _union("services"), _union("statuses"),
        *([] if "timestamp" in keys else [F.array_sort(F.collect_set(F.to_date("timestamp"))).alias("days")]),
    ).withColumn("last_ts", ns_to_ts("last_start_ns"))


def merge_index(rows: DataFrame, tier: str = "1day") -> DataFrame:
    """Index rows of several batches as one for each trace and day."""
    return _merged(rows, "trace_id", "timestamp")


def long_rows(index: DataFrame) -> DataFrame:
    """One whole row for each trace with spans on more than one day, with its ``days``."""
    return _merged(index, "trace_id").where(F.size("days") > 1)


def _days(start_ns: int | None, end_ns: int | None) -> Column:
    """The days of a time range, as a condition that prunes ``dt`` partitions."""
    bounds = []
    if start_ns is not None:
        bounds.append(F.col("dt") >= F.to_date(ns_to_ts(F.lit(start_ns))))
    if end_ns is not None:
        bounds.append(F.col("dt") <= F.to_date(ns_to_ts(F.lit(end_ns - 1))))
    return reduce(Column.__and__, bounds, F.lit(True))


def search(
    index: DataFrame, long: DataFrame, service: str | None = None, start_ns: int | None = None, end_ns: int | None = None,
    min_duration_ms: int | None = None, max_duration_ms: int | None = None, status: str | None = None,
) -> DataFrame:
    """T1–T4 and L7's input from the index: the rows of :func:`vigil.operators.traces.find_traces`, and each trace's ``days``.

    ``index`` has a ``dt`` column (its partitions, where it is stored); no span is read.
    """
    ms = ns_to_ms(F.col("last_end_ns") - F.col("first_start_ns"))
    tests = []
    if service is not None:
        tests.append(F.array_contains("services", F.lit(service)))
    if status is not None:
        tests.append(F.array_contains("statuses", F.lit(status)))
    if start_ns is not None:
        tests.append(F.col("last_start_ns") >= F.lit(start_ns))
    if end_ns is not None:
        tests.append(F.col("first_start_ns") < F.lit(end_ns))
    if min_duration_ms is not None:
        tests.append(ms >= F.lit(min_duration_ms))
    if max_duration_ms is not None:
        tests.append(ms <= F.lit(max_duration_ms))
    holds = reduce(Column.__and__, tests, F.lit(True))
    columns = ["trace_id", "span_count", "services", F.col("first_start_ns").alias("start_ns"), F.col("last_end_ns").alias("end_ns"),
               ms.alias("duration_ms")]
    short = index.where(_days(start_ns, end_ns)).where(holds).join(long.select("trace_id"), "trace_id", "left_anti")
    short = short.select(*columns, F.array(F.to_date("timestamp")).alias("days"))
    return short.unionByName(long.where(holds).select(*columns, "days"))


def fetch_spans(spans: DataFrame, found: DataFrame, most: int = 10_000) -> DataFrame:
    """All spans of the found traces, read from the traces' days only.

    What reaches the driver is the days, at most as many as the table has. The ids are
    broadcast only if they are counted to be no more than ``most``.
    """
    days = [r["day"] for r in found.select(F.explode("days").alias("day")).distinct().collect()]
    ids = found.select("trace_id").distinct()
    if ids.limit(most + 1).count() <= most:
        ids = F.broadcast(ids)
    return spans.where(F.col("dt").isin(days)).join(ids, "trace_id", "left_semi")


def _versions(spark: SparkSession, root: str) -> list[int]:
    from vigil.streaming.folding import Files

    files, path = Files(spark, root), f"{root.rstrip('/')}/{LONG}"
    return sorted(int(n.removeprefix("version=")) for n in files.names(path)
                  if n.startswith("version=") and files.exists(f"{path}/{n}/_SUCCESS"))


def read_index(spark: SparkSession, root: str) -> tuple[DataFrame, DataFrame]:
    """The stored index and its long traces."""
    root = root.rstrip("/")
    index = spark.read.parquet(f"{root}/{DAYS}")
    found = _versions(spark, root)
    if found:
        return index, spark.read.parquet(f"{root}/{LONG}/version={found[-1]}")
    return index, spark.createDataFrame([], long_rows(index.drop("dt")).schema)


def refresh_long(spark: SparkSession, root: str, days: list) -> None:
    """Bring the long traces up to date after the index rows of ``days`` have changed.

    Ids of the changed days are looked up among all days by their id column alone; whole
    rows are read for those found on several days only. The table gets a new version, so a
    reader, or this job when it is repeated, never meets a half-written one.
    """
    from vigil.streaming.folding import Files

    root, files = root.rstrip("/"), Files(spark, root)
    index, old = read_index(spark, root)
    # traces that the days hold now, and those that had spans there before
    changed = index.where(F.col("dt").isin(days)).select("trace_id")
    touched = F.arrays_overlap("days", F.array(*[F.lit(d) for d in days]).cast("array<date>"))
    changed = changed.unionByName(old.where(touched).select("trace_id")).distinct()
    several = index.select("trace_id", "dt").join(changed, "trace_id", "left_semi")
    several = several.groupBy("trace_id").agg(F.count_distinct("dt").alias("n")).where("n > 1").select("trace_id")
    fresh = long_rows(index.drop("dt").join(several, "trace_id", "left_semi"))
    stays = old.join(changed, "trace_id", "left_anti")
    found = _versions(spark, root)
    version = found[-1] + 1 if found else 0
    rows = stays.unionByName(fresh).hint("rebalance").sortWithinPartitions("first_start_ns")
    rows.write.mode("overwrite").parquet(f"{root}/{LONG}/version={version}")
    for gone in found[:-1]:  # the version before stays for readers that have just begun
        files.delete(f"{root}/{LONG}/version={gone}")


def write_index(spans: DataFrame, root: str, days: list | None = None) -> None:
    """Build the index of whole days from their spans, and refresh the long traces."""
    from vigil.operators.rollups import overwrite_days

    if days is not None:
        spans = spans.where(F.col("dt").isin(days))
    overwrite_days(index_rows(spans).withColumn("dt", F.to_date("timestamp")), f"{root.rstrip('/')}/{DAYS}")
    if days is None:
        days = [r["dt"] for r in spans.select("dt").distinct().collect()]
    refresh_long(spans.sparkSession, root, days)
