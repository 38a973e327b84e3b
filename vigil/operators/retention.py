"""Retention (M4–M6, M8): TTL policies, the expiry filter, the partition
rewrite job, and re-normalisation of stored logs.

The job works on day-partitioned Parquet (``dt=YYYY-MM-DD``): whole expired
days are dropped by overwriting only the boundary day with its surviving
rows (dynamic partition overwrite) and deleting older day folders through
the Hadoop FileSystem API — no full-table rewrite.
"""

from __future__ import annotations

from dataclasses import dataclass, field
from datetime import datetime, timedelta

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from vigil.functions.normalize import normalize_message
from vigil.operators import trace_index
from vigil.operators.rollups import ROLLUP_RETENTION_DAYS

MIN_TTL_DAYS, MAX_TTL_DAYS = 1, 3650

# ---------------------------------------------------------------------------
# FIXED VALUES — default TTLs of the reference, in days.
# ---------------------------------------------------------------------------
DEFAULT_TTL_DAYS = {"logs": 30, "metrics": 90, "traces": 30}


def _validate_days(days: int, what: str) -> int:
    if not isinstance(days, int) or isinstance(days, bool):
        raise ValueError(f"{what}: whole days expected, got {days!r}")
    if not MIN_TTL_DAYS <= days <= MAX_TTL_DAYS:
        raise ValueError(f"{what}: {days} days lies outside {MIN_TTL_DAYS} to {MAX_TTL_DAYS}")
    return days


@dataclass
class RetentionPolicy:
    """M5: TTL per data type (logs / metrics / traces), validated 1..3650."""

    ttl_days: dict[str, int] = field(default_factory=lambda: dict(DEFAULT_TTL_DAYS))

    def __post_init__(self) -> None:
        unknown = set(self.ttl_days) - set(DEFAULT_TTL_DAYS)
        if unknown:
            raise ValueError(f"unknown data types {sorted(unknown)}")
        for name, days in self.ttl_days.items():
            _validate_days(days, f"TTL of {name}")

    def update(self, data_type: str, days: int) -> RetentionPolicy:
        if data_type not in DEFAULT_TTL_DAYS:
            raise ValueError(f"unknown data type {data_type!r}")
        self.ttl_days[data_type] = _validate_days(days, f"TTL of {data_type}")
        return self


@dataclass
class AggregationPolicy:
    """M6: which rollup tiers are built/retained, with their retention days."""

    tiers: dict[str, int] = field(default_factory=lambda: dict(ROLLUP_RETENTION_DAYS))
    enabled: dict[str, bool] = field(default_factory=dict)

    def __post_init__(self) -> None:
        for name, days in self.tiers.items():
            if name not in ROLLUP_RETENTION_DAYS:
                raise ValueError(f"unknown rollup {name!r}")
            _validate_days(days, f"retention of {name}")

    def is_enabled(self, tier: str) -> bool:
        return self.enabled.get(tier, True)


def cutoff(as_of: Column, ttl_days: int) -> Column:
    return as_of - F.make_interval(days=F.lit(_validate_days(ttl_days, "TTL")))


def apply_retention(df: DataFrame, ttl_days: int, as_of: Column, ts_col: str = "ts", date_col: str | None = "dt") -> DataFrame:
    """M4: rows younger than ``ttl_days`` at ``as_of``.

    The extra ``dt`` bound lets Catalyst prune whole expired day partitions.
    """
    limit = cutoff(as_of, ttl_days)
    cond = F.col(ts_col) >= limit
    if date_col and date_col in df.columns:
        cond = cond & (F.col(date_col) >= F.to_date(limit))
    return df.where(cond)


STAGING = "_retention_staging"  # partition discovery ignores names with an underscore


def _partition_columns(fs, hpath, path: str) -> list[str]:
    """The table's own partition columns, read from its folders (``dt``, ``dt/batch``, ``dt/run/epoch``, ...)."""
    columns, at = [], hpath(path)
    while True:
        below = [s for s in fs.listStatus(at) if s.isDirectory() and "=" in s.getPath().getName()]
        if not below:
            return columns
        columns.append(below[0].getPath().getName().split("=")[0])
        at = below[0].getPath()


def _as_named(spark: SparkSession, path: str, parts: list[str]) -> DataFrame:
    """The rows of a partitioned table with its partition columns as the text that names their folders.

    Inferred types would turn ``batch=007`` into the number 7 and write it back under another name.
    """
    schema = spark.read.parquet(path).schema
    fields = [f for f in schema.fields if f.name not in parts] + [T.StructField(p, T.StringType()) for p in parts]
    return spark.read.schema(T.StructType(fields)).parquet(path)


def _replace_day(spark: SparkSession, fs, hpath, path: str, date_col: str, day: str, staged: str, parts: list[str]) -> int:
    """Put the staged survivors in the place of ``day``, then drop the staging copy. Repeatable until that last step."""
    survivors = fs.exists(hpath(f"{staged}/{date_col}={day}"))
    fs.delete(hpath(f"{path}/{date_col}={day}"), True)
    if survivors:
        _as_named(spark, staged, parts).write.mode("append").partitionBy(*parts).parquet(path)
    fs.delete(hpath(staged), True)
    return int(survivors)


def expire_partitions(
    spark: SparkSession, path: str, ttl_days: int, as_of_ts: str, ts_col: str = "ts", date_col: str = "dt"
) -> dict[str, int]:
    """M4 job: enforce a TTL on a ``dt``-partitioned Parquet table in place.

    Days entirely before the cutoff are deleted as folders; the boundary day is
    rewritten with its surviving rows, in the table's own partition layout.
    Restart-safe: the survivors are first written to a staging folder named by day
    and cutoff and only then replace the day; a rerun first completes what an earlier
    run had staged, whatever its cutoff, since the day itself may be half replaced.
    ``as_of_ts`` is a UTC timestamp text (e.g. ``2024-01-31 00:00:00``).
    """
    path = path.rstrip("/")
    cutoff_dt = datetime.fromisoformat(as_of_ts.replace("Z", "")) - timedelta(days=_validate_days(ttl_days, "TTL"))
    boundary_day = cutoff_dt.date().isoformat()
    jvm = spark.sparkContext._jvm
    hpath = jvm.org.apache.hadoop.fs.Path
    fs = hpath(path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    left = fs.listStatus(hpath(f"{path}/{STAGING}")) if fs.exists(hpath(f"{path}/{STAGING}")) else []
    parts = _partition_columns(fs, hpath, path) or [date_col]
    for status in left:
        staged = status.getPath().toString()
        if fs.exists(hpath(f"{staged}/_SUCCESS")):
            _replace_day(spark, fs, hpath, path, date_col, status.getPath().getName()[:10], staged, parts)
    fs.delete(hpath(f"{path}/{STAGING}"), True)

    dropped = rewritten = 0
    days = {s.getPath().getName()[len(date_col) + 1 :] for s in fs.listStatus(hpath(path))
            if s.getPath().getName().startswith(f"{date_col}=")}
    if boundary_day in days:
        staged = f"{path}/{STAGING}/{boundary_day}-{cutoff_dt:%H%M%S%f}"
        boundary = _as_named(spark, path, parts).where(F.col(date_col) == F.lit(boundary_day))
        keep = boundary.where(F.col(ts_col) >= F.lit(cutoff_dt.isoformat(sep=" ")).cast("timestamp"))
        keep.write.partitionBy(*parts).parquet(staged)
        rewritten = _replace_day(spark, fs, hpath, path, date_col, boundary_day, staged, parts)
        fs.delete(hpath(f"{path}/{STAGING}"), True)
    for day in sorted(days):
        if day < boundary_day:
            fs.delete(hpath(f"{path}/{date_col}={day}"), True)
            dropped += 1
    return {"dropped_days": dropped, "rewritten_days": rewritten}


# which policy entry governs a raw table
RAW_TABLES = {"logs": "logs", "metrics": "metrics", "spans": "traces"}


def enforce_retention(
    spark: SparkSession, raw_tables: dict[str, str], tier_root: str, as_of_ts: str,
    retention: RetentionPolicy | None = None, aggregation: AggregationPolicy | None = None,
) -> dict[str, dict[str, int]]:
    """M4 + M6: one job over the raw tables and the stored rollup tiers, each with its own days.

    ``raw_tables`` maps ``logs`` / ``metrics`` / ``spans`` to their paths; tiers are the
    folders of ``tier_root`` as :func:`vigil.operators.rollups.write_rollups` names them,
    those that exist. Returns what each table dropped and rewrote.
    """
    retention, aggregation = retention or RetentionPolicy(), aggregation or AggregationPolicy()
    jvm = spark.sparkContext._jvm
    hpath = jvm.org.apache.hadoop.fs.Path
    fs = hpath(tier_root).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    done = {
        kind: expire_partitions(spark, path, retention.ttl_days[RAW_TABLES[kind]], as_of_ts) for kind, path in raw_tables.items()
    }
    for tier, days in aggregation.tiers.items():
        path = f"{tier_root.rstrip('/')}/{tier}"
        if fs.exists(hpath(path)):
            done[tier] = expire_partitions(spark, path, days, as_of_ts, ts_col="timestamp")
    index = f"{tier_root.rstrip('/')}/{trace_index.DAYS}"
    if fs.exists(hpath(index)):  # the index goes with the spans that it tells of
        done[trace_index.DAYS] = expire_partitions(spark, index, retention.ttl_days["traces"], as_of_ts, ts_col="last_ts")
    # the partial rows of streamed tiers stay as long as any tier that is merged from them
    partials = hpath(f"{tier_root.rstrip('/')}/_partials")
    for status in fs.listStatus(partials) if fs.exists(partials) else []:
        name = status.getPath().getName()
        days = max([d for t, d in aggregation.tiers.items() if t.split("_")[0] == name.split("_")[0]], default=MAX_TTL_DAYS)
        done[f"_partials/{name}"] = expire_partitions(spark, status.getPath().toString(), days, as_of_ts, ts_col="timestamp")
    return done


def renormalize_logs(logs: DataFrame) -> DataFrame:
    """M8: recompute ``normalized_message`` after a rule change (A5/A6 are then
    rebuilt from the result by :func:`vigil.operators.rollups.log_count_rollup`)."""
    return logs.withColumn("normalized_message", normalize_message("message"))


def rebuild_log_rollups(spark: SparkSession, logs_path: str, out_root: str, tiers=("1hour", "1day")) -> None:
    """M8: after a rule change, re-normalise the stored logs and rebuild the log
    rollups (overwrites each tier's ``dt`` partitions present in the logs)."""
    from vigil.operators.rollups import log_count_rollup, overwrite_days

    logs = renormalize_logs(spark.read.parquet(logs_path))
    for tier in tiers:
        table = log_count_rollup(logs, tier).withColumn("dt", F.to_date("timestamp"))
        overwrite_days(table, f"{out_root.rstrip('/')}/logs_{tier}_counts")
