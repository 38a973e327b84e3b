"""Parquet sinks for the stored tables.

Tables are partitioned by day (``dt``) and sorted within files by the
reference's sort keys, so min/max statistics prune row groups for the common
filters. Rows are dealt by day before they are sorted and written, in tasks sized by
the measured bytes of the shuffle (``REBALANCE``): a small day is one file, a large one as
many tasks and files as its bytes ask for, whatever share of the rows it holds.
:func:`compact_days` merges the small files that many batches leave.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vigil import schemas

# ---------------------------------------------------------------------------
# FIXED VALUES — sort keys of the reference's tables.
# ---------------------------------------------------------------------------
SORT_KEYS = {
    "logs": ("service", "level", "timestamp_ns"),
    "metrics": ("service", "name", "timestamp_ns"),
    "spans": ("service", "trace_id", "start_ns", "span_id"),
}
SCHEMAS = {"logs": schemas.LOG, "metrics": schemas.METRIC, "spans": schemas.SPAN}


def _with_dt(df: DataFrame) -> DataFrame:
    return df if "dt" in df.columns else df.withColumn("dt", F.to_date("ts"))


def write_table(
    df: DataFrame,
    path: str,
    kind: str,
    mode: str = "append",
    bloom_trace_id: bool = True,
    batch_id: str | None = None,
) -> None:
    """Append (or overwrite) rows to a day-partitioned Parquet table.

    Tasks of the write hold about ``spark.sql.adaptive.advisoryPartitionSizeInBytes``.

    With ``batch_id`` the rows land in ``dt=…/batch=<id>`` and replace only those
    partitions (dynamic overwrite), so re-running a batch after a failure —
    or after it already succeeded — never duplicates rows.
    """
    if kind not in SORT_KEYS:
        raise ValueError(f"unknown table kind {kind!r}")
    parts = ["dt"]
    out = _with_dt(df)
    if batch_id is not None:
        out, parts, mode = out.withColumn("batch", F.lit(str(batch_id))), ["dt", "batch"], "overwrite"
    out = _by_day(out).sortWithinPartitions(*parts, *SORT_KEYS[kind])
    writer = out.write.mode(mode).partitionBy(*parts)
    # stated for this write, so neither the session's mode nor another write's matters
    writer = writer.option("partitionOverwriteMode", "dynamic" if batch_id is not None else "static")
    if bloom_trace_id and "trace_id" in df.columns:
        writer = writer.option("parquet.bloom.filter.enabled#trace_id", "true")
    writer.parquet(path)


def _by_day(df: DataFrame) -> DataFrame:
    """Rows of a day together, in tasks of the advisory size: AQE splits large days and merges small ones by measured bytes."""
    return df.hint("rebalance", "dt")


COMPACTION = "_compaction_staging"  # partition discovery ignores names with an underscore


def compact_days(spark: SparkSession, path: str, kind: str, days: list[str]) -> None:
    """Rewrite the given days (``YYYY-MM-DD``) of a ``dt``-partitioned table as sorted files of the advisory size.

    The rows are staged next to the table first, so each day is replaced from a complete copy,
    which goes when all days are in place. A later call completes what a broken one had staged.
    Tables with partitions below the day keep them: batches and epochs must stay
    replaceable (streams fold theirs, :mod:`vigil.streaming.folding`).
    """
    jvm = spark.sparkContext._jvm
    hpath = jvm.org.apache.hadoop.fs.Path
    fs = hpath(path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    staged = f"{path.rstrip('/')}/{COMPACTION}"

    def put_in_place() -> None:
        # each day of the copy replaces that day; repeatable until the copy is gone
        copy = read_stored(spark, staged, kind)
        copy.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("dt").parquet(path)
        fs.delete(hpath(staged), True)

    if fs.exists(hpath(f"{staged}/_SUCCESS")):
        put_in_place()
    table = spark.read.parquet(path)
    below = [c for c in ("batch", "run", "epoch") if c in table.columns]
    if below:
        raise ValueError(f"days of this table are divided by {below}; compact the tables built from it instead")
    table = read_stored(spark, path, kind).where(F.col("dt").cast("string").isin(days))
    _by_day(table).sortWithinPartitions("dt", *SORT_KEYS[kind]).write.mode("overwrite").partitionBy("dt").parquet(staged)
    put_in_place()


def write_bucketed_table(
    df: DataFrame, table: str, path: str, num_buckets: int, key: str = "trace_id", mode: str = "overwrite"
) -> None:
    """Store spans or logs as a catalog table bucketed and sorted by ``trace_id``.

    Trace-keyed work on such tables — per-trace aggregates (A22, T1–T4), the
    fetch semi join (T5) and joins between two tables bucketed the same way —
    reads each bucket in one task with no shuffle. ``path`` keeps the data in
    shared storage (an external table) rather than a local warehouse folder.
    """
    (
        _with_dt(df)
        .write.mode(mode)
        .option("path", path)
        .partitionBy("dt")
        .bucketBy(num_buckets, key)
        .sortBy(key)
        .saveAsTable(table)
    )


def truncate_table(spark: SparkSession, path: str, kind: str) -> None:
    """Replace the table with an empty one of the same schema."""
    empty = spark.createDataFrame([], SCHEMAS[kind]).withColumn("dt", F.to_date("ts"))
    empty.write.mode("overwrite").option("partitionOverwriteMode", "static").partitionBy("dt").parquet(path)


def read_stored(spark: SparkSession, path: str, kind: str | None = None) -> DataFrame:
    """Read a stored table back; ``dt`` is recovered as a partition column.

    With ``kind`` the schema is given rather than inferred, so an empty
    (truncated) table reads as zero rows.
    """
    if kind is None:
        return spark.read.parquet(path)
    return spark.read.schema(f"{SCHEMAS[kind]}, dt date").parquet(path)
