"""M2 + M3: streaming ingest with exact rollups under any lateness.

Each micro-batch (``foreachBatch``):

1. validates and appends raw rows to a table partitioned by ``dt``, ``run`` and
   ``epoch`` — dynamic partition overwrite of ``run=<id>/epoch=<batch id>`` makes a
   replayed batch idempotent (absent times are the batch's, which the checkpoint keeps, so
   a replay meets the same day however late it comes), and the run id, which lives in the checkpoint, keeps
   the rows of other checkpoints apart: a new or lost checkpoint counts its epochs
   from zero again but under a new run id. Rejected rows go to a quarantine table
   the same way, with rows whose event time lies outside the accepted span;
2. writes the batch's own state of each tier as partial rows (``<rollup_root>/_partials``,
   replaceable like the raw rows; :mod:`vigil.operators.states`) and builds the touched days
   of every tier from the partial rows: the day's raw rows are not read again, whatever
   the kind — the states of the span tiers give exact percentiles and distinct counts;
3. where a touched day holds raw rows without partial ones (of an older layout), collects the
   day keys (at most the accepted span, ≤ 3651 values) and recomputes those days of every rollup from the raw table
   with the batch operators, overwriting only those ``dt`` partitions.

Closed epochs are folded as the stream goes (:mod:`vigil.streaming.folding`), so a day's
folders stay few however many batches touch it.

Late rows are never dropped: they land in their day and that day is rebuilt,
which is what the reference's insert-triggered views do. The recompute reads
only the touched days (static partition pruning on ``dt``).
"""

from __future__ import annotations

import uuid
from collections.abc import Callable
from functools import partial

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from vigil.functions.timefn import TIERS
from vigil.operators import trace_index
from vigil.operators.rollups import overwrite_days, write_rollups
from vigil.operators.retention import MAX_TTL_DAYS, AggregationPolicy
from vigil.operators.states import STATES, State
from vigil.schemas import CORRUPT, RECEIVED
from vigil.session import configure, stream_checkpoint
from vigil.sources.sinks import SORT_KEYS
from vigil.streaming.folding import fold_day, recover


DEFAULT_TIERS = {"logs": ("1hour", "1day"), "metrics": tuple(TIERS), "spans": ("1hour", "1day")}


def read_json_stream(spark: SparkSession, path: str, schema: str, multi_line: bool = False) -> DataFrame:
    """M3: a JSON file stream (native or OTLP bodies) with ``source_file`` provenance,
    as the batch readers add it, so quarantined rows name their file."""
    configure(spark)
    raw = (
        spark.readStream.schema(f"{schema}, {CORRUPT} string")
        .option("multiLine", str(multi_line).lower())
        .option("columnNameOfCorruptRecord", CORRUPT)
        .json(path)
    )
    return raw.select("*", F.col("_metadata.file_path").alias("source_file"))


def _run_id(spark: SparkSession, checkpoint: str) -> str:
    """The id of the checkpoint: made once and stored inside it, so it goes when the checkpoint goes."""
    jvm = spark.sparkContext._jvm
    path = jvm.org.apache.hadoop.fs.Path(f"{checkpoint.rstrip('/')}/run_id")
    fs = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if not fs.exists(jvm.org.apache.hadoop.fs.Path(f"{checkpoint.rstrip('/')}/run_id/_SUCCESS")):
        spark.createDataFrame([(uuid.uuid4().hex,)], "id string").coalesce(1).write.mode("overwrite").text(path.toString())
    return spark.read.text(path.toString()).first()[0]


def _write_epoch(df: DataFrame, path: str, run: str, epoch_id: int) -> None:
    (
        df.withColumns({"run": F.lit(run), "epoch": F.lit(epoch_id)})
        .write.mode("overwrite")
        .option("partitionOverwriteMode", "dynamic")
        .partitionBy("dt", "run", "epoch")
        .parquet(path)
    )


def _epochs(spark: SparkSession, path: str, day) -> set[str]:
    """The ``run=…/epoch=…`` folders that a table has for a day."""
    jvm = spark.sparkContext._jvm
    pattern = jvm.org.apache.hadoop.fs.Path(f"{path.rstrip('/')}/dt={day}/run=*/epoch=*")
    found = pattern.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).globStatus(pattern) or []
    return {f"{s.getPath().getParent().getName()}/{s.getPath().getName()}" for s in found}


def partial_tables(out_root: str, kind: str, tiers) -> dict[State, str]:
    """Where each state of a kind keeps the partial rows of its batches, at the finest of the tiers."""
    finest = min(tiers, key=list(TIERS).index)
    return {state: f"{out_root.rstrip('/')}/_partials/{state.partials.format(tier=finest)}" for state in STATES[kind]}


def merge_days(
    spark: SparkSession, valid: DataFrame, raw_path: str, out_root: str, kind: str, run: str, epoch_id: int, days: list,
    tiers=None, policy: AggregationPolicy | None = None,
) -> list:
    """Add a batch to the tiers of ``kind`` through its partial rows; returns the days that need a rebuild from raw rows.

    The partial rows of an epoch replace themselves on a replay, and a tier's day is always
    the merge of all partial rows of the day, so every step can be repeated.
    """
    if not days:
        return days
    wanted = sorted(tiers or DEFAULT_TIERS[kind], key=list(TIERS).index)
    root = out_root.rstrip("/")
    partials = partial_tables(out_root, kind, wanted)
    for state, path in partials.items():
        _write_epoch(state.rows(valid, wanted[0]).withColumn("dt", F.to_date("timestamp")), path, run, epoch_id)
    whole = [d for d in days if all(_epochs(spark, raw_path, d) <= _epochs(spark, path, d) for path in partials.values())]
    for state, path in partials.items() if whole else ():
        rows = spark.read.parquet(path).where(F.col("dt").isin(whole)).drop("dt", "run", "epoch")
        built = dict.fromkeys(wanted) if "{tier}" in state.table else {wanted[0]: None}
        for tier in built:
            name = state.table.format(tier=tier)
            if policy is None or policy.is_enabled(name):
                overwrite_days(state.finish(rows, tier).withColumn("dt", F.to_date("timestamp")), f"{root}/{name}")
    if kind == "spans" and whole:
        trace_index.refresh_long(spark, root, whole)
    return [d for d in days if d not in whole]


def recompute_days(
    spark: SparkSession, raw_path: str, out_root: str, kind: str, days: list, tiers=None,
    policy: AggregationPolicy | None = None,
) -> None:
    """Rebuild the given days of every rollup of ``kind`` from the raw table.

    ``days`` are partition values (one per touched day, so at most the
    retention span); the ``dt IN (...)`` filter is pruned at planning time and
    only those day folders are read and overwritten.
    """
    if not days:
        return
    raw = spark.read.parquet(raw_path).where(F.col("dt").isin(days)).drop("run", "epoch")
    write_rollups(raw, kind, out_root, tiers or DEFAULT_TIERS[kind], policy)
    if kind == "spans":
        trace_index.write_index(raw, out_root, days)


def start_ingest(
    stream: DataFrame,
    kind: str,
    validate: Callable[[DataFrame], tuple[DataFrame, DataFrame]],
    raw_path: str,
    quarantine_path: str,
    rollup_root: str,
    name: str,
    available_now: bool = False,
    tiers=None,
    checkpoint: str | None = None,
    policy: AggregationPolicy | None = None,
    max_age_days: int = MAX_TTL_DAYS,
) -> StreamingQuery:
    """Run M3 ingest + M2 tier maintenance as one checkpointed streaming query.

    ``validate`` splits a batch into valid and rejected rows; for OTLP use
    ``otlp.split_requests``, which also rejects the requests that could not be read.

    The checkpoint defaults to ``<spark.checkpoint.dir>/<name>``. Event time is what
    clients claim: rows older than ``max_age_days`` or more than a day ahead are
    quarantined, which also bounds the days that a batch can touch.
    """
    spark = stream.sparkSession
    configure(spark)
    location = stream_checkpoint(spark, name, checkpoint)
    run = _run_id(spark, location)

    wanted = tiers or DEFAULT_TIERS[kind]
    finest = min(wanted, key=list(TIERS).index)
    merges = {path: partial(state.merge, tier=finest) for state, path in partial_tables(rollup_root, kind, wanted).items()}

    def process(batch: DataFrame, epoch_id: int) -> None:
        for table in (raw_path, quarantine_path, *merges):
            recover(spark, table, run)
        batch = batch.persist()  # read once, used by the two writes and the day scan
        try:
            valid, rejected = validate(batch)
            valid = valid if "dt" in valid.columns else valid.withColumn("dt", F.to_date("ts"))
            received = F.to_date(F.lit(batch.agg(F.max(RECEIVED)).first()[0]))  # a replay's as the first run's
            in_span = F.col("dt").between(F.date_sub(received, max_age_days), F.date_add(received, 1))
            outside = valid.where(~F.coalesce(in_span, F.lit(False))).withColumn("reject_reason", F.lit("event time out of range"))
            valid = valid.where(in_span)
            rejected = rejected.unionByName(outside.drop("dt"), allowMissingColumns=True)
            _write_epoch(valid, raw_path, run, epoch_id)
            # a day of the row's own, so that a replay meets the same partitions; 1970 for far-off times
            day = F.to_date("ts")
            day = F.when(F.year(day).between(2000, 2100), day).otherwise(F.lit("1970-01-01").cast("date"))
            _write_epoch(rejected.withColumn("dt", day), quarantine_path, run, epoch_id)
            # Distinct day keys of this batch: bounded by the accepted span.
            days = [r.dt for r in valid.select("dt").distinct().collect()]
            rebuild = merge_days(spark, valid, raw_path, rollup_root, kind, run, epoch_id, days, tiers, policy)
            quarantined = [r.day for r in rejected.select(day.alias("day")).distinct().collect()]  # bounded by the years above
        finally:
            batch.unpersist()
        recompute_days(spark, raw_path, rollup_root, kind, rebuild, tiers, policy)
        # every epoch before this one is committed: it will not be replayed
        for touched in days:
            fold_day(spark, raw_path, touched, run, epoch_id, SORT_KEYS[kind], merges)
        for touched in quarantined:
            fold_day(spark, quarantine_path, touched, run, epoch_id)

    # in a stream this is the batch's time, which the checkpoint keeps
    stream = stream.withColumn(RECEIVED, F.current_timestamp())
    writer = stream.writeStream.foreachBatch(process).option("checkpointLocation", location).queryName(name)
    if available_now:
        writer = writer.trigger(availableNow=True)
    return writer.start()
