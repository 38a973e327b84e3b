"""M1 with late rows kept: windows are published once the watermark has passed them, and what comes later is merged in.

A stream that drops late rows is fast and wrong; one that rewrites a tier for every row is
right and busy. Here each batch splits its rows: those of open windows go to the tier's
state rows (:mod:`vigil.operators.states`), those of windows already published to a side
table of late rows. When the watermark (the newest event time of all batches, less the
allowed delay) passes windows, the days that hold them are published from the state rows.
``reconcile`` then merges the late rows into the published windows: the tier equals the
batch rollup of all rows, however late they came.

Under ``<root>/_closing/<table>``: ``states`` and ``late`` by ``dt`` and ``epoch``, replaced
by a replayed batch, and ``marks``, a name for each batch with the newest event time
it had seen. A window's fate follows from the marks of the batches before, so a replay splits
the rows as the first run did.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from vigil.operators.rollups import overwrite_days
from vigil.operators.states import STATES, State
from vigil.plans.tiers import TIER_SECONDS
from vigil.session import configure, stream_checkpoint
from vigil.streaming.folding import Files

MICROS = 1_000_000


@dataclass(frozen=True)
class ClosingTier:
    """Where one tier and what it is made of are kept."""

    root: str
    kind: str
    tier: str
    state: int = 0

    @property
    def of(self) -> State:
        return STATES[self.kind][self.state]

    @property
    def table(self) -> str:
        return f"{self.root.rstrip('/')}/{self.of.table.format(tier=self.tier)}"

    def part(self, name: str) -> str:
        return f"{self.root.rstrip('/')}/_closing/{self.of.table.format(tier=self.tier)}/{name}"

    @property
    def width(self) -> int:
        return TIER_SECONDS[self.tier] * MICROS

    def rows(self, spark: SparkSession, name: str) -> DataFrame | None:
        files = Files(spark, self.root)
        if not any(n.startswith("dt=") for n in files.names(self.part(name))):
            return None
        return spark.read.parquet(self.part(name)).drop("epoch")


def _marks(files: Files, tier: ClosingTier) -> dict[int, int]:
    """Newest event time (µs) that each batch had seen, its own rows included."""
    return {int(epoch): int(newest) for epoch, newest in (n.split("~") for n in files.names(tier.part("marks")))}


def _watermark(files: Files, tier: ClosingTier, before: int | None, delay: int) -> int | None:
    """The watermark that the batches before an epoch (all, if none is given) have set."""
    seen = [newest for epoch, newest in _marks(files, tier).items() if before is None or epoch < before]
    return max(seen) - delay if seen else None


def _publish(spark: SparkSession, tier: ClosingTier, rows: DataFrame, days: list, watermark: int) -> None:
    """Write the closed windows of some days of the tier from state rows."""
    closed = rows.where(F.col("dt").isin(days) & (F.unix_micros("timestamp") + F.lit(tier.width) <= F.lit(watermark))).drop("dt")
    overwrite_days(tier.of.finish(closed, tier.tier).withColumn("dt", F.to_date("timestamp")), tier.table)


def _days_between(rows: DataFrame, tier: ClosingTier, after: int | None, upto: int) -> list:
    end = F.unix_micros("timestamp") + F.lit(tier.width)
    closing = (end <= F.lit(upto)) & (F.lit(True) if after is None else end > F.lit(after))
    return [r["dt"] for r in rows.where(closing).select("dt").distinct().collect()]  # at most the days of open windows


def _write_epoch(rows: DataFrame, path: str, epoch: int) -> None:
    rows.withColumns({"dt": F.to_date("timestamp"), "epoch": F.lit(epoch)}).write.mode("overwrite").option(
        "partitionOverwriteMode", "dynamic").partitionBy("dt", "epoch").parquet(path)


def start_closing(
    stream: DataFrame, tier: ClosingTier, name: str, delay_seconds: int = 600, available_now: bool = False,
    checkpoint: str | None = None, reconcile_every: int | None = None,
) -> StreamingQuery:
    """Keep a tier of an entity stream: published windows once, late rows aside.

    ``reconcile_every``: merge the late rows after so many batches, inside the stream;
    otherwise call :func:`reconcile` while the stream is stopped.
    """
    spark = stream.sparkSession
    configure(spark)
    delay = delay_seconds * MICROS

    def process(batch: DataFrame, epoch: int) -> None:
        files = Files(spark, tier.root)
        before = _watermark(files, tier, epoch, delay)
        states = tier.of.rows(batch, tier.tier).persist()
        try:
            newest = batch.agg(F.max(F.unix_micros("ts"))).first()[0]
            if newest is None:
                return
            late = F.lit(False) if before is None else F.unix_micros("timestamp") + F.lit(tier.width) <= F.lit(before)
            _write_epoch(states.where(~late), tier.part("states"), epoch)
            _write_epoch(states.where(late), tier.part("late"), epoch)
        finally:
            states.unpersist()
        for mark in files.names(tier.part("marks")):  # of the run that this one repeats
            if mark.startswith(f"{epoch}~"):
                files.delete(f"{tier.part('marks')}/{mark}")
        newest = max([newest, *(m for e, m in _marks(files, tier).items() if e < epoch)])
        files.touch(f"{tier.part('marks')}/{epoch}~{newest}")
        rows = tier.rows(spark, "states")
        if rows is not None and (days := _days_between(rows, tier, before, newest - delay)):
            _publish(spark, tier, rows, days, newest - delay)
        if reconcile_every and epoch % reconcile_every == reconcile_every - 1:
            reconcile(spark, tier, delay_seconds)

    writer = stream.writeStream.foreachBatch(process).option("checkpointLocation", stream_checkpoint(spark, name, checkpoint)).queryName(name)
    if available_now:
        writer = writer.trigger(availableNow=True)
    return writer.start()


def late_rows(spark: SparkSession, tier: ClosingTier) -> DataFrame | None:
    """State rows that came after their window was published and are not merged yet."""
    return tier.rows(spark, "late")


def reconcile(spark: SparkSession, tier: ClosingTier, delay_seconds: int = 600) -> list:
    """Merge the late rows into the published windows; returns the days that were rewritten.

    The days are published from state rows and late rows together; then the late rows join
    the state rows, so a later publication of the same day has them too. Either step can
    be repeated after a lost driver.
    """
    files, late = Files(spark, tier.root), late_rows(spark, tier)
    if late is None:
        return []
    days = [r["dt"] for r in late.select("dt").distinct().collect()]
    states = tier.rows(spark, "states")
    rows = late if states is None else states.unionByName(late)
    _publish(spark, tier, rows, days, _watermark(files, tier, None, delay_seconds * MICROS))
    for day in files.names(tier.part("late")):
        for epoch in files.names(f"{tier.part('late')}/{day}") if day.startswith("dt=") else ():
            # under a number of its own: the batch's on-time rows of that day keep theirs
            files.rename(f"{tier.part('late')}/{day}/{epoch}", f"{tier.part('states')}/{day}/epoch=-{int(epoch.removeprefix('epoch=')) + 1}")
        files.delete(f"{tier.part('late')}/{day}")
    return days
