"""M1: published windows plus reconciled late rows equal the batch rollup, for every kind of tier."""

import os

import pytest
from helpers import BASE_NS, logs_df, metrics_df, spans_df
from pyspark.sql import functions as F

from vigil.operators import rollups
from vigil.streaming.closing import ClosingTier, late_rows, reconcile, start_closing

HOUR = 3_600_000_000_000
START = BASE_NS // (24 * HOUR) * 24 * HOUR
# hours at which each batch has rows: the second and third come with rows of hours long published
BATCHES = [[1, 1, 2], [5, 1, 2, 4], [9, 1, 8, 27], [30, 2, 8, 26]]


def rows_of(spark, kind, hours, batch):
    if kind == "spans":
        return spans_df(spark, [dict(trace_id=f"t{h % 3}", span_id=f"{batch}-{i}", start_ns=START + h * HOUR + i, duration_ms=h + batch)
                                for i, h in enumerate(hours)])
    if kind == "metrics":
        return metrics_df(spark, [dict(name="m", value=h + batch, ts_ns=START + h * HOUR + i) for i, h in enumerate(hours)])
    return logs_df(spark, [dict(message=f"user {h} failed", service="s", ts_ns=START + h * HOUR + i) for i, h in enumerate(hours)])


# the last merges its late rows inside the stream
CASES = [("logs", 0, rollups.log_count_rollup, False), ("metrics", 0, rollups.metric_rollup, False),
         ("spans", 0, rollups.span_stats_rollup, False), ("spans", 1, rollups.trace_stats_rollup, False),
         ("logs", 0, rollups.log_count_rollup, True)]


def text(df, columns):
    return sorted(str(tuple(r)) for r in df.select(columns).collect())


@pytest.mark.parametrize("kind,state,rollup,inside", CASES)
def test_stream_and_reconciliation_equal_batch(spark, tmp_dir, kind, state, rollup, inside):
    tier = ClosingTier(f"{tmp_dir}/tiers", kind, "1hour", state)
    frames = [rows_of(spark, kind, hours, n).drop("attributes", "log_id", "point_id") for n, hours in enumerate(BATCHES)]
    os.makedirs(f"{tmp_dir}/in")
    for n, frame in enumerate(frames):
        frame.coalesce(1).write.parquet(f"{tmp_dir}/made{n}")
        part, = [f for f in os.listdir(f"{tmp_dir}/made{n}") if f.endswith(".parquet")]
        os.replace(f"{tmp_dir}/made{n}/{part}", f"{tmp_dir}/in/{n}.parquet")
        stream = spark.readStream.schema(frame.schema).parquet(f"{tmp_dir}/in")
        query = start_closing(stream, tier, f"closing_{kind}", 1800, True, f"{tmp_dir}/ck", reconcile_every=2 if inside else None)
        query.awaitTermination(300)
        assert query.exception() is None
    whole = frames[0]
    for frame in frames[1:]:
        whole = whole.unionByName(frame)
    want = rollup(whole, "1hour")
    columns = [c for c in want.columns if c != "labels"]
    closed = F.col("timestamp") + F.expr("interval 1 hour") <= F.timestamp_micros(F.lit((START + 30 * HOUR) // 1000 - 1800 * 10**6))
    want = want.where(closed)
    published = spark.read.parquet(tier.table)
    if not inside:
        assert late_rows(spark, tier).count() > 0 and text(published, columns) != text(want, columns)
    reconcile(spark, tier, 1800)
    assert text(spark.read.parquet(tier.table), columns) == text(want, columns) and want.count() >= 5
    assert late_rows(spark, tier) is None and reconcile(spark, tier, 1800) == []


def test_a_replayed_batch_splits_its_rows_alike(spark, tmp_dir):
    tier = ClosingTier(f"{tmp_dir}/tiers", "logs", "1hour")
    os.makedirs(f"{tmp_dir}/in")

    def run():
        query = start_closing(spark.readStream.schema(schema).parquet(f"{tmp_dir}/in"), tier, "closing_replay", 1800, True, f"{tmp_dir}/ck")
        query.awaitTermination(300)

    for n, hours in enumerate(BATCHES[:3]):
        frame = rows_of(spark, "logs", hours, n).drop("attributes", "log_id")
        schema = frame.schema
        frame.coalesce(1).write.parquet(f"{tmp_dir}/made{n}")
        part, = [f for f in os.listdir(f"{tmp_dir}/made{n}") if f.endswith(".parquet")]
        os.replace(f"{tmp_dir}/made{n}/{part}", f"{tmp_dir}/in/{n}.parquet")
        run()
    before = [text(spark.read.parquet(p), ["timestamp", "count"]) for p in (tier.table, tier.part("states"), tier.part("late"))]
    for f in os.listdir(f"{tmp_dir}/ck/commits"):
        if f.strip(".").startswith("2"):
            os.remove(f"{tmp_dir}/ck/commits/{f}")
    run()
    assert [text(spark.read.parquet(p), ["timestamp", "count"]) for p in (tier.table, tier.part("states"), tier.part("late"))] == before
