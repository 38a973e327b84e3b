"""Mergeable states: tiers from any split of the rows equal tiers from all rows; streams use and fold them."""

import json
import os

import pytest
from pyspark.sql import functions as F

from helpers import BASE_NS, spans_df
from vigil import schemas
from vigil.operators import rollups, states
from vigil.sources import native_json, views
from vigil.sources.validate import span_reject_reason, split_valid
from vigil.streaming import folding, ingest

SF = "/root/testdata/sf0.001"
SPAN_COLS = [*states.SPAN_KEYS, "span_count", "avg_duration_ns", "min_duration_ns", "max_duration_ns", *rollups.SPAN_PERCENTILES]
TRACE_COLS = ["timestamp", "service", "unique_traces", "total_spans"]


def rows_of(df, columns):
    return sorted(tuple(str(v) for v in r) for r in df.select(columns).collect())


def test_tiers_of_merged_states_equal_tiers_of_all_rows(spark):
    spans = views.spans(spark, SF)
    third = F.pmod(F.xxhash64("span_id"), F.lit(3))
    parts = [spans.where(third == i) for i in range(3)]
    values = parts[0].sparkSession.createDataFrame([], states.span_values(spans, "1hour").schema)
    members = spark.createDataFrame([], states.trace_members(spans, "1hour").schema)
    for part in parts:
        values = states.merge_span_values(values.unionByName(states.span_values(part, "1hour")), "1hour")
        members = members.unionByName(states.trace_members(part, "1hour"))
    for tier in ("1hour", "1day"):
        assert rows_of(states.span_stats(values, tier), SPAN_COLS) == rows_of(rollups.span_stats_rollup(spans, tier), SPAN_COLS)
        assert rows_of(states.trace_stats(members, tier), TRACE_COLS) == rows_of(rollups.trace_stats_rollup(spans, tier), TRACE_COLS)


def test_sketches_count_a_trace_once_over_buckets(spark):
    # 5,000 traces of a service, each with a span in each of three hours; a few of another
    spans = spark.range(15_000).select(
        F.concat(F.lit("t"), F.col("id") % 5000).alias("trace_id"), F.lit("hot").alias("service"),
        F.timestamp_seconds(F.lit(1_700_000_000) + F.call_function("div", F.col("id"), F.lit(5000)) * 3600).alias("ts"),
    ).unionByName(spark.range(6).select(F.concat(F.lit("u"), F.col("id") % 2).alias("trace_id"), F.lit("cold").alias("service"),
                                        F.timestamp_seconds(F.lit(1_700_000_000) + F.col("id") * 1200).alias("ts")))
    hours = rollups.trace_stats_rollup(spans, "1hour", sketch=True)
    exact = {r.service: r.n for r in spans.groupBy("service").agg(F.count_distinct("trace_id").alias("n")).collect()}
    whole = {r.service: (r.unique_traces, r.total_spans) for r in states.distinct_traces(hours, ["service"]).collect()}
    days = {r.service: r.unique_traces for r in states.distinct_traces(states.trace_tier_up(hours, "1day"), ["service"]).collect()}
    assert whole["cold"] == (2, 6) and whole["hot"][1] == 15_000
    assert abs(whole["hot"][0] - exact["hot"]) <= states.SKETCH_ERROR * exact["hot"] and days == {k: v[0] for k, v in whole.items()}
    assert hours.agg(F.sum("unique_traces")).first()[0] > 2.9 * exact["hot"]  # what a sum of the exact counts would say


def span(i, minute=0, day=15):
    return {"trace_id": f"t{i % 4}", "span_id": f"s{i}", "name": "op", "service": f"svc{i % 2}", "duration_ms": i % 7,
            "start_time": f"2024-01-{day:02d}T10:{minute:02d}:00Z"}


def send(inbox, name, rows):
    os.makedirs(inbox, exist_ok=True)
    with open(f"{inbox}/{name}", "w") as out:
        out.write("\n".join(map(json.dumps, rows)))


def run_stream(spark, base, fanout=None, monkeypatch=None):
    if fanout:
        monkeypatch.setattr(folding, "FANOUT", fanout)
        monkeypatch.setattr(folding.fold_day, "__defaults__", ((), None, fanout))
    stream = spark.readStream.schema(schemas.NATIVE_SPAN).option("maxFilesPerTrigger", 1).json(f"{base}/in")
    query = ingest.start_ingest(
        stream, "spans", lambda b: split_valid(native_json.normalize_spans(b), span_reject_reason()), f"{base}/raw", f"{base}/bad",
        f"{base}/tiers", "spans", available_now=True, checkpoint=f"{base}/ck")
    query.awaitTermination(300)
    assert query.exception() is None


def stored_tiers(spark, base):
    return {t: rows_of(spark.read.parquet(f"{base}/tiers/{t}"), SPAN_COLS if t.startswith("spans") else TRACE_COLS)
            for t in ("spans_1hour_stats", "spans_1day_stats", "traces_1hour_stats", "traces_1day_stats")}


def tiers_of(spark, base, rows):
    body = spark.createDataFrame([(json.dumps(r),) for r in rows], "b string").select(F.from_json("b", schemas.NATIVE_SPAN).alias("r")).select("r.*")
    spans, _ = split_valid(native_json.normalize_spans(body), span_reject_reason())
    return {f"{n}_{t}_stats": rows_of(fn(spans, t), cols) for t in ("1hour", "1day") for n, fn, cols in
            (("spans", rollups.span_stats_rollup, SPAN_COLS), ("traces", rollups.trace_stats_rollup, TRACE_COLS))}


def test_a_batch_updates_span_tiers_without_the_days_raw_spans(spark, tmp_dir):
    first, second = [span(i) for i in range(20)], [span(i, minute=30) for i in range(15, 40)]
    send(f"{tmp_dir}/in", "a.json", first)
    run_stream(spark, tmp_dir)
    for folder, _, files in os.walk(f"{tmp_dir}/raw/dt=2024-01-15"):
        for f in files:
            os.truncate(f"{folder}/{f}", 0)  # only the states can tell of the first batch
    send(f"{tmp_dir}/in", "b.json", second)
    run_stream(spark, tmp_dir)
    assert stored_tiers(spark, tmp_dir) == tiers_of(spark, tmp_dir, first + second)


def folders(base, day="2024-01-15"):
    run, = os.listdir(f"{base}/dt={day}")
    return sorted(int(f.removeprefix("epoch=")) for f in os.listdir(f"{base}/dt={day}/{run}") if f.startswith("epoch="))


def test_closed_epochs_are_folded_and_a_replay_replaces_its_rows(spark, tmp_dir, monkeypatch):
    sent = []
    for n in range(8):
        rows = [span(10 * n + i, minute=n) for i in range(5)] + ([{"span_id": "x"}] if n % 2 else [])
        send(f"{tmp_dir}/in", f"{n}.json", rows)
        sent += rows
    run_stream(spark, tmp_dir, 3, monkeypatch)
    partials = [f"{tmp_dir}/tiers/_partials/{t}" for t in ("spans_1hour_values", "traces_1hour_members")]
    assert len(folders(f"{tmp_dir}/raw")) <= 4 and all(folders(p) == folders(f"{tmp_dir}/raw") for p in partials)
    assert spark.read.parquet(f"{tmp_dir}/raw").count() == 40 and spark.read.parquet(f"{tmp_dir}/bad").count() == 4
    valid = [r for r in sent if "name" in r]
    assert stored_tiers(spark, tmp_dir) == tiers_of(spark, tmp_dir, valid)
    # the newest epoch is replayed: its commit is lost
    os.remove(f"{tmp_dir}/ck/commits/7")
    for f in os.listdir(f"{tmp_dir}/ck/commits"):
        if f.startswith(".7"):
            os.remove(f"{tmp_dir}/ck/commits/{f}")
    run_stream(spark, tmp_dir, 3, monkeypatch)
    assert spark.read.parquet(f"{tmp_dir}/raw").count() == 40 and stored_tiers(spark, tmp_dir) == tiers_of(spark, tmp_dir, valid)


@pytest.mark.parametrize("step", ["staging", "staged", "deleted"])
def test_a_broken_fold_is_completed(spark, tmp_dir, step):
    path, run = f"{tmp_dir}/t", "r"
    for e in range(3):
        spark.createDataFrame([(e, i) for i in range(3)], "e int, i int").write.parquet(f"{path}/dt=2024-01-01/run={run}/epoch={e}")
    staged = f"{path}/{folding.STAGING}/2024-01-01~{run}~0~1"
    spark.read.parquet(*[f"{path}/dt=2024-01-01/run={run}/epoch={e}" for e in (0, 1)]).write.parquet(staged)
    files = folding.Files(spark, path)
    if step == "staging":
        os.remove(f"{staged}/_SUCCESS")
    if step == "deleted":
        files.delete(f"{path}/dt=2024-01-01/run={run}/epoch=0")
        files.delete(f"{path}/dt=2024-01-01/run={run}/epoch=1")
    folding.recover(spark, path, run)
    assert folding.epochs(files, path, "2024-01-01", run) == ([0, 1, 2] if step == "staging" else [1, 2])
    assert sorted((r.e, r.i) for r in spark.read.parquet(path).collect()) == [(e, i) for e in range(3) for i in range(3)]
    assert files.names(f"{path}/{folding.STAGING}") == []


def test_folds_of_partial_rows_follow_the_raw_epochs():
    assert folding.size_classes({e: 100 for e in range(8)}, 8) == [list(range(8))]
    assert folding.size_classes({0: 5000, 1: 100, 2: 90, 3: 110}, 3) == [[1, 2, 3]]
    assert folding.covered([2, 5], [0, 1, 2, 3, 4, 5]) == [[0, 1, 2], [3, 4, 5]]
    assert folding.covered([2, 5], [2, 5]) == [] and folding.covered([2, 5], [3, 5, 6]) == [[3, 5]]


def test_a_replay_gives_absent_times_the_time_of_the_first_run(spark, tmp_dir):
    send(f"{tmp_dir}/in", "a.json", [{k: v for k, v in span(i).items() if k != "start_time"} for i in range(3)])
    run_stream(spark, tmp_dir)
    first = sorted((r.span_id, r.ts, str(r.dt)) for r in spark.read.parquet(f"{tmp_dir}/raw").collect())
    for f in os.listdir(f"{tmp_dir}/ck/commits"):
        os.remove(f"{tmp_dir}/ck/commits/{f}")
    run_stream(spark, tmp_dir)
    assert sorted((r.span_id, r.ts, str(r.dt)) for r in spark.read.parquet(f"{tmp_dir}/raw").collect()) == first and len(first) == 3
