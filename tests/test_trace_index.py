"""The trace index answers as the search over all spans does, and reads no other days."""

import random

import pytest
from pyspark.sql import functions as F

from helpers import BASE_NS, spans_df
from vigil.operators import trace_index, traces
from vigil.sources.sinks import read_stored, write_table

DAY = 86_400_000_000_000
MIDNIGHT = BASE_NS // DAY * DAY


def make_spans(spark, n=260, seed=3, days=6):
    r = random.Random(seed)
    rows = []
    for i in range(n):
        trace = r.randrange(60)
        start = MIDNIGHT + (trace % days) * DAY + r.randrange(DAY)
        if trace % 9 == 0:
            start += r.randrange(3) * DAY  # lasts over days, perhaps with a day between
        rows.append(dict(trace_id=f"t{trace}", span_id=f"s{i}", service=f"svc{r.randrange(4)}", status=r.choice(["ok", "ok", "error"]),
                         start_ns=start, duration_ms=r.randrange(50_000)))
    rows += [dict(trace_id="around", span_id=f"a{k}", service="svc0", start_ns=MIDNIGHT + k * DAY) for k in (0, 5)]
    return spans_df(spark, rows)


FILTERS = [
    {}, {"service": "svc1"}, {"status": "error"}, {"start_ns": MIDNIGHT + 2 * DAY + DAY // 3}, {"end_ns": MIDNIGHT + 2 * DAY},
    {"start_ns": MIDNIGHT + 2 * DAY, "end_ns": MIDNIGHT + 2 * DAY + DAY // 24}, {"min_duration_ms": 40_000, "max_duration_ms": 10**8},
    {"service": "svc0", "status": "error", "start_ns": MIDNIGHT + DAY, "end_ns": MIDNIGHT + 4 * DAY, "min_duration_ms": 1},
]


def key(df):
    return sorted(str(tuple(r)) for r in df.select(trace_index.FOUND).collect())


@pytest.fixture(scope="module")
def stored(spark, tmp_path_factory):
    base = str(tmp_path_factory.mktemp("index"))
    spans = make_spans(spark)
    write_table(spans, f"{base}/spans", "spans")
    trace_index.write_index(spans, base)
    return base, spans


@pytest.mark.parametrize("filters", FILTERS)
def test_search_equals_the_search_over_all_spans(spark, stored, filters):
    base, spans = stored
    found = trace_index.search(*trace_index.read_index(spark, base), **filters)
    want = traces.find_traces(spans, prefilter=False, **filters)
    assert key(found) == key(want) == key(traces.find_traces(spans, **filters)) and (found.count() > 0)
    fetched = trace_index.fetch_spans(spans, found.limit(5))
    ids = [r.trace_id for r in found.limit(5).collect()]
    assert sorted(r.span_id for r in fetched.collect()) == sorted(r.span_id for r in spans.where(F.col("trace_id").isin(ids)).collect())


def partition_filters(df):
    plan = df._jdf.queryExecution().executedPlan().toString()
    return [line for line in plan.splitlines() if "FileScan" in line]


def test_both_scans_are_pruned_by_day(spark, stored):
    base, _ = stored
    index, long = trace_index.read_index(spark, base)
    found = trace_index.search(index, long, start_ns=MIDNIGHT + 2 * DAY, end_ns=MIDNIGHT + 3 * DAY)
    scans = [s for s in partition_filters(found) if "dt=" in s or "trace_index]" in s or "trace_index/" not in s]
    assert any("PartitionFilters: [isnotnull(dt" in s and ">= 2023-11-16" in s and "<= 2023-11-16" in s for s in scans), scans
    spans = read_stored(spark, f"{base}/spans")
    day_traces = found.where(F.size("days") == 1)
    scans = partition_filters(trace_index.fetch_spans(spans, day_traces))
    assert any("PartitionFilters: [" in s and "2023-11-16" in s and "kind" in s for s in scans), scans


def test_the_index_grows_day_by_day(spark, tmp_dir):
    spans = make_spans(spark, seed=8)
    days = [r.dt for r in spans.select("dt").distinct().orderBy("dt").collect()]
    for day in days:  # late days come last: traces become long as their other days arrive
        trace_index.write_index(spans, tmp_dir, [day])
    index, long = trace_index.read_index(spark, tmp_dir)
    whole = trace_index.index_rows(spans)
    assert sorted(map(str, index.select(whole.columns).collect())) == sorted(map(str, whole.collect()))
    want = trace_index.long_rows(whole)
    assert sorted(map(str, long.select(want.columns).collect())) == sorted(map(str, want.collect()))
    # a day that shrinks takes its traces out of the long ones
    fewer = spans.where((F.col("dt") != days[-1]) | (F.col("trace_id") == "none"))
    trace_index.write_index(fewer.unionByName(spans.where(F.col("dt") == days[-1]).limit(1)), tmp_dir, days[-1:])
    kept = trace_index.read_index(spark, tmp_dir)
    assert kept[1].count() <= long.count() and key(trace_index.search(*kept)) == key(traces.find_traces(
        fewer.unionByName(spans.where(F.col("dt") == days[-1]).limit(1))))


def test_indexes_of_batches_merge(spark):
    spans = make_spans(spark, seed=5)
    half = F.pmod(F.xxhash64("span_id"), F.lit(2))
    parts = [trace_index.index_rows(spans.where(half == i)) for i in range(2)]
    merged = trace_index.merge_index(parts[0].unionByName(parts[1]))
    whole = trace_index.index_rows(spans)
    assert sorted(map(str, merged.select(whole.columns).collect())) == sorted(map(str, whole.collect()))


def test_the_index_expires_with_its_spans(spark, tmp_dir):
    from vigil.operators.retention import RetentionPolicy, enforce_retention

    spans = make_spans(spark, seed=4)
    trace_index.write_index(spans, f"{tmp_dir}/tiers")
    cutoff = F.lit("2023-11-17 12:00:00").cast("timestamp")
    done = enforce_retention(spark, {}, f"{tmp_dir}/tiers", "2023-11-19 12:00:00", RetentionPolicy({"traces": 2}))
    index, _ = trace_index.read_index(spark, f"{tmp_dir}/tiers")
    whole = trace_index.index_rows(spans)
    kept = whole.where(F.col("last_ts") >= cutoff)
    assert done[trace_index.DAYS]["dropped_days"] > 0 and 0 < kept.count() < whole.count()
    assert sorted(map(str, index.select(whole.columns).collect())) == sorted(map(str, kept.collect()))
