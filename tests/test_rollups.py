"""A1–A11 golden cases (after the reference's aggregation tests) and properties."""

import random

import pytest
from pyspark.sql import functions as F

from helpers import BASE_NS, logs_df, metrics_df, spans_df
from vigil.operators import rollups
from vigil.operators.quantiles import grouped_percentiles
from vigil.sources import views

MIN = 60 * 1_000_000_000
T0 = (BASE_NS // MIN) * MIN  # a minute boundary


def test_metric_rollup_golden(spark):
    labels = {"service": "test-service", "host": "server1"}
    pts = [dict(name="cpu_usage", value=v, labels=labels, ts_ns=T0 + i * 1_000_000_000) for i, v in enumerate([50, 75, 100, 25])]
    r = rollups.metric_rollup(metrics_df(spark, pts), "1min").collect()
    assert len(r) == 1
    assert (r[0]["count"], r[0]["sum"], r[0]["min"], r[0]["max"], r[0]["avg"]) == (4, 250.0, 25.0, 100.0, 62.5)
    assert r[0]["labels_key"] == "host=server1,service=test-service"


def test_metric_rollup_per_service(spark):
    pts = [
        dict(name="request_count", value=v, labels={"service": s}, ts_ns=T0 + i)
        for i, (s, v) in enumerate([("api-service", 100), ("api-service", 200), ("worker-service", 50), ("worker-service", 150)])
    ]
    got = {r.service: (r["count"], r["sum"]) for r in rollups.metric_rollup(metrics_df(spark, pts), "1hour").collect()}
    assert got == {"api-service": (2, 300.0), "worker-service": (2, 200.0)}


def test_log_counts_and_patterns(spark):
    rows = [
        dict(level="error", message="Connection timeout", service="db-service"),
        dict(level="error", message="Connection refused", service="db-service"),
        dict(level="error", message="Connection reset", service="db-service"),
        dict(level="warn", message="Slow query", service="db-service"),
        dict(level="info", message="Request handled", service="api-service"),
        dict(level="error", message="Payment failed for user 123", service="pay"),
        dict(level="error", message="Payment failed for user 456", service="pay"),
        dict(level="info", message="Payment succeeded", service="pay"),
    ]
    counts = rollups.log_count_rollup(logs_df(spark, rows), "1hour")
    by = counts.groupBy("level", "service").agg(F.sum("count").alias("n"))
    got = {(r.level, r.service): r.n for r in by.collect()}
    assert got[("error", "db-service")] == 3
    pat = {r.normalized_message: r["count"] for r in counts.where("service = 'pay'").collect()}
    assert pat == {"Payment failed for user <NUM>": 2, "Payment succeeded": 1}
    sample = counts.where("normalized_message = 'Payment failed for user <NUM>'").first().sample_message
    assert sample == "Payment failed for user 123"


def test_span_and_trace_stats(spark):
    spans = spans_df(
        spark,
        [dict(trace_id=f"t{i}", span_id=f"s{i}", name="op", service="svc", duration_ms=100) for i in range(1, 4)]
        + [dict(trace_id="t4", span_id="s4", name="op", service="svc", status="error", duration_ms=500)],
    )
    stats = {r.status_code: r.span_count for r in rollups.span_stats_rollup(spans, "1hour").collect()}
    assert stats == {"ok": 3, "error": 1}
    six = spans_df(spark, [dict(trace_id=f"t{i // 2}", span_id=f"s{i}", service="svc") for i in range(6)])
    t = rollups.trace_stats_rollup(six, "1day").first()
    assert (t.total_spans, t.unique_traces) == (6, 3)


def test_tier_up_equals_direct(spark):
    m = views.metrics(spark, "/root/testdata/sf0.001")
    direct = rollups.metric_rollup(m, "1day")
    for fine in ("1min", "5min", "1hour"):
        up = rollups.tier_up(rollups.metric_rollup(m, fine), "1day")
        cols = ["timestamp", "name", "metric_type", "service", "labels_key", "count", "sum", "min", "max", "avg"]
        # the sums agree to the rounding of DOUBLE addition
        up, same = (df.withColumns({c: F.round(c, 6) for c in ("sum", "avg")}).select(cols) for df in (up, direct))
        assert up.exceptAll(same).count() == 0
        assert same.exceptAll(up).count() == 0


def _brute(values, p):
    v = sorted(values)
    pos = p * (len(v) - 1)
    lo, hi = int(pos // 1), int(-(-pos // 1))
    return v[lo] + (v[hi] - v[lo]) * (pos - lo)


@pytest.mark.parametrize("seed", [1, 2])
def test_grouped_percentiles_vs_brute_force_with_hot_group(spark, seed):
    rnd = random.Random(seed)
    rows = [("hot", rnd.randint(0, 10_000)) for _ in range(3000)]  # a third+ of all rows in one group
    rows += [(f"g{rnd.randint(0, 40)}", rnd.randint(0, 500)) for _ in range(2000)]
    rows += [("single", 7)]
    df = spark.createDataFrame(rows, "k string, v long").repartition(7)
    probs = {"p0": 0.0, "p50": 0.5, "p95": 0.95, "p99": 0.99, "p100": 1.0}
    got = {r.k: r for r in grouped_percentiles(df, ["k"], "v", probs).collect()}
    groups = {}
    for k, v in rows:
        groups.setdefault(k, []).append(v)
    assert set(got) == set(groups)
    for k, vals in groups.items():
        r = got[k]
        assert (r.n, r.sum_v, r.min_v, r.max_v) == (len(vals), sum(vals), min(vals), max(vals))
        for name, p in probs.items():
            assert r[name] == pytest.approx(_brute(vals, p), abs=1e-9), (k, name)


def test_percentiles_match_builtin(spark):
    df = views.spans(spark, "/root/testdata/sf0.001").select("service", "duration_ns")
    ours = grouped_percentiles(df, ["service"], "duration_ns", {"p95": 0.95})
    builtin = df.groupBy("service").agg(F.percentile("duration_ns", 0.95).alias("b"))
    for r in ours.join(builtin, "service").collect():
        assert r.p95 == pytest.approx(r.b, rel=1e-12)


def test_pick_tier():
    from vigil.plans.tiers import pick_tier

    assert pick_tier(1, 30) == "raw"
    assert pick_tier(1, 60) == "1min"
    assert pick_tier(1, 3600) == "1hour"
    assert pick_tier(60, 300) == "5min"
    assert pick_tier(100, 300) == "raw"  # 5-minute tier keeps 90 days
    assert pick_tier(400, 86_400) == "1day"


def test_percentiles_hot_group_of_identical_values_is_split(spark):
    rows = [("hot", 0)] * 4000 + [("hot", 5)] * 10 + [(f"g{i % 7}", i) for i in range(500)]
    df = spark.createDataFrame(rows, "k string, v long").repartition(8)
    got = {r.k: r for r in grouped_percentiles(df, ["k"], "v", {"p50": 0.5, "p99": 0.99, "p100": 1.0}).collect()}
    assert (got["hot"].n, got["hot"].p50, got["hot"].p100) == (4010, 0.0, 5.0)
    assert got["hot"].p99 == pytest.approx(_brute([0] * 4000 + [5] * 10, 0.99))
    # the range exchange spreads the hot group: no partition holds most of it
    from pyspark.sql import functions as F

    spread = (
        df.withColumn("_tie", F.monotonically_increasing_id())
        .repartitionByRange(8, "k", "v", "_tie")
        .groupBy(F.spark_partition_id().alias("pid")).count()
        .agg(F.max("count")).first()[0]
    )
    assert spread < 2000


def test_span_tier_without_percentiles_matches(spark):
    sp = views.spans(spark, "/root/testdata/sf0.001")
    cols = ["timestamp", "service", "operation", "span_kind", "status_code", "span_count", "avg_duration_ns",
            "min_duration_ns", "max_duration_ns"]
    full = rollups.span_stats_rollup(sp, "1hour").select(cols)
    lite = rollups.span_stats_rollup(sp, "1hour", percentiles=False).select(cols)
    assert full.exceptAll(lite).count() == 0 and lite.exceptAll(full).count() == 0


def test_write_rollups_job_is_rerunnable(spark, tmp_dir):
    m = views.metrics(spark, "/root/testdata/sf0.001")
    names = rollups.write_rollups(m, "metrics", f"{tmp_dir}/tiers")
    assert names == ["metrics_1min", "metrics_5min", "metrics_1hour", "metrics_1day"]
    rollups.write_rollups(m, "metrics", f"{tmp_dir}/tiers", tiers=("1day",))  # re-run one tier
    day = spark.read.parquet(f"{tmp_dir}/tiers/metrics_1day").drop("dt")
    direct = rollups.metric_rollup(m, "1day").drop("labels")
    assert day.count() == direct.count()
    assert day.select("count").groupBy().sum().first()[0] == m.count()
