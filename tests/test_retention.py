"""M4–M8: policies, the expiry filter, the partition job and the data-age report."""

import pytest
from pyspark.sql import functions as F

from helpers import BASE_NS, logs_df
from vigil.operators import counts
from vigil.operators.retention import AggregationPolicy, RetentionPolicy, apply_retention, expire_partitions
from vigil.sources import views
from vigil.sources.sinks import read_stored, truncate_table, write_table

DAY = 86_400 * 1_000_000_000


def test_policy_validation():
    p = RetentionPolicy()
    assert p.ttl_days == {"logs": 30, "metrics": 90, "traces": 30}
    assert p.update("logs", 7).ttl_days["logs"] == 7
    for bad in (0, 3651):
        with pytest.raises(ValueError):
            RetentionPolicy({"logs": bad})
    with pytest.raises(ValueError):
        p.update("profiles", 3)
    assert AggregationPolicy().tiers["metrics_1min"] == 30
    with pytest.raises(ValueError):
        AggregationPolicy({"metrics_1min": 0})


def test_apply_retention(spark):
    logs = logs_df(spark, [dict(message=f"m{i}", service="s", ts_ns=BASE_NS + i * DAY) for i in range(10)])
    as_of = F.lit("2023-11-24 22:13:20").cast("timestamp")  # BASE_NS + 10 days
    kept = sorted(r.message for r in apply_retention(logs, 3, as_of).collect())
    assert kept == ["m7", "m8", "m9"]


def test_expire_partitions_job(spark, tmp_dir):
    logs = logs_df(spark, [dict(message=f"m{i}", service="s", ts_ns=BASE_NS + i * DAY // 2) for i in range(10)])
    path = f"{tmp_dir}/logs"
    write_table(logs, path, "logs")
    before = read_stored(spark, path).count()
    stats = expire_partitions(spark, path, ttl_days=2, as_of_ts="2023-11-19 12:00:00")
    after = sorted(r.message for r in read_stored(spark, path).collect())
    # cutoff 2023-11-17 12:00: m5 (11-17 10:13) is dropped from the boundary day, m6.. survive
    assert before == 10 and after == ["m6", "m7", "m8", "m9"]
    assert stats["dropped_days"] >= 1 and stats["rewritten_days"] == 1
    truncate_table(spark, path, "logs")
    assert read_stored(spark, path, "logs").count() == 0


def test_data_age_report(spark):
    d = "/root/testdata/sf0.001"
    rep = counts.data_age(
        {"logs": (views.logs(spark, d), "ts"), "metrics": (views.metrics(spark, d), "ts")},
        {"logs": 10, "metrics": 90},
    )
    rows = {r.data_type: r for r in rep.collect()}
    assert rows["logs"].exceeds_ttl is True and rows["metrics"].exceeds_ttl is False
    assert rows["logs"]["count"] == rows["metrics"]["count"] > 0


def test_rebuild_log_rollups(spark, tmp_dir):
    from vigil.operators.retention import rebuild_log_rollups

    logs = logs_df(spark, [dict(message=f"Payment failed for user {i}", service="pay", level="error",
                                ts_ns=BASE_NS + i * 60_000_000_000) for i in range(5)])
    write_table(logs, f"{tmp_dir}/logs", "logs")
    rebuild_log_rollups(spark, f"{tmp_dir}/logs", f"{tmp_dir}/roll")
    day = spark.read.parquet(f"{tmp_dir}/roll/logs_1day_counts").collect()
    assert [(r.normalized_message, r["count"]) for r in day] == [("Payment failed for user <NUM>", 5)]


def test_expire_partitions_resumes_from_staging(spark, tmp_dir):
    logs = logs_df(spark, [dict(message=f"m{i}", service="s", ts_ns=BASE_NS + i * DAY // 2) for i in range(10)])
    path = f"{tmp_dir}/logs2"
    write_table(logs, path, "logs")
    # a previous attempt staged the survivors and then lost the boundary day folder
    import shutil

    boundary = "2023-11-17"
    staged = f"{path}/_retention_staging/{boundary}"
    read_stored(spark, path, "logs").where(f"dt = '{boundary}' and ts >= '2023-11-17 12:00:00'").write.partitionBy(
        "dt").parquet(staged)
    shutil.rmtree(f"{path}/dt={boundary}")
    expire_partitions(spark, path, ttl_days=2, as_of_ts="2023-11-19 12:00:00")
    assert sorted(r.message for r in read_stored(spark, path, "logs").collect()) == ["m6", "m7", "m8", "m9"]


def test_batch_writes_are_idempotent(spark, tmp_dir):
    logs = logs_df(spark, [dict(message=f"m{i}", service="s", ts_ns=BASE_NS + i * DAY // 3) for i in range(9)])
    path = f"{tmp_dir}/idem"
    write_table(logs, path, "logs", batch_id="b1")
    write_table(logs, path, "logs", batch_id="b1")  # a re-run of the same batch
    write_table(logs.limit(2), path, "logs", batch_id="b2")
    assert spark.read.parquet(path).count() == 11


def test_expire_partitions_with_batches(spark, tmp_dir):
    logs = logs_df(spark, [dict(message=f"m{i}", service="s", ts_ns=BASE_NS + i * DAY // 2) for i in range(10)])
    path = f"{tmp_dir}/batched"
    write_table(logs, path, "logs", batch_id="b1")
    expire_partitions(spark, path, ttl_days=2, as_of_ts="2023-11-19 12:00:00")
    assert sorted(r.message for r in spark.read.parquet(path).collect()) == ["m6", "m7", "m8", "m9"]
    expire_partitions(spark, path, ttl_days=2, as_of_ts="2023-11-19 12:00:00")  # idempotent
    assert spark.read.parquet(path).count() == 4


def test_batch_names_survive_expiry_and_a_rerun(spark, tmp_dir):
    logs = logs_df(spark, [dict(message=f"m{i}", service="s", ts_ns=BASE_NS + i * DAY // 12) for i in range(24)])
    path = f"{tmp_dir}/named"
    for batch in ("007", "1e3", "2024-01-01"):  # names that look like values
        write_table(logs, path, "logs", batch_id=batch)
    expire_partitions(spark, path, ttl_days=2, as_of_ts="2023-11-17 12:00:00")
    import os

    kept = {name for day in os.listdir(path) if day.startswith("dt=") for name in os.listdir(f"{path}/{day}")}
    assert kept == {"batch=007", "batch=1e3", "batch=2024-01-01"}
    before = spark.read.parquet(path).count()
    young = logs.where("ts >= '2023-11-15 12:00:00'")
    for batch in ("007", "1e3", "2024-01-01"):  # a rerun replaces its own rows
        write_table(young, path, "logs", batch_id=batch)
    assert spark.read.parquet(path).count() == before == 3 * young.count()
