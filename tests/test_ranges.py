"""Stitched range reads, deep pages and the message dictionary."""

import os
import random

import pytest
from helpers import BASE_NS, logs_df, metrics_df
from pyspark.sql import functions as F

from vigil.functions.normalize import normalize_message
from vigil.functions.timefn import ns_to_ts
from vigil.operators import deep_pages, pattern_dictionary, rollups
from vigil.operators.logs import OrderBy, search_logs
from vigil.operators.predicates import Cond
from vigil.plans.ranges import RAW, Segment, read_range, stitch
from vigil.plans.tiers import TIER_SECONDS
from vigil.sources.sinks import read_stored, write_table

SECOND, DAY = 10**9, 86_400 * 10**9
TIERS = list(TIER_SECONDS)


def test_segments_cover_the_range_once_in_whole_buckets():
    r = random.Random(1)
    for _ in range(300):
        start = r.randrange(10 * DAY)
        end = start + r.choice([0, 1, r.randrange(90 * SECOND), r.randrange(DAY), r.randrange(400 * DAY)])
        closed = r.choice([None, r.randrange(20 * DAY)])
        oldest = r.choice([{}, {"1min": r.randrange(5 * DAY), "5min": r.randrange(3 * DAY)}])
        found = stitch(start, end, TIERS, closed, oldest)
        assert all(s.start_ns < s.end_ns for s in found)
        assert [s.start_ns for s in found] == [start, *[s.end_ns for s in found[:-1]]][: len(found)] and (not found or found[-1].end_ns == end)
        for s in found:
            if s.source != RAW:
                width = TIER_SECONDS[s.source] * SECOND
                assert s.start_ns % width == s.end_ns % width == 0
                assert closed is None or s.end_ns <= closed
                assert s.start_ns >= oldest.get(s.source, 0)
        if closed is None and not oldest:  # raw rows only where no whole minute fits
            assert sum(s.end_ns - s.start_ns for s in found if s.source == RAW) < 2 * 60 * SECOND
    assert stitch(0, DAY, ["1day"]) == [Segment("1day", 0, DAY)]


def test_a_range_off_the_borders_equals_raw(spark, tmp_dir):
    r = random.Random(3)
    points = [dict(name=r.choice("ab"), value=r.randrange(100), ts_ns=BASE_NS + r.randrange(5 * DAY), labels={"h": r.choice("xy")}) for _ in range(400)]
    raw = metrics_df(spark, points)
    rollups.write_rollups(raw, "metrics", tmp_dir)
    tiers = {t: spark.read.parquet(f"{tmp_dir}/metrics_{t}") for t in TIERS}
    cols = ["timestamp", "name", "labels_key", "count", "sum", "min", "max"]
    for start, end, bucket in ((BASE_NS + 17 * SECOND, BASE_NS + 4 * DAY + 3 * SECOND + 1, "1day"), (BASE_NS + DAY, BASE_NS + DAY + 7200 * SECOND, "1hour"),
                               (BASE_NS + 5, BASE_NS + 3 * SECOND, "1min")):
        inside = raw.where((F.col("timestamp_ns") >= start) & (F.col("timestamp_ns") < end))
        want = rollups.metric_rollup(inside, bucket)
        got = read_range("metrics", raw, tiers, start, end, bucket, closed_ns=BASE_NS + 3 * DAY)
        assert sorted(map(str, got.select(cols).collect())) == sorted(map(str, want.select(cols).collect()))
    plan = read_range("metrics", raw, tiers, BASE_NS + DAY, BASE_NS + 2 * DAY)._jdf.queryExecution().executedPlan().toString()
    scans = [s for s in plan.splitlines() if "FileScan" in s]
    assert scans and all("PartitionFilters: [isnotnull(dt" in s for s in scans)


@pytest.fixture(scope="module")
def paged(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("paged"))
    r = random.Random(7)
    rows = [dict(message=f"m{i % 50}", service="s", level=r.choice(["info", "error"]), ts_ns=BASE_NS + r.randrange(60) * 3600 * SECOND // 10 * 7)
            for i in range(700)]
    logs = logs_df(spark, rows)
    write_table(logs.drop("level_order"), path, "logs")
    return path, logs


@pytest.mark.parametrize("offset,limit", [(0, 10), (5, 0), (123, 50), (650, 100), (699, 5), (700, 5), (10**7, 3)])
@pytest.mark.parametrize("descending", [True, False])
def test_pages_equal_offsets(spark, paged, offset, limit, descending):
    _, logs = paged
    for where in (None, Cond("level", "=", "error")):
        got = deep_pages.page_at(logs, offset, limit, where, descending).collect()
        want = search_logs(logs, where, OrderBy("timestamp", descending), limit, offset).collect()
        assert [x.log_id for x in got] == [x.log_id for x in want]


def test_a_deep_page_reads_the_hours_that_hold_it(spark, paged):
    path, _ = paged
    logs = spark.read.parquet(path)
    counts = rollups.log_count_rollup(logs, "1hour")
    page = deep_pages.page_at(logs, 400, 20, counts=counts)
    plan = page._jdf.queryExecution().executedPlan().toString()
    scan, = [s for s in plan.splitlines() if "FileScan" in s]
    assert ">= 2023-11-15)" in scan and "<= 2023-11-15)" in scan  # one of two days
    kept, = [s for s in plan.splitlines() if "Filter" in s and "FileScan" not in s]
    assert "timestamp_ns" in kept and ">=" in kept and "<" in kept
    times = [r.timestamp_ns for r in search_logs(logs, None, OrderBy("timestamp"), 20, 400).collect()]
    assert [r.timestamp_ns for r in page.collect()] == times


def test_a_rule_change_rewrites_distinct_messages_only(spark, tmp_dir):
    logs = logs_df(spark, [dict(message=f"user {i % 5} failed", service="s", ts_ns=BASE_NS + i * DAY // 20) for i in range(60)])
    seen = spark.sparkContext.accumulator(0)

    def counted(version):
        def change(message):
            probe = F.udf(lambda m: (seen.add(1), m)[1])  # counts what the rules see
            return F.concat(F.lit(version), normalize_message(probe(message)))
        return change

    path, root = f"{tmp_dir}/dict", f"{tmp_dir}/tiers"
    pattern_dictionary.rebuild_log_tiers(logs.limit(30), path, root, version="v1", normalise=counted("A "))
    pattern_dictionary.rebuild_log_tiers(logs, path, root, version="v1", normalise=counted("A "))
    assert seen.value == 5 and spark.read.parquet(path).where("version = 'v1'").count() == 5
    for tier in ("1hour", "1day"):
        whole = rollups.log_count_rollup(logs.withColumn("normalized_message", F.concat(F.lit("A "), normalize_message("message"))), tier)
        stored = spark.read.parquet(f"{root}/logs_{tier}_counts").drop("dt")
        assert sorted(map(str, stored.select(whole.columns).collect())) == sorted(map(str, whole.collect()))
    pattern_dictionary.rebuild_log_tiers(logs, path, root, version="v2", normalise=counted("B "))
    assert seen.value == 10
    assert {r.normalized_message for r in spark.read.parquet(f"{root}/logs_1day_counts").collect()} == {"B user <NUM> failed"}
    pattern_dictionary.rebuild_log_tiers(logs, path, root)  # the rules in force
    assert {r.normalized_message for r in spark.read.parquet(f"{root}/logs_1day_counts").collect()} == {"user <NUM> failed"}
    assert os.path.isdir(f"{path}/version={pattern_dictionary.rules_version()}")


from vigil.operators.predicates import And, Or  # noqa: E402
from vigil.sources import skip_index  # noqa: E402


@pytest.fixture(scope="module")
def gram_table(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("grams"))
    words = ["timeout", "Größe", "refused", "日本語のログ", "disk full", "ΣΟΦΟΣ", "ok"]
    for i, w in enumerate(words):  # a file for each
        rows = [dict(message=f"{w} on host-{j}", service="s", ts_ns=BASE_NS + i * DAY // 3) for j in range(6)] + [dict(message="", service="s")]
        write_table(logs_df(spark, rows).coalesce(1), path, "logs")
    skip_index.build(spark, path, "logs")
    write_table(logs_df(spark, [dict(message="timeout later", service="s", ts_ns=BASE_NS)]), path, "logs")  # not indexed
    return path


@pytest.mark.parametrize("pred,most", [
    (Cond("message", "contains", "TimeOut"), 3), (Cond("message", "contains", "größe"), 2), (Cond("message", "starts_with", "日本語"), 2),
    (Cond("message", "ends_with", "host-3"), 99), (Cond("message", "contains", "σοφος"), 2), (Cond("message", "contains", "absent word"), 1),
    (And(Cond("message", "contains", "disk"), Cond("message", "contains", "refused")), 1),
    (Or(Cond("message", "contains", "disk"), Cond("message", "contains", "refused")), 4), (Cond("message", "contains", "ok"), 99),
    (Or(Cond("message", "contains", "disk"), Cond("service", "=", "s")), 99), (Cond("message", "!=", "ok"), 99),
    (And(Cond("message", "contains", "disk"), Cond("service", "=", "S")), 2),
])
def test_searches_open_only_files_that_can_match(spark, gram_table, pred, most):
    found = skip_index.search(spark, gram_table, "logs", pred)
    want = search_logs(read_stored(spark, gram_table, "logs"), pred)
    assert sorted(r.message for r in found.collect()) == sorted(r.message for r in want.collect())
    every = read_stored(spark, gram_table, "logs").inputFiles()
    assert len(found.inputFiles()) <= min(most, len(every))


def test_days_are_indexed_again(spark, gram_table):
    before = skip_index.candidate_files(spark, gram_table, "logs", Cond("message", "contains", "absent word"))
    skip_index.build(spark, gram_table, "logs", days=["2023-11-14"])
    after = skip_index.candidate_files(spark, gram_table, "logs", Cond("message", "contains", "absent word"))
    assert len(before) == 1 and after == []


def test_ns_days(spark):
    assert str(spark.range(1).select(F.to_date(ns_to_ts(F.lit(BASE_NS))).alias("d")).first().d) == "2023-11-14"


def test_grams_split_a_text_once(spark):
    """A text of 40,000 letters took minutes when it was split again for each gram."""
    import time

    texts = [("ab" * 20_000 + "xyz",), ("ab",), ("",), (None,), ("ÄBc",)]
    df = spark.createDataFrame(texts, "t string")
    began = time.monotonic()
    found = [len(r.g) for r in df.select(skip_index.grams(F.col("t")).alias("g")).collect()]
    assert found == [5, 0, 0, 0, 1]
    assert time.monotonic() - began < 30
