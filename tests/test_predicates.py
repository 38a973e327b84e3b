"""Predicate semantics, after the reference executor's unit tests."""

import pytest

from helpers import BASE_NS, logs_df
from vigil.operators.logs import OrderBy, search_logs, total_count
from vigil.operators.predicates import And, Cond, Or, compile_predicate, parse_rfc3339_ns


@pytest.fixture(scope="module")
def five(spark):
    rows = [
        dict(level="info", message="Info message", service="api", attributes={"user_id": 42, "path": "/home", "ok": True, "ratio": 0.5}),
        dict(level="error", message="Error occurred", service="api", attributes={"user_id": 7, "ratio": 2}, trace_id="t1", span_id="s1"),
        dict(level="debug", message="Debug message", service="auth-service", attributes={"path": "/Login"}),
        dict(level="error", message="Database connection failed", service="db-service", attributes={"ok": False}),
        dict(level="warn", message="High memory usage", service="api", attributes={"user_id": 1.5}),
    ]
    return logs_df(spark, rows)


def ids(df, pred):
    return sorted(r.log_id for r in df.where(compile_predicate(pred)).collect())


def test_level_equals(five):
    assert ids(five, Cond("level", "=", "error")) == [1, 3]
    assert ids(five, Cond("LEVEL", "=", "ERROR")) == [1, 3]


def test_level_order(five):
    assert ids(five, Cond("level", ">=", "warn")) == [1, 3, 4]
    assert ids(five, Cond("level", "<", "info")) == [2]
    assert ids(five, Cond("level", ">", "nonsense")) == []
    assert ids(five, Cond("level", "=", 3)) == []


def test_string_fields_case(five):
    assert ids(five, Cond("service", "=", "API")) == [0, 1, 4]
    assert ids(five, Cond("service", "!=", "API")) == [2, 3]
    assert ids(five, Cond("message", "contains", "MESSAGE")) == [0, 2]
    assert ids(five, Cond("message", "starts_with", "data")) == [3]
    assert ids(five, Cond("message", "ends_with", "USAGE")) == [4]
    # ordering is case-sensitive code-point order
    assert ids(five, Cond("service", ">", "b")) == [3]
    assert ids(five, Cond("service", "<", "B")) == []
    # a number literal against a string field is FALSE, even for !=
    assert ids(five, Cond("service", "!=", 5)) == []


def test_missing_ids(five):
    assert ids(five, Cond("trace_id", "=", "T1")) == [1]
    assert ids(five, Cond("trace_id", "!=", "t1")) == [0, 2, 3, 4]
    # missing trace_id matches any operator when the literal is ''
    assert ids(five, Cond("trace_id", "contains", "")) == [0, 1, 2, 3, 4]
    assert ids(five, Cond("span_id", ">", "")) == [0, 1, 2, 3, 4]
    assert ids(five, Cond("span_id", ">", "a")) == [1]


def test_attributes_typed(five):
    assert ids(five, Cond("user_id", "=", 42)) == [0]
    assert ids(five, Cond("user_id", ">", 5)) == [0, 1]
    # integer literal vs float attribute -> FALSE; float literal vs int attribute compares as f64
    assert ids(five, Cond("user_id", "<", 2)) == []
    assert ids(five, Cond("user_id", "<", 2.0)) == [4]
    assert ids(five, Cond("ratio", "=", 0.5)) == [0]
    assert ids(five, Cond("ratio", "!=", 0.5)) == [1, 2, 3, 4]
    assert ids(five, Cond("ok", "=", True)) == [0]
    assert ids(five, Cond("ok", "!=", True)) == [1, 2, 3, 4]
    assert ids(five, Cond("ok", ">", True)) == []
    assert ids(five, Cond("path", "=", "/login")) == [2]
    assert ids(five, Cond("path", "contains", "HOM")) == [0]
    # key lookup is case-sensitive
    assert ids(five, Cond("PATH", "=", "/home")) == []
    # missing attribute: != TRUE, others FALSE; type mismatch FALSE even for !=
    assert ids(five, Cond("missing", "!=", "x")) == [0, 1, 2, 3, 4]
    assert ids(five, Cond("missing", "=", "x")) == []
    assert ids(five, Cond("path", "!=", 3)) == [1, 3, 4]


def test_timestamp(five):
    t2 = BASE_NS + 2_000_000_000
    iso = "2023-11-14T22:13:22Z"  # BASE_NS + 2 s
    assert parse_rfc3339_ns(iso) == t2
    assert ids(five, Cond("timestamp", ">=", iso)) == [2, 3, 4]
    assert ids(five, Cond("timestamp", "<", (BASE_NS // 10**9) + 1)) == [0]
    assert ids(five, Cond("timestamp", "=", "not a time")) == []
    assert ids(five, Cond("timestamp", "contains", iso)) == []
    assert parse_rfc3339_ns("2023-11-14T22:13:22.5+01:00") == t2 - 3600 * 10**9 + 500_000_000


def test_and_or_grouping(five):
    pred = And(Or(Cond("level", "=", "error"), Cond("level", "=", "warn")), Cond("service", "=", "api"))
    assert ids(five, pred) == [1, 4]
    assert ids(five, Cond("level", "=", "error") | Cond("service", "=", "api") & Cond("level", "=", "info")) == [0, 1, 3]


def test_search_order_limit_total(five):
    page = search_logs(five, Cond("service", "=", "api"), OrderBy("timestamp"), limit=2)
    assert [r.log_id for r in page.collect()] == [4, 1]
    page = search_logs(five, None, OrderBy("level", descending=False), limit=3, offset=1)
    assert [r.log_id for r in page.collect()] == [0, 4, 1]
    assert total_count(five, Cond("level", "=", "error")).first().total_count == 2
    with pytest.raises(ValueError):
        OrderBy("nope").columns()
    with pytest.raises(ValueError):
        Cond("level", "~", "x")


def test_search_after_matches_offset_pages(spark):
    from vigil.operators.logs import search_after
    from vigil.sources import views

    logs = views.logs(spark, "/root/testdata/sf0.001")
    pred = Cond("level", ">=", "info")
    offset_ids = [r.log_id for r in search_logs(logs, pred, limit=60).collect()]
    pages, after = [], None
    for _ in range(3):
        page = search_after(logs, pred, after, limit=20).collect()
        pages += [r.log_id for r in page]
        after = (page[-1].timestamp_ns, page[-1].log_id)
    assert pages == offset_ids


def test_page_caps(five):
    from pyspark.sql import functions as F

    from vigil.operators.logs import LOG_MAX_LIMIT, TRACE_DEFAULT_LIMIT, TRACE_MAX_LIMIT, effective_limit, page

    assert effective_limit(None, 100, 1000) == 100
    assert effective_limit(5000, 100, LOG_MAX_LIMIT) == 1000
    assert effective_limit(50, TRACE_DEFAULT_LIMIT, TRACE_MAX_LIMIT) == 50
    with pytest.raises(ValueError):
        effective_limit(-1, 100, 1000)
    got = [r.log_id for r in page(five, [F.col("log_id").desc()], limit=2, offset=1).collect()]
    assert got == [3, 2]


def test_search_on_stored_otlp_logs(spark, tmp_dir):
    """Stored logs carry no log_id / level_order: search still works and is deterministic."""
    import json as _json
    import os

    from vigil.sources import otlp
    from vigil.sources.sinks import read_stored, write_table

    recs = [{"timeUnixNano": str(BASE_NS + (i // 2) * 10**9), "severityNumber": 17 if i % 3 else 9,
             "body": {"stringValue": f"disk timeout {i}"}} for i in range(12)]
    req = {"resourceLogs": [{"resource": {"attributes": [{"key": "service.name", "value": {"stringValue": "db"}}]},
                             "scopeLogs": [{"scope": {"name": "x"}, "logRecords": recs}]}]}
    os.makedirs(f"{tmp_dir}/in")
    with open(f"{tmp_dir}/in/r.json", "w") as fh:
        _json.dump(req, fh)
    valid, _ = otlp.ingest_otlp_logs(spark, f"{tmp_dir}/in")
    write_table(valid, f"{tmp_dir}/logs", "logs")
    stored = read_stored(spark, f"{tmp_dir}/logs", "logs")
    pred = Cond("level", ">=", "warn") & Cond("message", "contains", "TIMEOUT")
    first = [r.message for r in search_logs(stored, pred, OrderBy("level"), limit=5).collect()]
    again = [r.message for r in search_logs(stored, pred, OrderBy("level"), limit=5).collect()]
    assert first == again and len(first) == 5
    assert all(int(m.split()[-1]) % 3 for m in first)  # only the error-severity records


@pytest.mark.parametrize("value,after", [
    (1704067200000, True), (-1704067200000, False), ("9999-01-01T00:00:00Z", True), ("0001-01-01T00:00:00Z", False), (8210266876799, True),
])
def test_times_beyond_every_row_compare_like_any_other(spark, value, after):
    df = logs_df(spark, [{"message": "m", "service": "s"}])
    want = {"<": after, "<=": after, ">": not after, ">=": not after, "=": False, "!=": True, "contains": False}
    for op, holds in want.items():
        assert search_logs(df, Cond("timestamp", op, value)).count() == int(holds), op


@pytest.mark.parametrize("value", [8210266876800, -8334601228801, 2**63])
def test_seconds_that_are_no_date_match_nothing(spark, value):
    df = logs_df(spark, [{"message": "m", "service": "s"}])
    assert all(search_logs(df, Cond("timestamp", op, value)).count() == 0 for op in ("<", "<=", ">", ">=", "=", "!="))
