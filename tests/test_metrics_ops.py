"""A13–A17, A23 and F20–F22."""

import pytest

from helpers import metrics_df
from vigil.operators.metrics import aggregate_metrics, aggregate_metrics_windowed, filter_metrics


@pytest.fixture(scope="module")
def pts(spark):
    rows = [dict(name="requests", value=v, labels={"service": "api", "host": h}) for v, h in
            [(100, "a"), (200, "b"), (300, "a"), (400, "b")]]
    rows.append(dict(name="other", value=9, labels={"service": "api"}))
    return metrics_df(spark, rows)


def test_aggregates(pts):
    want = {"sum": 1000.0, "avg": 250.0, "min": 100.0, "max": 400.0, "count": 4.0}
    for fn, value in want.items():
        r = aggregate_metrics(pts, fn, name="requests").first()
        assert (r.value, r["count"]) == (value, 4), fn


def test_empty_and_unknown(pts):
    r = aggregate_metrics(pts, "avg", name="nothing").first()
    assert (r.value, r["count"]) == (0.0, 0)
    with pytest.raises(ValueError):
        aggregate_metrics(pts, "median")


def test_label_filter(pts):
    assert filter_metrics(pts, labels={"host": "a"}).count() == 2
    assert filter_metrics(pts, labels={"host": "a", "service": "api"}).count() == 2
    assert filter_metrics(pts, labels={"zone": "x"}).count() == 0
    assert filter_metrics(pts, name="requests", metric_type="gauge").count() == 4


def test_windowed(pts):
    rows = aggregate_metrics_windowed(pts, "sum", "1 hour", by=["name"]).collect()
    assert {r.name: r.value for r in rows} == {"requests": 1000.0, "other": 9.0}


def test_histograms_only_when_asked(spark):
    rows = [dict(name="lat", value=v, metric_type=t) for v, t in [(10, "gauge"), (20, "gauge"), (50, "histogram")]]
    pts = metrics_df(spark, rows)
    simple = aggregate_metrics(pts, "sum", name="lat").first()
    both = aggregate_metrics(pts, "sum", include_histograms=True, name="lat").first()
    assert (simple.value, simple["count"]) == (30.0, 2)
    assert (both.value, both["count"]) == (80.0, 3)  # a histogram contributes its sum (D8)
