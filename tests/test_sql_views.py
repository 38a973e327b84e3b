"""The reference's documented queries as Spark SQL over registered views."""

from vigil.plans.sql import register_views

SF = "/root/testdata/sf0.001"


def test_documented_queries_run(spark):
    names = register_views(spark, SF)
    assert {"logs", "metrics", "spans", "metrics_1min", "logs_1day_counts", "traces_1hour_stats"} <= set(names)
    q = {
        "tier": "SELECT * FROM metrics_1day WHERE name = 'purchase' LIMIT 30",
        "errors": "SELECT timestamp, level, service, normalized_message, count, sample_message FROM logs_1hour_counts "
                  "WHERE level = 'error' ORDER BY count DESC LIMIT 100",
        "patterns": "SELECT normalized_message, sum(count) AS occurrences, min(sample_message) AS example "
                    "FROM logs_1day_counts WHERE level = 'error' GROUP BY normalized_message "
                    "ORDER BY occurrences DESC LIMIT 10",
        "perf": "SELECT timestamp, service, operation, avg_duration_ns / 1000000 AS avg_ms, "
                "p95_duration_ns / 1000000 AS p95_ms, span_count FROM spans_1hour_stats ORDER BY timestamp DESC LIMIT 100",
        "complexity": "SELECT service, sum(unique_traces) AS total_traces, "
                      "sum(total_spans) / sum(unique_traces) AS avg_complexity FROM traces_1day_stats GROUP BY service",
        "udf": "SELECT normalize_log_message(message) AS p, count(*) AS n FROM logs GROUP BY 1",
        "star": "SELECT * FROM logs WHERE lower(service) = 'svc-1' ORDER BY timestamp_ns DESC LIMIT 5",
    }
    for name, text in q.items():
        assert spark.sql(text).count() > 0, name
    total = spark.sql("SELECT sum(count) AS n FROM logs_1day_counts").first().n
    assert total == spark.sql("SELECT count(*) AS n FROM logs").first().n
