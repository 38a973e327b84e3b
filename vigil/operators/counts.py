"""Row counts (A18), distinct traces (A19), oldest/newest (A21) and the
data-age report (M7)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vigil.functions.timefn import age_days


def entity_counts(logs: DataFrame, metrics: DataFrame, spans: DataFrame) -> DataFrame:
    """One row per entity with its row count."""
    parts = [
        df.agg(F.count(F.lit(1)).alias("row_count")).select(F.lit(name).alias("entity"), "row_count")
        for name, df in (("logs", logs), ("metrics", metrics), ("spans", spans))
    ]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


def trace_count(spans: DataFrame) -> DataFrame:
    """Number of distinct traces."""
    return spans.agg(F.count_distinct("trace_id").alias("trace_count"))


def data_age(
    sources: dict[str, tuple[DataFrame, str]],
    ttl_days: dict[str, int],
    as_of: Column | None = None,
) -> DataFrame:
    """Per data type — oldest, newest, count, oldest age in days and
    whether that age exceeds the type's TTL. ``as_of`` defaults to the newest
    event in the data so the report is reproducible; it is taken from the
    per-type rows themselves (a window over one row per data type), so the
    data is scanned once."""
    parts = []
    for name, (df, ts_col) in sources.items():
        parts.append(
            df.agg(F.min(ts_col).alias("oldest"), F.max(ts_col).alias("newest"), F.count(F.lit(1)).alias("count"))
            .select(F.lit(name).alias("data_type"), "oldest", "newest", "count",
                    F.lit(float(ttl_days[name])).alias("_ttl"))
        )
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    ref = as_of if as_of is not None else F.max("newest").over(Window.partitionBy(F.lit(0)))
    out = out.withColumn("oldest_age_days", age_days(ref, F.col("oldest")))
    return out.select(
        "data_type", "oldest", "newest", "count", "oldest_age_days",
        F.coalesce(F.col("oldest_age_days") > F.col("_ttl"), F.lit(False)).alias("exceeds_ttl"),
    )
