"""M8: a dictionary of messages and their patterns, by version of the rules.

Distinct messages are far fewer than log rows, and most stay when the rules change. The
dictionary keeps the pattern of every message met so far under the version of the rules
that made it (``version=…`` partitions); after a change only distinct messages are
normalised, once each, and the log tiers are rebuilt from counts by message joined to it.
Batches add just the messages that the version lacks.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from vigil.functions.normalize import NORMALIZATION_RULES, normalize_message
from vigil.functions.timefn import bucket_start
from vigil.operators.rollups import overwrite_days


def rules_version() -> str:
    """Names the rules in force: it changes when they do."""
    return hashlib.md5(repr(NORMALIZATION_RULES).encode()).hexdigest()[:12]


def message_counts(logs: DataFrame, tier: str) -> DataFrame:
    """Rows per bucket, level, service and message: what log tiers of any rules follow from."""
    return logs.groupBy(bucket_start("ts", tier).alias("timestamp"), "level", "service", "message").agg(F.count(F.lit(1)).alias("count"))


def counts_by_pattern(counts: DataFrame, dictionary: DataFrame) -> DataFrame:
    """A5/A6 from message counts and the dictionary (``message``, ``normalized_message``) of the rules wanted.

    Copies of a message in a bucket are one row here, so a frequent message joins as often
    as it has buckets, levels and services.
    """
    joined = counts.join(dictionary.select("message", "normalized_message"), "message")
    return joined.groupBy("timestamp", "level", "service", "normalized_message").agg(
        F.sum("count").alias("count"), F.min("message").alias("sample_message")
    )


def _stored(spark: SparkSession, path: str) -> DataFrame:
    """The dictionary so far; empty before the first update."""
    from vigil.streaming.folding import Files

    if not Files(spark, path).names(path):
        return spark.createDataFrame([], "message string, normalized_message string, version string")
    return spark.read.schema("message string, normalized_message string, version string").parquet(path)


def update(
    logs: DataFrame, path: str, version: str | None = None, normalise: Callable[[Column], Column] | None = None
) -> DataFrame:
    """Add the messages of ``logs`` that the version lacks; returns the version's dictionary.

    Only distinct messages meet the rules. A repeated update adds nothing; one that failed
    half way adds what is missing.
    """
    spark, version = logs.sparkSession, version or rules_version()
    known = _stored(spark, path).where(F.col("version") == version).select("message")
    missing = logs.select("message").where(F.col("message").isNotNull()).distinct().join(known, "message", "left_anti")
    fresh = missing.withColumn("normalized_message", (normalise or normalize_message)(F.col("message")))
    fresh.withColumn("version", F.lit(version)).hint("rebalance").write.mode("append").partitionBy("version").parquet(path)
    return _stored(spark, path).where(F.col("version") == version)


def rebuild_log_tiers(
    logs: DataFrame, path: str, out_root: str, tiers=("1hour", "1day"), version: str | None = None,
    normalise: Callable[[Column], Column] | None = None,
) -> None:
    """After a rule change: the days of ``logs`` in both log tiers, from the dictionary."""
    dictionary = update(logs, path, version, normalise)
    for tier in tiers:
        table = counts_by_pattern(message_counts(logs, tier), dictionary).withColumn("dt", F.to_date("timestamp"))
        overwrite_days(table, f"{out_root.rstrip('/')}/logs_{tier}_counts")
