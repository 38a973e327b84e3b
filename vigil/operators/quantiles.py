"""Exact grouped statistics with linear-interpolated percentiles, skew-safe.

Spark's built-in ``percentile`` keeps a value->count map per group and merges
a group's maps in one task, so one hot group (a third of all rows) would be
held by one executor. This operator instead counts:

1. one row per (group, value) with its count, after a map-side partial count; the
   shuffle is by group and value, so a hot group is spread by its values and a value
   that repeats is one row;
2. counts per (group, bin), a bin being a fixed narrow range of values (``_bin``): a
   window over a group's bins, of which there are a bounded number, gives each bin's
   first rank, hence the bins that hold the wanted ranks and where in them;
3. the values of those few bins are joined back, ranked inside their bin, and the
   wanted ones are assembled.

Every step is a function of the values alone: nothing depends on how rows fall into
partitions, or on two readers sharing one exchange.

Result equals ``percentile(value, p)`` / DuckDB ``quantile_cont``:
``v[lo] + (v[hi] - v[lo]) * (p*(n-1) - lo)``.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

BINS_PER_DOUBLING = 1024  # a bin spans a factor of 2^(1/1024)
_FAR = 1100 * BINS_PER_DOUBLING  # beyond the exponents of a double


def _bin(value: Column) -> Column:
    """A bin number that never falls as the value rises: logarithmic, mirrored for negative values."""
    v = value.cast("double")
    place = F.floor(F.log2(F.abs(v)) * BINS_PER_DOUBLING) + _FAR
    return F.when(v == 0, F.lit(0)).when(v > 0, place).otherwise(-place).cast("bigint")


def grouped_percentiles(
    df: DataFrame,
    keys: Sequence[str],
    value: str,
    probs: Mapping[str, float],
    weight: str | None = None,
) -> DataFrame:
    """Per group of ``keys``: ``n``, ``sum_v``, ``min_v``, ``max_v`` and one column per prob.

    NULL values are ignored, like SQL aggregates. ``sum_v`` keeps the input type. With
    ``weight``, a row stands for that many equal ones.
    """
    keys = list(keys)
    for name, p in probs.items():
        if not 0.0 <= p <= 1.0:
            raise ValueError(f"percentile {name}={p} outside [0, 1]")
    if weight is None:
        vals = df.select(*keys, F.col(value).alias("_v")).where(F.col("_v").isNotNull())
        counted = vals.groupBy(*keys, "_v").agg(F.count(F.lit(1)).alias("_c"), F.sum("_v").alias("_s"))
    else:
        vals = df.select(*keys, F.col(value).alias("_v"), F.col(weight).alias("_w")).where(F.col("_v").isNotNull())
        counted = vals.groupBy(*keys, "_v").agg(F.sum("_w").alias("_c"), F.sum(F.col("_v") * F.col("_w")).alias("_s"))
    counted = counted.withColumn("_bin", _bin(F.col("_v")))
    bins = counted.groupBy(*keys, "_bin").agg(
        F.sum("_c").alias("_bc"), F.sum("_s").alias("_bs"), F.min("_v").alias("_lo"), F.max("_v").alias("_hi")
    )
    by_key = Window.partitionBy(*keys)
    earlier = by_key.orderBy("_bin").rowsBetween(Window.unboundedPreceding, -1)
    bins = bins.select(
        *keys, "_bin", "_bc", F.coalesce(F.sum("_bc").over(earlier), F.lit(0)).alias("_start"),
        F.sum("_bc").over(by_key).alias("_n"), F.sum("_bs").over(by_key).alias("_sum"),
        F.min("_lo").over(by_key).alias("_min"), F.max("_hi").over(by_key).alias("_max"),
    )
    # the ranks each percentile needs, kept on the bin that holds them, counted from the bin's first
    wanted = []
    for name, p in probs.items():
        pos = F.lit(float(p)) * (F.col("_n") - 1).cast("double")
        for side, rank in (("lo", F.floor(pos)), ("hi", F.ceil(pos))):
            wanted.append(F.struct(F.lit(f"{name}|{side}").alias("tag"), (rank.cast("bigint") - F.col("_start")).alias("rank")))
    inside = F.filter(F.array(*wanted), lambda w: (w["rank"] >= 0) & (w["rank"] < F.col("_bc")))
    bins = bins.withColumn("_wanted", inside).where(F.size("_wanted") > 0).drop("_start", "_bc")
    held = counted.select(*[F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)], F.col("_bin").alias("_b"), "_v", "_c")
    on = F.col("_bin") == F.col("_b")
    for i, k in enumerate(keys):
        on = on & F.col(k).eqNullSafe(F.col(f"_k{i}"))
    in_bin = Window.partitionBy(*keys, "_bin").orderBy("_v").rowsBetween(Window.unboundedPreceding, 0)
    placed = held.join(bins, on).withColumn("_upto", F.sum("_c").over(in_bin))
    hits = placed.withColumn(
        "_hit", F.filter("_wanted", lambda w: (w["rank"] < F.col("_upto")) & (w["rank"] >= F.col("_upto") - F.col("_c")))
    ).select(*keys, "_n", "_sum", "_min", "_max", "_v", F.explode("_hit.tag").alias("_tag"))
    # every non-empty group has its wanted values, so one aggregate assembles the result
    tags = [f"{name}|{side}" for name in probs for side in ("lo", "hi")]
    out = hits.groupBy(*keys).agg(
        F.max("_n").alias("n"),
        F.max("_sum").alias("sum_v"),
        F.max("_min").alias("min_v"),
        F.max("_max").alias("max_v"),
        *[F.max(F.when(F.col("_tag") == F.lit(t), F.col("_v"))).alias(t) for t in tags],
    )
    for name, p in probs.items():
        lo = F.col(f"`{name}|lo`").cast("double")
        hi = F.col(f"`{name}|hi`").cast("double")
        pos = F.lit(float(p)) * (F.col("n") - 1).cast("double")
        out = out.withColumn(name, lo + (hi - lo) * (pos - F.floor(pos)))
    return out.select(*keys, "n", "sum_v", "min_v", "max_v", *probs.keys())
