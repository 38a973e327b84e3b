"""Reads over any time range, stitched from the tiers: whole buckets of the coarsest tier that has them, finer tiers at
the edges, raw rows for what is less than the finest bucket and for the end that no tier has closed yet.

A range of a year that begins and ends off the borders reads about 365 day buckets, at most
23 hours, 11 five-minutes and 4 minutes of buckets at each edge, and less than a minute of
raw rows there, in place of a year of points. Each source is filtered by its own time
column and by ``dt``, so stored tiers are pruned by day.
"""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vigil.functions.timefn import ns_to_ts
from vigil.operators.states import STATES
from vigil.plans.tiers import TIER_SECONDS

RAW = "raw"
NS = 1_000_000_000


@dataclass(frozen=True)
class Segment:
    source: str  # a tier, or raw
    start_ns: int
    end_ns: int


def stitch(start_ns: int, end_ns: int, tiers: list[str], closed_ns: int | None = None, oldest_ns: Mapping[str, int] | None = None) -> list[Segment]:
    """The segments of ``[start, end)`` in order, from the given tiers and raw rows.

    ``closed_ns``: buckets that end later are not complete in any tier. ``oldest_ns``: the
    time from which a source still has rows (retention); buckets before it are not read
    from it, and raw rows are the last resort.
    """
    oldest = dict(oldest_ns or {})
    ordered = sorted(tiers, key=lambda t: -TIER_SECONDS[t])

    def cover(lo: int, hi: int, level: int) -> list[Segment]:
        if lo >= hi:
            return []
        for i in range(level, len(ordered)):
            width = TIER_SECONDS[ordered[i]] * NS
            first = -(-max(lo, oldest.get(ordered[i], lo)) // width) * width
            last = (hi if closed_ns is None else min(hi, closed_ns)) // width * width
            if first < last:
                return [*cover(lo, first, i + 1), Segment(ordered[i], first, last), *cover(last, hi, i + 1)]
        return [Segment(RAW, lo, hi)]

    return cover(start_ns, end_ns, 0)


def _part(df: DataFrame, segment: Segment) -> DataFrame:
    """The rows of a source in a segment, with the days that prune its partitions."""
    time = ("timestamp_ns" if "timestamp_ns" in df.columns else "start_ns") if segment.source == RAW else "timestamp"
    lo, hi = F.lit(segment.start_ns), F.lit(segment.end_ns)
    if segment.source != RAW:
        lo, hi = ns_to_ts(lo), ns_to_ts(hi)
    rows = df.where((F.col(time) >= lo) & (F.col(time) < hi))
    if "dt" in df.columns:
        rows = rows.where(F.col("dt").between(F.to_date(ns_to_ts(F.lit(segment.start_ns))), F.to_date(ns_to_ts(F.lit(segment.end_ns - 1)))))
    return rows


def read_range(
    kind: str, raw: DataFrame, tiers: Mapping[str, DataFrame], start_ns: int, end_ns: int, bucket: str = "1day",
    closed_ns: int | None = None, oldest_ns: Mapping[str, int] | None = None, state: int = 0,
) -> DataFrame:
    """The state rows of a kind (``STATES[kind][state]``) in ``[start, end)``, by ``bucket``; equal to those of the raw rows.

    ``tiers`` are state rows by tier: for metrics and logs the stored tiers themselves, for
    spans the partial rows. Only tiers no coarser than ``bucket`` can be read. With
    ``finish`` of the state, or a further aggregate over ``timestamp``, the rows become a report.
    """
    kept = STATES[kind][state]
    fitting = [t for t in tiers if TIER_SECONDS[t] <= TIER_SECONDS[bucket]]
    parts = []
    for segment in stitch(start_ns, end_ns, fitting, closed_ns, oldest_ns):
        if segment.source == RAW:
            part = kept.rows(_part(raw, segment), bucket)
        else:
            part = _part(tiers[segment.source], segment)
        parts.append(part.drop("dt"))
    if not parts:
        return kept.merge(kept.rows(raw.limit(0), bucket), bucket)
    whole = parts[0]
    for part in parts[1:]:
        whole = whole.unionByName(part)
    return kept.merge(whole, bucket)
