"""Pages far from the start, without sorting what comes before them.

Rows are counted by time slice (a day, then an hour of it); the counts, at most a few tens
of thousands of numbers, tell which slices hold the page. Only those slices are read again,
with ``dt`` and time bounds that reach the scan, sorted, and cut with the offset that is
left. A global sort would rank every skipped row.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vigil.operators.logs import OrderBy, order_logs
from vigil.operators.predicates import Pred, where_

HOUR_NS = 3_600_000_000_000


def _holding(counts: list[tuple[int, int]], offset: int, limit: int) -> tuple[list[int], int]:
    """The slices, in page order, that hold rows ``[offset, offset + limit)``, and the rows of the first before the page."""
    chosen, before, skipped = [], 0, offset
    for at, n in counts:
        if before + n > offset and before < offset + limit:
            if not chosen:
                skipped = offset - before
            chosen.append(at)
        before += n
        if before >= offset + limit:
            break
    return chosen, skipped


def page_at(
    logs: DataFrame, offset: int, limit: int, where: Pred | None = None, descending: bool = True,
    counts: DataFrame | None = None,
) -> DataFrame:
    """Rows ``[offset, offset + limit)`` in time order, as ``search_logs`` with that offset gives them.

    ``counts`` (``timestamp``, ``count``: hourly, such as a stored hour tier) spares the
    counting scan where there is no predicate. Without it, rows that pass ``where`` are
    counted by hour, which reads the time column and what the predicate needs.
    """
    if offset < 0 or limit < 0:
        raise ValueError("offset and limit must not be negative")
    matching = where_(logs, where)
    if counts is None or where is not None:
        hour = F.call_function("div", F.col("timestamp_ns") - F.pmod(F.col("timestamp_ns"), F.lit(HOUR_NS)), F.lit(HOUR_NS))
        counted = matching.groupBy(hour.alias("hour")).agg(F.count(F.lit(1)).alias("n"))
    else:
        hour = F.call_function("div", F.unix_micros("timestamp"), F.lit(HOUR_NS // 1000))
        counted = counts.groupBy(hour.alias("hour")).agg(F.sum("count").alias("n"))
    # one number for each hour that has rows
    slices = sorted(((r["hour"], r["n"]) for r in counted.collect()), reverse=descending)
    hours, skipped = _holding(slices, offset, limit)
    if not hours or not limit:
        return order_logs(matching, OrderBy("timestamp", descending)).limit(0)
    lo, hi = min(hours) * HOUR_NS, (max(hours) + 1) * HOUR_NS
    rows = matching.where((F.col("timestamp_ns") >= F.lit(lo)) & (F.col("timestamp_ns") < F.lit(hi)))
    if "dt" in logs.columns:
        rows = rows.where(F.col("dt").between(F.to_date(F.timestamp_micros(F.lit(lo // 1000))), F.to_date(F.timestamp_micros(F.lit(hi // 1000 - 1)))))
    return order_logs(rows, OrderBy("timestamp", descending)).offset(skipped).limit(limit)
