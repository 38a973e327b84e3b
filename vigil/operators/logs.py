"""Log operators: entity filters (F16–F19), search with order/limit/offset
(L1–L6), and the page's total count (A20)."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vigil.functions.model import level_order
from vigil.operators.predicates import Pred, where_

# ---------------------------------------------------------------------------
# FIXED VALUES — page sizes of the reference's HTTP API.
# ---------------------------------------------------------------------------
LOG_DEFAULT_LIMIT, LOG_MAX_LIMIT = 100, 1000
METRIC_DEFAULT_LIMIT, METRIC_MAX_LIMIT = 1000, 1000
TRACE_DEFAULT_LIMIT, TRACE_MAX_LIMIT = 100, 100

SORT_FIELDS = {"timestamp": "timestamp_ns", "level": None, "service": "service", "message": "message"}
# Rows without a unique id are ordered by their content after the sort key:
# rows equal on all of it are interchangeable, so pages stay deterministic.
CONTENT_TIE_BREAK = ("service", "message", "trace_id", "span_id")


def time_range(ts_ns: str, start_ns: int | None, end_ns: int | None, date_col: str | None = "dt") -> Column:
    """``[start, end)`` on the ns column, plus a ``dt`` conjunct for partition pruning.

    Catalyst cannot derive day bounds through the ns -> date expression, so the
    matching ``dt`` range is written out explicitly (inclusive on both days).
    """
    cond = F.lit(True)
    if start_ns is not None:
        cond = cond & (F.col(ts_ns) >= F.lit(start_ns))
        if date_col:
            cond = cond & (F.col(date_col) >= F.to_date(F.timestamp_micros(F.lit(start_ns // 1000))))
    if end_ns is not None:
        cond = cond & (F.col(ts_ns) < F.lit(end_ns))
        if date_col:
            cond = cond & (F.col(date_col) <= F.to_date(F.timestamp_micros(F.lit(end_ns // 1000))))
    return cond


def filter_logs(
    logs: DataFrame,
    start_ns: int | None = None,
    end_ns: int | None = None,
    level: str | None = None,
    service: str | None = None,
    message_contains: str | None = None,
) -> DataFrame:
    """The store's filter — time range, exact level, exact (case-sensitive)
    service, case-insensitive message substring."""
    cond = time_range("timestamp_ns", start_ns, end_ns, "dt" if "dt" in logs.columns else None)
    if level is not None:
        cond = cond & (F.col("level") == F.lit(level.lower()))
    if service is not None:
        cond = cond & (F.col("service") == F.lit(service))
    if message_contains is not None:
        cond = cond & F.lower(F.col("message")).contains(F.lower(F.lit(message_contains)))
    return logs.where(cond)


@dataclass(frozen=True)
class OrderBy:
    field: str = "timestamp"
    descending: bool = True  # D26: the default direction is DESC

    def columns(self, tie_break: tuple[str, ...] = ("log_id",)) -> list[Column]:
        field = self.field.lower()
        if field not in SORT_FIELDS:
            raise ValueError(f"cannot order logs by {self.field!r}; sortable: {sorted(SORT_FIELDS)}")
        key = level_order("level") if field == "level" else F.col(SORT_FIELDS[field])
        primary = key.desc() if self.descending else key.asc()
        # A tie-break keeps pages deterministic.
        return [primary, *[F.col(c).asc_nulls_first() for c in tie_break]]


def tie_break_for(logs: DataFrame) -> tuple[str, ...]:
    return ("log_id",) if "log_id" in logs.columns else CONTENT_TIE_BREAK


def effective_limit(limit: int | None, default: int, maximum: int) -> int:
    """The route's page size rule — default when absent, capped at ``maximum``."""
    if limit is None:
        return default
    if limit < 0:
        raise ValueError("limit must be non-negative")
    return min(limit, maximum)


def order_logs(logs: DataFrame, order: OrderBy | None = None) -> DataFrame:
    """L1–L3: a total order over the logs frame."""
    return logs.orderBy(*(order or OrderBy()).columns(tie_break_for(logs)))


def search_logs(
    logs: DataFrame,
    where: Pred | None = None,
    order: OrderBy | None = None,
    limit: int | None = None,
    offset: int | None = None,
) -> DataFrame:
    """The SQL-like log query: WHERE, ORDER BY (default timestamp DESC), OFFSET, LIMIT.

    Filters the whole table (D3). ``limit`` keeps the top-k plan
    (TakeOrderedAndProject); a deep ``offset`` needs a global sort.
    """
    out = order_logs(where_(logs, where), order)
    if offset:
        out = out.offset(offset)
    if limit is not None:
        out = out.limit(limit)
    return out


def search_after(
    logs: DataFrame,
    where: Pred | None = None,
    after: tuple[int, int] | None = None,
    limit: int = LOG_DEFAULT_LIMIT,
) -> DataFrame:
    """Key-set paging in the default order (newest first, ``log_id`` tie-break).

    ``after`` is the ``(timestamp_ns, log_id)`` of the last row of the previous
    page. Unlike a deep OFFSET (a global sort that ranks every skipped row),
    each page is a range filter on the time column — prunable at the scan and
    by ``dt`` — followed by a bounded top-k.
    """
    if "log_id" not in logs.columns:
        raise ValueError("key-set paging needs a unique log_id column")
    out = where_(logs, where)
    if after is not None:
        ts, lid = after
        out = out.where(
            (F.col("timestamp_ns") < F.lit(ts)) | ((F.col("timestamp_ns") == F.lit(ts)) & (F.col("log_id") > F.lit(lid)))
        )
        if "dt" in logs.columns:
            out = out.where(F.col("dt") <= F.to_date(F.timestamp_micros(F.lit(ts // 1000))))
    return out.orderBy(*OrderBy().columns()).limit(limit)


def total_count(logs: DataFrame, where: Pred | None = None) -> DataFrame:
    """Matching rows before limit/offset (one-row frame ``total_count``)."""
    return where_(logs, where).agg(F.count(F.lit(1)).alias("total_count"))


def page(
    df: DataFrame,
    order: list[Column],
    limit: int | None,
    offset: int | None,
    default_limit: int = LOG_DEFAULT_LIMIT,
    max_limit: int = LOG_MAX_LIMIT,
) -> DataFrame:
    """Order, skip ``offset`` rows and return at most the capped page size."""
    out = df.orderBy(*order)
    if offset:
        out = out.offset(offset)
    return out.limit(effective_limit(limit, default_limit, max_limit))
