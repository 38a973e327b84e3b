"""Time helpers.

Nanosecond epoch BIGINT is the truth; TIMESTAMP (µs) is derived for bucketing.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

NS_PER_MS = 1_000_000
NS_PER_SECOND = 1_000_000_000
SECONDS_PER_DAY = 86_400

# An RFC 3339 time: date, time of day with seconds, and an offset; nothing may be left out.
RFC3339 = r"^\d{4}-\d{2}-\d{2}[Tt ]\d{2}:\d{2}:\d{2}(\.\d+)?([Zz]|[+-]\d{2}:\d{2})$"

# Rollup tiers: name -> (bucket kind, width). 5 minutes uses a tumbling window.
TIERS = {
    "1min": "minute",
    "5min": "5 minutes",
    "1hour": "hour",
    "1day": "day",
}


def _c(col: Column | str) -> Column:
    return F.col(col) if isinstance(col, str) else col


def _div(col: Column, by: int) -> Column:
    """Integer division towards zero; ``/`` would go through DOUBLE and lose digits beyond 2^53."""
    return F.call_function("div", col, F.lit(by).cast("bigint"))


def ns_to_ts(ns: Column | str) -> Column:
    """Epoch nanoseconds -> TIMESTAMP (the microsecond the instant lies in)."""
    c = _c(ns)
    return F.timestamp_micros(_div(c - F.pmod(c, F.lit(1000)), 1000))


def ts_to_ns(ts: Column | str) -> Column:
    """TIMESTAMP or TIMESTAMP_NTZ -> epoch nanoseconds (UTC session)."""
    return F.unix_micros(_c(ts).cast("timestamp")) * F.lit(1000)


def bucket_start(ts: Column | str, tier: str) -> Column:
    """Start of the tier bucket containing ``ts`` (UTC)."""
    unit = TIERS.get(tier, tier)
    if unit in ("minute", "hour", "day"):
        return F.date_trunc(unit, _c(ts))
    # Fixed-width buckets aligned to the epoch, like toStartOfFiveMinutes.
    return F.window(_c(ts), unit).start


def ns_to_ms(ns: Column | str) -> Column:
    """Whole milliseconds, truncated toward zero."""
    return _div(_c(ns), NS_PER_MS)


def age_days(as_of: Column, oldest: Column) -> Column:
    """The whole seconds of ``as_of - oldest`` (truncated) divided by 86400."""
    micros = F.unix_micros(as_of) - F.unix_micros(oldest)
    return _div(micros, 1_000_000).cast("double") / F.lit(float(SECONDS_PER_DAY))
