"""Choosing a metric rollup tier for a query range (§4 pre-aggregation).

The reference leaves the tier to the user; ``pick_tier`` picks the coarsest
tier whose bucket still resolves the requested step and whose retention
still covers the start of the range, falling back to raw points.
"""

from __future__ import annotations

from vigil.operators.rollups import ROLLUP_RETENTION_DAYS

TIER_SECONDS = {"1min": 60, "5min": 300, "1hour": 3600, "1day": 86_400}


def pick_tier(range_start_age_days: float, step_seconds: int) -> str:
    """Return ``'raw'`` or a tier name (``'1min'`` … ``'1day'``)."""
    if step_seconds <= 0:
        raise ValueError("step_seconds must be positive")
    best = "raw"
    for tier, width in TIER_SECONDS.items():
        if width <= step_seconds and range_start_age_days <= ROLLUP_RETENTION_DAYS[f"metrics_{tier}"]:
            best = tier
    return best
