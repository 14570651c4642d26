"""The state of an alert: ok, pending, firing, resolved."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

OK, PENDING, FIRING, RESOLVED = "ok", "pending", "firing", "resolved"


def following(state: Column, holds: Column, active_ms: Column, now_ms: Column, for_ms: Column) -> Column:
    """The state after an evaluation. ``active_ms``: since when the condition has held (null: not until now)."""
    waiting = F.when(now_ms - active_ms >= for_ms, FIRING).otherwise(PENDING)
    return (
        F.when(~holds, F.when(state.isin(PENDING, FIRING), RESOLVED).otherwise(OK))
        .when(state == FIRING, FIRING)
        .when(state == PENDING, waiting)
        .otherwise(F.when(for_ms <= 0, FIRING).otherwise(PENDING))
    )
