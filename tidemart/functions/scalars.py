"""Column expressions shared by the plans. All stay inside whole-stage codegen."""

from __future__ import annotations

import datetime as dt
from collections.abc import Mapping

from pyspark.sql import Column
from pyspark.sql import functions as F

DateLike = dt.date | Column


def as_date(value: DateLike) -> Column:
    """A date literal, or the given column (for example a scalar subquery)."""
    return value if isinstance(value, Column) else F.lit(value)


def col(value: str | Column) -> Column:
    return F.col(value) if isinstance(value, str) else value


def money(value: str | Column) -> Column:
    return col(value).cast("decimal(12,2)")


def hours_between(earlier: str | Column, later: str | Column) -> Column:
    """Whole hours between two dates taken at midnight."""
    return F.timestamp_diff("HOUR", col(earlier).cast("timestamp"), col(later).cast("timestamp"))


def safe_divide(numerator: str | Column, denominator: str | Column) -> Column:
    """NULL when the denominator is zero (ANSI ``/`` would raise)."""
    return F.try_divide(col(numerator), col(denominator))


def is_weekend(day: str | Column) -> Column:
    return F.dayofweek(col(day)).isin(1, 7)


def in_trailing_window(day: str | Column, end: DateLike, days: int) -> Column:
    """True on the half-open range (end - days, end]."""
    d, stop = col(day), as_date(end)
    return (d > F.date_sub(stop, days)) & (d <= stop)


def in_forward_window(day: str | Column, start: str | Column, days: int) -> Column:
    """True on (start, start + days]; a NULL day gives false, never NULL."""
    d, begin = col(day), col(start)
    return F.coalesce((d > begin) & (d <= F.date_add(begin, days)), F.lit(False))


def eligible_at(signup: str | Column, churn: str | Column, snapshot: DateLike) -> Column:
    """Signed up by the snapshot and not churned at it."""
    s = as_date(snapshot)
    return (col(signup) <= s) & (col(churn).isNull() | (col(churn) > s))


def date_range(start: DateLike, stop: DateLike, step_days: int = 1) -> Column:
    """Array of dates with inclusive end; empty, not reversed, when stop < start."""
    a, b = as_date(start), as_date(stop)
    dates = F.sequence(a, b, F.expr(f"interval {int(step_days)} days"))
    return F.when(a <= b, dates).otherwise(F.array().cast("array<date>"))


# Probability cuts of the risk tiers.
RISK_TIERS = {"high": 0.6, "medium": 0.3}


def risk_tier(probability: str | Column) -> Column:
    p = col(probability)
    return (
        F.when(p >= RISK_TIERS["high"], "high").when(p >= RISK_TIERS["medium"], "medium").otherwise("low")
    )


def lookup(mapping: Mapping[str, float], key: str | Column) -> Column:
    """Value of a small fixed map, NULL for a missing key."""
    entries = [F.lit(part) for pair in mapping.items() for part in pair]
    return F.try_element_at(F.create_map(*entries), col(key))


def clip_at_zero(value: str | Column) -> Column:
    return F.greatest(col(value), F.lit(0.0))


def nan_to_null(value: str | Column) -> Column:
    return F.when(~F.isnan(col(value)), col(value))


def iso_date(day: str | Column) -> Column:
    return F.date_format(col(day), "yyyy-MM-dd")


def rounded(value: str | Column, digits: int) -> Column:
    """HALF_UP rounding, returned as double so every engine prints it alike."""
    return F.round(col(value), digits).cast("double")
