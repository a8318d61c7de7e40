"""Small column helpers shared by the operators."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

DAY = 86_400


def col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def nz(c: Column | str) -> Column:
    """Null counts as zero."""
    return F.coalesce(col(c), F.lit(0))


def clamp(c: Column, low: float, high: float) -> Column:
    return F.least(F.greatest(c, F.lit(low)), F.lit(high))


def pct_change(now: Column | str, before: Column | str) -> Column:
    """Relative change in percent, null when the base is zero or missing."""
    return (F.try_divide(col(now), col(before)) - 1.0) * 100.0


def epoch(ts: Column | str) -> Column:
    """Whole epoch seconds of a timestamp with or without time zone."""
    return F.unix_timestamp(col(ts).cast("timestamp"))


def at(seconds: Column) -> Column:
    """Zone-less timestamp from epoch seconds (session zone is UTC)."""
    return F.timestamp_seconds(seconds).cast("timestamp_ntz")


def ntz(text: str) -> Column:
    return F.lit(text).cast("timestamp_ntz")


def epoch_any(n: Column | str) -> Column:
    """Vendors send seconds or milliseconds; anything above 1e10 is milliseconds."""
    return F.when(col(n) > 1e10, F.floor(col(n) / 1000)).otherwise(F.floor(col(n)))


def minutes_between(later: Column, earlier: Column) -> Column:
    return (epoch(later) - epoch(earlier)) / 60.0


def hours_between(later: Column, earlier: Column) -> Column:
    return (epoch(later) - epoch(earlier)) / 3600.0


def when_first(*cases: tuple[Column, object], default: object = None) -> Column:
    """CASE WHEN over (condition, value) pairs; values may be plain literals."""
    out = None
    for cond, val in cases:
        v = val if isinstance(val, Column) else F.lit(val)
        out = F.when(cond, v) if out is None else out.when(cond, v)
    return out if default is None else out.otherwise(default if isinstance(default, Column) else F.lit(default))


def cents(x: Column) -> Column:
    """To whole cents, halves up, by plain arithmetic: the same in any engine."""
    return F.floor(x * 100.0 + 0.5) / 100.0
