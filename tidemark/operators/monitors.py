"""Stateful monitors over ordered checks: crossings, run lengths, bands, drops and alert cooldowns.

Inputs with many rows per key carry a slice column (see ``sliced``), so that no task gets all checks of a key.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidemark.operators import sliced
from tidemark.operators.cooldowns import cooldown

__all__ = ["cooldown", "cross_events", "hysteresis", "rolling_drop", "run_counters", "sustained_below"]


def cross_events(checks: DataFrame, keys: list[str], order: list[str], above: str = "above") -> DataFrame:
    """Checks whose side of the average differs from the previous check; the first check never alerts."""
    seen = sliced.previous(checks, keys, order, above, "was_above")
    event = (F.when(F.col(above) & ~F.col("was_above"), "breakout")
             .when(~F.col(above) & F.col("was_above"), "breakdown"))
    return seen.withColumn("event", event).filter(F.col("event").isNotNull())


def run_counters(checks: DataFrame, keys: list[str], order: list[str], above: str = "above") -> DataFrame:
    """Consecutive checks above / below the average, up to and including each check."""
    numbered = checks.withColumn("_r", F.row_number().over(sliced.in_slice(checks, keys, order)).cast("bigint"))
    up, down = F.when(F.col(above), F.col("_r")), F.when(~F.col(above), F.col("_r"))

    def scan(per, before):
        base = per.withColumn("_base", F.coalesce(F.sum("_n").over(before), F.lit(0)))
        return (base.withColumn("_up0", F.last(F.col("_base") + F.col("_last_up"), ignorenulls=True).over(before))
                .withColumn("_down0", F.last(F.col("_base") + F.col("_last_down"), ignorenulls=True).over(before)))

    rows = sliced.inherit(numbered, keys, {"_n": F.count(F.lit(1)), "_last_up": F.max(up), "_last_down": F.max(down)},
                          scan, ["_base", "_up0", "_down0"])
    so_far = sliced.in_slice(checks, keys, order).rowsBetween(W.unboundedPreceding, 0)
    base, zero = F.coalesce(F.col("_base"), F.lit(0)), F.lit(0)
    last_down = F.coalesce(base + F.max(down).over(so_far), F.col("_down0"), zero)
    last_up = F.coalesce(base + F.max(up).over(so_far), F.col("_up0"), zero)
    idx = base + F.col("_r")
    return (rows.withColumns({"idx": idx, "above_count": idx - last_down, "below_count": idx - last_up})
            .drop("_r", "_base", "_up0", "_down0"))


def sustained_below(checks: DataFrame, keys: list[str], order: list[str], above: str = "above") -> DataFrame:
    """Run counters plus a flag on checks that want an alert: below, and either just crossed or below before.

    A first check below has no earlier check to have crossed from and is no candidate. Feed the flagged
    rows to ``cooldown`` for the alerts that are sent.
    """
    runs = run_counters(checks, keys, order, above)
    crossed = (F.col("below_count") == 1) & (F.col("idx") > 1)
    return runs.withColumn("wants_alert", ~F.col(above) & (crossed | (F.col("below_count") >= 2)))


def hysteresis(checks: DataFrame, keys: list[str], order: list[str], value: str, low: Column, high: Column) -> DataFrame:
    """Alert on entering the low or the high band; the middle re-arms both."""
    zone = F.when(F.col(value) < low, "below_low").when(F.col(value) > high, "above_high").otherwise("mid")
    zoned = sliced.previous(checks.withColumn("zone", zone), keys, order, "zone", "_prev")
    return zoned.filter((F.col("zone") != "mid") & ~F.col("zone").eqNullSafe(F.col("_prev"))).drop("_prev")


def rolling_drop(checks: DataFrame, keys: list[str], order: list[str], value: str, points: int = 10,
                 share: float = 0.85) -> DataFrame:
    """Checks lying below ``share`` of the mean of the last ``points`` values (their own included)."""
    rolled = sliced.rolling(checks, keys, order, points, recent_avg=lambda w: F.avg(value).over(w))
    return rolled.filter((F.col("idx") >= points) & (F.col(value) < F.col("recent_avg") * share))
