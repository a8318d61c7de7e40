"""Ordered computations per key that never put a whole key into one task.

A window partitioned by the key alone sends every row of a hot key through a single task. Here each key
is cut into time slices. The slices are summarised with an ordinary (map-side combined) aggregate, the
few summaries of a key are scanned in order, and what each slice inherits from its predecessors is joined
back. Windows over the rows then run per (key, slice). Summaries number at most
``time span / slice length`` per key, however many rows the key has.

A frame without a slice column is computed with plain windows per key. That is for series whose rows per key
are bounded by time already, such as candles.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.window import WindowSpec

SLICE = "_slice"


def slice_time(df: DataFrame, ts: str, seconds: int) -> DataFrame:
    """Tag rows with a time slice; choose the length so that one key's slice fits a task."""
    return df.withColumn(SLICE, F.floor(F.unix_timestamp(F.col(ts).cast("timestamp")) / seconds))


def slice_number(df: DataFrame, n: str, width: int) -> DataFrame:
    return df.withColumn(SLICE, F.floor(F.col(n) / width))


def inherit(df: DataFrame, keys: list[str], summary: dict[str, Column],
            scan: Callable[[DataFrame, WindowSpec], DataFrame], names: list[str]) -> DataFrame:
    """Join to every row what its slice inherits from the earlier slices of the key.

    ``summary`` aggregates a slice; ``scan`` turns the summaries into the inherited columns ``names``, given
    the window of all earlier slices.
    """
    if SLICE not in df.columns:
        return df.withColumns({n: F.lit(None) for n in names})
    per_slice = df.groupBy(*keys, SLICE).agg(*[c.alias(n) for n, c in summary.items()])
    before = W.partitionBy(*keys).orderBy(SLICE).rowsBetween(W.unboundedPreceding, -1)
    on = [*keys, SLICE]
    side = scan(per_slice, before).select(*[F.col(k).alias(f"_on_{i}") for i, k in enumerate(on)], *names)
    same = reduce(and_, [F.col(k).eqNullSafe(F.col(f"_on_{i}")) for i, k in enumerate(on)])  # windows treat null keys as a group, so must this
    return df.join(side, same, "left").drop(*[f"_on_{i}" for i in range(len(on))])


def in_slice(df: DataFrame, keys: list[str], order: list[str]) -> WindowSpec:
    cut = [SLICE] if SLICE in df.columns else []
    return W.partitionBy(*keys, *cut).orderBy(*order)


def running_sums(df: DataFrame, keys: list[str], order: list[str], values: dict[str, Column]) -> DataFrame:
    """Inclusive running sums per key in ``order``, one column per entry of ``values``."""
    src = df.withColumns({f"_v_{n}": v for n, v in values.items()})
    rows = inherit(src, keys, {f"_c_{n}": F.sum(f"_v_{n}") for n in values},
                   lambda per, before: per.withColumns({f"_c_{n}": F.sum(f"_c_{n}").over(before) for n in values}),
                   [f"_c_{n}" for n in values])
    w = in_slice(df, keys, order).rowsBetween(W.unboundedPreceding, 0)
    return (rows.withColumns({n: F.coalesce(F.col(f"_c_{n}"), F.lit(0)) + F.sum(f"_v_{n}").over(w) for n in values})
            .drop(*[f"_v_{n}" for n in values], *[f"_c_{n}" for n in values]))


def row_index(df: DataFrame, keys: list[str], order: list[str], out: str = "idx") -> DataFrame:
    """1-based position of each row within its key."""
    return running_sums(df, keys, order, {out: F.lit(1).cast("bigint")})


def last_known(df: DataFrame, keys: list[str], order: list[str], value: Column, out: str,
               inclusive: bool = True) -> DataFrame:
    """Last non-null ``value`` at or before each row (strictly before it when not inclusive)."""
    newest = F.max(F.when(F.col("_v").isNotNull(), F.struct(*order, F.col("_v").alias("_v"))))["_v"]
    rows = inherit(df.withColumn("_v", value), keys, {"_m": newest},
                   lambda per, before: per.withColumn("_carry", F.last("_m", ignorenulls=True).over(before)), ["_carry"])
    w = in_slice(df, keys, order).rowsBetween(W.unboundedPreceding, 0 if inclusive else -1)
    return rows.withColumn(out, F.coalesce(F.last("_v", ignorenulls=True).over(w), F.col("_carry"))).drop("_v", "_carry")


def previous(df: DataFrame, keys: list[str], order: list[str], value: str, out: str) -> DataFrame:
    """Value of the preceding row of the key (the column must not hold nulls)."""
    return last_known(df, keys, order, F.col(value), out, inclusive=False)


def rolling(df: DataFrame, keys: list[str], order: list[str], rows: int, block: int = 65_536,
            **aggs) -> DataFrame:
    """Aggregates over the last ``rows`` rows of the key, the current one included.

    Rows are numbered and cut into blocks of ``block``; each row is copied to all later blocks whose frames reach
    back to it, so each frame is complete inside its block. ``aggs`` maps an output name to a function of the window.
    """
    idx = row_index(df, keys, order, "_idx")
    own = F.floor((F.col("_idx") - 1) / block)
    spread = F.sequence(own, F.floor((F.col("_idx") + rows - 2) / block))
    w = W.partitionBy(*keys, "_block").orderBy("_idx").rowsBetween(-(rows - 1), 0)
    out = idx.withColumn("_own", own).withColumn("_block", F.explode(spread))
    out = out.select("*", *[make(w).alias(name) for name, make in aggs.items()])
    return out.filter(F.col("_block") == F.col("_own")).drop("_own", "_block").withColumnRenamed("_idx", "idx")
