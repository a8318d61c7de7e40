"""Exponential averages over series of any length, without a task that gets a whole key.

A row turns the average m into q * m + k * c, an affine map. Rows are numbered and cut into blocks; a block's rows are one affine map,
found by an ordinary aggregate. What a block starts from is the composition of the maps before it: blocks are composed in groups
and groups in order, so the longest array holds a thousand maps. Inside a block the rows' averages are a running sum.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidemark import fixed
from tidemark.operators import sliced
from tidemark.operators.candles import smoothing

BLOCK = 4096
GROUP = 1024


def _same(left: list[Column], right: list[Column]) -> Column:
    out = left[0].eqNullSafe(right[0])
    for a, b in zip(left[1:], right[1:], strict=True):
        out = out & a.eqNullSafe(b)
    return out


def _named(df: DataFrame, names: list[str]) -> tuple[DataFrame, list[str]]:
    new = [f"_r_{n}" for n in names]
    return df.withColumnsRenamed(dict(zip(names, new, strict=True))), new


def _join(left: DataFrame, right: DataFrame, on: list[str]) -> DataFrame:
    """Inner join in which null keys match, as they do in windows and groups."""
    right, new = _named(right, on)
    return left.join(right, _same([left[c] for c in on], [right[c] for c in new])).drop(*new)


def _prefixes(maps: DataFrame, keys: list[str], at: str) -> DataFrame:
    """For each map (a, b) of a key the composition (a0, b0) of those at smaller ``at``, and the key's whole composition (wa, wb)."""
    first = F.struct(F.array().cast("array<struct<at:bigint,a0:double,b0:double>>").alias("out"), F.lit(1.0).alias("a"), F.lit(0.0).alias("b"))

    def step(acc: Column, x: Column) -> Column:
        seen = F.struct(x["at"].alias("at"), acc["a"].alias("a0"), acc["b"].alias("b0"))
        return F.struct(F.array_append(acc["out"], seen).alias("out"), (x["a"] * acc["a"]).alias("a"), (x["a"] * acc["b"] + x["b"]).alias("b"))
    arrays = maps.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct(F.col(at).cast("bigint").alias("at"), "a", "b"))).alias("m"))
    folded = arrays.select(*keys, F.aggregate("m", first, step).alias("f"))
    return folded.select(*keys, F.explode("f.out").alias("x"), F.col("f.a").alias("wa"), F.col("f.b").alias("wb")).select(
        *keys, F.col("x.at").alias(at), "x.a0", "x.b0", "wa", "wb")


def ema_series(rows: DataFrame, keys: list[str], order: list[str], value: str, length: int = fixed.EMA_LEN, block: int = BLOCK,
               out: str = "ema") -> DataFrame:
    """``rows`` with their 1-based position ``idx`` and the average ``out`` at every row: null up to the seed, the mean of the first ``length`` values.

    Rows are in time slices where there is a slice column (see ``sliced``). A row of null value is no part of the series and is left out. Keys may be null.
    A key shorter than ``length`` has no average. No array or window holds more than a block, a group of blocks or a slice of a key's rows;
    the groups of a key are one array, one entry for each four million rows.
    """
    k = smoothing(length)
    q = 1 - k
    if q > 0:  # weights within a block stay far from overflow
        block = max(1, min(block, int(250 / -math.log10(q))))
    idx, blk = F.col("idx"), F.floor((F.col("idx") - 1) / block)
    numbered = sliced.row_index(rows.filter(F.col(value).isNotNull()), keys, order).withColumn("_block", blk)
    last = (F.col("_block") + 1) * block  # position of a full block's last row
    live = idx > length
    own = F.sum(F.when(live, k * F.col(value) * F.pow(F.lit(q), last - idx)).otherwise(0.0))
    blocks = numbered.groupBy(*keys, "_block").agg(own.alias("b"), F.sum(F.when(~live, F.col(value)).otherwise(0.0)).alias("_seed"),
                                                   F.count(F.lit(1)).alias("_n"))
    maps = blocks.withColumn("a", F.pow(F.lit(q), F.greatest(F.lit(0), F.least(F.lit(block), last - length))))
    maps = maps.withColumn("_group", F.floor(F.col("_block") / GROUP))
    inner = _prefixes(maps, [*keys, "_group"], "_block")
    whole = inner.groupBy(*keys, "_group").agg(F.first("wa").alias("a"), F.first("wb").alias("b"))
    outer = _prefixes(whole, keys, "_group").select(*keys, "_group", F.col("a0").alias("ga"), F.col("b0").alias("gb"))
    seeds = maps.groupBy(*keys).agg((F.sum("_seed") / length).alias("_x"), F.sum("_n").alias("_rows")).filter(F.col("_rows") >= length)
    start = _join(_join(inner, outer, [*keys, "_group"]), seeds, keys)
    start = start.select(*keys, "_block", (F.col("a0") * (F.col("ga") * F.col("_x") + F.col("gb")) + F.col("b0")).alias("_from"))
    side, on = _named(start, [*keys, "_block"])
    met = numbered.join(side, _same([numbered[c] for c in [*keys, "_block"]], [side[c] for c in on]), "left").drop(*on)
    steps = idx - F.greatest(F.lit(length), F.col("_block") * block)  # rows of the block that the average has moved by
    so_far = W.partitionBy(*keys, "_block").orderBy("idx").rowsBetween(W.unboundedPreceding, 0)
    moved = F.sum(F.when(live, k * F.col(value) * F.pow(F.lit(q), -steps)).otherwise(0.0)).over(so_far) if q > 0 else None
    if q > 0:
        average = F.when(live, F.pow(F.lit(q), steps) * (F.col("_from") + moved)).when(idx == length, F.col("_from"))
    else:
        average = F.col(value)
    # the seed is known in every block; before it there is no average
    return met.withColumn(out, average).drop("_block", "_from")
