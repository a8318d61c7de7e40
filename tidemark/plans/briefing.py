"""The daily digest: one row from several one-row aggregates."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.operators import wallets as wa


def digest(watchlist: DataFrame, trades: DataFrame, scored: DataFrame, positions_pnl: DataFrame) -> DataFrame:
    parts = [
        watchlist.agg(F.count(F.lit(1)).alias("tracked")),
        wa.activity(trades).agg(F.sum("transfers").alias("transfers"), F.round(F.sum("volume_usd"), 2).alias("volume_usd")),
        scored.agg(*[F.count_if(f"engine_{n}").alias(f"signals_{n}") for n in "abc"]),
        wa.convergence(trades).agg(F.count(F.lit(1)).alias("convergences")),
        positions_pnl.agg(F.round(F.sum("pnl"), 2).alias("pnl")),
    ]
    return reduce(lambda a, p: a.join(F.broadcast(p)), parts)  # each side is one row
