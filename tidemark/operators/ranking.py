"""Top lists and pages. Limits here are the feature; ties are settled by source rank and position."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def top_by_volume(df: DataFrame, k: int) -> DataFrame:
    return df.orderBy(F.col("volume_24h").desc(), "source_rank", "pos").limit(k)


def top_matches(tokens: DataFrame, matches: int = 10, others: int = 5) -> DataFrame:
    """Best matches and best others by volume; ``kind`` is match, micro or large."""
    return (top_by_volume(tokens.filter(F.col("kind") == "match"), matches)
            .unionByName(top_by_volume(tokens.filter(F.col("kind").isin("micro", "large")), others)))


def token_page(tokens: DataFrame, by: str, page: int, size: int, min_liquidity: float, descending: bool = True) -> DataFrame:
    """One page of the sorted listing, then the liquidity filter: a page may come back short."""
    key = F.col(by).desc() if descending else F.col(by).asc()
    return tokens.orderBy(key, "token").offset(page * size).limit(size).filter(F.col("liquidity") >= min_liquidity)
