"""Counting, de-duplication, funnels, sentiment and activity summaries."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidemark import fixed
from tidemark.functions import text as tx
from tidemark.operators import filters as fl


def dedup_tokens(listings: DataFrame, keys: Sequence[str] = ("platform", "contract"),
                 order: Sequence[str] = ("source_rank", "pos")) -> DataFrame:
    """First listing per key in source order; listings without a contract are all kept.

    The rank limit runs before the shuffle, so a token listed very often sends one row per task.
    """
    keyed = listings.filter(fl_present("contract"))
    w = W.partitionBy(*keys).orderBy(*order)
    first = keyed.withColumn("_rn", F.row_number().over(w)).filter("_rn = 1").drop("_rn")
    return first.unionByName(listings.filter(~fl_present("contract")))


def fl_present(c: str) -> Column:
    return F.coalesce(F.col(c), F.lit("")) != ""


def filter_funnel(tokens: DataFrame, age: Column) -> DataFrame:
    """Rows surviving each stage of the discovery scan, in one pass."""
    cls, mom, kind = fl.age_class(age), fl.momentum_class(), fl.target_class()
    t = tokens.select(cls.alias("a"), mom.alias("m"), kind.alias("k"))
    window = F.col("a") == "sweet_spot"
    kept = window & (F.col("m") == "keep")
    return t.agg(F.count(F.lit(1)).alias("unique_tokens"),
                 F.count_if(F.col("a") == "too_fresh").alias("too_fresh"),
                 F.count_if(F.col("a") == "too_old").alias("too_old"),
                 F.count_if(window).alias("in_window"),
                 F.count_if(window & (F.col("m") == "falling")).alias("falling"),
                 F.count_if(window & (F.col("m") == "parabolic")).alias("parabolic"),
                 F.count_if(kept).alias("momentum"),
                 F.count_if(kept & (F.col("k") == "match")).alias("matches"),
                 F.count_if(kept & F.col("k").isin("micro", "large")).alias("others"))


def confirmations(trades: DataFrame) -> DataFrame:
    """Distinct buying wallets per token; de-duplicated by (token, wallet) before counting per token."""
    return (trades.filter("side = 'buy'").select("token", "wallet").distinct()
            .groupBy("token").agg(F.count(F.lit(1)).alias("wallets")))


def buys_by_token(trades: DataFrame, order: Sequence[str]) -> DataFrame:
    return (trades.filter("side = 'buy'").groupBy("token")
            .agg(F.count(F.lit(1)).alias("buys"), F.min(F.struct(*order, "symbol"))["symbol"].alias("first_symbol")))


def sentiment(posts: DataFrame, by: Sequence[str] = (), whole_words: bool = False) -> DataFrame:
    """Engagement-weighted keyword sentiment, overall or per group.

    A post weighs 1 + engagement / 100, which is summed as whole hundredths: exact in any order.
    """
    low = F.lower("text")
    weight = F.lit(100) + F.col("engagement")
    bull, bear = (tx.contains_any(low, ws, whole_words) for ws in (fixed.BULL_WORDS, fixed.BEAR_WORDS))
    rows = posts.select(*by, "engagement", F.when(bull, weight).otherwise(0).alias("bull"),
                        F.when(bear, weight).otherwise(0).alias("bear"))
    s = rows.groupBy(*by).agg((F.coalesce(F.sum("bull"), F.lit(0)) / 100).alias("bullish"),
                              (F.coalesce(F.sum("bear"), F.lit(0)) / 100).alias("bearish"),
                              F.count(F.lit(1)).alias("posts"),
                              F.coalesce(F.sum("engagement"), F.lit(0)).alias("engagement"))
    signals = F.col("bullish") + F.col("bearish")
    s = s.withColumn("score", F.coalesce(F.try_divide(F.col("bullish"), signals), F.lit(0.5)))
    label = F.when(F.col("score") > 0.6, "bullish").when(F.col("score") < 0.4, "bearish").otherwise("neutral")
    return (s.withColumn("sentiment", label)
            .withColumn("confidence", F.least(signals / 20, F.lit(1.0)))
            .withColumn("avg_engagement", F.coalesce(F.try_divide("engagement", "posts"), F.lit(0.0))))


def sentiment_signal(search: DataFrame, authored: DataFrame) -> DataFrame:
    """Direction from search posts plus the on-topic posts of followed authors."""
    topical = authored.filter(tx.contains_any(F.lower("text"), fixed.TOPIC_WORDS))
    s = sentiment(search.unionByName(topical))
    return s.withColumn("direction", F.when(F.col("sentiment") == "bullish", "UP")
                        .when(F.col("sentiment") == "bearish", "DOWN").otherwise("NEUTRAL"))


def buy_sell_ratio(buys: str = "buys", sells: str = "sells") -> Column:
    return F.when(F.col(sells) == 0, 1.0).otherwise(F.try_divide(F.col(buys), F.col(sells)))


def unusual_activity(events: DataFrame, key: str, ts: str, bucket: str = "1 hour", buckets: int = 24,
                     limit: float = 2.0) -> DataFrame:
    """Buckets whose count lies more than ``limit`` deviations above the mean of the preceding buckets."""
    counts = events.groupBy(key, F.window(ts, bucket)["start"].alias("bucket")).agg(F.count(F.lit(1)).alias("n"))
    w = W.partitionBy(key).orderBy("bucket").rowsBetween(-buckets, -1)
    # sums of whole numbers are exact, so the deviation does not depend on evaluation order
    n, s, q = F.count("n").over(w), F.sum("n").over(w), F.sum(F.col("n") * F.col("n")).over(w)
    sd = F.sqrt((n * q - s * s) / (n * (n - 1)))
    z = F.when((n == buckets) & (n * q > s * s), (F.col("n") - s / n) / sd)
    return counts.withColumn("z", z).filter(F.col("z") > limit)
