"""Wallet analytics from a trades table: flows, holdings, profit, rankings and signals."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidemark import fixed
from tidemark.functions.values import cents


def is_buy() -> Column:
    return F.col("side") == "buy"


def signed(c: str) -> Column:
    return F.when(is_buy(), F.col(c)).otherwise(-F.col(c))


def balances(trades: DataFrame) -> DataFrame:
    """Net quantity and money flow per wallet and token."""
    return trades.groupBy("wallet", "token").agg(
        F.sum(signed("qty")).alias("balance"), F.round(F.sum(signed("value_usd")), 2).alias("net_usd"),
        F.min(F.when(is_buy(), F.col("ts"))).alias("first_buy"))


def whale_wallets(trades: DataFrame, min_balance: float) -> DataFrame:
    """Wallets whose net holdings over all tokens reach the minimum."""
    return (trades.groupBy("wallet").agg(F.sum(signed("qty")).alias("balance"))
            .filter(F.col("balance") >= min_balance))


def activity(trades: DataFrame, min_value: float = fixed.WHALE_ACTIVITY_MIN) -> DataFrame:
    """Large transfers per token; pass trades already limited to the time window."""
    big = trades.filter(F.col("value_usd") >= min_value)
    return big.groupBy("token").agg(F.count(F.lit(1)).alias("transfers"), F.round(F.sum("value_usd"), 2).alias("volume_usd"),
                                    F.max("value_usd").alias("largest"))


def directional_flows(transfers: DataFrame, threshold: float = fixed.FLOW_THRESHOLD) -> DataFrame:
    """In, out and net flow per token; the flag marks a large absolute net flow."""
    inn = F.round(F.sum(F.when(F.col("direction") == "in", F.col("value_usd")).otherwise(0.0)), 2)
    out = F.round(F.sum(F.when(F.col("direction") == "out", F.col("value_usd")).otherwise(0.0)), 2)
    f = transfers.groupBy("token").agg(inn.alias("inflow"), out.alias("outflow"))
    return (f.withColumn("net", F.round(F.col("inflow") - F.col("outflow"), 2))
            .withColumn("flagged", F.abs("net") >= threshold))


def holder_distribution(trades: DataFrame) -> DataFrame:
    """Share of the largest and the ten largest holders per token, in percent.

    The rank limit is applied before the shuffle; totals come from an ordinary aggregate.
    """
    held = balances(trades).filter(F.col("balance") > 0).select("token", "wallet", "balance")
    w = W.partitionBy("token").orderBy(F.col("balance").desc(), "wallet")
    top = (held.withColumn("rn", F.row_number().over(w)).filter("rn <= 10").groupBy("token")
           .agg(F.sum("balance").alias("t10"), F.max("balance").alias("t1")))
    total = held.groupBy("token").agg(F.sum("balance").alias("total"), F.count(F.lit(1)).alias("holders"))
    return top.join(total, "token").select(
        "token", "holders", (F.col("t1") / F.col("total") * 100).alias("top1_pct"),
        (F.col("t10") / F.col("total") * 100).alias("top10_pct"))


def token_performance(trades: DataFrame) -> DataFrame:
    """Realised profit per wallet and token: sales minus the average purchase price of what was sold."""
    buy, sell = is_buy(), ~is_buy()

    def part(cond: Column, c: str) -> Column:
        return F.coalesce(F.sum(F.when(cond, F.col(c))), F.lit(0.0))

    t = trades.groupBy("wallet", "token").agg(
        F.count(F.lit(1)).alias("trades"), F.round(F.sum("value_usd"), 2).alias("volume"),
        F.round(part(buy, "value_usd"), 2).alias("bought_usd"), part(buy, "qty").alias("bought"),
        F.round(part(sell, "value_usd"), 2).alias("sold_usd"), part(sell, "qty").alias("sold"))
    cost = F.coalesce(F.try_divide("bought_usd", "bought"), F.lit(0.0)) * F.col("sold")
    return t.withColumn("pnl", F.when(F.col("sold") > 0, cents(F.col("sold_usd") - cost)).otherwise(0.0))


def wallet_pnl(trades: DataFrame) -> DataFrame:
    """Trading summary per wallet: profit, trades, volume and share of sold tokens with a gain."""
    p = token_performance(trades).groupBy("wallet").agg(
        F.round(F.sum("pnl"), 2).alias("pnl"), F.sum("trades").alias("trades"), F.round(F.sum("volume"), 2).alias("volume"),
        F.count_if(F.col("sold") > 0).alias("closed"), F.count_if(F.col("pnl") > 0).alias("winners"))
    return p.withColumn("win_rate", F.coalesce(F.try_divide("winners", "closed"), F.lit(0.0)))


def counterparties(trades: DataFrame, k: int) -> DataFrame:
    """The ``k`` most traded counterparties of each wallet; the list is the feature, its length the caller's."""
    c = trades.groupBy("wallet", "counterparty").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("value_usd"), 2).alias("volume"))
    w = W.partitionBy("wallet").orderBy(F.col("n").desc(), F.col("volume").desc(), "counterparty")
    return c.withColumn("rn", F.row_number().over(w).cast("bigint")).filter(F.col("rn") <= k)


def leaderboard(pnl: DataFrame, k: int) -> DataFrame:
    """Best wallets by profit; ranks are numbered on the ``k`` rows that remain."""
    top = pnl.orderBy(F.col("pnl").desc(), "wallet").limit(k)
    return top.withColumn("rank", F.row_number().over(W.orderBy(F.col("pnl").desc(), "wallet")).cast("bigint"))


def net_flows(trades: DataFrame) -> DataFrame:
    """How many wallets bought or sold on balance, per token."""
    b = balances(trades)
    return b.groupBy("token").agg(F.count_if(F.col("net_usd") > 0).alias("buyers"), F.count_if(F.col("net_usd") < 0).alias("sellers"),
                                  F.round(F.sum("net_usd"), 2).alias("net_usd"))


def smart_signals(window_trades: DataFrame, first_buys: DataFrame, since: Column, min_wallets: int) -> DataFrame:
    """Accumulation, distribution and count of first-ever buys in the window, per token."""
    fresh = first_buys.filter(F.col("first_buy") >= since).groupBy("token").agg(F.count(F.lit(1)).alias("new_positions"))
    return (net_flows(window_trades).join(fresh, "token", "left")
            .select("token", (F.col("buyers") >= min_wallets).alias("accumulation"),
                    (F.col("sellers") >= min_wallets).alias("distribution"),
                    F.coalesce("new_positions", F.lit(0)).alias("new_positions")))


def convergence(trades: DataFrame, min_wallets: int = fixed.CONVERGENCE_WALLETS) -> DataFrame:
    """Tokens bought by at least ``min_wallets`` distinct wallets."""
    return (trades.filter(is_buy()).select("token", "wallet").distinct().groupBy("token")
            .agg(F.count(F.lit(1)).alias("wallets")).filter(F.col("wallets") >= min_wallets))


def divergence(flows: DataFrame, prices: DataFrame, min_change: float = fixed.DIVERGENCE_PCT) -> DataFrame:
    """Tokens sold on balance while the price rose."""
    return flows.filter(F.col("net_usd") < 0).join(prices.filter(F.col("change_24h") > min_change), "token")


def smart_holders(trades: DataFrame) -> DataFrame:
    """Wallets still holding a token, with their average entry price."""
    h = trades.groupBy("token", "wallet").agg(
        F.sum(signed("qty")).alias("balance"),
        F.round(F.sum(F.when(is_buy(), F.col("value_usd"))), 2).alias("bought_usd"),
        F.sum(F.when(is_buy(), F.col("qty"))).alias("bought"))
    return h.filter(F.col("balance") > 0).select("token", "wallet", "balance",
                                                 (F.col("bought_usd") / F.col("bought")).alias("entry_price"))


def candidate_confidence(candidates: DataFrame, pnl: DataFrame) -> DataFrame:
    """Confidence of a candidate wallet: breadth of the overlap and share of winning tokens, half each."""
    breadth = F.least(F.col("common_tokens") / (2.0 * fixed.COMMON_TOKENS), F.lit(1.0))
    return (candidates.join(pnl.filter("pnl > 0"), "wallet")
            .withColumn("confidence", 0.5 * breadth + 0.5 * F.col("win_rate")))


def to_remove(wallets: DataFrame, last_seen: DataFrame, recent_pnl: DataFrame, as_of: Column,
              inactive_days: int = fixed.INACTIVE_DAYS) -> DataFrame:
    """Why a tracked wallet should go: no trade for too long, or a loss over the recent window."""
    idle = F.date_diff(as_of, F.to_date("last_ts"))
    reason = (F.when(F.col("last_ts").isNull() | (idle >= inactive_days), "inactive")
              .when(F.col("pnl") < 0, "net_loser"))
    return (wallets.join(last_seen, "wallet", "left").join(recent_pnl.select("wallet", "pnl"), "wallet", "left")
            .withColumn("reason", reason).filter("reason is not null"))
