"""Wallet analytics computed from trades."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark import bindings as b
from tidemark import fixed
from tidemark.catalog.base import query, with_
from tidemark.catalog.joins import EXCHANGE_SQL, TRACKED_SQL, exchanges, tracked
from tidemark.functions.values import ntz
from tidemark.operators import joins as jn
from tidemark.operators import wallets as wa

T = with_(b.TRADES_SQL)
RECENT = "ts >= TIMESTAMP '2001-05-01'"


def all_trades(spark, sf):
    return b.trades(spark, sf, wallets=True)


def recent_trades(spark, sf):
    return b.trades(spark, sf, wallets=True, since=b.RECENT_FROM)


SIGNED = "CASE WHEN side = 'buy' THEN {0} ELSE -{0} END"


@query("whale_wallets", T + f"""SELECT wallet, sum({SIGNED.format('qty')}) AS balance FROM t GROUP BY wallet
HAVING sum({SIGNED.format('qty')}) >= 500""")
def whale_wallets(spark, sf):
    return wa.whale_wallets(all_trades(spark, sf), 500)


@query("whale_activity", T + f"""SELECT token, count(*) AS transfers, round(sum(value_usd), 2) AS volume_usd, max(value_usd) AS largest
FROM t WHERE {RECENT} AND value_usd >= 500 GROUP BY token""")
def whale_activity(spark, sf):
    return wa.activity(b.trades(spark, sf, since=b.RECENT_FROM))


@query("directional_flows", with_(b.TRADES_SQL, EXCHANGE_SQL) + f"""
SELECT token, round(inn, 2) AS inflow, round(out, 2) AS outflow, round(round(inn, 2) - round(out, 2), 2) AS net,
  abs(round(round(inn, 2) - round(out, 2), 2)) >= 500000 AS flagged
FROM (SELECT token, sum(CASE WHEN line_status = 'O' THEN value_usd ELSE 0 END) AS inn,
        sum(CASE WHEN line_status = 'F' THEN value_usd ELSE 0 END) AS out FROM t JOIN exchange USING (wallet) GROUP BY token)""")
def directional_flows(spark, sf):
    """Flows to and from wallets labelled as exchanges."""
    t = all_trades(spark, sf).join(exchanges(spark, sf), "wallet", "left_semi")
    return wa.directional_flows(t.withColumn("direction", F.when(F.col("line_status") == "O", "in").otherwise("out")))


HELD_SQL = f"held AS (SELECT token, wallet, sum({SIGNED.format('qty')}) AS balance FROM t GROUP BY 1, 2 HAVING sum({SIGNED.format('qty')}) > 0)"


@query("holder_distribution", with_(b.TRADES_SQL, HELD_SQL) + """
SELECT token, count(*) AS holders, max(balance) / sum(balance) * 100 AS top1_pct,
  sum(balance) FILTER (rn <= 10) / sum(balance) * 100 AS top10_pct
FROM (SELECT *, row_number() OVER (PARTITION BY token ORDER BY balance DESC, wallet) AS rn FROM held) GROUP BY token""")
def holder_distribution(spark, sf):
    return wa.holder_distribution(all_trades(spark, sf))


def pnl_sql(where: str = "true") -> str:
    return f"""
agg AS (SELECT wallet, token, count(*) AS trades, round(sum(value_usd), 2) AS volume,
        round(coalesce(sum(value_usd) FILTER (side = 'buy'), 0), 2) AS bought_usd, coalesce(sum(qty) FILTER (side = 'buy'), 0) AS bought,
        round(coalesce(sum(value_usd) FILTER (side = 'sell'), 0), 2) AS sold_usd, coalesce(sum(qty) FILTER (side = 'sell'), 0) AS sold
      FROM t WHERE {where} GROUP BY wallet, token),
perf AS (SELECT *, CASE WHEN sold > 0 THEN floor((sold_usd - CASE WHEN bought = 0 THEN 0 ELSE bought_usd / bought END * sold) * 100 + 0.5) / 100
        ELSE 0 END AS pnl FROM agg),
pnl AS (SELECT wallet, round(sum(pnl), 2) AS pnl, sum(trades)::BIGINT AS trades, round(sum(volume), 2) AS volume,
        count(*) FILTER (sold > 0) AS closed, count(*) FILTER (pnl > 0) AS winners,
        CASE WHEN count(*) FILTER (sold > 0) = 0 THEN 0 ELSE count(*) FILTER (pnl > 0) / count(*) FILTER (sold > 0) END AS win_rate
      FROM perf GROUP BY wallet)"""


@query("wallet_pnl", with_(b.TRADES_SQL, pnl_sql()) + "SELECT wallet, pnl, trades, volume, win_rate FROM pnl")
def wallet_pnl(spark, sf):
    return wa.wallet_pnl(all_trades(spark, sf)).select("wallet", "pnl", "trades", "volume", "win_rate")


@query("wallet_token_performance", with_(b.TRADES_SQL, pnl_sql(RECENT)) + "SELECT wallet, token, trades, bought, sold, pnl FROM perf")
def wallet_token_performance(spark, sf):
    return wa.token_performance(recent_trades(spark, sf)).select("wallet", "token", "trades", "bought", "sold", "pnl")


@query("counterparties", """SELECT wallet, counterparty, n, volume, rn FROM (SELECT *, row_number() OVER
  (PARTITION BY wallet ORDER BY n DESC, volume DESC, counterparty) AS rn FROM (SELECT o_custkey AS wallet, l_suppkey AS counterparty,
    count(*) AS n, round(sum(l_extendedprice), 2) AS volume FROM lineitem JOIN orders ON o_orderkey = l_orderkey GROUP BY 1, 2))
WHERE rn <= 3""")
def counterparties(spark, sf):
    t = b.trades(spark, sf, token="l_suppkey", wallets=True).withColumnRenamed("token", "counterparty")
    return wa.counterparties(t, 3)


@query("leaderboard", with_(b.TRADES_SQL, pnl_sql(RECENT)) + """SELECT wallet, pnl, row_number() OVER (ORDER BY pnl DESC, wallet) AS rank
FROM pnl ORDER BY pnl DESC, wallet LIMIT 25""")
def leaderboard(spark, sf):
    return wa.leaderboard(wa.wallet_pnl(recent_trades(spark, sf)), 25).select("wallet", "pnl", "rank")


FLOWS_SQL = f"""
bal AS (SELECT wallet, token, round(sum({SIGNED.format('value_usd')}), 2) AS net_usd FROM t WHERE {RECENT} GROUP BY 1, 2),
flows AS (SELECT token, count(*) FILTER (net_usd > 0) AS buyers, count(*) FILTER (net_usd < 0) AS sellers,
        round(sum(net_usd), 2) AS net_usd FROM bal GROUP BY 1)"""


@query("smart_signals", with_(b.TRADES_SQL, FLOWS_SQL, f"""
fb AS (SELECT wallet, token, min(ts) FILTER (side = 'buy') AS first_buy FROM t GROUP BY 1, 2),
np AS (SELECT token, count(*) AS new_positions FROM fb WHERE first_buy >= TIMESTAMP '2001-05-01' GROUP BY 1)""") + """
SELECT token, buyers >= 3 AS accumulation, sellers >= 3 AS distribution, coalesce(new_positions, 0) AS new_positions
FROM flows LEFT JOIN np USING (token)""")
def smart_signals(spark, sf):
    t = all_trades(spark, sf)
    first = t.filter("side = 'buy'").groupBy("wallet", "token").agg(F.min("ts").alias("first_buy"))
    return wa.smart_signals(recent_trades(spark, sf), first, ntz(b.RECENT_FROM), fixed.CONVERGENCE_WALLETS)


@query("convergence", T + f"""SELECT token, count(DISTINCT wallet) AS wallets FROM t WHERE {RECENT} AND side = 'buy'
GROUP BY token HAVING count(DISTINCT wallet) >= 3""")
def convergence(spark, sf):
    return wa.convergence(recent_trades(spark, sf))


@query("divergence", with_(b.TRADES_SQL, FLOWS_SQL, b.SNAP_SQL) + """SELECT token, flows.net_usd, change_24h FROM flows JOIN snap USING (token)
WHERE flows.net_usd < 0 AND change_24h > 5""")
def divergence(spark, sf):
    return (wa.divergence(wa.net_flows(recent_trades(spark, sf)), b.snapshots(spark, sf))
            .select("token", "net_usd", "change_24h"))


@query("smart_holders", with_(b.TRADES_SQL, TRACKED_SQL) + f"""
SELECT token, wallet, sum({SIGNED.format('qty')}) AS balance, round(sum(value_usd) FILTER (side = 'buy'), 2)
  / sum(qty) FILTER (side = 'buy') AS entry_price FROM t JOIN tracked USING (wallet) GROUP BY 1, 2 HAVING sum({SIGNED.format('qty')}) > 0""")
def smart_holders(spark, sf):
    return wa.smart_holders(all_trades(spark, sf).join(tracked(spark, sf), "wallet", "left_semi"))


CAND_SQL = """
hd AS (SELECT DISTINCT wallet, token FROM t WHERE ts >= TIMESTAMP '2000-06-01'),
cand AS (SELECT wallet, count(*) AS common_tokens FROM hd
      WHERE token IN (SELECT token FROM hd JOIN tracked USING (wallet)) AND wallet NOT IN (SELECT wallet FROM tracked)
        AND wallet NOT IN (SELECT wallet FROM exchange) GROUP BY wallet HAVING count(*) >= 5)"""


@query("candidate_confidence", with_(b.TRADES_SQL, TRACKED_SQL, EXCHANGE_SQL, CAND_SQL, pnl_sql()) + """
SELECT wallet, common_tokens, round(confidence, 6) AS confidence FROM (SELECT wallet, common_tokens,
  0.5::DOUBLE * least(common_tokens / 10.0::DOUBLE, 1) + 0.5::DOUBLE * win_rate AS confidence FROM cand JOIN pnl USING (wallet) WHERE pnl > 0)
WHERE confidence >= 0.7::DOUBLE""")
def candidate_confidence(spark, sf):
    t = b.trades(spark, sf, wallets=True, since=b.SUPPLY_FROM)
    c = wa.candidate_confidence(jn.cobuyers(t, tracked(spark, sf), exchanges(spark, sf)), wa.wallet_pnl(all_trades(spark, sf)))
    return (c.filter(F.col("confidence") >= fixed.CANDIDATE_CONFIDENCE)
            .select("wallet", "common_tokens", F.round("confidence", 6).alias("confidence")))


@query("wallet_removal", with_(b.TRADES_SQL, TRACKED_SQL, pnl_sql(RECENT), "seen AS (SELECT wallet, max(ts) AS last_ts FROM t GROUP BY 1)") + """
SELECT * FROM (SELECT k.wallet, CASE WHEN last_ts IS NULL OR date_diff('day', last_ts::DATE, DATE '2001-11-05') >= 45 THEN 'inactive'
  WHEN pnl < 0 THEN 'net_loser' END AS reason FROM tracked k LEFT JOIN seen USING (wallet) LEFT JOIN pnl USING (wallet)) WHERE reason IS NOT NULL""")
def wallet_removal(spark, sf):
    t = all_trades(spark, sf)
    seen = t.groupBy("wallet").agg(F.max("ts").alias("last_ts"))
    return wa.to_remove(tracked(spark, sf), seen, wa.wallet_pnl(recent_trades(spark, sf)),
                        F.lit(b.AS_OF[:10]).cast("date")).select("wallet", "reason")
