"""Top lists, pages, the discovery scan and the daily digest."""

from __future__ import annotations

from tidemark import bindings as b
from tidemark.catalog.aggregates import UNIQUE_SQL
from tidemark.catalog.base import query, with_
from tidemark.catalog.scores import REPORT_SQL, report
from tidemark.catalog.wallets import RECENT, pnl_sql, recent_trades
from tidemark.functions.values import epoch, ntz
from tidemark.operators import filters as fl
from tidemark.operators import ranking as rk
from tidemark.operators import wallets as wa
from tidemark.plans import briefing, discovery

KIND = "CASE WHEN market_cap BETWEEN 100000 AND 500000 THEN 'match' WHEN market_cap <= 0 THEN NULL WHEN market_cap < 100000 THEN 'micro' ELSE 'large' END"
TOP = """
SELECT source, pos, kind, volume_24h FROM (SELECT *, row_number() OVER (PARTITION BY kind = 'match' ORDER BY volume_24h DESC, source_rank, pos) AS rn FROM k WHERE kind IS NOT NULL)
WHERE rn <= CASE WHEN kind = 'match' THEN 10 ELSE 5 END"""


@query("top_matches", with_(b.LISTINGS_SQL, f"k AS (SELECT *, {KIND} AS kind FROM listings)") + TOP)
def top_matches(spark, sf):
    return rk.top_matches(b.listings(spark, sf).withColumn("kind", fl.target_class())).select("source", "pos", "kind", "volume_24h")


@query("discovery_scan", with_(b.LISTINGS_SQL, UNIQUE_SQL, f"""
k AS (SELECT *, {KIND} AS kind FROM uniq WHERE {b.LISTING_AGE_SQL} BETWEEN 4 AND 10 AND change_24h BETWEEN -5 AND 200)""") + TOP)
def discovery_scan(spark, sf):
    return discovery.scan(b.listings(spark, sf), epoch(ntz(b.AS_OF))).select("source", "pos", "kind", "volume_24h")


@query("token_page", with_(b.SNAP_SQL) + """SELECT token, volume_24h, liquidity FROM (SELECT * FROM snap ORDER BY volume_24h DESC, token LIMIT 50 OFFSET 50)
WHERE liquidity >= 10000""")
def token_page(spark, sf):
    return rk.token_page(b.snapshots(spark, sf), "volume_24h", 1, 50, 10_000).select("token", "volume_24h", "liquidity")


@query("briefing_mart", with_(b.TRADES_SQL, b.WATCH_SQL, b.SNAP_SQL, pnl_sql(RECENT)) + f"""
SELECT (SELECT count(*) FROM watch) AS tracked,
  (SELECT count(*) FROM t WHERE {RECENT} AND value_usd >= 500) AS transfers, (SELECT round(sum(value_usd), 2) FROM t WHERE {RECENT} AND value_usd >= 500) AS volume_usd,
  (SELECT count(*) FROM ({REPORT_SQL}) WHERE contains(engines, 'A')) AS signals_a, (SELECT count(*) FROM ({REPORT_SQL}) WHERE contains(engines, 'B')) AS signals_b,
  (SELECT count(*) FROM ({REPORT_SQL}) WHERE contains(engines, 'C')) AS signals_c,
  (SELECT count(*) FROM (SELECT token FROM t WHERE {RECENT} AND side = 'buy' GROUP BY token HAVING count(DISTINCT wallet) >= 3)) AS convergences,
  (SELECT round(sum(pnl), 2) FROM pnl) AS pnl""")
def briefing_mart(spark, sf):
    t = recent_trades(spark, sf)
    return briefing.digest(b.watchlist(spark, sf), t, report(spark, sf), wa.wallet_pnl(t))
