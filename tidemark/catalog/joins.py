"""Joins, merges and set operations."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark import bindings as b
from tidemark.catalog.base import query, with_
from tidemark.functions.values import ntz
from tidemark.operators import joins as jn

TRACKED_SQL = "tracked AS (SELECT c_custkey AS wallet FROM customer WHERE c_acctbal > 9000)"
EXCHANGE_SQL = "exchange AS (SELECT c_custkey AS wallet FROM customer WHERE c_acctbal < 0)"


def tracked(spark, sf):
    return b.table(spark, sf, "customer").filter(F.col("c_acctbal") > 9000).select(F.col("c_custkey").alias("wallet"))


def exchanges(spark, sf):
    return b.table(spark, sf, "customer").filter(F.col("c_acctbal") < 0).select(F.col("c_custkey").alias("wallet"))


PAIRS_SQL = """
pairs AS (SELECT l_partkey AS token, l_suppkey AS pos, round(sum(l_extendedprice * l_discount) + 0.0::DOUBLE, 4) * 20 AS liquidity,
        round(sum(l_extendedprice), 2) AS volume, max(l_shipdate) AS created_at FROM lineitem GROUP BY 1, 2),
best AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY token ORDER BY coalesce(liquidity, 0) DESC, pos) AS rn
        FROM pairs) WHERE rn = 1)"""


def pairs(spark, sf):
    """A pair is a token (part) traded on a pool (supplier)."""
    li = b.table(spark, sf, "lineitem")
    return li.groupBy(F.col("l_partkey").alias("token"), F.col("l_suppkey").alias("pos")).agg(
        (F.round(F.sum(F.col("l_extendedprice") * F.col("l_discount")) + 0.0, 4) * 20).alias("liquidity"),
        F.round(F.sum("l_extendedprice"), 2).alias("volume"), F.max("l_shipdate").alias("created_at"))


@query("best_pair", with_(PAIRS_SQL) + "SELECT token, pos, liquidity, volume FROM best")
def best_pair(spark, sf):
    return jn.best_pair(pairs(spark, sf), ["token"]).select("token", "pos", "liquidity", "volume")


@query("boosted_best_pair", with_(PAIRS_SQL) + """SELECT token, p_brand, pos, liquidity FROM part JOIN best ON token = p_partkey
WHERE p_type = 'PROMO' AND liquidity >= 10000""")
def boosted_best_pair(spark, sf):
    boosted = b.table(spark, sf, "part").filter("p_type = 'PROMO'").select(F.col("p_partkey").alias("token"), "p_brand")
    return (jn.boosted_best_pair(boosted, pairs(spark, sf), ["token"])
            .select("token", "p_brand", "pos", "liquidity"))


SNAPWATCH = with_(b.WATCH_SQL, b.SNAP_SQL)


def traded_recently(spark, sf):
    return b.snapshots(spark, sf).filter("volume_24h > 0")


@query("watchlist_snapshot", SNAPWATCH + """SELECT w.address, w.added_date, s.market_cap, s.change_24h FROM watch w
JOIN snap s ON s.address = w.address WHERE volume_24h > 0""")
def watchlist_snapshot(spark, sf):
    return (b.watchlist(spark, sf).select("address", "added_date").join(traded_recently(spark, sf), "address")
            .select("address", "added_date", "market_cap", "change_24h"))


@query("watchlist_keep_missing", SNAPWATCH + """SELECT w.address, s.market_cap, (s.address IS NULL) AS missing FROM watch w
LEFT JOIN snap s ON s.address = w.address AND volume_24h > 0""")
def watchlist_keep_missing(spark, sf):
    s = traded_recently(spark, sf).select("address", "market_cap", F.lit(False).alias("m"))
    return (b.watchlist(spark, sf).select("address").join(s, "address", "left")
            .select("address", "market_cap", F.coalesce("m", F.lit(True)).alias("missing")))


@query("watchlist_new", with_(b.WATCH_SQL, b.LISTINGS_SQL) + """SELECT symbol, name, address, NULL AS chain, added_date, NULL AS notes FROM watch UNION ALL
SELECT symbol, symbol, contract, 'solana', DATE '2001-11-05', '4-10 days (scanner verified) | ' || printf('%+.1f%%', change_24h) || ' | MC $' ||
  round_even(market_cap / 1000, 0)::BIGINT || 'K | Auto-added from scanner'
FROM (SELECT *, row_number() OVER (PARTITION BY contract ORDER BY source_rank) AS rn FROM listings WHERE market_cap BETWEEN 100000 AND 500000 AND contract <> '')
WHERE rn = 1 AND contract NOT IN (SELECT address FROM watch)""")
def watchlist_new(spark, sf):
    """The list as it is, and an entry for the first match of each token that is not on it."""
    found = b.listings(spark, sf).filter(F.col("market_cap").between(100_000, 500_000))
    first = found.groupBy(F.col("contract").alias("address")).agg(*[F.min_by(c, "source_rank").alias(c) for c in ("symbol", "change_24h", "market_cap")])
    new = jn.scanner_entries(first.withColumn("name", F.col("symbol")), ntz(b.AS_OF))
    listed = b.watchlist(spark, sf).select("symbol", "name", "address", F.lit(None).cast("string").alias("chain"), "added_date", F.lit(None).cast("string").alias("notes"))
    return jn.upsert_new(listed, new)


@query("signal_merge", with_(b.SNAP_SQL, TRACKED_SQL, b.TRADES_SQL, """
nb AS (SELECT token, wallet, sum(CASE WHEN side = 'buy' THEN value_usd ELSE -value_usd END) AS net FROM t
       JOIN tracked USING (wallet) WHERE ts >= TIMESTAMP '2001-05-01' GROUP BY 1, 2),
one AS (SELECT token, count(*) FILTER (net > 0) AS buyers, count(*) FILTER (net < 0) AS sellers FROM nb GROUP BY 1),
two AS (SELECT token, count(DISTINCT wallet) AS wallets FROM t WHERE ts >= TIMESTAMP '2001-05-01' GROUP BY 1),
three AS (SELECT p_partkey AS token, 1 AS listed FROM part WHERE p_type = 'PROMO')""") + """
SELECT s.token, one.buyers, one.sellers, two.wallets, CASE WHEN s.chain = 'base' THEN three.listed END AS base_signal,
  s.change_24h, s.volume_24h FROM snap s LEFT JOIN one USING (token) LEFT JOIN two USING (token) LEFT JOIN three USING (token)""")
def signal_merge(spark, sf):
    return signals(spark, sf).select("token", "buyers", "sellers", "wallets", "base_signal", "change_24h", "volume_24h")


def signals(spark, sf):
    """Four sources per token: tracked-wallet flows, wallet counts, a chain-specific list and the market."""
    t = b.trades(spark, sf, wallets=True, since=b.RECENT_FROM)
    signed = F.when(F.col("side") == "buy", F.col("value_usd")).otherwise(-F.col("value_usd"))
    net = t.join(tracked(spark, sf), "wallet", "left_semi").groupBy("token", "wallet").agg(F.sum(signed).alias("net"))
    flows = net.groupBy("token").agg(F.count_if(F.col("net") > 0).alias("buyers"), F.count_if(F.col("net") < 0).alias("sellers"))
    counts = t.select("token", "wallet").distinct().groupBy("token").agg(F.count(F.lit(1)).alias("wallets"))
    listed = b.table(spark, sf, "part").filter("p_type = 'PROMO'").select(F.col("p_partkey").alias("token"), F.lit(1).alias("listed"))
    merged = jn.merge_signals(b.snapshots(spark, sf), {"flows": flows, "counts": counts, "listed": listed})
    return merged.withColumn("base_signal", F.when(F.col("chain") == "base", F.col("listed")))


@query("token_enrichment", with_(PAIRS_SQL) + """SELECT p_partkey AS token, best.liquidity, best.volume,
  date_diff('day', best.created_at::DATE, DATE '2001-11-05')::INT AS age_days FROM part LEFT JOIN best ON token = p_partkey""")
def token_enrichment(spark, sf):
    tokens = b.table(spark, sf, "part").select(F.col("p_partkey").alias("token"))
    return jn.enrich(tokens, pairs(spark, sf)).select(
        "token", "liquidity", "volume",
        F.date_diff(F.lit(b.AS_OF[:10]).cast("date"), F.to_date("created_at")).alias("age_days"))


@query("whale_positions", """SELECT c_custkey AS wallet, o_orderkey AS position_id, o_totalprice AS size FROM customer
JOIN orders ON o_custkey = c_custkey WHERE c_acctbal / 10000 > 0.7::DOUBLE AND o_totalprice > 100 AND o_orderstatus = 'O'""")
def whale_positions(spark, sf):
    w = b.table(spark, sf, "customer").select(F.col("c_custkey").alias("wallet"), (F.col("c_acctbal") / 10000).alias("score"))
    p = b.table(spark, sf, "orders").filter("o_orderstatus = 'O'").select(
        F.col("o_custkey").alias("wallet"), F.col("o_orderkey").alias("position_id"), F.col("o_totalprice").alias("size"))
    return jn.whale_positions(w, p).select("wallet", "position_id", "size")


@query("execution_lineage", """SELECT l_orderkey AS opportunity_id, l_linenumber AS line_no, l_extendedprice AS amount,
  o_orderpriority AS job_priority, s_name AS agent, n_name AS site FROM lineitem LEFT JOIN orders ON o_orderkey = l_orderkey
LEFT JOIN supplier ON s_suppkey = l_suppkey LEFT JOIN nation ON n_nationkey = s_nationkey""")
def execution_lineage(spark, sf):
    li = b.table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_extendedprice", "l_suppkey")
    o = b.table(spark, sf, "orders").select(F.col("o_orderkey").alias("l_orderkey"), "o_orderpriority")
    s = b.table(spark, sf, "supplier").select(F.col("s_suppkey").alias("l_suppkey"), "s_name", "s_nationkey")
    n = b.table(spark, sf, "nation").select(F.col("n_nationkey").alias("s_nationkey"), "n_name")
    return (li.join(o, "l_orderkey", "left").join(s, "l_suppkey", "left").join(n, "s_nationkey", "left")
            .select(F.col("l_orderkey").alias("opportunity_id"), F.col("l_linenumber").alias("line_no"),
                    F.col("l_extendedprice").alias("amount"), F.col("o_orderpriority").alias("job_priority"),
                    F.col("s_name").alias("agent"), F.col("n_name").alias("site")))


@query("cobuyers", with_(b.TRADES_SQL, TRACKED_SQL, EXCHANGE_SQL, """
held AS (SELECT DISTINCT wallet, token FROM t WHERE ts >= TIMESTAMP '2000-06-01')""") + """
SELECT wallet, count(*) AS common_tokens FROM held
WHERE token IN (SELECT token FROM held JOIN tracked USING (wallet)) AND wallet NOT IN (SELECT wallet FROM tracked)
  AND wallet NOT IN (SELECT wallet FROM exchange) GROUP BY wallet HAVING count(*) >= 5""")
def cobuyers(spark, sf):
    t = b.trades(spark, sf, wallets=True, since=b.SUPPLY_FROM)
    return jn.cobuyers(t, tracked(spark, sf), exchanges(spark, sf))


@query("wallet_similarity", with_(b.TRADES_SQL, "held AS (SELECT DISTINCT wallet, token FROM t)") + """
SELECT h.wallet, count(w.token) AS shared,
  count(w.token) / (count(*) + (SELECT count(*) FROM held WHERE wallet = 7) - count(w.token)) AS jaccard
FROM held h LEFT JOIN held w ON w.wallet = 7 AND w.token = h.token WHERE h.wallet <> 7 GROUP BY h.wallet HAVING count(w.token) > 0""")
def wallet_similarity(spark, sf):
    return jn.similar_wallets(b.trades(spark, sf, wallets=True), 7)


SETS_SQL = """
held AS (SELECT DISTINCT o_custkey AS wallet, l_suppkey AS token FROM lineitem JOIN orders ON l_orderkey = o_orderkey WHERE l_shipdate >= TIMESTAMP '2000-06-01'),
own AS (SELECT wallet, list(token ORDER BY token) AS tokens FROM held GROUP BY wallet),
rep AS (SELECT min(wallet) AS rep, count(*) AS copies, len(tokens) AS n, tokens FROM own GROUP BY tokens)"""


def traded_sets(spark, sf):
    return jn.wallet_sets(b.trades(spark, sf, token="l_suppkey", wallets=True, since=b.SUPPLY_FROM))


@query("wallet_similarity_pairs", with_(SETS_SQL, """
each AS (SELECT rep, n, unnest(tokens) AS token FROM rep),
pairs AS (SELECT a.rep AS wallet_a, b.rep AS wallet_b, count(*) AS shared, a.n + b.n - count(*) AS whole FROM each a JOIN each b ON a.token = b.token AND a.rep < b.rep
  GROUP BY a.rep, b.rep, a.n, b.n)""") + "SELECT wallet_a, wallet_b, shared, shared / whole AS jaccard FROM pairs WHERE 100 * shared >= 50 * whole")
def wallet_similarity_pairs(spark, sf):
    """Wallets with similar trading patterns without naming one; wallets of equal sets are one."""
    return jn.similar_pairs(traded_sets(spark, sf)[0])


@query("wallet_set_classes", with_(SETS_SQL) + "SELECT wallet, rep FROM own JOIN rep USING (tokens)")
def wallet_set_classes(spark, sf):
    """The wallet that stands for each wallet's token set in ``wallet_similarity_pairs``."""
    return traded_sets(spark, sf)[1]


@query("price_asof_trade", """
SELECT token, order_id, line_no, price, entry FROM (SELECT *, last_value(bought IGNORE NULLS) OVER
    (PARTITION BY token ORDER BY ts, side_no, o1, o2, o3 ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS entry FROM (
  SELECT l_suppkey AS token, l_shipdate AS ts, 1 AS side_no, l_orderkey AS order_id, l_linenumber AS line_no,
    l_extendedprice / l_quantity AS price, NULL AS bought, NULL AS o1, NULL AS o2, NULL AS o3 FROM lineitem WHERE l_returnflag = 'R'
  UNION ALL SELECT l_suppkey, l_shipdate, 0, NULL, NULL, NULL, l_extendedprice / l_quantity, l_orderkey, l_linenumber,
    l_extendedprice / l_quantity FROM lineitem WHERE l_returnflag <> 'R')) WHERE side_no = 1""")
def price_asof_trade(spark, sf):
    """For every sale the latest purchase price of the token at that time."""
    t = b.trades(spark, sf, token="l_suppkey")
    sells = t.filter("side = 'sell'").select("token", "ts", "order_id", "line_no", "price")
    buys = t.filter("side = 'buy'").select("token", "ts", "order_id", "line_no", F.col("price").alias("bought"))
    return (jn.as_of(sells, buys, ["token"], "ts", "bought", "entry", 90 * 86_400, ["order_id", "line_no", "bought"])
            .select("token", "order_id", "line_no", "price", "entry"))


@query("wallet_upsert_dedup", """SELECT c_custkey AS address, 'manual' AS source FROM customer WHERE c_acctbal > 9000 UNION ALL
SELECT DISTINCT o_custkey, 'auto' FROM orders WHERE o_totalprice > 300000
  AND o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_acctbal > 9000)""")
def wallet_upsert_dedup(spark, sf):
    have = tracked(spark, sf).select(F.col("wallet").alias("address"), F.lit("manual").alias("source"))
    found = (b.table(spark, sf, "orders").filter("o_totalprice > 300000")
             .select(F.col("o_custkey").alias("address")).distinct().withColumn("source", F.lit("auto")))
    listed = have.select("address")
    return have.unionByName(found.join(listed, "address", "left_anti"))


UNION_SQL = """
SELECT source, source_rank, contract, market_cap, holders FROM (
  SELECT source, source_rank, contract, market_cap, NULL::BIGINT AS holders FROM listings
  UNION ALL SELECT 'snapshot', 9, address, market_cap, holders FROM snap)"""


@query("union_sources", with_(b.LISTINGS_SQL, b.SNAP_SQL) + UNION_SQL)
def union_sources(spark, sf):
    a = b.listings(spark, sf).select("source", "source_rank", "contract", "market_cap")
    s = b.snapshots(spark, sf).select(F.lit("snapshot").alias("source"), F.lit(9).alias("source_rank"),
                                      F.col("address").alias("contract"), "market_cap", "holders")
    return a.unionByName(s, allowMissingColumns=True)


@query("distinct_base_tokens", with_(b.LISTINGS_SQL) + "SELECT DISTINCT platform, contract FROM listings WHERE contract <> ''")
def distinct_base_tokens(spark, sf):
    return b.listings(spark, sf).filter("contract <> ''").select("platform", "contract").distinct()


@query("except_listed", with_(b.WATCH_SQL, b.SNAP_SQL) + """SELECT address FROM snap WHERE market_cap BETWEEN 100000 AND 500000
EXCEPT SELECT address FROM watch""")
def except_listed(spark, sf):
    found = b.snapshots(spark, sf).filter(F.col("market_cap").between(100_000, 500_000)).select("address")
    return jn.not_listed(found, b.watchlist(spark, sf).select("address"))
