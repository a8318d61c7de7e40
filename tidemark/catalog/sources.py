"""Vendor payloads, text logs and written tables. Payloads are built from the driver tables, then parsed back."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark import bindings as b
from tidemark.catalog.base import query, with_
from tidemark.catalog.scores import ENRICHED_SQL, scored_tokens
from tidemark.catalog.series import BARS, pool_candles
from tidemark.functions.values import epoch, ntz
from tidemark.session import shared_dir, written
from tidemark.sources import logs, tables, vendors

SNAP = with_(b.SNAP_SQL)


def payload(df, *fields):
    return df.select(F.to_json(F.struct(*fields)).alias("raw"))


def missing(n, c):
    """Every n-th token comes without this field."""
    return F.when(F.col("token") % n != 0, c)


@query("norm_pairs", SNAP + """SELECT lower(chain) AS chain, address, CASE WHEN token % 7 = 0 THEN 'UNKNOWN' ELSE symbol END AS symbol, price, market_cap,
  CASE WHEN token % 5 = 0 THEN 0 ELSE liquidity END AS liquidity, change_24h, buys, sells, created_at FROM snap""")
def norm_pairs(spark, sf):
    c = F.col
    raw = payload(b.snapshots(spark, sf), c("chain").alias("chainId"), c("address").alias("tokenAddress"), c("price").cast("string").alias("priceUsd"),
                  c("market_cap").alias("marketCap"), (epoch("created_at") * 1000).alias("pairCreatedAt"),
                  F.struct(c("address"), missing(7, c("symbol")).alias("symbol")).alias("baseToken"),
                  missing(5, F.struct(c("liquidity").alias("usd"))).alias("liquidity"), F.struct(c("volume_24h").alias("h24")).alias("volume"),
                  F.struct(c("change_24h").alias("h24")).alias("priceChange"), F.struct(F.struct("buys", "sells").alias("h24")).alias("txns"))
    return vendors.norm_pairs(vendors.parse(raw, "raw", vendors.PAIRS)).select(
        "chain", "address", "symbol", "price", "market_cap", "liquidity", "change_24h", "buys", "sells", "created_at")


@query("norm_birdeye", SNAP + """SELECT address, symbol, price, CASE WHEN token % 3 = 0 THEN 0 ELSE market_cap END AS market_cap, volume_24h, change_24h, 0 AS holders
FROM snap WHERE market_cap <= 300000 UNION ALL
SELECT address, symbol, price, CASE WHEN token % 3 = 0 THEN 0 ELSE market_cap END, volume_24h, change_24h, holders FROM snap WHERE market_cap > 300000""")
def norm_birdeye(spark, sf):
    """Both dialects of the vendor: the long one for small tokens, the short one for the others."""
    c, s = F.col, b.snapshots(spark, sf)
    long = payload(s.filter("market_cap <= 300000"), "address", "symbol", "price", "liquidity", c("volume_24h").alias("v24hUSD"),
                   missing(3, c("market_cap")).alias("marketCap"), c("change_24h").alias("priceChange24h"))
    short = payload(s.filter("market_cap > 300000"), "address", "symbol", "price", "liquidity", c("volume_24h").alias("v24h"),
                    missing(3, c("market_cap")).alias("mc"), c("change_24h").alias("v24hChangePercent"), c("holders").alias("uniqueWallet24h"))
    cols = ["address", "symbol", "price", "market_cap", "volume_24h", "change_24h", "holders"]
    a = vendors.norm_token_list(vendors.parse(long, "raw", vendors.TOKEN_LIST)).withColumn("holders", F.lit(0).cast("bigint"))
    return a.select(*cols).unionByName(vendors.norm_token_list_short(vendors.parse(short, "raw", vendors.TOKEN_LIST_SHORT)).select(*cols))


@query("norm_trending", SNAP + """SELECT CASE WHEN token % 4 = 0 THEN 'unknown' ELSE chain END AS chain, address, symbol,
  CASE WHEN token % 7 = 0 THEN 0 ELSE holders::DOUBLE END AS price, CASE WHEN token % 6 = 0 THEN 0 ELSE holders * 1000.0::DOUBLE END AS market_cap, CASE WHEN token % 9 = 0 THEN 0 ELSE buys * 1000000.0::DOUBLE END AS volume_24h, change_24h FROM snap""")
def norm_trending(spark, sf):
    return trending(spark, sf).select("chain", "address", "symbol", "price", "market_cap", "volume_24h", "change_24h")


@query("norm_trending_by_id", SNAP + "SELECT CASE WHEN token % 2 = 0 THEN 'solana' ELSE 'ethereum' END AS chain, address, symbol FROM snap")
def norm_trending_by_id(spark, sf):
    """The dialect without a platform: the chain is told by the id."""
    return trending(spark, sf, by_id=True).select("chain", "address", "symbol")


def trending(spark, sf, by_id=False):
    c = F.col
    data = F.struct(F.when(c("token") % 7 == 0, F.lit(None).cast("string")).otherwise(F.concat(F.lit("$"), "holders")).alias("price"),
                    F.when(c("token") % 6 == 0, "N/A").otherwise(F.concat(F.lit("$"), "holders", F.lit("K"))).alias("market_cap"),
                    F.when(c("token") % 9 == 0, "1.2T").otherwise(F.concat(F.lit("$"), "buys", F.lit(".0M"))).alias("total_volume"),
                    F.struct(c("change_24h").alias("usd")).alias("price_change_percentage_24h"))
    prefix = F.when(c("token") % 2 == 0, "solana-").otherwise("eth-")
    item = F.struct(F.concat(prefix, "symbol").alias("id"), c("symbol"), missing(4, c("chain")).alias("platform_id"), c("address").alias("contract_address"), data.alias("data"))
    raw = payload(b.snapshots(spark, sf), F.array(F.struct(item.alias("item"))).alias("coins"))
    return vendors.norm_trending(vendors.parse(raw, "raw", vendors.TRENDING), by_id)


@query("norm_gmgn", SNAP + "SELECT CASE WHEN token % 4 = 0 THEN 'solana' ELSE chain END AS chain, address, symbol, price, liquidity, holders FROM snap")
def norm_gmgn(spark, sf):
    c = F.col
    t = F.struct("symbol", "address", missing(4, c("chain")).alias("chain"), "price", "liquidity", c("holders").alias("holder_count"))
    raw = payload(b.snapshots(spark, sf), F.struct(F.array(t).alias("tokens")).alias("data"))
    return vendors.norm_ranked(vendors.parse(raw, "raw", vendors.RANKED)).select("chain", "address", "symbol", "price", "liquidity", "holders")


@query("norm_ohlcv", with_(BARS) + """SELECT token::VARCHAR AS token, epoch_ms(bucket) // 1000 AS ts, o, h, l, c, v, 'object' AS form FROM bars
UNION ALL SELECT token::VARCHAR, epoch_ms(bucket) // 1000, o, h, l, c, 0, 'array' FROM bars""")
def norm_ohlcv(spark, sf):
    c = written(pool_candles(spark, sf), "pool-candles")  # built once for the two forms
    t = F.col("token").cast("string").alias("token")
    sec = epoch("bucket")
    obj = payload(c, t, F.array(F.struct(sec.alias("unixTime"), *"ohlcv")).alias("items"))
    arr = payload(c, t, F.array(F.array((sec * 1000).cast("double"), *"ohlc")).alias("items"))
    return (vendors.norm_ohlcv(vendors.parse(obj, "raw", vendors.OHLCV)).withColumn("form", F.lit("object"))
            .unionByName(vendors.norm_ohlc(vendors.parse(arr, "raw", vendors.OHLC)).withColumn("form", F.lit("array"))))


@query("flat_candles", SNAP + "SELECT address, created_at AS ts, price AS o, price AS h, price AS l, price AS c, volume_24h AS v, market_cap AS marketcap, liquidity FROM snap")
def flat_candles(spark, sf):
    return vendors.pair_as_candle(b.snapshots(spark, sf), F.col("created_at"))


@query("wallet_tx_explode", with_(b.TRADES_SQL) + """SELECT 'w_' || wallet AS wallet, 'tok_' || token AS token, epoch_ms(ts) // 1000 AS at, qty AS amount,
  CASE WHEN order_id % 4 = 0 THEN NULL ELSE value_usd END AS value_usd FROM t
WHERE side = 'buy' AND ts >= TIMESTAMP '2001-10-06' AND order_id % 3 < 2 + (line_no % 2)""")
def wallet_tx_explode(spark, sf):
    """Transactions with a time as number, as ISO text, in the other field, or without one."""
    c, t = F.col, b.trades(spark, sf, wallets=True)
    sec = epoch("ts")
    stamp = (F.when(c("order_id") % 3 == 0, sec.cast("string"))
             .when(c("order_id") % 3 == 1, F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss'Z'")))
    gain = F.struct(F.when(c("side") == "buy", "inc").otherwise("dec").alias("changeType"), F.concat(F.lit("tok_"), "token").alias("tokenAddress"),
                    c("qty").alias("amount"), F.when(c("order_id") % 4 != 0, c("value_usd")).alias("valueUSD"))
    paid = F.struct(F.lit("inc").alias("changeType"), F.lit("usd").alias("tokenAddress"), F.lit(0.0).alias("amount"), F.lit(0.0).alias("valueUSD"))
    raw = payload(t, F.concat(F.lit("w_"), "wallet").alias("wallet"), stamp.alias("timestamp"),
                  F.when((c("order_id") % 3 == 2) & (c("line_no") % 2 == 1), sec).alias("blockTime"), F.array(gain, paid).alias("tokenChanges"))
    x = vendors.wallet_buys(vendors.parse(raw, "raw", vendors.WALLET_TX), epoch(ntz(b.AS_OF)), hours=24 * 30)
    return x.select("wallet", "token", "at", "amount", "value_usd")


def scan_lines(spark, sf):
    """Scanner output of every token: header, price, change, market cap and, on one chain, the explorer link."""
    s = b.snapshots(spark, sf).withColumn("sym", F.translate(F.col("token").cast("string"), "0123456789", "ABCDEFGHIJ"))
    head = F.concat(F.lit("1. 📈 Coin "), "token", F.lit(" ($"), F.when(F.col("chain") == "BSC", F.lower("sym")).otherwise(F.col("sym")), F.lit(") [PAIR]"))
    link = F.when(F.col("chain") == "solana", F.concat(F.lit("   🔍 Solscan: https://solscan.io/token/T"), "token")).otherwise("   🔍 none")
    texts = F.array(head, F.concat(F.lit("   💰 Price: $"), "buys"), F.concat(F.lit("   📊 24h: +"), "holders", F.lit(".5% | Vol: $"), "sells"),
                    F.concat(F.lit("   🏦 MC: $"), F.format_number("market_cap", 0), F.lit(" ✅")), link)
    lines = s.select(F.concat(F.lit("run"), F.col("token") % 3).alias("file"), "token", F.posexplode(texts).alias("i", "value"))
    return lines.select("file", (F.col("token") * 5 + F.col("i")).alias("line_no"), "value")


@query("scan_log_blocks", with_(b.SNAP_SQL, """
q AS (SELECT *, 'run' || token % 3 AS file FROM snap),
h AS (SELECT *, count(*) FILTER (chain <> 'BSC') OVER (PARTITION BY file ORDER BY token) AS blk FROM q),
first_ AS (SELECT file, blk, min(token) FILTER (chain <> 'BSC') AS head, min(token) FILTER (chain = 'solana') AS link FROM h GROUP BY 1, 2),
last_ AS (SELECT f.file, f.head, f.link, f.link AS closing FROM first_ f WHERE head IS NOT NULL AND link IS NOT NULL)""") + """
SELECT l.file, 'Coin ' || l.head AS name, translate(l.head::VARCHAR, '0123456789', 'ABCDEFGHIJ') AS symbol, '$' || s.buys AS price,
  (s.holders || '.5')::DOUBLE AS change_24h, round_even(s.market_cap, 0)::BIGINT AS market_cap, 'T' || l.closing AS address FROM last_ l JOIN snap s ON s.token = l.closing""")
def scan_log_blocks(spark, sf):
    return logs.scan_blocks(raw(spark, scan_lines(spark, sf)))


def raw(spark, lines):
    """Lines written as rotated raw logs, one folder for each, and read back from the text alone."""
    path = shared_dir(spark, "raw-logs")
    ordered = lines.repartitionByRange("file", "line_no").sortWithinPartitions("file", "line_no")
    ordered.select("file", "value").write.partitionBy("file").text(path)
    return logs.read_lines(spark, path, "file")


def run_lines(spark, sf):
    """One logged run per day of events."""
    e = b.table(spark, sf, "events").groupBy(F.to_date("ts").alias("day")).agg(
        F.count(F.lit(1)).alias("n"), *[F.count_if(F.col("event_type") == k).alias(k) for k in ("view", "click", "error", "signup")])
    at = [F.concat(F.lit("["), F.date_format("day", "yyyy-MM-dd"), F.lit(f"T10:00:{s:02d}Z] ")) for s in (0, 3, 3, 3, 8)]
    texts = F.array(F.concat(at[0], F.lit("=== Multi-Source Memecoin Scanner v5 ===")), F.concat(at[1], F.lit("Total unique tokens found: "), "n"),
                    F.concat(at[2], F.lit("Filtered out "), "view", F.lit(" tokens < 4 days (too fresh)")),
                    F.concat(at[3], F.lit("Tokens in sweet spot (4-10 days): "), "click"),
                    F.concat(at[4], F.lit("Complete: "), "error", F.lit(" sweet spot matches, "), "signup", F.lit(" others")))
    return e.select(F.date_format("day", "yyyy-MM").alias("file"), F.dayofmonth("day").alias("d"), F.posexplode(texts).alias("i", "value")).select(
        "file", (F.col("d") * 10 + F.col("i")).cast("bigint").alias("line_no"), "value")


@query("scan_log_metrics", """SELECT strftime(day, '%Y-%m') AS file, row_number() OVER (ORDER BY day) AS run, n AS unique_tokens, v AS too_fresh, 0::BIGINT AS too_old, c AS in_window,
  e AS matches, s AS others, 8::BIGINT AS seconds FROM (SELECT ts::DATE AS day, count(*) AS n, count(*) FILTER (event_type = 'view') AS v,
  count(*) FILTER (event_type = 'click') AS c, count(*) FILTER (event_type = 'error') AS e, count(*) FILTER (event_type = 'signup') AS s FROM events GROUP BY 1)""")
def scan_log_metrics(spark, sf):
    return logs.run_metrics(raw(spark, run_lines(spark, sf)))


@query("watchlist_read", with_(b.WATCH_SQL) + "SELECT symbol, name, address, added_date FROM watch")
def watchlist_read(spark, sf):
    path = shared_dir(spark, "watchlist")
    b.watchlist(spark, sf).write.json(path)
    return tables.read_watchlist(spark, path).select("symbol", "name", "address", "added_date")


@query("thresholds", """SELECT key, coalesce(o.value, d.value) AS value FROM (VALUES ('min_transaction_usd', 10000.0::DOUBLE), ('convergence_min_whales', 3),
  ('divergence_threshold', 0.05), ('exchange_flow_threshold', 500000)) d(key, value) FULL JOIN (SELECT 'exchange_flow_threshold' AS key, max(l_extendedprice) AS value FROM lineitem
  UNION ALL SELECT 'max_quantity', max(l_quantity) FROM lineitem) o USING (key)""")
def thresholds(spark, sf):
    top = b.table(spark, sf, "lineitem").agg(F.max("l_extendedprice").alias("p"), F.max("l_quantity").alias("q"))
    o = top.select(F.explode(F.create_map(F.lit("exchange_flow_threshold"), "p", F.lit("max_quantity"), "q")).alias("key", "value"))
    return tables.thresholds(spark, o)


@query("snapshot_write", ENRICHED_SQL + """SELECT DATE '2001-11-04' AS date, status, count(*) AS tokens FROM s4 WHERE status = 'REJECT' GROUP BY status
UNION ALL SELECT DATE '2001-11-05', status, count(*) FROM s4 GROUP BY status""")
def snapshot_write(spark, sf):
    """Two days written, the second one twice: it replaces itself and leaves the first alone."""
    path = shared_dir(spark, "snapshots")
    s = written(scored_tokens(spark, sf).select("token", "status", "composite", "confirmations"), "scored")  # scored once for the three writes
    days = [F.lit(d).cast("date") for d in ("2001-11-04", "2001-11-05")]
    tables.write_snapshot(s.filter("status = 'REJECT'"), path, days[0])
    tables.write_snapshot(s.filter("status = 'REJECT'"), path, days[1])
    tables.write_snapshot(s, path, days[1])
    return spark.read.parquet(path).groupBy("date", "status").agg(F.count(F.lit(1)).alias("tokens"))


@query("alert_sink", "SELECT event_id, CASE WHEN value > 50 THEN 2 ELSE 1 END AS batch_id FROM events WHERE event_type = 'error'")
def alert_sink(spark, sf):
    """Two batches of alerts, the second one delivered twice."""
    path = shared_dir(spark, "alerts")
    a = b.table(spark, sf, "events").filter("event_type = 'error'").select("event_id", "value")
    for batch, part in ((1, "value <= 50"), (2, "value > 50"), (2, "value > 50")):
        tables.write_alerts(a.filter(part).select("event_id"), path, batch)
    return spark.read.parquet(path)


@query("history_append_trim", """SELECT key, event_id, price FROM (SELECT event_type AS key, event_id, value AS price,
  row_number() OVER (PARTITION BY event_type ORDER BY ts DESC, event_id DESC) AS rn FROM events) WHERE rn <= 100""")
def history_append_trim(spark, sf):
    c, cut = b.checks(spark, sf), ntz("2024-01-29 00:00:00")
    return tables.append_trim(c.filter(F.col("ts") < cut), c.filter(F.col("ts") >= cut), "key", ["ts", "event_id"]).select("key", "event_id", "price")
