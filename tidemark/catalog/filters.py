"""Row filters and labels."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark import bindings as b
from tidemark import fixed
from tidemark.catalog.base import query, with_
from tidemark.catalog.joins import tracked
from tidemark.functions import text
from tidemark.functions.values import epoch, epoch_any, ntz
from tidemark.operators import filters as fl

SNAP = with_(b.SNAP_SQL)
AS_OF_SQL = "TIMESTAMP '2001-11-05'"


def as_of():
    return epoch(ntz(b.AS_OF))


@query("target_band", SNAP + """SELECT token, market_cap, liquidity FROM snap
WHERE market_cap >= 100000 AND market_cap <= 500000 AND liquidity >= 10000""")
def target_band(spark, sf):
    return fl.target_band(b.snapshots(spark, sf)).select("token", "market_cap", "liquidity")


@query("trading_rules", SNAP + """SELECT token, CASE WHEN market_cap < 100000 THEN 'mc_low' WHEN market_cap > 500000 THEN 'mc_high'
  WHEN liquidity < 50000 AND liquidity > 0 THEN 'liquidity_low' WHEN volume_24h < 50000 THEN 'volume_low' ELSE 'match' END AS verdict
FROM snap""")
def trading_rules(spark, sf):
    return b.snapshots(spark, sf).select("token", fl.trading_rule().alias("verdict"))


@query("source_prebands", with_(b.LISTINGS_SQL) + """SELECT source, pos, market_cap FROM listings
WHERE CASE source WHEN 'AF' THEN market_cap BETWEEN 10000 AND 2000000 WHEN 'NF' THEN market_cap BETWEEN 50000 AND 1000000 ELSE true END""")
def source_prebands(spark, sf):
    latest, top = fixed.SOURCE_BANDS["latest"], fixed.SOURCE_BANDS["top_volume"]
    return (b.listings(spark, sf).filter(fl.source_preband(bands={"AF": latest, "NF": top}))
            .select("source", "pos", "market_cap"))


@query("chain_allow", SNAP + """SELECT token, lower(chain) AS chain, address FROM snap
WHERE lower(chain) IN ('solana', 'ethereum', 'base') AND address <> ''""")
def chain_allow(spark, sf):
    return fl.allowed_chain(b.snapshots(spark, sf)).select("token", "chain", "address")


@query("age_filter_discovery", SNAP + f"""SELECT token, created_at FROM snap
WHERE created_at IS NULL OR (epoch({AS_OF_SQL}) - epoch(created_at)) / 3600 <= 72""")
def age_filter_discovery(spark, sf):
    return (b.snapshots(spark, sf).filter(fl.young_enough(epoch("created_at"), as_of())).select("token", "created_at"))


CREATED_SQL = """
cr AS (SELECT *, CASE WHEN token % 3 = 0 THEN NULL WHEN token % 3 = 1 THEN epoch_ms(created_at) ELSE epoch_ms(created_at) // 1000 END
        AS raw FROM snap)"""


def created(spark, sf):
    """Creation times as vendors send them: milliseconds, seconds or nothing."""
    sec = epoch("created_at")
    raw = F.when(F.col("token") % 3 == 0, None).when(F.col("token") % 3 == 1, sec * 1000).otherwise(sec)
    return b.snapshots(spark, sf).withColumn("raw", raw)


AGE_SQL = """
aged AS (SELECT *, CASE WHEN raw IS NOT NULL THEN ((epoch(TIMESTAMP '2001-11-05')::BIGINT - CASE WHEN raw > 1e10 THEN raw // 1000 ELSE raw END) // 86400)::INT
        WHEN market_cap > 0 AND volume_24h / market_cap > 0.1::DOUBLE THEN 5 ELSE 0 END AS age FROM cr)"""


@query("coin_age", with_(b.SNAP_SQL, CREATED_SQL, AGE_SQL) + """
SELECT token, age, CASE WHEN age < 4 THEN 'too_fresh' WHEN age > 10 THEN 'too_old' ELSE 'sweet_spot' END AS age_class FROM aged""")
def coin_age(spark, sf):
    c = created(spark, sf).withColumn("age", fl.age_or_estimate(epoch_any("raw"), as_of()))
    return c.select("token", "age", fl.age_class(F.col("age")).alias("age_class"))


@query("age_days_simple", with_(b.SNAP_SQL, CREATED_SQL) + """
SELECT token, CASE WHEN coalesce(raw, 0) = 0 THEN 0 ELSE ((epoch(TIMESTAMP '2001-11-05')::BIGINT
  - CASE WHEN raw > 1e10 THEN raw // 1000 ELSE raw END) // 86400)::INT END AS age FROM cr""")
def age_days_simple(spark, sf):
    return created(spark, sf).select("token", fl.age_days(epoch_any("raw"), as_of()).alias("age"))


@query("momentum_split", SNAP + """SELECT token, change_24h, CASE WHEN change_24h < -5 THEN 'falling'
  WHEN change_24h > 200 THEN 'parabolic' ELSE 'keep' END AS momentum FROM snap""")
def momentum_split(spark, sf):
    return b.snapshots(spark, sf).select("token", "change_24h", fl.momentum_class().alias("momentum"))


@query("target_split", SNAP + """SELECT token, CASE WHEN market_cap BETWEEN 100000 AND 500000 THEN 'match'
  WHEN market_cap <= 0 THEN NULL WHEN market_cap < 100000 THEN 'micro' ELSE 'large' END AS kind FROM snap""")
def target_split(spark, sf):
    return b.snapshots(spark, sf).select("token", fl.target_class().alias("kind"))


@query("discovery_config_filter", SNAP + """SELECT token, (change_24h > 50) AS flagged FROM snap
WHERE market_cap <= 100000000 AND volume_24h >= 100000 AND change_24h BETWEEN -50 AND 200
  AND lower(chain) IN ('solana', 'ethereum', 'base')""")
def discovery_config_filter(spark, sf):
    cfg = {**fixed.DISCOVERY, "min_volume": 100_000}
    return (b.snapshots(spark, sf).filter(fl.discovery_pass(cfg))
            .select("token", (F.col("change_24h") > cfg["flag_gain"]).alias("flagged")))


@query("launch_filter", SNAP + """SELECT token, market_cap, holders, change_24h FROM snap
WHERE market_cap BETWEEN 50000 AND 1000000 AND holders >= 20 ORDER BY change_24h DESC, token LIMIT 20""")
def launch_filter(spark, sf):
    return fl.launches(b.snapshots(spark, sf), min_holders=20).select("token", "market_cap", "holders", "change_24h")


@query("large_transfers", """SELECT l_orderkey AS order_id, l_linenumber AS line_no, l_extendedprice AS value_usd, l_shipdate AS ts
FROM lineitem JOIN orders ON l_orderkey = o_orderkey WHERE l_extendedprice >= 10000
  AND o_custkey IN (SELECT c_custkey FROM customer WHERE c_acctbal > 9000)
ORDER BY l_shipdate DESC, l_orderkey DESC, l_linenumber DESC, l_extendedprice DESC LIMIT 50""")
def large_transfers(spark, sf):
    t = b.trades(spark, sf, wallets=True).filter(F.col("value_usd") >= fixed.MIN_TRANSACTION_USD)
    t = t.join(tracked(spark, sf), "wallet", "left_semi")
    newest = [F.col(c).desc() for c in ("ts", "order_id", "line_no", "value_usd")]
    return t.orderBy(*newest).limit(fixed.LARGE_TRANSFER_LIMIT).select("order_id", "line_no", "value_usd", "ts")


@query("change_label", SNAP + """SELECT token, CASE WHEN change_24h > 50 THEN 'surging' WHEN change_24h > 20 THEN 'rising'
  WHEN change_24h > 0 THEN 'up' ELSE 'down' END AS label, (change_24h > 50) AS high_volatility FROM snap""")
def change_label(spark, sf):
    c = F.col("change_24h")
    return b.snapshots(spark, sf).select("token", fl.change_label(c).alias("label"), (c > 50).alias("high_volatility"))


@query("mc_label", SNAP + """SELECT token, CASE WHEN market_cap <= 0 THEN NULL WHEN market_cap BETWEEN 100000 AND 500000
  THEN 'sweet_spot' WHEN market_cap < 100000 THEN 'below' ELSE 'above' END AS label FROM snap""")
def mc_label(spark, sf):
    return b.snapshots(spark, sf).select("token", fl.mc_label(F.col("market_cap")).alias("label"))


@query("explorer_links", SNAP + """SELECT token, CASE chain WHEN 'base' THEN 'https://basescan.org/token/' || address
  WHEN 'solana' THEN 'https://solscan.io/token/' || address ELSE '' END AS explorer,
  'https://app.bubblemaps.io/' || chain || '/token/' || address AS bubble_map, left(address, 12) || '...' AS short FROM snap""")
def explorer_links(spark, sf):
    chain, address = F.col("chain"), F.col("address")
    return b.snapshots(spark, sf).select("token", text.explorer(chain, address).alias("explorer"),
                                         text.bubble_map(chain, address).alias("bubble_map"),
                                         text.short_address(address).alias("short"))


@query("table_filters", """SELECT event_id AS id, ts AS created_at FROM events
WHERE (event_type = 'click' OR event_type = 'error') AND value > 20 ORDER BY ts DESC, event_id DESC LIMIT 10""")
def table_filters(spark, sf):
    """Inbox of one agent: clicks are addressed to it, errors are broadcast, small values were read."""
    e = b.table(spark, sf, "events")
    to = F.when(F.col("event_type") == "error", None).otherwise(F.col("event_type"))
    m = e.select(F.col("event_id").alias("id"), F.col("ts").alias("created_at"), to.alias("to_agent"),
                 (F.col("value") <= 20).alias("read"))
    return fl.inbox(m, "click").select("id", "created_at")


HEALTH_SQL = """
svc AS (SELECT o_orderkey AS id, CASE o_orderstatus WHEN 'F' THEN 'stopped' WHEN 'O' THEN 'running' ELSE
        (['error', 'crashed', 'restarting'])[(o_custkey % 3 + 1)::INT] END AS status,
        CASE WHEN o_orderpriority = '1-URGENT' THEN 'unhealthy' ELSE 'healthy' END AS health FROM orders)"""


@query("service_health", with_(HEALTH_SQL) + """SELECT id, status, health FROM svc
WHERE status NOT IN ('running', 'stopped') AND (health = 'unhealthy' OR status IN ('error', 'crashed'))""")
def service_health(spark, sf):
    o = b.table(spark, sf, "orders")
    odd = F.element_at(F.array(F.lit("error"), F.lit("crashed"), F.lit("restarting")), (F.col("o_custkey") % 3 + 1).cast("int"))
    status = F.when(F.col("o_orderstatus") == "F", "stopped").when(F.col("o_orderstatus") == "O", "running").otherwise(odd)
    health = F.when(F.col("o_orderpriority") == "1-URGENT", "unhealthy").otherwise("healthy")
    s = o.select(F.col("o_orderkey").alias("id"), status.alias("status"), health.alias("health"))
    return s.filter(fl.service_down(F.col("status"), F.col("health")))


@query("symbol_signals", """SELECT 'PURCHASE' AS token, count(*) AS count FROM events WHERE lower(event_type) = lower('PURCHASE')""")
def symbol_signals(spark, sf):
    return fl.symbol_signals(b.table(spark, sf, "events").select(F.col("event_type").alias("token")), "PURCHASE")
