"""Domain tables derived from the driver's parquet tables.

Money sums are rounded to the cents they consist of, so that sums do not depend on the order in which
partitions are added up and downstream thresholds are reproducible.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions.values import nz, ntz, pct_change

AS_OF = "2001-11-05 00:00:00"
EVENTS_AS_OF = "2024-01-31 00:00:00"
RECENT_FROM = "2001-05-01 00:00:00"
SUPPLY_FROM = "2000-06-01 00:00:00"
DAY_3 = 259_200


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def sequence():
    """Order of trades as one number: time in microseconds, order, line. It fits an aggregation buffer, a struct does not."""
    micros = F.unix_micros(F.col("l_shipdate").cast("timestamp")).cast("decimal(20,0)")
    within = (F.col("l_orderkey").cast("decimal(15,0)") * F.lit(100) + F.col("l_linenumber")).cast("decimal(17,0)")
    return (micros * F.lit(10**17).cast("decimal(18,0)") + within).cast("decimal(38,0)")


def trades(spark: SparkSession, sf: str, token: str = "l_partkey", wallets: bool = False,
           since: str | None = None) -> DataFrame:
    """One row per line item; joined to orders only when the wallet is needed."""
    t = table(spark, sf, "lineitem")
    if since:
        t = t.filter(F.col("l_shipdate") >= ntz(since))
    if wallets:
        t = t.join(table(spark, sf, "orders").select("o_orderkey", "o_custkey"),
                   F.col("l_orderkey") == F.col("o_orderkey"))
    return t.select(
        F.col(token).alias("token"),
        *([F.col("o_custkey").alias("wallet")] if wallets else []),
        F.col("l_shipdate").alias("ts"),
        sequence().alias("seq"),
        F.col("l_orderkey").alias("order_id"),
        F.col("l_linenumber").alias("line_no"),
        F.col("l_quantity").alias("qty"),
        (F.col("l_extendedprice") / F.col("l_quantity")).alias("price"),
        F.col("l_extendedprice").alias("value_usd"),
        F.col("l_discount").alias("discount"),
        F.when(F.col("l_returnflag") == "R", "sell").otherwise("buy").alias("side"),
        F.col("l_returnflag").alias("flag"),
        F.col("l_linestatus").alias("line_status"),
    )


TRADE_ORDER = ["ts", "order_id", "line_no", "price"]

TRADES_SQL = """
t AS (SELECT l_partkey AS token, l_suppkey AS pool, l_shipdate AS ts, l_orderkey AS order_id, l_linenumber AS line_no,
        l_quantity AS qty, l_extendedprice / l_quantity AS price, l_extendedprice AS value_usd, l_discount AS discount,
        CASE WHEN l_returnflag = 'R' THEN 'sell' ELSE 'buy' END AS side, l_returnflag AS flag,
        l_linestatus AS line_status, o_custkey AS wallet
      FROM lineitem JOIN orders ON l_orderkey = o_orderkey)"""


def last_price():
    """Price of the latest trade; hash aggregation, combined before the shuffle without a sort."""
    return F.max_by("price", "seq")


def snapshots(spark: SparkSession, sf: str) -> DataFrame:
    """One market snapshot per token (part)."""
    t = trades(spark, sf)
    recent, supply = F.col("ts") >= ntz(RECENT_FROM), F.col("ts") >= ntz(SUPPLY_FROM)
    agg = t.groupBy("token").agg(
        last_price().alias("price"),
        F.round(F.sum("value_usd"), 2).alias("value_all"),
        F.sum("qty").alias("qty_all"),
        F.round(nz(F.sum(F.when(supply, F.col("value_usd")))), 2).alias("market_cap"),
        F.round(nz(F.sum(F.when(recent, F.col("value_usd")))), 2).alias("volume_24h"),
        F.round(nz(F.sum(F.when(supply, F.col("value_usd") * F.col("discount")))) + 0.0, 4).alias("liquidity"),
        F.count_if(F.col("side") == "buy").alias("buys"),
        F.count_if(F.col("side") == "sell").alias("sells"),
        F.count(F.lit(1)).alias("holders"),
        F.max("ts").alias("created_at"),
    )
    return agg.select(
        "token",
        F.concat(F.lit("TOK"), F.col("token")).alias("symbol"),
        F.concat(F.lit("tok_"), F.col("token")).alias("address"),
        F.element_at(F.array(*[F.lit(c) for c in ("solana", "ethereum", "base", "BSC")]),
                     (F.col("token") % 4 + 1).cast("int")).alias("chain"),
        "price", "market_cap", "volume_24h", "liquidity",
        pct_change(F.col("price"), F.col("value_all") / F.col("qty_all")).alias("change_24h"),
        "buys", "sells", "holders", "created_at",
        F.date_diff(F.lit(AS_OF[:10]).cast("date"), F.to_date("created_at")).alias("age_days"),
    )


SNAP_SQL = """
snap AS (SELECT token, 'TOK' || token AS symbol, 'tok_' || token AS address,
        (['solana', 'ethereum', 'base', 'BSC'])[(token % 4 + 1)::INT] AS chain, price, market_cap, volume_24h, liquidity,
        (price / (value_all / qty_all) - 1.0::DOUBLE) * 100.0::DOUBLE AS change_24h, buys, sells, holders, created_at,
        date_diff('day', created_at::DATE, DATE '2001-11-05')::INT AS age_days
      FROM (SELECT l_partkey AS token,
              arg_max(l_extendedprice / l_quantity,
                      (l_shipdate, l_orderkey, l_linenumber, l_extendedprice / l_quantity)) AS price,
              round(sum(l_extendedprice), 2) AS value_all, sum(l_quantity) AS qty_all,
              round(coalesce(sum(l_extendedprice) FILTER (l_shipdate >= TIMESTAMP '2000-06-01'), 0), 2) AS market_cap,
              round(coalesce(sum(l_extendedprice) FILTER (l_shipdate >= TIMESTAMP '2001-05-01'), 0), 2) AS volume_24h,
              round(coalesce(sum(l_extendedprice * l_discount) FILTER (l_shipdate >= TIMESTAMP '2000-06-01'), 0)
                    + 0.0::DOUBLE, 4) AS liquidity,
              count(*) FILTER (l_returnflag <> 'R') AS buys, count(*) FILTER (l_returnflag = 'R') AS sells,
              count(*) AS holders, max(l_shipdate) AS created_at
            FROM lineitem GROUP BY l_partkey))"""


def listings(spark: SparkSession, sf: str) -> DataFrame:
    """Vendor listings: the same token offered by several sources, some without a contract."""
    t = trades(spark, sf)
    agg = t.groupBy("token", "flag", "line_status").agg(
        last_price().alias("price"),
        F.round(F.sum("value_usd"), 2).alias("market_cap"),
        F.round(nz(F.sum(F.when(F.col("ts") >= ntz(RECENT_FROM), F.col("value_usd")))), 2).alias("volume_24h"),
        F.sum("qty").alias("qty_all"),
        F.max(F.when(F.col("token") % 3 != 0, F.col("ts"))).alias("created_at"),  # many vendors send no creation time
    )
    rank = (F.when(F.col("flag") == "A", 0).when(F.col("flag") == "N", 2).otherwise(4)
            + F.when(F.col("line_status") == "F", 0).otherwise(1))
    return agg.select(
        F.concat("flag", "line_status").alias("source"), rank.alias("source_rank"), F.col("token").alias("pos"),
        F.when(F.col("token") % 2 == 0, "solana").otherwise("base").alias("platform"),
        F.when(F.col("token") % 11 == 0, "").otherwise(F.concat(F.lit("tok_"), F.col("token"))).alias("contract"),
        F.concat(F.lit("TOK"), F.col("token")).alias("symbol"),
        "price", "market_cap", "volume_24h",
        pct_change(F.col("price"), F.col("market_cap") / F.col("qty_all")).alias("change_24h"),
        "created_at",
    )


LISTINGS_SQL = """
listings AS (SELECT l_returnflag || l_linestatus AS source,
        CASE l_returnflag WHEN 'A' THEN 0 WHEN 'N' THEN 2 ELSE 4 END + CASE l_linestatus WHEN 'F' THEN 0 ELSE 1 END
          AS source_rank,
        l_partkey AS pos, CASE WHEN l_partkey % 2 = 0 THEN 'solana' ELSE 'base' END AS platform,
        CASE WHEN l_partkey % 11 = 0 THEN '' ELSE 'tok_' || l_partkey END AS contract, 'TOK' || l_partkey AS symbol,
        arg_max(l_extendedprice / l_quantity, (l_shipdate, l_orderkey, l_linenumber, l_extendedprice / l_quantity))
          AS price,
        round(sum(l_extendedprice), 2) AS market_cap,
        round(coalesce(sum(l_extendedprice) FILTER (l_shipdate >= TIMESTAMP '2001-05-01'), 0), 2) AS volume_24h,
        (arg_max(l_extendedprice / l_quantity, (l_shipdate, l_orderkey, l_linenumber, l_extendedprice / l_quantity))
          / (round(sum(l_extendedprice), 2) / sum(l_quantity)) - 1.0::DOUBLE) * 100.0::DOUBLE AS change_24h,
        max(CASE WHEN l_partkey % 3 <> 0 THEN l_shipdate END) AS created_at
      FROM lineitem GROUP BY l_partkey, l_returnflag, l_linestatus)"""

LISTING_AGE_SQL = """CASE WHEN created_at IS NOT NULL THEN date_diff('day', created_at::DATE, DATE '2001-11-05')
        WHEN market_cap > 0 AND volume_24h / market_cap > 0.1::DOUBLE THEN 5 ELSE 0 END"""


def checks(spark: SparkSession, sf: str) -> DataFrame:
    """Monitor checks: one value per event, keyed by event type."""
    return table(spark, sf, "events").select(
        F.col("event_type").alias("key"), "ts", "event_id", F.col("value").alias("price"), F.col("user_id").alias("wallet"))


def watchlist(spark: SparkSession, sf: str) -> DataFrame:
    """Parts of one brand, as if added by hand; some of them never traded."""
    p = table(spark, sf, "part")
    return p.filter(F.col("p_brand").isin("Brand#3", "Brand#7")).select(
        F.col("p_partkey").alias("token"), F.concat(F.lit("tok_"), F.col("p_partkey")).alias("address"),
        F.concat(F.lit("TOK"), F.col("p_partkey")).alias("symbol"), F.col("p_name").alias("name"),
        F.date_sub(F.lit(AS_OF[:10]).cast("date"), F.col("p_size") % 16).alias("added_date"))


WATCH_SQL = """
watch AS (SELECT p_partkey AS token, 'tok_' || p_partkey AS address, 'TOK' || p_partkey AS symbol, p_name AS name,
        DATE '2001-11-05' - (p_size % 16)::INT AS added_date
      FROM part WHERE p_brand IN ('Brand#3', 'Brand#7'))"""
