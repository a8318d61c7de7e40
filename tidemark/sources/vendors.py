"""Vendor payloads to one snapshot schema.

Every dialect has an explicit schema, so reading needs no inference pass and nested fields are pruned.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions import text as tx
from tidemark.functions.values import epoch_any, nz

PAIRS = ("chainId STRING, tokenAddress STRING, pairAddress STRING, dexId STRING, url STRING, priceUsd STRING, marketCap DOUBLE, "
         "pairCreatedAt BIGINT, baseToken STRUCT<address: STRING, symbol: STRING, name: STRING>, liquidity STRUCT<usd: DOUBLE>, "
         "volume STRUCT<h24: DOUBLE>, priceChange STRUCT<h24: DOUBLE>, txns STRUCT<h24: STRUCT<buys: BIGINT, sells: BIGINT>>")
TOKEN_LIST = "address STRING, symbol STRING, name STRING, price DOUBLE, liquidity DOUBLE, v24hUSD DOUBLE, marketCap DOUBLE, priceChange24h DOUBLE"
TOKEN_LIST_SHORT = ("address STRING, symbol STRING, name STRING, price DOUBLE, liquidity DOUBLE, v24h DOUBLE, mc DOUBLE, "
                    "v24hChangePercent DOUBLE, uniqueWallet24h BIGINT")
TRENDING = ("coins ARRAY<STRUCT<item: STRUCT<id: STRING, name: STRING, symbol: STRING, platform_id: STRING, contract_address: STRING, "
            "data: STRUCT<price: STRING, market_cap: STRING, total_volume: STRING, price_change_percentage_24h: STRUCT<usd: DOUBLE>>>>>")
RANKED = ("data STRUCT<tokens: ARRAY<STRUCT<symbol: STRING, name: STRING, address: STRING, chain: STRING, price: DOUBLE, market_cap: DOUBLE, "
          "volume_24h: DOUBLE, price_change_24h: DOUBLE, liquidity: DOUBLE, holder_count: BIGINT>>>")
OHLCV = "token STRING, items ARRAY<STRUCT<unixTime: BIGINT, o: DOUBLE, h: DOUBLE, l: DOUBLE, c: DOUBLE, v: DOUBLE>>"
OHLC = "token STRING, items ARRAY<ARRAY<DOUBLE>>"
WALLET_TX = ("wallet STRING, timestamp STRING, blockTime BIGINT, signature STRING, source STRING, tokenChanges ARRAY<STRUCT<changeType: STRING, "
             "tokenAddress: STRING, tokenSymbol: STRING, tokenName: STRING, amount: DOUBLE, valueUSD: DOUBLE>>")


def read(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """JSON lines as landed by the collectors."""
    return spark.read.schema(schema).json(path)


def parse(df: DataFrame, column: str, schema: str) -> DataFrame:
    """The same payloads held in a text column."""
    return df.select(F.from_json(column, schema).alias("j")).select("j.*")


def _text(c: str | Column, default: str = "") -> Column:
    return F.coalesce(F.col(c) if isinstance(c, str) else c, F.lit(default))


def _num(c: str | Column) -> Column:
    return nz(c).cast("double")


def _each(items: str) -> Column:
    """A row for each item, none for null. Not ``explode`` of the bare column: Spark would filter on its size below the parser, and parse each payload twice."""
    return F.explode(F.coalesce(F.col(items), F.array()))


def norm_pairs(raw: DataFrame) -> DataFrame:
    """Exchange pairs: nested numbers flattened, text prices parsed, missing numbers zero."""
    return raw.select(
        F.lit("pairs").alias("source"), F.lower("chainId").alias("chain"), _text("tokenAddress").alias("address"),
        _text("baseToken.symbol", "UNKNOWN").alias("symbol"), _text("baseToken.name").alias("name"),
        _num(F.col("priceUsd").try_cast("double")).alias("price"), _num("marketCap").alias("market_cap"),
        _num("volume.h24").alias("volume_24h"), _num("liquidity.usd").alias("liquidity"),
        _num("priceChange.h24").alias("change_24h"), nz("txns.h24.buys").alias("buys"), nz("txns.h24.sells").alias("sells"),
        F.timestamp_seconds(epoch_any("pairCreatedAt")).cast("timestamp_ntz").alias("created_at"))


def norm_token_list(raw: DataFrame, chain: str = "solana") -> DataFrame:
    return raw.select(
        F.lit("token_list").alias("source"), F.lit(chain).alias("chain"), _text("address").alias("address"),
        _text("symbol", "UNKNOWN").alias("symbol"), _text("name").alias("name"), _num("price").alias("price"),
        _num("marketCap").alias("market_cap"), _num("v24hUSD").alias("volume_24h"), _num("liquidity").alias("liquidity"),
        _num("priceChange24h").alias("change_24h"))


def norm_token_list_short(raw: DataFrame, chain: str = "solana") -> DataFrame:
    """The same vendor's shorter field names, with a wallet count."""
    return raw.select(
        F.lit("token_list").alias("source"), F.lit(chain).alias("chain"), _text("address").alias("address"),
        _text("symbol").alias("symbol"), _text("name").alias("name"), _num("price").alias("price"), _num("mc").alias("market_cap"),
        _num("v24h").alias("volume_24h"), _num("liquidity").alias("liquidity"), _num("v24hChangePercent").alias("change_24h"),
        nz("uniqueWallet24h").alias("holders"))


def norm_trending(raw: DataFrame, by_id: bool = False) -> DataFrame:
    """Trending list with money as text; the chain is the platform, or unknown. ``by_id``: the dialect that tells the chain by the id."""
    i = raw.select(_each("coins.item").alias("i"))
    return i.select(
        F.lit("trending").alias("source"), (trending_chain(F.col("i.id")) if by_id else _text("i.platform_id", "unknown")).alias("chain"), _text("i.contract_address").alias("address"),
        _text("i.symbol", "???").alias("symbol"), _text("i.name", "Unknown").alias("name"), tx.money(F.col("i.data.price")).alias("price"),
        tx.money(F.col("i.data.market_cap")).alias("market_cap"), tx.volume(F.col("i.data.total_volume")).alias("volume_24h"),
        _num("i.data.price_change_percentage_24h.usd").alias("change_24h"))


def trending_chain(vendor_id: Column) -> Column:
    """Chain from the id prefix, for payloads without a platform."""
    return F.when(vendor_id.startswith("solana"), "solana").otherwise("ethereum")


def norm_ranked(raw: DataFrame) -> DataFrame:
    """Ranked token list with holder counts."""
    t = raw.select(_each("data.tokens").alias("t"))
    return t.select(
        F.lit("ranked").alias("source"), _text("t.chain", "solana").alias("chain"), _text("t.address").alias("address"),
        _text("t.symbol").alias("symbol"), _text("t.name").alias("name"), _num("t.price").alias("price"), _num("t.market_cap").alias("market_cap"),
        _num("t.volume_24h").alias("volume_24h"), _num("t.liquidity").alias("liquidity"), _num("t.price_change_24h").alias("change_24h"),
        nz("t.holder_count").alias("holders"))


def norm_ohlcv(raw: DataFrame) -> DataFrame:
    """Candle objects with a time in seconds."""
    x = raw.select("token", _each("items").alias("x"))
    return x.select("token", nz("x.unixTime").alias("ts"), *[_num(f"x.{c}").alias(c) for c in "ohlcv"])


def norm_ohlc(raw: DataFrame) -> DataFrame:
    """Candle arrays ``[milliseconds, o, h, l, c]``; there is no volume."""
    x = raw.select("token", _each("items").alias("x"))
    at = [F.get("x", F.lit(i)) for i in range(5)]
    return x.select("token", F.floor(at[0] / 1000).alias("ts"), *[at[i + 1].alias(c) for i, c in enumerate("ohlc")], F.lit(0.0).alias("v"))


def pair_as_candle(pairs: DataFrame, ts: Column) -> DataFrame:
    """A flat candle from a current price, for tokens without history."""
    return pairs.select("address", ts.alias("ts"), *[F.col("price").alias(c) for c in "ohlc"], F.col("volume_24h").alias("v"),
                        F.col("market_cap").alias("marketcap"), "liquidity")


def wallet_buys(raw: DataFrame, as_of_seconds: Column, hours: float = 24) -> DataFrame:
    """One row per token received in the window. Times are numbers or ISO text; rows without one are dropped."""
    number = F.col("timestamp").try_cast("double").cast("bigint")
    iso = F.unix_timestamp(F.try_to_timestamp("timestamp"))
    t = raw.withColumn("at", F.when(F.coalesce("timestamp", F.lit("")) == "", F.col("blockTime")).otherwise(F.coalesce(number, iso)))
    t = t.filter(F.col("at").isNotNull() & (F.col("at") >= as_of_seconds - int(hours * 3600)))
    c = t.select("wallet", "at", "signature", F.col("source").alias("dex"), _each("tokenChanges").alias("c"))
    return (c.filter((F.col("c.changeType") == "inc") & (F.col("c.amount") > 0))
            .select("wallet", _text("c.tokenAddress", "UNKNOWN").alias("token"), F.col("c.tokenSymbol").alias("symbol"), "at",
                    F.col("c.amount").alias("amount"), F.col("c.valueUSD").alias("value_usd"), "dex", "signature"))
