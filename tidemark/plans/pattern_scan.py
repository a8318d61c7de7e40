"""The candle-pattern scan: trades in, one alert per token out."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidemark import fixed
from tidemark.operators import candles as cd
from tidemark.operators import filters as fl
from tidemark.streaming.sinks import stored

ALERTS = "token {token}, pattern STRING, ts TIMESTAMP_NTZ, price DOUBLE, ema50 DOUBLE, reason STRING, alerted_at TIMESTAMP, run BIGINT"


def histories(bars: DataFrame, seconds: list[int], n: int = fixed.FETCH_CANDLES) -> DataFrame:
    """The last ``n`` candles of each token for every length of ``seconds``, built from shorter ones that divide them: one row per token and ``turn``, the
    place in ``seconds``, as ``candles.history`` gives. The candles are read once, however many lengths there are.
    """
    kind = bars.schema["bucket"].dataType
    at = F.unix_timestamp(F.col("bucket").cast("timestamp"))
    turns = F.array(*[F.struct(F.lit(i).alias("turn"), F.timestamp_seconds(F.floor(at / s) * s).cast(kind).alias("longer")) for i, s in enumerate(seconds)])
    each = bars.select("*", F.explode(turns).alias("t")).groupBy("token", F.col("t.turn").alias("turn"), F.col("t.longer").alias("longer"))
    longer = each.agg(F.min_by("o", "bucket").alias("o"), F.max("h").alias("h"), F.min("l").alias("l"), F.max_by("c", "bucket").alias("c"), F.sum("v").alias("v"))
    newest = W.partitionBy("token", "turn").orderBy(F.col("longer").desc())
    last = longer.withColumn("back", F.row_number().over(newest)).filter(F.col("back") <= n).withColumnRenamed("longer", "bucket")
    return (last.groupBy("token", "turn").agg(F.array_sort(F.collect_list(F.struct("bucket", "o", "h", "l", "c", "v"))).alias("bars"))
            .withColumn("closes", F.col("bars.c")).withColumn("n", F.size("bars")))


def scan(trades: DataFrame, order: list[str], base: str, a: str, b: str, c: str, mc: Column, market: DataFrame | None = None) -> DataFrame:
    """Pattern A on timeframe ``a``, B on ``b``, C on ``c``; the first in that order wins for a token.

    Trades are aggregated once, to ``base`` candles; the three timeframes are built from those in one pass, all patterns are evaluated on one row each, and
    the first hit is taken. ``mc`` is the market cap that C asks for: over the candles, or, with ``market``, a column of it (token, ...).
    """
    sec = fixed.TIMEFRAME_SECONDS
    hist = histories(cd.resample(trades, sec[base], order), [sec[a], sec[b], sec[c]])
    if market is not None:
        hist = hist.join(market, "token")
    h = cd.pattern_c(cd.pattern_b(cd.pattern_a(cd.with_ema(hist))), mc)
    turn = F.col("turn")
    at = (F.when((turn == 0) & F.col("hit_a"), F.col("n")).when(turn == 1, F.col("hit_b_at")).when((turn == 2) & F.col("hit_c"), F.col("n")) - 1).cast("int")
    hits = h.select("token", "turn", at.alias("at"), "bars", "closes", "emas").filter(F.col("at").isNotNull()).select(
        "token", "turn", F.get("bars", F.col("at"))["bucket"].alias("ts"), F.get("closes", F.col("at")).alias("price"), F.get("emas", F.col("at")).alias("ema50"))

    def first(value: str) -> Column:
        return F.coalesce(*[F.max(F.when(turn == i, F.col(value))) for i in range(3)]).alias(value)
    won = hits.groupBy("token").agg(F.min("turn").alias("turn"), first("ts"), first("price"), first("ema50"))
    names = list(fixed.PATTERN_TEXT)[:3]
    pattern = F.element_at(F.array(*[F.lit(x) for x in names]), turn + 1)
    reason = F.element_at(F.array(*[F.lit(fixed.PATTERN_TEXT[x]) for x in names]), turn + 1)
    return won.select("token", (turn + 1).alias("rank"), pattern.alias("pattern"), "ts", "price", "ema50", reason.alias("reason"))


def run(trades: DataFrame, market: DataFrame, path: str, number: int, as_of: str, order: list[str], base: str, a: str, b: str, c: str,
        hours: float = fixed.ENGINE_COOLDOWN_HOURS) -> DataFrame:
    """One run of the scan at ``as_of`` (UTC) with all its gates; its alerts are added to the alert state below ``path`` and returned.

    Tokens whose market cap or liquidity (``market``: token, market_cap, liquidity) is outside the target band, and those that an earlier run alerted less than
    ``hours`` ago, are left out before any candle is built. The state is cut by run: a run reads those before it and replaces its own, so a run that
    is repeated after a failure gives the same state. Trades after ``as_of`` are not looked at.
    """
    spark, now = trades.sparkSession, F.to_timestamp(F.lit(as_of))
    state = stored(spark, path, ALERTS.format(token=trades.schema["token"].dataType.simpleString()))
    last = state.filter(F.col("run") < number).groupBy("token").agg(F.max("alerted_at").alias("last"))
    rested = F.col("last").isNull() | (F.unix_timestamp(now) - F.unix_timestamp("last") >= hours * 3600)
    open_ = fl.target_band(market).join(last, "token", "left").filter(rested).select("token", "market_cap")
    seen = trades.filter(F.col("ts").cast("timestamp") <= now).join(open_.select("token"), "token", "left_semi")
    alerts = scan(seen, order, base, a, b, c, F.col("market_cap"), open_).drop("rank")
    (alerts.withColumn("alerted_at", now).withColumn("run", F.lit(number).cast("bigint")).write.mode("overwrite")
     .option("partitionOverwriteMode", "dynamic").partitionBy("run").parquet(path))
    return stored(spark, path, ALERTS.format(token=trades.schema["token"].dataType.simpleString())).filter(F.col("run") == number)
