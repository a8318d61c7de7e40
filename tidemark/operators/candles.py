"""Candles, exponential averages and the candle patterns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidemark import fixed


def resample(trades: DataFrame, seconds: int, order: list[str], key: str = "token") -> DataFrame:
    """Trades to OHLCV candles; ``order`` must follow ``ts`` and decide open and close without ties.

    With one fixed-width order column (a number or a time) the trades are hashed; with several Spark has to sort them
    on both sides of the shuffle, as a struct does not fit a hash buffer.
    """
    bucket = F.window("ts", f"{seconds} seconds")["start"]
    ranked = F.col(order[0]) if len(order) == 1 else F.struct(*[F.col(c) for c in order if c != "price"], F.col("price").alias("price"))
    return (trades.groupBy(key, bucket.alias("bucket"))
            .agg(F.min_by("price", ranked).alias("o"), F.max("price").alias("h"), F.min("price").alias("l"),
                 F.max_by("price", ranked).alias("c"), F.sum("qty").alias("v")))


def latest(candles: DataFrame, n: int, key: str = "token") -> DataFrame:
    """The last ``n`` candles of each key; the rank limit is applied before the shuffle."""
    w = W.partitionBy(key).orderBy(F.col("bucket").desc())
    return candles.withColumn("back", F.row_number().over(w)).filter(F.col("back") <= n)


def history(candles: DataFrame, n: int = fixed.FETCH_CANDLES, key: str = "token") -> DataFrame:
    """One row per key with its last ``n`` candles as an ascending array (at most ``n`` structs)."""
    return (latest(candles, n, key)
            .groupBy(key)
            .agg(F.array_sort(F.collect_list(F.struct("bucket", "o", "h", "l", "c", "v"))).alias("bars"))
            .withColumn("closes", F.col("bars.c"))
            .withColumn("n", F.size("bars")))


def smoothing(length: int) -> float:
    return 2 / (length + 1)


def ema_last(values: Column, length: int) -> Column:
    """EMA after the last value, seeded with the mean of the first ``length``; null when shorter."""
    k = smoothing(length)
    seed = F.aggregate(F.slice(values, 1, length), F.lit(0.0), lambda a, x: a + x) / length
    rest = F.slice(values, length + 1, F.greatest(F.size(values) - length, F.lit(0)))
    out = F.aggregate(rest, seed, lambda m, x: (x - m) * k + m)
    return F.when(F.size(values) >= length, out)


def ema_padded(values: Column, length: int) -> Column:
    """EMA at every position, the seed repeated over the first ones; a shorter array comes back unchanged.

    The array holds a bounded number of candles (see ``history``).
    """
    k = smoothing(length)
    seed = F.aggregate(F.slice(values, 1, length), F.lit(0.0), lambda a, x: a + x) / length
    rest = F.slice(values, length + 1, F.greatest(F.size(values) - length, F.lit(0)))
    out = F.aggregate(rest, F.array_repeat(seed, length),
                      lambda a, x: F.array_append(a, (x - F.element_at(a, -1)) * k + F.element_at(a, -1)))
    return F.when(F.size(values) < length, values).otherwise(out)


def with_ema(hist: DataFrame, length: int = fixed.EMA_LEN) -> DataFrame:
    return hist.withColumn("emas", ema_padded(F.col("closes"), length))


def trailing_ema(price: Column, window, fetched: int, length: int) -> Column:
    """EMA a monitor sees that fetches the last ``fetched`` candles, for every position of a series.

    With the window this short the recurrence is a finite weighted sum: the mean of the oldest ``length``
    values decayed over the remaining steps, plus the weighted remaining values. Null until enough rows.
    """
    k, steps = smoothing(length), fetched - length
    q = 1 - k
    seed = F.avg(price).over(window.rowsBetween(-(fetched - 1), -steps))
    tail = F.lit(0.0)
    for j in range(steps - 1, -1, -1):
        tail = tail + F.lag(price, j).over(window) * (k * q ** j)
    full = F.count(price).over(window.rowsBetween(-(fetched - 1), 0)) == fetched
    return F.when(full, seed * (q ** steps) + tail)


def pattern_a(hist: DataFrame) -> DataFrame:
    """Last close back above the average after closing at or below it."""
    c, e = F.col("closes"), F.col("emas")
    crossed = (F.element_at(c, -1) > F.element_at(e, -1)) & (F.element_at(c, -2) <= F.element_at(e, -2))
    enough = F.col("n") >= fixed.MIN_CANDLES["A"]
    return hist.withColumn("hit_a", F.coalesce(enough & crossed, F.lit(False)))


def pattern_b(hist: DataFrame, recent: int = 20, lookback: int = 40, dump: float = 1.2) -> DataFrame:
    """First position among the recent ones (the last excluded) that crosses up after a dump; null if none."""
    c, e, n = F.col("closes"), F.col("emas"), F.col("n")

    def crosses(i: Column) -> Column:  # i is a 1-based position
        before = F.array_max(F.slice(c, F.greatest(i - lookback, F.lit(1)), F.greatest(F.least(F.lit(lookback), i - 1), F.lit(0))))
        return ((i > fixed.EMA_LEN) & (F.get(c, i - 1) > F.get(e, i - 1)) & (F.get(c, i - 2) <= F.get(e, i - 2))
                & (before > F.get(c, i - 1) * dump))

    hits = F.filter(F.sequence(n - recent + 1, n - 1), crosses)
    return hist.withColumn("hit_b_at", F.when(n >= fixed.MIN_CANDLES["B"], F.get(hits, F.lit(0))))


def pattern_c(hist: DataFrame, mc: Column, recent: int = 20, pump: float = 1.30, near: float = 0.02) -> DataFrame:
    """Verdict of the hold-after-pump pattern: no_pump / no_ema_hold / hit, null with too few candles."""
    c, e, n = F.col("closes"), F.col("emas"), F.col("n")
    tail = F.slice(c, F.greatest(n - recent + 1, F.lit(1)), recent)
    pumped = F.array_max(F.slice(tail, 1, 15)) > F.array_min(F.slice(tail, 1, 5)) * pump
    last, ema = F.element_at(c, -1), F.element_at(e, -1)
    held = (F.abs(last - ema) / ema < near) & (last > F.element_at(c, -3))
    verdict = F.when(~pumped, "no_pump").when(held, "hit").otherwise("no_ema_hold")
    return (hist.withColumn("verdict_c", F.when(n >= fixed.MIN_CANDLES["C"], verdict))
            .withColumn("hit_c", F.coalesce((F.col("verdict_c") == "hit") & (mc >= fixed.PATTERN_C_MIN_MC), F.lit(False))))


def features(candles: DataFrame, n: int = fixed.FETCH_CANDLES) -> DataFrame:
    """Chart features the daily engines read: position against highs, touches, rejections, trend riding."""
    h = with_ema(history(candles, n)).filter(F.col("n") >= fixed.MIN_CANDLES["A"])
    top = candles.groupBy("token").agg(F.max("h").alias("top"))
    zipped = F.arrays_zip(F.col("bars"), F.col("emas").alias("ema"),
                          F.concat(F.array(F.lit(None).cast("double")), F.col("closes")).alias("pc"),
                          F.concat(F.array(F.lit(None).cast("double")), F.col("emas")).alias("pe"))

    def tail(k: int) -> Column:
        return F.slice(F.slice(F.col("z"), 1, F.col("n")), -k, k)

    h = h.withColumn("z", F.slice(zipped, 1, F.col("n"))).withColumn("vols", F.col("bars.v"))
    last = F.element_at("closes", -1)
    touch = F.filter(tail(20), lambda x: (x["bars"]["l"] <= x["ema"]) & (x["ema"] <= x["bars"]["h"]))
    reject = F.filter(tail(20), lambda x: (x["bars"]["h"] >= x["ema"]) & (x["bars"]["c"] < x["ema"]) & (x["pc"] < x["pe"]))
    mean = {k: F.aggregate(F.slice("vols", -k, k), F.lit(0.0), lambda a, v: a + v) / k for k in (5, 20)}
    return (h.join(top, "token").select(
        "token",
        (last / F.array_max(F.slice(F.col("bars.h"), -40, 40))).alias("price_vs_high"),
        (1 - last / F.col("top")).alias("ath_drawdown"),
        F.size(touch).cast("bigint").alias("touches"),
        F.size(reject).cast("bigint").alias("rejections"),
        F.forall(tail(10), lambda x: x["bars"]["c"] > x["ema"]).alias("riding"),
        F.when(mean[5] > 1.5 * mean[20], "high").otherwise("neutral").alias("volume_trend")))


def double_top(candles: DataFrame, n: int = fixed.FETCH_CANDLES) -> DataFrame:
    """The last two local highs, the later one lower, and the last close below the average."""
    h = with_ema(history(candles, n)).filter(F.col("n") >= fixed.EMA_LEN)
    highs = F.col("bars.h")
    peaks = F.filter(F.sequence(F.lit(2), F.col("n") - 1),
                     lambda i: (F.get(highs, i - 1) > F.get(highs, i - 2)) & (F.get(highs, i - 1) > F.get(highs, i)))
    out = h.withColumn("peaks", peaks).filter(F.size("peaks") >= 2).select(
        "token", F.get(highs, F.element_at("peaks", -2) - 1).alias("first_peak"),
        F.get(highs, F.element_at("peaks", -1) - 1).alias("second_peak"),
        F.element_at("closes", -1).alias("price"), F.element_at("emas", -1).alias("ema50"))
    return out.filter((F.col("second_peak") < F.col("first_peak")) & (F.col("price") < F.col("ema50")))


def volume_compression(candles: DataFrame, n: int = fixed.FETCH_CANDLES, span: int = 20) -> DataFrame:
    """Volume during tests of the average against all recent volume, and its expansion on the reclaim."""
    h = with_ema(history(candles, n)).filter(F.col("n") >= fixed.MIN_CANDLES["A"])
    z = F.slice(F.arrays_zip("bars", "emas"), -(span + 1), span)
    tests = F.filter(z, lambda x: (x["bars"]["l"] <= x["emas"]) & (x["emas"] <= x["bars"]["h"]))

    def mean_volume(a: Column) -> Column:
        return F.try_divide(F.aggregate(a, F.lit(0.0), lambda s, x: s + x["bars"]["v"]), F.size(a))

    last = F.element_at("bars", -1)
    return (h.withColumn("test_volume", mean_volume(tests)).withColumn("base_volume", mean_volume(z))
            .filter(F.col("test_volume").isNotNull())
            .withColumn("compressed", (F.col("test_volume") < F.col("base_volume")) & (last["v"] > F.col("base_volume"))
                        & (last["c"] > F.element_at("emas", -1))))
