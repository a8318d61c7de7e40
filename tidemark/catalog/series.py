"""Candles, averages, patterns and monitors over the driver tables."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidemark import bindings as b
from tidemark import fixed
from tidemark.catalog.base import query, with_
from tidemark.functions.values import ntz
from tidemark.operators import averages
from tidemark.operators import candles as cd
from tidemark.operators import monitors as mon
from tidemark.operators import sliced
from tidemark.plans import pattern_scan
from tidemark.session import shared_dir


def pool_trades(spark, sf):
    return b.trades(spark, sf, token="l_suppkey")


def pool_candles(spark, sf, seconds=b.DAY_3):
    return cd.resample(pool_trades(spark, sf), seconds, ["seq"])


def candles_sql(seconds: int, name: str = "bars", key: str = "l_suppkey", where: str = "true") -> str:
    ms = seconds * 1000
    order = "(l_shipdate, l_orderkey, l_linenumber, l_extendedprice / l_quantity)"
    return f"""
{name} AS (SELECT {key} AS token, make_timestamp_ms(epoch_ms(l_shipdate) // {ms} * {ms}) AS bucket,
        arg_min(l_extendedprice / l_quantity, {order}) AS o, max(l_extendedprice / l_quantity) AS h,
        min(l_extendedprice / l_quantity) AS l, arg_max(l_extendedprice / l_quantity, {order}) AS c,
        sum(l_quantity) AS v
      FROM lineitem WHERE {where} GROUP BY 1, 2)"""


def ema_sql(bars: str = "bars", suffix: str = "", n: int = 100) -> str:
    """Positions 1..n of the last n candles with the padded EMA50."""
    return f"""
pos{suffix} AS (SELECT *, row_number() OVER (PARTITION BY token ORDER BY bucket) AS i, count(*) OVER (PARTITION BY token) AS n
      FROM (SELECT *, row_number() OVER (PARTITION BY token ORDER BY bucket DESC) AS back FROM {bars}) WHERE back <= {n}),
seed{suffix} AS (SELECT token, sum(c) / 50 AS seed FROM pos{suffix} WHERE i <= 50 GROUP BY token HAVING count(*) = 50),
ema{suffix}(token, i, e) AS (SELECT token, 50::BIGINT, seed FROM seed{suffix} UNION ALL
      SELECT p.token, p.i, (p.c - r.e) * (2.0::DOUBLE / 51) + r.e FROM ema{suffix} r
      JOIN pos{suffix} p ON p.token = r.token AND p.i = r.i + 1),
bar{suffix} AS (SELECT p.*, CASE WHEN s.token IS NULL THEN p.c WHEN p.i < 50 THEN s.seed ELSE r.e END AS e
      FROM pos{suffix} p LEFT JOIN seed{suffix} s ON s.token = p.token
      LEFT JOIN ema{suffix} r ON r.token = p.token AND r.i = p.i)"""


BARS = candles_sql(b.DAY_3)
EMA = ema_sql()


@query("candles", with_(BARS) + "SELECT token, bucket, o, h, l, c, v FROM bars")
def candles(spark, sf):
    return pool_candles(spark, sf)


@query("ema", with_(BARS, EMA) + "SELECT token, n, round(e, 6) AS ema50 FROM bar WHERE i = n AND n >= 50")
def ema(spark, sf):
    h = cd.history(pool_candles(spark, sf))
    return (h.select("token", F.col("n").cast("bigint").alias("n"),
                     F.round(cd.ema_last(F.col("closes"), fixed.EMA_LEN), 6).alias("ema50"))
            .filter(F.col("ema50").isNotNull()))


@query("ema_series_padded", with_(BARS, EMA) + "SELECT token, bucket, round(e, 6) AS ema50 FROM bar")
def ema_series_padded(spark, sf):
    h = cd.with_ema(cd.history(pool_candles(spark, sf)))
    x = h.select("token", F.explode(F.arrays_zip("bars", "emas")).alias("x"))
    return x.select("token", F.col("x.bars.bucket").alias("bucket"), F.round("x.emas", 6).alias("ema50"))


LONG_EMA = """
pos AS (SELECT event_type AS key, event_id, value AS c, row_number() OVER (PARTITION BY event_type ORDER BY ts, event_id) AS i FROM events WHERE value IS NOT NULL),
seed AS (SELECT key, sum(c) / 50 AS e FROM pos WHERE i <= 50 GROUP BY key HAVING count(*) = 50),
ema(key, i, e) AS (SELECT key, 50::BIGINT, e FROM seed UNION ALL
      SELECT p.key, p.i, (p.c - r.e) * (2.0::DOUBLE / 51) + r.e FROM ema r JOIN pos p ON p.key = r.key AND p.i = r.i + 1)"""


@query("ema_long_series", with_(LONG_EMA) + "SELECT key, event_id, i AS idx, round(e, 6) AS ema50 FROM ema JOIN pos USING (key, i)")
def ema_long_series(spark, sf):
    """The average over all checks of a key, not only over those of a fetched window."""
    s = averages.ema_series(event_checks(spark, sf), ["key"], ["ts", "event_id"], "price")
    return s.filter(F.col("ema").isNotNull()).select("key", "event_id", "idx", F.round("ema", 6).alias("ema50"))


@query("sma50", with_(BARS) + """
SELECT token, bucket, CASE WHEN count(c) OVER w = 50 THEN round(avg(c) OVER w, 6) END AS sma50 FROM bars
WINDOW w AS (PARTITION BY token ORDER BY bucket ROWS BETWEEN 49 PRECEDING AND CURRENT ROW)""")
def sma50(spark, sf):
    w = W.partitionBy("token").orderBy("bucket").rowsBetween(-49, 0)
    full = F.count("c").over(w) == 50
    return pool_candles(spark, sf).select("token", "bucket", F.when(full, F.round(F.avg("c").over(w), 6)).alias("sma50"))


PATTERN_A = "l.n >= 52 AND l.c > l.e AND p.c <= p.e"


@query("engine_a_reclaim", with_(BARS, EMA) + f"""
SELECT l.token, l.bucket, l.c AS price, round(l.e, 6) AS ema50, ({PATTERN_A}) AS hit
FROM bar l JOIN bar p ON p.token = l.token AND p.i = l.i - 1 WHERE l.i = l.n""")
def engine_a_reclaim(spark, sf):
    h = cd.pattern_a(cd.with_ema(cd.history(pool_candles(spark, sf))))
    return (h.filter(F.col("n") >= 2)
            .select("token", F.element_at("bars", -1)["bucket"].alias("bucket"),
                    F.element_at("closes", -1).alias("price"),
                    F.round(F.element_at("emas", -1), 6).alias("ema50"), F.col("hit_a").alias("hit")))


def pattern_b_sql(s: str = "") -> str:
    return f"""
hitb{s} AS (SELECT token, min(i) AS i FROM (SELECT token, i, n, c, e, lag(c) OVER w AS pc, lag(e) OVER w AS pe,
          max(c) OVER (PARTITION BY token ORDER BY i ROWS BETWEEN 40 PRECEDING AND 1 PRECEDING) AS top
        FROM bar{s} WINDOW w AS (PARTITION BY token ORDER BY i))
      WHERE n >= 60 AND i BETWEEN n - 19 AND n - 1 AND i > 50 AND c > e AND pc <= pe AND top > c * 1.2::DOUBLE
      GROUP BY token)"""


@query("engine_b_reclaim_after_dump", with_(BARS, EMA, pattern_b_sql()) + """
SELECT token, bucket, c AS price, round(e, 6) AS ema50 FROM bar JOIN hitb USING (token, i)""")
def engine_b_reclaim_after_dump(spark, sf):
    h = cd.pattern_b(cd.with_ema(cd.history(pool_candles(spark, sf)))).filter(F.col("hit_b_at").isNotNull())
    at = (F.col("hit_b_at") - 1).cast("int")
    return h.select("token", F.get("bars", at)["bucket"].alias("bucket"), F.get("closes", at).alias("price"),
                    F.round(F.get("emas", at), 6).alias("ema50"))


def last_turnover():
    """Stand-in for the market cap of a candle: ten times its turnover."""
    return F.element_at("closes", -1) * F.element_at("bars", -1)["v"] * 10


def pattern_c_sql(s: str = "") -> str:
    return f"""
verc{s} AS (SELECT token, max(n) AS n, max(bucket) AS bucket,
        arg_max(c, i) AS price, arg_max(e, i) AS ema50, arg_max(c, i) * arg_max(v, i) * 10 AS mc,
        CASE WHEN NOT max(c) FILTER (i <= n - 5) > min(c) FILTER (i <= n - 15) * 1.30::DOUBLE THEN 'no_pump'
             WHEN abs(arg_max(c, i) - arg_max(e, i)) / arg_max(e, i) < 0.02::DOUBLE
                  AND arg_max(c, i) > max(c) FILTER (i = n - 2) THEN 'hit' ELSE 'no_ema_hold' END AS verdict
      FROM bar{s} WHERE n >= 80 AND i > n - 20 GROUP BY token)"""


@query("engine_c_hold", with_(BARS, EMA, pattern_c_sql()) + """
SELECT token, bucket, price AS price, round(ema50, 6) AS ema50, verdict,
  (verdict = 'hit' AND mc >= 300000) AS hit FROM verc""")
def engine_c_hold(spark, sf):
    h = cd.pattern_c(cd.with_ema(cd.history(pool_candles(spark, sf))), last_turnover())
    return (h.filter(F.col("verdict_c").isNotNull())
            .select("token", F.element_at("bars", -1)["bucket"].alias("bucket"),
                    F.element_at("closes", -1).alias("price"),
                    F.round(F.element_at("emas", -1), 6).alias("ema50"),
                    F.col("verdict_c").alias("verdict"), F.col("hit_c").alias("hit")))


CASCADE = with_(candles_sql(259_200, "bars_a"), candles_sql(86_400, "bars_b"), candles_sql(604_800, "bars_c"),
                ema_sql("bars_a", "_a"), ema_sql("bars_b", "_b"), ema_sql("bars_c", "_c"), pattern_b_sql("_b"),
                pattern_c_sql("_c"), f"""
alerts AS (
  SELECT l.token, 1 AS rank, 'A' AS pattern, l.bucket AS ts, l.c AS price, l.e AS ema50
    FROM bar_a l JOIN bar_a p ON p.token = l.token AND p.i = l.i - 1 WHERE l.i = l.n AND {PATTERN_A}
  UNION ALL SELECT token, 2, 'B', bucket, c, e FROM bar_b JOIN hitb_b USING (token, i)
  UNION ALL SELECT token, 3, 'C', bucket, price, ema50 FROM verc_c WHERE verdict = 'hit' AND mc >= 300000)""") + """
SELECT token, pattern, ts, price AS price, round(ema50, 6) AS ema50
FROM (SELECT *, row_number() OVER (PARTITION BY token ORDER BY rank) AS rn FROM alerts) WHERE rn = 1"""


@query("cascade_first_engine", CASCADE)
def cascade_first_engine(spark, sf):
    alerts = pattern_scan.scan(pool_trades(spark, sf), ["seq"], base="1D", a="3D", b="1D", c="1W",
                               mc=last_turnover())
    return alerts.select("token", "pattern", "ts", "price", F.round("ema50", 6).alias("ema50"))


RUNS = ("2001-03-01 00:00:00", "2001-03-02 12:00:00")


def market(spark, sf, as_of):
    """Market data of a pool at a time: turnover of the two weeks before, and a liquidity from the quantity traded."""
    t = pool_trades(spark, sf).filter((F.col("ts") <= ntz(as_of)) & (F.col("ts") > ntz(as_of) - F.expr("INTERVAL 14 DAYS")))
    return t.groupBy("token").agg(F.round(F.sum("value_usd"), 2).alias("market_cap"), (F.sum("qty") * 200).alias("liquidity"))


def run_sql(k: int, gate: str) -> list[str]:
    upto = f"l_shipdate <= TIMESTAMP '{RUNS[k]}'"
    return [f"""
market{k} AS (SELECT token, market_cap FROM (SELECT l_suppkey AS token, round(sum(l_extendedprice), 2) AS market_cap, sum(l_quantity) * 200 AS liquidity FROM lineitem
  WHERE {upto} AND l_shipdate > TIMESTAMP '{RUNS[k]}' - INTERVAL 14 DAYS GROUP BY 1) WHERE market_cap BETWEEN 100000 AND 500000 AND liquidity >= 10000 AND {gate})""",
            *[candles_sql(n, f"bars_{x}{k}", where=upto) for n, x in ((259_200, "a"), (86_400, "b"), (604_800, "c"))],
            *[ema_sql(f"bars_{x}{k}", f"_{x}{k}") for x in "abc"], pattern_b_sql(f"_b{k}"), pattern_c_sql(f"_c{k}"), f"""
alerts{k} AS (SELECT token, pattern, ts, price, ema50 FROM (SELECT *, row_number() OVER (PARTITION BY token ORDER BY pattern) AS rn FROM (
  SELECT l.token, 'A' AS pattern, l.bucket AS ts, l.c AS price, l.e AS ema50 FROM bar_a{k} l JOIN bar_a{k} p ON p.token = l.token AND p.i = l.i - 1 WHERE l.i = l.n AND {PATTERN_A}
  UNION ALL SELECT token, 'B', bucket, c, e FROM bar_b{k} JOIN hitb_b{k} USING (token, i)
  UNION ALL SELECT token, 'C', bucket, price, ema50 FROM verc_c{k} WHERE verdict = 'hit' AND token IN (SELECT token FROM market{k} WHERE market_cap >= 300000))
  WHERE token IN (SELECT token FROM market{k})) WHERE rn = 1)"""]


@query("pattern_scan_runs", with_(*run_sql(0, "true"), *run_sql(1, "token NOT IN (SELECT token FROM alerts0)")) + " UNION ALL ".join(
    f"SELECT {k}::BIGINT AS run, token, pattern, ts, price, round(ema50, 6) AS ema50 FROM alerts{k}" for k in (0, 1)))
def pattern_scan_runs(spark, sf):
    """Two runs of the gated scan a day and a half apart, the second one made twice: what the first alerted is still cooling down."""
    path, t = shared_dir(spark, "scan-state"), pool_trades(spark, sf)
    for k in (0, 1, 1):
        pattern_scan.run(t, market(spark, sf, RUNS[k]), path, k, RUNS[k], ["seq"], base="1D", a="3D", b="1D", c="1W")
    return spark.read.parquet(path).select(F.col("run").cast("bigint").alias("run"), "token", "pattern", "ts", "price", F.round("ema50", 6).alias("ema50"))


# --- monitors over candle closes -------------------------------------------------------------------

MON_SQL = """
chk AS (SELECT token, bucket, c AS price, CASE WHEN count(c) OVER full_ = 60 THEN
          avg(c) OVER old_ * power(1 - 2.0::DOUBLE / 51, 10) + (2.0::DOUBLE / 51) * (""" + " + ".join(
    f"lag(c, {j}) OVER w * power(1 - 2.0::DOUBLE / 51, {j})" for j in range(10)) + """) END AS ema
      FROM bars WINDOW w AS (PARTITION BY token ORDER BY bucket),
        full_ AS (PARTITION BY token ORDER BY bucket ROWS BETWEEN 59 PRECEDING AND CURRENT ROW),
        old_ AS (PARTITION BY token ORDER BY bucket ROWS BETWEEN 59 PRECEDING AND 10 PRECEDING)),
chk2 AS (SELECT *, price > ema AS above, row_number() OVER (PARTITION BY token ORDER BY bucket) AS idx
      FROM chk WHERE ema IS NOT NULL)"""


def close_checks(spark, sf):
    """Every candle close as a check against the EMA50 of the last 60 candles."""
    w = W.partitionBy("token").orderBy("bucket")
    c = pool_candles(spark, sf).select("token", "bucket", F.col("c").alias("price"))
    c = c.withColumn("ema", cd.trailing_ema(F.col("price"), w, 60, fixed.EMA_LEN)).filter(F.col("ema").isNotNull())
    return c.withColumn("above", F.col("price") > F.col("ema"))


@query("ema_cross_events", with_(BARS, MON_SQL) + """
SELECT token, bucket, price AS price, CASE WHEN above THEN 'breakout' ELSE 'breakdown' END AS event
FROM (SELECT *, lag(above) OVER (PARTITION BY token ORDER BY bucket) AS was FROM chk2) WHERE above <> was""")
def ema_cross_events(spark, sf):
    return (mon.cross_events(close_checks(spark, sf), ["token"], ["bucket"])
            .select("token", "bucket", "price", "event"))


RUNS_SQL = """
runs AS (SELECT *, idx - coalesce(max(CASE WHEN NOT above THEN idx END) OVER w, 0) AS above_count,
        idx - coalesce(max(CASE WHEN above THEN idx END) OVER w, 0) AS below_count
      FROM chk2 WINDOW w AS (PARTITION BY token ORDER BY bucket)),
cand AS (SELECT *, row_number() OVER (PARTITION BY token ORDER BY bucket) AS k FROM runs
      WHERE NOT above AND ((below_count = 1 AND idx > 1) OR below_count >= 2)),
nxt AS (SELECT a.token, a.k, min(c.k) AS nk FROM cand a LEFT JOIN cand c
      ON c.token = a.token AND c.bucket >= a.bucket + INTERVAL 144 HOUR GROUP BY a.token, a.k),
sent(token, k) AS (SELECT token, 1::BIGINT FROM cand WHERE k = 1 UNION ALL
      SELECT s.token, n.nk FROM sent s JOIN nxt n ON n.token = s.token AND n.k = s.k WHERE n.nk IS NOT NULL)"""


@query("sustained_below", with_(BARS, MON_SQL, RUNS_SQL) + """
SELECT token, bucket, price, above_count, below_count FROM cand JOIN sent USING (token, k)""")
def sustained_below(spark, sf):
    """Alerts that remain after a cooldown (144 h, as these checks are three days apart)."""
    runs = mon.sustained_below(close_checks(spark, sf), ["token"], ["bucket"]).filter("wants_alert")
    return (mon.cooldown(runs, ["token"], "bucket", 144, ["price", "above_count", "below_count"])
            .select("token", "bucket", "price", "above_count", "below_count"))


@query("run_counters", with_(BARS, MON_SQL, RUNS_SQL) + "SELECT token, bucket, above_count, below_count FROM runs")
def run_counters(spark, sf):
    return (mon.run_counters(close_checks(spark, sf), ["token"], ["bucket"])
            .select("token", "bucket", "above_count", "below_count"))


# --- monitors over the event stream (few keys, each with a large share of all rows) ------------------

HOUR_6 = 6 * 3600


def event_checks(spark, sf):
    return sliced.slice_time(b.checks(spark, sf), "ts", HOUR_6)


@query("rolling_drop", """
SELECT key, event_id, price, round(a, 6) AS recent_avg FROM (
  SELECT event_type AS key, event_id, value AS price, avg(value) OVER w AS a, count(*) OVER w AS n FROM events
  WINDOW w AS (PARTITION BY event_type ORDER BY ts, event_id ROWS BETWEEN 9 PRECEDING AND CURRENT ROW))
WHERE n = 10 AND price < a * 0.85::DOUBLE""")
def rolling_drop(spark, sf):
    return (mon.rolling_drop(event_checks(spark, sf), ["key"], ["ts", "event_id"], "price")
            .select("key", "event_id", "price", F.round("recent_avg", 6).alias("recent_avg")))


@query("threshold_hysteresis", """
SELECT key, event_id, price, zone FROM (SELECT *, lag(zone) OVER (PARTITION BY key ORDER BY ts, event_id) AS pz FROM (
  SELECT event_type AS key, ts, event_id, value AS price,
    CASE WHEN value < 10 THEN 'below_low' WHEN value > 100 THEN 'above_high' ELSE 'mid' END AS zone FROM events))
WHERE zone <> 'mid' AND zone IS DISTINCT FROM pz""")
def threshold_hysteresis(spark, sf):
    return (mon.hysteresis(event_checks(spark, sf), ["key"], ["ts", "event_id"], "price", F.lit(10), F.lit(100))
            .select("key", "event_id", "price", "zone"))


@query("cooldown", with_("""
c AS (SELECT user_id, epoch_us(ts) // 1000000 AS sec, row_number() OVER (PARTITION BY user_id ORDER BY epoch_us(ts) // 1000000) AS k
      FROM (SELECT DISTINCT user_id, date_trunc('second', ts) AS ts FROM events WHERE event_type = 'error')),
nxt AS (SELECT a.user_id, a.k, min(b.k) AS nk FROM c a LEFT JOIN c b ON b.user_id = a.user_id AND b.sec >= a.sec + 259200
      GROUP BY a.user_id, a.k),
sent(user_id, k) AS (SELECT user_id, 1::BIGINT FROM c WHERE k = 1 UNION ALL
      SELECT s.user_id, n.nk FROM sent s JOIN nxt n ON n.user_id = s.user_id AND n.k = s.k WHERE n.nk IS NOT NULL)""") + """
SELECT c.user_id AS wallet, c.sec AS sec FROM sent JOIN c USING (user_id, k)""")
def cooldown(spark, sf):
    cand = b.table(spark, sf, "events").filter(F.col("event_type") == "error").select(F.col("user_id").alias("wallet"), "ts")
    return mon.cooldown(cand, ["wallet"], "ts", fixed.ENGINE_COOLDOWN_HOURS).select("wallet", "sec")


@query("ema_distance", with_(BARS, EMA) + """
SELECT token, round((c - e) / e * 100, 6) AS distance_pct FROM bar WHERE i = n AND n >= 50""")
def ema_distance(spark, sf):
    h = cd.history(pool_candles(spark, sf)).withColumn("ema50", cd.ema_last(F.col("closes"), fixed.EMA_LEN))
    last = F.element_at("closes", -1)
    return (h.filter(F.col("ema50").isNotNull())
            .select("token", F.round((last - F.col("ema50")) / F.col("ema50") * 100, 6).alias("distance_pct")))


FEATURES_SQL = """
f AS (SELECT *, lag(c) OVER w AS pc, lag(e) OVER w AS pe FROM bar WINDOW w AS (PARTITION BY token ORDER BY i)),
ath AS (SELECT token, max(h) AS top FROM bars GROUP BY token),
feat AS (SELECT token, arg_max(c, i) / max(h) FILTER (i > n - 40) AS price_vs_high,
        1 - arg_max(c, i) / any_value(top) AS ath_drawdown,
        count(*) FILTER (i > n - 20 AND l <= e AND e <= h) AS touches,
        count(*) FILTER (i > n - 20 AND h >= e AND c < e AND pc < pe) AS rejections,
        min(c - e) FILTER (i > n - 10) > 0 AS riding,
        CASE WHEN avg(v) FILTER (i > n - 5) > 1.5::DOUBLE * avg(v) FILTER (i > n - 20) THEN 'high' ELSE 'neutral' END AS volume_trend
      FROM f JOIN ath USING (token) WHERE n >= 52 GROUP BY token)"""


@query("pattern_features", with_(BARS, EMA, FEATURES_SQL) + """
SELECT token, round(price_vs_high, 6) AS price_vs_high, round(ath_drawdown, 6) AS ath_drawdown, touches, rejections,
  riding, volume_trend FROM feat""")
def pattern_features(spark, sf):
    f = cd.features(pool_candles(spark, sf))
    return f.select("token", F.round("price_vs_high", 6).alias("price_vs_high"),
                    F.round("ath_drawdown", 6).alias("ath_drawdown"), "touches", "rejections", "riding", "volume_trend")


@query("double_top", with_(BARS, EMA, """
peak AS (SELECT token, i, h, row_number() OVER (PARTITION BY token ORDER BY i DESC) AS r FROM (
      SELECT token, i, h, lag(h) OVER w AS ph, lead(h) OVER w AS nh FROM bar WINDOW w AS (PARTITION BY token ORDER BY i))
      WHERE h > ph AND h > nh)""") + """
SELECT b.token, p1.h AS first_peak, p2.h AS second_peak, b.c AS price
FROM bar b JOIN peak p2 ON p2.token = b.token AND p2.r = 1 JOIN peak p1 ON p1.token = b.token AND p1.r = 2
WHERE b.i = b.n AND b.n >= 50 AND p2.h < p1.h AND b.c < b.e""")
def double_top(spark, sf):
    return cd.double_top(pool_candles(spark, sf)).select(
        "token", "first_peak", "second_peak", "price")


@query("volume_compression", with_(BARS, EMA) + """
SELECT token, round(test_v, 6) AS test_volume, round(base_v, 6) AS base_volume, (test_v < base_v AND last_v > base_v AND rc) AS compressed
FROM (SELECT token, avg(v) FILTER (i BETWEEN n - 20 AND n - 1 AND l <= e AND e <= h) AS test_v,
        avg(v) FILTER (i BETWEEN n - 20 AND n - 1) AS base_v, arg_max(v, i) AS last_v, arg_max(c > e, i) AS rc
      FROM bar WHERE n >= 52 GROUP BY token) WHERE test_v IS NOT NULL""")
def volume_compression(spark, sf):
    return cd.volume_compression(pool_candles(spark, sf)).select(
        "token", F.round("test_volume", 6).alias("test_volume"), F.round("base_volume", 6).alias("base_volume"), "compressed")


@query("top_per_group", """
SELECT l_suppkey AS token, rn, l_extendedprice AS value_usd FROM (SELECT l_suppkey, l_extendedprice,
  row_number() OVER (PARTITION BY l_suppkey ORDER BY l_extendedprice DESC) AS rn FROM lineitem) WHERE rn <= 5""")
def top_per_group(spark, sf):
    w = W.partitionBy("token").orderBy(F.col("value_usd").desc())
    t = pool_trades(spark, sf).select("token", "value_usd")
    return t.withColumn("rn", F.row_number().over(w)).filter("rn <= 5").select("token", F.col("rn").cast("bigint").alias("rn"), "value_usd")
