"""Stream operators run to completion over the event table. Their SQL is the batch equivalent, limited to what
the final watermark has closed."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.catalog.agents import STATUS_SQL, updates
from tidemark.catalog.base import query, with_
from tidemark.session import shared_dir
from tidemark.streaming import sinks
from tidemark.streaming import stateful as st
from tidemark.streaming import windows as wi

EVENTS = "events.parquet"


def stream(spark, sf, delay="0 seconds"):
    e = wi.read_files(spark, sf, EVENTS)
    e = e.select(F.col("event_type").alias("key"), "ts", "event_id", F.col("value").alias("price"), F.col("user_id").alias("wallet"),
                 F.when(F.col("value") >= 30, "buy").otherwise("sell").alias("side"))
    return wi.timed(e, delay)


WM = "wm AS (SELECT epoch_us(max(ts)) // 1000 AS w FROM events)"


def bucket(hours: int, ts: str = "ts") -> str:
    ms = hours * 3_600_000
    return f"make_timestamp_ms(epoch_us({ts}) // {ms * 1000} * {ms})"


def closes_sql(hours: int) -> str:
    return f"""
ca AS (SELECT event_type AS key, {bucket(hours)} AS bucket, arg_min(value, (ts, event_id)) AS o, max(value) AS h, min(value) AS l,
        arg_max(value, (ts, event_id)) AS c, count(*) AS n FROM events GROUP BY 1, 2),
closed AS (SELECT ca.* FROM ca, wm WHERE epoch_ms(bucket) + {hours * 3_600_000} <= w)"""


@query("stream_candles", with_(WM, closes_sql(6)) + "SELECT key, bucket, o, h, l, c, n FROM closed")
def stream_candles(spark, sf):
    c = wi.candles(stream(spark, sf), "6 hours", ["ts", "event_id"]).drop("at")
    return wi.run_available(c, "stream_candles")


@query("stream_sliding_activity", with_(WM, f"""
small AS (SELECT event_type AS key, {bucket(2)} AS b, count(*) AS n, sum(value) AS volume FROM events GROUP BY 1, 2),
big AS (SELECT key, b - INTERVAL 2 HOUR * k::INT AS from_ts, sum(n)::BIGINT AS n, round(sum(volume), 2) AS volume FROM small, range(12) r(k) GROUP BY 1, 2)""")
       + "SELECT key, from_ts, n, volume FROM big, wm WHERE epoch_ms(from_ts) + 86400000 <= w")
def stream_sliding_activity(spark, sf):
    return wi.run_available(wi.sliding_activity(stream(spark, sf)), "stream_sliding")


@query("stream_convergence", with_("wm AS (SELECT epoch_us(max(ts)) // 1000 AS w FROM events WHERE value >= 30)") + f"""SELECT key, bucket, wallets FROM (SELECT event_type AS key, {bucket(24)} AS bucket, count(DISTINCT user_id) AS wallets
  FROM events WHERE value >= 30 GROUP BY 1, 2), wm WHERE wallets >= 25 AND epoch_ms(bucket) + 86400000 <= w""")
def stream_convergence(spark, sf):
    # the filter is pushed below the watermark, so only purchases move it
    return wi.run_available(wi.convergence(stream(spark, sf).filter("side = 'buy'"), 25), "stream_convergence")


@query("stream_convergence_sketch", with_("wm AS (SELECT epoch_us(max(ts)) // 1000 AS w FROM events WHERE value >= 30)", f"""
each AS (SELECT DISTINCT event_type AS key, {bucket(2)} AS b, user_id FROM events WHERE value >= 30),
wide AS (SELECT key, b - INTERVAL 2 HOUR * k::INT AS from_ts, count(DISTINCT user_id) AS wallets FROM each, range(12) r(k) GROUP BY 1, 2)""") + """
SELECT key, from_ts, wallets, true AS close FROM wide, wm WHERE epoch_ms(from_ts) + 86400000 <= w""")
def stream_convergence_sketch(spark, sf):
    """Sketched counts of every window beside the exact ones of a batch: ``close`` tells whether they differ by 3 % at most."""
    buys = stream(spark, sf).filter("side = 'buy'")
    got = wi.run_available(wi.convergence_sketch(buys, 1), "stream_sketch").withColumnRenamed("wallets", "guess")
    e = spark.read.parquet(f"{sf}/{EVENTS}").filter("value >= 30")
    each = e.select(F.col("event_type").alias("key"), F.window(F.col("ts").cast("timestamp"), "24 hours", "2 hours")["start"].alias("from_ts"), "user_id").distinct()
    exact = each.groupBy("key", "from_ts").agg(F.count(F.lit(1)).alias("wallets"))
    return got.join(exact, ["key", "from_ts"]).select("key", "from_ts", "wallets", (F.abs(F.col("guess") - F.col("wallets")) <= 0.03 * F.col("wallets")).alias("close"))


@query("stream_volume_spike", with_(WM) + f"""SELECT key, bucket, round(volume, 2) AS volume, buys, sells FROM (SELECT event_type AS key, {bucket(1)} AS bucket,
  sum(value) AS volume, count(*) FILTER (value >= 30) AS buys, count(*) FILTER (value < 30) AS sells FROM events GROUP BY 1, 2), wm
WHERE volume > 100 AND CASE WHEN sells = 0 THEN 1 ELSE buys / sells END > 1.5::DOUBLE AND epoch_ms(bucket) + 3600000 <= w""")
def stream_volume_spike(spark, sf):
    return wi.run_available(wi.volume_spikes(stream(spark, sf), 100), "stream_spikes")


@query("stream_alert_dedup", "SELECT DISTINCT event_type || '-' || user_id || '-' || strftime(ts, '%Y-%m-%d') AS subject FROM events")
def stream_alert_dedup(spark, sf):
    s = stream(spark, sf, "1 day")
    subject = F.concat_ws("-", "key", "wallet", F.date_format("ts", "yyyy-MM-dd"))
    return wi.run_available(wi.once_per_period(s.withColumn("subject", subject), ["subject"]).select("subject"), "stream_dedup")


@query("stream_cooldown", with_("""
c AS (SELECT user_id, sec, row_number() OVER (PARTITION BY user_id ORDER BY sec) AS k
      FROM (SELECT DISTINCT user_id, epoch_us(ts) // 1000000 AS sec FROM events WHERE event_type = 'error')
      WHERE (sec + 1) * 1000 <= (SELECT epoch_us(max(ts)) // 1000 - 60000 FROM events WHERE event_type = 'error')),
nxt AS (SELECT a.user_id, a.k, min(b.k) AS nk FROM c a LEFT JOIN c b ON b.user_id = a.user_id AND b.sec >= a.sec + 259200 GROUP BY 1, 2),
sent(user_id, k) AS (SELECT user_id, 1::BIGINT FROM c WHERE k = 1 UNION ALL
      SELECT s.user_id, n.nk FROM sent s JOIN nxt n ON n.user_id = s.user_id AND n.k = s.k WHERE n.nk IS NOT NULL)""") + """
SELECT user_id AS key, sec FROM sent JOIN c USING (user_id, k)""")
def stream_cooldown(spark, sf):
    c = stream(spark, sf, "1 minute").filter("key = 'error'").select(F.col("wallet").alias("key"), "ts")
    return wi.run_available(st.cooldown(c, "BIGINT"), "stream_cooldown")


CHK = "chk AS (SELECT key, epoch_ms(bucket) // 1000 AS sec, c AS price, row_number() OVER (PARTITION BY key ORDER BY bucket) AS i FROM closed)"
EMA_STREAM = """
seed AS (SELECT key, sum(price) / 50 AS e FROM chk WHERE i <= 50 GROUP BY key HAVING count(*) = 50),
ema(key, i, e) AS (SELECT key, 50::BIGINT, e FROM seed UNION ALL SELECT c.key, c.i, (c.price - r.e) * (2.0::DOUBLE / 51) + r.e FROM ema r JOIN chk c ON c.key = r.key AND c.i = r.i + 1),
ce AS (SELECT key, sec, price, e, price > e AS above, i - 49 AS idx FROM chk JOIN ema USING (key, i))"""


def hourly(spark, sf):
    return st.as_checks(wi.candles(stream(spark, sf), "1 hour", ["ts", "event_id"]))


@query("stream_hysteresis", with_(WM, closes_sql(1), CHK) + """SELECT key, sec, price, zone FROM (SELECT *, lag(zone) OVER (PARTITION BY key ORDER BY sec) AS pz FROM (
  SELECT *, CASE WHEN price < 10 THEN 'below_low' WHEN price > 100 THEN 'above_high' ELSE 'mid' END AS zone FROM chk)) WHERE zone <> 'mid' AND zone IS DISTINCT FROM pz""")
def stream_hysteresis(spark, sf):
    return wi.run_available(st.hysteresis(hourly(spark, sf), 10, 100), "stream_hysteresis")


@query("stream_cross", with_(WM, closes_sql(1), CHK, EMA_STREAM) + """SELECT key, sec, price, round(e, 6) AS ema, CASE WHEN above THEN 'breakout' ELSE 'breakdown' END AS event
FROM (SELECT *, lag(above) OVER (PARTITION BY key ORDER BY sec) AS was FROM ce) WHERE above <> was""")
def stream_cross(spark, sf):
    x = wi.run_available(st.crosses(hourly(spark, sf)), "stream_cross")
    return x.withColumn("ema", F.round("ema", 6))


@query("stream_ema_monitor", with_(WM, closes_sql(1), CHK, EMA_STREAM, """
runs AS (SELECT *, idx - coalesce(max(CASE WHEN above THEN idx END) OVER (PARTITION BY key ORDER BY sec), 0) AS below_count FROM ce),
cand AS (SELECT *, row_number() OVER (PARTITION BY key ORDER BY sec) AS k FROM runs WHERE NOT above AND ((below_count = 1 AND idx > 1) OR below_count >= 2)),
nxt AS (SELECT a.key, a.k, min(c.k) AS nk FROM cand a LEFT JOIN cand c ON c.key = a.key AND c.sec >= a.sec + 21600 GROUP BY 1, 2),
sent(key, k) AS (SELECT key, 1::BIGINT FROM cand WHERE k = 1 UNION ALL
      SELECT s.key, n.nk FROM sent s JOIN nxt n ON n.key = s.key AND n.k = s.k WHERE n.nk IS NOT NULL)""") + """
SELECT key, sec, price, round(e, 6) AS ema, below_count FROM sent JOIN cand USING (key, k)""")
def stream_ema_monitor(spark, sf):
    x = wi.run_available(st.ema_monitor(hourly(spark, sf)), "stream_ema")
    return x.withColumn("ema", F.round("ema", 6))


@query("stream_heartbeat", with_(WM) + """SELECT key, ms + 300000 AS stale_at FROM (SELECT user_id AS key, epoch_us(ts) // 1000 AS ms,
  lead(epoch_us(ts) // 1000) OVER (PARTITION BY user_id ORDER BY ts) AS nx FROM events), wm WHERE coalesce(nx - ms > 300000, ms + 300000 <= w)""")
def stream_heartbeat(spark, sf):
    return wi.run_available(st.heartbeats(stream(spark, sf).select(F.col("wallet").alias("key"), "ts"), "BIGINT"), "stream_heartbeat")


@query("stream_expiry", """SELECT event_id AS key, epoch_us(ts) // 1000 + 21600000 AS expired_at FROM events
WHERE event_type = 'signup' AND epoch_us(ts) // 1000 + 21600000 <= (SELECT epoch_us(max(ts)) // 1000 FROM events WHERE event_type = 'signup')""")
def stream_expiry(spark, sf):
    # the filter is pushed below the watermark, so only these events move it
    o = stream(spark, sf).filter("key = 'signup'").select(F.col("event_id").alias("key"), "ts")
    return wi.run_available(st.deadlines(o, "BIGINT"), "stream_expiry")


ALERT_DAYS = ("ts < TIMESTAMP '2024-01-11'", "ts >= TIMESTAMP '2024-01-11' AND ts < TIMESTAMP '2024-01-21'", "ts >= TIMESTAMP '2024-01-21'")


def delivered(spark, sf, kind, name):
    """Events of one kind (of all without) as a stream over a folder that gets a new part before each run."""
    e = spark.read.parquet(f"{sf}/{EVENTS}")
    e = (e.filter(F.col("event_type") == kind) if kind else e).withColumn("ts", F.col("ts").cast("timestamp"))
    return e, shared_dir(spark, name)


@query("stream_alert_sink", f"""SELECT user_id AS wallet, ts::DATE AS day, CASE WHEN {ALERT_DAYS[0]} THEN 0 WHEN {ALERT_DAYS[2]} THEN 2 ELSE 1 END AS batch_id,
  min(event_id) AS event_id, count(*) AS stored FROM (SELECT *, row_number() OVER (PARTITION BY user_id, ts::DATE ORDER BY ts, event_id) AS rn FROM events
  WHERE event_type = 'error') WHERE rn = 1 GROUP BY ALL""")
def stream_alert_sink(spark, sf):
    """Three batches into the alert table, one alert per wallet and day, then all of them a second time by a query that lost its checkpoint."""
    e, path = delivered(spark, sf, "error", "alert-events")
    table = shared_dir(spark, "alert-table")
    for again in (False, True):
        checkpoint, source = shared_dir(spark, "alert-checkpoint"), path if not again else shared_dir(spark, "alert-again")
        for folder in sinks.parts(e.select("user_id", "ts", "event_id"), source, [F.expr(c) for c in ALERT_DAYS]):
            s = spark.readStream.schema("user_id BIGINT, ts TIMESTAMP, event_id BIGINT").parquet(folder)
            alerts = s.select(F.col("user_id").alias("wallet"), F.to_date("ts").alias("on_day"), "ts", "event_id")
            sinks.alert_sink(alerts, table, checkpoint, ["wallet", "on_day"], "ts", ["event_id"])
    t = spark.read.parquet(table).groupBy("wallet", "day", "batch_id").agg(F.min("event_id").alias("event_id"), F.count(F.lit(1)).alias("stored"))
    return t.withColumn("batch_id", F.col("batch_id").cast("int"))


@query("stream_state_upsert", with_(STATUS_SQL) + "SELECT agent, status, last_heartbeat, last_activity FROM latest")
def stream_state_upsert(spark, sf):
    """The newest state of every agent from batches that are out of order, the first of them delivered twice."""
    table, checkpoint, source = (shared_dir(spark, f"state-{x}") for x in ("table", "checkpoint", "events"))
    up = updates(spark, sf).withColumn("ts", F.col("ts").cast("timestamp"))
    turn = F.pmod(F.xxhash64("event_id"), F.lit(3))
    for folder in sinks.parts(up, source, [turn == 2, turn == 0, turn == 2, turn == 1]):
        s = spark.readStream.schema(up.schema).parquet(folder)
        sinks.state_sink(s, table, checkpoint, "agent", "ts", "event_id", buckets=8)
    t = spark.read.parquet(table)
    return t.select("agent", "status", *[F.col(c).cast("timestamp_ntz").alias(c) for c in ("last_heartbeat", "last_activity")])


@query("stream_late_data", f"""SELECT key, bucket, n FROM (SELECT event_type AS key, {bucket(1)} AS bucket, count(*) AS n FROM events
  WHERE ts >= TIMESTAMP '2024-01-15' GROUP BY 1, 2), (SELECT epoch_us(max(ts)) // 1000 - 1800000 AS w FROM events) WHERE epoch_ms(bucket) + 3600000 <= w""")
def stream_late_data(spark, sf):
    """The later half arrives first, in two batches; the earlier half is then older than the 30 minutes allowed.

    A batch judges lateness by the watermark its predecessor worked with, so the third one drops its rows.
    """
    path = shared_dir(spark, "late")
    e = spark.read.parquet(f"{sf}/{EVENTS}").select("event_type", "ts")
    later = "ts >= TIMESTAMP_NTZ '2024-01-15'"
    parts = (f"{later} AND event_type <> 'error'", f"{later} AND event_type = 'error'", f"NOT {later}")
    sizes = e.agg(*[F.count_if(F.expr(p)).alias(f"n{i}") for i, p in enumerate(parts)]).first()
    files = max(1, min(spark.sparkContext.defaultParallelism, min(sizes) // 8))  # as many for each part: that is how a batch takes a part
    for part in parts:
        e.filter(part).repartition(files).write.mode("append").parquet(path)
    late = wi.timed(wi.read_files(spark, path, "*.parquet", files_per_batch=files), "30 minutes")
    n = late.groupBy(F.window("ts", "1 hour").alias("w"), F.col("event_type").alias("key")).agg(F.count(F.lit(1)).alias("n"))
    return wi.run_available(n.select("key", F.col("w.start").alias("bucket"), "n"), "stream_late")
