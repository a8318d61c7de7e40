"""Aggregations over listings, snapshots, texts and events."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark import bindings as b
from tidemark import fixed
from tidemark.catalog.base import query, with_
from tidemark.functions import text as tx
from tidemark.functions.values import epoch, ntz
from tidemark.operators import aggregates as ag
from tidemark.operators import filters as fl

UNIQUE_SQL = """
uniq AS (SELECT * EXCLUDE rn FROM (SELECT *, row_number() OVER (PARTITION BY platform, contract ORDER BY source_rank, pos) AS rn
        FROM listings WHERE contract <> '') WHERE rn = 1 UNION ALL SELECT * FROM listings WHERE contract = '')"""


@query("dedup_tokens", with_(b.LISTINGS_SQL, UNIQUE_SQL) + "SELECT source, platform, contract, pos, market_cap FROM uniq")
def dedup_tokens(spark, sf):
    return ag.dedup_tokens(b.listings(spark, sf)).select("source", "platform", "contract", "pos", "market_cap")


STAGES_SQL = """
st AS (SELECT *, """ + b.LISTING_AGE_SQL + """ AS age FROM uniq),
cl AS (SELECT age >= 4 AND age <= 10 AS win, age < 4 AS fresh, age > 10 AS old, change_24h < -5 AS falling,
        change_24h > 200 AS para, market_cap BETWEEN 100000 AND 500000 AS match, market_cap > 0 AS has_mc FROM st)"""


@query("filter_funnel", with_(b.LISTINGS_SQL, UNIQUE_SQL, STAGES_SQL) + """
SELECT count(*) AS unique_tokens, count(*) FILTER (fresh) AS too_fresh, count(*) FILTER (old) AS too_old,
  count(*) FILTER (win) AS in_window, count(*) FILTER (win AND falling) AS falling, count(*) FILTER (win AND para) AS parabolic,
  count(*) FILTER (win AND NOT falling AND NOT para) AS momentum,
  count(*) FILTER (win AND NOT falling AND NOT para AND match) AS matches,
  count(*) FILTER (win AND NOT falling AND NOT para AND NOT match AND has_mc) AS others FROM cl""")
def filter_funnel(spark, sf):
    u = ag.dedup_tokens(b.listings(spark, sf))
    return ag.filter_funnel(u, fl.age_or_estimate(epoch("created_at"), epoch(ntz(b.AS_OF))))


@query("whale_confirmations", with_(b.TRADES_SQL) + "SELECT token, count(DISTINCT wallet) AS wallets FROM t WHERE side = 'buy' GROUP BY token")
def whale_confirmations(spark, sf):
    return ag.confirmations(b.trades(spark, sf, wallets=True))


@query("buys_by_token", with_(b.TRADES_SQL) + """SELECT token, count(*) AS buys,
  arg_min('S' || order_id || '-' || line_no, (ts, order_id, line_no, price)) AS first_symbol FROM t WHERE side = 'buy' GROUP BY token""")
def buys_by_token(spark, sf):
    t = b.trades(spark, sf).withColumn("symbol", F.concat(F.lit("S"), "order_id", F.lit("-"), "line_no"))
    return ag.buys_by_token(t, b.TRADE_ORDER)


POSTS_SQL = """
posts AS (SELECT lang, source, lower(text) AS low, text, (n_chars % 500) + (n_chars % 70) + (n_chars % 30) AS engagement FROM documents),
word AS (SELECT *, 100 + engagement AS w, """ + " OR ".join(f"contains(low, '{w}')" for w in fixed.BULL_WORDS) + """ AS bull,
        """ + " OR ".join(f"contains(low, '{w}')" for w in fixed.BEAR_WORDS) + """ AS bear FROM posts)"""

SENTIMENT_COLS = """
  bullish, bearish, posts, engagement, CASE WHEN bullish + bearish = 0 THEN 0.5 ELSE bullish / (bullish + bearish) END AS score,
  CASE WHEN bullish + bearish = 0 THEN 'neutral' WHEN bullish / (bullish + bearish) > 0.6::DOUBLE THEN 'bullish'
       WHEN bullish / (bullish + bearish) < 0.4::DOUBLE THEN 'bearish' ELSE 'neutral' END AS sentiment,
  least((bullish + bearish) / 20, 1) AS confidence, CASE WHEN posts = 0 THEN 0 ELSE engagement / posts END AS avg_engagement"""


def sentiment_sql(source: str, by: str = "") -> str:
    keys = f"{by}, " if by else ""
    return f"""SELECT {keys}{SENTIMENT_COLS} FROM (SELECT {keys}coalesce(sum(w) FILTER (bull), 0)::DOUBLE / 100 AS bullish,
  coalesce(sum(w) FILTER (bear), 0)::DOUBLE / 100 AS bearish, count(*) AS posts, coalesce(sum(engagement), 0)::BIGINT AS engagement
  FROM {source} {'GROUP BY ' + by if by else ''})"""


def posts(spark, sf):
    n = F.col("n_chars")
    return b.table(spark, sf, "documents").select("lang", "source", "text", (n % 500 + n % 70 + n % 30).alias("engagement"))


@query("sentiment", with_(POSTS_SQL) + sentiment_sql("word", "source"))
def sentiment(spark, sf):
    return ag.sentiment(posts(spark, sf), by=["source"])


TOPICAL = " OR ".join(f"contains(low, '{w}')" for w in fixed.TOPIC_WORDS)


@query("sentiment_signal", with_(POSTS_SQL, f"sel AS (SELECT * FROM word WHERE lang = 'en' OR (lang <> 'en' AND ({TOPICAL})))") + f"""
SELECT *, CASE sentiment WHEN 'bullish' THEN 'UP' WHEN 'bearish' THEN 'DOWN' ELSE 'NEUTRAL' END AS direction
FROM ({sentiment_sql("sel")})""")
def sentiment_signal(spark, sf):
    p = posts(spark, sf)
    return ag.sentiment_signal(p.filter("lang = 'en'"), p.filter("lang <> 'en'"))


@query("tweet_topics", f"SELECT doc_id, ({TOPICAL.replace('low', 'lower(text)')}) AS on_topic FROM documents")
def tweet_topics(spark, sf):
    return b.table(spark, sf, "documents").select(
        "doc_id", tx.contains_any(F.lower("text"), fixed.TOPIC_WORDS).alias("on_topic"))


@query("buy_sell_ratio", with_(b.SNAP_SQL) + "SELECT token, CASE WHEN sells = 0 THEN 1.0 ELSE buys / sells END AS ratio FROM snap")
def buy_sell_ratio(spark, sf):
    return b.snapshots(spark, sf).select("token", ag.buy_sell_ratio().alias("ratio"))


@query("daily_exposure", """SELECT l_shipdate::DATE AS day, round(sum(l_extendedprice), 2) AS exposure FROM lineitem
WHERE l_shipdate >= TIMESTAMP '2001-10-01' AND l_shipdate < TIMESTAMP '2001-10-02' GROUP BY 1""")
def daily_exposure(spark, sf):
    """Amount traded on one day; the bounds on the raw column reach the file scan."""
    li = b.table(spark, sf, "lineitem")
    day = li.filter((F.col("l_shipdate") >= ntz("2001-10-01 00:00:00")) & (F.col("l_shipdate") < ntz("2001-10-02 00:00:00")))
    return day.groupBy(F.to_date("l_shipdate").alias("day")).agg(F.round(F.sum("l_extendedprice"), 2).alias("exposure"))


@query("unusual_activity", with_("""
h AS (SELECT event_type AS key, date_trunc('hour', ts) AS bucket, count(*) AS n FROM events GROUP BY 1, 2),
w AS (SELECT *, count(n) OVER v AS c, sum(n) OVER v AS s, sum(n * n) OVER v AS q FROM h
      WINDOW v AS (PARTITION BY key ORDER BY bucket ROWS BETWEEN 24 PRECEDING AND 1 PRECEDING))""") + """
SELECT key, bucket, n, round(z, 6) AS z FROM (SELECT *, CASE WHEN c = 24 AND c * q > s * s THEN
  (n - s::DOUBLE / c) / sqrt((c * q - s * s)::DOUBLE / (c * (c - 1))) END AS z FROM w) WHERE z > 2""")
def unusual_activity(spark, sf):
    e = b.table(spark, sf, "events").select(F.col("event_type").alias("key"), "ts")
    return ag.unusual_activity(e, "key", "ts").select("key", "bucket", "n", F.round("z", 6).alias("z"))


@query("sector_performance", with_(b.SNAP_SQL) + """SELECT p_type AS sector, count(*) AS tokens,
  round(sum(volume_24h), 2) AS volume, round(avg(change_24h), 6) AS avg_change FROM snap JOIN part ON p_partkey = token GROUP BY 1""")
def sector_performance(spark, sf):
    sector = b.table(spark, sf, "part").select(F.col("p_partkey").alias("token"), F.col("p_type").alias("sector"))
    return (b.snapshots(spark, sf).join(sector, "token").groupBy("sector")
            .agg(F.count(F.lit(1)).alias("tokens"), F.round(F.sum("volume_24h"), 2).alias("volume"),
                 F.round(F.avg("change_24h"), 6).alias("avg_change")))
