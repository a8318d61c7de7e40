"""Prediction-market bets."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark import bindings as b
from tidemark.catalog.base import query, with_
from tidemark.functions import text as tx
from tidemark.operators import bets as bt
from tidemark.operators import joins as jn

# An order is a market: its text names a probability and a confidence level.
MARKETS_SQL = """
mk AS (SELECT o_orderkey AS id, o_orderkey AS pos, (o_custkey % 99 + 1) / 100 AS yes_price, o_totalprice * 10 AS volume,
        o_totalprice * 4 AS liquidity, 'We estimate ' || (o_orderkey * 7 % 101) || '% with ' || (['High', 'medium', 'low', 'no'])[(o_orderkey % 4 + 1)::INT]
          || ' confidence; 5% doubt' || CASE WHEN o_orderstatus = 'P' THEN ' extreme_odds' ELSE '' END AS research,
        date_diff('day', o_orderdate::DATE, DATE '2001-11-05')::INT AS days_to_resolve FROM orders)"""

PARSED_SQL = r"""
pr AS (SELECT *, coalesce(TRY_CAST(nullif(regexp_extract(research, '([0-9]+)%', 1), '') AS DOUBLE) / 100, 0.5::DOUBLE) AS p,
        CASE WHEN contains(lower(research), 'high confidence') THEN 0.8::DOUBLE WHEN contains(lower(research), 'medium confidence') THEN 0.6::DOUBLE
             WHEN contains(lower(research), 'low confidence') THEN 0.4::DOUBLE ELSE 0.5::DOUBLE END AS conf FROM mk)"""


def markets(spark, sf):
    o, k = b.table(spark, sf, "orders"), F.col("o_orderkey")
    level = F.element_at(F.array(*[F.lit(x) for x in ("High", "medium", "low", "no")]), (k % 4 + 1).cast("int"))
    research = F.concat(F.lit("We estimate "), k * 7 % 101, F.lit("% with "), level, F.lit(" confidence; 5% doubt"),
                        F.when(F.col("o_orderstatus") == "P", " extreme_odds").otherwise(""))
    return o.select(k.alias("id"), k.alias("pos"), ((F.col("o_custkey") % 99 + 1) / 100).alias("yes_price"),
                    (F.col("o_totalprice") * 10).alias("volume"), (F.col("o_totalprice") * 4).alias("liquidity"), research.alias("research"),
                    F.date_diff(F.lit(b.AS_OF[:10]).cast("date"), F.to_date("o_orderdate")).alias("days_to_resolve"))


BETS_SQL = """
e0 AS (SELECT *, p < 0.2::DOUBLE OR p > 0.8::DOUBLE AS extreme, p - yes_price AS edge FROM pr WHERE volume >= 1000000 AND liquidity >= 500000),
e1 AS (SELECT *, CASE WHEN edge > 0 THEN p ELSE 1 - p END AS win, CASE WHEN edge > 0 THEN yes_price ELSE 1 - yes_price END AS stake FROM e0
      WHERE NOT (extreme AND (contains(upper(research), 'EXTREME_ODDS') OR p < 0.15::DOUBLE)) AND abs(edge) >= 0.10::DOUBLE
        AND NOT (extreme AND abs(edge) < 0.15::DOUBLE)),
e2 AS (SELECT *, CASE WHEN stake > 0 THEN (1 - stake) / stake ELSE 0 END AS odds FROM e1),
e3 AS (SELECT *, CASE WHEN odds > 0 THEN (win * odds - (1 - win)) / odds END AS frac FROM e2),
e4 AS (SELECT *, CASE WHEN odds > 0 THEN least(greatest(3.0::DOUBLE * frac * 0.25::DOUBLE, 0.5::DOUBLE), 3.0::DOUBLE) ELSE 3.0::DOUBLE * 0.1::DOUBLE END AS kelly FROM e3),
bets AS (SELECT *, floor(greatest(0.5::DOUBLE, least(CASE WHEN extreme THEN least(kelly, 1.0::DOUBLE) ELSE kelly END, 3.0::DOUBLE * abs(edge) * conf))
        * 100 + 0.5::DOUBLE) / 100 AS amount FROM e4)"""
BETS = with_(MARKETS_SQL, PARSED_SQL, BETS_SQL)


@query("evaluate_bets", BETS + """SELECT id, CASE WHEN edge > 0 THEN 'YES' ELSE 'NO' END AS side, round(abs(edge), 6) AS edge, conf AS confidence,
  p AS probability, extreme AS is_extreme, amount, round(coalesce(frac, 0), 6) AS kelly_fraction,
  CASE WHEN p < 0.15::DOUBLE AND edge > 0.05::DOUBLE THEN 'LOW_PROB_HIGH_EDGE - Review carefully (Fed pattern)' END AS warning FROM bets""")
def evaluate_bets(spark, sf):
    e = bt.evaluate(markets(spark, sf))
    return e.select("id", "side", F.round("edge", 6).alias("edge"), "confidence", "probability", "is_extreme", "amount",
                    F.round("kelly_fraction", 6).alias("kelly_fraction"), "warning")


@query("simple_edge", with_(MARKETS_SQL, PARSED_SQL) + """SELECT id, p AS probability, round(abs(p - 0.5::DOUBLE), 6) AS edge,
  CASE WHEN p > 0.5::DOUBLE THEN 'YES' ELSE 'NO' END AS side FROM (SELECT * FROM pr ORDER BY pos LIMIT 5)
WHERE volume >= 500000 AND abs(p - 0.5::DOUBLE) >= 0.10::DOUBLE""")
def simple_edge(spark, sf):
    return bt.simple_edge(markets(spark, sf)).select("id", "probability", F.round("edge", 6).alias("edge"), "side")


@query("pct_from_text", with_(MARKETS_SQL, PARSED_SQL) + "SELECT id, p AS probability FROM pr")
def pct_from_text(spark, sf):
    return markets(spark, sf).select("id", tx.percent_in(F.col("research")).alias("probability"))


@query("confidence_from_text", with_(MARKETS_SQL, PARSED_SQL) + "SELECT id, conf AS confidence FROM pr")
def confidence_from_text(spark, sf):
    return markets(spark, sf).select("id", tx.confidence_in(F.col("research")).alias("confidence"))


WALLETS_SQL = """
ws AS (SELECT c_custkey AS wallet, greatest(c_acctbal, 0) * 1.5::DOUBLE AS total_profit, n AS total_trades, wins / n AS win_rate FROM customer
      JOIN (SELECT o_custkey, count(*) AS n, count(*) FILTER (o_orderstatus <> 'F') AS wins FROM orders GROUP BY 1) ON o_custkey = c_custkey),
sc AS (SELECT *, least(least(total_profit / 10000, 1) * 0.4::DOUBLE + win_rate * 0.3::DOUBLE + least(total_trades / 100, 1) * 0.3::DOUBLE, 1) AS score FROM ws)"""


def followed(spark, sf):
    n = b.table(spark, sf, "orders").groupBy(F.col("o_custkey").alias("wallet")).agg(
        F.count(F.lit(1)).alias("total_trades"), F.count_if(F.col("o_orderstatus") != "F").alias("wins"))
    c = b.table(spark, sf, "customer").select(F.col("c_custkey").alias("wallet"),
                                              (F.greatest(F.col("c_acctbal"), F.lit(0)) * 1.5).alias("total_profit"))
    w = c.join(n, "wallet").withColumn("win_rate", F.col("wins") / F.col("total_trades"))
    return w.withColumn("score", bt.wallet_score())


@query("wallet_score", with_(WALLETS_SQL) + "SELECT wallet, round(score, 6) AS score, score > 0.5::DOUBLE AS followed FROM sc")
def wallet_score(spark, sf):
    return followed(spark, sf).select("wallet", F.round("score", 6).alias("score"), (F.col("score") > 0.5).alias("followed"))


@query("copy_signals", with_(WALLETS_SQL) + """SELECT wallet, o_orderkey AS position_id, o_totalprice AS size, round(win_rate * score, 6) AS confidence,
  win_rate * score >= 0.80::DOUBLE AS execute FROM sc JOIN orders ON o_custkey = wallet WHERE score > 0.5::DOUBLE AND o_totalprice > 100
ORDER BY win_rate * score * o_totalprice DESC, o_orderkey LIMIT 5""")
def copy_signals(spark, sf):
    pos = b.table(spark, sf, "orders").select(F.col("o_custkey").alias("wallet"), F.col("o_orderkey").alias("position_id"),
                                              F.col("o_totalprice").alias("size"))
    s = bt.copy_signals(jn.whale_positions(followed(spark, sf), pos, min_score=0.5))
    return s.select("wallet", "position_id", "size", F.round("confidence", 6).alias("confidence"), "execute")


FORM_SQL = """
f AS (SELECT count(*) FILTER (pnl > 0) / count(*) AS win_rate, round(sum(pnl), 4) AS total_pnl, (SELECT count(*) FROM lineitem) AS trades
      FROM (SELECT l_extendedprice * (l_discount - 0.05::DOUBLE) AS pnl FROM lineitem
        ORDER BY l_shipdate DESC, l_orderkey DESC, l_linenumber DESC, l_extendedprice DESC LIMIT 10))"""


def settled(spark, sf):
    li = b.table(spark, sf, "lineitem")
    return li.select("l_shipdate", "l_orderkey", "l_linenumber", "l_extendedprice",
                     (F.col("l_extendedprice") * (F.col("l_discount") - 0.05)).alias("pnl"))


def form(spark, sf):
    newest = [F.col(c).desc() for c in ("l_shipdate", "l_orderkey", "l_linenumber", "l_extendedprice")]
    return bt.recent_form(settled(spark, sf), newest).withColumn("total_pnl", F.round("total_pnl", 4))


@query("recent_win_rate", with_(FORM_SQL) + "SELECT win_rate, total_pnl, trades FROM f")
def recent_win_rate(spark, sf):
    return form(spark, sf)


@query("strategy_adjustment", with_(FORM_SQL) + """SELECT CASE WHEN trades < 5 THEN 0 WHEN win_rate < 0.4::DOUBLE OR total_pnl < -30 THEN -1
  WHEN win_rate > 0.6::DOUBLE AND total_pnl > 50 THEN 1 ELSE 0 END AS adjustment,
  CASE WHEN trades < 5 THEN 'baseline' WHEN win_rate < 0.4::DOUBLE OR total_pnl < -30 THEN 'conservative'
  WHEN win_rate > 0.6::DOUBLE AND total_pnl > 50 THEN 'aggressive' ELSE 'standard' END AS mode,
  CASE WHEN trades < 5 THEN 0.10::DOUBLE WHEN win_rate < 0.4::DOUBLE OR total_pnl < -30 THEN 0.15::DOUBLE WHEN win_rate > 0.6::DOUBLE AND total_pnl > 50 THEN 0.08::DOUBLE ELSE 0.10::DOUBLE END AS min_edge FROM f""")
def strategy_adjustment(spark, sf):
    return bt.strategy_adjustment(form(spark, sf)).select("adjustment", "mode", "min_edge")


@query("stop_loss", """SELECT order_id, line_no, round(loss, 6) AS loss FROM (SELECT l_orderkey AS order_id, l_linenumber AS line_no,
  (mark - l_extendedprice / l_quantity) / (l_extendedprice / l_quantity) AS loss FROM lineitem JOIN
  (SELECT l_partkey, arg_max(l_extendedprice / l_quantity, (l_shipdate, l_orderkey, l_linenumber, l_extendedprice / l_quantity)) AS mark
   FROM lineitem GROUP BY 1) USING (l_partkey) WHERE l_returnflag <> 'R') WHERE loss <= -0.20::DOUBLE""")
def stop_loss(spark, sf):
    t = b.trades(spark, sf)
    mark = t.groupBy("token").agg(b.last_price().alias("current"))
    pos = t.filter("side = 'buy'").join(mark, "token").withColumnRenamed("price", "entry")
    return bt.stop_loss(pos).select("order_id", "line_no", F.round("loss", 6).alias("loss"))


ALLOC_SQL = """
c AS (SELECT o_orderpriority AS portfolio, o_orderdate::DATE AS day, o_orderkey AS id, o_totalprice AS edge, o_orderkey * 7 % 251 AS amt,
        row_number() OVER (PARTITION BY o_orderpriority, o_orderdate::DATE ORDER BY o_totalprice DESC, o_orderkey) AS k FROM orders),
g(portfolio, day, k, used, ok) AS (SELECT portfolio, day, k, CASE WHEN amt <= 400 THEN amt ELSE 0 END, amt <= 400 FROM c WHERE k = 1 UNION ALL
      SELECT c.portfolio, c.day, c.k, g.used + CASE WHEN g.used + c.amt <= 400 THEN c.amt ELSE 0 END, g.used + c.amt <= 400
      FROM g JOIN c ON c.portfolio = g.portfolio AND c.day = g.day AND c.k = g.k + 1)"""


@query("exposure_allocation", with_(ALLOC_SQL) + """SELECT portfolio, day, id, amt / 100 AS amount FROM g JOIN c USING (portfolio, day, k) WHERE ok""")
def exposure_allocation(spark, sf):
    """Bets of a day and portfolio, zero and cents among them, under a limit of 4, low enough for some to be refused."""
    o = b.table(spark, sf, "orders").select(
        F.col("o_orderpriority").alias("portfolio"), F.to_date("o_orderdate").alias("day"), F.col("o_orderkey").alias("id"),
        F.col("o_totalprice").alias("edge"), ((F.col("o_orderkey") * 7 % 251) / 100).alias("amount"))
    return bt.allocate(o, ["portfolio", "day"], limit=4.0)


@query("hedge_tier", """SELECT doc_id, CASE WHEN contains(text, 'an') THEN 0.95::DOUBLE ELSE 0.92::DOUBLE END AS coverage FROM documents
WHERE contains(text, 'an') OR contains(text, 'th')""")
def hedge_tier(spark, sf):
    """Tier names are put in place of three frequent syllables, as the texts name no tiers."""
    t = F.replace(F.replace(F.replace("text", F.lit("an"), F.lit(" T1 ")), F.lit("th"), F.lit(" T2 ")), F.lit("de"), F.lit(" T3 "))
    d = b.table(spark, sf, "documents").select("doc_id", t.alias("analysis"))
    return bt.hedges(d).select("doc_id", "coverage")


@query("hedge_lines", """SELECT doc_id, i - 1 AS line_no, lines[i] AS raw_line FROM (SELECT doc_id, lines, unnest(range(1, len(lines) + 1)) AS i FROM (
  SELECT doc_id, string_split(replace(replace(replace(text, 'an', ' T1 '), 'th', ' T2 '), 'de', ' T3 '), chr(10)) AS lines FROM documents))
WHERE (contains(lines[i], 'T1') OR contains(lines[i], 'T2')) AND (contains(lower(lines[i]), 'coverage') OR contains(lines[i], '%'))""")
def hedge_lines(spark, sf):
    """The lines a hedge scan keeps; tier names are put in place of syllables as in ``hedge_tier``."""
    t = F.replace(F.replace(F.replace("text", F.lit("an"), F.lit(" T1 ")), F.lit("th"), F.lit(" T2 ")), F.lit("de"), F.lit(" T3 "))
    d = b.table(spark, sf, "documents").select("doc_id", t.alias("output"))
    return bt.hedge_lines(d).select("doc_id", F.col("line_no").cast("bigint").alias("line_no"), "raw_line")


@query("bet_redflags", BETS + """SELECT id, flags FROM (SELECT id, concat_ws(',', CASE WHEN p < 0.2::DOUBLE OR p > 0.8::DOUBLE THEN 'EXTREME_PROBABILITY' END,
  CASE WHEN conf <= 0.4::DOUBLE THEN 'LOW_CONFIDENCE' END, CASE WHEN days_to_resolve > 30 THEN 'FAR_RESOLUTION' END,
  CASE WHEN amount > 3 THEN 'OVERSIZED' END) AS flags FROM bets) WHERE flags <> ''""")
def bet_redflags(spark, sf):
    m = markets(spark, sf)
    e = bt.evaluate(m).join(m.select("id", "days_to_resolve"), "id")
    return bt.red_flags(e).select("id", F.array_join("flags", ",").alias("flags"))
