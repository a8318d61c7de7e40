"""Engine scores, wallet-token scores, alerts and watchlist decisions."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidemark import bindings as b
from tidemark import fixed
from tidemark.catalog.base import query, with_
from tidemark.catalog.joins import PAIRS_SQL, TRACKED_SQL, pairs, signals, traded_recently
from tidemark.catalog.series import BARS, EMA, FEATURES_SQL, pool_candles
from tidemark.catalog.wallets import HELD_SQL, recent_trades
from tidemark.functions.values import epoch, hours_between, ntz
from tidemark.operators import aggregates as ag
from tidemark.operators import candles as cd
from tidemark.operators import scoring as sc
from tidemark.operators import wallets as wa
from tidemark.plans import wallet_scan


def points(*steps: tuple[str, str]) -> str:
    """Sum of CASE terms as doubles, in order; a step may hold several alternatives."""
    return "0.0::DOUBLE" + "".join(f" + CASE {s} ELSE 0.0::DOUBLE END" for s in steps)


def w(cond: str, p: float) -> str:
    return f"WHEN {cond} THEN {p}::DOUBLE"


SCAN_A = points(w("p1 > p3", .3), w("abs(change_24h) > 10", .2), w("change_24h > 0", .2))
SCAN_B = points(w("change_24h > 50", .3), w("change_24h > 20 AND change_24h < 200", .3), w("volume_24h > 100000", .2), w("p1 > p2", .2))
SCAN_C = points(w("market_cap >= 300000", .3) + " " + w("market_cap >= 100000", .1), w("change_24h > 20", .3),
                w("change_24h > 0 AND change_24h < 300", .2), w("p1 >= p2 * 0.95::DOUBLE", .2))

LAST3_SQL = """
l3 AS (SELECT token, max(price) FILTER (rn = 1) AS p1, max(price) FILTER (rn = 2) AS p2, max(price) FILTER (rn = 3) AS p3, count(*) AS n
      FROM (SELECT l_partkey AS token, l_extendedprice / l_quantity AS price, row_number() OVER (PARTITION BY l_partkey
        ORDER BY l_shipdate DESC, l_orderkey DESC, l_linenumber DESC, l_extendedprice / l_quantity DESC) AS rn FROM lineitem) WHERE rn <= 3 GROUP BY 1)"""


def engines_sql(a: str, bb: str, c: str, src: str, gate: bool = False, marks=(.5, .6, .6)) -> str:
    g3, g2 = ("n >= 3 AND ", "n >= 2 AND ") if gate else ("", "")
    wrap = (lambda e, n: f"CASE WHEN n >= {n} THEN {e} ELSE 0 END") if gate else (lambda e, n: e)
    return f"""SELECT token, round(sa, 6) AS score_a, round(sb, 6) AS score_b, round(sc, 6) AS score_c, round(sa + sb + sc, 6) AS total,
  concat_ws(',', CASE WHEN {g3}sa >= {marks[0]}::DOUBLE THEN 'A' END, CASE WHEN {g3}sb >= {marks[1]}::DOUBLE THEN 'B' END,
    CASE WHEN {g2}sc >= {marks[2]}::DOUBLE THEN 'C' END) AS engines
FROM (SELECT *, {wrap(a, 3)} AS sa, {wrap(bb, 3)} AS sb, {wrap(c, 2)} AS sc FROM {src})"""


def engine_columns(df):
    return df.select("token", *[F.round(f"score_{n}", 6).alias(f"score_{n}") for n in "abc"], F.round("total", 6).alias("total"), "engines")


def last_prices(spark, sf, n=3):
    """The last few prices per token, oldest first; the rank bound is applied before the shuffle."""
    t = b.trades(spark, sf).select("token", *b.TRADE_ORDER)
    win = W.partitionBy("token").orderBy(*[F.col(c).desc() for c in b.TRADE_ORDER])
    return (t.withColumn("rn", F.row_number().over(win)).filter(F.col("rn") <= n).groupBy("token")
            .agg(F.array_sort(F.collect_list(F.struct(*b.TRADE_ORDER)))["price"].alias("prices")))


@query("scan_engine_scores", with_(b.SNAP_SQL, LAST3_SQL) + engines_sql(SCAN_A, SCAN_B, SCAN_C, "snap JOIN l3 USING (token)", gate=True))
def scan_engine_scores(spark, sf):
    return engine_columns(sc.scan_engines(b.snapshots(spark, sf).join(last_prices(spark, sf), "token")))


REPORT_A = points(w("change_24h >= 20 AND change_24h <= 100", .5), w("change_24h > 0", .3))
REPORT_B = points(w("change_24h > 100", .4) + " " + w("change_24h > 50", .3), w("change_24h < 500", .3), w("volume_24h > 200000", .3))
REPORT_C = points(w("market_cap >= 300000", .4) + " " + w("market_cap >= 200000", .2), w("change_24h > 100", .4) + " " + w("change_24h > 50", .2),
                  w("change_24h > 0 AND change_24h < 800", .2))
REPORT_SQL = engines_sql(REPORT_A, REPORT_B, REPORT_C, "snap")


def report(spark, sf):
    return sc.report_engines(b.snapshots(spark, sf))


@query("report_engine_scores", with_(b.SNAP_SQL) + REPORT_SQL)
def report_engine_scores(spark, sf):
    return engine_columns(report(spark, sf))


@query("engine_counts", with_(b.SNAP_SQL) + f"""SELECT count(*) AS tokens, count(*) FILTER (contains(engines, 'A')) AS engine_a,
  count(*) FILTER (contains(engines, 'B')) AS engine_b, count(*) FILTER (contains(engines, 'C')) AS engine_c FROM ({REPORT_SQL})""")
def engine_counts(spark, sf):
    return report(spark, sf).agg(F.count(F.lit(1)).alias("tokens"), *[F.count_if(f"engine_{n}").alias(f"engine_{n}") for n in "abc"])


@query("engine_rank", with_(b.SNAP_SQL) + f"""SELECT token, total, engines FROM ({REPORT_SQL}) WHERE engines <> '' ORDER BY total DESC, token""")
def engine_rank(spark, sf):
    return engine_columns(report(spark, sf)).filter("engines <> ''").orderBy(F.col("total").desc(), "token").select("token", "total", "engines")


DAILY_SQL_A = points(w("age_days >= 4", .2), w("change_24h >= 10 AND change_24h <= 100", .4) + " " + w("change_24h >= 5 AND change_24h < 10", .2),
                     w("change_24h > 0", .2), w("riding AND change_24h > 10", .5), w("price_vs_high < 0.7::DOUBLE AND volume_trend = 'high'", -.6),
                     w("ath_drawdown > 0.9::DOUBLE", -.8) + " " + w("ath_drawdown > 0.7::DOUBLE", -.5), w("change_24h < -30", -.4))
DAILY_SQL_B = points(w("change_24h > 100", .4) + " " + w("change_24h > 50", .3), w("change_24h < 500 AND age_days >= 2", .2),
                     w("volume_24h > 100000", .3) + " " + w("volume_24h > 50000", .2),
                     w("rejections >= 3", .5) + " " + w("touches >= 3", .3) + " " + w("touches >= 1", .1))
DAILY_SQL_C = points(w("market_cap >= 300000", .4) + " " + w("market_cap >= 200000", .2),
                     w("change_24h > 100", .3) + " " + w("change_24h > 50", .2) + " " + w("change_24h > 20", .1),
                     w("change_24h > 0 AND change_24h < 800", .2),
                     w("touches >= 5", .4) + " " + w("touches >= 3", .3) + " " + w("touches >= 1", .1),
                     w("volume_24h > 100000", .3) + " " + w("volume_24h > 50000", .2) + " " + w("volume_24h > 20000", .1),
                     "WHEN sells = 0 THEN 0.0::DOUBLE " + w("buys / sells > 1.5::DOUBLE", .3) + " " + w("buys / sells > 1.2::DOUBLE", .2) + " "
                     + w("buys / sells < 0.8::DOUBLE", -.2),
                     w("age_days >= 4", .1), w("age_days <= 10", .1), w("age_days >= 10 AND touches >= 3", .2))

# Chart features come from the token's pool of the same number; tokens without one take the neutral values.
WITH_FEATURES = """
ft AS (SELECT s.*, coalesce(f.price_vs_high, 1) AS price_vs_high, coalesce(f.ath_drawdown, 0) AS ath_drawdown,
        coalesce(f.touches, 0) AS touches, coalesce(f.rejections, 0) AS rejections, coalesce(f.riding, false) AS riding,
        coalesce(f.volume_trend, 'neutral') AS volume_trend FROM snap s LEFT JOIN feat f ON f.token = s.token)"""
DAILY = with_(BARS, EMA, FEATURES_SQL, b.SNAP_SQL, WITH_FEATURES)


def with_features(spark, sf):
    return b.snapshots(spark, sf).join(cd.features(pool_candles(spark, sf)), "token", "left")


def daily_sql(n: str, expr: str, mark: float, reason: str) -> str:
    return f"""SELECT token, round(s, 6) AS score, s >= {mark}::DOUBLE AS qualifies, reason
FROM (SELECT *, {expr} AS s, {reason} AS reason FROM ft)"""


def reason_sql(*parts: str) -> str:
    joined = "concat_ws(' | ', " + ", ".join(f"CASE {p} END" for p in parts) + ")"
    return f"coalesce(nullif({joined}, ''), '{fixed.NO_DATA}')"


def daily_one(spark, sf, n):
    return sc.daily_engines(with_features(spark, sf)).select(
        "token", F.round(f"score_{n}", 6).alias("score"), F.col(f"engine_{n}").alias("qualifies"), F.col(f"reason_{n}").alias("reason"))


A_, B_, C_ = fixed.DAILY_A, fixed.DAILY_B, fixed.DAILY_C


def fmt(template: str, value: str) -> str:
    """The fixed text with its number filled in, as SQL."""
    if "%.0f" in template:
        a, z = template.split("%.0f")
        num = f"round_even({value}, 0)::BIGINT::VARCHAR"
    elif "%.2f" in template:
        a, z = template.split("%.2f")
        num = f"printf('%.2f', {value})"
    else:
        a, z = template.split("%d")
        num = f"({value})::VARCHAR"
    return f"'{a}' || {num} || '{z.replace('%%', '%')}'"


@query("daily_engine_a", DAILY + daily_sql("a", DAILY_SQL_A, .5, reason_sql(
    f"WHEN age_days >= 4 THEN '{A_['history']}'",
    f"WHEN change_24h >= 10 AND change_24h <= 100 THEN '{A_['steady']}' WHEN change_24h >= 5 AND change_24h < 10 THEN '{A_['mild']}'",
    f"WHEN change_24h > 0 THEN '{A_['positive']}'", f"WHEN riding AND change_24h > 10 THEN '{A_['riding']}'",
    f"WHEN price_vs_high < 0.7::DOUBLE AND volume_trend = 'high' THEN '{A_['double_top']}'",
    f"WHEN ath_drawdown > 0.9::DOUBLE THEN '{A_['dead']}' WHEN ath_drawdown > 0.7::DOUBLE THEN '{A_['drawdown']}'",
    f"WHEN change_24h < -30 THEN '{A_['decline']}'")))
def daily_engine_a(spark, sf):
    return daily_one(spark, sf, "a")


@query("daily_engine_b", DAILY + daily_sql("b", DAILY_SQL_B, .6, reason_sql(
    f"WHEN change_24h > 100 THEN {fmt(B_['strong'], 'change_24h')} WHEN change_24h > 50 THEN {fmt(B_['good'], 'change_24h')}",
    f"WHEN change_24h < 500 AND age_days >= 2 THEN '{B_['tempered']}'",
    f"WHEN volume_24h > 100000 THEN {fmt(B_['high_volume'], 'volume_24h / 1000')} WHEN volume_24h > 50000 THEN {fmt(B_['good_volume'], 'volume_24h / 1000')}",
    f"WHEN rejections >= 3 THEN {fmt(B_['rejections'], 'rejections')} WHEN touches >= 3 THEN {fmt(B_['tests'], 'touches')} "
    f"WHEN touches >= 1 THEN {fmt(B_['tested'], 'touches')}")))
def daily_engine_b(spark, sf):
    return daily_one(spark, sf, "b")


@query("daily_engine_c", DAILY + daily_sql("c", DAILY_SQL_C, .7, reason_sql(
    f"WHEN market_cap >= 300000 THEN {fmt(C_['mc_300'], 'market_cap / 1000')} WHEN market_cap >= 200000 THEN {fmt(C_['mc_200'], 'market_cap / 1000')}",
    f"WHEN change_24h > 100 THEN {fmt(C_['strong'], 'change_24h')} WHEN change_24h > 50 THEN {fmt(C_['good'], 'change_24h')} "
    f"WHEN change_24h > 20 THEN {fmt(C_['mild'], 'change_24h')}",
    f"WHEN change_24h > 0 AND change_24h < 800 THEN '{C_['holding']}'",
    f"WHEN touches >= 5 THEN {fmt(C_['support_5'], 'touches')} WHEN touches >= 3 THEN {fmt(C_['support_3'], 'touches')} "
    f"WHEN touches >= 1 THEN {fmt(C_['support_1'], 'touches')}",
    f"WHEN volume_24h > 100000 THEN {fmt(C_['high_volume'], 'volume_24h / 1000')} WHEN volume_24h > 50000 THEN {fmt(C_['good_volume'], 'volume_24h / 1000')} "
    f"WHEN volume_24h > 20000 THEN {fmt(C_['some_volume'], 'volume_24h / 1000')}",
    f"WHEN sells = 0 THEN NULL WHEN buys / sells > 1.5::DOUBLE THEN {fmt(C_['buying_strong'], 'buys / sells')} "
    f"WHEN buys / sells > 1.2::DOUBLE THEN {fmt(C_['buying'], 'buys / sells')} WHEN buys / sells < 0.8::DOUBLE THEN {fmt(C_['selling'], 'buys / sells')}",
    f"WHEN age_days >= 4 THEN '{C_['old_enough']}'", f"WHEN age_days <= 10 THEN '{C_['fresh']}'",
    f"WHEN age_days >= 10 AND touches >= 3 THEN '{C_['mature']}'")))
def daily_engine_c(spark, sf):
    return daily_one(spark, sf, "c")


@query("daily_watchlist", with_(BARS, EMA, FEATURES_SQL, b.SNAP_SQL, WITH_FEATURES, b.WATCH_SQL) + engines_sql(
    DAILY_SQL_A, DAILY_SQL_B, DAILY_SQL_C, "(SELECT ft.* FROM ft JOIN watch w ON w.address = ft.address WHERE age_days BETWEEN 4 AND 10)",
    marks=(.5, .6, .7)))
def daily_watchlist(spark, sf):
    listed = b.watchlist(spark, sf).select("address")
    gated = with_features(spark, sf).join(listed, "address", "left_semi").filter(F.col("age_days").between(*fixed.AGE_DAYS))
    return engine_columns(sc.daily_engines(gated)).orderBy(F.col("total").desc(), "token")


# --- wallet-token scores -----------------------------------------------------------------------------

POOL_HELD_SQL = HELD_SQL.replace("SELECT token, wallet", "SELECT pool AS token, wallet")
ENRICHED_SQL = with_(b.TRADES_SQL, PAIRS_SQL, POOL_HELD_SQL, """
conf AS (SELECT token, count(DISTINCT wallet) AS confirmations, count(*) AS buys FROM t
      WHERE ts >= TIMESTAMP '2001-05-01' AND side = 'buy' GROUP BY token)""", """
dist AS (SELECT token, sum(balance) FILTER (rn <= 10) / sum(balance) * 100 AS top10_pct
      FROM (SELECT *, row_number() OVER (PARTITION BY token ORDER BY balance DESC, wallet) AS rn FROM held) GROUP BY token)""", """
en AS (SELECT token, confirmations, buys, date_diff('day', created_at::DATE, DATE '2001-11-05')::INT AS age_days, liquidity, volume, top10_pct,
        (['true', 'false', NULL])[(token % 3 + 1)::INT]::BOOLEAN AS mint_authority,
        (['true', 'false', NULL])[(token % 5 % 3 + 1)::INT]::BOOLEAN AS freeze_authority,
        (['true', 'false', NULL])[(token % 7 % 3 + 1)::INT]::BOOLEAN AS lp_locked
      FROM conf JOIN best USING (token) LEFT JOIN dist USING (token))""", """
s1 AS (SELECT *, least(100, greatest(0, 50 + CASE WHEN age_days BETWEEN 4 AND 10 THEN 20 WHEN age_days < 4 THEN -15 WHEN age_days > 30 THEN -10 ELSE 0 END
          + CASE WHEN confirmations >= 2 THEN 15 ELSE 0 END))::DOUBLE AS a_score,
        least(100, greatest(0, 50 + CASE WHEN coalesce(liquidity, 0) = 0 THEN 0 WHEN liquidity >= 100000 THEN 25 WHEN liquidity >= 25000 THEN 10 ELSE -20 END
          + CASE WHEN coalesce(volume, 0) = 0 THEN 0 WHEN volume >= 100000 THEN 15 WHEN volume >= 50000 THEN 5 ELSE -15 END))::DOUBLE AS b_score,
        least(100, greatest(0, 50 + CASE WHEN top10_pct > 35 THEN -30 WHEN top10_pct > 25 THEN -10 WHEN top10_pct IS NOT NULL THEN 10 ELSE 0 END
          + CASE WHEN mint_authority THEN -20 ELSE 0 END + CASE WHEN freeze_authority THEN -15 ELSE 0 END
          + CASE WHEN lp_locked THEN 10 WHEN NOT lp_locked THEN -15 ELSE 0 END))::DOUBLE AS c_score,
        coalesce(top10_pct > 35, false) OR coalesce(mint_authority, false) OR coalesce(NOT lp_locked, false) AS risk FROM en)""", """
s2 AS (SELECT *, 0.40::DOUBLE * a_score + 0.35::DOUBLE * b_score + 0.25::DOUBLE * c_score AS composite FROM s1)""", """
s3 AS (SELECT *, concat_ws(',', CASE WHEN liquidity < 25000 THEN 'LIQUIDITY < $25,000' END, CASE WHEN volume < 50000 THEN 'VOLUME < $50,000' END,
        CASE WHEN top10_pct > 35 THEN 'TOP10 > 35%' END, CASE WHEN a_score < 40 THEN 'WEAK_STRUCTURE' END) AS why FROM s2)""", """
s4 AS (SELECT *, CASE WHEN why <> '' THEN CASE WHEN composite >= 70 AND confirmations >= 2 THEN 'WATCH' ELSE 'REJECT' END
        WHEN composite >= 60 THEN 'PASS' ELSE 'WATCH' END AS status,
        CASE WHEN why = '' AND composite < 60 THEN 'LOW_COMPOSITE' ELSE why END AS reasons FROM s3)""")


def scored_tokens(spark, sf):
    # holder shares come from the pool of the token's number; tokens without one have none
    pool = b.trades(spark, sf, token="l_suppkey", wallets=True)

    def flag(m):
        i = (m + 1).cast("int")
        return F.element_at(F.array(F.lit(True), F.lit(False), F.lit(None).cast("boolean")), i)

    security = b.table(spark, sf, "part").select(
        F.col("p_partkey").alias("token"), flag(F.col("p_partkey") % 3).alias("mint_authority"),
        flag(F.col("p_partkey") % 5 % 3).alias("freeze_authority"), flag(F.col("p_partkey") % 7 % 3).alias("lp_locked"))
    return wallet_scan.scan(recent_trades(spark, sf), pairs(spark, sf), wa.holder_distribution(pool).select("token", "top10_pct"), security,
                            F.lit(b.AS_OF[:10]).cast("date"))


@query("whale_score_a", ENRICHED_SQL + """SELECT token, a_score, coalesce(nullif(concat_ws('; ', CASE WHEN age_days BETWEEN 4 AND 10
  THEN 'Sweet spot age: ' || age_days || 'd' WHEN age_days < 4 THEN 'Too fresh: ' || age_days || 'd' WHEN age_days > 30
  THEN 'Aging: ' || age_days || 'd' END, CASE WHEN confirmations >= 2 THEN 'Whale cluster: ' || confirmations END), ''), 'No strong signals') AS a_notes FROM s4""")
def whale_score_a(spark, sf):
    return scored_tokens(spark, sf).select("token", "a_score", "a_notes")


@query("whale_score_b", ENRICHED_SQL + "SELECT token, b_score FROM s4")
def whale_score_b(spark, sf):
    return scored_tokens(spark, sf).select("token", "b_score")


@query("whale_score_c", ENRICHED_SQL + "SELECT token, c_score, risk FROM s4")
def whale_score_c(spark, sf):
    return scored_tokens(spark, sf).select("token", "c_score", "risk")


@query("whale_composite", ENRICHED_SQL + "SELECT token, round(composite, 6) AS composite FROM s4")
def whale_composite(spark, sf):
    return scored_tokens(spark, sf).select("token", F.round("composite", 6).alias("composite"))


@query("strategy_gates", ENRICHED_SQL + "SELECT token, status, reasons FROM s4")
def strategy_gates(spark, sf):
    return scored_tokens(spark, sf).select("token", "status", F.array_join("reject_reasons", ",").alias("reasons"))


@query("status_counts", ENRICHED_SQL + "SELECT status, count(*) AS tokens FROM s4 GROUP BY status")
def status_counts(spark, sf):
    return scored_tokens(spark, sf).groupBy("status").agg(F.count(F.lit(1)).alias("tokens"))


@query("top_pass", ENRICHED_SQL + """SELECT token, status, rn FROM (SELECT *, row_number() OVER (PARTITION BY status
  ORDER BY CASE WHEN status = 'PASS' THEN -composite ELSE 0 END, token) AS rn FROM s4)
WHERE rn <= CASE status WHEN 'PASS' THEN 3 WHEN 'WATCH' THEN 5 ELSE 10 END""")
def top_pass(spark, sf):
    return wallet_scan.top_by_status(scored_tokens(spark, sf)).select("token", "status", "rn")


@query("unified_alerts", with_(b.TRADES_SQL, TRACKED_SQL, b.SNAP_SQL, """
nb AS (SELECT token, wallet, sum(CASE WHEN side = 'buy' THEN value_usd ELSE -value_usd END) AS net FROM t
       JOIN tracked USING (wallet) WHERE ts >= TIMESTAMP '2001-05-01' GROUP BY 1, 2),
one AS (SELECT token, count(*) FILTER (net > 0) AS buyers, count(*) FILTER (net < 0) AS sellers FROM nb GROUP BY 1),
two AS (SELECT token, count(DISTINCT wallet) AS wallets FROM t WHERE ts >= TIMESTAMP '2001-05-01' GROUP BY 1),
m AS (SELECT s.token, coalesce(buyers, 0) >= 1 AS f, coalesce(wallets, 0) >= 3 AS w, coalesce(s.chain = 'base' AND p.p_type = 'PROMO', false) AS g,
        coalesce(sellers > buyers, false) AS d, change_24h, volume_24h, CASE WHEN sells = 0 THEN 1 ELSE buys / sells END AS ratio
      FROM snap s LEFT JOIN one USING (token) LEFT JOIN two USING (token) LEFT JOIN part p ON p.p_partkey = s.token)""") + """
SELECT token, 'CONVERGENCE' AS type, 'HIGH' AS priority, concat_ws(',', CASE WHEN f THEN 'nansen' END, CASE WHEN w THEN 'cielo' END,
  CASE WHEN g THEN 'base_signal' END) AS sources FROM m WHERE f::INT + w::INT + g::INT >= 2
UNION ALL SELECT token, 'DIVERGENCE', 'MEDIUM', 'nansen' FROM m WHERE d AND change_24h > 5
UNION ALL SELECT token, 'VOLUME_SPIKE', 'MEDIUM', 'dexscreener' FROM m WHERE volume_24h > 500000 AND ratio > 1.5::DOUBLE""")
def unified_alerts(spark, sf):
    return sc.unified_alerts(merged_flags(spark, sf))


def merged_flags(spark, sf):
    s = signals(spark, sf)
    return s.select("token", "change_24h", "volume_24h",
                    (F.coalesce("buyers", F.lit(0)) >= 1).alias("flow_convergence"),
                    (F.coalesce("wallets", F.lit(0)) >= 3).alias("wallet_convergence"),
                    F.col("base_signal").isNotNull().alias("base_count"),
                    F.coalesce(F.col("sellers") > F.col("buyers"), F.lit(False)).alias("divergence"),
                    ag.buy_sell_ratio().alias("buy_sell_ratio"))


K_SQL = "'$' || round_even(market_cap / 1000, 0)::BIGINT || 'K'"


@query("watchlist_maintain", with_(b.WATCH_SQL, b.SNAP_SQL, """
j AS (SELECT w.address, date_diff('day', CASE WHEN w.token % 5 = 0 THEN DATE '2026-01-01' ELSE w.added_date END, DATE '2001-11-05') AS age, s.market_cap, s.change_24h, s.address IS NULL AS missing
      FROM watch w LEFT JOIN snap s ON s.address = w.address AND volume_24h > 0)""", f"""
r AS (SELECT *, CASE WHEN age > 10 THEN 'Age ' || age || 'd > 10d' WHEN missing THEN NULL WHEN market_cap < 100000 THEN 'MC ' || {K_SQL} || ' < $100K'
        WHEN market_cap > 500000 THEN 'Graduated MC ' || {K_SQL}
        WHEN change_24h < -50 THEN 'Distribution ' || printf('%.1f%%', change_24h) || ' 24h' END AS reason FROM j)""") + f"""
SELECT address, reason, reason IS NULL AS keep, CASE WHEN reason IS NULL AND NOT missing THEN age || ' days | ' || printf('%+.1f%%', change_24h)
  || ' | MC ' || {K_SQL} || ' | Updated 06:30' END AS note FROM r""")
def watchlist_maintain(spark, sf):
    s = traded_recently(spark, sf).select("address", "market_cap", "change_24h", F.lit(False).alias("m"))
    w = b.watchlist(spark, sf).withColumn("added_date", F.when(F.col("token") % 5 != 0, F.col("added_date")))  # some rows have no date
    j = w.join(s, "address", "left").withColumn("missing", F.coalesce("m", F.lit(True)))
    return sc.watchlist_maintain(j, ntz(f"{b.AS_OF[:10]} 06:30:00")).select("address", "reason", "keep", "note")


@query("exit_ladder", """
SELECT l_orderkey AS order_id, l_linenumber AS line_no, l_partkey AS token, CASE WHEN m >= 10 THEN 'consider_full_exit' WHEN m >= 5 THEN 'take_more_profit'
  WHEN m >= 2 THEN 'take_initial_out' WHEN h >= 48 AND m <= 1 THEN 'time_stop' ELSE 'hold' END AS action
FROM (SELECT l.*, mark / (l_extendedprice / l_quantity) AS m, (epoch(TIMESTAMP '2001-11-05') - epoch(l_shipdate)) / 3600 AS h FROM lineitem l
  JOIN (SELECT l_partkey, arg_max(l_extendedprice / l_quantity, (l_shipdate, l_orderkey, l_linenumber, l_extendedprice / l_quantity)) AS mark
        FROM lineitem GROUP BY 1) USING (l_partkey) WHERE l_returnflag <> 'R')""")
def exit_ladder(spark, sf):
    t = b.trades(spark, sf)
    mark = t.groupBy("token").agg(b.last_price().alias("mark"))
    return t.filter("side = 'buy'").join(mark, "token").select(
        "order_id", "line_no", "token",
        sc.exit_ladder(F.col("mark"), F.col("price"), hours_between(ntz(b.AS_OF), F.col("ts"))).alias("action"))


@query("launch_momentum", with_(b.SNAP_SQL) + """SELECT token, round((percent_rank() OVER (ORDER BY holders) + percent_rank() OVER (ORDER BY volume_24h)
  + percent_rank() OVER (ORDER BY buys) + percent_rank() OVER (ORDER BY change_24h)) / 4 * 100, 6) AS score FROM snap""")
def launch_momentum(spark, sf):
    s = sc.launch_momentum(b.snapshots(spark, sf), ["holders", "volume_24h", "buys", "change_24h"])
    return s.select("token", F.round("score", 6).alias("score"))


@query("message_triage", """
WITH m AS (SELECT event_id AS id, event_type || ' ' || (['payment failed', 'weekly meeting', 'hello', 'invoice due', 'Security Alert'])[(user_id % 5 + 1)::INT]
    AS subject, 'user' || user_id AS sender, ts FROM events WHERE epoch(TIMESTAMP '2024-01-30 23:00:00') - epoch_us(ts) // 1000000 <= 1800 * 48),
c AS (SELECT *, CASE WHEN regexp_matches(subject || ' ' || sender, '(?i)payment failed|security alert|suspicious|unauthorized|expired|expiring|overdue|declined|blocked')
    THEN 'urgent' WHEN regexp_matches(subject || ' ' || sender, '(?i)meeting|appointment|reminder|subscription|renewal|invoice|deadline|scheduled') THEN 'heads_up' END AS level FROM m)
SELECT id, subject, sender, level FROM c WHERE level = 'urgent' UNION ALL
SELECT arg_min(id, (ts, id)), subject, arg_min(sender, (ts, id)), 'heads_up' FROM c WHERE level = 'heads_up' GROUP BY subject""")
def message_triage(spark, sf):
    kinds = F.array(*[F.lit(x) for x in ("payment failed", "weekly meeting", "hello", "invoice due", "Security Alert")])
    e = b.table(spark, sf, "events")
    m = e.select(F.col("event_id").alias("id"), F.concat("event_type", F.lit(" "), F.element_at(kinds, (F.col("user_id") % 5 + 1).cast("int"))).alias("subject"),
                 F.concat(F.lit("user"), "user_id").alias("sender"), "ts")
    return sc.message_triage(m, epoch(ntz("2024-01-30 23:00:00")), minutes=30 * 48).select("id", "subject", "sender", "level")
