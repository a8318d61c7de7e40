"""Boundaries of filters, scores, parsers and bets."""

import pytest
from pyspark.sql import functions as F

from tidemark.functions import text as tx
from tidemark.functions.values import epoch_any
from tidemark.operators import aggregates as ag
from tidemark.operators import bets, scoring
from tidemark.operators import filters as fl
from tidemark.sources import tables, vendors


def one(spark, schema, rows, *cols):
    return [tuple(r) for r in spark.createDataFrame(rows, schema).select(*cols).collect()]


def test_trading_rule(spark):
    rows = [(99_999.99, 60_000.0, 60_000.0), (100_000.0, 60_000.0, 60_000.0), (500_000.0, 60_000.0, 60_000.0), (500_000.01, 60_000.0, 60_000.0),
            (200_000.0, 49_999.0, 60_000.0), (200_000.0, 0.0, 60_000.0), (200_000.0, 50_000.0, 49_999.0), (200_000.0, 50_000.0, 50_000.0)]
    got = one(spark, "market_cap DOUBLE, liquidity DOUBLE, volume_24h DOUBLE", rows, fl.trading_rule())
    assert [g[0] for g in got] == ["mc_low", "match", "match", "mc_high", "liquidity_low", "match", "volume_low", "match"]


def test_age_and_momentum(spark):
    day = 86_400
    rows = [(a * day, c, v) for a, c, v in [(3, -5.0, 0.0), (4, -5.01, 0.0), (10, 200.0, 0.0), (11, 200.1, 0.0)]] + [(None, 0.0, 11.0), (None, 0.0, 10.0)]
    got = one(spark, "back BIGINT, change_24h DOUBLE, volume_24h DOUBLE", rows, fl.momentum_class())
    assert [g[0] for g in got] == ["keep", "falling", "keep", "parabolic", "keep", "keep"]
    df = spark.createDataFrame(rows, "back BIGINT, change_24h DOUBLE, volume_24h DOUBLE").withColumn("market_cap", F.lit(100.0))
    age = fl.age_or_estimate(F.lit(10 ** 9) - F.col("back"), F.lit(10 ** 9))
    assert [r[0] for r in df.select(fl.age_class(age)).collect()] == ["too_fresh", "sweet_spot", "sweet_spot", "too_old", "sweet_spot", "too_fresh"]


def test_epoch_units(spark):
    got = one(spark, "n BIGINT", [(10_000_000_000,), (10_000_000_001,), (1_700_000_000_123,)], epoch_any("n"))
    assert [g[0] for g in got] == [10_000_000_000, 10_000_000, 1_700_000_000]


@pytest.mark.parametrize("text,money,volume", [("$1,234", 1234, 1234), ("1.5K", 1500, 1500), ("2M", 2e6, 2e6), ("1.2T", 1.2e12, 0), ("1.5k", 0, 0),
                                               ("N/A", 0, 0), ("", 0, 0), ("1KM", 0, 0), (None, 0, 0), ("3B", 3e9, 3e9)])
def test_money(spark, text, money, volume):
    assert one(spark, "t STRING", [(text,)], tx.money(F.col("t")), tx.volume(F.col("t"))) == [(money, volume)]


def test_text_extraction(spark):
    rows = [("about 35% or 40%, High Confidence",), ("nothing",), ("100%",)]
    assert one(spark, "t STRING", rows, tx.percent_in(F.col("t")), tx.confidence_in(F.col("t"))) == [(.35, .8), (.5, .5), (1.0, .5)]
    assert one(spark, "t STRING", [("x/token/Ab9?z",), ("none",)], tx.contract_in(F.col("t"))) == [("Ab9",), (None,)]
    assert one(spark, "t STRING", [("he is upset",)], tx.contains_any(F.col("t"), ["up"]), tx.contains_any(F.col("t"), ["up"], True)) == [(True, False)]


def test_buy_sell_ratio_without_sells(spark):
    assert one(spark, "buys BIGINT, sells BIGINT", [(5, 0), (6, 4)], ag.buy_sell_ratio()) == [(1.0,), (1.5,)]


def test_wallet_scores_and_gates(spark):
    schema = ("token INT, age_days INT, confirmations INT, liquidity DOUBLE, volume DOUBLE, top10_pct DOUBLE, mint_authority BOOLEAN, "
              "freeze_authority BOOLEAN, lp_locked BOOLEAN")
    rows = [(1, 4, 2, 100_000.0, 100_000.0, 20.0, False, False, True), (2, 3, 1, 24_999.0, 49_999.0, 35.1, True, True, False),
            (3, None, 0, None, None, None, None, None, None), (4, 31, 0, 0.0, 50_000.0, 25.1, None, None, None), (5, 10, 2, 25_000.0, 99_999.0, 35.0, False, False, None)]
    got = {r.token: r for r in scoring.score_wallet_tokens(spark.createDataFrame(rows, schema)).collect()}
    assert [(got[i].a_score, got[i].b_score, got[i].c_score) for i in range(1, 6)] == [(85, 90, 70), (35, 15, 0), (50, 50, 50), (40, 55, 40), (85, 65, 40)]
    assert [got[i].status for i in range(1, 6)] == ["PASS", "REJECT", "WATCH", "REJECT", "PASS"]
    assert got[2].reject_reasons == ["LIQUIDITY < $25,000", "VOLUME < $50,000", "TOP10 > 35%", "WEAK_STRUCTURE"]
    assert got[3].reject_reasons == ["LOW_COMPOSITE"] and got[4].reject_reasons == ["LIQUIDITY < $25,000"]
    assert [got[i].risk for i in range(1, 6)] == [False, True, False, False, False]
    assert got[3].a_notes == "No strong signals" and got[1].b_notes == "Strong liquidity: $100,000; Good volume: $100,000"


def test_scan_scores_need_prices(spark):
    df = spark.createDataFrame([(1, [1.0], 30.0, 2e5, 4e5), (2, [1.0, 1.0], 30.0, 2e5, 4e5), (3, [1.0, .9, 1.1], 60.0, 2e5, 4e5)],
                               "token INT, prices ARRAY<DOUBLE>, change_24h DOUBLE, volume_24h DOUBLE, market_cap DOUBLE")
    assert [(r.engines, round(r.total, 2)) for r in scoring.scan_engines(df).orderBy("token").collect()] == [("", 0.0), ("C", 1.0), ("A,B,C", 2.7)]


def test_bets(spark):
    def market(i, price, text, volume=2e6, liq=6e5):
        return (i, price, volume, liq, text)
    rows = [market(1, .40, "60% high confidence"), market(2, .55, "60%"), market(3, .30, "10%"), market(4, .60, "85% low confidence"),
            market(5, .75, "85%"), market(6, .60, "85% EXTREME_ODDS"), market(7, .40, "60%", volume=999_999.0), market(8, 0.0, "60%"), market(9, .8, "50%")]
    df = spark.createDataFrame(rows, "id INT, yes_price DOUBLE, volume DOUBLE, liquidity DOUBLE, research STRING")
    got = {r.id: r for r in bets.evaluate(df).collect()}
    assert set(got) == {1, 4, 8, 9}
    assert (got[1].side, got[1].amount, got[9].side, got[9].amount) == ("YES", .5, "NO", .5)
    assert got[4].is_extreme and got[4].amount <= 1.0 and got[8].kelly_fraction == 0.0


@pytest.mark.parametrize("form,mode", [((.3, 100., 20), "conservative"), ((.7, 51., 20), "aggressive"), ((.7, 50., 20), "standard"), ((.1, -90., 4), "baseline"),
                                       ((.5, -31., 20), "conservative")])
def test_strategy_adjustment(spark, form, mode):
    df = spark.createDataFrame([form], "win_rate DOUBLE, total_pnl DOUBLE, trades INT")
    assert bets.strategy_adjustment(df).first()["mode"] == mode


def test_sentiment_without_signals(spark):
    df = spark.createDataFrame([("quiet", 5), ("", 0)], "text STRING, engagement INT")
    r = ag.sentiment(df).first()
    assert (r.sentiment, r.score, r.confidence) == ("neutral", .5, 0)


def test_dedup_is_idempotent_and_keeps_nameless(spark):
    rows = [("solana", "x", 1, 5), ("solana", "x", 0, 9), ("base", "x", 2, 1), ("base", "", 1, 1), ("base", "", 1, 2)]
    df = spark.createDataFrame(rows, "platform STRING, contract STRING, source_rank INT, pos INT")
    once = ag.dedup_tokens(df)
    assert sorted(map(tuple, once.collect())) == sorted([rows[1], rows[2], rows[3], rows[4]])
    assert sorted(map(tuple, ag.dedup_tokens(once).collect())) == sorted(map(tuple, once.collect()))


def test_missing_watchlist_is_empty(spark, tmp_path):
    assert tables.read_watchlist(spark, str(tmp_path / "none.json")).count() == 0
    (tmp_path / "w.json").write_text('[{"symbol": "A", "address": "tok_01", "added_date": "2026-02-15"},\n {"symbol": "B"}]')
    got = tables.read_watchlist(spark, str(tmp_path / "w.json"), multi_line=True).orderBy("symbol").collect()
    assert [(r.symbol, r.address, str(r.added_date)) for r in got] == [("A", "tok_01", "2026-02-15"), ("B", None, "None")]


def test_pair_payload_defaults(spark, tmp_path):
    (tmp_path / "p.json").write_text('{"chainId": "Base", "tokenAddress": "t", "priceUsd": "0.5", "liquidity": null, "baseToken": {}}\n{"tokenAddress": "u", "priceUsd": "bad"}\n')
    got = vendors.norm_pairs(vendors.read(spark, str(tmp_path / "p.json"), vendors.PAIRS)).orderBy("address").collect()
    assert [(r.chain, r.symbol, r.price, r.liquidity, r.created_at) for r in got] == [("base", "UNKNOWN", .5, 0.0, None), (None, "UNKNOWN", 0.0, 0.0, None)]


def test_wallet_times(spark):
    change = '[{"changeType": "inc", "tokenAddress": "a", "amount": 2.0}, {"changeType": "dec", "tokenAddress": "b", "amount": 1.0}]'
    rows = [("w1", '"timestamp": "1970-01-02T00:00:00Z"'), ("w2", '"timestamp": "86400"'), ("w3", '"blockTime": 86400'), ("w4", '"source": "x"'), ("w5", '"timestamp": "1"')]
    df = spark.createDataFrame([(f'{{"wallet": "{w}", {t}, "tokenChanges": {change}}}',) for w, t in rows], "raw STRING")
    got = vendors.wallet_buys(vendors.parse(df, "raw", vendors.WALLET_TX), F.lit(100_000)).collect()
    assert sorted((r.wallet, r.token, r.at) for r in got) == [("w1", "a", 86400), ("w2", "a", 86400), ("w3", "a", 86400)]
