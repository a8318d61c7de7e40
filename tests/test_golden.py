"""Recorded cases replayed."""

import pytest
from pyspark.sql import functions as F

from tidemark.operators import monitors as mon
from tidemark.operators import scoring as sc
from tidemark.operators import sliced
from tidemark.sources import logs

G1 = [(1, 83.5, 542097.0, 116886.0, "A,B", 2.10), (2, 604.0, 1119734.0, 310632.0, "B,C", 2.00), (3, 719.0, 535895.0, 304934.0, "B,C", 2.00),
      (4, 90.6, 163848.0, 218130.0, "A,B,C", 2.00), (5, 183.0, 1307254.0, 104614.0, "B,C", 1.90), (6, 700.0, 1830419.0, 288917.0, "B,C", 1.80),
      (7, 274.0, 186218.0, 150703.0, "B,C", 1.60), (8, -37.6, 265703.0, 118584.0, "B", 0.60), (9, -17.1, 155847.0, 170144.0, "", 0.30)]


def test_engine_report(spark):
    df = spark.createDataFrame([r[:4] for r in G1], "id INT, change_24h DOUBLE, volume_24h DOUBLE, market_cap DOUBLE")
    got = {r.id: (r.engines, round(r.total, 2)) for r in sc.report_engines(df).collect()}
    assert got == {r[0]: (r[4], r[5]) for r in G1}


G2 = [(1771175005, .0002681, .0001584712741095696), (1771175857, .0002943, .0002), (1771182083, .0002247, .0002), (1771189214, .0001794, .0002),
      (1771196533, .0001143, .0002), (1771203607, .0000752, .0002), (1771210805, .00006212, .0002), (1771218027, .00006035, .0002)]


@pytest.mark.parametrize("slice_seconds", [None, 10_000])
def test_ema_monitor_replay(spark, slice_seconds):
    df = spark.createDataFrame([("me", *r) for r in G2], "key STRING, time BIGINT, price DOUBLE, ema DOUBLE")
    df = df.withColumn("ts", F.timestamp_seconds("time")).withColumn("above", F.col("price") > F.col("ema"))
    if slice_seconds:
        df = sliced.slice_time(df, "ts", slice_seconds)
    runs = mon.sustained_below(df, ["key"], ["ts"])
    assert runs.orderBy("time").collect()[-1].below_count == 5
    sent = mon.cooldown(runs.filter("wants_alert"), ["key"], "ts", 6)
    assert sorted(r.sec for r in sent.collect()) == [1771189214, 1771218027]


def test_daily_watchlist(spark):
    rows = [(1, 13.4, 228000.0, 47000.0, 9, 1, 1), (2, -42.0, 44000.0, 311000.0, 5, 1, 1), (3, -68.0, 13000.0, 62000.0, 6, 1, 1), (4, -42.3, 11000.0, 6000.0, 10, 1, 1)]
    df = spark.createDataFrame(rows, "token INT, change_24h DOUBLE, market_cap DOUBLE, volume_24h DOUBLE, age_days INT, buys BIGINT, sells BIGINT")
    out = {r.token: r for r in sc.daily_engines(df).collect()}
    assert [(out[i].engines, round(out[i].total, 2)) for i in (1, 2, 3, 4)] == [("A,C", 1.70), ("", 0.80), ("", 0.60), ("", 0.20)]
    assert out[1].reason_a == "Has history (4+ days) | Steady uptrend (10-100%) | Positive momentum"
    assert out[4].reason_a.endswith("distribution phase")


FUNNELS = [(64, 38, 9, 17, 2, 15), (64, 41, 7, 16, 2, 14), (60, 34, 11, 15, 3, 12), (62, 35, 12, 15, 3, 12), (57, 30, 12, 15, 3, 12)]


@pytest.mark.parametrize("width", [100_000, 7])
def test_run_log_funnels(spark, width, monkeypatch):
    monkeypatch.setattr(logs, "LINES_PER_SLICE", width)
    lines = []
    for day, (u, fresh, old, win, match, other) in enumerate(FUNNELS, 1):
        t = f"[2026-02-{day:02d}T16:36:40Z] "
        lines += [t + "=== Multi-Source Memecoin Scanner v5 ===", t + f"Total unique tokens found: {u}",
                  t + f"Filtered out {fresh} tokens < 4 days (too fresh)", t + f"Filtered out {old} tokens > 10 days (too old)",
                  t + f"Tokens in sweet spot (4-10 days): {win}", t.replace("40Z", "48Z") + f"Complete: {match} sweet spot matches, {other} others"]
    df = spark.createDataFrame([("log", i, x) for i, x in enumerate(lines)], "file STRING, line_no BIGINT, value STRING")
    got = logs.run_metrics(df).orderBy("run").collect()
    assert [tuple(r)[2:8] for r in got] == FUNNELS
    assert all(r.unique_tokens == r.too_fresh + r.too_old + r.in_window and r.seconds == 8 for r in got)


@pytest.mark.parametrize("width", [100_000, 2])
def test_scanner_output_blocks(spark, width, monkeypatch):
    monkeypatch.setattr(logs, "LINES_PER_SLICE", width)
    lines = ["noise", "1. 📈 Lost Coin ($LOST) [PAIR]", "   💰 Price: 1", "2. 🚀 Kept Coin ($KEPT) [PAIR]", "   💰 Price: $0.5", "   📊 24h: +12.5% | Vol: $9",
             "   🏦 MC: $123,456 ✅", "   🔍 Solscan: https://solscan.io/token/Abc9", "   💰 Price: after", "   🔍 Solscan: https://solscan.io/token/Zzz",
             "3. 💎 lower ($low) [PAIR]", "   🔍 Solscan: https://solscan.io/token/No"]
    df = spark.createDataFrame([("f", i, x) for i, x in enumerate(lines)], "file STRING, line_no BIGINT, value STRING")
    assert [tuple(r)[1:] for r in logs.scan_blocks(df).collect()] == [("Kept Coin", "KEPT", "$0.5", 12.5, 123456, "Abc9")]
