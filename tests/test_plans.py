"""Physical plans: pushdown, rank limits before shuffles, sliced windows."""

import pytest

from tidemark.catalog import QUERIES

SF = "/root/testdata/sf0.001"


def plan(spark, name):
    return QUERIES[name].run(spark, SF)._jdf.queryExecution().executedPlan().toString()


def test_filters_and_columns_reach_the_scan(spark):
    p = plan(spark, "daily_exposure")
    assert "PushedFilters: [IsNotNull(l_shipdate), GreaterThanOrEqual(l_shipdate" in p
    assert "ReadSchema: struct<l_orderkey:bigint,l_extendedprice:double,l_shipdate:timestamp_ntz>" in p or \
        "ReadSchema: struct<l_extendedprice:double,l_shipdate:timestamp_ntz>" in p


@pytest.mark.parametrize("name", ["top_per_group", "dedup_tokens", "counterparties", "holder_distribution", "exposure_allocation", "history_append_trim", "ema"])
def test_rank_limit_before_shuffle(spark, name):
    assert "WindowGroupLimit" in plan(spark, name)


@pytest.mark.parametrize("name", ["large_transfers", "token_page", "launch_filter", "recent_win_rate"])
def test_top_lists_do_not_sort_everything(spark, name):
    assert "TakeOrderedAndProject" in plan(spark, name)


@pytest.mark.parametrize("name", ["threshold_hysteresis", "rolling_drop", "price_asof_trade", "scan_log_blocks"])
def test_windows_over_hot_keys_are_sliced(spark, name):
    """Rows are windowed by key and slice or block; windows by key alone run over slice summaries only."""
    p = plan(spark, name)
    assert "_slice" in p
    rows = [line for line in p.splitlines() if "Window [" in line and "_carry" not in line and "_c_" not in line]
    assert all("_slice" in line or "_block" in line for line in rows), rows


@pytest.mark.parametrize("name", ["candles", "ema", "target_band", "stop_loss", "filter_funnel", "discovery_scan", "daily_watchlist"])
def test_trades_are_hashed_not_sorted_before_the_shuffle(spark, name):
    assert "SortAggregate" not in plan(spark, name)


@pytest.mark.parametrize("name", ["candles", "wallet_pnl", "sentiment", "threshold_hysteresis"])
def test_tables_are_read_as_they_are(spark, name):
    assert "REPARTITION" not in plan(spark, name)


def test_pattern_scan_reads_trades_once(spark):
    p = plan(spark, "cascade_first_engine")
    assert p.count("Scan parquet") == 1 and "SortAggregate" not in p and p.count("Exchange hashpartitioning") <= 4


def test_gated_scan_builds_no_candles_of_closed_tokens(spark):
    """Band and cooldown narrow the trades below the first aggregate, and a run that is repeated changes nothing."""
    from pyspark.sql import functions as F

    from tidemark.catalog import series
    from tidemark.plans import pattern_scan
    from tidemark.session import shared_dir
    path, trades = shared_dir(spark, "scan-test"), series.pool_trades(spark, SF)
    wide = trades.select("token").distinct().withColumns({"market_cap": F.lit(400_000.0), "liquidity": F.lit(20_000.0)})
    kinds = {"order": ["seq"], "base": "1D", "a": "3D", "b": "1D", "c": "1W"}
    def hits(number, as_of, market=wide):
        return {r.token for r in pattern_scan.run(trades, market, path, number, as_of, **kinds).collect()}
    first = hits(0, "2001-03-01 00:00:00")
    assert first and not hits(1, "2001-03-03 23:59:59") & first and hits(0, "2001-03-01 00:00:00") == first
    assert hits(2, "2001-03-04 00:00:00") & first  # 72 hours are over, the bound included
    assert not hits(3, "2001-06-01 00:00:00", wide.withColumn("market_cap", F.lit(500_001.0)))
    assert not hits(3, "2001-06-01 00:00:00", wide.withColumn("liquidity", F.lit(9_999.0)))


def test_rollup_has_parts_for_its_rows(spark, monkeypatch):
    import datetime as dt
    from tidemark.operators import agents
    day = dt.datetime(2024, 1, 31)
    ex = [(i % 5 if i % 7 else None, day + dt.timedelta(days=i % 3), 10.0, float(i % 4 - 1), "settled", 0.5) for i in range(90)]
    jobs = [(i % 6, "completed" if i % 2 else "failed", day + dt.timedelta(days=i % 40), i) for i in range(60)]
    e = spark.createDataFrame(ex, "agent BIGINT, executed_at TIMESTAMP_NTZ, amount DOUBLE, pnl DOUBLE, status STRING, confidence DOUBLE")
    j = spark.createDataFrame(jobs, "agent BIGINT, status STRING, completed_at TIMESTAMP_NTZ, minutes BIGINT")
    want = sorted(map(str, agents.agent_rollup(e, j).collect()))
    monkeypatch.setattr(agents, "ROLLED", 10)
    got = agents.agent_rollup(e, j)
    after = got._jdf.queryExecution().executedPlan().toString().split("Union")[0]
    assert "REPARTITION_BY_NUM" in after and after.count("Exchange") == 1 and ", 16)" in after
    assert sorted(map(str, got.collect())) == want and len(want) > 40


def test_candle_payloads_are_parsed_once(spark):
    from tidemark.sources import vendors
    rows = ['{"token":"a","items":[{"unixTime":7,"o":1.5},null]}', '{"token":"b","items":null}', '{"token":"c"}', '{"token":"d","items":[]}', None]
    raw = spark.createDataFrame([(r,) for r in rows], "raw STRING")
    got = vendors.norm_ohlcv(vendors.parse(raw, "raw", vendors.OHLCV))
    assert sorted(map(tuple, got.collect())) == [("a", 0, 0.0, 0.0, 0.0, 0.0, 0.0), ("a", 7, 1.5, 0.0, 0.0, 0.0, 0.0)]
    assert "Filter" not in got._jdf.queryExecution().executedPlan().toString()
    arrays = spark.createDataFrame([('{"token":"a","items":[[7000,1,2,3,4],[8000]]}',), ('{"token":"b"}',)], "raw STRING")
    got = vendors.norm_ohlc(vendors.parse(arrays, "raw", vendors.OHLC))
    assert sorted(map(tuple, got.collect())) == [("a", 7, 1.0, 2.0, 3.0, 4.0, 0.0), ("a", 8, None, None, None, None, 0.0)]
    assert "Filter" not in got._jdf.queryExecution().executedPlan().toString()


def test_candles_of_payloads_are_built_once(spark):
    assert "Aggregate" not in plan(spark, "norm_ohlcv")


def test_snapshot_is_scored_once(spark, monkeypatch):
    from tidemark.sources import tables
    seen, write = [], tables.write_snapshot
    monkeypatch.setattr(tables, "write_snapshot", lambda s, *a: (seen.append(s._jdf.queryExecution().executedPlan().toString()), write(s, *a))[1])
    assert QUERIES["snapshot_write"].run(spark, SF).count()
    assert len(seen) == 3 and not any("Join" in p or "Exchange" in p for p in seen)
