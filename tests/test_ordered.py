"""Sliced windows, cooldown and greedy allocation against brute force, with one hot key."""

import random

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidemark.operators import bets, joins, monitors, sliced


@pytest.fixture(scope="module")
def rows(spark):
    rnd = random.Random(5)
    data = [("hot" if rnd.random() < .6 else rnd.choice("abc"), rnd.randrange(100_000), i, rnd.choice([None, 1.0, 2.0, 5.0, 9.0])) for i in range(1500)]
    df = spark.createDataFrame(data, "key STRING, sec BIGINT, id BIGINT, v DOUBLE").withColumn("ts", F.timestamp_seconds("sec"))
    return df.cache()


ORDER = ["ts", "id"]


def same(a, b, cols):
    assert sorted(map(tuple, a.select(*cols).collect()), key=str) == sorted(map(tuple, b.select(*cols).collect()), key=str)


@pytest.mark.parametrize("seconds", [500, 7_000])
def test_running_sum_and_last_known(rows, seconds):
    cut = sliced.slice_time(rows, "ts", seconds)
    w = W.partitionBy("key").orderBy(*ORDER).rowsBetween(W.unboundedPreceding, 0)
    before = W.partitionBy("key").orderBy(*ORDER).rowsBetween(W.unboundedPreceding, -1)
    want = rows.select("*", F.row_number().over(W.partitionBy("key").orderBy(*ORDER)).alias("x"))
    same(sliced.row_index(cut, ["key"], ORDER, "x"), want, ["id", "x"])
    want = rows.select("*", F.last("v", True).over(w).alias("x"))
    same(sliced.last_known(cut, ["key"], ORDER, F.col("v"), "x"), want, ["id", "x"])
    want = rows.select("*", F.last("v", True).over(before).alias("x"))
    same(sliced.last_known(cut, ["key"], ORDER, F.col("v"), "x", inclusive=False), want, ["id", "x"])


@pytest.mark.parametrize("block", [16, 1000])
def test_rolling(rows, block):
    full = rows.filter("v is not null")
    w = W.partitionBy("key").orderBy(*ORDER).rowsBetween(-9, 0)
    want = full.select("*", F.sum("v").over(w).alias("x"))
    got = sliced.rolling(sliced.slice_time(full, "ts", 900), ["key"], ORDER, 10, block=block, x=lambda w: F.sum("v").over(w))
    same(got, want, ["id", "x"])


def test_run_counters_sliced_equals_plain(rows):
    checks = rows.filter("v is not null").withColumn("above", F.col("v") > 2)
    cols = ["id", "idx", "above_count", "below_count"]
    same(monitors.run_counters(sliced.slice_time(checks, "ts", 600), ["key"], ORDER), monitors.run_counters(checks, ["key"], ORDER), cols)


def test_cooldown_matches_greedy(spark, rows):
    got = sorted((r.key, r.sec) for r in monitors.cooldown(rows.drop("sec"), ["key"], "ts", 0.5).collect())
    want, last = [], {}
    for key, sec in sorted((r.key, r.sec) for r in rows.collect()):
        if key not in last or sec - last[key] >= 1800:
            want.append((key, sec))
            last[key] = sec
    assert got == want


@settings(max_examples=8, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.integers(0, 20_000), min_size=1, max_size=60), st.sampled_from([1, 2, 6]))
def test_cooldown_gaps(spark, secs, hours):
    df = spark.createDataFrame([("k", s) for s in secs], "key STRING, s BIGINT").select("key", F.timestamp_seconds("s").alias("ts"))
    got = sorted(r.sec for r in monitors.cooldown(df, ["key"], "ts", hours).collect())
    assert got[0] == min(secs)
    assert all(b - a >= hours * 3600 for a, b in zip(got, got[1:]))
    assert all(any(g <= s < g + hours * 3600 for g in got) for s in secs)


def test_hysteresis_alternates(rows):
    checks = sliced.slice_time(rows.filter("v is not null"), "ts", 800)
    hits = monitors.hysteresis(checks, ["key"], ORDER, "v", F.lit(2), F.lit(5)).collect()
    seen = {}
    zone = {"hot": None, "a": None, "b": None, "c": None}
    for r in sorted(rows.filter("v is not null").collect(), key=lambda r: (r.ts, r.id)):
        z = "below_low" if r.v < 2 else "above_high" if r.v > 5 else None
        if z and z != zone[r.key]:
            seen[r.id] = z
        zone[r.key] = z
    assert {r.id: r.zone for r in hits} == seen


def test_allocation_matches_greedy(spark):
    rnd = random.Random(3)
    data = [(rnd.choice(["p", "q"]), i, rnd.randrange(1, 400) / 1000, rnd.choice([rnd.randrange(50, 301), rnd.randrange(0, 60)]) / 100) for i in range(900)]
    df = spark.createDataFrame(data, "portfolio STRING, id BIGINT, edge DOUBLE, amount DOUBLE")
    got = sorted((r.portfolio, r.id) for r in bets.allocate(df, ["portfolio"]).collect())
    want, used = [], {"p": 0, "q": 0}
    for p, i, _, a in sorted(data, key=lambda r: (-r[2], r[1])):
        if used[p] + round(a * 100) <= 1500:
            used[p] += round(a * 100)
            want.append((p, i))
    assert got == sorted(want)


def test_as_of_takes_last_at_or_before(spark):
    left = spark.createDataFrame([("k", 10, 1), ("k", 25, 2), ("k", 5, 3), ("z", 9, 4)], "key STRING, s BIGINT, id INT")
    right = spark.createDataFrame([("k", 10, 1.5, 1), ("k", 10, 1.7, 2), ("k", 20, 2.5, 3)], "key STRING, s BIGINT, price DOUBLE, n INT")
    l, r = (d.withColumn("ts", F.timestamp_seconds("s")) for d in (left, right))
    got = joins.as_of(l, r.drop("s"), ["key"], "ts", "price", "p", 7, ["n"]).collect()
    assert {x.id: x.p for x in got} == {1: 1.7, 2: 2.5, 3: None, 4: None}


def test_null_keys_are_a_group(spark):
    df = spark.createDataFrame([(None, 10, 1), (None, 9000, 2), ("k", 20, 5), ("k", 9000, 6)], "key STRING, s BIGINT, v BIGINT").withColumn("ts", F.timestamp_seconds("s"))
    got = sliced.running_sums(sliced.slice_time(df, "ts", 100), ["key"], ["ts"], {"total": F.col("v")}).collect()
    assert {(r.key, r.s): r.total for r in got} == {(None, 10): 1, (None, 9000): 3, ("k", 20): 5, ("k", 9000): 11}
    left, right = df.select("key", "ts", "s"), df.select("key", "ts", F.col("v").cast("double").alias("price"), F.col("s").alias("n"))
    seen = joins.as_of(left, right, ["key"], "ts", "price", "p", 100, ["n"]).collect()
    assert {(r.key, r.s): r.p for r in seen} == {(None, 10): 1.0, (None, 9000): 2.0, ("k", 20): 5.0, ("k", 9000): 6.0}


@pytest.mark.parametrize("block", [1, 4, 100])
def test_rolling_frames_longer_than_a_block(spark, block):
    df = spark.range(30).select(F.lit("k").alias("key"), F.timestamp_seconds("id").alias("ts"), "id")
    got = sliced.rolling(sliced.slice_time(df, "ts", 7), ["key"], ["ts"], 10, block, n=lambda w: F.count(F.lit(1)).over(w)).collect()
    assert sorted((r.id, r.n) for r in got) == [(i, min(i + 1, 10)) for i in range(30)]


def test_tokens_without_creation_time(spark):
    from tidemark.plans import discovery
    data = [("s", 0, 1, "solana", "c1", 200_000.0, 50_000.0, 10.0, None), ("s", 0, 2, "solana", "c2", 200_000.0, 20_000.0, 10.0, None)]
    df = spark.createDataFrame(data, "source STRING, source_rank INT, pos BIGINT, platform STRING, contract STRING, market_cap DOUBLE, volume_24h DOUBLE, "
                                     "change_24h DOUBLE, created_at TIMESTAMP")
    assert [r.pos for r in discovery.select(df, F.lit(1_000_000_000)).collect()] == [1]
