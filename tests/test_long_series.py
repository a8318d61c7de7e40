"""Averages and cooldowns over keys that no task holds whole."""

import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.operators import averages, sliced
from tidemark.operators.cooldowns import cooldown


def ema_loop(values, length):
    m, out = np.mean(values[:length]), [None] * min(length - 1, len(values))
    if len(values) < length:
        return [None] * len(values)
    out.append(m)
    for x in values[length:]:
        m = (x - m) * (2 / (length + 1)) + m
        out.append(m)
    return out


def close(a, b):
    return (a is None) == (b is None) and (a is None or abs(a - b) <= 1e-9 * max(1, abs(b)))


@pytest.mark.parametrize("length,block,group", [(50, 7, 3), (5, 4096, 1024), (1, 3, 2), (2, 100, 2)])
def test_ema_equals_the_loop(spark, monkeypatch, length, block, group):
    monkeypatch.setattr(averages, "GROUP", group)
    rnd = random.Random(3)
    rows = [(key, i, rnd.uniform(-5, 500) if rnd.random() > 0.02 else None) for key, n in (("a", 400), (None, 90), ("b", 49), ("c", 51)) for i in range(n)]
    df = sliced.slice_number(spark.createDataFrame(rows, "key STRING, at BIGINT, price DOUBLE"), "at", 64)
    got = {(r.key, r["at"]): (r.idx, r.ema) for r in averages.ema_series(df, ["key"], ["at"], "price", length, block).collect()}
    for key in ("a", None, "b", "c"):
        series = [(i, p) for k, i, p in rows if k == key and p is not None]
        for n, ((at, _), want) in enumerate(zip(series, ema_loop([p for _, p in series], length), strict=True)):
            assert got[key, at][0] == n + 1 and close(got[key, at][1], want), (key, at)
    assert len(got) == sum(p is not None for _, _, p in rows)


def test_ema_of_a_million_rows_of_one_key(spark):
    n = 1_000_000
    df = spark.range(n).select(F.lit("k").alias("key"), F.col("id").alias("at"), (F.pmod(F.xxhash64("id"), F.lit(100_000)) / 100.0).alias("price"))
    got = averages.ema_series(sliced.slice_number(df, "at", 50_000), ["key"], ["at"], "price")
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan
    assert all("_block" in w or "_slice" in w or "_c_" in w for w in plan.splitlines() if "Window [" in w)
    some = {r["at"]: r.ema for r in got.filter("at % 99991 = 0 OR at = 999999 OR at = 49").collect()}
    prices = [r.price for r in df.orderBy("at").collect()]
    want = ema_loop(prices, 50)
    assert len(some) == 13 and all(close(some[i], want[i]) for i in some)


def fold(secs, gap):
    sent, last = [], None
    for s in sorted(set(secs)):
        if last is None or s >= last + gap:
            sent.append(s)
            last = s
    return sent


@pytest.mark.parametrize("seconds", [1 << 22, 3000, 100, 1])
def test_cooldown_equals_the_fold(spark, seconds):
    rnd = random.Random(seconds)
    data = {"dense": [rnd.randrange(20_000) for _ in range(4000)], "sparse": [rnd.randrange(200_000) for _ in range(60)], None: list(range(0, 9000, 20)),
            "bursts": [b + rnd.randrange(150) for b in range(-5000, 100_000, 7000) for _ in range(40)], "one": [7]}
    rows = [(k, s, i) for k, secs in data.items() for i, s in enumerate(secs)]
    df = spark.createDataFrame(rows, "key STRING, sec BIGINT, n BIGINT").withColumn("ts", F.timestamp_seconds("sec"))
    got = {}
    for r in cooldown(df.drop("sec"), ["key"], "ts", 100 / 3600, ["n"], seconds=seconds).collect():
        got.setdefault(r.key, []).append(r.sec)
    assert {k: sorted(v) for k, v in got.items()} == {k: fold(v, 100) for k, v in data.items()}


def test_cooldown_of_two_keys_and_of_nothing(spark):
    df = spark.createDataFrame([(1, None, 5), (1, 2, 6), (1, 2, 5), (None, 2, 5)], "a BIGINT, b BIGINT, sec BIGINT").withColumn("ts", F.timestamp_seconds("sec"))
    got = sorted(map(str, cooldown(df.drop("sec"), ["a", "b"], "ts", 1).select("a", "b", "sec").collect()))
    assert len(got) == 3 and "Row(a=1, b=2, sec=5)" in got
    assert cooldown(df.drop("sec").limit(0), ["a", "b"], "ts", 1).count() == 0


def test_no_task_of_the_cooldown_holds_a_key(spark):
    df = spark.range(200_000).select(F.lit("k").alias("key"), F.timestamp_seconds("id").alias("ts"))
    sent = cooldown(df, ["key"], "ts", 10 / 3600, seconds=500)
    plan = sent._jdf.queryExecution().executedPlan().toString()
    assert not re.search(r"hashpartitioning\(key#\d+, \d+\)", plan)  # by key and slice, never by key alone
    assert sent.count() == 20_000
