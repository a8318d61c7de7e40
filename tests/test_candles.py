"""Candles, averages and patterns against plain Python."""

import random

import pytest
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidemark.operators import candles as cd


def ema(xs, n):
    if len(xs) < n:
        return xs
    out = [sum(xs[:n]) / n]
    for x in xs[n:]:
        out.append((x - out[-1]) * 2 / (n + 1) + out[-1])
    return [out[0]] * (n - 1) + out


def series(seed, n):
    rnd, x, out = random.Random(seed), 100.0, []
    for _ in range(n):
        x *= rnd.choice([.7, .93, .98, 1.0, 1.02, 1.08, 1.35])
        x = min(max(x, 20.0), 400.0)
        out.append(x)
    return out


SIZES = [1, 49, 50, 51, 52, 59, 60, 79, 80, 100, 140]


@pytest.fixture(scope="module")
def bars(spark):
    rows = []
    for t, n in enumerate(SIZES * 6):
        rows += [(t, i * 3600, c) for i, c in enumerate(series(t, n))]
    df = spark.createDataFrame(rows, "token INT, s BIGINT, c DOUBLE").withColumn("bucket", F.timestamp_seconds("s"))
    return df.select("token", "bucket", F.col("c").alias("o"), (F.col("c") * 1.02).alias("h"), (F.col("c") * .98).alias("l"), "c", F.lit(1.0).alias("v")).cache()


def closes(t):
    return series(t, (SIZES * 6)[t])[-100:]


def test_ema_padded_and_last(bars):
    h = cd.with_ema(cd.history(bars)).withColumn("last", cd.ema_last(F.col("closes"), 50))
    for r in h.collect():
        want = ema(closes(r.token), 50)
        assert r.emas == pytest.approx(want, rel=1e-12)
        assert (r.last is None) == (len(want) < 50) and (r.last is None or r.last == pytest.approx(want[-1]))
        if r.last is not None:
            assert min(r.closes) <= r.last <= max(r.closes)


def test_patterns(bars):
    h = cd.pattern_c(cd.pattern_b(cd.pattern_a(cd.with_ema(cd.history(bars)))), F.lit(300_000)).collect()
    seen = set()
    for r in h:
        c = closes(r.token)
        e, n = ema(c, 50), len(c)
        a = n >= 52 and c[-1] > e[-1] and c[-2] <= e[-2]
        b = None
        if n >= 60:
            for i in range(n - 20, n - 1):
                if i >= 50 and c[i] > e[i] and c[i - 1] <= e[i - 1] and max(c[max(0, i - 40):i]) > c[i] * 1.2:
                    b = i + 1
                    break
        v = None
        if n >= 80:
            t = c[-20:]
            v = "no_pump" if not max(t[:15]) > min(t[:5]) * 1.3 else "hit" if abs(c[-1] - e[-1]) / e[-1] < .02 and c[-1] > t[-3] else "no_ema_hold"
        assert (r.hit_a, r.hit_b_at, r.verdict_c, r.hit_c) == (a, b, v, v == "hit")
        seen |= {("a", a), ("b", b is not None), v}
    assert {("a", True), ("b", True), "no_pump", "no_ema_hold"} <= seen


def test_pattern_c_needs_market_cap(bars):
    h = cd.pattern_c(cd.with_ema(cd.history(bars)), F.lit(299_999))
    assert h.filter("hit_c").count() == 0


def test_trailing_ema_is_the_ema_of_the_window(bars):
    w = W.partitionBy("token").orderBy("bucket")
    got = bars.withColumn("e", cd.trailing_ema(F.col("c"), w, 60, 50)).orderBy("bucket").collect()
    by = {}
    for r in got:
        by.setdefault(r.token, []).append(r)
    for rs in by.values():
        for i, r in enumerate(rs):
            if i < 59:
                assert r.e is None
            else:
                assert r.e == pytest.approx(ema([x.c for x in rs[i - 59:i + 1]], 50)[-1], rel=1e-9)


def test_resample_open_close(spark):
    t = spark.createDataFrame([("k", 10, 2, 5.0, 1.0), ("k", 10, 1, 7.0, 2.0), ("k", 90, 1, 9.0, 1.0), ("k", 70, 1, 1.0, 4.0)], "token STRING, s BIGINT, n INT, price DOUBLE, qty DOUBLE")
    c = cd.resample(t.withColumn("ts", F.timestamp_seconds("s")), 60, ["ts", "n", "price"]).orderBy("bucket").collect()
    assert [(r.o, r.h, r.l, r.c, r.v) for r in c] == [(7.0, 7.0, 5.0, 5.0, 3.0), (1.0, 9.0, 1.0, 9.0, 5.0)]
