"""Streams split over several batches give what one batch gives."""

import pytest
from pyspark.sql import functions as F

from tidemark.streaming import stateful as st
from tidemark.streaming import windows as wi


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    """Checks of two keys in four files, in time order."""
    path = str(tmp_path_factory.mktemp("stream") / "checks")
    for part in range(4):
        rows = [(k, part * 3600 + i * 60, i, float((i * 37 + part * 11 + len(k)) % 130)) for i in range(60) for k in ("a", "bb")]
        df = spark.createDataFrame(rows, "key STRING, s BIGINT, event_id BIGINT, price DOUBLE")
        df.select("key", F.timestamp_seconds(F.col("s") + 999_999_600).alias("ts"), "event_id", "price").coalesce(1).write.mode("append").parquet(path)
    return path


def checks(spark, folder, files):
    return wi.timed(wi.read_files(spark, folder, "*.parquet", files_per_batch=files), "0 seconds")


BUILD = {
    "candles": lambda s: wi.candles(s, "10 minutes", ["ts", "event_id"]).drop("at"),
    "cooldown": lambda s: st.cooldown(s.select("key", "ts"), "STRING", hours=.25),
    "hysteresis": lambda s: st.hysteresis(st.as_checks(wi.candles(s, "2 minutes", ["ts", "event_id"])), 20, 100),
    "ema": lambda s: st.ema_monitor(st.as_checks(wi.candles(s, "1 minute", ["ts", "event_id"])), length=10, hours=.2),
    "cross": lambda s: st.crosses(st.as_checks(wi.candles(s, "1 minute", ["ts", "event_id"])), length=10),
    "heartbeat": lambda s: st.heartbeats(s.select("key", "ts").filter(F.minute("ts") % 20 == 0), "STRING", minutes=5),
}


@pytest.mark.parametrize("name", sorted(BUILD))
def test_batches_do_not_matter(spark, folder, name):
    one = wi.run_available(BUILD[name](checks(spark, folder, 100)), "t_one")
    many = wi.run_available(BUILD[name](checks(spark, folder, 1)), "t_many")
    a, b = (sorted(map(tuple, x.collect())) for x in (one, many))
    assert a and a == b


def test_cooldown_stream_equals_batch(spark, folder):
    from tidemark.operators import monitors
    stream = wi.run_available(BUILD["cooldown"](checks(spark, folder, 1)), "t_cool")
    source = spark.read.parquet(folder).select("key", "ts")
    closed = source.filter(F.unix_timestamp("ts") < source.agg(F.max(F.unix_timestamp("ts"))).first()[0])  # what the watermark has passed
    batch = monitors.cooldown(closed, ["key"], "ts", .25)
    assert sorted(map(tuple, stream.select("key", "sec").collect())) == sorted(map(tuple, batch.select("key", "sec").collect()))


@pytest.mark.parametrize("files", [1, 2, 100])
def test_cooldown_takes_rows_out_of_order(spark, tmp_path, files):
    path = str(tmp_path / "late")
    for secs in ([1000, 1001], [999, 2000], [998, 1999], [9000]):
        df = spark.createDataFrame([("k", s) for s in secs], "key STRING, s BIGINT").select("key", F.timestamp_seconds("s").alias("ts"))
        df.coalesce(1).write.mode("append").parquet(path)
    source = wi.timed(wi.read_files(spark, path, "*.parquet", files_per_batch=files), "2000 seconds")
    got = wi.run_available(st.cooldown(source, "STRING", hours=2 / 3600), "t_late")
    assert sorted(r.sec for r in got.collect()) == [998, 1000, 1999]


@pytest.mark.parametrize("files", [1, 100])
def test_deadlines_wait_in_buckets(spark, tmp_path, files):
    path = str(tmp_path / "due")
    parts = ([("a", 1000), ("b", 1001), (None, 1002), ("a", 1003)], [("b", 4000), ("c", 4001), (None, 4002)], [("d", 9000)], [("e", 9500)], [("a", 10500)], [("z", 30000)])
    for rows in parts:
        df = spark.createDataFrame(rows, "key STRING, s BIGINT").select("key", F.timestamp_seconds("s").alias("ts"))
        df.coalesce(1).write.mode("append").parquet(path)
    due = st.deadlines(wi.timed(wi.read_files(spark, path, "*.parquet", files_per_batch=files), "100000 seconds"), "STRING", hours=1)
    assert "bucket" in due._jdf.queryExecution().analyzed().toString()
    assert wi.run_available(due, "t_due").count() == 0  # the watermark is far behind
    due = st.deadlines(wi.timed(wi.read_files(spark, path, "*.parquet", files_per_batch=files), "0 seconds"), "STRING", hours=1)
    got = sorted(((r.key or "", r.expired_at // 1000) for r in wi.run_available(due, "t_due").collect()))
    again = [("a", 14100)] if files == 1 else []  # in one batch the key waits already
    assert got == sorted([("", 4602), ("a", 4600), ("b", 4601), ("c", 7601), ("d", 12600), ("e", 13100), *again])
