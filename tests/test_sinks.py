"""Stream sinks, raw logs, percent ranks and rejected rows."""

import datetime as dt

from pyspark.sql import functions as F

from tidemark.functions import payloads
from tidemark.operators import agents, scoring
from tidemark.session import shared_dir
from tidemark.sources import logs
from tidemark.streaming import sinks

T0 = dt.datetime(2024, 1, 1, tzinfo=dt.timezone.utc)


def alerts(spark, rows):
    return spark.createDataFrame([(k, T0 + dt.timedelta(hours=h), n) for k, h, n in rows], "key STRING, ts TIMESTAMP, n BIGINT")


def test_alerts_are_stored_once_for_each_batch(spark):
    path = shared_dir(spark, "sink-test")
    one, two = alerts(spark, [("a", 1, 1), ("a", 0, 2), ("b", 30, 3), (None, 2, 4)]), alerts(spark, [("a", 1, 5), ("c", 50, 6)])
    for batch_id, df in ((0, one), (0, one), (1, two), (0, one), (1, two)):
        sinks.append_alerts(df, batch_id, path, ["key"], "ts", ["n"])
    sinks.append_alerts(one.limit(0), 2, path, ["key"], "ts")
    got = sorted(((r.key or "", r.n, r.batch_id, str(r.day)) for r in spark.read.parquet(path).collect()))
    assert got == [("", 4, 0, "2024-01-01"), ("a", 2, 0, "2024-01-01"), ("a", 5, 1, "2024-01-01"), ("b", 3, 0, "2024-01-02"), ("c", 6, 1, "2024-01-03")]


def test_part_of_a_batch_that_was_stored_is_completed(spark):
    path = shared_dir(spark, "sink-test")
    rows = alerts(spark, [(f"k{i}", i, i) for i in range(60)])
    sinks.append_alerts(rows.filter("n < 20"), 7, path, ["key"], "ts")  # what a lost driver had written
    sinks.append_alerts(rows, 7, path, ["key"], "ts")
    assert spark.read.parquet(path).count() == 60


def test_states_do_not_depend_on_the_order_of_batches(spark):
    rows = [(f"a{i % 17}", T0 + dt.timedelta(minutes=i * 37 % 400), i, "working" if i % 3 == 0 else "idle") for i in range(300)]
    df = spark.createDataFrame(rows, "agent STRING, ts TIMESTAMP, n BIGINT, status STRING")
    want = {r.agent: r for r in agents.latest_state(df, "agent", "ts", "n").collect()}
    for order in ((0, 1, 2), (2, 0, 1, 0)):
        path = shared_dir(spark, "state-test")
        for i, part in enumerate(order):
            sinks.upsert_states(df.filter(F.col("n") % 3 == part), i, path, "agent", "ts", "n", buckets=4)
        got = {r.agent: r for r in spark.read.parquet(path).drop("bucket").select(*agents.latest_state(df, "agent", "ts", "n").columns).collect()}
        assert got == want


def test_only_touched_buckets_are_rewritten(spark):
    path = shared_dir(spark, "state-test")
    df = spark.createDataFrame([(f"a{i}", T0, i, "idle") for i in range(40)], "agent STRING, ts TIMESTAMP, n BIGINT, status STRING")
    sinks.upsert_states(df, 0, path, "agent", "ts", "n", buckets=8)
    files = {r.f for r in spark.read.parquet(path).select(F.input_file_name().alias("f")).distinct().collect()}
    sinks.upsert_states(df.limit(1).withColumn("ts", F.col("ts") + F.expr("INTERVAL 1 HOUR")), 1, path, "agent", "ts", "n", buckets=8)
    after = {r.f for r in spark.read.parquet(path).select(F.input_file_name().alias("f")).distinct().collect()}
    assert len(files - after) == 1 and spark.read.parquet(path).count() == 40


def test_line_numbers_of_files_larger_than_a_split(spark, tmp_path):
    text = [f"{i} {'x' * (i * 7 % 190)} é" if i % 11 else "" for i in range(4000)]
    (tmp_path / "scanner-1.log").write_text("\n".join(text) + "\n")
    (tmp_path / "other.run.txt").write_text("\n".join(text[:7]))
    (tmp_path / "empty.log").write_text("")
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "16k")
    try:
        lines = logs.read_lines(spark, str(tmp_path))
        assert spark.read.text(str(tmp_path)).rdd.getNumPartitions() > 10
        got = {}
        for r in lines.collect():
            got.setdefault(r.file, []).append((r.line_no, r.value))
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)
    assert {f: [v for _, v in sorted(x)] for f, x in got.items()} == {"scanner-1": text, "other.run": text[:7]}
    assert sorted(n for n, _ in got["scanner-1"]) == list(range(4000))


def test_percent_rank_of_close_values(spark):
    n = 1_000_000
    df = spark.range(n).select(F.lit("p").alias("part"), (1 + F.pmod(F.col("id") * 7919, F.lit(n)) / 1e9).alias("x"))
    ranks = scoring.percent_ranks(df, "part", "x")
    assert ranks.filter(F.abs(F.col("pr") - F.round((F.col("x") - 1) * 1e9) / (n - 1)) > 1e-12).count() == 0
    ranges = spark.read.parquet(next(f.rsplit("/", 1)[0] for f in ranks.inputFiles())).groupBy("_range").count().collect()
    assert len(ranges) > 2 and max(r["count"] for r in ranges) <= 2 * n / len(ranges)


def test_percent_rank_of_ties_and_groups(spark):
    rows = [("a", float(v)) for v in (5, 1, 1, 3, 3, 3)] + [("b", 7.0), ("c", float("nan")), ("c", -0.0), ("c", 2.0)]
    got = {(r.part, str(r.x)): r.pr for r in scoring.percent_ranks(spark.createDataFrame(rows, "part STRING, x DOUBLE"), "part", "x").collect()}
    assert got == {("a", "1.0"): 0, ("a", "3.0"): 0.4, ("a", "5.0"): 1, ("b", "7.0"): 0, ("c", "-0.0"): 0, ("c", "2.0"): 0.5, ("c", "nan"): 1} or got[("c", "0.0")] == 0


def test_rejected_rows_are_kept_apart(spark):
    df = spark.createDataFrame([(1, "pending", 5), (2, "lost", 50), (3, None, None), (4, "failed", 0)], "id BIGINT, status STRING, priority INT")
    path = shared_dir(spark, "quarantine-test")
    seen = agents.quarantine(df, agents.job_checks(), path)
    assert seen == {"rows": 4, "rejected": 2, "valid_status": 1, "valid_priority": 2}
    got = {r.id: (r.part, r.violations) for r in spark.read.parquet(path).collect()}
    assert got == {1: ("accepted", []), 2: ("rejected", ["valid_status", "valid_priority"]), 3: ("accepted", []), 4: ("rejected", ["valid_priority"])}


def test_payload_fields(spark):
    rows = [(1, '{"a": {"b": [1, "2"]}}'), (2, "{broken"), (3, None), (4, '{"a": null}'), (5, "[]"), (6, '"text"')]
    got = payloads.fields(spark.createDataFrame(rows, "id BIGINT, p STRING"), "p", {"first": ("$.a.b[0]", "bigint", -1), "second": ("$.a.b[1]", "bigint", None)})
    assert {r.id: (r["first"], r.second) for r in got.collect()} == {1: (1, 2), 2: (None, None), 3: (None, None), 4: (-1, None), 5: (-1, None), 6: (-1, None)}
