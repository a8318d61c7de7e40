"""Tables that streams end in: alerts that are stored once, and the latest state of every key.

Both are written by ``foreachBatch``, which may hand over a batch again after a failure; doing so changes nothing.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.operators.agents import latest_state, merge_states


def stored(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """The table below ``path``; one that was never written is empty."""
    try:
        return spark.read.schema(schema).parquet(path)
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], schema)


def append_alerts(batch: DataFrame, batch_id: int, path: str, key: list[str], ts: str, first: list[str] | None = None) -> None:
    """Add the alerts of one batch, once per (key, batch).

    Of alerts with equal key the earliest is kept, ties by ``first``. The table is cut by the alerts' day, so that the number of folders
    follows the calendar, not the batches. A batch that comes again finds its rows by number in the days it touches and adds only
    what is missing; what other batches stored is neither read nor rewritten.
    """
    cols = [c for c in batch.columns if c not in key]
    order = F.struct(F.col(ts), *[F.col(c) for c in first or []]) if first else F.col(ts)
    one = batch.groupBy(*key).agg(F.min_by(F.struct(*cols), order).alias("_a")).select(*key, *[F.col(f"_a.{c}").alias(c) for c in cols])
    rows = one.withColumn("batch_id", F.lit(batch_id).cast("bigint")).withColumn("day", F.to_date(ts)).select(*batch.columns, "batch_id", "day")
    rows.persist()  # one reading of the batch for its days and its rows
    try:
        days = [r["day"] for r in rows.select("day").distinct().collect()]  # the days of one batch
        if days:
            known = stored(batch.sparkSession, path, ", ".join(f"`{n}` {t}" for n, t in rows.dtypes))
            mine = known.filter(F.col("day").isin(days) & (F.col("batch_id") == batch_id)).select(*[F.col(k).alias(f"_k{i}") for i, k in enumerate(key)])
            same = None
            for i, k in enumerate(key):
                eq = F.col(k).eqNullSafe(F.col(f"_k{i}"))
                same = eq if same is None else same & eq
            fresh = rows.join(mine, same, "left_anti")
            fresh.hint("rebalance", F.col("day")).write.mode("append").partitionBy("day").parquet(path)
    finally:
        rows.unpersist()


def upsert_states(batch: DataFrame, batch_id: int, path: str, key: str, ts: str, tie: str, buckets: int = 64) -> None:
    """Bring the newest row of each key of the batch into the state table.

    The table is cut by a hash of the key, and only buckets that the batch has keys of are read and replaced (dynamic overwrite). Rows that are older
    than what is stored change nothing, and the latest of two equal times is decided by ``tie``; so batches may come in any order and again.
    """
    bucket = F.pmod(F.xxhash64(key), F.lit(buckets)).cast("int")
    new = latest_state(batch, key, ts, tie).withColumn("bucket", bucket)
    new.persist()
    try:
        touched = [r["bucket"] for r in new.select("bucket").distinct().collect()]  # at most ``buckets``
        if touched:
            old = stored(batch.sparkSession, path, ", ".join(f"`{n}` {t}" for n, t in new.dtypes)).filter(F.col("bucket").isin(touched))
            merged = merge_states(old.drop("bucket").unionByName(new.drop("bucket")), key, tie).withColumn("bucket", bucket)
            (merged.select(*new.columns).repartition("bucket").write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
             .partitionBy("bucket").parquet(path))
    finally:
        new.unpersist()


def run_into(stream: DataFrame, write: Callable[[DataFrame, int], None], checkpoint: str) -> None:
    """Process what is there with ``foreachBatch``; the next call with this checkpoint goes on with the next batch number."""
    q = stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    q.awaitTermination()


def alert_sink(stream: DataFrame, path: str, checkpoint: str, key: list[str], ts: str, first: list[str] | None = None) -> None:
    run_into(stream, lambda df, i: append_alerts(df, i, path, key, ts, first), checkpoint)


def state_sink(stream: DataFrame, path: str, checkpoint: str, key: str, ts: str, tie: str, buckets: int = 64) -> None:
    run_into(stream, lambda df, i: upsert_states(df, i, path, key, ts, tie, buckets), checkpoint)


def parts(df: DataFrame, path: str, by: list[Column]):
    """Write ``df`` in pieces, one for each condition; yields after each, so that a stream over ``path`` can take a piece as its next batch."""
    for cond in by:
        df.filter(cond).write.mode("append").parquet(path)
        yield path
