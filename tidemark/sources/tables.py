"""Watchlists, thresholds and the written tables: snapshots, alerts and histories."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.errors import AnalysisException

from tidemark import fixed

WATCHLIST = "symbol STRING, name STRING, address STRING, chain STRING, added_date DATE, notes STRING"


def read_watchlist(spark: SparkSession, path: str, multi_line: bool = False) -> DataFrame:
    """Watchlist as JSON lines, or as one JSON array with ``multi_line``; a missing file is an empty list."""
    try:
        return spark.read.schema(WATCHLIST).option("multiLine", multi_line).json(path)
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], WATCHLIST)


def thresholds(spark: SparkSession, overrides: DataFrame, defaults: dict[str, float] | None = None) -> DataFrame:
    """Default settings overlaid by a (key, value) table; keys known to one side only are kept."""
    base = spark.createDataFrame(list((defaults or fixed.DEFAULT_THRESHOLDS).items()), "key STRING, preset DOUBLE")
    return (base.join(overrides.select("key", "value"), "key", "full")
            .select("key", F.coalesce("value", "preset").alias("value")))


def write_snapshot(scored: DataFrame, path: str, date: Column) -> None:
    """Daily scored snapshot; writing a date again replaces that date only."""
    (scored.withColumn("date", date).write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
     .partitionBy("date").parquet(path))


def write_alerts(alerts: DataFrame, path: str, batch_id: int) -> None:
    """Alerts of one batch; a batch that is run again replaces its own rows, so none is stored twice."""
    (alerts.withColumn("batch_id", F.lit(batch_id)).write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
     .partitionBy("batch_id").parquet(path))


def append_trim(history: DataFrame, new: DataFrame, key: str, order: list[str], keep: int = fixed.HISTORY_KEEP) -> DataFrame:
    """History plus new entries, the newest ``keep`` per key; the rank bound is applied before the shuffle."""
    w = W.partitionBy(key).orderBy(*[F.col(c).desc() for c in order])
    return history.unionByName(new).withColumn("_rn", F.row_number().over(w)).filter(F.col("_rn") <= keep).drop("_rn")
