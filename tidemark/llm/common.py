"""Helpers shared by the operators: words, written tables, running sums and joins that survive hot keys."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidemark.session import shared_dir

BLANKS = " \t\n\x0b\x0c\r"
BLANK_RUN = r"[\x20\x09-\x0D]+"
SALTS = 64


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return modest_batches(spark.read.parquet(f"{sf_dir}/{name}.parquet"))


def modest_batches(df: DataFrame) -> DataFrame:
    """``df``, whose session from now on hands texts to Python in batches of 4 MB rather than 64 MB, unless it was told another size."""
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    if df.sparkSession.conf.get(name) == "67108864b":
        df.sparkSession.conf.set(name, str(4 << 20))
    return df


def stored(df: DataFrame, purpose: str) -> DataFrame:
    """Write a table below the cluster's shared folder and read it back: cuts lineage and survives lost executors."""
    path = shared_dir(df.sparkSession, purpose)
    df.write.parquet(path)
    table = df.sparkSession.read.schema(df.schema).parquet(path)
    table.written_to = path
    return table


def released(df: DataFrame, purpose: str) -> DataFrame:
    """``stored``, whose shuffle files go as soon as the table is written, not when the driver happens to collect its garbage."""
    conf, name = df.sparkSession.conf, "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = conf.get(name, None)
    conf.set(name, "true")
    try:
        return stored(df, purpose)
    finally:
        if before is None:
            conf.unset(name)
        else:
            conf.set(name, before)


def removed(*tables: DataFrame) -> None:
    """Delete the files of tables that ``stored`` or ``released`` wrote and that nothing reads any more."""
    for df in tables:
        context = df.sparkSession.sparkContext
        path = context._jvm.org.apache.hadoop.fs.Path(df.written_to)
        path.getFileSystem(context._jsc.hadoopConfiguration()).delete(path, True)


def words(text: Column) -> Column:
    """Words as runs of characters other than ASCII white space; null and blank texts give an empty array."""
    inner = F.btrim(F.coalesce(text, F.lit("")), F.lit(BLANKS))
    return F.when(inner == "", F.array().cast("array<string>")).otherwise(F.split(inner, BLANK_RUN))


def n_words(text: Column) -> Column:
    inner = F.btrim(F.coalesce(text, F.lit("")), F.lit(BLANKS))
    return F.when(inner == "", F.lit(0)).otherwise(F.size(F.split(inner, BLANK_RUN))).cast("long")


def running(df: DataFrame, keys: Sequence[str], chunk: str, order: Sequence[Column], value: Column, out: str) -> DataFrame:
    """Sum of ``value`` over the rows of the same keys that come earlier, as a new column ``out``.

    ``chunk`` is a column that rises with ``order`` and cuts each key into pieces. Only the pieces' sums are brought
    together by key, so a key that holds most rows is spread over many tasks. Null keys form a group of their own.
    """
    part = [*keys, chunk]
    valued = df.withColumn("run_value", value)
    sums = valued.groupBy(*part).agg(F.sum("run_value").alias("run_sum"))
    before = Window.partitionBy(*keys).orderBy(chunk).rowsBetween(Window.unboundedPreceding, -1)
    starts = sums.select(*[F.col(k).alias(f"run_{i}") for i, k in enumerate(part)],
                         F.coalesce(F.sum("run_sum").over(before), F.lit(0)).alias("run_start"))
    inside = Window.partitionBy(*part).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    own = valued.withColumn(out, F.coalesce(F.sum("run_value").over(inside), F.lit(0)))
    on = [F.col(k).eqNullSafe(F.col(f"run_{i}")) for i, k in enumerate(part)]
    cond = on[0]
    for c in on[1:]:
        cond = cond & c
    return (own.join(starts, cond).withColumn(out, (F.col(out) + F.col("run_start")).cast("long"))
            .drop("run_value", "run_start", *[f"run_{i}" for i in range(len(part))]))


def spread_join(left: DataFrame, right: DataFrame, key: str, by: Column, how: str = "inner") -> DataFrame:
    """Join on ``key`` (null never matches), where many left rows may share a key and right has one row for each.

    Left rows are salted by ``by``; a right row is copied only to the salts that its key really has on the left, so
    a rare key stays one row and a hot key is met in up to ``SALTS`` tasks.
    """
    salted = left.withColumn("salt", F.pmod(F.xxhash64(by), F.lit(SALTS)))
    present = salted.select(key, "salt").distinct()
    return salted.join(present.join(right, key), [key, "salt"], how).drop("salt")


def spread_min(df: DataFrame, key: str, value: str, by: Column, out: str) -> DataFrame:
    """Least ``value`` within each key, found salt by salt first; one row for each key."""
    part = df.groupBy(key, F.pmod(F.xxhash64(by), F.lit(SALTS)).alias("salt")).agg(F.min(value).alias(out))
    return part.groupBy(key).agg(F.min(out).alias(out))


def checked_broadcast(df: DataFrame, rows: int = 2_000_000) -> DataFrame:
    """A narrow table marked for broadcast if it is counted to have at most so many rows; else as it is, for an ordinary join."""
    return F.broadcast(df) if df.count() <= rows else df
