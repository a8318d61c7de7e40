"""Scanner text output and run logs to rows.

Lines carry a file, a line number and a slice (see ``operators.sliced``), so a very long file is not read
by one task.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidemark import fixed
from tidemark.operators import sliced

LINES_PER_SLICE = 100_000


def read_lines(spark: SparkSession, path: str, log: str | None = None) -> DataFrame:
    """Lines of raw text files below ``path`` with the log they are of and their number in it, from 0: file, line_no, value.

    A log is a file, named without its folder and ending; or, with the name of a partition column in ``log``, all files of a folder in the order of their
    names, as rotated logs are. Files are read in splits by as many tasks as they have, in any order: a line's number is its place in the
    split and the lines of the splits before, of which only the counts are brought together. Texts are not moved.
    """
    meta = F.col("_metadata")
    name = F.col(log) if log else F.regexp_replace(meta["file_name"], r"\.[^.]*$", "")
    lines = spark.read.text(path).select(name.alias("file"), meta["file_path"].alias("_path"), meta["file_block_start"].alias("_block_start"),
                                         F.monotonically_increasing_id().alias("_at"), "value")
    splits = lines.groupBy("file", "_path", "_block_start").agg(F.min("_at").alias("_first"), F.count(F.lit(1)).alias("_n"))
    before = W.partitionBy("file").orderBy("_path", "_block_start").rowsBetween(W.unboundedPreceding, -1)
    splits = splits.select("_path", "_block_start", (F.coalesce(F.sum("_n").over(before), F.lit(0)) - F.col("_first")).alias("_block_shift"))
    return lines.join(splits, ["_path", "_block_start"]).select("file", (F.col("_at") + F.col("_block_shift")).alias("line_no"), "value")


def scan_blocks(lines: DataFrame) -> DataFrame:
    """Tokens listed in scanner output.

    A header opens a record, the line with the explorer link closes it; what an unclosed record held is
    lost. Lines are numbered by the headers so far and the links before them: one record is one such
    group, so it is built by a plain aggregate.
    """
    v = F.col("value")
    is_header, is_link = v.rlike(fixed.LOG_HEADER), v.contains(fixed.LOG_LINK)
    cut = sliced.slice_number(lines, "line_no", LINES_PER_SLICE)
    seg = sliced.running_sums(cut, ["file"], ["line_no"], {
        "headers": is_header.cast("bigint"), "links": is_link.cast("bigint")})
    seg = seg.withColumn("links", F.col("links") - is_link.cast("bigint"))

    def newest(cond, value):
        return F.max(F.when(cond, F.struct("line_no", value.alias("x"))))["x"]

    change = F.regexp_extract(v, fixed.LOG_CHANGE, 1)
    mc = F.regexp_replace(F.regexp_extract(v, fixed.LOG_MARKET_CAP, 1), ",", "")
    rec = seg.groupBy("file", "headers", "links").agg(
        newest(is_header, F.trim(F.regexp_extract(v, fixed.LOG_HEADER, 1))).alias("name"),
        newest(is_header, F.regexp_extract(v, fixed.LOG_HEADER, 2)).alias("symbol"),
        newest(v.contains("Price:"), F.trim(F.get(F.split(v, "Price:"), F.lit(1)))).alias("price"),
        newest(v.contains("24h:") & (change != ""), change.try_cast("double")).alias("change_24h"),
        newest(v.contains("MC:") & (mc != ""), mc.try_cast("bigint")).alias("market_cap"),
        newest(is_link, F.nullif(F.regexp_extract(v, fixed.LOG_TOKEN, 1), F.lit(""))).alias("address"),
        F.count_if(is_link).alias("closed"))
    return (rec.filter(F.col("symbol").isNotNull() & (F.col("closed") > 0))
            .select("file", "name", "symbol", F.coalesce("price", F.lit("")).alias("price"),
                    F.coalesce("change_24h", F.lit(0.0)).alias("change_24h"),
                    F.coalesce("market_cap", F.lit(0)).alias("market_cap"), "address"))


def run_metrics(lines: DataFrame) -> DataFrame:
    """Funnel counts and duration of each run in the run logs; a banner line starts a run."""
    v = F.col("value")
    cut = sliced.slice_number(lines, "line_no", LINES_PER_SLICE)
    runs = sliced.running_sums(cut, ["file"], ["line_no"], {"run": v.contains(fixed.LOG_BANNER).cast("bigint")})
    at = F.unix_timestamp(F.try_to_timestamp(F.regexp_extract(v, fixed.LOG_TIME, 1)))
    out = runs.filter(F.col("run") > 0).groupBy("file", "run").agg(
        *[F.max(F.regexp_extract(v, p, 1).try_cast("bigint")).alias(n) for n, p in fixed.LOG_METRICS.items()],
        (F.max(at) - F.min(at)).alias("seconds"))
    return out.na.fill(0, ["too_fresh", "too_old"])
