"""The wallet scan: trades of followed wallets in, scored and gated tokens out."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidemark.operators import aggregates as ag
from tidemark.operators import joins as jn
from tidemark.operators import scoring as sc


def scan(trades: DataFrame, pairs: DataFrame, distribution: DataFrame, security: DataFrame, as_of: Column) -> DataFrame:
    """Bought tokens enriched with their best pair, holder shares and security flags, then scored."""
    bought = ag.confirmations(trades).withColumnRenamed("wallets", "confirmations")
    e = (jn.enrich(bought, pairs).join(distribution, "token", "left").join(security, "token", "left")
         .withColumn("age_days", F.date_diff(as_of, F.to_date("created_at"))))
    return sc.score_wallet_tokens(e)


def top_by_status(scored: DataFrame, keep: dict[str, int] | None = None) -> DataFrame:
    """The report's lists: best PASS tokens by composite, the other groups in their own order."""
    keep = keep or {"PASS": 3, "WATCH": 5, "REJECT": 10}
    w = W.partitionBy("status").orderBy(F.when(F.col("status") == "PASS", -F.col("composite")).otherwise(0.0), "token")
    limit = F.lit(0)
    for s, k in keep.items():
        limit = F.when(F.col("status") == s, k).otherwise(limit)
    return (scored.withColumn("rn", F.row_number().over(w).cast("bigint")).filter(F.col("rn") <= max(keep.values()))
            .filter(F.col("rn") <= limit))
