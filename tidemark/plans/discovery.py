"""The discovery scan: vendor listings in, ranked matches out."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions.values import epoch
from tidemark.operators import aggregates as ag
from tidemark.operators import filters as fl
from tidemark.operators import ranking as rk


def select(listings: DataFrame, as_of: Column) -> DataFrame:
    """De-duplicated listings inside the age window and momentum band, with their target class.

    A listing without a creation time counts as established when its turnover is high, else as fresh.
    """
    age = fl.age_or_estimate(epoch("created_at"), as_of)
    return (ag.dedup_tokens(listings)
            .filter(fl.age_class(age) == "sweet_spot")
            .filter(fl.momentum_class() == "keep")
            .withColumn("kind", fl.target_class())
            .filter(F.col("kind").isNotNull()))


def scan(listings: DataFrame, as_of: Column) -> DataFrame:
    return rk.top_matches(select(listings, as_of))
