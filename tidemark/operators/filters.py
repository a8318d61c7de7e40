"""Row predicates and labels on market snapshots."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark import fixed
from tidemark.functions.values import nz, when_first


def in_target(mc: str = "market_cap") -> Column:
    return F.col(mc).between(*fixed.TARGET_MC)


def target_band(df: DataFrame) -> DataFrame:
    return df.filter(in_target() & (F.col("liquidity") >= fixed.TARGET_MIN_LIQUIDITY))


def trading_rule() -> Column:
    """Name of the first rule a token breaks; a liquidity of zero means unknown and passes."""
    low, high = fixed.TARGET_MC
    return when_first(
        (F.col("market_cap") < low, "mc_low"),
        (F.col("market_cap") > high, "mc_high"),
        ((F.col("liquidity") > 0) & (F.col("liquidity") < fixed.RULE_MIN_LIQUIDITY), "liquidity_low"),
        (F.col("volume_24h") < fixed.RULE_MIN_VOLUME, "volume_low"),
        default="match")


def source_preband(source: str = "source", bands: dict | None = None) -> Column:
    """Market-cap band per source; sources without a band pass."""
    bands = bands or fixed.SOURCE_BANDS
    return when_first(*[(F.col(source) == s, F.col("market_cap").between(*b)) for s, b in bands.items()], default=True)


def allowed_chain(df: DataFrame, chains: tuple[str, ...] = fixed.CHAINS) -> DataFrame:
    return (df.withColumn("chain", F.lower("chain"))
            .filter(F.col("chain").isin(*chains) & (F.coalesce("address", F.lit("")) != "")))


def young_enough(created_seconds: Column, as_of_seconds: Column, hours: float = fixed.DISCOVERY_MAX_AGE_HOURS) -> Column:
    """Unknown creation time (null or zero) passes."""
    return (nz(created_seconds) == 0) | ((as_of_seconds - created_seconds) / 3600.0 <= hours)


def age_days(created_seconds: Column, as_of_seconds: Column) -> Column:
    """Whole days since creation, truncated toward zero; 0 when unknown."""
    days = ((as_of_seconds - created_seconds) / 86400.0).cast("int")
    return F.when(nz(created_seconds) == 0, 0).otherwise(days)


def age_or_estimate(created_seconds: Column, as_of_seconds: Column) -> Column:
    """Age in days; without a creation time a high turnover stands for an established token."""
    turnover = F.try_divide(nz("volume_24h").cast("double"), nz("market_cap"))
    estimate = F.when((nz("market_cap") > 0) & (turnover > fixed.AGED_BY_TURNOVER), fixed.AGE_DAYS[0] + 1).otherwise(0)
    days = ((as_of_seconds - created_seconds) / 86400.0).cast("int")
    return F.when(created_seconds.isNull(), estimate).otherwise(days)


def age_class(age: Column) -> Column:
    young, old = fixed.AGE_DAYS
    return when_first((age < young, "too_fresh"), (age > old, "too_old"), default="sweet_spot")


def momentum_class(change: Column | None = None) -> Column:
    change = F.col("change_24h") if change is None else change
    low, high = fixed.MOMENTUM
    return when_first((change < low, "falling"), (change > high, "parabolic"), default="keep")


def target_class() -> Column:
    """match / micro / large; null for tokens without a market cap."""
    return when_first((in_target(), "match"), (F.col("market_cap") <= 0, None),
                      (F.col("market_cap") < fixed.TARGET_MC[0], "micro"), (F.col("market_cap") > 0, "large"))


def discovery_pass(cfg: dict = fixed.DISCOVERY) -> Column:
    return ((F.col("market_cap") <= cfg["max_mc"]) & (F.col("volume_24h") >= cfg["min_volume"])
            & F.col("change_24h").between(cfg["min_change"], cfg["max_change"])
            & F.lower("chain").isin(*fixed.CHAINS))


def launches(df: DataFrame, limit: int = fixed.LAUNCH_LIMIT, min_holders: int = fixed.LAUNCH_MIN_HOLDERS) -> DataFrame:
    """New launches by momentum; the limit is the feature (a top list)."""
    return (df.filter(F.col("market_cap").between(*fixed.LAUNCH_BAND) & (F.col("holders") >= min_holders))
            .orderBy(F.col("change_24h").desc(), "token").limit(limit))


def change_label(change: Column) -> Column:
    return when_first((change > 50, "surging"), (change > 20, "rising"), (change > 0, "up"), default="down")


def mc_label(mc: Column) -> Column:
    low, high = fixed.TARGET_MC
    return when_first((mc <= 0, None), (mc.between(low, high), "sweet_spot"), (mc < low, "below"), (mc > high, "above"))


def service_down(status: Column, health: Column) -> Column:
    return ~status.isin("running", "stopped") & ((health == "unhealthy") | status.isin("error", "crashed"))


def inbox(messages: DataFrame, agent: str, limit: int = 10, unread_only: bool = True) -> DataFrame:
    """Newest messages addressed to the agent or to everybody."""
    m = messages.filter((F.col("to_agent") == agent) | F.col("to_agent").isNull())
    if unread_only:
        m = m.filter(~F.col("read"))
    return m.orderBy(F.col("created_at").desc(), F.col("id").desc()).limit(limit)


def symbol_signals(signals: DataFrame, token: str) -> DataFrame:
    """Number of signals for one token, whatever the letter case."""
    hit = signals.filter(F.lower("token") == token.lower())
    return hit.agg(F.count(F.lit(1)).alias("count")).select(F.lit(token).alias("token"), "count")
