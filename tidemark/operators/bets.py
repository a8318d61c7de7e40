"""Prediction-market bets: evaluation, sizing, limits, copying and strategy adjustment."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidemark import fixed
from tidemark.functions import rules as ru
from tidemark.functions import text as tx
from tidemark.functions.values import cents, clamp


def evaluate(markets: DataFrame) -> DataFrame:
    """Markets worth a bet, with side, edge and size. Sizing is fractional Kelly, limited by edge and confidence."""
    m = (markets.filter((F.col("volume") >= fixed.MIN_MARKET_VOLUME) & (F.col("liquidity") >= fixed.MIN_MARKET_LIQUIDITY))
         # exploding a single struct makes the text be parsed once; as plain columns the parsing would be
         # repeated in every filter below that is pushed down
         .select("*", F.explode(F.array(F.struct(
             tx.percent_in(F.col("research")).alias("probability"), tx.confidence_in(F.col("research")).alias("confidence"),
             F.upper("research").contains("EXTREME_ODDS").alias("flag")))).alias("r"))
         .select("*", "r.probability", "r.confidence", "r.flag"))
    p, price = F.col("probability"), F.col("yes_price")
    low, high = fixed.PROBABILITY_RANGE
    m = m.withColumn("is_extreme", (p < low) | (p > high)).withColumn("signed_edge", p - price)
    edge = F.abs("signed_edge")
    flagged = F.col("flag") | (p < fixed.LONGSHOT)
    m = m.filter(~(F.col("is_extreme") & flagged) & (edge >= fixed.MIN_EDGE)
                 & ~(F.col("is_extreme") & (edge < fixed.MIN_EDGE_EXTREME)))
    yes = F.col("signed_edge") > 0
    # one step per column: each is used several times below, and would be repeated if written inline
    m = m.select("id", p.alias("probability"), "confidence", "is_extreme", "signed_edge", edge.alias("edge"),
                 F.when(yes, p).otherwise(1 - p).alias("win"), F.when(yes, price).otherwise(1 - price).alias("stake"))
    win, stake, odds, fraction, kelly = (F.col(c) for c in ("win", "stake", "odds", "fraction", "kelly"))
    m = m.withColumn("odds", F.when(stake > 0, (1 - stake) / stake).otherwise(0.0))
    m = m.withColumn("fraction", F.when(odds > 0, (win * odds - (1 - win)) / odds))
    m = m.withColumn("kelly", F.when(odds > 0, clamp(fixed.MAX_POSITION * fraction * fixed.KELLY_SHARE, fixed.MIN_POSITION, fixed.MAX_POSITION))
                     .otherwise(fixed.MAX_POSITION * 0.1))
    capped = F.when(F.col("is_extreme"), F.least(kelly, F.lit(fixed.MAX_POSITION_EXTREME))).otherwise(kelly)
    size = F.greatest(F.lit(fixed.MIN_POSITION), F.least(capped, fixed.MAX_POSITION * F.col("edge") * F.col("confidence")))
    warn = F.when((F.col("probability") < fixed.LONGSHOT) & (F.col("signed_edge") > 0.05), F.lit(fixed.LONGSHOT_WARNING))
    return m.select("id", F.when(F.col("signed_edge") > 0, "YES").otherwise("NO").alias("side"), stake.alias("current_price"),
                    win.alias("target_price"), "edge", "confidence", "probability", "is_extreme", cents(size).alias("amount"),
                    warn.alias("warning"), F.coalesce(fraction, F.lit(0.0)).alias("kelly_fraction"))


def simple_edge(markets: DataFrame, top: int = 5, min_volume: float = 500_000) -> DataFrame:
    """The first ``top`` markets in listing order, then the volume filter: the limit comes first."""
    m = markets.orderBy("pos").limit(top).filter(F.col("volume") >= min_volume)
    p = tx.percent_in(F.col("research"))
    return (m.select("id", p.alias("probability"), F.abs(p - 0.5).alias("edge"), F.when(p > 0.5, "YES").otherwise("NO").alias("side"))
            .filter(F.col("edge") >= fixed.MIN_EDGE))


def wallet_score() -> Column:
    """0-1 from profit, win rate and number of trades."""
    s = (F.least(F.col("total_profit") / 10_000, F.lit(1.0)) * 0.4 + F.col("win_rate") * 0.3
         + F.least(F.col("total_trades") / 100, F.lit(1.0)) * 0.3)
    return F.least(s, F.lit(1.0))


def copy_signals(positions: DataFrame, top: int = 5) -> DataFrame:
    """Best positions of followed wallets; only confident ones are marked for execution."""
    s = positions.withColumn("confidence", F.col("win_rate") * F.col("score"))
    s = s.orderBy((F.col("confidence") * F.col("size")).desc(), "position_id").limit(top)
    return s.withColumn("execute", F.col("confidence") >= fixed.COPY_CONFIDENCE)


def recent_form(trades: DataFrame, order: Sequence[Column], n: int = 10) -> DataFrame:
    """Win rate and profit of the last ``n`` trades, and how many trades there are in all."""
    last = trades.orderBy(*order).limit(n).agg(
        F.try_divide(F.count_if(F.col("pnl") > 0), F.count(F.lit(1))).alias("win_rate"), F.sum("pnl").alias("total_pnl"))
    size = trades.agg(F.count(F.lit(1)).alias("trades"))
    return last.join(F.broadcast(size))  # one row each


def strategy_adjustment(form: DataFrame, lose: float = -30, win: float = 50, max_position: float = fixed.MAX_POSITION,
                        stop: float = fixed.STOP_LOSS) -> DataFrame:
    """Tighten after losses, loosen after gains, else keep the standard limits."""
    base = F.col("trades") < 5
    tight = ~base & ((F.col("win_rate") < 0.4) | (F.col("total_pnl") < lose))
    loose = ~base & ~tight & (F.col("win_rate") > 0.6) & (F.col("total_pnl") > win)

    def pick(t, l, n):
        return F.when(tight, F.lit(t)).when(loose, F.lit(l)).otherwise(F.lit(n))

    return form.select("win_rate", "total_pnl", "trades", pick(-1, 1, 0).alias("adjustment"),
                       F.when(base, "baseline").otherwise(pick("conservative", "aggressive", "standard")).alias("mode"),
                       pick(0.15, 0.08, 0.10).alias("min_edge"), pick(3.0, max_position, max_position).alias("max_position"),
                       pick(0.10, stop, stop).alias("stop_loss"))


def stop_loss(positions: DataFrame, share: float = fixed.STOP_LOSS) -> DataFrame:
    loss = F.try_divide(F.col("current") - F.col("entry"), F.col("entry"))
    return positions.filter(F.col("entry") > 0).withColumn("loss", loss).filter(F.col("loss") <= -share)


def allocate(candidates: DataFrame, group: Sequence[str], limit: float = fixed.MAX_DAILY_EXPOSURE,
             max_position: float | None = None) -> DataFrame:
    """Accept candidates by falling edge while they fit the limit; one that does not fit uses up nothing.

    Greedy, so a fold over the group, which is first cut down without changing the result: of the
    candidates with equal amounts only the first ``limit / amount`` by edge can be accepted, because once
    one of them does not fit, no later one of that amount does. Amounts are whole cents, so a group keeps a number of
    rows that depends on the limit only, the sum of ``limit / amount`` over all amounts (11,000 at a limit of 15). The
    rank bound is applied before the shuffle. Amounts of zero always fit and stay out of the fold; negative ones
    and nulls are no candidates.
    """
    amount = F.col("amount") if max_position is None else F.least(F.col("amount"), F.lit(max_position))
    cap = int(round(limit * 100))
    every = candidates.withColumn("_c", F.round(amount * 100).cast("bigint"))
    free, c = every.filter(F.col("_c") == 0), every.filter(F.col("_c").between(1, cap))
    w = W.partitionBy(*group, "_c").orderBy(F.col("edge").desc(), "id")
    c = c.withColumn("_rn", F.row_number().over(w)).filter((F.col("_rn") <= cap) & (F.col("_rn") * F.col("_c") <= cap))
    ranked = c.groupBy(*group).agg(F.array_sort(F.collect_list(F.struct((-F.col("edge")).alias("e"), "id", "_c"))).alias("q"))
    start = F.struct(F.lit(0).cast("bigint").alias("used"), F.array().cast(f"array<struct<id:{_type(candidates, 'id')},_c:bigint>>").alias("took"))

    def step(s, x):
        fits = s["used"] + x["_c"] <= cap
        return F.when(fits, F.struct((s["used"] + x["_c"]).alias("used"),
                                     F.array_append(s["took"], F.struct(x["id"].alias("id"), x["_c"].alias("_c"))).alias("took"))).otherwise(s)

    got = ranked.select(*group, F.explode(F.aggregate("q", start, step)["took"]).alias("t"))
    took = got.select(*group, F.col("t.id").alias("id"), (F.col("t._c") / 100).alias("amount"))
    return took.unionByName(free.select(*group, "id", F.lit(0.0).alias("amount")))


def _type(df: DataFrame, c: str) -> str:
    return df.schema[c].dataType.simpleString()


def hedge_coverage(text: Column) -> Column:
    """Coverage of the first tier named in the text, 0 when none is."""
    out = None
    for tier, share in fixed.HEDGE_TIERS:
        cond = text.contains(tier)
        out = F.when(cond, share) if out is None else out.when(cond, share)
    return out.otherwise(0.0)


def hedge_lines(scans: DataFrame, text: str = "output") -> DataFrame:
    """Lines of a scan's output that name one of the two best tiers and speak of coverage or give a percentage: one row each, ``line_no`` from 0, ``raw_line``."""
    best = F.col("raw_line").contains(fixed.HEDGE_TIERS[0][0]) | F.col("raw_line").contains(fixed.HEDGE_TIERS[1][0])
    told = F.lower("raw_line").contains("coverage") | F.col("raw_line").contains("%")
    lines = scans.select("*", F.posexplode(F.split(text, "\n")).alias("line_no", "raw_line"))
    return lines.filter(best & told)


def hedges(pairs: DataFrame) -> DataFrame:
    return pairs.withColumn("coverage", hedge_coverage(F.col("analysis"))).filter(F.col("coverage") >= fixed.HEDGE_MIN_COVERAGE)


def red_flags(bets: DataFrame) -> DataFrame:
    """Reasons to refuse a bet."""
    low, high = fixed.PROBABILITY_RANGE
    flags = ru.reasons(((F.col("probability") < low) | (F.col("probability") > high), "EXTREME_PROBABILITY"),
                       (F.col("confidence") <= 0.4, "LOW_CONFIDENCE"),
                       (F.col("days_to_resolve") > 30, "FAR_RESOLUTION"),
                       (F.col("amount") > 0.2 * fixed.MAX_DAILY_EXPOSURE, "OVERSIZED"))
    return bets.withColumn("flags", flags).filter(F.size("flags") > 0)
