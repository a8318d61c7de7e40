"""Engine scores, wallet-token scores, gates and alerts as column expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidemark import fixed
from tidemark.functions import rules as ru
from tidemark.functions import text as tx
from tidemark.functions.values import clamp, nz
from tidemark.session import written

CHANGE, MC, VOL = "change_24h", "market_cap", "volume_24h"


def _points(rules: list[ru.Rule], passes: float) -> tuple[Column, Column]:
    s = ru.total(rules)
    return s, s >= passes


def _engines(df: DataFrame, a, b, c) -> DataFrame:
    """Add score and verdict per engine, the list of engines that fired and the total."""
    named = dict(zip("abc", (a, b, c)))
    fired = F.concat_ws(",", *[F.when(ok, F.lit(n.upper())) for n, (_, ok) in named.items()])
    return df.withColumns({**{f"score_{n}": score for n, (score, _) in named.items()},
                           **{f"engine_{n}": ok for n, (_, ok) in named.items()},
                           "engines": fired, "total": a[0] + b[0] + c[0]})


def scan_engines(df: DataFrame, prices: str = "prices") -> DataFrame:
    """Scores of the live scan from the last few prices, change, volume and market cap."""
    ch, p, n = F.col(CHANGE), F.col(prices), F.size(prices)
    last, prev, third = F.try_element_at(p, F.lit(-1)), F.try_element_at(p, F.lit(-2)), F.try_element_at(p, F.lit(-3))
    a = [ru.rule(last > third, 0.3), ru.rule(F.abs(ch) > 10, 0.2), ru.rule(ch > 0, 0.2)]
    b = [ru.rule(ch > 50, 0.3), ru.rule((ch > 20) & (ch < 200), 0.3), ru.rule(F.col(VOL) > 100_000, 0.2),
         ru.rule(last > prev, 0.2)]
    c = [ru.ladder((F.col(MC) >= 300_000, 0.3), (F.col(MC) >= 100_000, 0.1)), ru.rule(ch > 20, 0.3),
         ru.rule((ch > 0) & (ch < 300), 0.2), ru.rule(last >= prev * 0.95, 0.2)]

    def guarded(rules, passes, least):
        score, ok = _points(rules, passes)
        return F.when(n >= least, score).otherwise(0.0), F.coalesce((n >= least) & ok, F.lit(False))

    return _engines(df, guarded(a, 0.5, 3), guarded(b, 0.6, 3), guarded(c, 0.6, 2))


def report_engines(df: DataFrame) -> DataFrame:
    """Scores of the engine report, from change, volume and market cap alone."""
    ch = F.col(CHANGE)
    a = [ru.rule(ch.between(20, 100), 0.5), ru.rule(ch > 0, 0.3)]
    b = [ru.ladder((ch > 100, 0.4), (ch > 50, 0.3)), ru.rule(ch < 500, 0.3), ru.rule(F.col(VOL) > 200_000, 0.3)]
    c = [ru.ladder((F.col(MC) >= 300_000, 0.4), (F.col(MC) >= 200_000, 0.2)), ru.ladder((ch > 100, 0.4), (ch > 50, 0.2)),
         ru.rule((ch > 0) & (ch < 800), 0.2)]
    return _engines(df, _points(a, 0.5), _points(b, 0.6), _points(c, 0.6))


def daily_a() -> list[ru.Rule]:
    ch, age, t = F.col(CHANGE), F.col("age_days"), fixed.DAILY_A
    return [ru.rule(age >= 4, 0.2, t["history"]),
            ru.ladder((ch.between(10, 100), 0.4, t["steady"]), ((ch >= 5) & (ch < 10), 0.2, t["mild"])),
            ru.rule(ch > 0, 0.2, t["positive"]),
            ru.rule(F.col("riding") & (ch > 10), 0.5, t["riding"]),
            ru.rule((F.col("price_vs_high") < 0.7) & (F.col("volume_trend") == "high"), -0.6, t["double_top"]),
            ru.ladder((F.col("ath_drawdown") > 0.9, -0.8, t["dead"]), (F.col("ath_drawdown") > 0.7, -0.5, t["drawdown"])),
            ru.rule(ch < -30, -0.4, t["decline"])]


def daily_b() -> list[ru.Rule]:
    ch, vol, t = F.col(CHANGE), F.col(VOL), fixed.DAILY_B
    touches, rejections = F.col("touches"), F.col("rejections")
    return [ru.ladder((ch > 100, 0.4, tx.filled(t["strong"], ch)), (ch > 50, 0.3, tx.filled(t["good"], ch))),
            ru.rule((ch < 500) & (F.col("age_days") >= 2), 0.2, t["tempered"]),
            ru.ladder((vol > 100_000, 0.3, tx.filled(t["high_volume"], vol / 1000)),
                      (vol > 50_000, 0.2, tx.filled(t["good_volume"], vol / 1000))),
            ru.ladder((rejections >= 3, 0.5, tx.filled(t["rejections"], rejections)),
                      (touches >= 3, 0.3, tx.filled(t["tests"], touches)), (touches >= 1, 0.1, tx.filled(t["tested"], touches)))]


def daily_c() -> list[ru.Rule]:
    ch, vol, mc, age, t = F.col(CHANGE), F.col(VOL), F.col(MC), F.col("age_days"), fixed.DAILY_C
    touches = F.col("touches")
    ratio = F.when(F.col("sells") > 0, F.try_divide(F.col("buys"), F.col("sells")))
    return [ru.ladder((mc >= 300_000, 0.4, tx.filled(t["mc_300"], mc / 1000)), (mc >= 200_000, 0.2, tx.filled(t["mc_200"], mc / 1000))),
            ru.ladder((ch > 100, 0.3, tx.filled(t["strong"], ch)), (ch > 50, 0.2, tx.filled(t["good"], ch)),
                      (ch > 20, 0.1, tx.filled(t["mild"], ch))),
            ru.rule((ch > 0) & (ch < 800), 0.2, t["holding"]),
            ru.ladder((touches >= 5, 0.4, tx.filled(t["support_5"], touches)), (touches >= 3, 0.3, tx.filled(t["support_3"], touches)),
                      (touches >= 1, 0.1, tx.filled(t["support_1"], touches))),
            ru.ladder((vol > 100_000, 0.3, tx.filled(t["high_volume"], vol / 1000)),
                      (vol > 50_000, 0.2, tx.filled(t["good_volume"], vol / 1000)),
                      (vol > 20_000, 0.1, tx.filled(t["some_volume"], vol / 1000))),
            ru.ladder((ratio > 1.5, 0.3, tx.filled(t["buying_strong"], ratio)), (ratio > 1.2, 0.2, tx.filled(t["buying"], ratio)),
                      (ratio < 0.8, -0.2, tx.filled(t["selling"], ratio))),
            ru.rule(age >= 4, 0.1, t["old_enough"]), ru.rule(age <= 10, 0.1, t["fresh"]),
            ru.rule((age >= 10) & (touches >= 3), 0.2, t["mature"])]


def daily_engines(df: DataFrame) -> DataFrame:
    """The three daily engines with scores, verdicts and reason texts.

    Chart features that are missing take the values that make no rule apply.
    """
    neutral = {"price_vs_high": 1.0, "ath_drawdown": 0.0, "touches": 0, "rejections": 0, "riding": False, "volume_trend": "neutral"}
    have = set(df.columns)
    df = df.withColumns({c: F.coalesce(F.col(c), F.lit(v)) if c in have else F.lit(v) for c, v in neutral.items()})
    a, b, c = daily_a(), daily_b(), daily_c()
    out = _engines(df, _points(a, 0.5), _points(b, 0.6), _points(c, 0.7))
    return out.withColumns({f"reason_{n}": ru.notes(rules, " | ", fixed.NO_DATA) for n, rules in zip("abc", (a, b, c))})


# --- wallet-token scores -----------------------------------------------------------------------------


def _days(c: Column) -> Column:
    return F.concat(c.cast("int").cast("string"), F.lit("d"))


def whale_a() -> tuple[Column, Column]:
    age, n = F.col("age_days"), F.col("confirmations")
    low, high = fixed.AGE_DAYS
    rules = [ru.ladder((age.between(low, high), 20, F.concat(F.lit("Sweet spot age: "), _days(age))),
                       (age < low, -15, F.concat(F.lit("Too fresh: "), _days(age))),
                       (age > 30, -10, F.concat(F.lit("Aging: "), _days(age)))),
             ru.rule(n >= fixed.WALLET_CONFIRMATIONS, 15, F.concat(F.lit("Whale cluster: "), n.cast("string")))]
    return clamp(ru.total(rules, 50.0), 0.0, 100.0), ru.notes(rules, "; ", "No strong signals")


def whale_b() -> tuple[Column, Column]:
    """Zero or missing liquidity / volume neither helps nor hurts."""
    liq, vol = F.col("liquidity"), F.col("volume")

    def steps(c, names, cuts, pts):
        known = nz(c) != 0
        return ru.ladder(*[(known & cond, p, F.concat(F.lit(f"{n}: "), tx.usd(c)))
                           for cond, p, n in zip((c >= cuts[0], c >= cuts[1], F.lit(True)), pts, names)])

    rules = [steps(liq, ("Strong liquidity", "Adequate liquidity", "Low liquidity"), (100_000, fixed.WALLET_MIN_LIQUIDITY), (25, 10, -20)),
             steps(vol, ("Good volume", "Min volume", "Low volume"), (2 * fixed.WALLET_MIN_VOLUME, fixed.WALLET_MIN_VOLUME), (15, 5, -15))]
    return clamp(ru.total(rules, 50.0), 0.0, 100.0), ru.notes(rules, "; ", "Insufficient data")


def whale_c() -> tuple[Column, Column, Column]:
    """Risk score; the lock is three-valued (locked, unlocked, unknown)."""
    top10, mint, freeze, locked = (F.col(c) for c in ("top10_pct", "mint_authority", "freeze_authority", "lp_locked"))

    def note(label):
        return F.concat(F.lit(f"{label}: "), tx.filled("%.1f%%", top10))

    rules = [ru.ladder((top10 > fixed.WALLET_MAX_TOP10, -30, note("High top10")), (top10 > 25, -10, note("Elevated top10")),
                       (top10.isNotNull(), 10, note("Good distribution"))),
             ru.rule(mint, -20, "Mint authority enabled"), ru.rule(freeze, -15, "Freeze authority enabled"),
             ru.ladder((locked, 10, "LP locked"), (~locked, -15, "LP unlocked"))]
    risk = F.coalesce(top10 > fixed.WALLET_MAX_TOP10, F.lit(False)) | F.coalesce(mint, F.lit(False)) | F.coalesce(~locked, F.lit(False))
    return clamp(ru.total(rules, 50.0), 0.0, 100.0), ru.notes(rules, "; ", "No red flags"), risk


def composite(a: Column, b: Column, c: Column) -> Column:
    return F.lit(0.40) * a + F.lit(0.35) * b + F.lit(0.25) * c


def strategy_gates(df: DataFrame) -> DataFrame:
    """Hard gates on scored tokens: status and the reasons for it."""
    why = ru.reasons((F.col("liquidity") < fixed.WALLET_MIN_LIQUIDITY, "LIQUIDITY < $25,000"),
                     (F.col("volume") < fixed.WALLET_MIN_VOLUME, "VOLUME < $50,000"),
                     (F.col("top10_pct") > fixed.WALLET_MAX_TOP10, "TOP10 > 35%"),
                     (F.col("a_score") < 40, "WEAK_STRUCTURE"))
    strong = (F.col("composite") >= 70) & (F.col("confirmations") >= 2)
    failed = F.size("_why") > 0
    status = (F.when(failed & strong, "WATCH").when(failed, "REJECT").when(F.col("composite") >= 60, "PASS").otherwise("WATCH"))
    low = F.array(F.lit("LOW_COMPOSITE"))
    return (df.withColumn("_why", why)
            .withColumns({"status": status, "reject_reasons": F.when(~failed & (F.col("composite") < 60), low).otherwise(F.col("_why"))})
            .drop("_why"))


def score_wallet_tokens(enriched: DataFrame) -> DataFrame:
    (a, an), (b, bn), (c, cn, risk) = whale_a(), whale_b(), whale_c()
    s = enriched.withColumns({"a_score": a, "a_notes": an, "b_score": b, "b_notes": bn, "c_score": c, "c_notes": cn, "risk": risk})
    return strategy_gates(s.withColumn("composite", composite(F.col("a_score"), F.col("b_score"), F.col("c_score"))))


def unified_alerts(merged: DataFrame) -> DataFrame:
    """Zero to three alerts per token from the merged signals."""
    sources = F.array_compact(F.array(*[F.when(F.col(c), F.lit(n)) for c, n in
                                        (("flow_convergence", "nansen"), ("wallet_convergence", "cielo"), ("base_count", "base_signal"))]))

    def alert(cond, kind, priority, src):
        return F.when(cond, F.struct(F.lit(kind).alias("type"), F.lit(priority).alias("priority"), src.alias("sources")))

    alerts = F.array_compact(F.array(
        alert(F.size(sources) >= 2, "CONVERGENCE", "HIGH", F.array_join(sources, ",")),
        alert(F.col("divergence") & (F.col(CHANGE) > fixed.DIVERGENCE_PCT), "DIVERGENCE", "MEDIUM", F.lit("nansen")),
        alert((F.col(VOL) > 500_000) & (F.col("buy_sell_ratio") > 1.5), "VOLUME_SPIKE", "MEDIUM", F.lit("dexscreener"))))
    return merged.withColumn("alert", F.explode(alerts)).select("token", "alert.*")


def watchlist_maintain(joined: DataFrame, as_of: Column) -> DataFrame:
    """Keep or remove each watchlist row, with the reason or the refreshed note, which says when it was updated (``as_of``, a time).

    A row without an added date counts as added on a fixed day.

    ``joined`` is the watchlist left-joined with market data; ``missing`` marks rows without data.
    """
    low, high = fixed.TARGET_MC
    age, mc, ch = F.date_diff(as_of, F.coalesce("added_date", F.lit(fixed.WATCH_ADDED).cast("date"))), F.col(MC), F.col(CHANGE)
    reason = (F.when(age > fixed.WATCH_MAX_AGE_DAYS, F.concat(F.lit("Age "), age.cast("string"), F.lit("d > 10d")))
              .when(F.col("missing"), None)
              .when(mc < low, F.concat(F.lit("MC "), tx.usd_k(mc), F.lit(" < $100K")))
              .when(mc > high, F.concat(F.lit("Graduated MC "), tx.usd_k(mc)))
              .when(ch < fixed.DISTRIBUTION_PCT, F.concat(F.lit("Distribution "), tx.filled("%.1f%%", ch), F.lit(" 24h"))))
    note = F.concat(age.cast("string"), F.lit(" days | "), tx.signed_pct(ch), F.lit(" | MC "), tx.usd_k(mc),
                    F.lit(" | Updated "), F.date_format(as_of, "HH:mm"))
    return (joined.withColumn("reason", reason).withColumn("keep", F.col("reason").isNull())
            .withColumn("note", F.when(F.col("keep") & ~F.col("missing"), note)))


def exit_ladder(price: Column, entry: Column, opened_hours: Column) -> Column:
    """Action for a position from its multiple of the entry price, or the time stop after 48 hours."""
    m = F.try_divide(price, entry)
    return (F.when(m >= 10, "consider_full_exit").when(m >= 5, "take_more_profit").when(m >= 2, "take_initial_out")
            .when((opened_hours >= 48) & (m <= 1), "time_stop").otherwise("hold"))


def message_triage(messages: DataFrame, as_of_seconds: Column, minutes: int = 30) -> DataFrame:
    """Urgent and heads-up messages of the last minutes; heads-up ones once per subject."""
    text = F.concat_ws(" ", "subject", "sender")
    level = (F.when(text.rlike("(?i)" + "|".join(fixed.URGENT_WORDS)), "urgent")
             .when(text.rlike("(?i)" + "|".join(fixed.HEADS_UP_WORDS)), "heads_up"))
    m = messages.filter(as_of_seconds - F.unix_timestamp(F.col("ts").cast("timestamp")) <= minutes * 60)
    m = m.withColumn("level", level).filter("level is not null")
    first = (m.filter("level = 'heads_up'").groupBy("subject")
             .agg(F.min(F.struct("ts", "id", "sender")).alias("f"))
             .select("f.id", "subject", "f.sender", "f.ts", F.lit("heads_up").alias("level")))
    return m.filter("level = 'urgent'").select("id", "subject", "sender", "ts", "level").unionByName(first)


def percent_ranks(long: DataFrame, group: str, x: str) -> DataFrame:
    """Rows (group, x, pr): the percent rank of every distinct value within its group, whatever the values' distribution.

    A rank over a group as a window would be one task. Distinct values are counted and cut into ranges at borders that Spark samples
    from them, so that ranges have about equally many values; the rows below a value are those of the ranges before, of which only the sums are brought
    together, and of the lower values of its own. The cut is written down, since it must be the same wherever it is used.
    """
    values = long.groupBy(group, x).agg(F.count(F.lit(1)).alias("n"))
    cut = written(values.repartitionByRange(group, x).withColumn("_range", F.spark_partition_id()), "rank-values")
    ranges = cut.groupBy(group, "_range").agg(F.sum("n").alias("_sum"))
    earlier = W.partitionBy(group).orderBy("_range").rowsBetween(W.unboundedPreceding, -1)
    ranges = ranges.select(group, "_range", F.coalesce(F.sum("_sum").over(earlier), F.lit(0)).alias("_below"), F.sum("_sum").over(W.partitionBy(group)).alias("_all"))
    lower = W.partitionBy(group, "_range").orderBy(x).rowsBetween(W.unboundedPreceding, -1)
    rank = F.col("_below") + F.coalesce(F.sum("n").over(lower), F.lit(0))
    pr = F.when(F.col("_all") > 1, rank / (F.col("_all") - 1)).otherwise(0.0)
    return cut.join(ranges, [group, "_range"]).select(group, x, pr.alias("pr"))


def launch_momentum(df: DataFrame, parts: list[str], key: str = "token") -> DataFrame:
    """0-100 score: the mean percent rank of the components over the whole table."""
    long = df.select(key, F.explode(F.array(*[F.struct(F.lit(p).alias("part"), (F.col(p).cast("double") + 0.0).alias("x")) for p in parts])).alias("c"))
    long = long.select(key, "c.part", "c.x").filter(F.col("x").isNotNull())
    ranks = percent_ranks(long, "part", "x")
    return long.join(ranks, ["part", "x"]).groupBy(key).agg((F.sum("pr") / len(parts) * 100).alias("score"))
