"""Relational combinations of listings, pairs, watchlists, signals and wallets.

No join here carries a broadcast hint: Spark broadcasts a side whose size it has measured to be below its
threshold, and splits skewed partitions of the others at run time.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark import fixed
from tidemark.functions import text as tx
from tidemark.functions.values import nz
from tidemark.operators import sliced


def best_pair(pairs: DataFrame, keys: list[str], liquidity: str = "liquidity", pos: str = "pos") -> DataFrame:
    """Most liquid pair per token (null counts as zero, the earlier one wins a tie)."""
    rest = [c for c in pairs.columns if c not in keys]
    rank = F.struct(nz(liquidity).alias("l"), (-F.col(pos)).alias("p"))
    return (pairs.groupBy(*keys).agg(F.max_by(F.struct(*rest), rank).alias("best")).select(*keys, "best.*"))


def boosted_best_pair(boosted: DataFrame, pairs: DataFrame, keys: list[str],
                      min_liquidity: float = fixed.TARGET_MIN_LIQUIDITY) -> DataFrame:
    """Boosted tokens with their best pair. Pairs of other tokens are dropped before the aggregate."""
    wanted = pairs.join(boosted.select(*keys).distinct(), keys, "left_semi")
    return boosted.join(best_pair(wanted, keys).filter(nz("liquidity") >= min_liquidity), keys)


def enrich(tokens: DataFrame, pairs: DataFrame, key: str = "token") -> DataFrame:
    """Best pair facts per token; nulls when the token has no pair."""
    return tokens.join(best_pair(pairs, [key]), key, "left")


def not_listed(found: DataFrame, listed: DataFrame, key: str = "address") -> DataFrame:
    """Rows whose key is present and not listed yet."""
    return found.filter(nz_text(key) != "").join(listed.select(key), key, "left_anti")


def nz_text(c: str) -> Column:
    return F.coalesce(F.col(c), F.lit(""))


def scanner_entries(found: DataFrame, as_of: Column) -> DataFrame:
    """Watchlist rows for scanner matches: chain, day added and a note with the change and the market cap."""
    note = F.concat(F.lit(f"{fixed.SCANNER_AGE_NOTE} | "), tx.signed_pct(F.col("change_24h")), F.lit(" | MC "), tx.usd_k(F.col("market_cap")), F.lit(f" | {fixed.SCANNER_SOURCE_NOTE}"))
    return found.select("symbol", "name", "address", F.lit(fixed.SCANNER_CHAIN).alias("chain"), F.to_date(as_of).alias("added_date"), note.alias("notes"))


def upsert_new(listed: DataFrame, found: DataFrame, key: str = "address") -> DataFrame:
    """The list plus the rows not on it."""
    return listed.unionByName(not_listed(found, listed, key))


def merge_signals(tokens: DataFrame, signals: dict[str, DataFrame], key: str = "token") -> DataFrame:
    """Left-join one column per source onto the tokens; every source holds at most one row per key."""
    return reduce(lambda acc, s: acc.join(s, key, "left"), signals.values(), tokens)


def as_of(left: DataFrame, right: DataFrame, keys: list[str], ts: str, value: str, out: str,
          seconds: int, right_order: list[str]) -> DataFrame:
    """For every left row the latest right ``value`` at or before its time.

    Both sides are stacked and the last known value carried forward, per key and time slice, so neither a
    hot key nor a dense time range ends up in one task. ``right_order`` breaks ties between equal times.
    """
    cols = left.columns
    stacked = (left.select(*cols, F.lit(1).alias("_side"), F.lit(None).cast("double").alias("_val"),
                           *[F.lit(None).cast(right.schema[c].dataType).alias(f"_o_{c}") for c in right_order])
               .unionByName(right.select(*keys, ts, F.lit(0).alias("_side"), F.col(value).cast("double").alias("_val"),
                                         *[F.col(c).alias(f"_o_{c}") for c in right_order]), allowMissingColumns=True))
    cut = sliced.slice_time(stacked, ts, seconds)
    order = [ts, "_side", *[f"_o_{c}" for c in right_order]]
    known = sliced.last_known(cut, keys, order, F.col("_val"), out)
    return known.filter(F.col("_side") == 1).select(*cols, out)


def whale_positions(wallets: DataFrame, positions: DataFrame, min_score: float = 0.7,
                    min_size: float = fixed.COPY_MIN_SIZE) -> DataFrame:
    return wallets.filter(F.col("score") > min_score).join(positions.filter(F.col("size") > min_size), "wallet")


def cobuyers(trades: DataFrame, tracked: DataFrame, excluded: DataFrame, min_common: int = fixed.COMMON_TOKENS) -> DataFrame:
    """Wallets that traded at least ``min_common`` of the tokens any tracked wallet traded.

    Only distinct (wallet, token) rows meet the distinct token set, so nothing is paired within a token.
    """
    held = trades.select("wallet", "token").distinct()
    theirs = held.join(tracked, "wallet", "left_semi").select("token").distinct()
    return (held.join(theirs, "token", "left_semi")
            .join(tracked, "wallet", "left_anti").join(excluded, "wallet", "left_anti")
            .groupBy("wallet").agg(F.count(F.lit(1)).alias("common_tokens"))
            .filter(F.col("common_tokens") >= min_common))


def similar_wallets(trades: DataFrame, wallet) -> DataFrame:
    """Jaccard similarity of every wallet's token set with that of one wallet.

    One pass over the distinct (wallet, token) rows: each wallet's set size and its share of the wanted set.
    """
    held = trades.select("wallet", "token").distinct()
    wanted = held.filter(F.col("wallet") == wallet).select("token", F.lit(1).alias("hit"))
    size = held.filter(F.col("wallet") == wallet).agg(F.count(F.lit(1)).alias("own"))
    per = (held.filter(F.col("wallet") != wallet).join(wanted, "token", "left").groupBy("wallet")
           .agg(F.count(F.lit(1)).alias("n"), F.count("hit").alias("shared")).filter("shared > 0"))
    return (per.join(F.broadcast(size))  # one row
            .withColumn("jaccard", F.col("shared") / (F.col("n") + F.col("own") - F.col("shared")))
            .select("wallet", "shared", "jaccard"))


def wallet_sets(trades: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Distinct token sets (rep, copies, n, tokens) with the least wallet that holds each, and (wallet, rep) for every wallet.

    ``tokens`` is in one order for all sets: tokens that few wallets hold first, then by token. A set has each token once, so a wallet with most of
    the trades is as long as the list of tokens.
    """
    held = trades.select("wallet", "token").filter("wallet IS NOT NULL AND token IS NOT NULL").distinct()
    common = held.groupBy("token").agg(F.count(F.lit(1)).alias("holders"))
    ordered = F.transform(F.array_sort(F.collect_list(F.struct("holders", "token"))), lambda x: x["token"])
    sets = held.join(common, "token").groupBy("wallet").agg(ordered.alias("tokens"))
    classes = sets.groupBy("tokens").agg(F.min("wallet").alias("rep"), F.count(F.lit(1)).alias("copies"))
    members = sets.join(classes.select("tokens", "rep"), "tokens").select("wallet", "rep")
    return classes.select("rep", "copies", F.size("tokens").alias("n"), "tokens"), members


def similar_pairs(sets: DataFrame, percent: int = 50) -> DataFrame:
    """All pairs of ``sets`` (see ``wallet_sets``) whose Jaccard similarity is at least ``percent`` in a hundred: wallet_a < wallet_b, shared, jaccard.

    Exact. Two sets that similar share a token among their rarest ones: of n tokens the first n - ceil(n * percent / 100) + 1, so sets meet
    by those alone. Where they meet, they are kept only if their sizes allow the similarity, if enough tokens are left
    behind the place where they meet, and if it is the first token they share; then the whole sets are compared, in the same task. So
    a pair comes about once, and none below ``percent`` is moved. Wallets of equal sets are one set: list them by membership.
    """
    need = F.floor((F.col("n") * percent + 99) / 100)
    prefix = F.slice("tokens", 1, (F.col("n") - need + 1).cast("int"))
    met = sets.select("rep", "n", "tokens", F.posexplode(prefix).alias("at", "token"))
    a, b = (met.select("token", *[F.col(c).alias(f"{c}_{s}") for c in ("rep", "n", "tokens", "at")]) for s in "ab")
    least = F.ceil((F.col("n_a") + F.col("n_b")) * percent / F.lit(100 + percent))  # tokens that a pair so similar shares
    sizes = (F.col("n_a") * 100 >= F.col("n_b") * percent) & (F.col("n_b") * 100 >= F.col("n_a") * percent)
    room = F.least(F.col("n_a") - F.col("at_a"), F.col("n_b") - F.col("at_b")) >= least
    both = a.join(b, "token").filter((F.col("rep_a") < F.col("rep_b")) & sizes & room)
    shared = both.withColumn("both", F.array_intersect("tokens_a", "tokens_b")).filter(F.get("both", F.lit(0)) == F.col("token"))
    out = shared.withColumn("shared", F.size("both").cast("bigint")).withColumn("whole", F.col("n_a") + F.col("n_b") - F.col("shared"))
    return (out.filter(F.col("shared") * 100 >= F.col("whole") * percent)
            .select(F.col("rep_a").alias("wallet_a"), F.col("rep_b").alias("wallet_b"), "shared", (F.col("shared") / F.col("whole")).alias("jaccard")))
