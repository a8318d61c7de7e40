"""All pairs of wallets with similar token sets, against brute force."""

import random

import pytest

from tidemark.operators import joins


def trades(rows, spark):
    return spark.createDataFrame(rows, "wallet BIGINT, token STRING")


def brute(rows, percent):
    sets = {}
    for w, t in rows:
        if w is not None and t is not None:
            sets.setdefault(w, set()).add(t)
    reps = {}
    for w in sorted(sets):
        reps.setdefault(frozenset(sets[w]), w)
    some = sorted((w, s) for s, w in reps.items())
    return {(a, b, len(x & y)) for i, (a, x) in enumerate(some) for b, y in some[i + 1:] if x & y and 100 * len(x & y) >= percent * len(x | y)}, \
        {w: reps[frozenset(s)] for w, s in sets.items()}


@pytest.mark.parametrize("percent", [1, 34, 50, 80, 100])
def test_pairs_equal_brute_force(spark, percent):
    rnd = random.Random(percent)
    rows = [(None, "x"), (1, None)]
    for w in range(120):
        base = [f"t{i}" for i in range(w % 9 * 7, w % 9 * 7 + rnd.randrange(1, 14))]
        rows += [(w, t) for t in base if rnd.random() < 0.9] * 2 + [(w, f"t{rnd.randrange(80)}") for _ in range(rnd.choice([0, 1, 3]))] + [(w, "everyone")]
    rows += [(500 + i, t) for i in range(100) for t in ("everyone", "t1")]  # a third of all wallets hold one set
    sets, members = joins.wallet_sets(trades(rows, spark))
    pairs, classes = brute(rows, percent)
    assert {(r.wallet_a, r.wallet_b, r.shared) for r in joins.similar_pairs(sets, percent).collect()} == pairs
    assert {r.wallet: r.rep for r in members.collect()} == classes
    assert sum(r.copies for r in sets.collect()) == len(classes) and len(pairs) > (10 if percent < 100 else 0) - 1


def test_nothing_below_the_similarity_is_moved(spark):
    rows = [(w, f"t{w % 5 + i}") for w in range(60) for i in range(w % 4 + 2)]
    plan = joins.similar_pairs(joins.wallet_sets(trades(rows, spark))[0])._jdf.queryExecution().executedPlan().toString()
    assert plan.index("array_intersect") < plan.index("Join") and "Exchange" not in plan[:plan.index("array_intersect")]
    assert joins.similar_pairs(joins.wallet_sets(trades([], spark))[0]).count() == 0
