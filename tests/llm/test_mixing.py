import pytest
from pyspark.sql import functions as F

from helpers import empty, table
from tidemark.llm import mixing


@pytest.fixture(scope="module")
def skewed(spark):
    """Most words in one source, some sources tiny."""
    words = F.expr("concat_ws(' ', transform(sequence(1, cast(id % 40 + 1 as int)), x -> 'w'))")
    source = F.when(F.col("id") % 3 < 2, "hot").when(F.col("id") % 300 == 2, "tiny").otherwise(F.concat(F.lit("s"), F.col("id") % 7))
    return spark.range(6000).select(F.col("id").alias("doc_id"), words.alias("text"), source.alias("source"))


def test_targets_are_met(skewed):
    got = mixing.mix(skewed).collect()
    assert all(r.taken <= 3 * r.size for r in got) and len(got) == 6000
    taken, target = {}, {}
    for r in got:
        taken[r.source] = taken.get(r.source, 0) + r.taken
        target[r.source] = r.target
    total = sum(r.size for r in got)
    assert abs(sum(target.values()) - total) < 1e-6 * total
    assert all(abs(taken[s] - target[s]) <= 0.01 * target[s] + 2 for s in target)


def test_water_level(spark):
    sized = spark.createDataFrame([("a", 10), ("b", 1000), ("c", 400), (None, 90)], "source STRING, size BIGINT")
    got = {r.source: r.target for r in mixing.shares(sized).collect()}
    left = 1500 - 30
    assert got["a"] == 30 and got[None] == 270  # weights 5, 2, 1, 5: both stop at three times their size
    assert abs(got["b"] - (left - 270) * 2 / 3) < 1e-9 and abs(got["c"] - (left - 270) / 3) < 1e-9


def test_odd_rows_and_reruns(spark):
    df = table(spark)
    a, b = (sorted(map(tuple, mixing.mix(df).collect()), key=str) for _ in range(2))
    assert a == b and len(a) == df.count()
    assert {r[0] for r in a if r[2] == 0} >= {60, 61, 62} and all(r[5] == 0 for r in a if r[2] == 0)
    assert mixing.mix(empty(spark)).count() == 0
    out = mixing.repeat_documents(df)
    assert out.columns == df.columns and mixing.repeat_documents(empty(spark)).count() == 0
