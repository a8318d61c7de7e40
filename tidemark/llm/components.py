"""Connected components of a graph given as an edge table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import stored


def connected(edges: DataFrame) -> DataFrame:
    """Rows (id, root) for every vertex of ``edges`` (a, b); equal roots mean the same component.

    Each round every vertex takes the smallest id among itself and its neighbours, edges are redrawn between what their
    ends took, and loops and repeats go. Every component shrinks at least by half in a round, so there are logarithmically
    many. The graph is written out after each round, so Spark can split the partition of a vertex with very many edges in
    the joins; nothing is collected.
    An edge table without rows gives none.
    """
    edges = stored(edges.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).filter("a < b").distinct(), "edges")
    maps = []
    while True:
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        near = both.groupBy(F.col("a").alias("id")).agg(F.min("b").alias("to")).select("id", F.least("id", "to").alias("to"))
        taken = stored(near, "taken")
        maps.append(taken)
        left = edges.join(taken.select(F.col("id").alias("a"), F.col("to").alias("ta")), "a")
        met = left.join(taken.select(F.col("id").alias("b"), F.col("to").alias("tb")), "b")
        edges = stored(met.select(F.least("ta", "tb").alias("a"), F.greatest("ta", "tb").alias("b")).filter("a < b").distinct(), "edges")
        if edges.isEmpty():
            break
    roots = maps[0].select("id", F.col("to").alias("root"))
    for taken in maps[1:]:
        roots = roots.join(taken.select(F.col("id").alias("root"), "to"), "root", "left").select("id", F.coalesce("to", "root").alias("root"))
    return stored(roots, "roots") if len(maps) > 1 else roots
