"""Connected components of a distributed edge table, without gathering any component."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weblore.session import cut


def components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """(node, comp) for every node of edges (a, b): comp is the smallest node of its component.

    Alternating large-star and small-star steps (Kiveris et al., 2014): each round every node
    points its neighbours to the smallest node it sees, so long chains halve. Each round is
    checkpointed; the loop ends when a round changes nothing. Self loops and repeated edges
    are harmless; an empty table gives no rows.
    """
    pairs = cut(edges.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    mark = None
    for _ in range(max_rounds):
        both = pairs.unionByName(pairs.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        large = both.join(least, "a").filter("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).filter("a <> b").distinct()
        down = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(down, "a").select(F.explode(F.array(F.struct("a", F.col("m").alias("b")), F.struct(F.col("b").alias("a"), F.col("m").alias("b")))).alias("e")).select("e.*")
        pairs = cut(small.filter("a <> b").distinct())
        now = pairs.agg(F.count("*").alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")).alias("h")).first()
        if (now.n, now.h) == mark:
            break
        mark = (now.n, now.h)
    else:
        raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    return pairs.select(F.col("a").alias("node"), F.col("b").alias("comp")).unionByName(pairs.select(F.col("b").alias("node"), F.col("b").alias("comp")).distinct())
