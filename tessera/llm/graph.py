"""Connected components of an edge list, for classes of similar documents."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import discard, settled

MAX_ROUNDS = 60


def components(edges: DataFrame) -> DataFrame:
    """``node, root`` of every node of ``edges`` (columns ``a, b``, any direction,
    self-loops and repeats allowed); root is the smallest node of the component.

    Alternating large-star and small-star steps until an iteration changes
    nothing; the number of rounds grows with the logarithm of a component's
    diameter.  Each round is written to the shared folder.  Minima are partial
    aggregates and the joins are equi-joins that Spark can split, so a node
    with any number of edges is no single task's work.
    """

    def neighbours(e: DataFrame) -> DataFrame:
        return e.select("a", "b").unionByName(e.select(F.col("b").alias("a"), F.col("a").alias("b")))

    def star(e: DataFrame, large: bool) -> DataFrame:
        """Every larger (large) or smaller-or-equal neighbour of a is linked to a's least neighbour."""
        near = neighbours(e) if large else e
        least = near.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        joined = near.join(least, "a")
        if large:
            out = joined.filter("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        else:
            out = joined.select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(least.select("a", F.col("m").alias("b")))
        return out.filter("a <> b").distinct()

    pairs = settled(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).filter("a <> b").distinct(), "components-0")
    mark = None
    for nth in range(1, MAX_ROUNDS + 1):
        before, pairs = pairs, settled(star(star(pairs, True), False), f"components-{nth}")
        discard(before)
        now = pairs.agg(F.count("*"), F.coalesce(F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")), F.lit(0))).first()
        if now == mark:
            break
        mark = now
    else:
        raise RuntimeError(f"components did not settle in {MAX_ROUNDS} rounds")
    return pairs.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(pairs.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())
