"""Connected components by alternating large-star and small-star steps on DataFrames."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chronoweave.llm.common import cut, sized


def _signature(edges: DataFrame) -> tuple:
    h = F.xxhash64("a", "b")
    row = edges.agg(F.count(F.lit(1)).alias("n"), F.bit_xor(h).alias("x"), F.sum(F.shiftright(h, 20)).alias("s")).first()
    return tuple(row)


def _large_star(edges: DataFrame, n: int) -> DataFrame:
    both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
    return sized(both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b"), n).distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    """Edges come with a > b."""
    least = edges.groupBy("a").agg(F.min("b").alias("m"))
    moved = edges.join(least, "a").where("b > m").select(F.col("b").alias("a"), F.col("m").alias("b"))
    return least.select("a", F.col("m").alias("b")).unionByName(moved).distinct()


def components(edges: DataFrame, a: str = "a", b: str = "b", most_rounds: int = 60, rows: int | None = None) -> DataFrame:
    """``(node, component)`` of every node that has a link; component is the smallest node reachable.

    Links are undirected, about ``rows`` if that is known; repeated links and loops change nothing and null ends are ignored.  Every round is one
    checkpoint, so a lost executor costs one round at most; its tasks are as many as its links need.  The number of rounds grows with the logarithm of the longest
    shortest path.
    """
    now = edges.select(F.greatest(a, b).alias("a"), F.least(a, b).alias("b")).where("a <> b").distinct()
    now = cut(now if rows is None else sized(now, rows))
    before = _signature(now)
    now = sized(now, before[0])
    for _ in range(most_rounds):
        if not before[0]:
            break
        now = cut(sized(_small_star(sized(_large_star(now, before[0]), before[0])), before[0]))
        after = _signature(now)
        if after == before:
            break
        before = after
    else:
        raise RuntimeError(f"components did not settle in {most_rounds} rounds")
    roots = now.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct()
    return now.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(roots)
