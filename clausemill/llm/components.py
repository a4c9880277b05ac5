"""Connected components by alternating stars: each round is two aggregations and two joins over the links."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from clausemill.llm.shared import drop, settle


def _large_star(links: DataFrame) -> DataFrame:
    both = links.union(links.select("v", "u"))
    least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
    return both.filter("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()


def _small_star(links: DataFrame) -> DataFrame:
    least = links.groupBy("u").agg(F.min("v").alias("m"))
    moved = links.join(least, "u").filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.union(least.select("u", F.col("m").alias("v"))).distinct()


def components(links: DataFrame, max_rounds: int = 60) -> DataFrame:
    """links(u, v), any order, loops allowed -> (u, v): each node but the least of a component, and that least node.

    Rounds are written to the shared folder, each in place of the last; they end when a round leaves the links as they were.
    """
    now = settle(links.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).filter("u > v").distinct(), "links")
    sign = lambda df: tuple(df.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(20,0)"))).first())
    before = sign(now)
    for _ in range(max_rounds):
        if not before[0]:
            return now
        last, now = now, settle(_small_star(_large_star(now)), "links")
        after = sign(now)
        drop(last)
        if after == before:
            return now
        before = after
    raise RuntimeError(f"components not settled in {max_rounds} rounds")
