"""Connected components of a table of links, by alternating large-star and small-star steps.

Each step replaces links by links to the smallest neighbour and keeps what is connected; when nothing
changes, every node hangs on the smallest node of its component. Steps only join and aggregate, each
round is a table in the shared folder, and no component is ever gathered in one place.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .storage import saved

ROUNDS = 60


def _large_star(links: DataFrame) -> DataFrame:
    both = links.select("a", "b").union(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = saved(both.groupBy("a").agg(F.min("b").alias("least")).select("a", F.least("a", "least").alias("least")), "star-least")
    return both.filter("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("least").alias("b")).filter("a <> b").distinct()


def _small_star(links: DataFrame) -> DataFrame:
    down = links.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    least = saved(down.groupBy("a").agg(F.min("b").alias("least")), "star-least")
    moved = down.join(least, "a").select(F.col("b").alias("a"), F.col("least").alias("b")).filter("a <> b")
    return moved.union(least.select("a", F.col("least").alias("b"))).distinct()


def _mark(links: DataFrame) -> tuple:
    return links.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()


def components(links: DataFrame) -> DataFrame:
    """node, root of every node that has a link in rows of a, b; root is the smallest node it can reach.

    Links to nothing (null) or to itself are ignored; repeated links and either direction are alike.
    """
    now = saved(links.select("a", "b").filter("a <> b").distinct(), "links")
    mark = _mark(now)
    if not mark[0]:
        return now.select(F.col("a").alias("node"), F.col("b").alias("root"))
    for _ in range(ROUNDS):
        now = saved(_small_star(saved(_large_star(now), "links")), "links")
        before, mark = mark, _mark(now)
        if mark == before:
            return now.select(F.col("a").alias("node"), F.col("b").alias("root")).union(
                now.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct()
            )
    raise RuntimeError(f"components did not settle in {ROUNDS} rounds")
