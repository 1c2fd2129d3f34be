"""Connected components of links between 64-bit nodes, by alternating large and small stars.

Every round is a few joins and minima over the links, written to the shared folder; the rounds
needed grow with the logarithm of the longest chain. Nothing but two numbers a round reaches the
driver.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import written

#: Nodes with more than one in so many of all rows are hubs (and never those with fewer than LEAST_HUB): at most HUBS of them.
HUBS, LEAST_HUB = 10_000, 200


def _with_least(rows: DataFrame, least: DataFrame, total: int) -> DataFrame:
    """``rows`` (u, v) and for each u its m of ``least`` (u, m, c = rows of u).

    The rows of a hub would all meet in one task, so hubs, of which there can be HUBS at most, are
    broadcast, and the others joined.
    """
    hub = F.col("c") > max(LEAST_HUB, total // HUBS)
    hubs = F.broadcast(least.filter(hub).select("u", "m"))
    others = rows.join(hubs.select("u"), "u", "left_anti").join(least.filter(~hub).select("u", "m"), "u")
    return rows.join(hubs, "u").unionByName(others)


def _large_star(links: DataFrame, total: int) -> DataFrame:
    both = links.unionByName(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"), F.count("*").alias("c"))
    return _with_least(both, least, 2 * total).filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))


def _small_star(links: DataFrame, total: int) -> DataFrame:
    down = links.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    least = down.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("c"))
    others = _with_least(down, least, total).filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return others.unionByName(least.select("u", F.col("m").alias("v")))


def components(links: DataFrame, rounds: int = 100) -> DataFrame:
    """links (u, v) of longs -> (u, root), one row for each linked node; root is its least node.

    Links may repeat, lead both ways, or lead from a node to itself. No links give no rows.
    """
    now = written(links.filter("u <> v").select("u", "v").distinct(), "links")
    seen = None
    for _ in range(rounds):
        state = tuple(now.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
        if state == seen or not state[0]:
            break
        seen = state
        now = written(_small_star(_large_star(now, state[0]), state[0]).filter("u <> v").distinct(), "links")
    else:
        raise RuntimeError(f"links did not settle in {rounds} rounds")
    return now.select("u", F.col("v").alias("root")).unionByName(now.select(F.col("v").alias("u"), F.col("v").alias("root")).distinct())
