"""Connected components of a link table, by alternating stars over DataFrames.

Each round points every node's larger (then smaller) neighbours at the least id next to it. The number of
rounds grows with the logarithm of the longest chain. Minima are aggregated before the shuffle, and written before they
are joined again: a join of two plain shuffles can be split, so a node that a third of all links touch costs no
task more than its share. Nothing is gathered on the driver.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from biblioflow.llm.common import saved


def _least(links: DataFrame) -> DataFrame:
    return links.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))


def components(links: DataFrame, rounds: int = 60) -> DataFrame:
    """Links (a, b) of long ids, in any order, with repeats and self-links allowed -> (id, component) of every id
    in a link; component is the least id reachable. Null ids are ignored; an empty table gives an empty one."""
    now = saved(
        links.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "links"
    )
    before = None
    for _ in range(rounds):
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = both.join(saved(_least(both), "least"), "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = saved(large.where("u <> v").distinct(), "large")
        least = saved(large.groupBy("u").agg(F.min("v").alias("m")), "least")
        small = large.join(least, "u").select(F.explode(F.array("u", "v")).alias("u"), F.col("m").alias("v"))
        now = saved(small.where("u <> v").distinct(), "links")
        mark = now.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if mark == before:
            break
        before = mark
    else:
        raise RuntimeError(f"components did not settle in {rounds} rounds")
    stars = now.select(F.col("u").alias("id"), F.col("v").alias("component"))
    return stars.unionByName(now.select(F.col("v").alias("id"), F.col("v").alias("component")).distinct())
