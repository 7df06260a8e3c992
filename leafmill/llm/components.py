"""Connected components of links between 64-bit nodes, by alternating stars.

Large-star and small-star steps (Kiveris et al., 2014) until nothing changes.
A step is a minimum for each node (combined on the map side, so a hub costs one
row for each task) and a join back, which AQE can split as the minima are
settled before; links are settled after each round, so lineage stays short and
lost executors cost one round.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from leafmill.llm.common import release, settle


def _state(links: DataFrame) -> tuple:
    return tuple(links.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())


def components(links: DataFrame) -> DataFrame:
    """links (u, v: long) -> (u, v): every linked node but the least of its component, and that least node."""
    links = settle(links.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())
    before = None
    while (now := _state(links)) != before:
        before = now
        both = links.union(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = settle(both.groupBy("u").agg(F.least(F.col("u"), F.min("v")).alias("m")))
        large = settle(both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct())
        release(links, least)
        least = settle(large.groupBy("u").agg(F.min("v").alias("m")))
        joined = large.join(least, "u")
        small = joined.where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).union(least.select("u", F.col("m").alias("v")))
        links = settle(small.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())
        release(large, least)
    return links
