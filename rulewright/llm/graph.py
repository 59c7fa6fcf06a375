"""Connected components by alternating large and small stars.

Each step replaces links by links to the smallest neighbour, until every node is linked to the smallest node of its
component. Minima are aggregated before they are shuffled and written, so the joins that follow have two plain
shuffles, whose hot partitions (the centre of a large component) AQE can split.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import saved


def components(links: DataFrame, max_rounds: int = 40) -> DataFrame:
    """(node, root) of every node in links (columns u and v, longs); root is the smallest node of its component."""
    links = saved(links.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).where("u <> v").distinct(), "links")
    before = None
    for _ in range(max_rounds):
        now = links.agg(F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("h")).first()
        if now == before or not now["n"]:
            return links.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(links.select(F.col("v").alias("node"), F.col("v").alias("root"))).distinct()
        before = now
        both = links.unionByName(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = saved(both.groupBy("u").agg(F.least("u", F.min("v")).alias("m")), "least")
        large = both.join(least.hint("merge"), "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        links = saved(large, "large")
        # after a large star, u > v holds and each u has few links: its smallest becomes the others' neighbour
        least = saved(links.groupBy("u").agg(F.min("v").alias("m")), "least")
        small = links.join(least.hint("merge"), "u").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.withColumnRenamed("m", "v")).where("u <> v").distinct()
        links = saved(small.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")), "small")
    raise RuntimeError("components did not settle; raise max_rounds")
