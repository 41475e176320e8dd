"""Connected components of links, by alternating large and small stars.

Every step is a minimum by key and a join; the links live in the shared folder
between steps, never on the driver. The number of rounds grows with the
logarithm of the longest chain.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import empty, written


def _unfinished(links: DataFrame) -> DataFrame:
    """Nodes that are a centre and a leaf, or a leaf of two centres: stars have none."""
    ends = F.explode(F.array(F.struct(F.col("u").alias("node"), F.lit(1).alias("leaf"), F.lit(0).alias("centre")), F.struct(F.col("v").alias("node"), F.lit(0).alias("leaf"), F.lit(1).alias("centre"))))
    counts = links.select(ends.alias("e")).groupBy("e.node").agg(F.sum("e.leaf").alias("leaf"), F.max("e.centre").alias("centre"))
    return counts.where("leaf + centre > 1 and leaf > 0")


#: Up to so many links (16 bytes each) one task does each step, without exchanges; more are dealt by key.
ONE_TASK = 100_000


def leaves(links: DataFrame) -> DataFrame:
    """node and component (the smallest node reachable) for each node with links but the smallest of its component.

    links has columns u and v in either order; null ends, loops and repeated
    links are ignored. No links give no rows.
    """
    links = links.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    few = links.limit(ONE_TASK + 1).count() <= ONE_TASK
    place = (lambda df: df.coalesce(1)) if few else (lambda df: df)
    now = place(written(place(links).distinct(), "links"))
    smallest = F.min("v").over(Window.partitionBy("u"))
    while not empty(_unfinished(now)):
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        both = place(both)
        least = place(written(both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m")), "least"))
        # large star: larger neighbours go to the smallest of the neighbourhood
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        # small star: a node's smaller neighbours and the node itself go to the smallest of them; few are left for each
        small = large.distinct().withColumn("m", smallest)
        small = small.select(F.explode(F.array(F.struct("u", F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("e")).select("e.*")
        now = place(written(small.where("u <> v").distinct(), "links"))
    return now.select(F.col("u").alias("node"), F.col("v").alias("component"))


def components(links: DataFrame) -> DataFrame:
    """node and component for each node that has a link, the smallest included."""
    found = leaves(links)
    return found.unionByName(found.select(F.col("component").alias("node"), "component").distinct())
