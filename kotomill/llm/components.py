"""Connected components of a link table by alternating large-star and small-star contraction.

The links stay distributed: every step is a grouped minimum (partially aggregated, so a hub costs one
row per task) and an equi-join with the written minima (broadcast if small, else Spark may split it when a hub is skewed).
An iteration deals its links out three times if the minima are small: for either minimum and for the distinct links at its end.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Cut, small_side


def components(links: DataFrame, a: str, b: str) -> DataFrame:
    """(node, root) for every node with a link to another one; root is the smallest node reachable.

    Self links and null ends are ignored, repeated links count once, an empty table gives an empty one.
    """
    u, v = F.col("u"), F.col("v")
    pairs = links.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).where(u.isNotNull() & v.isNotNull() & (u != v))
    now = Cut(pairs.distinct(), "links")
    while True:
        both = now.df.unionByName(now.df.select(v.alias("u"), u.alias("v")))
        low = Cut(both.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("d")), "large")
        if low.df.where("m < u AND d > 1").isEmpty():  # each node has one link, to a smaller one, or only larger ones
            low.drop()
            break
        least = small_side(low).select("u", F.least("u", "m").alias("m"))
        wide = Cut(both.join(least, "u").where(v > u).select(v.alias("u"), F.col("m").alias("v")), "large-star")  # a row for each link, equal ones go below
        now.drop()
        low.drop()
        low = Cut(wide.df.groupBy("u").agg(F.min("v").alias("m")), "small")
        near = wide.df.join(small_side(low), "u").where(v != F.col("m")).select(v.alias("u"), F.col("m").alias("v"))
        now = Cut(near.unionByName(low.df.withColumnRenamed("m", "v")).distinct(), "small-star")
        wide.drop()
        low.drop()
    ends = now.df.select(u.alias("node"), v.alias("root"))
    return ends.unionByName(now.df.select(v.alias("node"), v.alias("root")).distinct())
