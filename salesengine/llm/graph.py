"""Connected components of a link table, by alternating large and small stars.

Links stay in DataFrames; each round is written to the shared checkpoint
folder.  Rounds grow with the logarithm of the longest path.  A node with very
many links is a skewed join key, which adaptive execution splits.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from salesengine.session import reliable_checkpoint


def components(links: DataFrame) -> DataFrame:
    """(node, root) for every node of ``links`` (a long, b long) that isn't the least of its component; root is the least.

    Nulls, loops and repeated links don't matter; no links give an empty frame.
    """
    u, v = F.greatest("a", "b"), F.least("a", "b")
    stars = reliable_checkpoint(links.where("a != b").select(u.alias("u"), v.alias("v")).distinct())
    state = None
    while True:
        both = stars.unionByName(stars.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").where("v != m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        stars = reliable_checkpoint(small.unionByName(low.select("u", F.col("m").alias("v"))).distinct())
        now = stars.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")), F.count_distinct("u")).first()
        if now == state and now[0] == now[2]:
            return stars.select(F.col("u").alias("node"), F.col("v").alias("root"))
        state = now
