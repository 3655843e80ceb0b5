"""Connected components of a link table, by alternating large and small stars (Kiveris et al., 2014)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import cut, drop


def connected(links: DataFrame) -> DataFrame:
    """(node, root) for every node of links (u, v); root is the smallest node that can be reached.

    Null ends and loops are ignored; repeated links change nothing; no links give no rows. Each round is linear in
    the links, minima are combined before the shuffle, and the links of a round are written to the shared folder.
    The number of rounds grows with the logarithm of the longest path.
    """
    spark = links.sparkSession
    edges = links.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).where("u <> v").distinct()
    edges, path = cut(edges, "links")
    before = None
    while True:
        # large star: every larger neighbour of u moves to the smallest of u and its neighbours
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        # small star: u and its smaller neighbours move to the smallest of them
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select(F.explode(F.array("u", "v")).alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        new, new_path = cut(small, "links")
        drop(spark, path)
        edges, path = new, new_path
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == before:
            return edges.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(edges.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
        before = now
