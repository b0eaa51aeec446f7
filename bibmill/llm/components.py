"""Connected components of a table of links, by alternating stars.

Each round ties every node to the smallest one among its neighbours, first for
larger and then for smaller neighbours, until nothing changes: then each node
has one link, to the smallest of its component. A node's neighbours are never
gathered; minima are added up before the shuffle, written, and joined back. Spark
splits a hot node's rows only where a plain shuffle feeds the join, so no join here
has an aggregate on either side.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch


def components(links: DataFrame, scratch: Scratch) -> DataFrame:
    """links: (a, b) of longs. Returns (node, root) for each node but the roots."""

    def cut(df: DataFrame) -> tuple[DataFrame, tuple]:
        out = scratch.cut(df.where("a <> b").distinct(), "stars")
        return out, tuple(out.agg(F.count("*"), F.expr("bit_xor(xxhash64(a, b))"), F.expr("sum(cast(a as decimal(38, 0)))"), F.expr("sum(cast(b as decimal(38, 0)))")).first())

    now, mark = cut(links.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")))
    while mark[0]:
        both = now.select(F.col("a").alias("u"), F.col("b").alias("v")).union(now.select(F.col("b"), F.col("a")))
        least = scratch.cut(both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m")), "least")
        large = scratch.cut(both.join(least, "u").where("v > u").select(F.col("v").alias("a"), F.col("m").alias("b")).distinct(), "large")
        lower = scratch.cut(large.groupBy("a").agg(F.min("b").alias("m")), "lower")
        small = large.join(lower, "a").select(F.explode(F.array(F.struct(F.col("b").alias("a"), F.col("m").alias("b")), F.struct("a", F.col("m").alias("b")))).alias("x")).select("x.*")
        new, after = cut(small)
        scratch.drop(now, least, large, lower)
        now, same, mark = new, after == mark, after
        if same:
            break
    return now.select(F.col("a").alias("node"), F.col("b").alias("root"))
