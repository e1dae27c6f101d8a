"""Connected components by alternating large and small stars, all on DataFrames."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pantrylake.llm.common import checkpointed, release


def components(edges: DataFrame) -> DataFrame:
    """node, comp (the least node of its component) for every node of edges(a, b); rounds grow with the log of a path's length.

    A hub's edges are joined to one aggregated row, so that they can be dealt to many tasks.  Loops, repeated edges and either
    order of a pair change nothing; edges with a null node are left out; no edges give no rows.
    """
    pairs = edges.filter("a <> b").select(F.greatest("a", "b").alias("hi"), F.least("a", "b").alias("lo")).distinct()
    pairs, before = checkpointed(pairs), None
    while True:
        both = pairs.select(F.col("hi").alias("u"), F.col("lo").alias("v")).unionByName(pairs.select(F.col("lo").alias("u"), F.col("hi").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.filter("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        root = large.groupBy("u").agg(F.min("v").alias("m"))
        small = (
            large.join(root, "u")
            .select(F.explode(F.array(F.struct(F.col("v").alias("hi"), F.col("m").alias("lo")), F.struct(F.col("u").alias("hi"), F.col("m").alias("lo")))).alias("e"))
            .select("e.hi", "e.lo")
            .filter("hi <> lo")
            .distinct()
        )
        pairs = checkpointed(small)
        now = pairs.agg(F.count("*"), F.sum(F.xxhash64("hi", "lo").cast("decimal(38,0)"))).first()
        if now == before or now[0] == 0:
            break
        before = now
        del both, least, large, root, small
        release(pairs.sparkSession)
    return pairs.select(F.col("hi").alias("node"), F.col("lo").alias("comp")).unionByName(pairs.select(F.col("lo").alias("node"), F.col("lo").alias("comp")).distinct())
