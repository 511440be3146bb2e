"""Connected components of a link table by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pricelens.llm import common


def components(links: DataFrame) -> DataFrame:
    """links(a, b) of long vertices -> (v, root), root the smallest vertex of v's component.

    Vertices without a link do not appear; self links and nulls are ignored. A step gives each vertex the
    minimum of its neighbours (aggregated before the shuffle) and re-links them. The minima are a table of their
    own, so that the join with the links of a hub is one that Spark can split. Every step is written to the
    shared folder, so lineage stays one step long. Ends when a step changes nothing.
    """
    edges = common.staged(links.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "links")
    before = None
    while True:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = common.staged(both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m")), "large-low")
        large = both.where("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        large = common.staged(large, "large-star")
        low = common.staged(large.groupBy("u").agg(F.min("v").alias("m")), "small-low")
        small = large.join(low, "u").select(F.explode(F.array(
            F.struct(F.col("u").alias("u"), F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("e"))
        edges = common.staged(small.select("e.*").where("u <> v").distinct(), "small-star")
        now = edges.agg(F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("s")).first()
        if now == before:
            return edges.select(F.col("u").alias("v"), F.col("v").alias("root")).unionByName(
                edges.select(F.col("v"), F.col("v").alias("root")).distinct())
        before = now
