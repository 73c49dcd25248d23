"""Connected components of a link table, by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from linkgraph.llm.common import Scratch


def _stars(edges: DataFrame, large: bool) -> DataFrame:
    """Hang the neighbours of each node on the smallest one around it: those above it, or those below."""
    if large:
        around = edges.select("u", "v").unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    else:
        around = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    least = around.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
    hung = around.join(least, "u")
    if large:
        moved = hung.where(F.col("v") > F.col("u")).select(F.col("v").alias("u"), F.col("m").alias("v"))
    else:
        moved = hung.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(
            least.select("u", F.col("m").alias("v"))
        )
    return moved.where(F.col("u") != F.col("v")).distinct()


def components(links: DataFrame, scratch: Scratch) -> DataFrame:
    """(node, root): every node of ``links`` (u, v: longs) with the smallest node it is connected to.

    Each round is two shuffles by node and ends in a written table; the number
    of rounds grows with the logarithm of the longest chain.
    """
    edges = scratch.write(links.where(F.col("u") != F.col("v")).select("u", "v").distinct(), "edges")
    mark = F.struct(
        F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(20,0)")).alias("h")
    ).alias("mark")
    seen = None
    while True:
        large = scratch.write(_stars(edges, large=True), "large")
        edges = scratch.write(_stars(large, large=False), "small")
        now = edges.agg(mark).first()["mark"]
        if now == seen:
            break
        seen = now
    roots = edges.select(F.col("u").alias("node"), F.col("v").alias("root"))
    return roots.unionByName(edges.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
