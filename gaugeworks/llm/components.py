"""Connected components by alternating stars: joins and grouped minima, a lineage cut for each round."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, held, needed, written


def connected(edges: DataFrame) -> DataFrame:
    """``(node, component)`` of each node of ``edges (a, b)``; a component is named by its smallest node.

    Each round hangs larger neighbours (large star), then smaller ones (small star), on the least
    neighbour; rounds are logarithmic in the number of nodes. Grouped minima are cut before they are
    joined back, so that a node with very many neighbours is a skewed join that Spark can split.
    Few edges are kept in few partitions (``common.HELD``): rounds over one partition shuffle nothing, and
    write one file for each table.
    Loops and repeated edges are allowed; rows with a null end are left out; no edge gives no row.
    """
    spark = edges.sparkSession
    links = held(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    turned = F.struct(F.col("b").alias("a"), F.col("a").alias("b"))
    state = None
    while (now := _state(links)) != state:
        if now[0] == 0:
            return spark.createDataFrame([], "node bigint, component bigint")
        state = now
        parts = needed(now[0])
        both = links.coalesce(parts).select(F.explode(F.array(F.struct("a", "b"), turned)).alias("x")).select("x.a", "x.b")
        least = cut(both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m")), parts)
        large = cut(both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct(), parts)
        least = cut(large.groupBy("a").agg(F.min("b").alias("m")), parts)
        small = large.join(least, "a").where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
        links = small.unionByName(least.withColumnRenamed("m", "b")).coalesce(parts).distinct()
        links = written(links.coalesce(parts), "links").coalesce(parts)
    leaves = links.select(F.col("a").alias("node"), F.col("b").alias("component"))
    roots = links.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct()
    return leaves.unionByName(roots).coalesce(parts)


def _state(links: DataFrame) -> tuple:
    """Equal for equal sets of edges: their number and sums of two hashes."""
    h = [F.sum(F.xxhash64("a", "b", F.lit(k)).cast("decimal(38,0)")) for k in (1, 2)]
    return tuple(links.agg(F.count("*"), *h).first())
