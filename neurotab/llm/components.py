"""Connected components by alternating star operations, all in Spark."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from neurotab.llm.common import write_scratch

MAX_ROUNDS = 64


def connected_components(edges: DataFrame) -> DataFrame:
    """(node, component) for every node of ``edges`` (a, b); the component is
    its smallest node.

    Large star links each node's larger neighbours to the smallest node next
    to it, small star does so with the smaller ones; the two repeat until only
    stars are left (a number of rounds that grows with the logarithm of the
    longest chain).  A hub with very many neighbours is no single task: the
    minimum per node combines before its shuffle, and the join back is
    between two written tables, so that AQE may split the hub's rows.
    Each round is written to the shared folder, which cuts the lineage."""
    links = edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).filter("u > v").distinct()
    links = write_scratch(links, "cc-links")
    for _ in range(MAX_ROUNDS):
        both = links.unionByName(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
        lowest = write_scratch(both.groupBy("u").agg(F.min("v").alias("low")).select(F.col("u").alias("n"), F.least("u", "low").alias("m")), "cc-low")
        large = both.filter("v > u").join(lowest, F.col("u") == F.col("n")).select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        large = write_scratch(large, "cc-large")
        lowest = write_scratch(large.groupBy("u").agg(F.min("v").alias("m")).withColumnRenamed("u", "n"), "cc-low")
        small = large.join(lowest, F.col("u") == F.col("n")).select(F.explode(F.array(
            F.struct(F.col("v").alias("u"), F.col("m").alias("v")), F.struct(F.col("u"), F.col("m").alias("v")))).alias("e")).select("e.*")
        after = write_scratch(small.filter("u > v").distinct(), "cc-links")
        # all stars: every node has one smaller neighbour, and no centre is itself a leaf
        centres = after.select(F.col("v").alias("u")).distinct()
        stable = after.join(centres, "u", "left_semi").isEmpty() and after.count() == after.select("u").distinct().count()
        links = after
        if stable:
            break
    else:
        raise RuntimeError("components did not settle")
    return links.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(
        links.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
