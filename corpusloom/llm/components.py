"""Connected components of an edge table by alternating large-star and small-star steps.

Each step is a minimum per node (combined before the shuffle) and an equi-join that adaptive execution can split
where a node has very many neighbours; the driver sees only whether stars are all that is left.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusloom.llm.common import Scratch


def _star(both: DataFrame, keep: F.Column) -> DataFrame:
    """Link the kept neighbours of each node to the least of the node and its neighbours."""
    least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    return both.join(least, "u").where(keep).select(F.col("v").alias("u"), F.col("m").alias("v"))


def _stars_only(edges: DataFrame) -> bool:
    """Whether every node has one edge down and none up, or only edges up: the stars' centres are the components then."""
    ends = edges.select(F.col("u").alias("x"), F.lit(1).alias("down")).unionByName(edges.select(F.col("v").alias("x"), F.lit(0).alias("down")))
    odd = ends.groupBy("x").agg(F.sum("down").alias("down"), F.count("*").alias("n")).where("down > 1 or (down = 1 and n > 1)")
    return odd.limit(1).count() == 0


def components(scratch: Scratch, edges: DataFrame, label: str) -> DataFrame:
    """(node, component) for every node of ``edges`` (columns u, v: long); component is its least node."""
    now = scratch.write(edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).where("u <> v").distinct(), f"{label}-0")
    k = 0
    while not _stars_only(now):
        # large star: neighbours above the node; small star: neighbours below it, and the node
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = _star(both, F.col("v") > F.col("u")).where("u <> v").distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select(F.explode(F.array(F.struct("u", F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("e")).select("e.u", "e.v").where("u <> v").distinct()
        after = scratch.write(small, f"{label}-{k + 1}")
        scratch.drop(f"{label}-{k}")
        now, k = after, k + 1
    nodes = now.groupBy("u").agg(F.min("v").alias("component")).withColumnRenamed("u", "node")
    return nodes.unionByName(now.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
