"""Connected components of a table of edges, in rounds of star contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from themeloom.llm.common import materialise


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    return both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    down = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    least = down.groupBy("u").agg(F.min("v").alias("m"))
    hung = down.join(least, "u").where("v != m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return hung.unionByName(least.select("u", F.col("m").alias("v"))).where("u != v").distinct()


def components(edges: DataFrame, purpose: str = "components") -> DataFrame:
    """(node, component) for every node of the edges (u, v); the component is its smallest node.

    Nodes may be of any orderable type. Every round writes its edges to the shared folder, so lost executors cost
    one round at most; a hub only meets a combined minimum and a join that can be split. Rounds grow with the
    logarithm of the longest path. Loops and repeated edges do no harm; without edges the result is empty.
    """
    current = materialise(edges.select("u", "v").where("u != v").distinct(), purpose)
    state = None
    while True:
        row = current.agg(F.count("*"), F.expr("bit_xor(xxhash64(u, v))")).first()
        if tuple(row) == state or row[0] == 0:
            break
        state = tuple(row)
        current = materialise(_small_star(_large_star(current)), purpose)
    roots = current.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    return current.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(roots)
