"""Connected components of an edge table by alternating star contractions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marginalia.llm.shared import materialise


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.least(F.col("u"), F.min("v")).alias("m"))
    return both.where(F.col("v") > F.col("u")).join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))


def _small_star(edges: DataFrame) -> DataFrame:
    down = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    least = down.groupBy("u").agg(F.min("v").alias("m"))
    moved = down.join(least, "u").where(F.col("v") != F.col("m")).select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.unionByName(least.select("u", F.col("m").alias("v")))


def components(edges: DataFrame) -> DataFrame:
    """``node, label`` for each node of ``edges(u, v)``; the label is the smallest node of the component.

    Each round writes its edges to the shared folder, and rounds go on until
    the edges stay the same; their number grows with the logarithm of the
    longest path. Loops and repeated edges do no harm. Nodes only in loops
    and an empty table give no rows.
    """
    current = materialise(edges.where(F.col("u") != F.col("v")).select("u", "v").distinct(), "edges")
    mark = None
    while True:
        current = materialise(_small_star(_large_star(current).distinct()).where(F.col("u") != F.col("v")).distinct(), "edges")
        now = tuple(current.agg(F.count(F.lit(1)), F.expr("bit_xor(xxhash64(u, v))"), F.expr("bit_xor(xxhash64(v, u, 7))")).first())
        if now == mark:
            break
        mark = now
    return current.select(F.col("u").alias("node"), F.col("v").alias("label")).unionByName(current.select(F.col("v").alias("node"), F.col("v").alias("label"))).distinct()
