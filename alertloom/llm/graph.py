"""Connected components of an undirected graph by alternating star contraction.

Every step is a grouped minimum and an equi-join; nothing is collected. A hub
costs one row per edge and its joins have a single row on the other side, so
adaptive skew handling can split it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from alertloom.llm.common import remove_written, written


def _star(edges: DataFrame, both_ways: bool) -> DataFrame:
    """Link every vertex's neighbours to its smallest neighbour.

    ``both_ways``: large star (only larger neighbours move); else small star
    over edges directed to the smaller end.
    """
    if both_ways:
        pairs = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    else:
        pairs = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    least = pairs.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("at"), F.least("a", "m").alias("m"))
    moved = pairs.join(least, F.col("a") == F.col("at"))
    if both_ways:
        moved = moved.where(F.col("b") > F.col("a")).select(F.col("b").alias("a"), F.col("m").alias("b"))
    else:
        moved = moved.select(F.explode(F.array(F.col("a"), F.col("b"))).alias("a"), F.col("m").alias("b"))
    return moved.where(F.col("a") != F.col("b")).distinct()


def connected_components(edges: DataFrame, max_rounds: int = 40) -> DataFrame:
    """Map every vertex of ``edges`` (a, b: long) to the smallest vertex it reaches.

    Returns (vertex, component), without vertices that are their component's
    smallest. Self-loops and repeated edges don't matter; an empty input gives
    an empty result. Raises RuntimeError if it has not converged in
    ``max_rounds`` (the rounds needed grow with the logarithm of the size).
    """
    spark = edges.sparkSession
    now = written(spark, edges.select("a", "b").where("a <> b"), "edges")
    mark = None
    for _ in range(max_rounds):
        then = written(spark, _star(_star(now, True), False), "edges")
        row = then.agg(F.count("*").alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")).alias("h")).first()
        remove_written(now)
        now = then
        if (row.n, row.h) == mark or row.n == 0:
            return now.select(F.col("a").alias("vertex"), F.col("b").alias("component"))
        mark = (row.n, row.h)
    raise RuntimeError("connected components did not converge")
