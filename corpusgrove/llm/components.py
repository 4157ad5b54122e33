"""Connected components of an edge table as joins and grouped minima."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .util import materialize

MAX_ROUNDS = 60


def _unsettled(edges: DataFrame) -> int:
    """Nodes that still hang on several others, or have others hang on them
    while they hang on one themselves. None: every edge points at a root."""
    ends = edges.select(F.col("u").alias("node"), F.lit(1).alias("up"), F.lit(0).alias("down")).unionByName(
        edges.select(F.col("v").alias("node"), F.lit(0).alias("up"), F.lit(1).alias("down")))
    ends = ends.groupBy("node").agg(F.sum("up").alias("up"), F.max("down").alias("down"))
    return ends.where("up > 1 or (up = 1 and down = 1)").count()


def components(edges: DataFrame) -> DataFrame:
    """(node, component): the smallest node that each node of ``edges(u, v)``
    reaches, for every node that has an edge.

    Each round hands every node's larger neighbours, then its smaller ones, to
    the smallest neighbour it has, until all edges point at roots. The number
    of rounds is logarithmic in the number of nodes. A step is one grouped
    minimum (partial sums before the shuffle) and one join whose skew Spark can
    split, so a node with very many neighbours stays a stream of rows. Each
    round is written to the shared folder. Raises if the limit is reached.
    """
    edges = materialize(edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())
    for _ in range(MAX_ROUNDS):
        if not _unsettled(edges):
            break
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = (both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
                 .where("u <> v").distinct())
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = (large.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
                 .unionByName(least.select("u", F.col("m").alias("v")))
                 .where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())
        edges = materialize(small)
    else:
        raise RuntimeError(f"components did not settle in {MAX_ROUNDS} rounds")
    roots = edges.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    return edges.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(roots)
