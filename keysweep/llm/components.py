"""Connected components over a table of links."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from keysweep.plans.store import stored


def smallest_reachable(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """``fp, component``: the smallest ``least`` of all nodes that ``fp`` is connected with, itself included.

    ``nodes`` (``fp, least``, distinct ``fp``) and ``edges`` (``a, b``) are stored tables. Alternates large and small stars:
    every node's larger neighbours, then all of its neighbours, are hung below the smallest one, until only
    stars are left, which takes a number of rounds logarithmic in the nodes. Links are shuffled by node; each
    round is written out, so none is computed twice. Stars are built with aggregates joined back, not
    with lists, so a node with any number of neighbours is never held as one row.
    """
    edges = edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct()
    edges = stored(edges)
    while True:
        before = _signature(edges)
        if before[0] == 0:
            break
        edges = stored(_star(edges, large=True))
        edges = stored(_star(edges, large=False))
        if _signature(edges) == before:
            break
    # Now (u, v) names the root v of every u that is not a root itself.
    roots = stored(nodes.join(edges.withColumnRenamed("u", "fp").withColumnRenamed("v", "root"), "fp", "left")
                   .select("fp", "least", F.coalesce("root", "fp").alias("root")))
    least = stored(roots.groupBy("root").agg(F.min("least").alias("component")))
    return stored(roots.join(least, "root").select("fp", "component"))


def _signature(edges: DataFrame) -> tuple:
    row = edges.agg(F.count("*").alias("n"), F.bit_xor(F.xxhash64("u", "v")).alias("x")).first()
    return row["n"], row["x"]


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """Edges are (u, v) with u > v."""
    if large:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = stored(both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m")))
        hung = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    else:
        least = stored(edges.groupBy("u").agg(F.min("v").alias("m")))
        hung = edges.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        hung = hung.unionByName(least.withColumnRenamed("m", "v"))
    return hung.where("u <> v").distinct()
