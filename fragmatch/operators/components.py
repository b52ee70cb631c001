"""Connected components of a distributed edge list.

Alternating large-star and small-star steps (Kiveris et al., 2014): each step
is one aggregation and one equi-join on the nodes, with map-side partial
minima, and the edge list shrinks to stars around each component's smallest
node. No adjacency list is ever gathered, so that a node with a very large
degree costs no more memory than any other.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fragmatch.plans.scratch import drop, save


def _step(edges: DataFrame, large: bool) -> DataFrame:
    """One star step on rows (a, b) with a > b.

    The minima are saved before they are joined: what is joined then comes
    straight from shuffles, whose skewed parts Spark can split, so that the
    edges of a node with very many of them are dealt to several tasks.
    """
    if large:
        both = edges.unionAll(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = save(both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m")))
        moved = both.where("b > a").join(low, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
    else:
        low = save(edges.groupBy("a").agg(F.min("b").alias("m")))
        moved = edges.join(low, "a").select(F.col("b").alias("x"), "m").where("x <> m").select(F.col("x").alias("a"), F.col("m").alias("b"))
        moved = moved.unionAll(low.select("a", F.col("m").alias("b")))
    out = save(moved.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    drop(low)
    return out


def _stars(edges: DataFrame) -> bool:
    """Whether every node of rows (a, b) hangs on one root, and roots hang on nothing."""
    ends = edges.select(F.col("a").alias("n"), F.lit(1).alias("up"), F.lit(0).alias("root")).unionAll(edges.select("b", F.lit(0), F.lit(1)))
    odd = ends.groupBy("n").agg(F.sum("up").alias("up"), F.max("root").alias("root")).where("up > 1 or up = 1 and root = 1")
    return not odd.head(1)


def components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """(node, component) for every node with an edge; component is its smallest node.

    ``edges`` has two bigint columns, in either order and with repeats or
    loops; rows with nulls are no edges. An empty list gives an empty result.
    The result reads a saved table.
    """
    a, b = edges.columns[:2]
    e = edges.select(F.greatest(a, b).alias("a"), F.least(a, b).alias("b")).where(F.col(a).isNotNull() & F.col(b).isNotNull() & (F.col("a") != F.col("b")))
    now = save(e)
    for _ in range(max_rounds):
        mid = _step(now, True)
        new = _step(mid, False)
        drop(mid, now)
        now = new
        if _stars(now):
            break
    else:
        raise RuntimeError(f"no fixed point within {max_rounds} rounds")
    roots = now.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct()
    return now.select(F.col("a").alias("node"), F.col("b").alias("component")).unionAll(roots)
