"""Connected components of a graph given as rows of edges."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strata.session import discard, materialize


def components(edges: DataFrame, a: str = "a", b: str = "b", max_rounds: int = 60) -> DataFrame:
    """(node, root): for each node with an edge, the least node that it reaches;
    roots themselves are left out.

    Alternating large and small stars: each round links every node to the
    least of its neighbours, so the depth of a tree shrinks fast and the rows
    never outgrow the edges.  Minima are combined before each shuffle, a node
    with very many edges is only met by a join that Spark can split, and each
    round is written to the shared folder, so a lost executor costs one round."""
    up = lambda x, y: F.struct(F.greatest(x, y).alias("v"), F.least(x, y).alias("r"))
    e = edges.select(up(F.col(a), F.col(b)).alias("e")).select("e.v", "e.r").where("v <> r").distinct()
    e = materialize(e, "edges")
    for _ in range(max_rounds):
        if _stars(e):
            return e.select(F.col("v").alias("node"), F.col("r").alias("root"))
        last, e = e, materialize(_small_star(_large_star(e)), "edges")
        discard(last)
    raise RuntimeError("components did not settle")


def _stars(e: DataFrame) -> bool:
    """Every node has one edge down, to a node without any: r is the least of its component."""
    rows, nodes = e.agg(F.count("*"), F.count_distinct("v")).first()
    return rows == nodes and e.join(e.select(F.col("r").alias("v")).distinct(), "v", "left_semi").isEmpty()


def _large_star(e: DataFrame) -> DataFrame:
    """Each larger neighbour of a node goes to the least of the node and its neighbours."""
    both = e.union(e.select("r", "v")).toDF("u", "w")
    least = both.groupBy("u").agg(F.min("w").alias("m")).select("u", F.least("u", "m").alias("m"))
    return both.where("w > u").join(least, "u").select(F.col("w").alias("v"), F.col("m").alias("r"))


def _small_star(e: DataFrame) -> DataFrame:
    """A node and its smaller neighbours go to the least of them."""
    least = e.groupBy("v").agg(F.min("r").alias("m"))
    moved = e.join(least, "v").select(F.col("r").alias("v"), F.col("m").alias("r"))
    return moved.union(least.select("v", F.col("m").alias("r"))).where("v <> r").distinct()
