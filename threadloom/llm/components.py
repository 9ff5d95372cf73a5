"""Connected components of a distributed edge table by contraction.

Each round ties every node to the smallest of itself and its neighbours, in an
order that is drawn anew, and replaces the nodes of all edges by what they are
tied to. Edges inside a group of tied nodes vanish, and so do their nodes, until
no edge is left. In a drawn order the edges shrink by a share on average
whatever the graph looks like, so chains take a number of rounds like the
logarithm of their length, and stars, groups of copies around one node, two.

Skew: a node with very many edges is one row per task after the partial minimum,
and joins bring it one row, so Spark may split its edges over tasks. Every round
is written to the shared folder, and removed after the next; only counts come to
the driver.
"""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from threadloom.llm.shared import discard, written


def _pairs(edges: DataFrame) -> DataFrame:
    """Edges between different nodes, once each."""
    rows = edges.where(F.col("a") != F.col("b"))
    return rows.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def connected(edges: DataFrame, name: str = "components") -> DataFrame:
    """(node, component): each node of the edge table (a, b) with the smallest node it can reach. Nodes without edges are not returned."""
    edges = written(_pairs(edges), name)
    ties = []
    while not edges.isEmpty():
        drawn = lambda c, salt=len(ties): F.struct(F.xxhash64(F.lit(salt), c).alias("at"), F.col(c).alias("node"))
        both = edges.select("a", drawn("b").alias("other")).unionByName(edges.select(F.col("b").alias("a"), drawn("a").alias("other")))
        least = both.groupBy("a").agg(F.min("other").alias("other"))
        tie = written(least.select(F.col("a").alias("node"), F.least(drawn("a"), "other").getField("node").alias("to")), f"{name}-ties")
        ties.append(tie)
        before = edges
        for side in ("a", "b"):
            edges = edges.join(tie.select(F.col("node").alias(side), F.col("to").alias(f"_{side}")), side)
        edges = written(_pairs(edges.select(F.col("_a").alias("a"), F.col("_b").alias("b"))), name)
        discard(before)
    if not ties:
        return edges.select(F.col("a").alias("node"), F.col("b").alias("component"))
    # what the nodes of each round end up tied to, from the last round on
    ends = ties[-1]
    for tie in reversed(ties[:-1]):
        later = ends.select(F.col("node").alias("to"), F.col("to").alias("_end"))
        former = ends
        ends = written(tie.join(later, "to", "left").select("node", F.coalesce("_end", "to").alias("to")), f"{name}-ends")
        discard(former, tie)
    first = written(ends.groupBy("to").agg(F.min("node").alias("_low")), f"{name}-lowest")
    return ends.join(first, "to").select("node", F.least("_low", "to").alias("component"))
