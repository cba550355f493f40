"""Connected components by contraction, on written tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from bitquarry.llm.common import saved


def _jumped(parents: DataFrame) -> DataFrame:
    """``node`` and ``label``, the end of its chain of parents; a chain halves with each round."""
    while True:
        above = parents.select(F.col("node").alias("label"), F.col("label").alias("above"))
        both = saved(parents.join(above, "label").select("node", "label", "above"), "jumps")
        parents = both.select("node", F.col("above").alias("label"))
        if not both.where("label != above").limit(1).count():
            return parents


def components(edges: DataFrame) -> DataFrame:
    """``node`` and ``label`` (the smallest node that it reaches) of every node of ``edges`` (a, b).

    Each node takes its smallest neighbour, if that is smaller than itself, for its parent; the nodes of a tree become one,
    and the edges between trees are the next round's, so that edges are joined as a whole in the first round only. Tables are
    joined as written, so that Spark can split the shuffle partition of a node with very many neighbours.
    """
    left = saved(edges.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).where("a != b").distinct(), "edges")
    rounds = []
    while True:
        ends = left.select(F.col("a").alias("node"), F.col("a").alias("label")).unionByName(left.select(F.col("b").alias("node"), F.col("a").alias("label")))
        labels = _jumped(saved(ends.groupBy("node").agg(F.min("label").alias("label")), "parents"))
        rounds.append(labels)
        of_a, of_b = labels.select(F.col("node").alias("a"), F.col("label").alias("x")), labels.select(F.col("node").alias("b"), F.col("label").alias("y"))
        left = left.join(of_a, "a").where("x != b").join(of_b, "b").where("x != y")
        left = saved(left.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct(), "edges")
        if not left.limit(1).count():
            break
    out = rounds.pop()
    while rounds:  # a tree's label is that of its smallest node
        later = out.select(F.col("node").alias("label"), F.col("label").alias("last"))
        out = saved(rounds.pop().join(later, "label", "left").select("node", F.coalesce("last", "label").alias("label")), "labels")
    return out
