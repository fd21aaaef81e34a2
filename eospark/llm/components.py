"""Connected components of a large graph by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from eospark.functions.storage import staged


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    # Written first, so that both sides of the join are plain exchanges and Spark can split a node with many neighbours.
    least = staged(both.groupBy("a").agg(F.least("a", F.min("b")).alias("m")), "least")
    return both.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    least = staged(edges.groupBy("a").agg(F.min("b").alias("m")), "least")
    moved = edges.join(least, "a").where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
    return moved.unionByName(least.select("a", F.col("m").alias("b"))).distinct()


def component_labels(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """``node, label`` for every node of ``edges`` (``a, b``) but the smallest of its component, which is the label.

    Loops and repeated edges do no harm. Steps repeat until nothing changes; each is written to the shared folder. All
    steps are joins of a node with its one smallest neighbour, so nothing is gathered, and the links of a node with very
    many neighbours are split like any skewed join.
    """
    g, l = F.greatest("a", "b"), F.least("a", "b")
    edges = staged(edges.where("a <> b").select(g.alias("a"), l.alias("b")).distinct(), "edges")
    before = None
    for _ in range(max_rounds):
        state = tuple(edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())
        if state == before or not state[0]:
            break
        before = state
        edges = staged(_small_star(_large_star(edges)), "edges")
    else:
        raise RuntimeError("components did not settle")
    return edges.select(F.col("a").alias("node"), F.col("b").alias("label"))
