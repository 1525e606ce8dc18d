"""Connected components, with every round written to the shared folder."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marginalia.llm.common import Scratch, saved


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for all nodes of ``edges`` (a, b); equal roots, same component.

    Each round maps every node to the smallest of itself and its neighbours, follows that
    map once more, and keeps the edges between different images. Ids should be hashes: with ids
    in no order along the paths, a fixed share of the nodes vanishes with every round. No node's
    neighbours are ever gathered in one place.
    """
    rounds = []
    edges = saved(edges.select("a", "b").filter("a <> b").distinct(), "edges")
    while not edges.isEmpty():
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        step = saved(both.groupBy("a").agg(F.min("b").alias("b")).select(F.col("a").alias("node"), F.least("a", "b").alias("root")), "step")
        step = saved(step.join(step.select(F.col("node").alias("root"), F.col("root").alias("next")), "root").select("node", F.col("next").alias("root")), "jump")
        rounds.append(step)
        edges = saved(
            edges.join(step.select(F.col("node").alias("a"), F.col("root").alias("ra")), "a")
            .join(step.select(F.col("node").alias("b"), F.col("root").alias("rb")), "b")
            .filter("ra <> rb")
            .select(F.col("ra").alias("a"), F.col("rb").alias("b"))
            .distinct(),
            "edges",
        )
    if not rounds:
        return edges.select(F.col("a").alias("node"), F.col("b").alias("root"))
    labels = rounds[0]
    for step in rounds[1:]:
        labels = labels.join(step.select(F.col("node").alias("root"), F.col("root").alias("next")), "root", "left").select("node", F.coalesce("next", "root").alias("root"))
    return saved(labels, "labels")


#: Edges up to so many are joined with a broadcast of their minima (at most twice as many rows of 16 bytes).
BROADCAST_EDGES = 250_000


def _large_star(edges: DataFrame, hinted) -> DataFrame:
    """Every larger neighbour of a node is tied to the smallest of the node and its neighbours."""
    both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
    return both.filter("b > a").join(hinted(least), "a").select(F.col("b").alias("a"), F.col("m").alias("b"))


def _small_star(edges: DataFrame, hinted) -> DataFrame:
    """The smaller neighbours of a node, and the node, are tied to the smallest of them; ``edges`` go from larger to smaller."""
    least = edges.groupBy("a").agg(F.min("b").alias("m"))
    others = edges.join(hinted(least), "a").filter("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
    return others.unionByName(least.select("a", F.col("m").alias("b"))).distinct()


def _stars(edges: DataFrame) -> bool:
    """Whether every node has one edge to a smaller one, or only edges to larger ones."""
    ends = edges.select(F.col("a").alias("node"), F.lit(1).alias("up"), F.lit(0).alias("down")).unionByName(edges.select(F.col("b").alias("node"), F.lit(0).alias("up"), F.lit(1).alias("down")))
    return ends.groupBy("node").agg(F.sum("up").alias("up"), F.max("down").alias("down")).filter("up > 1 or up = 1 and down = 1").isEmpty()


def star_components(edges: DataFrame, name: str = "labels") -> DataFrame:
    """(node, root) for all nodes of ``edges`` (a, b) with edges to others: root is the smallest node of the component.

    Large-star and small-star steps alternate until one star around each root is left. Minima are taken before rows
    meet, and the joins on a node stand alone, so that Spark can split a node of many neighbours.
    """
    spark = edges.sparkSession
    with Scratch(spark, "stars") as scratch:
        state = scratch.saved(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).filter("a <> b").distinct(), "edges")
        hinted = F.broadcast if state.count() <= BROADCAST_EDGES else lambda df: df
        while not _stars(state):
            state = scratch.saved(_small_star(_large_star(state, hinted), hinted), "stars")
        roots = state.select("b").distinct()
        return saved(state.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(roots.select(F.col("b").alias("node"), F.col("b").alias("root"))), name)
