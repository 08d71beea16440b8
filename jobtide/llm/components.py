"""Connected components of a link table, by alternating star contractions."""

from __future__ import annotations

from itertools import count

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from jobtide.llm.workspace import Workspace


def _nearest(arcs: DataFrame) -> DataFrame:
    """Smallest neighbour of every node ``a``; combined before the shuffle."""
    return arcs.groupBy("a").agg(F.min("b").alias("least"))


def _large_star(links: DataFrame) -> DataFrame:
    """Every larger neighbour of a node is linked to the node's smallest neighbour."""
    arcs = links.select("a", "b").union(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = _nearest(arcs).select("a", F.least("a", "least").alias("least"))
    return (
        arcs.join(least, "a")
        .where("b > a")
        .select(F.col("b").alias("a"), F.col("least").alias("b"))
        .distinct()
    )


def _small_star(links: DataFrame) -> DataFrame:
    """A node and its smaller neighbours are linked to the smallest of them."""
    down = links.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    least = _nearest(down)
    moved = down.join(least, "a").where("b <> least").select(F.col("b").alias("a"), "least")
    return moved.union(least).select("a", F.col("least").alias("b")).distinct()


def connected_components(links: DataFrame, space: Workspace) -> DataFrame:
    """``node, root`` of every node that has a link; the root is its smallest member.

    ``links`` has two long columns ``a`` and ``b`` without nulls; loops and repeats do no
    harm, an empty table gives an empty one. Each round is written to the shared
    folder and the one before is removed. Rounds grow with the logarithm of the number of nodes. A node with very many
    links is reduced by partial aggregation, and its rows of the join can be split.
    """
    current = space.save(
        links.where("a <> b")
        .select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
        .distinct(),
        "links-0",
    )
    before = None
    for step in count(1):
        # XOR of row hashes: equal link sets give equal digests, in any order.
        digest = current.agg(
            F.count("*").alias("n"), F.bit_xor(F.xxhash64("a", "b")).alias("h")
        ).first()
        if digest == before:
            return current.select(F.col("a").alias("node"), F.col("b").alias("root"))
        before = digest
        current = space.save(_small_star(_large_star(current)), f"links-{step}")
        space.drop(f"links-{step - 1}")
