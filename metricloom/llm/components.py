"""Connected components by hooking, pointer jumping and contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from metricloom.session import pin

#: Rows that one part of a round's tables is worth.
PART = 10_000


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for every node of the edges (a, b): root is one node of its component.

    Each round points a node at its least neighbour, follows the pointers to their ends and
    contracts the edges to these ends. Such pointers have no cycles but pairs that point at
    each other, where the lesser node becomes an end. Every node joins another one, so a
    component at least halves in a round: rounds and jumps both grow with the logarithm of
    its size, never with a path's length. Loops, repeats and both directions of an edge are
    welcome; edges with a null end are left out. Nodes without an edge are not returned.

    Counts combine before their shuffles. Nothing but a count per round reaches the driver.
    A round's tables have at most two rows a link, so few links are kept in few files, whatever the
    number of shuffle partitions is.
    """
    links = edges.select("a", "b").where("a <> b").distinct()
    links = pin(links.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct())
    roots = None
    while n := links.count():
        # Ends are at most two a link; ``coalesce`` never adds parts.
        parts = 1 + 2 * n // PART
        both = links.union(links.select("b", "a"))
        least = both.groupBy("a").agg(F.min("b").alias("b"))
        pointers = pin(least.select(F.col("a").alias("node"), F.col("b").alias("root")).coalesce(parts))
        while True:
            ends = pointers.select(F.col("node").alias("root"), F.col("root").alias("end"))
            to = F.when(F.col("end") == F.col("node"), F.least("node", "root")).otherwise(F.col("end"))
            jumped = pin(
                pointers.join(ends, "root").select(
                    "node", to.alias("root"), (to != F.col("root")).alias("moved")
                ).coalesce(parts)
            )
            pointers = jumped.select("node", "root")
            if jumped.where("moved").isEmpty():
                break
        for end in ("a", "b"):
            to = pointers.select(F.col("node").alias(end), F.col("root").alias("to"))
            links = links.join(to, end).drop(end).withColumnRenamed("to", end)
        links = links.where("a <> b")
        links = pin(
            links.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct().coalesce(parts)
        )
        if roots is None:
            roots, most = pointers, parts
        else:
            to = pointers.select(F.col("node").alias("root"), F.col("root").alias("to"))
            joined = roots.join(to, "root", "left").select("node", F.coalesce("to", "root").alias("root"))
            roots = pin(joined.coalesce(most))
    if roots is None:
        return edges.select(F.col("a").alias("node"), F.col("b").alias("root")).limit(0)
    return roots
