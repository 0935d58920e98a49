"""Connected components of a link table that may be of any size.

Each round every node hooks onto its smallest neighbour, the resulting trees are
flattened by pointer jumping, and links are rewritten to tree roots.  The number of
nodes with links falls at least by half a round.  Nothing but row counts reaches the driver.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from .staging import Staging


def components(links: DataFrame, staging: Staging, name: str = "cc") -> DataFrame:
    """(a, b) -> (node, component): each linked node's smallest reachable node."""
    both = links.select("a", "b").unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b"))).where("a <> b").distinct()
    edges = staging.write(both, f"{name}-edges-0")
    labels = staging.write(edges.select(F.col("a").alias("node"), F.col("a").alias("component")).distinct(), f"{name}-labels-0")
    turn = 0
    while not edges.isEmpty():
        turn += 1
        roots = _flat(edges.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("root")).withColumnRenamed("a", "at"), staging, f"{name}-{turn}")
        labels = staging.write(labels.join(roots, F.col("component") == F.col("at"), "left").select("node", F.coalesce("root", "component").alias("component")), f"{name}-labels-{turn}")
        moved = edges.join(roots, F.col("a") == F.col("at")).select(F.col("root").alias("a"), "b").join(roots, F.col("b") == F.col("at")).select("a", F.col("root").alias("b"))
        edges = staging.write(moved.where("a <> b").distinct(), f"{name}-edges-{turn}")
        staging.drop(f"{name}-edges-{turn - 1}", f"{name}-labels-{turn - 1}")
    return labels


def _flat(parents: DataFrame, staging: Staging, name: str) -> DataFrame:
    """(at, root) with every root followed to the end of its chain."""
    jump = 0
    parents = staging.write(parents, f"{name}-jump-0")
    while True:
        up = parents.select(F.col("at").alias("via"), F.col("root").alias("next"))
        step = parents.join(up, F.col("root") == F.col("via"), "left").select("at", F.coalesce("next", "root").alias("next"), "root")
        jump += 1
        step = staging.write(step, f"{name}-jump-{jump}")
        staging.drop(f"{name}-jump-{jump - 1}")
        parents = step.select("at", F.col("next").alias("root"))
        if step.where(F.col("next") != F.col("root")).isEmpty():
            return parents
