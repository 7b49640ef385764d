"""Connected components as DataFrame operations; no links leave the executors."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import hot_join, materialise


def components(links: DataFrame) -> DataFrame:
    """(node, component) for every node in ``links`` (a, b); component is the smallest reachable node.

    Each round hooks every node to its smallest neighbour, flattens the
    resulting forest by pointer jumping, and contracts the links to those
    between different roots. Rounds and jumps are logarithmic in what is
    left; each is a few joins on small rows, written to the shared folder.
    Hot nodes are pre-aggregated by min before the shuffle, and the joins deal
    the rows of hot roots and nodes to many tasks. Null ends and loops are
    ignored.
    """
    edges = materialise(
        links.where(F.col("a") != F.col("b")).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "links"
    )
    maps = []
    while True:
        both = edges.select(F.col("a").alias("node"), F.col("b").alias("near")).union(edges.select("b", "a"))
        roots = materialise(both.groupBy("node").agg(F.min("near").alias("near")).select("node", F.least("node", "near").alias("root")), "hooks")
        while True:
            # How many nodes hang from each root; every root is a node.
            below = roots.groupBy("root").agg(F.count("*").alias("n")).withColumnRenamed("root", "up_node")
            up = roots.select(F.col("node").alias("up_node"), F.col("root").alias("up_root")).join(below, "up_node")
            jumped = materialise(hot_join(roots, materialise(up, "ups"), "root", "up_node", "node", "n").select("node", "root", "up_root"), "jumps")
            flat = jumped.where("root != up_root").isEmpty()
            roots = jumped.select("node", F.col("up_root").alias("root"))
            if flat:
                break
        maps.append(roots)
        rest = edges
        for end, away in (("a", "b"), ("b", "a")):
            degree = edges.groupBy(end).agg(F.count("*").alias(f"n_{end}"))
            side = degree.join(roots, F.col(end) == F.col("node")).select(F.col("node").alias(f"node_{end}"), F.col("root").alias(f"root_{end}"), f"n_{end}")
            rest = hot_join(rest, materialise(side, "sides"), end, f"node_{end}", away, f"n_{end}")
        rest = rest.where("root_a != root_b")
        edges = materialise(
            rest.select(F.least("root_a", "root_b").alias("a"), F.greatest("root_a", "root_b").alias("b")).distinct(), "contracted"
        )
        if edges.isEmpty():
            break
    found = maps[0].withColumnRenamed("root", "component")
    for later in maps[1:]:
        step = later.select(F.col("node").alias("at"), "root")
        found = found.join(step, F.col("component") == F.col("at"), "left").select("node", F.coalesce("root", "component").alias("component"))
    return found
