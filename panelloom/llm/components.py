"""Connected components of a link table, without bringing the links or the components to the driver."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..session import Scratch


def connected_components(links: DataFrame, rounds: int = 64) -> DataFrame:
    """(node, component) for every node of ``links`` (a, b); the component is the smallest node it holds.

    Every node points to a parent; in each round parents are hooked below the smallest grandparent among the neighbours and
    paths are halved, so long chains shrink by a factor each round.  Every round is written, and the one before it deleted.  Null
    ends are ignored.
    """
    scratch = Scratch(links.sparkSession, "components")
    ends = links.where("a is not null and b is not null and a <> b").select("a", "b")
    edges = scratch.keep(ends.unionByName(ends.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct())
    parents = edges.groupBy("a").agg(F.least("a", F.min("b")).alias("parent")).select(F.col("a").alias("node"), "parent")
    parents = scratch.keep(parents)
    held = parents
    for _ in range(rounds):
        upper = parents.select(F.col("node").alias("parent"), F.col("parent").alias("grand"))
        seen = scratch.keep(parents.join(upper, "parent").select("node", "parent", "grand"))
        near = edges.join(seen.select(F.col("node").alias("b"), "grand"), "b").groupBy("a").agg(F.min("grand").alias("near")) \
            .select(F.col("a").alias("node"), "near")
        both = seen.join(near, "node")
        offers = both.select(F.explode(F.array(
            F.struct("node", F.least("parent", "grand", "near").alias("parent"), F.col("parent").alias("was")),
            F.struct(F.col("parent").alias("node"), F.col("near").alias("parent"), F.lit(None).cast("long").alias("was")))).alias("o")).select("o.*")
        moved = scratch.keep(offers.groupBy("node").agg(F.min("parent").alias("parent"), F.min("was").alias("was")))
        scratch.drop(seen, held)
        held, parents = moved, moved.select("node", "parent")
        if moved.where("parent <> was").isEmpty():
            scratch.drop(edges)
            return parents.select("node", F.col("parent").alias("component"))
    raise RuntimeError(f"components did not settle in {rounds} rounds")
