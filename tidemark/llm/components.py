"""Connected components of an edge table, by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

ROUNDS = 64


def connected_components(edges: DataFrame, a: str = "a", b: str = "b", scratch: common.Scratch | None = None) -> DataFrame:
    """(node, component) for each node of an edge: component is the least node that can be reached.

    Edges count both ways; loops and repeats do not matter; edges with a null end are left out. No edges: no rows.
    Every step is a grouped minimum (combined before the shuffle) and a join on the node, in which a hub's edges are
    dealt out to many tasks; its result is written to the shared folder, and that of the step before removed. The
    rounds grow with the logarithm of the nodes; if ROUNDS of them were not enough, an error is raised rather than a
    partial answer given.
    """
    own = common.Scratch(edges.sparkSession)
    now = own.write(
        "edges",
        edges.where(F.col(a).isNotNull() & F.col(b).isNotNull() & (F.col(a) != F.col(b)))
        .select(F.greatest(a, b).alias("a"), F.least(a, b).alias("b"))
        .distinct(),
    )

    def star(rows: DataFrame) -> DataFrame:
        """rows (a, b) with m, the least node among a and its neighbours b."""
        least = own.write("least", rows.groupBy("a").agg(F.least("a", F.min("b")).alias("m"), F.count("*").alias("n")))
        return common.spread_join(rows, least.select("a", "m"), "a", least, "b", total=2 * state["n"])

    before = None
    for turn in range(ROUNDS):
        state = now.agg(F.count("*").alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")).alias("h")).first()
        if (state["n"], state["h"]) == before or not state["n"]:
            out = now.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(
                now.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct()
            )
            if scratch is None:
                return out
            out = scratch.write("components", out)
            own.drop(*own.paths)
            return out
        before = (state["n"], state["h"])
        both = now.unionByName(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        large = star(both).where(F.col("b") > F.col("a")).select(F.col("b").alias("a"), F.col("m").alias("b"))
        large = own.write("large", large.where(F.col("a") != F.col("b")).distinct())
        ends = F.array(F.struct("a", F.col("m").alias("b")), F.struct(F.col("b").alias("a"), F.col("m").alias("b")))
        small = star(large).select(F.explode(ends).alias("e")).select("e.a", "e.b")
        last = "edges" if not turn else f"edges{turn}"
        now = own.write(f"edges{turn + 1}", small.where(F.col("a") != F.col("b")).distinct())
        own.drop("large", "least", last)
    raise RuntimeError(f"components did not settle in {ROUNDS} rounds")
