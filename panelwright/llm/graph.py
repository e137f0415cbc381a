"""Connected components of a large sparse graph, by hooking to a neighbour and contracting."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .store import frozen, release


def components(edges: DataFrame) -> DataFrame:
    """``edges(a long, b long)`` -> ``(node long, root long)`` for every node with an edge to another.

    Each round gives every node its neighbour of least priority (a hash salted with the round, so a
    chain has no bad order), follows two hops, and maps the edges through that: the quotient graph
    keeps its connectivity and shrinks by a constant factor. Only joins and combined aggregates are
    used, and each round is a written table, so neither a hub nor a large component meets in a task.
    Null ends and loops are dropped; an empty input gives an empty table. The result is a written table.
    """
    live = frozen(edges.where("a is not null and b is not null and a <> b").selectExpr("least(a, b) a", "greatest(a, b) b").distinct(), "edges")
    names = None
    rounds = 0
    while not live.isEmpty():
        both = live.select("a", "b").union(live.select(F.col("b").alias("a"), F.col("a").alias("b")))
        best = both.groupBy("a").agg(F.min(F.struct(F.xxhash64(F.lit(rounds), "b").alias("p"), "b")).alias("best"))
        own = F.xxhash64(F.lit(rounds), "a")
        hop = frozen(best.select(F.col("a").alias("node"), F.when(F.col("best.p") < own, F.col("best.b")).otherwise(F.col("a")).alias("up")), "hop")
        second = hop.select(F.col("node").alias("up"), F.col("up").alias("root"))
        step = frozen(hop.join(second, "up").select("node", "root"), "step")
        before = names
        if names is None:
            names = step
        else:
            after = step.select(F.col("node").alias("root"), F.col("root").alias("next"))
            names = frozen(names.join(after, "root", "left").select("node", F.coalesce("next", "root").alias("root")), "names")
        left = step.select(F.col("node").alias("a"), F.col("root").alias("ra"))
        right = step.select(F.col("node").alias("b"), F.col("root").alias("rb"))
        mapped = live.join(left, "a").join(right, "b").where("ra <> rb")
        shrunk = frozen(mapped.selectExpr("least(ra, rb) a", "greatest(ra, rb) b").distinct(), "edges")
        release(live, hop, before, None if names is step else step)
        live = shrunk
        rounds += 1
    if names is None:
        names = frozen(live.select(F.col("a").alias("node"), F.col("b").alias("root")), "names")
    release(live)
    return names
