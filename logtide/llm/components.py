"""Connected components of a graph given by its edges, as joins and aggregations."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from logtide.llm.common import stored


def connected_components(edges: DataFrame) -> DataFrame:
    """(node, component): the smallest node that can be reached, for every node of `edges` (a, b), long numbers.

    Alternates the two star steps: every larger neighbour is tied to the smallest neighbour, then every node to its
    smallest one, until the edges are stars. The number of rounds grows with the logarithm of the longest path. A
    neighbourhood is never gathered in one place: minima are aggregated, then joined back. Each round is a written
    table, so lost executors do not undo it. Edges with a null end, loops and repeated edges are fine.
    """
    e = (edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
         .where("a IS NOT NULL AND b IS NOT NULL").distinct())
    e = stored(e.where("u <> v"), "components")
    state = _state(e)
    while state[0]:
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        tied = large.join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        e = stored(tied.unionByName(least.select("u", F.col("m").alias("v"))).distinct(), "components")
        after = _state(e)
        if after == state:
            break
        state = after
    roots = e.select(F.col("v").alias("node")).distinct().select("node", F.col("node").alias("component"))
    return e.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(roots)


def _state(e: DataFrame) -> tuple:
    """Size and checksum of the edges: two numbers that tell whether a round changed anything."""
    return tuple(e.agg(F.count("*"), F.coalesce(F.bit_xor(F.xxhash64("u", "v")), F.lit(0))).first())
