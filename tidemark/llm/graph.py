"""Connected components by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.shared import discard, written


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, component): the smallest node that each node of `edges` reaches.

    Each step writes its edges to the shared folder, so a lost executor costs one
    step at most, and no step adds edges: large-star links every larger neighbour
    of a node to the least node around it, small-star does so for the smaller ones.
    Only counts and checksums reach the driver. The least neighbour is found by a
    map-side minimum and written before it is joined, so the join's two sides are
    plain exchanges, which Spark splits where a node has very many edges.
    Edges with a null end or from a node to itself are left out; nodes of no other
    edge don't appear.
    """
    one, two = F.col(f"`{a}`"), F.col(f"`{b}`")
    current = written(
        edges.where(one.isNotNull() & two.isNotNull() & (one != two))
        .select(F.greatest(one, two).alias("u"), F.least(one, two).alias("v"))
        .distinct(),
        "edges",
    )
    state = _state(current)
    while state[0]:
        both = current.unionByName(current.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = written(
            both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m")),
            "low",
        )
        large = written(
            both.join(low, "u")
            .where("v > u and v != m")
            .select(F.col("v").alias("u"), F.col("m").alias("v"))
            .distinct(),
            "large",
        )
        least = written(large.groupBy("u").agg(F.min("v").alias("m")), "least")
        rest = (
            large.join(least, "u").where("v != m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        )
        step = written(
            rest.unionByName(least.select("u", F.col("m").alias("v"))).distinct(), "edges"
        )
        for old in (low, large, least, current):
            discard(old)
        current, before = step, state
        state = _state(current)
        if state == before:
            break
    roots = current.select(F.col("v").alias("node")).distinct()
    return current.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(
        roots.select("node", F.col("node").alias("component"))
    )


def _state(edges: DataFrame) -> tuple[int, int | None, int | None]:
    """Count and two checksums of distinct edges."""
    row = edges.agg(
        F.count("*"), F.bit_xor(F.xxhash64("u", "v")), F.bit_xor(F.xxhash64("v", "u"))
    ).first()
    return row[0], row[1], row[2]
