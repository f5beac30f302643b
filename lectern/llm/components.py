"""Connected components of an edge table, by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lectern.llm.store import drop, table


def _state(edges: DataFrame) -> tuple:
    row = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
    return tuple(row)


def connected_components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """From edges (u, v) of integers: a row (node, root) for each node, root being the smallest in its
    component.  Self-loops and repeated edges are allowed; an empty table gives an empty result.

    Each step aggregates per node (with map-side combine) and joins the minimum back, so a node of
    very many edges is split by adaptive execution; rounds are written to the shared folder.
    """
    # kept as (u, v) with u > v
    rows = edges.count()
    now = table(edges.where("u != v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "edges", rows)
    before = _state(now)
    for _ in range(max_rounds):
        both = now.select("u", "v").unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u != v").distinct()
        large = table(large, "large", 2 * before[0])
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        step = large.join(least, "u").select("v", "m").where("v != m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        last, now = now, table(step.unionByName(least.select("u", F.col("m").alias("v"))).distinct(), "edges", 2 * before[0])
        drop(last, large)
        state = _state(now)
        if state == before:
            break
        before = state
    else:
        raise RuntimeError("components did not settle")
    roots = now.select(F.col("u").alias("node"), F.col("v").alias("root"))
    return roots.unionByName(now.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
