"""Connected components of a distributed edge list, by alternating large-star and small-star steps.

Every step is joins and aggregations on long columns; edges stay distributed and are written to the
shared scratch folder after each round. A node of very many edges is a skewed join key there, which
adaptive execution splits; the aggregations combine before they shuffle.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docmill.llm import _base


def _least(rows: DataFrame) -> DataFrame:
    """(c, m): each node's least neighbour. Written, so that the join that follows is of plain tables: Spark then splits the
    edges of a hub among tasks, which it does not do for a side that is still being aggregated."""
    return _base.settle(rows.groupBy(F.col("u").alias("c")).agg(F.min("v").alias("m")), "cc-least")


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.select("u", "v").unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = _least(both).withColumn("m", F.least("c", "m"))
    return both.join(least, F.col("u") == F.col("c")).where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))


def _small_star(edges: DataFrame) -> DataFrame:
    joined = edges.join(_least(edges), F.col("u") == F.col("c"))
    return joined.select(F.when(F.col("v") == F.col("m"), F.col("u")).otherwise(F.col("v")).alias("u"), F.col("m").alias("v")).distinct()


def components(edges: DataFrame, label: str = "cc") -> DataFrame:
    """From edges (u, v) of longs with u > v: one row (node, root) for each node of an edge but the
    root itself, where root is the least node of the component. No edges: no rows."""
    state = _base.settle(edges.select("u", "v").distinct(), label)
    seen = None
    while True:
        now = state.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == seen or now[0] == 0:
            return state.select(F.col("u").alias("node"), F.col("v").alias("root"))
        seen = now
        state = _base.settle(_small_star(_base.settle(_large_star(state), label)), label)
