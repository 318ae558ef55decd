"""Connected components of a link table by large and small stars.

Every round replaces links by links to smaller neighbours and stages the result, so the lineage stays short
and the rounds grow with the logarithm of the longest path. Minima are pre-aggregated; the joins that carry
them back are plain equi-joins whose hot side Spark splits.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from recall_engine.llm.common import Scratch


def _largest_and_smallest(links: DataFrame) -> DataFrame:
    """Large star, then small star, over links ``_a < _b``."""
    both = links.select(F.col("_a").alias("_u"), F.col("_b").alias("_v")).unionByName(
        links.select(F.col("_b").alias("_u"), F.col("_a").alias("_v"))
    )
    least = both.groupBy("_u").agg(F.min("_v").alias("_m")).select("_u", F.least("_u", "_m").alias("_m"))
    large = both.filter(F.col("_v") > F.col("_u")).join(least, "_u").select(F.col("_m").alias("_a"), F.col("_v").alias("_b")).distinct()
    # Here every link runs from a node to a smaller one; its smallest neighbour takes over the others.
    small = large.groupBy("_b").agg(F.min("_a").alias("_m"))
    moved = large.join(small, "_b").select(
        F.col("_m").alias("_a"),
        F.when(F.col("_a") == F.col("_m"), F.col("_b")).otherwise(F.col("_a")).alias("_b"),
    )
    return moved.distinct()


def components(links: DataFrame, scratch: Scratch, most_rounds: int = 60) -> DataFrame:
    """``_node`` and ``_root`` (the smallest node reachable) of every node of ``links`` (``_a < _b``)."""
    signature = lambda df: df.agg(F.count(F.lit(1)), F.sum(F.xxhash64("_a", "_b").cast("decimal(38,0)"))).first()
    state = signature(links)
    for _ in range(most_rounds):
        if not state[0]:
            break
        links = scratch.stage(_largest_and_smallest(links), "stars")
        before, state = state, signature(links)
        if state == before:
            break
    else:
        raise RuntimeError("components did not settle")
    return links.select(F.col("_b").alias("_node"), F.col("_a").alias("_root")).unionByName(
        links.select(F.col("_a").alias("_node"), F.col("_a").alias("_root"))
    ).distinct()
