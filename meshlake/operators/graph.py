"""Graph operators over edges(src, dst, label, weight): neighbours and spreading activation, a join for each hop."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from meshlake.session import durable

INHIBITION = "inhibition"


def in_degree(edges: DataFrame) -> DataFrame:
    """(id, in_degree), repeated edges counted."""
    return edges.groupBy(F.col("dst").alias("id")).agg(F.count("*").alias("in_degree"))


def neighbors(edges: DataFrame, start: int, depth: int = 1) -> DataFrame:
    """(id): the nodes that 1 to ``depth`` hops reach, without the start."""
    spark = edges.sparkSession
    steps = edges.select("src", "dst")
    seen = frontier = spark.range(1).select(F.lit(start).cast("long").alias("id"))
    for hop in range(depth):
        reached = steps.join(frontier, F.col("src") == F.col("id")).select(F.col("dst").alias("id")).distinct()
        frontier = reached.join(seen, "id", "left_anti")
        if hop + 1 < depth:
            # The frontier is used twice from here on.
            frontier = durable(frontier)
            if frontier.isEmpty():
                break
        seen = seen.union(frontier)
    return seen.where(F.col("id") != start)


def diffuse(seeds: DataFrame, edges: DataFrame, depth: int, alpha: float = 0.0, inverse_inhibition: bool = False, lateral: int = 0) -> DataFrame:
    """(id, score): energy of ``seeds(id, score)`` spread along edges, ``alpha`` of it lost at each hop.

    Only positive energy goes on to a next hop; an edge labelled ``inhibition`` takes energy away, which counts in the
    totals. With ``inverse_inhibition`` a node gets less the more edges lead to it; ``lateral`` keeps that many of
    the strongest nodes for the next hop (ties to smaller ids), which is a stated bound.
    """
    total = tier = seeds.select("id", F.col("score").cast("double").alias("score"))
    if depth <= 0:
        return total
    keep = max(1.0 - alpha, 0.0)
    steps = edges.select("src", "dst", "label", F.col("weight").cast("double").alias("weight"))
    degree = durable(in_degree(edges)) if inverse_inhibition else None
    for hop in range(depth):
        # A sum over pairs is combined before its shuffle, so many edges into one node are one row per task.
        energy = F.col("score") * keep * F.col("weight") * F.when(F.col("label") == INHIBITION, -1.0).otherwise(1.0)
        spread = tier.where((F.col("score") * keep) > 0).join(steps, F.col("id") == F.col("src")).groupBy("dst").agg(F.sum(energy).alias("score"))
        spread = spread.withColumnRenamed("dst", "id")
        if degree is not None:
            # The factor depends on the target only, so it can follow the sum.
            spread = spread.join(degree, "id", "left").select("id", (F.col("score") / (1 + F.log10(F.greatest(F.coalesce("in_degree", F.lit(0)), F.lit(1)).cast("double")))).alias("score"))
        if hop + 1 < depth:
            spread = durable(spread)
        total = total.union(spread)
        tier = spread.where("score > 0")
        if lateral > 0:
            tier = tier.orderBy(F.desc("score"), "id").limit(lateral)
        if hop + 1 < depth and tier.isEmpty():
            break
    return total.groupBy("id").agg(F.sum("score").alias("score"))


def unlink(edges: DataFrame, src: int, dst: int) -> DataFrame:
    """Without all edges from ``src`` to ``dst``, whatever their labels."""
    return edges.where(~((F.col("src") == src) & (F.col("dst") == dst)))


def delete(nodes: DataFrame, edges: DataFrame, node: int) -> tuple[DataFrame, DataFrame]:
    """Without the node and the edges from and to it."""
    return nodes.where(F.col("id") != node), edges.where((F.col("src") != node) & (F.col("dst") != node))


def migrate(nodes: DataFrame, edges: DataFrame, dim: int) -> tuple[DataFrame, DataFrame]:
    """The same ids and payloads with zero vectors of another dimension, and the edges whose targets exist."""
    zero = F.array_repeat(F.lit(0.0).cast("float"), dim)
    return nodes.withColumn("vector", zero), edges.join(nodes.select(F.col("id").alias("dst")), "dst", "left_semi").select(edges.columns)
