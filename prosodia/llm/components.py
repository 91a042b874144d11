"""Connected components of an edge table by alternating star contractions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from prosodia.llm.shared import discard, materialise, spread_join


def _mark(edges: DataFrame) -> tuple:
    """A size and an order-free digest: equal in two rounds running when nothing moves any more."""
    return tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())


def connected_components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, root) for every node that has an edge; root is the smallest node of its component.

    Large-star hangs the larger neighbours of each node on its smallest one, small-star the smaller neighbours, until
    the edges are stars. Each round aggregates by node before it joins, and a hub's neighbour is sent to its edges instead
    of the edges to one task; rounds are logarithmic in the longest path. Nulls have no edges.
    """
    edges = materialise(
        edges.where(F.col(a) != F.col(b))
        .select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v"))
        .distinct()
    )
    before = _mark(edges)
    while before[0]:
        both = edges.unionAll(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("n")).withColumn("m", F.least("u", "m"))
        large = spread_join(both, least, ["u"], "n", 2 * before[0]).where("v > u")
        large = materialise(large.select(F.col("v").alias("u"), F.col("m").alias("v")).distinct())
        least = large.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("n"))
        hung = spread_join(large, least, ["u"], "n", 2 * before[0])
        small = materialise(
            hung.select(F.col("v").alias("u"), F.col("m").alias("v"))
            .unionAll(least.select("u", F.col("m").alias("v")))
            .where("u != v")
            .distinct()
        )
        discard(edges, large)
        edges = small
        after = _mark(edges)
        if after == before:
            break
        before = after
    roots = edges.groupBy("u").agg(F.min("v").alias("root")).withColumnRenamed("u", "node")
    return roots.unionAll(roots.select(F.col("root").alias("node"), "root").distinct())
