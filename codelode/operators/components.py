"""Connected components of an undirected edge list with long ids."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from codelode.session import cut_lineage


def connected_components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """``edges(a long, b long)`` -> ``(node, component)``; the component is its smallest node.

    Alternates two steps until nothing changes: every node sends its larger
    neighbours to its smallest one, then its smaller ones. A round moves each
    edge once and takes minima with map-side combine, so a hot node costs one
    skewed join side, which AQE splits. Rounds grow with the log of the diameter.
    Self loops are allowed; nulls are dropped.
    """
    e = cut_lineage(edges.where("a is not null and b is not null").select("a", "b").distinct())
    nodes = e.select(F.col("a").alias("node")).union(e.select(F.col("b").alias("node"))).distinct()
    e = e.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    before = None
    for _ in range(max_rounds):
        both = e.union(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        big = both.where("b > a").join(low, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        big = big.union(low.where("m < a").select("a", F.col("m").alias("b"))).where("a <> b").distinct()
        small_low = big.groupBy("a").agg(F.min("b").alias("m"))
        small = big.join(small_low, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        e = cut_lineage(small.union(small_low.select("a", F.col("m").alias("b"))).where("a <> b").distinct())
        now = tuple(e.agg(F.count("*"), F.sum(F.col("a").cast("decimal(38,0)")), F.sum(F.col("b").cast("decimal(38,0)"))).first())
        if now == before:
            break
        before = now
    else:
        raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    return nodes.join(e.groupBy("a").agg(F.min("b").alias("m")), F.col("node") == F.col("a"), "left").select("node", F.coalesce("m", "node").alias("component"))
