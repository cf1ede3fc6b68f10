"""Connected components of an edge table, by alternating large-star and small-star rounds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import drop_table, materialise


def connected_components(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """Rows (node, label): the smallest node that each node of edges (a, b) can reach.

    Each round points all larger neighbours of a node to its smallest one (large star), then all
    smaller ones (small star); it needs a minimum by node, combined before the shuffle, and a join.
    Nothing is gathered on the driver but a count and a checksum; each round is written to the
    shared folder. Nodes without an edge have no row.
    """
    now = materialise(edges.filter("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "edges")
    state = None
    for _ in range(rounds):
        both = now.union(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("u", "m"))
        large = both.filter("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        large = large.union(now.join(low, "u").select("u", F.col("m").alias("v"))).filter("u <> v").distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select(F.explode(F.array(F.struct("u", F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("e")).select("e.*")
        new = materialise(small.filter("u <> v").distinct(), "edges")
        drop_table(now)
        now, before = new, state
        state = now.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if state == before:
            break
    else:
        raise RuntimeError(f"components did not settle in {rounds} rounds")
    labels = now.select(F.col("u").alias("node"), F.col("v").alias("label"))
    return labels.union(labels.select(F.col("label").alias("node"), "label")).distinct()
