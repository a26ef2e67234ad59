"""Connected components of a large sparse graph by alternating star joins."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from sitegauge.session import stage

MAX_ROUNDS = 60


def connected(edges: DataFrame) -> DataFrame:
    """(``node``, ``label``) for every node of ``edges`` (a, b: bigint); the label is the smallest node it reaches.

    Every round links each node's larger neighbours, then its smaller ones, to the smallest of its neighbourhood, until
    all edges point at a component's smallest node.  Rounds grow with the logarithm of the longest chain.  Each round is
    a written table.  Null ends are left out; self-loops and repeated edges change nothing.
    """
    both = F.explode(F.array(
        F.struct(F.col("a").alias("node"), F.col("b").alias("near")),
        F.struct(F.col("b").alias("node"), F.col("a").alias("near"))))
    edges = stage(edges.where("a IS NOT NULL AND b IS NOT NULL AND a <> b").select(
        F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges")
    before = None
    for _ in range(MAX_ROUNDS):
        sides = edges.select(both.alias("e")).select("e.*")
        # Written first, so that both sides of the join come from a plain shuffle, whose hot partitions Spark splits.
        lowest = stage(sides.groupBy("node").agg(F.least(F.min("near"), F.col("node")).alias("low")), "lowest")
        # Larger neighbours point at the smallest of the neighbourhood.
        large = stage(edges.select(F.col("b").alias("node"), F.col("a").alias("near")).join(lowest, "node").select(
            F.col("near").alias("a"), F.col("low").alias("b")).where("a <> b").distinct(), "larger")
        # Smaller neighbours and the node itself point at the smallest of them.
        least = large.groupBy("a").agg(F.min("b").alias("low"))
        small = large.join(least, "a").select(
            F.explode(F.array(F.struct(F.col("b").alias("a"), F.col("low").alias("b")),
                              F.struct(F.col("a").alias("a"), F.col("low").alias("b")))).alias("e")).select("e.*")
        edges = stage(small.where("a <> b").distinct(), "edges")
        state = edges.agg(F.count(F.lit(1)), F.sum(F.col("b").cast("decimal(38,0)")),
                          F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if state == before:
            break
        before = state
    else:
        raise RuntimeError("the components did not settle")
    return edges.select(F.col("a").alias("node"), F.col("b").alias("label")).unionByName(
        edges.select(F.col("b").alias("node"), F.col("b").alias("label")).distinct())
