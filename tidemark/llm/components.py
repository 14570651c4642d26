"""Connected components of an edge table by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .scratch import Scratch

#: Up to so many edges (of two numbers, 16 MB) a round's least neighbours are sent to every executor.
BROADCAST_ROWS = 1_000_000


def components(edges: DataFrame, scratch: Scratch, name: str = "stars") -> DataFrame:
    """From edges (a, b): (node, root) for every node on an edge; root is the least node it reaches.

    Each round replaces edges by stars around least neighbours, and is written, so that a lost executor
    costs no more than a reread. The number of rounds grows with the logarithm of a component's size.
    """
    spark = edges.sparkSession

    def side(df: DataFrame, rows: int) -> DataFrame:
        return F.broadcast(df) if rows <= BROADCAST_ROWS else df

    # every edge points from the greater to the lesser node
    current = scratch.write(edges.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), f"{name}0")
    rows, before, step = current.count(), None, 0
    if rows and current.agg(F.count_distinct("a")).first()[0] == rows and not current.join(side(current.select(F.col("b").alias("a")), rows), "a", "left_semi").limit(1).count():
        rows_of_stars = current.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct()
        return current.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(rows_of_stars)
    while rows:
        near = current.unionByName(current.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = near.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("m"))
        # large star: greater neighbours move to the least node around
        large = current.select(F.col("b").alias("near"), F.col("a").alias("node")).join(side(least.withColumnRenamed("a", "near"), rows), "near").select(F.col("node").alias("a"), F.col("m").alias("b")).distinct()
        # small star: a node and its lesser neighbours move to the least of them
        down = large.groupBy("a").agg(F.min("b").alias("m"))
        moved = large.join(side(down, rows), "a").filter("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
        step += 1
        following = scratch.write(moved.unionByName(down.select("a", F.col("m").alias("b"))).distinct(), f"{name}{step}")
        scratch.drop(f"{name}{step - 1}")
        state = following.agg(F.count(F.lit(1)), F.sum(F.hash("a", "b").cast("long")), F.count_distinct("a")).first()
        current, rows = following, state[0]
        if state == before or state[0] == state[2] and not current.join(side(current.select(F.col("b").alias("a")), rows), "a", "left_semi").limit(1).count():
            break  # nothing moves any more: every node points at one other, and that at none
        before = state
    if not rows:
        kind = edges.schema["a"].dataType.simpleString()
        return spark.createDataFrame([], f"node {kind}, root {kind}")
    roots = current.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct()
    return current.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(roots)
