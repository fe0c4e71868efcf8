"""Connected components of an edge table by alternating large-star and small-star contraction.

Both star operations are one aggregate (map-side combined, so a node with millions of
neighbours is pre-aggregated) and one equi-join, which adaptive execution splits when a
node is hot. Rounds end when the edges are stars, which one aggregate tells; nothing but that reaches the driver.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from litloom.llm.common import fresh_dir, remove, written


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("m"))
    return both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b")


def _small_star(edges: DataFrame) -> DataFrame:
    down = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    least = down.groupBy("a").agg(F.min("b").alias("m"))
    moved = down.join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b")
    return moved.unionByName(least.select("a", F.col("m").alias("b")))


def _are_stars(edges: DataFrame) -> bool:
    """Whether every node has one edge down at most and none if another's leads to it: nothing is left to contract."""
    ends = edges.select(F.col("a").alias("node"), F.lit(1).alias("down"), F.lit(0).alias("met")).unionByName(edges.select(F.col("b").alias("node"), F.lit(0).alias("down"), F.lit(1).alias("met")))
    return ends.groupBy("node").agg(F.sum("down").alias("down"), F.max("met").alias("met")).where("down > 1 or (down = 1 and met = 1)").isEmpty()


def components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """``edges(a long, b long)`` -> ``(node, root)`` for every node that has an edge and is not its own root.

    ``root`` is the smallest node of the component. Loops, repeated edges and an empty
    table are fine; null ends are dropped. Raises if not converged in ``max_rounds``.
    """
    spark = edges.sparkSession
    # Written first: a round reads the edges three times.
    now = written(edges.where("a is not null and b is not null and a <> b").select("a", "b"), "edges")
    last_path = None
    for _ in range(max_rounds):
        step = _small_star(_large_star(now).distinct()).distinct()
        path = fresh_dir(spark, "stars")
        step.write.parquet(path)
        now = spark.read.schema(step.schema).parquet(path)
        if last_path:
            remove(spark, last_path)
        last_path = path
        if _are_stars(now):
            return now.select(F.col("a").alias("node"), F.col("b").alias("root"))
    raise RuntimeError(f"components not found in {max_rounds} rounds")
