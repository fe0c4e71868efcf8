"""Cross-domain matching: open gaps of one domain against proposals of another."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from litloom.functions.text import round4
from litloom.operators.scoring import Gaps
from litloom.operators.vectors import similar_pairs

# Fixed values of the matching rule.
CROSS_THRESHOLD = 0.82
HITS_PER_GAP = 20
GAP_POOL = 20
UNRESOLVED_ABOVE = 0.3


def unresolved(gaps: Gaps, pool: int = GAP_POOL) -> DataFrame:
    """The top gaps, then those of them whose rounded deficit is above 0.3."""
    return gaps.ranking(pool).where(F.col("solution_deficit_score") > UNRESOLVED_ABOVE)


def matches(gaps: Gaps, points: DataFrame, target: str, threshold: float = CROSS_THRESHOLD, top_n: int = 10) -> DataFrame:
    """``source_gap, target_solution, similarity_score, source_papers, target_papers, source_domain, target_domain``."""
    open_gaps = unresolved(gaps).withColumn("gap_rank", F.row_number().over(Window.orderBy(F.desc("score"), "seed")))  # at most GAP_POOL rows
    left = open_gaps.join(gaps.vectors.select(F.col("rank").alias("seed"), "vec"), "seed").select(F.col("seed").alias("l"), "vec")
    future = points.where((F.col("collection") == "future_directions") & (F.col("domain") == target) & (F.col("text") != "")).select("text", "paper_ids", F.col("embedding").alias("vec"), F.xxhash64("text", "domain").alias("r"))
    near = similar_pairs(future.select(F.col("r").alias("l"), "vec"), left.select(F.col("l").alias("r"), "vec"), threshold).select(F.col("r").alias("seed"), F.col("l").alias("r"), "sim")
    near = near.join(future.select("r", "text", "paper_ids"), "r")
    best = Window.partitionBy("seed").orderBy(F.desc("sim"), "text")
    near = near.withColumn("pos", F.row_number().over(best)).where(F.col("pos") <= HITS_PER_GAP)
    out = near.join(open_gaps.select("seed", "gap_rank", "gap_description", "supporting_papers"), "seed")
    out = out.withColumn("similarity_score", round4(F.col("sim"))).orderBy(F.desc("similarity_score"), "gap_rank", F.desc("sim"), "text").limit(top_n)
    return out.select(F.col("gap_description").alias("source_gap"), F.col("text").alias("target_solution"), "similarity_score", F.col("supporting_papers").alias("source_papers"), F.col("paper_ids").alias("target_papers"), F.lit(gaps.domain).alias("source_domain"), F.lit(target).alias("target_domain"))
