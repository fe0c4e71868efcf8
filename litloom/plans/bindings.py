"""Papers, edges and points made from the driver's tables by plain rules, in Spark and in SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from litloom.operators.graph import point_payloads


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def papers(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = F.col("doc_id")
    return table(spark, sf_dir, "documents").select(
        d.cast("string").alias("arxiv_id"), F.concat(F.lit("Paper "), d).alias("title"), F.when(d % 17 == 0, 0).otherwise(2014 + d % 11).cast("int").alias("year"),
        F.when(d % 2 == 0, "computer_vision").otherwise("medical_imaging").alias("domain"), F.when(d % 3 == 0, "explicit").when(d % 3 == 1, "conclusion").otherwise("inferred").alias("tier"), "doc_id",
    )


def edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``arxiv_id, text, tier, vec_id``: each paper has up to three nodes."""
    n = table(spark, sf_dir, "embeddings").count()
    k = F.explode(F.sequence(F.lit(0), F.lit(2)))
    rows = papers(spark, sf_dir).select("arxiv_id", "tier", "doc_id", k.alias("k"))
    return rows.select("arxiv_id", "tier", ((F.col("doc_id") * (3 + F.col("k")) + 7 * F.col("k")) % n).alias("vec_id")).distinct().withColumn("text", F.concat(F.lit("node "), "vec_id"))


def edges_limitation(e: DataFrame) -> DataFrame:
    return e.where("vec_id % 3 <> 0").select("arxiv_id", "text", "tier")


def edges_future(e: DataFrame) -> DataFrame:
    return e.where("vec_id % 3 = 0").select("arxiv_id", "text")


def points(spark: SparkSession, sf_dir: str) -> DataFrame:
    p, e = papers(spark, sf_dir), edges(spark, sf_dir)
    both = point_payloads(p, edges_limitation(e), "limitations").unionByName(point_payloads(p, edges_future(e), "future_directions"))
    vectors = table(spark, sf_dir, "embeddings").select(F.concat(F.lit("node "), "vec_id").alias("text"), "embedding")
    return both.join(vectors, "text")


#: The same rules for the oracle.
SQL = """
papers AS MATERIALIZED (
  SELECT CAST(doc_id AS VARCHAR) AS arxiv_id, 'Paper ' || doc_id AS title, CAST(CASE WHEN doc_id % 17 = 0 THEN 0 ELSE 2014 + doc_id % 11 END AS INTEGER) AS year,
         CASE WHEN doc_id % 2 = 0 THEN 'computer_vision' ELSE 'medical_imaging' END AS domain,
         CASE doc_id % 3 WHEN 0 THEN 'explicit' WHEN 1 THEN 'conclusion' ELSE 'inferred' END AS tier, doc_id FROM documents),
edges AS MATERIALIZED (
  SELECT DISTINCT arxiv_id, domain, year, tier, vec_id, 'node ' || vec_id AS text
  FROM (SELECT p.*, (doc_id * (3 + k) + 7 * k) % (SELECT count(*) FROM embeddings) AS vec_id FROM papers p, (SELECT unnest([0, 1, 2]) AS k) ks)),
points AS MATERIALIZED (
  SELECT CASE WHEN e.vec_id % 3 = 0 THEN 'future_directions' ELSE 'limitations' END AS collection, text, domain, e.vec_id, string_agg(arxiv_id, ',' ORDER BY arxiv_id) AS paper_ids,
         CAST(coalesce(max(nullif(year, 0)), 0) AS INTEGER) AS year, CAST(any_value(v.embedding) AS DOUBLE[]) AS vec
  FROM edges e JOIN embeddings v ON v.vec_id = e.vec_id GROUP BY text, domain, e.vec_id)
"""
