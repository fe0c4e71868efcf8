"""From raw documents to shards: quality, near-duplicates, benchmark passages, mixture, shards.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; ``run`` writes it as Parquet in
the shared folder and reads it back as the next stage's documents. All stages but the last
return the columns of ``documents``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from litloom.llm import decontam, hilbert, knn_quality, mixing, simhash
from litloom.llm.common import fresh_dir, quoted, remove, scratch, table, written

#: Column of the classifier's score within a stage.
SCORE = "__pipeline_score"


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the documents the classifier accepts. Null and empty texts score the share of good labels; repeated rows fare alike."""
    return knn_quality.accepted(docs, table(spark, sf_dir, "labels"))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps of each group of near-duplicates the document with the smallest id (five-word shingles, similarity 0.8).

    Null ids come last; null and empty texts are one group; unrelated documents under one id stay each.
    """
    return simhash.one_per_component(docs, simhash.similar_documents(docs, words=5, similarity=0.8))


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the documents in which no benchmark window occurs; null and empty texts stay."""
    return decontam.without_contaminated(docs, table(spark, sf_dir, "benchmark"))


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeats or leaves out documents so that the sources meet their target weights; texts without words go; a null source is one of its own.

    The classifier's score is the quality weight of the draw. A stage returns the columns of documents alone, so it is
    computed anew, by the model of the first stage.
    """
    model = knn_quality.fit(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    # Written: a score may differ in its last bits between runs, and the draw is made from it twice.
    scored = written(knn_quality.score(docs, model, SCORE), "scored")
    return mixing.mixed(scored, quality=F.col(SCORE)).select(*[quoted(c) for c in docs.columns])


def sharding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Places every document in one of eight shards along the Hilbert curve; nulls have places of their own."""
    return hilbert.shard(docs)


STAGES = [
    ("quality", quality),
    ("near_duplicates", near_duplicates),
    ("decontamination", decontamination),
    ("mixture", mixture),
    ("sharding", sharding),
]

#: The classifier and the hashes of the sampling have no SQL form; tests/llm checks the pipeline against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows. What a stage has written besides its result goes when the result is there, and the result when the next one is."""
    docs, last = table(spark, sf_dir, "documents"), None
    for name, stage in STAGES:
        path = fresh_dir(spark, f"stage-{name}")
        with scratch(spark):
            out = stage(spark, docs, sf_dir)
            out.write.parquet(path)
        docs = spark.read.schema(out.schema).parquet(path)
        if last:
            remove(spark, last)
        last = path
    return docs
