"""Exact deduplication by stateful streaming with disk-backed keyed state (built-in functions only).

1. A stateless stream reads the documents once and appends locator rows: file, row, id and the
   digest of the normalised text.
2. A stateful stream folds locators into RocksDB state keyed by digest, without expiry: the
   smallest (id, file, row) seen and the number of rows.
3. On hits, digests with several rows, the full normalised texts are compared: the smallest
   and the largest text of a digest must be the same bytes. A digest shared by different texts
   would be regrouped by the texts themselves.

Both streams stop when all available files are read and go on from their checkpoint when
called again with the same ``work_dir``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from litloom.llm.common import fresh_dir, is_dir, path_exists, text_of, written

WHITE = r"[\x20\x09-\x0D]+"
#: Fixed value: the class name of Spark's RocksDB state store.
STATE_STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
#: Settings of the stateful stream. Without fallocate a store takes the disk its keys need, not 4 MB at least.
_STATE_CONF = {"spark.sql.streaming.stateStore.providerClass": STATE_STORE, "spark.sql.streaming.stateStore.rocksdb.allowFAllocate": "false"}


def normalised(text_col: str) -> Column:
    return F.regexp_replace(text_of(text_col), WHITE, " ")


def _order(id_col: str = "id") -> Column:
    """Ids ascending, null last; then place, so exactly one row of a group is least."""
    return F.struct(F.col(id_col).isNull().alias("no_id"), F.col(id_col).alias("id"), F.col("file"), F.col("row"))


def _locators(spark: SparkSession, path: str, id_col: str, text_col: str, work: str, files_per_batch: int) -> DataFrame:
    schema = spark.read.parquet(path).schema
    place = path if is_dir(spark, path) else f"{path[:-1]}[{path[-1]}]"  # a stream takes folders and patterns only
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(place)
    rows = stream.select(F.col(id_col).cast("long").alias("id"), F.col("_metadata.file_path").alias("file"), F.col("_metadata.row_index").alias("row"), F.sha2(normalised(text_col), 256).alias("digest"))
    rows.writeStream.format("parquet").option("path", f"{work}/locators").option("checkpointLocation", f"{work}/locators-checkpoint").trigger(availableNow=True).start().awaitTermination()
    return _read(spark, f"{work}/locators", "id long, file string, row long, digest string")


def _read(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.read.schema(schema).parquet(path) if path_exists(spark, path) else spark.createDataFrame([], schema)


def _state(spark: SparkSession, work: str, files_per_batch: int) -> DataFrame:
    kept = "digest string, least struct<no_id: boolean, id: bigint, file: string, row: bigint>, n bigint"
    if not path_exists(spark, f"{work}/locators"):
        return spark.createDataFrame([], kept)
    stream = spark.readStream.schema("id long, file string, row long, digest string").option("maxFilesPerTrigger", files_per_batch).parquet(f"{work}/locators")
    state = stream.groupBy("digest").agg(F.min(_order()).alias("least"), F.count("*").alias("n"))
    old = {k: spark.conf.get(k, None) for k in _STATE_CONF}
    for k, v in _STATE_CONF.items():
        spark.conf.set(k, v)
    try:
        state.writeStream.outputMode("update").foreachBatch(lambda df, k: df.write.mode("overwrite").parquet(f"{work}/state/batch={k}")).option("checkpointLocation", f"{work}/state-checkpoint").trigger(availableNow=True).start().awaitTermination()
    finally:
        for k, v in old.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)
    # Later batches only lower the least row and raise the count. Written, so that a join with the
    # rows of a frequent digest has a shuffle on both sides and can be split.
    return written(_read(spark, f"{work}/state", kept).groupBy("digest").agg(F.min("least").alias("least"), F.max("n").alias("n")), "state")


def stream_dedup(spark: SparkSession, path: str, id_col: str = "doc_id", text_col: str = "text", work_dir: str | None = None, files_per_batch: int = 10_000) -> DataFrame:
    """One row per row of the Parquet table at ``path``: ``doc_id, keep_id, group_size, kept, text_sha256``.

    Null text counts as empty; texts are equal when their normalised forms are. Of equal texts the
    row with the smallest id stays (null ids last, then by file and row), so repeated rows
    and ids leave exactly one. An empty table gives no rows; other columns are ignored.
    """
    work = work_dir or fresh_dir(spark, "exact")
    rows = _locators(spark, path, id_col, text_col, work, files_per_batch)
    state = _state(spark, work, files_per_batch)
    hits = rows.join(state.where("n > 1").select("digest"), "digest").select(F.col("file").alias("__file"), F.col("row").alias("__row"), F.col("digest").alias("__digest"), F.col("id").alias("__id"))
    docs = spark.read.parquet(path).select(F.col(text_col).alias("__raw"), F.col("_metadata.file_path").alias("__f"), F.col("_metadata.row_index").alias("__r"))
    texts = docs.join(hits, (F.col("__f") == F.col("__file")) & (F.col("__r") == F.col("__row"))).select("__digest", "__id", "__file", "__row", normalised("__raw").alias("__text"))
    differing = texts.groupBy("__digest").agg(F.min("__text").alias("a"), F.max("__text").alias("b")).where("a <> b").select("__digest")
    base = rows.join(state, "digest").select("id", "file", "row", "digest", F.col("least").alias("keep"), "n")
    if not differing.isEmpty():
        odd = texts.join(differing, "__digest").select(F.col("__digest").alias("digest"), F.col("__id").alias("id"), F.col("__file").alias("file"), F.col("__row").alias("row"), F.col("__text").alias("t"))
        group = odd.groupBy("digest", "t").agg(F.min(_order()).alias("keep"), F.count("*").alias("n"))
        apart = odd.join(group, ["digest", "t"]).select("id", "file", "row", "digest", "keep", "n")
        base = base.join(differing, base["digest"] == differing["__digest"], "left_anti").unionByName(apart)
    return base.select(F.col("id").alias("doc_id"), F.col("keep.id").alias("keep_id"), F.col("n").alias("group_size"), ((F.col("file") == F.col("keep.file")) & (F.col("row") == F.col("keep.row"))).alias("kept"), F.col("digest").alias("text_sha256"))
