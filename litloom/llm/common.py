"""Helpers shared by the corpus operators: tables, shared storage and row keys."""

from __future__ import annotations

from collections.abc import Iterable

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from litloom.sources.shared import fresh_dir, remove, scratch, shared_dir, written  # noqa: F401  used by the operators

#: Stands for a null integer id wherever ids are ordered: null ids come last.
NULL_ID = 2**63 - 1
def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def dealt(width: int) -> list[int]:
    """An int for each partition that ``repartition(width, col)`` deals to it: the inverse of Spark's hash of ints.

    Numbered buckets go to partitions evenly this way; with another number of partitions they are dealt by hash.
    """

    def turn(x: np.ndarray, by: int) -> np.ndarray:
        return (x << np.uint32(by)) | (x >> np.uint32(32 - by))

    ids = np.arange(64 * width, dtype=np.uint32)
    # Murmur3 (x86, 32 bits) of one int with seed 42.
    h = turn(np.uint32(42) ^ turn(ids * np.uint32(0xCC9E2D51), 15) * np.uint32(0x1B873593), 13) * np.uint32(5) + np.uint32(0xE6546B64)
    h ^= np.uint32(4)
    h = (h ^ (h >> np.uint32(16))) * np.uint32(0x85EBCA6B)
    h = (h ^ (h >> np.uint32(13))) * np.uint32(0xC2B2AE35)
    part = (h ^ (h >> np.uint32(16))).view(np.int32) % width
    out = np.zeros(width, np.int64)
    out[part[::-1]] = ids[::-1]
    return out.tolist()


def quoted(name: str) -> Column:
    """The column of exactly this name."""
    return F.col("`" + name.replace("`", "``") + "`")


def renamed(names: Iterable[str]) -> list[Column]:
    """Given columns under private names ``__c0``, ``__c1``, .., so that no working column can clash with them."""
    return [quoted(c).alias(f"__c{i}") for i, c in enumerate(names)]


def given(names: Iterable[str]) -> list[Column]:
    """The columns of ``renamed`` under their own names again."""
    return [F.col(f"__c{i}").alias(c) for i, c in enumerate(names)]


def without(names: Iterable[str], added: Iterable[str]) -> list[str]:
    """``names`` but those that an operator adds itself (Spark's names ignore case)."""
    taken = {a.lower() for a in added}
    return [c for c in names if c.lower() not in taken]


def path_exists(spark: SparkSession, path: str) -> bool:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p)


def is_dir(spark: SparkSession, path: str) -> bool:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()).getFileStatus(p).isDirectory()


def id_key(col: str | Column) -> Column:
    """Integer id with null mapped behind every other id."""
    c = F.col(col) if isinstance(col, str) else col
    return F.coalesce(c.cast("long"), F.lit(NULL_ID))


def text_of(col: str | Column) -> Column:
    """Text with null as the empty string."""
    c = F.col(col) if isinstance(col, str) else col
    return F.coalesce(c.cast("string"), F.lit(""))


def shuffle_width(spark: SparkSession) -> int:
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
