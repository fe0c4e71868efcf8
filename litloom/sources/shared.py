"""Storage all executors share: written tables cut lineage and survive lost executors."""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import DataFrame, SparkSession

#: Used only on one machine (master ``local``) where the session names no shared folder, as in tests.
FALLBACK_DIR = "/tmp/checkpoints/litloom"
#: Folders made since the innermost ``scratch`` of this thread began; other threads have their own.
_MADE: ContextVar[list[str] | None] = ContextVar("litloom_made", default=None)


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: ``spark.checkpoint.dir``. Without it a cluster is refused."""
    named = spark.conf.get("spark.checkpoint.dir", "") or spark.sparkContext.getConf().get("spark.checkpoint.dir", "")
    if not named and not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    return (named or FALLBACK_DIR).rstrip("/")


def fresh_dir(spark: SparkSession, label: str) -> str:
    path = f"{shared_dir(spark)}/litloom-{label}-{uuid.uuid4().hex}"
    made = _MADE.get()
    if made is not None:
        made.append(path)
    return path


def written(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` as Parquet in the shared folder and read it back: cuts lineage, survives lost executors."""
    path = fresh_dir(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


@contextmanager
def scratch(spark: SparkSession) -> Iterator[None]:
    """Deletes the intermediate folders this thread makes within it; results must have been written elsewhere by its end."""
    made: list[str] = []
    token = _MADE.set(made)
    try:
        yield
    finally:
        _MADE.reset(token)
        for path in made:
            remove(spark, path)


def _at(spark: SparkSession, path: str):
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p, p.getFileSystem(spark._jsc.hadoopConfiguration())


def remove(spark: SparkSession, path: str) -> None:
    p, fs = _at(spark, path)
    fs.delete(p, True)


def names_in(spark: SparkSession, path: str) -> list[str]:
    """Names of what lies in a folder; none if it is not there."""
    p, fs = _at(spark, path)
    return [s.getPath().getName() for s in fs.listStatus(p)] if fs.exists(p) else []


def put_new(spark: SparkSession, path: str, text: str) -> bool:
    """A small file that must not be there yet appears whole, by renaming; False if it is there."""
    p, fs = _at(spark, path)
    folder, name = path.rsplit("/", 1)
    held, _ = _at(spark, f"{folder}/_{name}-{uuid.uuid4().hex}")
    out = fs.create(held, False)
    try:
        out.write(bytearray(text.encode()))
    finally:
        out.close()
    if not fs.exists(p) and fs.rename(held, p):
        return True
    fs.delete(held, False)
    return False


def text_in(spark: SparkSession, path: str) -> str:
    """A small file as text."""
    p, fs = _at(spark, path)
    source = fs.open(p)
    try:
        return spark._jvm.org.apache.commons.io.IOUtils.toString(source, "UTF-8")
    finally:
        source.close()
