"""Metadata, search and page sources. Offline they read files; ``fetch_with_retry`` serves live ones."""

from __future__ import annotations

import time
from collections.abc import Callable

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from litloom.functions.text import MAX_PAGES

METADATA = "title string, year int, abstract string, tldr struct<text string>, externalIds struct<ArXiv string>"


class RateLimited(Exception):
    """The source asks to slow down (HTTP 429)."""


def fetch_with_retry(fetch: Callable[[], bytes], tries: int = 3, sleep: Callable[[float], None] = time.sleep, on: tuple[type[Exception], ...] = (RateLimited,)) -> bytes:
    """Waits 1 s, then 2 s when rate limited (or at the errors ``on``); other errors rise at once."""
    for attempt in range(tries):
        try:
            return fetch()
        except on:
            if attempt == tries - 1:
                raise
            sleep(float(2**attempt))
    raise ValueError("tries must be positive")


def read_metadata(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(f"arxiv_id string, {METADATA}").json(path)


def shaped_metadata(raw: DataFrame) -> DataFrame:
    """``arxiv_id, title, year, abstract``: the abstract, else the short summary, else empty; no year is 0."""
    abstract = F.coalesce(F.nullif("abstract", F.lit("")), F.col("tldr.text"), F.lit(""))
    return raw.select("arxiv_id", F.coalesce("title", F.lit("")).alias("title"), F.coalesce("year", F.lit(0)).alias("year"), abstract.alias("abstract"))


def search_stubs(responses: DataFrame, limit: int = 100) -> DataFrame:
    """``arxiv_id, title, year`` of the items of search responses that have an id."""
    items = responses.select(F.explode("data").alias("d")).select(F.col("d.externalIds.ArXiv").alias("arxiv_id"), "d.title", "d.year")
    return items.where("arxiv_id is not null and arxiv_id <> ''").limit(limit)


def read_pages(spark: SparkSession, path: str, reader: Callable[[bytes], list[str]]) -> DataFrame:
    """``path, pages`` of binary files through a page reader (``bytes -> list of page texts``), one Arrow batch at a time."""
    @F.pandas_udf("array<string>")
    def pages(content: pd.Series) -> pd.Series:
        return content.map(lambda b: list(reader(b))[:MAX_PAGES])

    return spark.read.format("binaryFile").load(path).select("path", pages("content").alias("pages"))
