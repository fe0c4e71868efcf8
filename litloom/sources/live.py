"""Live sources: a search service as a Spark data source with pages as partitions, and metadata and files of found papers by HTTP.

Requests are spread over tasks, and each task waits between its own so that all together keep to the stated rate. A service
that asks to slow down (429) is asked again after 1 and 2 seconds; any other error of metadata or search rises or, for one paper, becomes
its ``error``. A file that cannot be had after three attempts is a row without pages: the abstract takes its place.
"""

from __future__ import annotations

import json
import time
import urllib.error
import urllib.parse
import urllib.request
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from litloom.functions.text import MAX_PAGES
from litloom.sources.connectors import RateLimited, fetch_with_retry

STUB = "arxiv_id string, title string, year int"
PAPER = "arxiv_id string, title string, year int, abstract string, pages array<string>, error string"
TIMEOUT = 30
PAGE = 100


def get(url: str, key: str = "") -> bytes:
    """The body of a response; 429 rises as ``RateLimited``."""
    request = urllib.request.Request(url, headers={"User-Agent": "Mozilla/5.0"} | ({"x-api-key": key} if key else {}))
    try:
        with urllib.request.urlopen(request, timeout=TIMEOUT) as response:
            return response.read()
    except urllib.error.HTTPError as e:
        if e.code == 429:
            raise RateLimited(url) from e
        raise


class Pace:
    """At most ``per_second`` calls a second (0: no bound)."""

    def __init__(self, per_second: float) -> None:
        self.gap, self.next = 1 / per_second if per_second else 0.0, 0.0

    def wait(self) -> None:
        now = time.monotonic()
        if now < self.next:
            time.sleep(self.next - now)
        self.next = max(now, self.next) + self.gap


class Page(InputPartition):
    def __init__(self, offset: int, size: int) -> None:
        self.offset, self.size = offset, size


class SearchReader(DataSourceReader):
    def __init__(self, options: dict[str, str]) -> None:
        self.options = options
        self.limit, self.page = int(options.get("limit", PAGE)), int(options.get("page", PAGE))

    def partitions(self) -> list[Page]:
        return [Page(at, min(self.page, self.limit - at)) for at in range(0, self.limit, self.page)]

    def read(self, partition: Page) -> Iterator[tuple]:
        ask = {"query": self.options["query"], "offset": partition.offset, "limit": partition.size, "fields": "paperId,title,year,externalIds"}
        body = fetch_with_retry(lambda: get(f"{self.options['endpoint']}/paper/search?{urllib.parse.urlencode(ask)}", self.options.get("key", "")))
        for item in json.loads(body).get("data") or []:
            name = (item.get("externalIds") or {}).get("ArXiv")
            if name:
                yield name, item.get("title") or "", item.get("year") or 0


class SearchSource(DataSource):
    """``spark.read.format("paper_search")`` with the options ``endpoint``, ``query``, ``limit``, ``page`` and ``key``: ``arxiv_id, title, year`` of what has an id."""

    @classmethod
    def name(cls) -> str:
        return "paper_search"

    def schema(self) -> str:
        return STUB

    def reader(self, schema) -> SearchReader:
        return SearchReader(dict(self.options))


def search(spark: SparkSession, endpoint: str, query: str, limit: int = PAGE, key: str = "") -> DataFrame:
    """The first ``limit`` results of a search, a page of them a task."""
    spark.dataSource.register(SearchSource)
    return spark.read.format("paper_search").options(endpoint=endpoint, query=query, limit=str(limit), key=key).load()


def metadata(endpoint: str, arxiv_id: str, key: str = "", sleep: Callable[[float], None] = time.sleep) -> tuple[str, int, str]:
    """Title, year and abstract: the abstract, else the short summary, else empty; no year is 0."""
    body = fetch_with_retry(lambda: get(f"{endpoint}/paper/arXiv:{arxiv_id}?fields=title,year,abstract,tldr", key), sleep=sleep)
    found = json.loads(body)
    return found.get("title") or "", found.get("year") or 0, found.get("abstract") or (found.get("tldr") or {}).get("text") or ""


def page_texts(files: str, arxiv_id: str, reader: Callable[[bytes], list[str]], sleep: Callable[[float], None] = time.sleep) -> list[str] | None:
    """Texts of the first pages, or None after three failures of any kind."""
    try:
        return fetch_with_retry(lambda: list(reader(get(f"{files}/{arxiv_id}")))[:MAX_PAGES], sleep=sleep, on=(Exception,))
    except Exception:
        return None


def gathered(
    stubs: DataFrame, endpoint: str, files: str | None = None, reader: Callable[[bytes], list[str]] | None = None, key: str = "", per_second: float = 0, tasks: int = 8,
) -> DataFrame:
    """``arxiv_id, title, year, abstract, pages, error`` of papers named by ``stubs(arxiv_id)``, fetched by ``tasks`` tasks.

    A paper whose metadata cannot be had keeps its row with ``error`` and nothing else. Without ``files`` there are no pages.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pace = Pace(per_second / tasks)
        for b in batches:
            rows = []
            for name in b.column(0).to_pylist():
                pace.wait()
                try:
                    title, year, abstract = metadata(endpoint, name, key)
                except Exception as e:  # one paper's failure stops no other
                    rows.append((name, None, None, None, None, f"{type(e).__name__}: {e}"))
                    continue
                pages = page_texts(files, name, reader) if files and reader else None
                rows.append((name, title, year, abstract, pages, None))
            types = [pa.string(), pa.string(), pa.int32(), pa.string(), pa.list_(pa.string()), pa.string()]
            columns = zip(*rows, strict=True) if rows else [[]] * 6
            yield pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(columns, types, strict=True)], ["arxiv_id", "title", "year", "abstract", "pages", "error"])

    names = stubs.select(F.col("arxiv_id").cast("string")).repartition(tasks, F.rand(1))
    return names.mapInArrow(run, PAPER)
