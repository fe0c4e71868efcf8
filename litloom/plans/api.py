"""The public functions: health, gaps, search, cross-domain matches, ingestion, explanation, paper lookup."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from litloom.functions import text as tx
from litloom.operators import crossdomain, vectors
from litloom.operators.scoring import Gaps
from litloom.plans import ingest as ingestion
from litloom.sources.store import Store, by_key

# Parameter bounds.
MOST_GAPS, MOST_MATCHES, MOST_HITS = 100, 50, 50


def _within(name: str, value: int, most: int) -> None:
    if not 1 <= value <= most:
        raise ValueError(f"{name} must be 1 to {most}")


def _not_empty(**values: str) -> None:
    for name, v in values.items():
        if not v:
            raise ValueError(f"{name} must not be empty")


def health(store: Store) -> DataFrame:
    """``status, papers, limitations, future_directions``; tables that are not there count 0."""
    points = store.read("points").agg(F.count_if(F.col("collection") == "limitations").alias("limitations"), F.count_if(F.col("collection") == "future_directions").alias("future_directions")).first()
    return store.read("papers").agg(F.lit("ok").alias("status"), F.count("*").alias("papers"), F.lit(points[0]).alias("limitations"), F.lit(points[1]).alias("future_directions"))


def gaps_of(store: Store, domain: str, **options) -> Gaps:
    return Gaps(store.read("papers"), store.read("edges_limitation"), store.read("points"), domain, **options)


def gaps(store: Store, domain: str = "computer_vision", top_n: int = 20, **options) -> DataFrame:
    _within("top_n", top_n, MOST_GAPS)
    return gaps_of(store, domain, **options).ranking(top_n)


def search(store: Store, q: str, encode: Callable[[str], list[float]], domain: str = "computer_vision", top_k: int = 10) -> DataFrame:
    _within("top_k", top_k, MOST_HITS)
    _not_empty(q=q)
    return vectors.search(store.read("points").where("collection = 'limitations'"), encode(q), top_k, domain)


def search_future(store: Store, q: str, encode: Callable[[str], list[float]], domain: str | None = None, top_k: int = 10) -> DataFrame:
    _within("top_k", top_k, MOST_HITS)
    _not_empty(q=q)
    return vectors.search(store.read("points").where("collection = 'future_directions'"), encode(q), top_k, domain)


def cross_domain(store: Store, source: str, target: str, top_n: int = 10, threshold: float = crossdomain.CROSS_THRESHOLD, **options) -> DataFrame:
    _within("top_n", top_n, MOST_MATCHES)
    return crossdomain.matches(gaps_of(store, source, **options), store.read("points"), target, threshold, top_n)


def ingest(store: Store, papers: DataFrame, extractor: Callable, domain: str, encode: Callable | None = None) -> DataFrame:
    _not_empty(domain=domain.strip())
    return ingestion.ingest(store, papers, extractor, domain.strip(), "upsert", True, encode)


def explain(pairs: DataFrame, model: Callable) -> DataFrame:
    """Adds ``explanation`` to matches by a text model (a UDF ``prompt -> text``); answers are stripped."""
    prompt = tx.explain_prompt(F.col("source_gap"), F.col("target_solution"), F.col("source_domain"), F.col("target_domain"))
    return pairs.withColumn("explanation", tx.strip(model(prompt)))


def paper(store: Store, arxiv_id: str) -> DataFrame:
    return by_key(store.lookup("papers", arxiv_id) if store.exists("papers") else store.read("papers"), arxiv_id)
