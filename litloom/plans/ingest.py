"""Ingestion: metadata, section and tier, prompt, extraction, validation, publication."""

from __future__ import annotations

import json
from collections.abc import Callable
from functools import reduce

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from litloom.functions import text as tx
from litloom.functions.records import LIST_FIELDS, validated
from litloom.operators.graph import COLLECTIONS, EDGES, build_graph, collected, edges_of, mentions_of, populated, upsert_edges
from litloom.operators.vectors import embed
from litloom.sources import live
from litloom.sources.schema import DEFAULT_DOMAIN
from litloom.sources.shared import written
from litloom.sources.store import Store, Transaction

RAW_KEPT = 500


def stub_extractor() -> Callable:
    """Offline stand-in for a model: sentences that admit or propose something, by keyword. Deterministic."""

    @F.pandas_udf("string")
    def run(prompts: pd.Series) -> pd.Series:
        def one(p: str | None) -> str:
            body = (p or "").split("\nText:\n")[-1]
            sentences = [s.strip() for s in body.replace("\n", ". ").split(". ") if s.strip()]
            out = {f: [] for f in LIST_FIELDS}
            out["limitations"] = [s for s in sentences if "limit" in s.lower() or "however" in s.lower()]
            out["future_directions"] = [s for s in sentences if "future" in s.lower()]
            return json.dumps(out)

        return prompts.map(one)

    return run


def extract(papers: DataFrame, extractor: Callable) -> DataFrame:
    """``papers(arxiv_id, title, year, abstract, pages)`` -> validated rows with ``reason`` and ``extraction_tier``."""
    found = papers.withColumn("__s", tx.with_abstract(tx.section_from_pages(F.col("pages")), F.col("abstract")))
    prompt = tx.extraction_prompt(tx.paper_text(F.col("title"), F.col("__s.body")), F.col("__s.tier"))
    return validated(found.withColumn("response", extractor(prompt)).withColumn("extraction_tier", F.col("__s.tier")).drop("__s"))


def plan_batch(stubs: DataFrame, stored: DataFrame) -> DataFrame:
    """Adds ``status``: ``skipped`` for stored ids, ``duplicate`` for repeats within the batch, else ``new``."""
    # Written: the order of the rows is taken once, as the plan is read several times.
    rows = written(stubs.withColumn("__at", F.monotonically_increasing_id()), "batch")
    return _with_status(rows, stored).drop("__at")


def _with_status(rows: DataFrame, stored: DataFrame) -> DataFrame:
    """``status`` of rows that are in the order of ``__at``."""
    rows = rows.withColumn("__n", F.row_number().over(Window.partitionBy("arxiv_id").orderBy("__at")))
    known = stored.select("arxiv_id").distinct().withColumn("__known", F.lit(True))
    status = F.when(F.col("__known"), "skipped").when(F.col("__n") > 1, "duplicate").otherwise("new")
    return rows.join(known, "arxiv_id", "left").withColumn("status", status).drop("__n", "__known")


def summary(outcomes: DataFrame) -> DataFrame:
    """One row ``ingested, skipped, failed``; repeats within a batch count as failed."""
    n = lambda *s: F.count_if(F.col("status").isin(*s)).alias
    return outcomes.agg(n("ingested")("ingested"), n("skipped")("skipped"), n("failed", "duplicate")("failed"))


def ingest(
    store: Store, stubs: DataFrame, extractor: Callable, domain: str = DEFAULT_DOMAIN, mode: str = "insert", publish: bool = True,
    encode: Callable | None = None, stream: tuple[str, int] | None = None,
) -> DataFrame:
    """Runs a batch and returns its summary.

    ``stubs(arxiv_id, title, year, abstract, pages)``; one with an ``error`` (see ``sources.live``) counts as failed. ``insert`` leaves stored papers untouched,
    ``upsert`` replaces them. A paper that fails goes to ``failures`` and stops nothing. With ``publish`` the
    graph (and, given an encoder, the points) follows if anything was ingested. Papers, failures, graph and points
    become visible together: after a failure anywhere the store is as before and the batch can be run again.
    A micro-batch ``stream`` (name, number) that has been committed before changes nothing and counts nothing.
    """
    if mode not in ("insert", "upsert"):
        raise ValueError("mode must be insert or upsert")
    with store.transaction(stream) as t:
        if t.seen:
            return summary(store.spark.createDataFrame([], "status string"))
        batch = stubs.withColumn("arxiv_id", F.regexp_replace("arxiv_id", r"(?U)^\s+|\s+\z", ""))
        # Texts are written once, here; what comes of a paper is decided on ids and kept without them.
        stubs = written(batch.withColumn("__at", F.monotonically_increasing_id()), "stubs")
        ids = stubs.select("arxiv_id", "__at")
        stored = t.read("papers", ids) if mode == "insert" else t.read("papers").limit(0)
        batch = written(_with_status(ids, stored), "planned")
        is_new = F.col("status") == "new"
        n = batch.agg(F.count_if(is_new).alias("new"), F.count_if(~is_new).alias("old")).first()
        # Joined to the shorter list: where it is short enough to be broadcast, texts are not shuffled.
        new = stubs.join(batch.where(is_new).select("__at"), "__at", "left_semi") if n["new"] < n["old"] else stubs.join(batch.where(~is_new).select("__at"), "__at", "left_anti")
        if "error" not in stubs.columns:
            new = new.withColumn("error", F.lit(None).cast("string"))
        lost = new.where("error is not null").select(F.current_timestamp().alias("ts"), "arxiv_id", F.lit("fetch").alias("stage"), F.col("error").alias("reason"), F.lit(None).cast("string").alias("raw"))
        done = extract(new.where("error is null"), extractor).withColumn("at", F.current_timestamp())
        raw = F.when(F.col("reason").isNotNull(), F.substring("response", 1, RAW_KEPT)).alias("raw")
        done = written(done.select("arxiv_id", "title", "year", *LIST_FIELDS, "raw_json", "at", "extraction_tier", "reason", raw), "extracted")
        rows = done.where("reason is null").select(
            "arxiv_id", "title", F.coalesce("year", F.lit(0)).cast("int").alias("year"), F.lit(domain).alias("domain"), *LIST_FIELDS, "raw_json",
            F.col("at").alias("ingested_at"), "extraction_tier",
        )
        bad = done.where("reason is not null").select(F.col("at").alias("ts"), "arxiv_id", F.lit("extraction").alias("stage"), "reason", "raw")
        twice = batch.where("status = 'duplicate'").select(F.current_timestamp().alias("ts"), "arxiv_id", F.lit("batch").alias("stage"), F.lit("duplicate").alias("reason"), F.lit(None).cast("string").alias("raw"))
        status = done.select(F.when(F.col("reason").isNull(), "ingested").otherwise("failed").alias("status")).unionByName(batch.where("status <> 'new'").select("status"))
        out = written(summary(status.unionByName(lost.select(F.lit("failed").alias("status")))), "summary")
        counts = out.first()
        if counts["ingested"]:
            (t.upsert if mode == "upsert" else t.insert_absent)("papers", rows, "arxiv_id")
        if counts["failed"]:
            t.append("failures", bad.unionByName(twice).unionByName(lost))
        if counts["ingested"] and publish:
            refresh(t, rows, encode)
    return out


def ingest_from_query(
    store: Store, endpoint: str, query: str, extractor: Callable, limit: int = live.PAGE, files: str | None = None, reader: Callable[[bytes], list[str]] | None = None,
    key: str = "", per_second: float = 0, **options,
) -> DataFrame:
    """Searches a live service, fetches what is not stored yet and ingests it; returns the summary. ``options`` as for ``ingest``."""
    stubs = written(live.search(store.spark, endpoint, query, limit, key).distinct(), "found")
    known = stubs.join(store.read("papers", stubs).select("arxiv_id"), "arxiv_id", "left_semi")
    fresh = live.gathered(stubs.join(known.select("arxiv_id"), "arxiv_id", "left_anti"), endpoint, files, reader, key, per_second)
    # Stored papers are not fetched; their stubs are counted as skipped.
    return ingest(store, fresh.unionByName(known, allowMissingColumns=True), extractor, **options)


def refresh(t: Transaction, papers: DataFrame, encode: Callable | None = None) -> None:
    """Upserts the graph of ``papers`` and what points depend on it; only buckets of these papers and of their texts are read and written."""
    for name, col, item in EDGES:
        t.merge(name, edges_of(papers, col, item), "arxiv_id", lambda old, new, item=item: upsert_edges(old, new, item))
    ids = papers.select("arxiv_id")
    changed = [mentions_of(papers, t.read(name, ids), collection) for name, collection in COLLECTIONS.items()]
    changed = written(reduce(DataFrame.unionByName, changed), "mentions")
    t.merge("mentions", changed, "text", lambda old, new: old.join(new, ["text", "collection", "arxiv_id"], "left_anti").unionByName(new))
    if encode is None:
        t.notes["points_behind"] = True
    elif t.notes.pop("points_behind", False):
        _encode(t, t.read("mentions"), encode)
    else:
        texts = changed.select("text", "collection").distinct()
        _encode(t, t.read("mentions", texts).join(texts, ["text", "collection"], "left_semi"), encode)


def _encode(t: Transaction, mentions: DataFrame, encode: Callable) -> None:
    """Points of all texts of ``mentions`` (which has every mention of each); a text that has its vector keeps it, only new ones are encoded."""
    fresh = written(collected(mentions), "payloads")
    known = t.read("points", fresh).select("text", "embedding").dropDuplicates(["text"])
    points = fresh.join(known, "text").unionByName(embed(fresh.join(known.select("text"), "text", "left_anti"), encode))
    t.merge("points", points, "text", lambda old, new: old.join(new, ["text", "collection"], "left_anti").unionByName(new, allowMissingColumns=True))


def populate(store: Store, mode: str = "append", encode: Callable | None = None) -> DataFrame:
    """Builds the graph (and, given an encoder, the points) of all stored papers; one row a table: ``kind, nodes_created, relationships_created``.

    ``append`` adds to the graph that is there, so running it again creates nothing; ``rebuild`` starts anew.
    """
    with store.transaction() as t:
        papers = t.read("papers")
        old = {name: store.read(name) for name, _, _ in EDGES}
        new = build_graph(papers, old, mode)
        counts = written(populated(old, new), "populated")
        for name, _, _ in EDGES:
            t.recreate(name, new[name], "arxiv_id")
        every = [mentions_of(papers, t.read(name), collection) for name, collection in COLLECTIONS.items()]
        t.recreate("mentions", reduce(DataFrame.unionByName, every), "text")
        if encode is None:
            t.notes["points_behind"] = True
        else:
            t.notes.pop("points_behind", None)
            payloads = collected(t.read("mentions"))
            known = t.read("points").select("text", "embedding").dropDuplicates(["text"])
            t.recreate("points", payloads.join(known, "text").unionByName(embed(payloads.join(known.select("text"), "text", "left_anti"), encode)), "text")
    return counts
