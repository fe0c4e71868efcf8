"""Queries through the public functions and a store: ingestion with pages, upsert and repetition, search, gaps, matches, explanation."""

from __future__ import annotations

import hashlib
import json

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from litloom.functions import records, text
from litloom.operators import graph, vectors
from litloom.operators.scoring import Gaps
from litloom.operators.vectors import hashing_encoder
from litloom.plans import api, ingest
from litloom.plans import bindings as b
from litloom.plans.registry import _PAIRS, _RANKED, _SCORED, CV, MI, ORACLES, T, _flat, _query_vector, joined, query, with_rules
from litloom.sources.shared import fresh_dir
from litloom.sources.store import Store

#: Stores built from the driver's tables, by application and folder.
_BUILT: dict[tuple[str, str], Store] = {}


def bound_store(spark: SparkSession, d: str) -> Store:
    """Papers, edges, mentions and points of the driver's tables in a store; built once a session and folder."""
    key = (spark.sparkContext.applicationId, d)
    if key not in _BUILT:
        kept = Store(spark, fresh_dir(spark, "store"))
        p, e = b.papers(spark, d), b.edges(spark, d)
        with kept.transaction() as t:
            t.recreate("papers", p.select("arxiv_id", "title", "year", "domain", F.col("tier").alias("extraction_tier")), "arxiv_id")
            t.recreate("edges_limitation", b.edges_limitation(e), "arxiv_id")
            t.recreate("edges_future", b.edges_future(e), "arxiv_id")
            t.recreate("points", b.points(spark, d), "text")
        _BUILT[key] = kept
    return _BUILT[key]


@query(ORACLES["search_topk"])
def api_search(spark: SparkSession, d: str) -> DataFrame:
    hits = api.search(bound_store(spark, d), "q", lambda q: _query_vector(spark, d, 1), CV, 10)
    return hits.select("text", joined("paper_ids"), "domain", text.round4(F.col("score")).alias("score"))


@query(ORACLES["search_topk_any_domain"])
def api_search_future(spark: SparkSession, d: str) -> DataFrame:
    hits = api.search_future(bound_store(spark, d), "q", lambda q: _query_vector(spark, d, 2))
    return hits.select("text", joined("paper_ids"), "domain", text.round4(F.col("score")).alias("score"))


@query(ORACLES["gap_ranking"])
def api_gaps(spark: SparkSession, d: str) -> DataFrame:
    return _flat(api.gaps(bound_store(spark, d), CV, 20, cluster_threshold=T, solution_threshold=T))


@query(ORACLES["cross_domain_matches"])
def api_cross_domain(spark: SparkSession, d: str) -> DataFrame:
    out = api.cross_domain(bound_store(spark, d), CV, MI, 10, T, cluster_threshold=T, solution_threshold=T)
    return out.withColumn("source_papers", joined("source_papers")).withColumn("target_papers", joined("target_papers"))


@query(ORACLES["health"])
def api_health(spark: SparkSession, d: str) -> DataFrame:
    return api.health(bound_store(spark, d))


@query(ORACLES["paper_lookup"])
def api_paper(spark: SparkSession, d: str) -> DataFrame:
    """A point lookup: one bucket of the store is read."""
    return api.paper(bound_store(spark, d), "42").select("arxiv_id", "title", "year", "domain")


@query(f"""
SELECT source_gap, target_solution, sha256('In two or three sentences, say why the proposal could help with the problem.' || chr(10) || 'Problem in computer vision: ' || source_gap
 || chr(10) || 'Proposal from medical imaging: ' || target_solution) AS explanation FROM ({ORACLES["cross_domain_matches"]})""")
def api_explain(spark: SparkSession, d: str) -> DataFrame:
    """Matches explained by a model that answers with white space around the digest of its prompt."""

    @F.pandas_udf("string")
    def model(prompts: pd.Series) -> pd.Series:
        return prompts.map(lambda p: f" \n{hashlib.sha256(p.encode()).hexdigest()}\t ")

    found = api.cross_domain(bound_store(spark, d), CV, MI, 10, T, cluster_threshold=T, solution_threshold=T)
    return api.explain(found, model).select("source_gap", "target_solution", "explanation")


_HITS = """pairs AS MATERIALIZED (SELECT src, l.r AS dst, max(sim) AS sim FROM (
    SELECT a.r AS src, p.text, list_cosine_similarity(a.vec, p.vec) AS sim, row_number() OVER (PARTITION BY a.r ORDER BY list_cosine_similarity(a.vec, p.vec) DESC, p.text) AS pos
    FROM limv a JOIN points p ON p.collection = 'limitations' WHERE list_cosine_similarity(a.vec, p.vec) >= 0.0) h
  JOIN lim l ON l.text = h.text AND h.src < l.r WHERE pos <= (SELECT count(*) FROM lim) GROUP BY src, l.r),"""


@query(with_rules(_RANKED.replace(_PAIRS, _HITS) + "SELECT rank, text, seed FROM cl"))
def cluster_members_limited(spark: SparkSession, d: str) -> DataFrame:
    """Clusters with each text's hits cut to as many as the domain has texts, over the points of all domains. At threshold 0 about half of all points are hits, so the cut matters."""
    papers, edges = b.papers(spark, d), b.edges_limitation(b.edges(spark, d))
    g = Gaps(papers, edges, b.points(spark, d), CV, 0.0, T, neighbour_limit="reference")
    return g.clusters.join(g.records.select("rank", "text"), "rank").select("rank", "text", "seed")


@query(with_rules("""
SELECT text, domain, CAST(length(text) AS VARCHAR) || ',' || (length(text) - length(replace(text, '1', ''))) || ',1' AS vec
FROM points WHERE collection = 'limitations'"""))
def embedded_points(spark: SparkSession, d: str) -> DataFrame:
    """Points with the vectors of an encoder (length, number of ones, 1), of a stated dimension."""

    @F.pandas_udf("array<float>")
    def encode(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: [float(len(t)), float(t.count("1")), 1.0])

    rows = b.points(spark, d).where("collection = 'limitations'").drop("embedding")
    out = vectors.embed(rows, encode, dim=3)
    return out.select("text", "domain", F.array_join(F.transform("embedding", lambda x: x.cast("int").cast("string")), ",").alias("vec"))


def _model():
    """Answers with the digest of the text it was given as a limitation, in a code fence; every seventh answer lacks keys."""

    @F.pandas_udf("string")
    def model(prompts: pd.Series) -> pd.Series:
        def one(p: str) -> str:
            title, body = p.split("\nText:\nTitle: Paper ", 1)[1].split("\n\n", 1)
            found = {f: [] for f in records.LIST_FIELDS} | {"limitations": ["L " + hashlib.md5(body.encode()).hexdigest()], "future_directions": ["later", ""]}
            return "```json\n" + json.dumps(found) + "\n```" if int(title) % 7 else '{"methods": 1}'

        return prompts.map(one)

    return model


@query(r"""
WITH body AS (SELECT doc_id, CAST(doc_id AS VARCHAR) AS arxiv_id, CASE doc_id % 4 WHEN 0 THEN 'explicit' WHEN 1 THEN 'conclusion' ELSE 'inferred' END AS tier,
  'L ' || md5(CASE doc_id % 4 WHEN 0 THEN regexp_replace(left('4. Limitations' || chr(10) || coalesce(text, '') || chr(10) || 'next ' || doc_id, 4000), '\s+$', '')
    WHEN 1 THEN regexp_replace(left('Conclusion' || chr(10) || coalesce(text, ''), 4000), '\s+$', '') ELSE coalesce(text, '') END) AS item FROM documents WHERE doc_id % 7 <> 0),
point AS (SELECT item, string_agg(arxiv_id, ',' ORDER BY arxiv_id) AS paper_ids, count(*) AS n FROM body GROUP BY item)
SELECT arxiv_id, tier, item, 'computer_vision' AS domain, paper_ids, n,
 md5('{"objectives": [], "methods": [], "datasets": [], "evaluation_metrics": [], "limitations": ["' || item || '"], "future_directions": ["later", ""]}') AS raw,
 (SELECT count(*) FROM documents WHERE doc_id % 7 = 0) AS failures FROM body JOIN point USING (item)""")
def api_ingest(spark: SparkSession, d: str) -> DataFrame:
    """Papers with pages through the public ingestion: every third first, under another domain; then all, which replaces those; then a numbered batch twice.

    Sections come from a heading on a tail page, from a conclusion, or are the abstract; ids and domains have white space around them; every seventh answer fails.
    """
    i, t = F.col("doc_id"), F.coalesce("text", F.lit(""))
    pages = F.when(i % 4 == 0, F.array(F.lit("front"), F.concat(F.lit("4. Limitations\n"), t), F.concat(F.lit("next "), i))).when(i % 4 == 1, F.array(F.concat(F.lit("Conclusion\n"), t)))
    docs = b.table(spark, d, "documents")
    stubs = docs.select("doc_id", F.concat(F.lit("  "), i, F.lit(" ")).alias("arxiv_id"), F.concat(F.lit("Paper "), i).alias("title"), F.lit(2020).alias("year"), t.alias("abstract"), pages.alias("pages"))
    kept = Store(spark, fresh_dir(spark, "store"))
    api.ingest(kept, stubs.where("doc_id % 3 = 0 and doc_id % 7 <> 0").drop("doc_id"), _model(), f" {MI} ", hashing_encoder(4))
    api.ingest(kept, stubs.drop("doc_id"), _model(), CV, hashing_encoder(4))
    for _ in range(2):
        ingest.ingest(kept, stubs.where("doc_id % 7 <> 0").drop("doc_id"), _model(), MI, encode=hashing_encoder(4), stream=("again", 0))
    edges = kept.read("edges_limitation").withColumnRenamed("text", "item")
    points = kept.read("points").where("collection = 'limitations' and size(embedding) = 4").select(F.col("text").alias("item"), F.col("domain").alias("of"), "paper_ids")
    papers = kept.read("papers").select("arxiv_id", "domain", F.md5("raw_json").alias("raw"))
    failures = kept.read("failures").agg(F.count("*").alias("failures"))
    out = edges.join(papers, "arxiv_id").join(points, "item").where("of = domain").join(F.broadcast(failures), F.lit(True))  # one row
    return out.select("arxiv_id", "tier", "item", "domain", joined("paper_ids"), F.size("paper_ids").cast("long").alias("n"), "raw", "failures")


@query(with_rules("""
, item AS (SELECT arxiv_id, CASE WHEN vec_id % 3 <> 0 THEN 'edges_limitation' ELSE 'edges_future' END AS kind, text AS item FROM edges)
SELECT kind, step, CASE WHEN step = 1 THEN n ELSE 0 END AS nodes_created, CASE WHEN step = 1 THEN e ELSE 0 END AS relationships_created
FROM (SELECT kind, count(DISTINCT item) AS n, count(*) AS e FROM item GROUP BY kind UNION ALL SELECT unnest(['edges_method', 'edges_dataset']), 0, 0), (SELECT unnest([1, 2]) AS step)"""))
def store_populate(spark: SparkSession, d: str) -> DataFrame:
    """The graph of a store's papers, built twice: all nodes and relationships are created once."""
    e = b.edges(spark, d)
    lists = e.groupBy("arxiv_id").agg(*[F.collect_list(F.when(F.col("vec_id") % 3 != 0 if c == "limitations" else F.col("vec_id") % 3 == 0, F.col("text"))).alias(c) for c in graph.COLLECTIONS.values()])
    none = F.array().cast("array<string>")
    p = b.papers(spark, d).join(lists, "arxiv_id").select("arxiv_id", "title", "year", "domain", "limitations", "future_directions", none.alias("methods"), none.alias("datasets"), F.col("tier").alias("extraction_tier"))
    kept = Store(spark, fresh_dir(spark, "store"))
    kept.upsert("papers", p, "arxiv_id")
    first, second = (ingest.populate(kept).withColumn("step", F.lit(step).cast("long")) for step in (1, 2))
    return first.unionByName(second)


@query(with_rules(_SCORED + "SELECT seed, (SELECT text FROM lim WHERE r = seed) AS description, supporting_papers FROM gaps"))
def store_gaps_after_upsert(spark: SparkSession, d: str) -> DataFrame:
    """Gaps of a store in which every paper was there before in another domain and year, and was upserted."""
    p = b.papers(spark, d)
    kept = Store(spark, fresh_dir(spark, "store"), bucket_rows=2000)
    kept.upsert("papers", p.withColumns({"year": F.lit(1999), "domain": F.lit("elsewhere")}).drop("doc_id", "tier"), "arxiv_id")
    kept.upsert("papers", p.drop("doc_id", "tier"), "arxiv_id")
    g = Gaps(kept.read("papers"), b.edges_limitation(b.edges(spark, d)), b.points(spark, d), CV, T, T)
    return g.ranking(20).select("seed", F.col("gap_description").alias("description"), joined("supporting_papers"))
