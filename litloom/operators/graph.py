"""Property graph as node and edge tables: extraction from papers, upsert, aggregates over edges."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from litloom.sources.schema import DEFAULT_DOMAIN, DEFAULT_TIER
from litloom.sources.shared import written

#: Edge table, list column of a paper, name of the item column.
EDGES = (("edges_limitation", "limitations", "text"), ("edges_future", "future_directions", "text"), ("edges_method", "methods", "name"), ("edges_dataset", "datasets", "name"))

#: Edge tables whose texts get vectors, and the collections these go to.
COLLECTIONS = {"edges_limitation": "limitations", "edges_future": "future_directions"}

#: Papers of a text in one part, about.
PART = 1000
#: Texts of a block whose pairs are made together, about.
BLOCK = 4096
#: Blocks of one kind of texts, at most: a text is sent once a block it meets.
MOST_PARTS = 16


def edges_of(papers: DataFrame, list_col: str, item: str) -> DataFrame:
    """One edge per paper and distinct item; empty and null items are dropped. Limitation edges carry the tier."""
    items = F.filter(F.array_distinct(list_col), lambda x: x.isNotNull() & (x != ""))
    rows = papers.select("arxiv_id", F.explode(items).alias(item), *([F.coalesce("extraction_tier", F.lit(DEFAULT_TIER)).alias("tier")] if list_col == "limitations" else []))
    return rows


def upsert_edges(old: DataFrame, new: DataFrame, item: str) -> DataFrame:
    """Union without repeats; where an edge is met again its tier is the new one."""
    if "tier" not in new.columns:
        return old.unionByName(new).dropDuplicates(["arxiv_id", item])
    both = old.withColumn("__v", F.lit(0)).unionByName(new.withColumn("__v", F.lit(1)))
    return both.groupBy("arxiv_id", item).agg(F.max_by("tier", F.struct("__v", "tier")).alias("tier"))


def build_graph(papers: DataFrame, old: dict[str, DataFrame] | None = None, mode: str = "append") -> dict[str, DataFrame]:
    """Edge tables of all papers. ``append`` keeps edges of earlier versions of a paper, ``rebuild`` starts anew."""
    if mode not in ("append", "rebuild"):
        raise ValueError("mode must be append or rebuild")
    out = {}
    for table, col, item in EDGES:
        new = edges_of(papers, col, item)
        out[table] = upsert_edges(old[table], new, item) if old and mode == "append" else new
    return out


def created(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """``n``: keys of ``new`` that ``old`` lacks."""
    return new.select(*keys).distinct().join(old.select(*keys), keys, "left_anti").agg(F.count("*").alias("n"))


def populated(old: dict[str, DataFrame], new: dict[str, DataFrame]) -> DataFrame:
    """``kind, nodes_created, relationships_created``: what edge tables ``new`` add to ``old``; one row a table."""
    rows = []
    for table, _, item in EDGES:
        nodes, edges = created(old[table], new[table], [item]), created(old[table], new[table], ["arxiv_id", item])
        parts = nodes.select(F.col("n").alias("nodes"), F.lit(0).alias("edges")).unionByName(edges.select(F.lit(0).alias("nodes"), F.col("n").alias("edges")))
        rows.append(parts.agg(F.lit(table).alias("kind"), F.sum("nodes").alias("nodes_created"), F.sum("edges").alias("relationships_created")))
    return reduce(DataFrame.unionByName, rows)


def violations(table: DataFrame, keys: list[str]) -> DataFrame:
    """Keys that break uniqueness; an intact table gives none."""
    return table.groupBy(*keys).count().where("count > 1")


def limitation_mentions(papers: DataFrame, edges: DataFrame, domain: str) -> DataFrame:
    """``text, arxiv_id, year, tier``: a row per limitation text of a domain and paper."""
    own = papers.where(F.col("domain") == domain).select("arxiv_id", "year")
    return edges.join(own, "arxiv_id").select("text", "arxiv_id", "year", "tier")


def limitation_records(papers: DataFrame, edges: DataFrame, domain: str) -> DataFrame:
    """``text, papers array<struct<arxiv_id, year, tier>>`` of a domain: one row per limitation text. For texts of bounded use; see ``limitation_parts``."""
    return limitation_mentions(papers, edges, domain).groupBy("text").agg(F.array_sort(F.collect_list(F.struct("arxiv_id", "year", "tier"))).alias("papers"))


def limitation_parts(papers: DataFrame, edges: DataFrame, domain: str, size: int = PART) -> DataFrame:
    """``text, part, parts, papers``: as ``limitation_records`` with the papers of a text dealt by hash to parts of about ``size``,
    so a text that every paper has is many rows and no large one."""
    rows = limitation_mentions(papers, edges, domain)
    counts = rows.groupBy("text").agg(F.ceil(F.count("*") / F.lit(size)).cast("long").alias("parts"))
    rows = rows.join(counts, "text").withColumn("part", F.pmod(F.xxhash64("arxiv_id"), "parts"))
    return rows.groupBy("text", "part", "parts").agg(F.array_sort(F.collect_list(F.struct("arxiv_id", "year", "tier"))).alias("papers"))


def mentions_of(papers: DataFrame, edges: DataFrame, collection: str) -> DataFrame:
    """``text, collection, arxiv_id, domain, year``: one row per edge of the given papers; an unknown year is null."""
    domain = F.coalesce(F.nullif("domain", F.lit("")), F.lit(DEFAULT_DOMAIN))
    own = papers.select("arxiv_id", domain.alias("domain"), F.nullif("year", F.lit(0)).alias("year"))
    return edges.join(own, "arxiv_id").select("text", F.lit(collection).alias("collection"), "arxiv_id", "domain", "year")


def collected(mentions: DataFrame) -> DataFrame:
    """``collection, text, domain, paper_ids, year``: one row per text and domain, year the largest known or 0."""
    rows = mentions.groupBy("collection", "text", "domain").agg(F.array_sort(F.collect_list("arxiv_id")).alias("paper_ids"), F.coalesce(F.max("year"), F.lit(0)).alias("year"))
    return rows.select("collection", "text", "domain", "paper_ids", "year")


def point_payloads(papers: DataFrame, edges: DataFrame, collection: str) -> DataFrame:
    """The payloads of a collection, from whole tables."""
    return collected(mentions_of(papers, edges, collection))


def papers_per_domain(papers: DataFrame) -> DataFrame:
    return papers.groupBy("domain").agg(F.count("*").alias("papers"))


def texts_sharing(edges: DataFrame, other: DataFrame, item: str, block: int = BLOCK) -> DataFrame:
    """Pairs of limitation texts of papers that share a method or data set, with the number of shared items.

    Texts with the same items are one kind: what two kinds share is counted once, and pairs of texts are made from pairs of kinds, in blocks of
    about ``block`` texts of each, and larger ones where a kind would have more than ``MOST_PARTS``. So a text is sent a bounded number of times for
    each two kinds, whatever their size. Pairs of texts are neither shuffled nor gathered; of a block one side is held, and spilled where it is large.
    """
    width = int(edges.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    link = written(edges.join(other, "arxiv_id").select("text", item).where(F.col(item).isNotNull() & F.col("text").isNotNull()).distinct(), "links")
    # The number of items and two sums of their hashes: no text's items are gathered.
    sums = [F.sum(F.xxhash64(item, F.lit(seed)).cast("decimal(20,0)")).alias(f"k{seed}") for seed in (1, 2)]
    texts = written(link.groupBy("text").agg(F.count("*").alias("k0"), *sums).select("text", F.concat_ws(":", "k0", "k1", "k2").alias("kind")), "kinds")
    parts = F.least(F.ceil(F.count("*") / F.lit(block)), F.lit(MOST_PARTS)).cast("long")
    kinds = written(texts.groupBy("kind").agg(F.min("text").alias("text"), parts.alias("parts")), "kinds")
    items = link.join(kinds, "text").select("kind", "parts", item)
    pairs = items.join(items.select(F.col("kind").alias("other_kind"), F.col("parts").alias("other_parts"), item), item).where("kind <= other_kind")
    pairs = pairs.groupBy("kind", "other_kind", "parts", "other_parts").agg(F.count("*").alias("shared"))
    # Written with its number, by which the blocks of two kinds are told from others.
    pairs = written(pairs.withColumn("pair", F.monotonically_increasing_id()).withColumn("same", F.col("kind") == F.col("other_kind")), "shared")
    place = lambda parts: F.pmod(F.xxhash64("text"), parts)
    each = lambda parts: F.explode(F.sequence(F.lit(0).cast("long"), F.col(parts) - 1))
    cell = ["pair", "part", "other_part"]
    # Two blocks of one kind meet once.
    once = "not same or part <= other_part"
    left = texts.join(pairs, "kind").withColumn("part", place("parts")).withColumn("other_part", each("other_parts")).where(once)
    left = left.select(*cell, "text", "shared", (F.col("same") & (F.col("part") == F.col("other_part"))).alias("within"))
    right = texts.withColumnRenamed("kind", "other_kind").join(pairs, "other_kind").withColumn("other_part", place("other_parts")).withColumn("part", each("parts")).where(once)
    right = right.select(*cell, F.col("text").alias("other_text"))
    # Few rows make many pairs: a number of partitions is named, so that it is kept.
    met = left.repartition(4 * width, *cell).join(right.repartition(4 * width, *cell), cell).where("not within or text < other_text")
    return met.select(F.least("text", "other_text").alias("text"), F.greatest("text", "other_text").alias("other_text"), "shared")
