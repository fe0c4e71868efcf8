"""Queries of the corpus operators, with production parameters over whole tables, and their SQL where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from litloom.llm import chat_collapse, decontam, exact_stream, hilbert, kd_clusters, knn_quality, minmax_hash, mixing, product_codes, secret_scan, simhash, suffix_dedup, superkmer, vector_sql
from litloom.llm.common import table


def op1_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf_dir, "documents")).select("doc_id", "fingerprint", "component_id")


def op2_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam.report(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op3_hilbert_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = hilbert.shard(table(spark, sf_dir, "documents").select("doc_id", "text", "source", "lang"))
    return out.select("doc_id", "size", "text_crc32", "law", "shard", "slot", "grown_shard", "curve_index")


def op4_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_stream.stream_dedup(spark, f"{sf_dir}/documents.parquet")


def op5_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents")).drop("text_key")


def op6_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return superkmer.digest(table(spark, sf_dir, "documents"))


def op7_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return knn_quality.classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op8_chat_collapse(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat_collapse.collapse(table(spark, sf_dir, "conversations"))


def op9_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_scan.scan(table(spark, sf_dir, "documents"))


def op10_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.digest(table(spark, sf_dir, "documents"))


def op11_kd_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return kd_clusters.cluster(table(spark, sf_dir, "embeddings"))


def op12_minmax_hash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minmax_hash.near_duplicates(table(spark, sf_dir, "documents")).select("doc_id", "n_shingles", "component_id", "kept")


def op13_product_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return product_codes.compress(table(spark, sf_dir, "embeddings"))


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f for f in (op1_simhash, op2_decontamination, op3_hilbert_sharding, op4_exact_dedup, op5_mixing, op6_substring_dedup, op7_quality, op8_chat_collapse, op9_secret_scan, op10_suffix_dedup, op11_kd_clusters, op12_minmax_hash, op13_product_codes, pipeline)
}

_FOLDED = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"

ORACLES: dict[str, str] = {
    "op2_decontamination": rf"""
WITH b AS (SELECT item_id, {_FOLDED} AS w FROM benchmark),
win AS (SELECT DISTINCT item_id, least(10, len(w)) AS n, array_to_string(w[p + 1 : p + least(10, len(w))], ' ') AS s
        FROM b, LATERAL (SELECT unnest(range(len(w) - least(10, len(w)) + 1)) AS p) WHERE len(w) > 0),
sizes AS (SELECT DISTINCT n FROM win),
d AS (SELECT doc_id, {_FOLDED} AS w FROM documents),
hit AS (SELECT doc_id, p, x.n, item_id
        FROM (SELECT doc_id, w, n, unnest(range(len(w) - n + 1)) AS p FROM d, sizes WHERE len(w) >= n) x
        JOIN win ON win.n = x.n AND win.s = array_to_string(w[p + 1 : p + x.n], ' ')),
words AS (SELECT doc_id, count(DISTINCT pos) AS n_hit FROM (SELECT doc_id, unnest(range(p, p + n)) AS pos FROM hit) GROUP BY doc_id),
items AS (SELECT doc_id, count(DISTINCT item_id) AS n_items, string_agg(DISTINCT CAST(item_id AS VARCHAR), ',' ORDER BY CAST(item_id AS VARCHAR)) AS s FROM hit GROUP BY doc_id)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
       sha256(coalesce(s, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN words USING (doc_id) LEFT JOIN items USING (doc_id)
""",
    "op4_exact_dedup": r"""
WITH n AS (SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS t FROM documents),
g AS (SELECT t, min(doc_id) AS keep_id, count(*) AS group_size FROM n GROUP BY t)
SELECT n.doc_id, keep_id, group_size, n.doc_id = keep_id AS kept, sha256(n.t) AS text_sha256 FROM n JOIN g ON n.t = g.t
""",
    "op6_substring_dedup": r"""
WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
win AS (SELECT doc_id, p, array_to_string(w[p : p + 34], ' ') AS s FROM (SELECT doc_id, w, unnest(range(1, len(w) - 33)) AS p FROM d WHERE len(w) >= 35)),
rep AS (SELECT doc_id, p FROM (SELECT doc_id, p, count(*) OVER (PARTITION BY s) AS c FROM win) WHERE c > 1),
word AS (SELECT doc_id, unnest(range(1, len(w) + 1)) AS p, unnest(w) AS x FROM d),
mark AS (SELECT word.doc_id, word.p, x, coalesce(max(rep.p) OVER (PARTITION BY word.doc_id ORDER BY word.p ROWS BETWEEN 34 PRECEDING AND CURRENT ROW), 0) > 0 AS gone
         FROM word LEFT JOIN rep ON rep.doc_id = word.doc_id AND rep.p = word.p),
kept AS (SELECT doc_id, count(*) FILTER (WHERE gone) AS n_removed, string_agg(x, ' ' ORDER BY p) FILTER (WHERE NOT gone) AS t FROM mark GROUP BY doc_id)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_removed, 0) AS BIGINT) AS n_removed, sha256(coalesce(t, '')) AS kept_sha256
FROM d LEFT JOIN kept USING (doc_id)
""",
    "op8_chat_collapse": chat_collapse.ORACLE,
    "op10_suffix_dedup": """
WITH d AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
byte AS (SELECT doc_id, unnest(range(len(h) // 2)) AS p, unnest(regexp_extract_all(h, '..')) AS x, len(h) // 2 AS n FROM d),
win AS (SELECT doc_id, unnest(range(len(h) // 2 - 99)) AS p, h FROM d WHERE len(h) >= 200),
txt AS (SELECT doc_id, p, substr(h, 2 * p + 1, 200) AS s FROM win),
rep AS (SELECT doc_id, p FROM (SELECT doc_id, p, row_number() OVER (PARTITION BY s ORDER BY doc_id, p) AS r FROM txt) WHERE r > 1),
mark AS (SELECT b.doc_id, b.p, x, coalesce(max(rep.p) OVER (PARTITION BY b.doc_id ORDER BY b.p ROWS BETWEEN 99 PRECEDING AND CURRENT ROW), -1) >= 0 AS gone
         FROM byte b LEFT JOIN rep ON rep.doc_id = b.doc_id AND rep.p = b.p),
edge AS (SELECT *, gone AND NOT coalesce(lag(gone) OVER (PARTITION BY doc_id ORDER BY p), false) AS opens FROM mark),
kept AS (SELECT doc_id, count(*) FILTER (WHERE gone) AS n_removed, count(*) FILTER (WHERE opens) AS n_spans, string_agg(x, '' ORDER BY p) FILTER (WHERE NOT gone) AS t FROM edge GROUP BY doc_id)
SELECT d.doc_id, CAST(len(h) // 2 AS BIGINT) AS n_bytes, CAST(coalesce(n_removed, 0) AS BIGINT) AS n_removed, CAST(coalesce(n_spans, 0) AS BIGINT) AS n_spans, sha256(unhex(coalesce(t, ''))) AS kept_sha256
FROM d LEFT JOIN kept USING (doc_id)
""",
    "op11_kd_clusters": vector_sql.clusters(),
    "op12_minmax_hash": r"""
WITH RECURSIVE t AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS MATERIALIZED (SELECT DISTINCT doc_id, array_to_string(w[p : p + 3], ' ') AS g FROM (SELECT doc_id, w, unnest(range(1, greatest(1, len(w) - 3) + 1)) AS p FROM t WHERE len(w) > 0)),
n AS MATERIALIZED (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
shared AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS k FROM s x JOIN s y ON x.g = y.g AND x.doc_id <> y.doc_id GROUP BY 1, 2),
link AS MATERIALIZED (SELECT a, b FROM shared JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * k >= 80 * (x.n + y.n - k)),
reach AS (SELECT a, b FROM link UNION SELECT r.a, l.b FROM reach r JOIN link l ON r.b = l.a),
least AS (SELECT a AS doc_id, min(b) AS b FROM reach GROUP BY a)
SELECT doc_id, CAST(coalesce(n, 0) AS BIGINT) AS n_shingles, least(doc_id, coalesce(b, doc_id)) AS component_id, doc_id = least(doc_id, coalesce(b, doc_id)) AS kept
FROM t LEFT JOIN n USING (doc_id) LEFT JOIN least USING (doc_id)
""",
    "op13_product_codes": vector_sql.codes(),
}
