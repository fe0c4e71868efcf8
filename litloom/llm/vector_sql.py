"""SQL of the clustering and of the vector codes, for the comparison with DuckDB: a common table a round, made by rule."""

#: Squared distance of lists of whole doubles, and floor(s / n) of integers.
_APART = "list_inner_product(v.q, v.q) - 2 * list_inner_product(v.q, c.q) + list_inner_product(c.q, c.q)"
_FLOOR = "CAST((s - ((s % n) + n) % n) // n AS DOUBLE)"


def _whole(scale: int, more: str, where: str) -> str:
    return f"""
rows AS MATERIALIZED (SELECT vec_id, {more} list_transform(embedding, lambda x: floor({scale} * CAST(x AS DOUBLE))) AS q FROM embeddings
         WHERE embedding IS NOT NULL AND {where} AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = len(embedding))"""


def clusters(dimensions: int = 64, scale: int = 256, k: int = 40, rounds: int = 5, seed: int = 2) -> str:
    name = f"sha256('{seed}:' || CAST(vec_id AS VARCHAR))"
    out = ["WITH" + _whole(scale, "", f"len(embedding) = {dimensions}"), f"c0 AS MATERIALIZED (SELECT row_number() OVER (ORDER BY {name}) - 1 AS c, q FROM rows QUALIFY c < {k})"]
    for i in range(rounds + 1):
        out.append(f"a{i} AS MATERIALIZED (SELECT vec_id, any_value(v.q) AS q, min(ROW({_APART}, c.c)) AS best FROM rows v, c{i} c GROUP BY vec_id)")
        if i < rounds:
            out.append(f"s{i} AS (SELECT c, pos, CAST(sum(x) AS HUGEINT) AS s, count(*) AS n FROM (SELECT best[2] AS c, unnest(q) AS x, unnest(range({dimensions})) AS pos FROM a{i}) GROUP BY c, pos)")
            out.append(f"m{i} AS (SELECT c, list({_FLOOR} ORDER BY pos) AS q FROM s{i} GROUP BY c)")
            out.append(f"c{i + 1} AS MATERIALIZED (SELECT c.c, coalesce(m.q, c.q) AS q FROM c{i} c LEFT JOIN m{i} m USING (c))")
    last = f"""
SELECT vec_id, CAST(best[2] AS INTEGER) AS cluster, CAST(best[1] AS BIGINT) AS distance, CAST(sum(best[1]) OVER (PARTITION BY best[2]) AS BIGINT) AS cluster_inertia,
       CAST(sum(best[1]) OVER () AS BIGINT) AS inertia, sha256(array_to_string(list_transform(c.q, lambda x: CAST(x AS BIGINT)), ',')) AS centroid_sha256
FROM a{rounds} a JOIN c{rounds} c ON c.c = best[2]"""
    return ",\n".join(out) + last


def codes(parts: int = 4, width: int = 16, entries: int = 256, rounds: int = 4, scale: int = 1024) -> str:
    out = [
        "WITH" + _whole(scale, "label,", f"len(embedding) = {parts * width}"),
        f"cut AS MATERIALIZED (SELECT vec_id, label, p, q[p * {width} + 1 : (p + 1) * {width}] AS q FROM (SELECT vec_id, label, q, unnest(range({parts})) AS p FROM rows))",
        f"c0 AS MATERIALIZED (SELECT p, row_number() OVER (PARTITION BY p ORDER BY vec_id) - 1 AS e, q FROM cut QUALIFY e < {entries})",
    ]
    for i in range(rounds + 1):
        out.append(f"a{i} AS MATERIALIZED (SELECT vec_id, any_value(label) AS label, v.p, any_value(v.q) AS q, min(ROW({_APART}, c.e)) AS best FROM cut v JOIN c{i} c ON c.p = v.p GROUP BY vec_id, v.p)")
        if i < rounds:
            out.append(f"s{i} AS (SELECT p, e, pos, CAST(sum(x) AS HUGEINT) AS s, count(*) AS n FROM (SELECT p, best[2] AS e, unnest(q) AS x, unnest(range({width})) AS pos FROM a{i}) GROUP BY p, e, pos)")
            out.append(f"m{i} AS (SELECT p, e, list({_FLOOR} ORDER BY pos) AS q FROM s{i} GROUP BY p, e)")
            out.append(f"c{i + 1} AS MATERIALIZED (SELECT c.p, c.e, coalesce(m.q, c.q) AS q FROM c{i} c LEFT JOIN m{i} m ON m.p = c.p AND m.e = c.e)")
    last = f""",
one AS (SELECT vec_id, any_value(label) AS label, string_agg(printf('%02x', best[2]), '' ORDER BY p) AS code, CAST(sum(best[1]) AS BIGINT) AS error FROM a{rounds} GROUP BY vec_id),
book AS (SELECT sha256(string_agg(array_to_string(list_transform(q, lambda x: CAST(x AS BIGINT)), ','), ',' ORDER BY p, e)) AS h FROM c{rounds})
SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error, h AS codebooks_sha256 FROM one, book"""
    return ",\n".join(out) + last
