"""DuckDB SQL of the queries that SQL can express."""

from __future__ import annotations

from ripecast.llm import centroid_clustering, importance_resampling, mixing, queries

MIXING = f"""
WITH sizes AS (
  SELECT coalesce(source, '') AS k, sum(coalesce(strlen(text), 0)) AS bytes FROM documents GROUP BY 1),
weighted AS (SELECT k, bytes, pow(CAST(bytes AS DOUBLE), {mixing.TEMPER}) AS w FROM sizes),
totals AS (SELECT sum(bytes) AS b, CAST(sum(CAST(w AS DECIMAL(28,6))) AS DOUBLE) AS w FROM weighted WHERE bytes > 0),
rates AS (
  SELECT k, CASE WHEN bytes > 0 THEN weighted.w / totals.w * totals.b / bytes ELSE 0 END AS rate FROM weighted, totals),
terms AS (SELECT k, rate, unnest(range(0, CAST(ceil(rate + 12 * sqrt(rate) + 30) AS INT) + 1)) AS n FROM rates),
logs AS (
  SELECT k, rate, n, CASE WHEN rate > 0 THEN exp(n * ln(rate) - rate
    - sum(CASE WHEN n > 0 THEN ln(CAST(n AS DOUBLE)) ELSE 0 END) OVER (PARTITION BY k ORDER BY n)) WHEN n = 0 THEN 1 ELSE 0 END AS p
  FROM terms),
steps AS (SELECT k, rate, n, sum(p) OVER (PARTITION BY k ORDER BY n) AS c FROM logs),
lists AS (SELECT k, rate, list(c ORDER BY n) AS steps FROM steps GROUP BY 1, 2),
counted AS (
  SELECT doc_id, source, rate, coalesce(CAST(doc_id AS VARCHAR), '') AS ident,
    CAST(len([c for c in steps if c <= u]) AS INT) AS repeats
  FROM (SELECT *, CAST('0x' || substr(md5('{mixing.SEED}:' || coalesce(CAST(doc_id AS VARCHAR), '')), 1, 13) AS BIGINT)
      / 4503599627370496.0 AS u FROM documents) d JOIN lists ON coalesce(source, '') = k)
SELECT doc_id, source, repeats, CAST(r AS INT) AS replica, round(rate, 6) AS rate,
  CAST('0x' || substr(md5('{mixing.SEED}:' || r || ':' || ident), 1, 15) AS BIGINT) AS shuffle_key
FROM (SELECT *, unnest(range(1, repeats + 1)) AS r FROM counted WHERE repeats > 0)
"""

URL_FILTER = f"""
WITH hosted AS (
  SELECT page_id, url, DATE '{queries.FIRST_DAY}' + CAST(((page_id % {queries.DAYS}) + {queries.DAYS}) % {queries.DAYS} AS INT) AS fetched_on,
    nullif(lower(rtrim(regexp_extract(coalesce(url, ''), '^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:@]+)', 1), '.')), '') AS host
  FROM pages),
hosts AS (SELECT DISTINCT host FROM hosted WHERE host IS NOT NULL),
patterns AS (
  SELECT DISTINCT unnest([host, array_to_string(list_slice(string_split(host, '.'), -3, len(string_split(host, '.'))), '.')]) AS pattern FROM hosts),
h AS (SELECT pattern, md5(pattern) AS h FROM patterns),
n AS (
  SELECT pattern, CAST('0x' || h[1:2] AS INT) AS listed, CAST('0x' || h[2:2] AS INT) % 3 AS cat,
    DATE '{queries.FIRST_DAY}' + CAST('0x' || h[3:5] AS INT) % 500 AS d1,
    CAST('0x' || h[6:7] AS INT) + 1 AS s2, CAST('0x' || h[8:9] AS INT) + 1 AS s3, CAST('0x' || h[10:10] AS INT) AS kind FROM h),
spans AS (
  SELECT pattern, ['adult', 'spam', 'malware'][cat + 1] AS category, d1 AS valid_from,
    CASE WHEN kind < 8 THEN d1 + s2 ELSE DATE '9999-12-31' END AS valid_to FROM n WHERE listed < 96
  UNION ALL
  SELECT pattern, ['adult', 'spam', 'malware'][cat + 1], d1 + s2 + s3, DATE '9999-12-31' FROM n WHERE listed < 96 AND kind < 4),
asked AS (
  SELECT host, fetched_on, pattern FROM (SELECT DISTINCT host, fetched_on FROM hosted WHERE host IS NOT NULL),
    LATERAL (SELECT unnest([array_to_string(list_slice(string_split(host, '.'), i, len(string_split(host, '.'))), '.')
      for i in range(1, greatest(len(string_split(host, '.')) - 1, 1) + 1)]) AS pattern)),
verdicts AS (
  SELECT host, fetched_on, string_agg(DISTINCT category, ',' ORDER BY category) AS categories,
    max({{'n': length(pattern), 'p': pattern, 'f': valid_from}}) AS best
  FROM asked JOIN spans USING (pattern) WHERE valid_from <= fetched_on AND fetched_on < valid_to GROUP BY 1, 2)
SELECT page_id, fetched_on, host, best IS NOT NULL AS blocked, categories, best.p AS pattern, best.f AS listed_on
FROM hosted LEFT JOIN verdicts USING (host, fetched_on)
"""

EXACT = r"""
WITH d AS (SELECT doc_id, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g')) AS text_sha256 FROM documents),
g AS (SELECT *, min(doc_id) OVER same AS keep_id, count(*) OVER same AS group_size,
    row_number() OVER (PARTITION BY text_sha256 ORDER BY doc_id NULLS LAST) AS place
  FROM d WINDOW same AS (PARTITION BY text_sha256))
SELECT doc_id, keep_id, group_size, place = 1 AS kept, text_sha256 FROM g
"""

_CRC = """list_reduce(list_concat([4294967295], [CAST('0x' || substr(hex(w), 2 * i + 1, 2) AS BIGINT) for i in range(strlen(w))]),
    lambda c, b: list_reduce(list_concat([xor(c, b)], range(8)), lambda x, i: xor(x >> 1, 3988292384 * (x & 1))))"""

RESAMPLING = f"""
WITH found AS (
  SELECT 0 AS side, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS ws FROM documents
  UNION ALL
  SELECT 1, item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') FROM benchmark),
used AS (SELECT side, doc_id, unnest(ws) AS w FROM found),
buckets AS (SELECT w, xor({_CRC}, 4294967295) % {importance_resampling.BUCKETS} AS bucket FROM (SELECT DISTINCT w FROM used)),
totals AS (SELECT bucket, count(*) FILTER (side = 0) AS s, count(*) FILTER (side = 1) AS t FROM used JOIN buckets USING (w) GROUP BY 1),
sums AS (SELECT CAST(coalesce(sum(s), 0) + {importance_resampling.BUCKETS} AS DOUBLE) AS s, CAST(coalesce(sum(t), 0) + {importance_resampling.BUCKETS} AS DOUBLE) AS t FROM totals),
gains AS (SELECT bucket, CAST(floor(1000 * ln((totals.t + 1) * sums.s / ((totals.s + 1) * sums.t))) AS BIGINT) AS gain FROM totals, sums),
weighed AS (
  SELECT doc_id, CAST(sum(gain) AS BIGINT) AS weight FROM used JOIN buckets USING (w) JOIN gains USING (bucket) WHERE side = 0 GROUP BY 1),
scored AS (
  SELECT doc_id, CAST(len(ws) AS BIGINT) AS n_features, coalesce(weight, 0) AS weight,
    coalesce(weight, 0) + CAST(floor(-1000 * ln(-ln((CAST('0x' || substr(sha256('{importance_resampling.SEED}:' || doc_id), 1, 8) AS BIGINT) + 0.5::DOUBLE)
      / 4294967296::DOUBLE))) AS BIGINT) AS score
  FROM found LEFT JOIN weighed USING (doc_id) WHERE side = 0),
ranked AS (
  SELECT doc_id, row_number() OVER (ORDER BY score DESC, doc_id) AS rank, count(*) OVER () AS n
  FROM scored WHERE n_features >= {importance_resampling.LEAST_WORDS})
SELECT scored.*, CASE WHEN rank <= n * {importance_resampling.PERCENT} // 100 THEN rank END AS rank FROM scored LEFT JOIN ranked USING (doc_id)
"""


def _clustering() -> str:
    """Every round as two expressions: nearest centroids by integer-valued dot products, then floors of means."""
    steps = [f"""
whole AS (
  SELECT vec_id, [floor({centroid_clustering.SCALE} * CAST(x AS DOUBLE)) for x in embedding] AS v FROM embeddings
  WHERE len(embedding) = {centroid_clustering.DIMENSIONS} AND len([x for x in embedding if x IS NOT NULL AND isfinite(x)]) = {centroid_clustering.DIMENSIONS}),
vectors AS MATERIALIZED (SELECT vec_id, v, list_inner_product(v, v) AS vv FROM whole),
c0 AS MATERIALIZED (
  SELECT CAST(row_number() OVER (ORDER BY sha256('{centroid_clustering.SEED}:' || vec_id)) - 1 AS INT) AS cluster, v AS c FROM vectors
  ORDER BY sha256('{centroid_clustering.SEED}:' || vec_id) LIMIT {centroid_clustering.CLUSTERS})"""]
    for k in range(centroid_clustering.ROUNDS + 1):
        steps.append(f"""
a{k} AS MATERIALIZED (
  SELECT vec_id, any_value(v) AS v, min(CAST(vv - 2 * list_inner_product(v, c) + list_inner_product(c, c) AS BIGINT) * 4096 + cluster) AS best
  FROM vectors CROSS JOIN c{k} GROUP BY vec_id)""")
        if k < centroid_clustering.ROUNDS:
            steps.append(f"""
m{k} AS (
  SELECT cluster, list(m ORDER BY i) AS c FROM (
    SELECT best % 4096 AS cluster, i, floor(sum(CAST(x AS HUGEINT)) / count(*)::DOUBLE) AS m
    FROM (SELECT best, unnest(v) AS x, generate_subscripts(v, 1) AS i FROM a{k}) GROUP BY 1, 2) GROUP BY 1),
c{k + 1} AS MATERIALIZED (SELECT cluster, coalesce(m{k}.c, c{k}.c) AS c FROM c{k} LEFT JOIN m{k} USING (cluster))""")
    last = centroid_clustering.ROUNDS
    return "WITH " + ",".join(steps) + f"""
SELECT vec_id, cluster, distance, CAST(sum(distance) OVER (PARTITION BY cluster) AS BIGINT) AS cluster_inertia,
  CAST(sum(distance) OVER () AS BIGINT) AS inertia, centroid_sha256
FROM (SELECT vec_id, CAST(best % 4096 AS INT) AS cluster, best // 4096 AS distance FROM a{last})
JOIN (SELECT cluster, sha256(array_to_string([CAST(x AS BIGINT) for x in c], ',')) AS centroid_sha256 FROM c{last}) USING (cluster)
"""


STATEMENTS = {
    "op7_mixing": MIXING, "op10_url_filter": URL_FILTER, "op11_exact_dedup": EXACT, "op12_importance_resampling": RESAMPLING,
    "op13_centroid_clustering": _clustering(),
}
