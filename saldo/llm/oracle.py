"""SQL of the operators that SQL can express, for DuckDB."""

from __future__ import annotations

#: From and to for ASCII letters without case.
ALPHA = "'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'"
OP11 = rf"""
WITH steps AS (
  SELECT list(list_reduce([n, 0, 0, 0, 0, 0, 0, 0, 0], lambda c, _: xor(c >> 1, 3988292384 * (c & 1))) ORDER BY n) AS shift
  FROM (SELECT CAST(unnest(range(256)) AS BIGINT) AS n)
), tokens AS (
  SELECT row_number() OVER () AS r, doc_id, from_documents, regexp_extract_all(translate(coalesce(text, ''), {ALPHA}), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM (SELECT doc_id, text, TRUE AS from_documents FROM documents UNION ALL SELECT NULL, text, FALSE FROM benchmark)
), features AS (
  SELECT r, unnest(list_concat(w,
    list_transform(range(1, greatest(len(w), 1)), lambda i: w[i] || ' ' || w[i + 1]),
    list_transform(range(1, greatest(len(w) - 1, 1)), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2]))) AS f
  FROM tokens
), hashed AS (
  SELECT f, xor(4294967295, list_reduce(list_concat([4294967295],
      list_transform(regexp_extract_all(hex(encode(f)), '..'), lambda h: CAST('0x' || h AS BIGINT))),
    lambda c, b: xor(shift[(xor(c, b) & 255) + 1], c >> 8))) % 10000 AS bucket
  FROM (SELECT DISTINCT f FROM features), steps
), counted AS (
  SELECT r, bucket, count(*) AS n FROM features JOIN hashed USING (f) GROUP BY ALL
), totals AS (
  SELECT bucket, coalesce(sum(n) FILTER (WHERE from_documents), 0) AS s, coalesce(sum(n) FILTER (WHERE NOT from_documents), 0) AS t
  FROM counted JOIN tokens USING (r) GROUP BY bucket
), gains AS (
  SELECT bucket, CAST(floor(1000 * ln(CAST(t + 1 AS DOUBLE) * CAST(sum(s) OVER () + 10000 AS DOUBLE)
    / (CAST(s + 1 AS DOUBLE) * CAST(sum(t) OVER () + 10000 AS DOUBLE)))) AS BIGINT) AS gain
  FROM totals
), weighed AS (
  SELECT r, sum(n) AS n_features, sum(n * gain) AS weight FROM counted JOIN gains USING (bucket) GROUP BY r
), scored AS (
  SELECT doc_id, r, len(w) >= 20 AS eligible, CAST(coalesce(n_features, 0) AS BIGINT) AS n_features, CAST(coalesce(weight, 0) AS BIGINT) AS weight,
    CAST(coalesce(weight, 0) + floor(-1000 * ln(-ln((CAST('0x' || sha256('42:' || coalesce(CAST(doc_id AS VARCHAR), ''))[1:8] AS BIGINT) + 0.5::DOUBLE) / 4294967296))) AS BIGINT) AS score
  FROM tokens LEFT JOIN weighed USING (r) WHERE from_documents
), placed AS (
  SELECT *, row_number() OVER (PARTITION BY eligible ORDER BY score DESC, doc_id) AS place, count(*) OVER (PARTITION BY eligible) AS n FROM scored
)
SELECT doc_id, n_features, weight, score, CASE WHEN eligible AND place <= 5 * n // 100 THEN place END AS rank FROM placed
"""
OP12 = rf"""
WITH docs AS (
  SELECT row_number() OVER () AS r, doc_id, string_split(coalesce(text, ''), chr(10)) AS parts FROM documents
), lines AS (
  SELECT r, doc_id, unnest(parts) AS line, unnest(range(len(parts))) AS i FROM docs
), keyed AS (
  SELECT *, translate(regexp_replace(line, '^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+$', '', 'g'), {ALPHA}) AS key FROM lines
), common AS (
  SELECT key FROM keyed WHERE length(key) >= 1 GROUP BY key HAVING count(DISTINCT r) >= 10
)
SELECT doc_id, count(*) AS n_lines, count(common.key) AS n_dropped,
  sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (WHERE common.key IS NULL), '')) AS kept_sha256
FROM keyed LEFT JOIN common USING (key) GROUP BY r, doc_id
"""


def _rounds(n: int) -> str:
    """Assignments a1 to an and the codebooks between them."""
    gap = "list_sum(list_transform(list_zip(x, c), lambda z: (z[1] - z[2]) * (z[1] - z[2])))"
    out = ""
    for k in range(1, n + 1):
        out += rf""", a{k} AS MATERIALIZED (
  SELECT vec_id, p, x, min({gap} * 64 + e) AS best
  FROM parts JOIN b{k-1} USING (p) GROUP BY vec_id, p, x
)"""
        if k < n:
            out += rf""", m{k} AS (
  SELECT p, best % 64 AS e, unnest(x) AS y, unnest(range(len(x))) AS i FROM a{k}
), s{k} AS (
  SELECT p, e, i, CAST(sum(y) AS BIGINT) AS s, count(*) AS n FROM m{k} GROUP BY p, e, i
), b{k} AS MATERIALIZED (
  SELECT p, e, coalesce(g.c, b{k-1}.c) AS c FROM b{k-1}
  LEFT JOIN (SELECT p, e, list((s - ((s % n) + n) % n) // n ORDER BY i) AS c FROM s{k} GROUP BY p, e) AS g USING (p, e)
)"""
    return out


OP13 = rf"""
WITH kept AS (
  SELECT vec_id, label, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS v
  FROM embeddings WHERE len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), parts AS MATERIALIZED (
  SELECT vec_id, p, v[p * (len(v) // 16) + 1 : (p + 1) * (len(v) // 16)] AS x FROM kept, range(16) AS t(p)
), b0 AS MATERIALIZED (
  SELECT p, e, x AS c FROM parts JOIN (SELECT vec_id, row_number() OVER (ORDER BY vec_id) - 1 AS e FROM kept QUALIFY e < 64) USING (vec_id)
){_rounds(3)}, coded AS (
  SELECT vec_id, string_agg(format('{{:02x}}', best % 64), '' ORDER BY p) AS code, CAST(sum(best // 64) AS BIGINT) AS error FROM a3 GROUP BY vec_id
), book AS (
  SELECT sha256(string_agg(array_to_string(c, ','), ',' ORDER BY p, e)) AS codebooks_sha256 FROM b2
)
SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error, codebooks_sha256
FROM coded JOIN kept USING (vec_id), book
"""
