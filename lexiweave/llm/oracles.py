"""DuckDB SQL for the queries that SQL can express: exact dedup (with its operator), sharding and quality rules."""

from __future__ import annotations

from .quality_rules import HOST_DEVIATIONS, HOST_LIMIT, MAX_DUP_LINES, MAX_SYMBOLS, MAX_WORD, MIN_WORD

#: CRC-32 from its rule: a table of 256 by eight shifts each, then a fold over the bytes.
OP8_SQL = """
WITH tab AS (
  SELECT list_transform(range(256), lambda b: list_reduce(list_prepend(b, range(8)), lambda c, k: CASE WHEN c % 2 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END)) AS t
), d AS (
  SELECT doc_id, text, coalesce(strlen(text), 0) + 1 AS size, row_number() OVER (ORDER BY doc_id) - 1 AS i, sum(coalesce(strlen(text), 0) + 1) OVER (ORDER BY doc_id) AS upto, sum(coalesce(strlen(text), 0) + 1) OVER () AS total FROM documents
), s AS (
  SELECT *, CAST(least(15, ((2 * (upto - size) + size) * 16) // (2 * total)) AS INT) AS shard FROM d
)
SELECT doc_id, CAST(size AS BIGINT) AS size,
  CAST(CASE WHEN size = 1 THEN 0 ELSE xor(list_reduce(list_prepend(4294967295, list_transform(range(size - 1), lambda k: CAST('0x' || substr(hex(encode(text)), CAST(2 * k + 1 AS INT), 2) AS BIGINT))), lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1])), 4294967295) END AS BIGINT) AS text_crc32,
  'bytes' AS law, shard, i - min(i) OVER (PARTITION BY shard) AS slot, CAST(NULL AS INT) AS grown_shard
FROM s, tab
"""

OP4_SQL = rf"""
WITH t AS (
  SELECT row_number() OVER () AS r, doc_id, coalesce('h' || source, 'null') AS host, coalesce(text, '') AS x FROM documents
), w AS (
  SELECT *, list_filter(string_split_regex(x, '[\x20\x09-\x0D]+'), lambda v: v <> '') AS ws, list_filter(string_split(x, chr(10)), lambda v: regexp_matches(v, '[^\x20\x09-\x0D]')) AS ls FROM t
), g AS (
  SELECT r, unnest(range(1, len(ws) - 1)) AS i, unnest(list_transform(range(1, len(ws) - 1), lambda i: ws[i] || ' ' || ws[i + 1] || ' ' || ws[i + 2])) AS gram FROM w WHERE len(ws) >= 3
), twice AS (
  SELECT r, i FROM (SELECT r, i, count(*) OVER (PARTITION BY r, gram) AS n FROM g) WHERE n > 1
), covered AS (
  SELECT r, CAST(sum(c) AS BIGINT) AS n_repeat_words FROM (SELECT r, least(3, coalesce(lead(i) OVER (PARTITION BY r ORDER BY i) - i, 3)) AS c FROM twice) GROUP BY r
), f AS (
  SELECT r, doc_id, host, CAST(len(ws) AS BIGINT) AS n_words, CAST(coalesce(list_sum(list_transform(ws, lambda v: length(v))), 0) AS BIGINT) AS word_chars, CAST(length(regexp_replace(x, '[^#*$%&|<>]+', '', 'g')) AS BIGINT) AS n_symbols,
    CAST(len(ls) - len(list_distinct(ls)) AS BIGINT) AS n_dup_lines, coalesce(n_repeat_words, 0) AS n_repeat_words FROM w LEFT JOIN covered USING (r)
), b AS (
  SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM f
), j AS (
  SELECT *, base_failed OR n_symbols > {MAX_SYMBOLS} * n_words OR n_dup_lines > {MAX_DUP_LINES} * n_words OR NOT (word_chars / greatest(n_words, 1) BETWEEN {MIN_WORD} AND {MAX_WORD}) AS failed FROM b
), h AS (
  SELECT host, count(*)::DOUBLE AS n, count(*) FILTER (failed)::DOUBLE AS k FROM j GROUP BY host
), p AS (
  SELECT (sum(k) + 0.5) / (sum(n) + 1) AS m, greatest(count(*) - 1, 0) AS free, sum(n) AS n, sum(n * n) AS nn FROM h
), q AS (
  SELECT m, 1 / least(greatest(CASE WHEN free > 0 THEN ((SELECT sum(n * (k / n - (SELECT m FROM p)) ** 2) FROM h) / (m * (1 - m)) - free) / greatest(n - nn / n - free, 1e-9) ELSE 0.5 END, 1e-4), 0.5) - 1 AS s FROM p
), v AS (
  SELECT host, (k + m * s) / (n + s) AS rate, n + s AS weight FROM h, q
)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND NOT (rate - {HOST_DEVIATIONS} * sqrt(rate * (1 - rate) / (weight + 1)) > {HOST_LIMIT}) AS kept, round(rate, 6) AS host_rate
FROM j JOIN v USING (host)
"""

#: Prefixes as lists of turns; subtrees through each node's prefixes. CRC-32 as above, of the digits of conv_id.
OP13_SQL = r"""
WITH tab AS (
  SELECT list_transform(range(256), lambda b: list_reduce(list_prepend(b, range(8)), lambda c, k: CASE WHEN c % 2 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END)) AS t
), own AS (
  SELECT conv_id, list({'role': coalesce(role, ''), 'text': coalesce(text, '')} ORDER BY turn NULLS FIRST) AS turns FROM conversations WHERE conv_id IS NOT NULL GROUP BY conv_id
), h AS (
  SELECT conv_id, turns, xor(list_reduce(list_prepend(4294967295, list_transform(range(length(CAST(conv_id AS VARCHAR))), lambda k: CAST(ascii(substr(CAST(conv_id AS VARCHAR), CAST(k + 1 AS INT), 1)) AS BIGINT))), lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1])), 4294967295) % 4 AS h FROM own, tab
), built AS (
  SELECT h.conv_id, list_concat(coalesce(b.turns, [])[:h.h], h.turns[h.h + 1:]) AS path FROM h LEFT JOIN own b ON b.conv_id = h.conv_id - h.conv_id % 20
), member AS (
  SELECT conv_id, path, unnest(range(len(path) + 1)) AS depth FROM built
), node AS (
  SELECT path[:depth] AS p, depth, min(conv_id) AS conv_id, count(*) AS n_convs, sha256(coalesce(string_agg(CAST(conv_id AS VARCHAR), ',' ORDER BY conv_id) FILTER (len(path) = depth), '')) AS ends_sha256 FROM member GROUP BY ALL
), counted AS (
  SELECT n.*, coalesce(k.n_children, 0) AS n_children, CASE WHEN n.depth = 0 THEN 0 ELSE (n.n_convs - 1) * len(list_filter(string_split_regex(p[n.depth].text, '[\x20\x09-\x0D]+'), lambda w: w <> '')) END AS own_saved
  FROM node n LEFT JOIN (SELECT p[:depth - 1] AS q, count(*) AS n_children FROM node WHERE depth > 0 GROUP BY 1) k ON k.q = n.p
), up AS (
  SELECT p[:d] AS q, count(*) FILTER (n_children = 0) AS n_leaves, sum(own_saved) AS saved_tokens FROM (SELECT *, unnest(range(depth + 1)) AS d FROM counted) GROUP BY 1
)
SELECT c.conv_id, c.depth, parent.conv_id AS parent_conv_id, c.n_convs, c.n_children, up.n_leaves, CAST(up.saved_tokens AS BIGINT) AS saved_tokens, c.ends_sha256
FROM counted c JOIN up ON up.q = c.p LEFT JOIN node parent ON c.depth > 0 AND parent.p = c.p[:c.depth - 1]
"""
