"""DuckDB SQL of the queries that SQL can express (that of op4 stands with its rules)."""

#: Base 32 of SHA-1: eight groups of 20 bits, four characters each.
OP3_SQL = """
WITH p AS (SELECT page_id, coalesce(html, '') AS body FROM pages),
h AS (SELECT page_id, cast(octet_length(encode(body)) AS bigint) AS payload_bytes, sha1(body) AS hex, max(page_id) OVER (PARTITION BY body) AS r FROM p),
d AS (SELECT *, array_to_string(list_transform(range(32), lambda k:
        substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
               1 + cast((cast('0x' || substr(hex, 1 + 5 * (k // 4), 5) AS bigint) >> (15 - 5 * (k % 4))) & 31 AS bigint), 1)), '') AS payload_digest FROM h)
SELECT page_id, payload_bytes, payload_digest, CASE WHEN r = page_id THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN r <> page_id THEN r END AS refers_to FROM d
"""

#: All pairs of documents that share a shingle, and the closure of their links.
OP1_SQL = r"""
WITH RECURSIVE w AS MATERIALIZED (
  SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                             '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws FROM documents),
s AS MATERIALIZED (
  SELECT doc_id, unnest(list_distinct(list_transform(range(greatest(1, len(ws) - 3)), lambda i: array_to_string(ws[i + 1:i + 4], ' ')))) AS sh
  FROM w WHERE len(ws) > 0),
n AS MATERIALIZED (SELECT doc_id, count(*) AS n FROM s GROUP BY 1),
pairs AS MATERIALIZED (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS k FROM s a JOIN s b ON a.sh = b.sh AND a.doc_id <> b.doc_id GROUP BY 1, 2),
links AS MATERIALIZED (
  SELECT a, b FROM pairs JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * k >= 80 * (x.n + y.n - k)),
reach(a, b) AS (SELECT a, b FROM links UNION SELECT r.a, l.b FROM reach r JOIN links l ON r.b = l.a),
c AS (SELECT a, min(b) AS b FROM reach GROUP BY 1)
SELECT w.doc_id, coalesce(n.n, 0) AS n_shingles, least(w.doc_id, coalesce(c.b, w.doc_id)) AS component_id,
       w.doc_id = least(w.doc_id, coalesce(c.b, w.doc_id)) AS kept
FROM w LEFT JOIN n ON n.doc_id = w.doc_id LEFT JOIN c ON c.a = w.doc_id
"""
