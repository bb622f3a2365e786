"""DuckDB SQL for the queries that SQL can express."""

from __future__ import annotations

ORACLES: dict[str, str] = {}

ORACLES["op1_exact_top_k"] = """
WITH c AS (SELECT vec_id, generate_subscripts(embedding, 1) AS i, unnest(embedding) AS x FROM embeddings),
bad AS (SELECT DISTINCT vec_id FROM c WHERE x IS NULL OR isnan(x) OR isinf(x)),
w AS (SELECT vec_id, i, CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT) AS x FROM c WHERE vec_id NOT IN (SELECT vec_id FROM bad)),
s AS (SELECT q.vec_id AS query_id, r.vec_id AS vec_id, CAST(sum(q.x * r.x) AS BIGINT) AS score FROM w q JOIN w r ON q.i = r.i AND q.vec_id <> r.vec_id
 WHERE q.vec_id % 50 = 0 GROUP BY 1, 2),
o AS (SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS "rank", vec_id, score FROM s)
SELECT * FROM o WHERE "rank" <= 5
"""

_RECORD = """'WARC/1.1' || chr(13) || chr(10) || 'WARC-Type: resource' || chr(13) || chr(10) || 'WARC-Target-URI: ' || coalesce(url, '') || chr(13) || chr(10) || 'WARC-Record-ID: <urn:page:'
 || CAST(page_id AS VARCHAR) || '>' || chr(13) || chr(10) || 'Content-Type: text/html' || chr(13) || chr(10) || 'Content-Length: ' || CAST(strlen(coalesce(html, '')) AS VARCHAR)
 || chr(13) || chr(10) || chr(13) || chr(10) || coalesce(html, '') || chr(13) || chr(10) || chr(13) || chr(10)"""

ORACLES["op3_merkle_fixity"] = f"""
WITH one AS (SELECT page_id, {_RECORD} AS rec FROM pages WHERE page_id IS NOT NULL),
lost AS (SELECT page_id, page_id % 211 = 3 AS gone, page_id % 409 = 9 AS moved, page_id % 397 = 5 OR page_id % 401 = 7 AS cut FROM pages),
other AS (SELECT -1 - page_id AS page_id, url, CASE WHEN page_id % 397 = 5 THEN left(html, greatest(length(html) - 1, 0)) WHEN page_id % 401 = 7 THEN html || 'x' ELSE html END AS html
 FROM pages WHERE page_id % 211 <> 3 AND page_id % 409 = 9),
extra AS (SELECT page_id, {_RECORD} AS rec FROM other),
state AS (SELECT page_id, CASE WHEN gone OR moved THEN 'missing' WHEN cut THEN 'changed' ELSE 'intact' END AS state FROM lost),
leaves AS (SELECT page_id, rec, 0 AS side FROM one UNION ALL SELECT page_id, rec, 1 AS side FROM extra),
placed AS (SELECT side, page_id, CAST(floor(page_id / 1024.0) AS BIGINT) AS archive, CAST(strlen(rec) AS BIGINT) AS length, sha256(rec) AS digest FROM leaves)
SELECT p.page_id, p.archive, CAST(coalesce(sum(p.length) OVER (PARTITION BY p.side, p.archive ORDER BY p.page_id, p.digest ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS start,
 p.length, p.digest, CAST(1 AS BIGINT) AS copies, coalesce(s.state, 'extra') AS state
FROM placed p LEFT JOIN state s ON p.page_id = s.page_id
"""
