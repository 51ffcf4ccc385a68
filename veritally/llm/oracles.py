"""SQL (for DuckDB) of the corpus queries that SQL can express, by brute force."""

from __future__ import annotations

from .chat import OP13_SQL
from .lines import OP9_SQL

_WORDS = r"SELECT doc_id, coalesce(regexp_extract_all(text, '[^\x20\x09-\x0D]+'), []) AS ws FROM documents"

OP1_SQL = f"""
WITH RECURSIVE w AS ({_WORDS}),
s AS (
  SELECT DISTINCT doc_id, array_to_string(ws[i:i + 4], ' ') AS k FROM (SELECT doc_id, ws, unnest(range(1, greatest(len(ws) - 3, 2))) AS i FROM w WHERE len(ws) > 0)
), n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
c AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM s a JOIN s b ON a.k = b.k AND a.doc_id < b.doc_id GROUP BY ALL),
e AS (SELECT a, b FROM c JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE c / (x.n + y.n - c) >= 0.8),
l AS (SELECT a, b FROM e UNION ALL SELECT b, a FROM e),
r(a, b) AS (SELECT doc_id, doc_id FROM documents UNION SELECT r.a, l.b FROM r JOIN l ON r.b = l.a)
SELECT a AS doc_id, min(b) AS component_id, a = min(b) AS kept FROM r GROUP BY a
"""

OP7_SQL = f"""
WITH w AS ({_WORDS}),
p AS (SELECT doc_id, i, array_to_string(ws[i:i + 12], ' ') AS k FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 11)) AS i FROM w WHERE len(ws) > 12)),
f AS (SELECT k, min(doc_id) AS m FROM p GROUP BY k),
h AS (SELECT p.doc_id, i FROM p JOIN f USING (k) WHERE m < p.doc_id),
g AS (SELECT doc_id, list(DISTINCT i + d) AS gone FROM h CROSS JOIN range(13) AS t(d) GROUP BY doc_id)
SELECT doc_id, len(ws) AS n_words, coalesce(len(gone), 0) AS n_removed,
  sha256(coalesce(array_to_string(list_filter(ws, lambda x, i: NOT list_contains(coalesce(gone, []), i)), ' '), '')) AS kept_sha256
FROM w LEFT JOIN g USING (doc_id)
"""

OP8_SQL = """
WITH RECURSIVE v AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS x FROM embeddings),
ok AS (SELECT * FROM v WHERE len(x) > 0 AND len(list_filter(x, lambda c: c IS NULL OR NOT isfinite(c))) = 0 AND list_max(list_transform(x, lambda c: abs(c))) > 0),
l AS (SELECT a.vec_id AS a, b.vec_id AS b FROM ok a JOIN ok b ON a.vec_id <> b.vec_id AND len(a.x) = len(b.x) AND list_cosine_similarity(a.x, b.x) >= 0.95),
r(a, b) AS (SELECT vec_id, vec_id FROM v UNION SELECT r.a, l.b FROM r JOIN l ON r.b = l.a),
n AS (SELECT a, count(*) AS n FROM l GROUP BY a)
SELECT r.a AS vec_id, coalesce(any_value(n.n), 0) AS n_links, min(r.b) AS component_id, r.a = min(r.b) AS kept FROM r LEFT JOIN n ON n.a = r.a GROUP BY r.a
"""

ORACLE_SQL = {"op1_minhash": OP1_SQL, "op7_substring": OP7_SQL, "op8_embeddings": OP8_SQL, "op9_lines": OP9_SQL, "op13_chat": OP13_SQL}
