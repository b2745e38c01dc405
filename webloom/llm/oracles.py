"""DuckDB SQL for the queries whose operators SQL can put in its own, quadratic way."""

#: Every 200-byte string of every text, counted.
SUFFIX_DEDUP = """
WITH d AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
w AS (SELECT doc_id, i, md5_number(substring(h, 2 * i + 1, 400)) AS k FROM (SELECT doc_id, h, unnest(range(0, len(h) // 2 - 199)) AS i FROM d WHERE len(h) >= 400)),
r AS (SELECT doc_id, i FROM w JOIN (SELECT k FROM w GROUP BY k HAVING count(*) > 1) USING (k)),
g AS (SELECT doc_id, i, sum(CAST(i > coalesce(before, -1000) + 200 AS INTEGER)) OVER (PARTITION BY doc_id ORDER BY i) AS run FROM (SELECT doc_id, i, lag(i) OVER (PARTITION BY doc_id ORDER BY i) AS before FROM r)),
s AS (SELECT doc_id, run, min(i) AS a, max(i) + 200 AS b FROM g GROUP BY doc_id, run),
e AS (SELECT doc_id, b AS a, lead(a) OVER (PARTITION BY doc_id ORDER BY a) AS b FROM s UNION ALL SELECT doc_id, 0, min(a) FROM s GROUP BY doc_id),
k AS (SELECT doc_id, string_agg(substring(h, 2 * a + 1, 2 * (coalesce(b, len(h) // 2) - a)), '' ORDER BY a) AS h FROM e JOIN d USING (doc_id) GROUP BY doc_id),
n AS (SELECT doc_id, count(*) AS n, sum(b - a) AS bytes FROM s GROUP BY doc_id)
SELECT doc_id, CAST(len(d.h) // 2 AS BIGINT) AS n_bytes, CAST(coalesce(n.bytes, 0) AS BIGINT) AS n_removed, CAST(coalesce(n.n, 0) AS BIGINT) AS n_spans, sha256(unhex(coalesce(k.h, d.h))) AS kept_sha256
FROM d LEFT JOIN k USING (doc_id) LEFT JOIN n USING (doc_id)
"""

#: All pairs of texts that share a shingle, exact Jaccard, components by recursion.
NEAR_DEDUP = r"""
WITH RECURSIVE w AS (SELECT doc_id, coalesce(text, '') AS text, list_filter(string_split_regex(lower(coalesce(text, '')), '\s+'), lambda x: x <> '') AS w FROM documents),
t AS (SELECT text, min(doc_id) AS node, any_value(w) AS w FROM w GROUP BY text),
s AS (SELECT node, array_to_string(w[i + 1 : i + 5], ' ') AS s FROM (SELECT node, w, unnest(range(0, greatest(len(w) - 4, 1))) AS i FROM t WHERE len(w) > 0) GROUP BY ALL),
z AS (SELECT node, count(*) AS total FROM s GROUP BY node),
c AS (SELECT x.node AS a, y.node AS b, count(*) AS common FROM s x JOIN s y ON x.s = y.s AND x.node < y.node GROUP BY x.node, y.node),
l AS (SELECT a, b FROM c JOIN z x ON x.node = a JOIN z y ON y.node = b WHERE common / (x.total + y.total - common) >= 0.8),
e AS (SELECT a, b FROM l UNION ALL SELECT b, a FROM l),
p AS (SELECT node AS a, node AS b FROM t UNION SELECT p.a, e.b FROM p JOIN e ON p.b = e.a),
m AS (SELECT a AS node, min(b) AS class_id FROM p GROUP BY a)
SELECT doc_id, m.class_id, count(*) OVER (PARTITION BY m.class_id) AS class_rows FROM w JOIN t USING (text) JOIN m ON m.node = t.node
"""
