"""DuckDB twins of the queries of this subpackage that SQL can express; each computes its result by another way."""

from __future__ import annotations

#: All pairs that share a shingle, their exact similarity, and components by reachability.
NGRAM_JACCARD = r"""
WITH RECURSIVE w AS (SELECT doc_id, list_filter(string_split_regex(coalesce(text, ''), '[ \t\n\x0B\f\r]+'), lambda x: x <> '') AS w FROM documents),
s AS (SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) >= 5 THEN list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' ')) WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END) AS g FROM w),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
c AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM s a JOIN s b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY 1, 2),
l AS (SELECT a, b FROM c JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE c >= 0.8 * (x.n + y.n - c) - 1e-9),
e AS (SELECT a, b FROM l UNION ALL SELECT b, a FROM l),
r(node, reach) AS (SELECT a, b FROM e UNION SELECT r.node, e.b FROM r JOIN e ON e.a = r.reach),
k AS (SELECT node, min(reach) AS least FROM r GROUP BY node), g AS (SELECT a, count(*) AS links FROM e GROUP BY a)
SELECT doc_id, least(doc_id, coalesce(k.least, doc_id)) AS class_id, coalesce(links, 0) AS n_links FROM documents LEFT JOIN k ON k.node = doc_id LEFT JOIN g ON g.a = doc_id
"""


def merkle(paragraphs: str, leaves: str) -> str:
    """Trees of texts and edited texts as lists of digests; likeness from equal paragraphs at both ends and counted leaves of the rest."""
    return rf"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t, lead(coalesce(text, '')) OVER (ORDER BY doc_id) AS nx, first_value(coalesce(text, '')) OVER (ORDER BY doc_id) AS f, lead(doc_id) OVER (ORDER BY doc_id) AS nid, first_value(doc_id) OVER (ORDER BY doc_id) AS fid FROM documents),
e AS (SELECT doc_id, coalesce(nid, fid) AS nid, t, left(t, length(t) - length(t) // 4) || left(coalesce(nx, f), length(t) // 4) AS ed FROM d),
u AS (SELECT doc_id, 0 AS k, t AS x FROM e UNION ALL SELECT doc_id, 1, ed FROM e),
p AS (SELECT doc_id, k, length(x) AS n, regexp_extract_all(x, '{paragraphs}') AS p FROM u),
h AS (SELECT *, list_transform(p, lambda x: sha256(x)) AS h FROM p),
q AS (SELECT *, list_filter(range(1, len(h) + 1), lambda i: i = len(h) OR left(h[i], 1) IN ('0', '1', '2', '3')) AS e FROM h),
s AS (SELECT *, list_transform(range(1, len(e) + 1), lambda i: sha256(array_to_string(h[coalesce(e[i - 1], 0) + 1:e[i]], ''))) AS s FROM q),
t AS (SELECT *, sha256(array_to_string(s, '')) AS root, sha256(array_to_string(s, '')) || ':' || array_to_string(list_transform(s, lambda x: left(x, 16)), ',') AS shown FROM s),
a AS (SELECT doc_id, 1 AS kind, doc_id AS other, 1 AS k FROM e UNION ALL SELECT doc_id, 2, nid, 0 FROM e),
f AS (SELECT a.*, x.n AS xn, y.n AS yn, x.h AS xh, y.h AS yh, x.e AS xe, x.root = y.root AS same, x.shown, y.shown AS other_shown,
  coalesce(nullif(list_position(list_transform(range(1, greatest(len(x.h), len(y.h)) + 1), lambda i: x.h[i] IS NOT DISTINCT FROM y.h[i]), false), 0) - 1, len(x.h)) AS front
  FROM a JOIN t x ON x.doc_id = a.doc_id AND x.k = 0 JOIN t y ON y.doc_id = a.other AND y.k = a.k),
b AS (SELECT * EXCLUDE (xh, yh, xe), len(xh) AS xl, len(yh) AS yl, len(list_filter(xe, lambda i: i <= front)) + 1 AS section,
  coalesce(nullif(list_position(list_transform(range(0, greatest(len(xh), len(yh)) - front), lambda i: i < len(xh) - front AND i < len(yh) - front AND xh[len(xh) - i] = yh[len(yh) - i]), false), 0) - 1, len(xh) - front) AS back FROM f),
v AS (SELECT doc_id, k, unnest(p) AS p, generate_subscripts(p, 1) AS i FROM p),
w AS (SELECT doc_id, k, i, unnest(regexp_extract_all(p, '{leaves}')) AS leaf, generate_subscripts(regexp_extract_all(p, '{leaves}'), 1) AS j FROM v),
l AS (SELECT doc_id, k, i, leaf, lag(leaf) OVER (PARTITION BY doc_id, k ORDER BY i, j) AS before FROM w),
m AS (SELECT b.doc_id, b.kind, 0 AS side, l.leaf, l.before FROM b JOIN l ON l.doc_id = b.doc_id AND l.k = 0 AND l.i > b.front AND l.i <= b.xl - b.back
  UNION ALL SELECT b.doc_id, b.kind, 1, l.leaf, l.before FROM b JOIN l ON l.doc_id = b.other AND l.k = b.k AND l.i > b.front AND l.i <= b.yl - b.back),
c AS (SELECT doc_id, kind, leaf, count(*) FILTER (WHERE side = 0) AS x, count(*) FILTER (WHERE side = 1) AS y FROM m GROUP BY doc_id, kind, leaf, before),
g AS (SELECT doc_id, kind, sum(least(x, y) * length(leaf)) AS shared, sum(x * length(leaf)) AS entered FROM c GROUP BY doc_id, kind),
r AS (SELECT b.*, CASE WHEN same THEN 1.0::DOUBLE ELSE 2.0::DOUBLE * (xn - coalesce(entered, 0) + coalesce(shared, 0))::DOUBLE / (xn + yn) END AS near FROM b LEFT JOIN g ON g.doc_id = b.doc_id AND g.kind = b.kind)
SELECT e.doc_id, length(e.t) AS n_chars, sha256(e.ed) AS edited_sha256, x.shown AS fingerprint, x.other_shown AS edited_fingerprint, x.near AS near_edited, y.near AS near_next,
CAST(CASE WHEN x.same THEN 0 ELSE x.section END AS INT) AS edit_section, CAST(CASE WHEN x.same THEN 0 ELSE x.front + 1 END AS INT) AS edit_paragraph, CAST(CASE WHEN x.same THEN 0 ELSE x.xl - x.back - x.front END AS INT) AS edit_paragraphs
FROM e JOIN r x ON x.doc_id = e.doc_id AND x.kind = 1 JOIN r y ON y.doc_id = e.doc_id AND y.kind = 2
"""


_WHITE = r" \t\n\x0B\f\r"

#: All windows of 50 words, those that occur twice, and their unions in code points.
SPARSE_SUFFIXES = rf"""
WITH k AS (SELECT doc_id, length(regexp_extract(coalesce(text, ''), '^[{_WHITE}]*')) AS lead, regexp_extract_all(coalesce(text, ''), '[^{_WHITE}]+[{_WHITE}]*') AS f FROM documents),
u AS (SELECT doc_id, lead, unnest(f) AS f, generate_subscripts(f, 1) AS i FROM k),
o AS (SELECT doc_id, i, regexp_replace(f, '[{_WHITE}]+$', '') AS w, lead + coalesce(sum(length(f)) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS a FROM u),
v AS (SELECT doc_id, i, a, lead(a + length(w), 49) OVER p AS e, md5(string_agg(w, ' ') OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN CURRENT ROW AND 49 FOLLOWING)) AS h FROM o WINDOW p AS (PARTITION BY doc_id ORDER BY i)),
r AS (SELECT doc_id, a, e, doc_id * 10000000 + i = min(doc_id * 10000000 + i) OVER (PARTITION BY h) AS first, count(*) OVER (PARTITION BY h) AS n FROM v WHERE e IS NOT NULL),
z AS (SELECT doc_id, 0 AS kind, a, e FROM r WHERE n > 1 UNION ALL SELECT doc_id, CASE WHEN first THEN 1 ELSE 2 END, a, e FROM r WHERE n > 1),
g AS (SELECT *, CASE WHEN a <= max(e) OVER (PARTITION BY doc_id, kind ORDER BY a ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) THEN 0 ELSE 1 END AS new FROM z),
j AS (SELECT doc_id, kind, min(a) AS a, max(e) AS e FROM (SELECT *, sum(new) OVER (PARTITION BY doc_id, kind ORDER BY a ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS island FROM g) GROUP BY doc_id, kind, island),
x AS (SELECT p.doc_id, sum(least(p.e, q.e) - greatest(p.a, q.a)) AS shared FROM j p JOIN j q ON p.doc_id = q.doc_id AND p.kind = 2 AND q.kind = 1 AND p.a < q.e AND q.a < p.e GROUP BY p.doc_id)
SELECT j.doc_id, CAST(count(*) FILTER (WHERE kind = 0) AS INT) AS n_spans, string_agg(CAST(a AS BIGINT) || ':' || CAST(e AS BIGINT), ',' ORDER BY a) FILTER (WHERE kind = 0) AS spans,
CAST(coalesce(sum(e - a) FILTER (WHERE kind = 2), 0) - coalesce(min(shared), 0) AS BIGINT) AS removed_chars FROM j LEFT JOIN x USING (doc_id) GROUP BY j.doc_id
"""
