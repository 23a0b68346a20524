"""SQL (DuckDB) of the pivot index, the prefix trie and the ranked search, each by brute force."""

VECTORS = """
WITH RECURSIVE v AS (SELECT row_number() OVER () AS r, vec_id, label, embedding::DOUBLE[] AS e FROM embeddings),
g AS (SELECT * FROM v WHERE label IS NOT NULL AND len(e) > 0 AND len(list_filter(e, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(e, lambda x: x != 0)) > 0),
p AS (SELECT a.r AS x, b.r AS y FROM g a JOIN g b ON a.label = b.label AND a.r != b.r
    WHERE CASE WHEN len(a.e) = len(b.e) THEN list_cosine_similarity(a.e, b.e) >= 0.98 ELSE false END),
near(x, y) AS (SELECT r, r FROM v UNION SELECT near.x, p.y FROM near JOIN p ON near.y = p.x),
least AS (SELECT near.x, min(v.vec_id) AS component_id FROM near JOIN v ON v.r = near.y GROUP BY near.x),
n AS (SELECT x, count(*) AS n FROM p GROUP BY x)
SELECT vec_id, coalesce(n.n, 0)::BIGINT AS n_links, component_id, coalesce(vec_id = component_id, false) AS kept
FROM v JOIN least ON least.x = v.r LEFT JOIN n ON n.x = v.r"""

TRIE = """
WITH o AS (SELECT conv_id AS c, coalesce(role, '') AS role, coalesce(text, '') AS text, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, '')) AS i
    FROM conversations WHERE conv_id IS NOT NULL),
ids AS (SELECT c, c - c % 5 AS base, xor(4294967295, list_reduce(list_transform(range(length(s)), lambda k: ascii(s[k + 1])::BIGINT),
    lambda crc, b: list_reduce(range(8), lambda x, k: CASE WHEN x & 1 = 1 THEN xor(x >> 1, 3988292384) ELSE x >> 1 END, xor(crc, b)), 4294967295::BIGINT)) % 9 AS h
    FROM (SELECT DISTINCT c, c::VARCHAR AS s FROM o)),
sizes AS (SELECT c, count(*) AS n FROM o GROUP BY c),
t AS (SELECT ids.c, o.i, o.role, o.text FROM ids JOIN o ON o.c = ids.base WHERE o.i <= h
    UNION ALL SELECT ids.c, o.i - h + least(h, coalesce(b.n, 0)), o.role, o.text FROM ids JOIN o USING (c) LEFT JOIN sizes b ON b.c = ids.base WHERE o.i > h),
l AS (SELECT c, list(sha256(strlen(role)::VARCHAR || ':' || role || text) ORDER BY i) AS turns, list(strlen(text) ORDER BY i) AS bytes FROM t GROUP BY c),
w AS (SELECT c, coalesce(turns, []) AS turns, coalesce(bytes, []) AS bytes FROM ids LEFT JOIN l USING (c)),
m AS (SELECT c, d, array_to_string(turns[1:d], '') AS key, coalesce(bytes[d], 0) AS size, d = len(turns) AS ends FROM (SELECT *, unnest(range(len(turns) + 1)) AS d FROM w)),
n AS (SELECT key, d, min(c) AS conv_id, count(*) AS n_convs, any_value(size) AS size, sha256(coalesce(string_agg(c::VARCHAR, ',' ORDER BY c) FILTER (ends), '')) AS ends_sha256 FROM m GROUP BY key, d),
kids AS (SELECT key[:64 * (d - 1)] AS key, count(*) AS n FROM n WHERE d > 0 GROUP BY 1),
a AS (SELECT n.*, coalesce(kids.n, 0) AS n_children FROM n LEFT JOIN kids ON kids.key = n.key),
sums AS (SELECT above, sum((n_children = 0)::BIGINT) AS n_leaves, sum((n_convs - 1) * size) AS saved
    FROM (SELECT *, unnest(list_transform(range(d + 1), lambda k: key[:64 * k])) AS above FROM a) GROUP BY above)
SELECT a.conv_id, a.d AS depth, up.conv_id AS parent_conv_id, a.n_convs, a.n_children, n_leaves::BIGINT AS n_leaves, saved::BIGINT AS saved_tokens, a.ends_sha256
FROM a JOIN sums ON sums.above = a.key LEFT JOIN n up ON a.d > 0 AND up.key = a.key[:64 * (a.d - 1)]"""

_TERMS = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')"

RANKED = f"""
WITH d AS (SELECT * FROM (SELECT row_number() OVER () AS r, doc_id, {_TERMS} AS terms FROM documents) WHERE len(terms) > 0),
s AS (SELECT count(*)::BIGINT AS docs, sum(len(terms))::BIGINT AS total FROM d),
i AS (SELECT row_number() OVER () AS item, item_id, list_distinct({_TERMS}) AS terms FROM benchmark),
q AS (SELECT item, item_id, unnest(terms) AS term FROM i),
tf AS (SELECT r, doc_id, term, n, count(*)::BIGINT AS tf FROM (SELECT r, doc_id, len(terms)::BIGINT AS n, unnest(terms) AS term FROM d) WHERE term IN (SELECT term FROM q) GROUP BY r, doc_id, term, n),
w AS (SELECT term, floor(1000 * ln((2 * docs + 2)::DOUBLE / (2 * count(*) + 1)))::BIGINT AS w FROM tf, s GROUP BY term, docs),
x AS (SELECT item, item_id, r, doc_id, sum(w * ((1000000000 * tf) // (1000 * tf + 8 * (10 + (90 * n * docs) // total))))::BIGINT AS score
    FROM q JOIN tf USING (term) JOIN w USING (term), s GROUP BY item, item_id, r, doc_id)
SELECT item_id, rank::INT AS rank, doc_id, score FROM (SELECT *, row_number() OVER (PARTITION BY item ORDER BY score DESC, doc_id NULLS LAST) AS rank FROM x WHERE score > 0) WHERE rank <= 10"""
