"""DuckDB SQL of the operators whose results SQL can express: exact search, sharding and n-gram groups."""

from __future__ import annotations

OP4 = """
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS e FROM embeddings
           WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0),
s AS (SELECT q.vec_id AS query_id, c.vec_id, list_inner_product(q.e, c.e)::BIGINT AS score FROM v q JOIN v c ON q.vec_id <> c.vec_id WHERE q.vec_id % 50 = 0),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s)
SELECT query_id, rank::INT AS rank, vec_id, score FROM r WHERE rank <= 5
"""

#: The checksum runs over the bytes with its usual table; the hash over 64-bit states as HUGEINT.
OP7 = """
WITH RECURSIVE t AS (SELECT list_transform(range(256), lambda i: list_reduce(list_prepend(i, range(8)), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END)) AS crc),
d AS (SELECT doc_id, coalesce(strlen(text), 0) + 16 AS size, list_transform(regexp_extract_all(hex(encode(coalesce(text, ''))), '..'), lambda h: ('0x' || h)::BIGINT) AS bytes FROM documents),
c AS (SELECT doc_id, size, xor(list_reduce(list_prepend(4294967295, bytes), lambda c, b: xor(c >> 8, crc[(xor(c, b) & 255) + 1])), 4294967295) AS text_crc32 FROM d, t),
j(doc_id, k, b, n) AS (
  SELECT DISTINCT doc_id, doc_id::HUGEINT, -1::BIGINT, 0::BIGINT FROM documents
  UNION ALL
  SELECT doc_id, k2, n, floor((n + 1) * (2147483648.0::DOUBLE / ((k2 // 8589934592) + 1)::DOUBLE))::BIGINT
  FROM (SELECT *, (k * 2862933555777941757 + 1) % 18446744073709551616 AS k2 FROM j WHERE n < 40)
),
f AS (SELECT doc_id, b AS shard, n FROM j WHERE n >= 40),
p AS (SELECT c.*, shard, n, ((doc_id & 255) + (doc_id >> 8 & 255) + (doc_id >> 16 & 255) + (doc_id >> 24 & 255) + (doc_id >> 32 & 255) + (doc_id >> 40 & 255) + (doc_id >> 48 & 255) + (doc_id >> 56 & 255)) % 256 AS sub FROM c JOIN f USING (doc_id))
SELECT doc_id, size::BIGINT AS size, text_crc32::BIGINT AS text_crc32, 'key' AS law, shard::INT AS shard,
       row_number() OVER (PARTITION BY shard ORDER BY sub, doc_id, text_crc32, size) - 1 AS slot, CASE WHEN n = 40 THEN 40 ELSE shard END::INT AS grown_shard FROM p
"""

#: Sets are distinct by their shingles; links are walked from every set. ``row`` and ``group`` are hashes of the library and left out.
OP8 = r"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
g AS (SELECT doc_id, unnest(list_distinct(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 4 THEN [array_to_string(w, ' ')] ELSE list_transform(range(1, len(w) - 2), lambda i: array_to_string(w[i:i + 3], ' ')) END)) AS gram FROM w),
n AS (SELECT doc_id, count(*) AS n FROM g GROUP BY 1),
o AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS o FROM g a JOIN g b ON a.gram = b.gram AND a.doc_id <> b.doc_id GROUP BY 1, 2),
l AS (SELECT a, b FROM o JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * o >= 85 * (x.n + y.n - o)),
r(a, b) AS (SELECT a, b FROM l UNION SELECT r.a, l.b FROM r JOIN l ON r.b = l.a)
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, least(d.doc_id, min(r.b)) AS component_id FROM documents d LEFT JOIN n ON n.doc_id = d.doc_id LEFT JOIN r ON r.a = d.doc_id GROUP BY d.doc_id, n.n
"""
