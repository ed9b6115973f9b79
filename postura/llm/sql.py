"""DuckDB SQL for the operators that SQL can express."""

WORDS = "regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')"

OP1 = f"""
WITH d AS (SELECT doc_id, {WORDS} AS ws FROM documents),
b AS (SELECT item_id, {WORDS} AS ws FROM benchmark),
w AS (SELECT DISTINCT item_id, ws[s:s + 9] AS t
      FROM (SELECT item_id, ws, unnest(generate_series(1, greatest(len(ws) - 9, 1))) AS s FROM b WHERE len(ws) > 0)),
sizes AS (SELECT DISTINCT len(t) AS n FROM w),
g AS (SELECT doc_id, s, n, ws[s:s + n - 1] AS t
      FROM (SELECT doc_id, ws, n, unnest(generate_series(1, len(ws) - n + 1)) AS s FROM d, sizes WHERE len(ws) >= n)),
h AS (SELECT g.doc_id, g.s, g.n, w.item_id, w.t FROM g JOIN w ON g.t = w.t),
tok AS (SELECT doc_id, unnest(ws) AS term, unnest(generate_series(0, len(ws) - 1)) AS p FROM d WHERE len(ws) > 0),
e AS (SELECT t, unnest(t) AS term, unnest(generate_series(0, len(t) - 1)) AS off FROM (SELECT DISTINCT t FROM w)),
r AS (SELECT t, arg_min(term, n * 100 + off) AS rarest FROM e JOIN (SELECT term, count(*) AS n FROM tok GROUP BY 1) c USING (term)
      GROUP BY t HAVING count(*) = len(t)),
a AS (SELECT tok.doc_id, tok.p, r.t, len(r.t) + 4 AS reach FROM tok JOIN r ON tok.term = r.rarest),
m AS (SELECT t, term, count(*) AS times FROM e GROUP BY 1, 2),
f AS (SELECT a.doc_id, a.p, a.t, m.term FROM a JOIN m ON a.t = m.t
      JOIN tok ON tok.doc_id = a.doc_id AND tok.term = m.term AND abs(tok.p - a.p) <= a.reach
      GROUP BY a.doc_id, a.p, a.t, m.term, m.times HAVING count(*) >= m.times),
nr AS (SELECT doc_id, count(DISTINCT t) AS n_near FROM (SELECT doc_id, p, t FROM f GROUP BY 1, 2, 3 HAVING count(*) = len(list_distinct(t))) q
       WHERE NOT EXISTS (SELECT 1 FROM h WHERE h.doc_id = q.doc_id AND h.t = q.t) GROUP BY 1),
pos AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(generate_series(s, s + n - 1)) AS p FROM h) GROUP BY 1),
it AS (SELECT doc_id, count(*) AS n_items, string_agg(i, ',' ORDER BY i) AS items
       FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS i FROM h) GROUP BY 1)
SELECT d.doc_id, CAST(len(d.ws) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit,
       CAST(coalesce(n_items, 0) AS BIGINT) AS n_items, sha256(coalesce(items, '')) AS items_sha256,
       coalesce(n_hit, 0) > 0 AS contaminated, CAST(coalesce(n_near, 0) AS BIGINT) AS n_near
FROM d LEFT JOIN pos USING (doc_id) LEFT JOIN it USING (doc_id) LEFT JOIN nr USING (doc_id)
"""

# hexadecimal digits of the UTF-8 bytes, so that places count bytes; a string is known by a 64-bit hash
OP7 = """
WITH d AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS x FROM documents),
s AS (SELECT doc_id, i, hash(substr(x, CAST(2 * i + 1 AS BIGINT), 800)) AS h FROM (SELECT doc_id, x, unnest(generate_series(0, len(x) // 2 - 400)) AS i FROM d WHERE len(x) >= 800)),
r AS (SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY h) AS n FROM s) WHERE n > 1),
g AS (SELECT doc_id, i, sum(new) OVER (PARTITION BY doc_id ORDER BY i) AS run
      FROM (SELECT doc_id, i, CASE WHEN i > lag(i) OVER (PARTITION BY doc_id ORDER BY i) + 400 THEN 1 ELSE 0 END AS new FROM r)),
spans AS (SELECT doc_id, min(i) AS a, max(i) + 400 AS b FROM g GROUP BY doc_id, run),
edges AS (SELECT doc_id, coalesce(lag(b) OVER (PARTITION BY doc_id ORDER BY a), 0) AS k, a, b FROM spans),
kept AS (SELECT e.doc_id, string_agg(substr(x, CAST(2 * k + 1 AS BIGINT), CAST(2 * (a - k) AS BIGINT)), '' ORDER BY a) || any_value(substr(x, CAST(2 * m + 1 AS BIGINT))) AS y, sum(b - a) AS gone, count(*) AS n
         FROM edges e JOIN d USING (doc_id) JOIN (SELECT doc_id, max(b) AS m FROM spans GROUP BY 1) l USING (doc_id) GROUP BY 1)
SELECT doc_id, CAST(len(x) // 2 AS BIGINT) AS n_bytes, CAST(coalesce(gone, 0) AS BIGINT) AS n_removed, CAST(coalesce(n, 0) AS BIGINT) AS n_spans, sha256(unhex(coalesce(y, x))) AS kept_sha256
FROM d LEFT JOIN kept USING (doc_id)
"""

# every document that shares a term with an item gets its score
OP12 = """
WITH ws AS (SELECT doc_id, row_number() OVER () AS doc, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+') AS ws FROM documents),
d AS (SELECT *, CAST(len(ws) AS BIGINT) AS n FROM ws WHERE len(ws) > 0), t AS (SELECT CAST(count(*) AS BIGINT) AS docs, CAST(sum(n) AS BIGINT) AS total FROM d),
p AS (SELECT doc, doc_id, n, term, CAST(count(*) AS BIGINT) AS tf FROM (SELECT doc, doc_id, n, unnest(ws) AS term FROM d) GROUP BY ALL),
w AS (SELECT term, CAST(floor(1000 * ln((2 * docs + 2)::DOUBLE / (2 * count(*) + 1))) AS BIGINT) AS w FROM p, t GROUP BY term, docs),
q AS (SELECT DISTINCT item_id, unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+')) AS term FROM benchmark),
s AS (SELECT item_id, doc, doc_id, CAST(sum(w * ((1000000000 * tf) // (1000 * tf + 8 * (10 + (90 * n * docs) // total)))) AS BIGINT) AS score FROM q JOIN p USING (term) JOIN w USING (term), t GROUP BY ALL),
r AS (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id, doc) AS rank FROM s WHERE score > 0)
SELECT item_id, CAST(rank AS INT) AS rank, doc_id, score FROM r WHERE rank <= 10
"""

# the checksum's table from its polynomial, then one step a byte; a row's place from the sorted fractions of all rows
OP13 = """
WITH t AS (SELECT list_transform(range(256), lambda i: list_reduce([i] || range(8), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END)) AS tbl),
b AS (SELECT doc_id, coalesce(source, '') AS s, source IS NOT NULL AS has, list_transform(regexp_extract_all(hex(encode(coalesce(text, ''))), '..'), lambda x: CAST('0x' || x AS BIGINT)) AS bytes FROM documents),
d AS (SELECT doc_id, s, has, CAST(len(bytes) + 16 AS BIGINT) AS size, xor(list_reduce([4294967295::BIGINT] || bytes, lambda c, x: xor(c >> 8, tbl[(xor(c, x) & 255) + 1])), 4294967295) AS crc FROM b, t),
r AS (SELECT *, row_number() OVER (PARTITION BY has, s ORDER BY md5('13:' || coalesce(CAST(doc_id AS VARCHAR), '') || ':' || crc), doc_id, size) - 1 AS r, count(*) OVER (PARTITION BY has, s) AS n FROM d),
p AS (SELECT *, row_number() OVER (ORDER BY (2 * r + 1)::DOUBLE / (2 * n), has, s, r) - 1 AS p, count(*) OVER () AS total FROM r)
SELECT doc_id, size, CAST(crc AS BIGINT) AS text_crc32, 'rows' AS law, CAST(p * 40 // total AS INT) AS shard, CAST(p - (p * 40 // total * total + 39) // 40 AS BIGINT) AS slot, CAST(NULL AS INT) AS grown_shard FROM p
"""

ORACLES = {"op1_benchmark_decontamination": OP1, "op7_suffix_array_dedup": OP7, "op12_ranked_search": OP12, "op13_interleaved_sharding": OP13}
