"""DuckDB statements, brute force by nature, for operators whose results SQL can express."""

#: Every 200-byte string of every text, counted.
SUBSTRINGS = """
WITH d AS (
  SELECT doc_id, hex(encode(coalesce(text, ''))) AS h, CAST(octet_length(encode(coalesce(text, ''))) AS BIGINT) AS n_bytes FROM documents
), p AS (
  SELECT doc_id, h, unnest(range(0, n_bytes - 199)) AS p FROM d
), g AS (
  SELECT doc_id, p, md5(substr(h, 2 * p + 1, 400)) AS k FROM p
), r AS (
  SELECT doc_id, p FROM (SELECT doc_id, p, count(*) OVER (PARTITION BY k) AS n FROM g) z WHERE n > 1
), s AS (
  SELECT doc_id, p, CASE WHEN p <= lag(p) OVER (PARTITION BY doc_id ORDER BY p) + 200 THEN 0 ELSE 1 END AS opens FROM r
), i AS (
  SELECT doc_id, p, sum(opens) OVER (PARTITION BY doc_id ORDER BY p) AS run FROM s
), x AS (
  SELECT doc_id, min(p) AS a, max(p) + 200 AS b FROM i GROUP BY doc_id, run
), k AS (
  SELECT doc_id, a, b, coalesce(lag(b) OVER (PARTITION BY doc_id ORDER BY a), 0) AS last FROM x
), c AS (
  SELECT doc_id, string_agg(substr(h, 2 * last + 1, 2 * (a - last)), '' ORDER BY a) AS head, max(b) AS tail, sum(b - a) AS gone, count(*) AS runs FROM k JOIN d USING (doc_id) GROUP BY doc_id
)
SELECT doc_id, n_bytes, CAST(coalesce(gone, 0) AS BIGINT) AS n_removed, CAST(coalesce(runs, 0) AS BIGINT) AS n_spans,
  sha256(unhex(coalesce(head, '') || substr(h, 2 * coalesce(tail, 0) + 1))) AS kept_sha256
FROM d LEFT JOIN c USING (doc_id)
"""

#: The digest's base32 letters come from five bits each.
WARC = """
WITH p AS (
  SELECT page_id, coalesce(html, '') AS h, max(page_id) OVER (PARTITION BY coalesce(html, '')) AS top FROM pages
), b AS (
  SELECT *, array_to_string(list_transform(range(1, 41), lambda i: lpad(bin(strpos('0123456789abcdef', substr(sha1(h), i, 1)) - 1), 4, '0')), '') AS bits FROM p
)
SELECT page_id, CAST(strlen(h) AS BIGINT) AS payload_bytes,
  array_to_string(list_transform(range(0, 32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + 16 * CAST(substr(bits, 5 * i + 1, 1) AS INT) + 8 * CAST(substr(bits, 5 * i + 2, 1) AS INT)
    + 4 * CAST(substr(bits, 5 * i + 3, 1) AS INT) + 2 * CAST(substr(bits, 5 * i + 4, 1) AS INT) + CAST(substr(bits, 5 * i + 5, 1) AS INT), 1)), '') AS payload_digest,
  CASE WHEN page_id = top THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN page_id < top THEN top END AS refers_to
FROM b
"""

#: All pairs. At the test sizes the forest finds every link.
EMBEDDINGS = """
WITH RECURSIVE v AS (
  SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings
), l AS (
  SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.vec_id <> b.vec_id AND list_cosine_similarity(a.e, b.e) >= 0.9
), r(vec_id, c) AS (
  SELECT vec_id, vec_id FROM v UNION SELECT l.b, r.c FROM r JOIN l ON l.a = r.vec_id
), n AS (
  SELECT a AS vec_id, count(*) AS n FROM l GROUP BY a
)
SELECT r.vec_id, coalesce(max(n.n), 0) AS n_links, min(c) AS component_id, r.vec_id = min(c) AS kept FROM r LEFT JOIN n ON n.vec_id = r.vec_id GROUP BY r.vec_id
"""

#: CRC-32 of a list of bytes, with its table of 256 remainders (r.tab).
_CRC_TABLE = """r AS (
  SELECT list(list_reduce(list_prepend(i, range(0, 8)), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) ORDER BY i) AS tab FROM (SELECT unnest(range(0, 256)) AS i) z
)"""


def _crc(octets: str) -> str:
    return f"xor(list_reduce(list_prepend(4294967295, {octets}), lambda c, b: xor(c >> 8, tab[1 + (xor(c, b) & 255)])), 4294967295)"


#: All pairs of equal words of a document at most a third of it apart; stretches of them at one distance are runs.
PERIODS = (
    f"""
WITH {_CRC_TABLE}, d AS (
  SELECT doc_id, {_crc("list_transform(range(1, 1 + length(CAST(doc_id AS VARCHAR))), lambda i: CAST(ascii(substr(CAST(doc_id AS VARCHAR), CAST(i AS INT), 1)) AS BIGINT))")} AS h,
    regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS w FROM documents, r
)"""
    + """, e AS (
  SELECT *, CAST(len(w) AS BIGINT) AS n, h % 10 = 0 AND len(w) > 0 AS hit, (h // 10) % greatest(len(w), 1) AS a, h // 10 AS g FROM d
), f AS (
  SELECT *, 1 + (n - a) // (3 + g % 8) AS p FROM e
), x AS (
  SELECT doc_id, n, unnest(range(0, n)) AS i, CASE WHEN hit THEN list_transform(range(0, n), lambda i: w[1 + CASE WHEN i >= a THEN a + (i - a) % p ELSE i END]) ELSE w END AS w FROM f
), t AS (
  SELECT doc_id, n, i, w[1 + i] AS w FROM x
), s AS (
  SELECT u.doc_id, v.i - u.i AS q, u.i - row_number() OVER (PARTITION BY u.doc_id, v.i - u.i ORDER BY u.i) AS island, u.i FROM t u JOIN t v ON u.doc_id = v.doc_id AND u.w = v.w AND v.i > u.i AND v.i - u.i <= u.n // 3
), m AS (
  SELECT doc_id, q, min(i) AS s, count(*) + q AS l FROM s GROUP BY doc_id, q, island HAVING count(*) + q >= greatest(24, 3 * q)
), o AS (
  SELECT doc_id, s, l, min(q) AS q FROM m GROUP BY doc_id, s, l
), gone AS (
  SELECT DISTINCT doc_id, unnest(range(s + q, s + l)) AS i FROM o
), kept AS (
  SELECT doc_id, string_agg(w, ' ' ORDER BY i) AS k FROM t ANTI JOIN gone USING (doc_id, i) GROUP BY doc_id
), b AS (
  SELECT doc_id, count(*) AS n_runs, string_agg(s || ',' || l || ',' || q || chr(10), '' ORDER BY s, q) AS lines FROM o GROUP BY doc_id
), best AS (
  SELECT doc_id, s, l, q FROM o QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY CAST(l AS DOUBLE) / q DESC, s, q) = 1
)
SELECT d.doc_id, coalesce(n_runs, 0) AS n_runs, s AS start, l AS length, q AS period, 1000 * l // q AS exponent_milli,
  sha256(coalesce(lines, '')) AS runs_sha256, sha256(coalesce(k, '')) AS collapsed_sha256
FROM d LEFT JOIN b USING (doc_id) LEFT JOIN best USING (doc_id) LEFT JOIN kept USING (doc_id)
"""
)

#: A word without its letter number i, for each i, meets others of the same (one replaced) and words as they are (one deleted).
SPELLING = f"""
WITH RECURSIVE {_CRC_TABLE}, t AS (
  SELECT coalesce(CAST(doc_id AS VARCHAR), '') AS k, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[A-Za-zÀ-ÿ]+')) AS w FROM documents
), u AS (
  SELECT k, w, count(*) AS n, hex(encode(k || ':' || w)) AS x FROM t WHERE length(w) >= 6 GROUP BY k, w
), h AS (
  SELECT w, n, {_crc("list_transform(range(0, length(x) // 2), lambda i: CAST(16 * (strpos('0123456789ABCDEF', substr(x, CAST(2 * i + 1 AS INT), 1)) - 1) + strpos('0123456789ABCDEF', substr(x, CAST(2 * i + 2 AS INT), 1)) - 1 AS BIGINT))")} AS h FROM u, r
), v AS (
  SELECT CASE WHEN h % 199 = 0 THEN substr(w, 1, CAST(h % length(w) AS INT)) || substr(w, CAST(h % length(w) AS INT) + 2) ELSE w END AS word, n FROM h
), c AS (
  SELECT word, CAST(sum(n) AS BIGINT) AS n FROM v WHERE length(word) >= 6 GROUP BY word HAVING sum(n) >= 5
), i AS (
  SELECT word, n, unnest(range(0, length(word))) AS i FROM c
), d AS (
  SELECT word, n, i, substr(word, 1, CAST(i AS INT)) || substr(word, CAST(i AS INT) + 2) AS d FROM i
), p AS (
  SELECT a.word AS a, b.word AS b, b.n AS n FROM d a JOIN d b ON a.i = b.i AND a.d = b.d AND a.word <> b.word
  UNION SELECT d.word, c.word, c.n FROM d JOIN c ON d.d = c.word
  UNION SELECT c.word, d.word, d.n FROM d JOIN c ON d.d = c.word
), m AS (
  SELECT a AS word, b, n AS bn, count(*) OVER (PARTITION BY a) AS n_near FROM p QUALIFY row_number() OVER (PARTITION BY a ORDER BY n DESC, b) = 1
), f AS (
  SELECT c.word, c.n, coalesce(n_near, 0) AS n_near, CASE WHEN bn >= 5 * c.n THEN b END AS form, CASE WHEN bn >= 5 * c.n THEN bn END AS form_n FROM c LEFT JOIN m USING (word)
), g(word, top) AS (
  SELECT word, word FROM f UNION ALL SELECT g.word, f.form FROM g JOIN f ON g.top = f.word WHERE f.form IS NOT NULL
)
SELECT f.word, f.form, e.top AS root, f.n, f.n_near, f.form_n FROM f JOIN (SELECT g.word, g.top FROM g JOIN f ON g.top = f.word WHERE f.form IS NULL) e ON e.word = f.word
"""

#: Base matches of each kind.
SECRETS = """
WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents)
SELECT doc_id,
  CAST(len(list_filter(regexp_extract_all(t, '(?i:(password|passwd|secret|token|api_?key))["'']?\\x20*[:=]\\x20*["'']?([A-Za-z0-9+/_.=-]+)', 2), lambda x: length(x) >= 12)) AS BIGINT) AS n_assign,
  CAST(len(list_filter(regexp_extract_all(t, 'AKIA[A-Z0-9]+'), lambda x: length(x) >= 18)) AS BIGINT) AS n_access,
  CAST(len(list_filter(regexp_extract_all(t, '[0-9a-f]+'), lambda x: length(x) >= 16)) AS BIGINT) AS n_hex
FROM d
"""

#: Sources stop at twice their size in the order of that size by weight; the rest have one level by weight.
TARGETS = """
WITH d AS (
  SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+')) AS BIGINT) AS size FROM documents
), s AS (
  SELECT source, CAST(sum(size) AS BIGINT) AS source_size, [5, 2, 1][1 + (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3] AS w FROM d GROUP BY source
), o AS (
  SELECT *, row_number() OVER (ORDER BY 2.0 * source_size / w, source NULLS LAST) AS k, sum(source_size) OVER () AS total, sum(w) OVER () AS all_w FROM s
), c AS (
  SELECT *, coalesce(sum(2.0 * source_size) OVER b, 0) AS capped, all_w - coalesce(sum(w) OVER b, 0) AS open_w FROM o WINDOW b AS (ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
), l AS (
  SELECT arg_min(level, k) AS level FROM (SELECT k, (1.5 * total - capped) / open_w AS level, 2.0 * source_size / w AS most FROM c) z WHERE level <= most
)
SELECT d.doc_id, size, source_size, round(least(2.0 * source_size, level * w), 4) AS target FROM d JOIN s ON d.source IS NOT DISTINCT FROM s.source, l
"""

#: The longest rule whose host is the url's or one above it, and whose path begins the url's.
RULES = """
WITH u AS (
  SELECT page_id, CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS r FROM pages
), h AS (
  SELECT page_id, translate(regexp_extract(r, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host, regexp_extract(substr(r, length(regexp_extract(r, '^[^/?#]*')) + 1), '^[^?#]*') AS path FROM u
), t(rule, of, start, verdict) AS (
  VALUES ('net/', 'net', '/', 'block'), ('example.net/en/', 'example.net', '/en/', 'allow'), ('example.com/de/', 'example.com', '/de/', 'block'), ('org/fr/', 'org', '/fr/', 'allow')
), f AS (
  SELECT page_id, arg_max(rule, length(rule)) AS rule, arg_max(verdict, length(rule)) AS verdict FROM h JOIN t ON (host = of OR ends_with(host, '.' || of)) AND starts_with(path, start) GROUP BY page_id
)
SELECT h.page_id, host, path, rule, verdict FROM h LEFT JOIN f USING (page_id)
"""
