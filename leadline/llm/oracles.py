"""DuckDB SQL for the rows of the numbered operators that SQL can express."""

from __future__ import annotations

_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"


def _windows(size: int, key: str, words: str) -> str:
    """(key, i, n, l): of each word its place, the number of words of its text and the next `size` words as a list."""
    ahead = ", ".join(f"lead(word, {k}) OVER w" for k in range(size))
    return f"SELECT {key}, i, count(*) OVER (PARTITION BY {key}) AS n, [{ahead}] AS l FROM {words} WINDOW w AS (PARTITION BY {key} ORDER BY i)"


_WORDS6 = "SELECT {key}, unnest(list_zip(range(1, len(w) + 1), w), recursive := false) AS x FROM (SELECT {key}, regexp_extract_all({lower}, '[0-9a-z\\x{{80}}-\\x{{10FFFF}}]+') AS w FROM {table})"


def _words6(table: str, key: str) -> str:
    return f"SELECT {key}, x[1] AS i, x[2] AS word FROM ({_WORDS6.format(key=key, lower=_LOWER, table=table)})"


OP6 = f"""WITH dw AS ({_words6('documents', 'doc_id')}), bw AS ({_words6('benchmark', 'item_id')}),
d AS ({_windows(13, 'doc_id', 'dw')}), b AS ({_windows(13, 'item_id', 'bw')}),
asked AS (SELECT DISTINCT item_id, least(n, 13) AS m, array_to_string(l[1:least(n, 13)], ' ') AS g FROM b WHERE i + least(n, 13) - 1 <= n),
sizes AS (SELECT DISTINCT m FROM asked),
held AS (SELECT doc_id, i, m, array_to_string(l[1:m], ' ') AS g FROM d, sizes WHERE i + m - 1 <= n),
met AS (SELECT doc_id, i, held.m, item_id FROM held JOIN asked ON held.m = asked.m AND held.g = asked.g),
hit AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + m)) AS p FROM (SELECT DISTINCT doc_id, i, m FROM met)) GROUP BY 1),
items AS (SELECT doc_id, count(*) AS n_items, string_agg(k, ',' ORDER BY k) AS ids FROM (SELECT DISTINCT doc_id, item_id::VARCHAR AS k FROM met) GROUP BY 1),
size AS (SELECT doc_id, count(*) AS n_words FROM dw GROUP BY 1)
SELECT doc_id, coalesce(n_words, 0) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(ids, '')) AS items_sha256,
coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= coalesce(n_words, 0) AS contaminated
FROM documents LEFT JOIN size USING (doc_id) LEFT JOIN hit USING (doc_id) LEFT JOIN items USING (doc_id)"""

_WORDS10 = f"SELECT doc_id, x[1] AS i, x[2] AS word FROM (SELECT doc_id, unnest(list_zip(range(1, len(w) + 1), w), recursive := false) AS x FROM (SELECT doc_id, regexp_extract_all({_LOWER}, '[^\\x20\\x09-\\x0D]+') AS w FROM documents))"

OP10 = f"""WITH RECURSIVE dw AS ({_WORDS10}), d AS ({_windows(5, 'doc_id', 'dw')}),
sets AS (SELECT DISTINCT doc_id, array_to_string(l[1:least(n, 5)], ' ') AS g FROM d WHERE i + least(n, 5) - 1 <= n),
size AS (SELECT doc_id, count(*) AS n FROM sets GROUP BY 1),
pairs AS (SELECT a.doc_id AS u, b.doc_id AS v, count(*) AS c FROM sets a JOIN sets b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY 1, 2),
link AS (SELECT u, v FROM pairs JOIN size x ON u = x.doc_id JOIN size y ON v = y.doc_id WHERE 100 * c >= 80 * (x.n + y.n - c)),
edge AS (SELECT u, v FROM link UNION ALL SELECT v, u FROM link),
reach AS (SELECT DISTINCT u AS id, u AS seen FROM edge UNION SELECT id, v FROM reach JOIN edge ON seen = u)
SELECT doc_id, coalesce(n, 0) AS n_shingles, coalesce(component, doc_id) AS component_id
FROM documents LEFT JOIN size USING (doc_id) LEFT JOIN (SELECT id AS doc_id, min(seen) AS component FROM reach GROUP BY 1) USING (doc_id)"""

_URL = "^(?:[a-zA-Z][a-zA-Z0-9+.-]*:)?//(?:[^/?#@]*@)?([^/?#:]*)(?::[0-9]*)?([^#]*)"

OP7 = rf"""WITH p AS (SELECT page_id, url, DATE '2022-06-01' + ((page_id * 37) % 700)::INT AS fetched_on, lower(regexp_extract(url, '{_URL}', 1)) AS h, regexp_extract(url, '{_URL}', 2) AS rest FROM pages),
hosts AS (SELECT h, b, DATE '2022-01-01' + b % 700 AS first FROM (SELECT h, ('0x' || md5(h)[1:4])::INT AS b FROM (SELECT DISTINCT h FROM p WHERE h <> ''))),
listed AS (SELECT CASE WHEN b % 3 = 0 THEN 'spam' ELSE 'adult' END AS list, 'd:' AS kind, CASE WHEN b % 3 = 0 THEN regexp_extract(h, '[^.]*\.[^.]*\.[^.]*$') ELSE h END AS value, b, first FROM hosts WHERE b % 2 = 0
  UNION ALL SELECT 'phishing', 'u:', h || '/en', b, first FROM hosts WHERE b % 5 = 1),
steps AS (SELECT list, kind || lower(value) AS key, "add", since FROM (SELECT *, true AS "add", first AS since FROM listed UNION ALL SELECT *, false, first + 90 + b % 200 FROM listed UNION ALL SELECT *, true, first + 400 FROM listed) WHERE value <> ''),
daily AS (SELECT list, key, since, bool_and("add") AS held FROM steps GROUP BY 1, 2, 3),
spans AS (SELECT * FROM (SELECT *, lead(since) OVER (PARTITION BY list, key ORDER BY since) AS until FROM daily) WHERE held),
parts AS (SELECT *, string_split(h, '.') AS labels, string_split(regexp_extract(rest, '^([^?]*)', 1), '/') AS dirs FROM p WHERE h <> ''),
asked AS (SELECT page_id, fetched_on, 'd:' || array_to_string(labels[i:], '.') AS key FROM (SELECT *, unnest(range(1, greatest(1, len(labels) - 1) + 1)) AS i FROM parts) WHERE i = 1 OR NOT regexp_matches(h, '^[0-9]+(\.[0-9]+){{3}}$')
  UNION SELECT page_id, fetched_on, 'u:' || h || array_to_string(dirs[1:i], '/') FROM (SELECT *, unnest(range(1, len(dirs) + 1)) AS i FROM parts)
  UNION SELECT page_id, fetched_on, 'u:' || h || rest FROM parts),
met AS (SELECT DISTINCT page_id, list, list || '=' || key AS hit FROM asked JOIN spans USING (key) WHERE since <= fetched_on AND (until IS NULL OR fetched_on < until)),
found AS (SELECT page_id, count(*) AS n, string_agg(DISTINCT list, ',' ORDER BY list) AS lists, string_agg(hit, ',' ORDER BY hit) AS hits FROM met GROUP BY 1)
SELECT page_id, url, fetched_on, n IS NOT NULL AS blocked, coalesce(n, 0) AS n_hits, coalesce(lists, '') AS lists, coalesce(hits, '') AS hits FROM p LEFT JOIN found USING (page_id)"""

#: Bytes are pairs of hexadecimal digits; every start of a 400-byte string by the digest of it.
SUFFIX_DEDUP = """WITH d AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS x FROM documents),
 w AS (SELECT doc_id, i, md5(substr(x, (2 * i + 1)::BIGINT, 800)) AS h FROM d, LATERAL (SELECT unnest(range(0, greatest(length(x) // 2 - 399, 0))) AS i)),
 s AS (SELECT doc_id, i FROM w WHERE h IN (SELECT h FROM w GROUP BY h HAVING count(*) > 1)),
 g AS (SELECT doc_id, i, sum(new) OVER (PARTITION BY doc_id ORDER BY i ROWS UNBOUNDED PRECEDING) AS k FROM (SELECT doc_id, i, CASE WHEN i <= lag(i) OVER (PARTITION BY doc_id ORDER BY i) + 400 THEN 0 ELSE 1 END AS new FROM s)),
 p AS (SELECT doc_id, a, z, coalesce(lag(z) OVER (PARTITION BY doc_id ORDER BY a), 0) AS b FROM (SELECT doc_id, min(i) AS a, max(i) + 400 AS z FROM g GROUP BY doc_id, k)),
 r AS (SELECT p.doc_id, count(*) AS n, sum(z - a) AS removed, max(z) AS last, string_agg(substr(x, (2 * b + 1)::BIGINT, (2 * (a - b))::BIGINT), '' ORDER BY a) AS kept FROM p JOIN d ON p.doc_id = d.doc_id GROUP BY p.doc_id)
SELECT d.doc_id, (length(x) // 2)::BIGINT AS n_bytes, coalesce(removed, 0)::BIGINT AS n_removed, coalesce(n, 0)::BIGINT AS n_spans, lower(sha256(unhex(coalesce(kept, '') || substr(x, (2 * coalesce(last, 0) + 1)::BIGINT)))) AS kept_sha256 FROM d LEFT JOIN r ON d.doc_id = r.doc_id"""


_POLYNOMIAL = 0xEDB88320
#: crc32 of the bytes of f, with the table t of what it makes of each byte.
_CRC = "xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(range(1, octet_length(encode(f)) + 1), lambda i: ('0x' || substr(hex(encode(f)), 2 * i - 1, 2))::BIGINT)), lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1])), 4294967295)"


def _grams13(table: str, key: str) -> str:
    ahead = "word || ' ' || lead(word, 1) OVER w"
    return f"SELECT {key}, unnest([word, {ahead}, {ahead} || ' ' || lead(word, 2) OVER w]) AS f FROM ({_words6(table, key)}) WINDOW w AS (PARTITION BY {key} ORDER BY i)"


OP13 = f"""WITH dg AS MATERIALIZED (SELECT * FROM ({_grams13('documents', 'doc_id')}) WHERE f IS NOT NULL),
bg AS MATERIALIZED (SELECT * FROM ({_grams13('benchmark', 'item_id')}) WHERE f IS NOT NULL),
step AS (SELECT list(x ORDER BY i) AS t FROM (SELECT i, list_reduce([i, 0, 0, 0, 0, 0, 0, 0, 0], lambda c, z: CASE WHEN c & 1 = 1 THEN xor(c >> 1, {_POLYNOMIAL}) ELSE c >> 1 END) AS x FROM range(256) r(i))),
bucket AS MATERIALIZED (SELECT f, {_CRC} % 10000 AS b FROM (SELECT f FROM dg UNION SELECT f FROM bg), step),
s AS (SELECT b, count(*) AS n FROM dg JOIN bucket USING (f) GROUP BY 1), t AS (SELECT b, count(*) AS n FROM bg JOIN bucket USING (f) GROUP BY 1),
gain AS (SELECT b, floor(1000 * ln(((coalesce(t.n, 0) + 1) * (SELECT coalesce(sum(n), 0) + 10000 FROM s))::DOUBLE / ((coalesce(s.n, 0) + 1) * (SELECT coalesce(sum(n), 0) + 10000 FROM t))::DOUBLE))::BIGINT AS g FROM range(10000) r(b) LEFT JOIN s USING (b) LEFT JOIN t USING (b)),
w AS (SELECT doc_id, count(*) AS n_features, sum(g)::BIGINT AS weight FROM dg JOIN bucket USING (f) JOIN gain USING (b) GROUP BY 1),
size AS (SELECT doc_id, count(*) AS n_words FROM ({_words6('documents', 'doc_id')}) GROUP BY 1),
scored AS (SELECT doc_id, coalesce(n_features, 0) AS n_features, coalesce(weight, 0) AS weight, coalesce(n_words, 0) AS n_words,
  coalesce(weight, 0) + floor(-1000 * ln(-ln((('0x' || sha256('42:' || doc_id)[1:8])::BIGINT + 0.5::DOUBLE) / 4294967296::DOUBLE)))::BIGINT AS score FROM documents LEFT JOIN w USING (doc_id) LEFT JOIN size USING (doc_id)),
placed AS (SELECT doc_id, row_number() OVER (ORDER BY score DESC, doc_id) AS rank, count(*) OVER () AS n FROM scored WHERE n_words >= 20)
SELECT doc_id, n_features, weight, score, CASE WHEN rank <= 5 * n // 100 THEN rank END AS rank FROM scored LEFT JOIN placed USING (doc_id)"""


def _lloyd(rounds: int = 6, parts: int = 8, entries: int = 16, scale: int = 4096) -> str:
    """op11: one pair of table expressions a round, each part against every entry of its codebook."""
    nearest = "list_sum(list_transform(list_zip(v, c), lambda x: (x[1] - x[2]) * (x[1] - x[2])))"
    steps = []
    for k in range(rounds + 1):
        steps.append(f"a{k} AS MATERIALIZED (SELECT vec_id, p, v, min(struct_pack(d := {nearest}, e := e)) AS b FROM v JOIN c{k} USING (p) GROUP BY 1, 2, 3)")
        if k < rounds:
            new = "list(((s - ((s % n) + n) % n) // n)::BIGINT ORDER BY i)"
            steps.append(f"n{k} AS (SELECT p, e, {new} AS c FROM (SELECT p, b.e AS e, i, sum(v[i])::BIGINT AS s, count(*) AS n FROM a{k}, LATERAL (SELECT unnest(range(1, len(v) + 1)) AS i) GROUP BY 1, 2, 3) GROUP BY 1, 2)")
            steps.append(f"c{k + 1} AS MATERIALIZED (SELECT p, e, coalesce(n{k}.c, c{k}.c) AS c FROM c{k} LEFT JOIN n{k} USING (p, e))")
    return f"""WITH k AS (SELECT vec_id, label, list_transform(embedding, lambda x: floor({scale} * x::DOUBLE)::BIGINT) AS q FROM embeddings
  WHERE embedding IS NOT NULL AND list_bool_and(list_transform(embedding, lambda x: x IS NOT NULL AND isfinite(x)))),
v AS MATERIALIZED (SELECT vec_id, p, q[(p * len(q) // {parts} + 1)::BIGINT:((p + 1) * len(q) // {parts})::BIGINT] AS v FROM k, range({parts}) t(p)),
c0 AS MATERIALIZED (SELECT p, dense_rank() OVER (PARTITION BY p ORDER BY vec_id) - 1 AS e, v AS c FROM v WHERE vec_id IN (SELECT vec_id FROM k ORDER BY vec_id LIMIT {entries})),
{", ".join(steps)},
coded AS (SELECT vec_id, string_agg(lpad(hex(b.e), 2, '0'), '' ORDER BY p) AS code, sum(b.d)::BIGINT AS error FROM a{rounds} GROUP BY 1),
books AS (SELECT sha256(string_agg(array_to_string(c, ','), ',' ORDER BY p, e)) AS codebooks_sha256 FROM c{rounds})
SELECT vec_id, lower(code) AS code, error, (sum(error) OVER (PARTITION BY label))::BIGINT AS label_error, codebooks_sha256 FROM coded JOIN k USING (vec_id), books"""


ORACLE = {"op11_vector_codes": _lloyd(), "op13_importance_resampling": OP13, "op2_suffix_dedup": SUFFIX_DEDUP, "op6_decontaminate": OP6, "op7_url_filter": OP7, "op10_ngram_join": OP10}
