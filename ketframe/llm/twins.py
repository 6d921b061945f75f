"""SQL twins (DuckDB dialect) of the registered queries that SQL can express."""

from __future__ import annotations

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def _words(pattern: str) -> str:
    return f"regexp_extract_all(translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}'), '{pattern}')"


#: all pairs that share a shingle, linked by their full sets; who can be reached from whom, link by link
OP3 = f"""WITH RECURSIVE worded AS (SELECT doc_id, {_words('[^\\x20\\x09-\\x0D]+')} AS w FROM documents),
sets AS (SELECT doc_id, list_distinct(CASE WHEN len(w) >= 5 THEN list_transform(range(len(w) - 4), lambda i: array_to_string(w[i + 1 : i + 5], ' ')) WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END) AS s FROM worded),
shingles AS (SELECT doc_id, len(s) AS n, unnest(s) AS g FROM sets),
links AS (SELECT a.doc_id AS a, b.doc_id AS b FROM shingles a JOIN shingles b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY 1, 2, a.n, b.n HAVING 100 * count(*) >= 75 * (a.n + b.n - count(*))),
reach AS (SELECT doc_id, doc_id AS other FROM sets UNION SELECT r.doc_id, l.b FROM reach r JOIN links l ON l.a = r.other),
least AS (SELECT doc_id, min(other) AS component_id FROM reach GROUP BY 1)
SELECT s.doc_id, CAST(len(s.s) AS BIGINT) AS n_shingles, c.component_id, s.doc_id = c.component_id AS kept FROM sets s JOIN least c ON c.doc_id = s.doc_id"""

_ITEM_WORDS = _words("[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+")
#: each window of an item, looked up among the document's strings of as many words
OP4 = f"""WITH docs AS (SELECT doc_id, {_ITEM_WORDS} AS w FROM documents),
items AS (SELECT CAST(item_id AS VARCHAR) AS item, {_ITEM_WORDS} AS w FROM benchmark),
windows AS (SELECT DISTINCT item, m, array_to_string(w[i + 1 : i + m], ' ') AS g FROM (SELECT item, w, m, unnest(range(len(w) - m + 1)) AS i FROM (SELECT item, w, least(len(w), 10) AS m FROM items WHERE len(w) > 0))),
spans AS (SELECT doc_id, m, i, array_to_string(w[i + 1 : i + m], ' ') AS g FROM (SELECT doc_id, w, m, unnest(range(len(w) - m + 1)) AS i FROM docs, (SELECT DISTINCT m FROM windows) sizes WHERE len(w) >= m)),
hits AS (SELECT s.doc_id, s.i, s.m, x.item FROM spans s JOIN windows x ON x.m = s.m AND x.g = s.g),
words_hit AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + m)) AS p FROM hits) GROUP BY 1),
found AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS names FROM (SELECT DISTINCT doc_id, item FROM hits) GROUP BY 1)
SELECT d.doc_id, CAST(len(d.w) AS BIGINT) AS n_words, CAST(coalesce(h.n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(f.n_items, 0) AS BIGINT) AS n_items, sha256(coalesce(f.names, '')) AS items_sha256, coalesce(h.n_hit, 0) > 0 AS contaminated
FROM docs d LEFT JOIN words_hit h ON h.doc_id = d.doc_id LEFT JOIN found f ON f.doc_id = d.doc_id"""
