"""DuckDB texts for the queries that SQL can express.

The others (learned models, approximate search, archives' round trips by
random plans) are tested against brute-force versions in ``tests/llm``.
"""

from __future__ import annotations

OP3 = """
WITH hashed AS (
  SELECT page_id, coalesce(octet_length(encode(html)), 0) AS payload_bytes, sha1(coalesce(html, '')) AS hex FROM pages
), held AS (
  SELECT hex, max(page_id) AS keeper FROM hashed GROUP BY hex
), quarters AS (
  SELECT page_id, payload_bytes, hex, keeper,
         list_transform(range(8), lambda i: ('0x' || substr(hex, CAST(1 + 5 * i AS INTEGER), 5))::BIGINT) AS groups20
  FROM hashed JOIN held USING (hex)
)
SELECT page_id, payload_bytes,
       list_aggregate(list_transform(groups20, lambda g:
         list_aggregate(list_transform([15, 10, 5, 0], lambda s:
           substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', CAST(1 + ((g >> s) & 31) AS INTEGER), 1)), 'string_agg', '')), 'string_agg', '') AS payload_digest,
       CASE WHEN page_id = keeper THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN page_id = keeper THEN NULL ELSE keeper END AS refers_to
FROM quarters
"""

OP7 = r"""
WITH RECURSIVE tokens AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                    '[^\x20\x09-\x0D]+') AS w
  FROM documents
), shingles AS (
  SELECT DISTINCT doc_id, s FROM (
    SELECT doc_id, unnest(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
                               ELSE list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' ')) END) AS s
    FROM tokens)
), sizes AS (
  SELECT doc_id, count(*) AS n FROM shingles GROUP BY doc_id
), shared AS (
  SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c
  FROM shingles a JOIN shingles b ON a.s = b.s AND a.doc_id <> b.doc_id GROUP BY 1, 2
), links AS (
  SELECT a, b FROM shared JOIN sizes x ON x.doc_id = a JOIN sizes y ON y.doc_id = b
  WHERE 100 * c >= 75 * (x.n + y.n - c)
), reach AS (
  SELECT doc_id AS node, doc_id AS other FROM documents
  UNION
  SELECT r.node, l.b FROM reach r JOIN links l ON l.a = r.other
)
SELECT d.doc_id, coalesce(z.n, 0) AS n_shingles, r.component_id
FROM documents d LEFT JOIN sizes z ON z.doc_id = d.doc_id
JOIN (SELECT node, min(other) AS component_id FROM reach GROUP BY node) r ON r.node = d.doc_id
"""

OP11 = r"""
WITH docs AS (
  SELECT row_number() OVER () AS r, coalesce(text, '') AS text, coalesce(lang, '') AS lang, coalesce(source, '') AS source FROM documents
), found AS (
  SELECT r, lang, source, unnest(regexp_extract_all(
    translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')) AS term
  FROM docs
), kept AS (
  SELECT lang, term, count(*) AS c FROM found GROUP BY lang, term HAVING count(DISTINCT r) >= 10
), langs AS (
  SELECT d.lang, coalesce(k.v, 0) AS v, coalesce(k.total, 0) AS total FROM (SELECT DISTINCT lang FROM docs) d
  LEFT JOIN (SELECT lang, count(*) AS v, sum(c) AS total FROM kept GROUP BY lang) k USING (lang)
), counts AS (
  SELECT lang, source, term, count(*) AS c FROM found SEMI JOIN kept USING (lang, term) GROUP BY ALL
), sources AS (
  SELECT d.lang, d.source, coalesce(n.total, 0) AS total FROM (SELECT DISTINCT lang, source FROM docs) d
  LEFT JOIN (SELECT lang, source, sum(c) AS total FROM counts GROUP BY ALL) n USING (lang, source)
), full_table AS (
  SELECT s.lang, s.source, k.term, coalesce(c.c, 0) AS c,
         1 + (1000000000::HUGEINT * (coalesce(c.c, 0) + 2)) // (s.total + 2 * l.v) AS p,
         1 + (1000000000::HUGEINT * (k.c + 2)) // (l.total + 2 * l.v) AS q
  FROM sources s JOIN langs l USING (lang) JOIN kept k USING (lang) LEFT JOIN counts c USING (lang, source, term)
), sums AS (
  SELECT a.lang, a.source, b.source AS item, sum(((a.p - b.p) * (a.p - b.p)) // (a.p + b.p)) AS value
  FROM full_table a JOIN full_table b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL
), pairs AS (
  SELECT a.lang, a.source, 'pair' AS part, b.source AS item, CAST(coalesce(s.value, 0) AS BIGINT) AS value
  FROM sources a JOIN sources b ON a.lang = b.lang AND a.source <> b.source
  LEFT JOIN sums s ON s.lang = a.lang AND s.source = a.source AND s.item = b.source
), terms AS (
  SELECT lang, source, 'term' AS part, term AS item, CAST(((p - q) * (p - q)) // (p + q) AS BIGINT) AS value
  FROM full_table WHERE c > 0 AND p > q
)
SELECT *, CAST(row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS INTEGER) AS rank
FROM (FROM pairs UNION ALL FROM terms)
QUALIFY part = 'pair' OR rank <= 10
"""

ORACLES: dict[str, str] = {"op3_arc_to_warc": OP3, "op7_jaccard_join": OP7, "op11_source_divergence": OP11}
