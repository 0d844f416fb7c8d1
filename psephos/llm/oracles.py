"""SQL of the operators whose whole result SQL can say, for DuckDB over the same tables."""

from __future__ import annotations

from psephos.llm import license_scan, near_dedup

# The rules in SQL: words by one pattern, three-word windows by their places.
QUALITY = r"""
WITH t AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
w AS (SELECT doc_id, text, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS words FROM t),
p AS (SELECT doc_id, unnest(words) AS word, generate_subscripts(words, 1) AS i FROM w),
g AS (SELECT doc_id, i, word || chr(10) || lead(word) OVER o || chr(10) || lead(word, 2) OVER o AS g FROM p WINDOW o AS (PARTITION BY doc_id ORDER BY i)),
r AS (SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, g) AS c FROM g WHERE g IS NOT NULL) WHERE c > 1),
c AS (SELECT doc_id, count(DISTINCT i + d) AS n FROM r, range(3) x(d) GROUP BY 1),
l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM t),
k AS (SELECT doc_id, count(*) AS n_lines, count(*) - count(DISTINCT line) AS n_dup_lines FROM l WHERE regexp_matches(line, '[^\x20\x09-\x0D]') GROUP BY 1),
m AS (SELECT w.doc_id, len(words) AS n_words, coalesce(length(array_to_string(words, '')), 0) AS word_chars, length(regexp_replace(text, '[^#*$%&|<>]', '', 'g')) AS n_symbols,
  coalesce(n_lines, 0) AS n_lines, coalesce(n_dup_lines, 0) AS n_dup_lines, coalesce(n, 0) AS n_repeat_words, length(regexp_replace(text, '[^!]', '', 'g')) AS n_exclaims
  FROM w LEFT JOIN c USING (doc_id) LEFT JOIN k USING (doc_id)),
f AS (SELECT *, (n_words < 50)::BIGINT + 2 * (100 * n_repeat_words > 50 * n_words)::BIGINT + 4 * (10 * n_symbols > n_words)::BIGINT + 8 * (10 * n_dup_lines > 6 * n_lines)::BIGINT
  + 16 * (word_chars < 2 * n_words OR word_chars > 16 * n_words)::BIGINT + 32 * (4 * n_exclaims > n_words)::BIGINT AS failures FROM m)
SELECT doc_id, n_words, word_chars, n_symbols, n_lines, n_dup_lines, n_repeat_words, n_exclaims, failures, (failures & 3) <> 0 AS base_failed, failures = 0 AS kept FROM f"""

WARC = """
WITH h AS (SELECT page_id, octet_length(encode(coalesce(html, ''))) AS payload_bytes, sha256(coalesce(html, '')) AS payload_digest FROM pages),
f AS (SELECT *, CASE WHEN payload_bytes >= 100 THEN min(page_id) OVER (PARTITION BY payload_digest) ELSE page_id END AS first FROM h)
SELECT page_id, payload_bytes, payload_digest, CASE WHEN page_id = first THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN page_id <> first THEN first END AS refers_to FROM f"""


def licenses() -> str:
    """Every block against every template's tokens, without the filters."""
    templates = license_scan.Scanner({}).templates
    tokens = ",\n  ".join(f"('{t.name}', '{t.label}', {t.size}, {t.need}, {len(t.tokens)}, '{w.decode()}', {w in t.naming}, {len(t.naming)})" for t in templates for w in t.tokens)
    phrases = "\n  ".join(f"UNION ALL SELECT doc_id, rid, i, '{label}' FROM p WHERE " + " AND ".join(f"{'w' + str(k) if k else 'word'} = '{w}'" for k, w in enumerate(phrase.split())) for phrase, label in license_scan.BASE.items())
    return rf"""
WITH tok(template, label, c, need, m, token, naming, named) AS (VALUES
  {tokens}),
t AS (SELECT row_number() OVER () AS rid, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS words FROM documents),
u AS (SELECT doc_id, rid, unnest(words) AS word, generate_subscripts(words, 1) - 1 AS i FROM t),
p AS (SELECT *, lead(word) OVER o AS w1, lead(word, 2) OVER o AS w2 FROM u WINDOW o AS (PARTITION BY rid ORDER BY i)),
b AS (SELECT NULL::BIGINT AS doc_id, NULL::BIGINT AS rid, NULL::BIGINT AS i, '' AS label WHERE false
  {phrases}),
k AS (SELECT rid, template, label, m, named, i // c - d AS block, count(DISTINCT token) AS shared, count(DISTINCT CASE WHEN naming THEN token END) AS naming
  FROM u JOIN tok ON word = token, range(2) r(d) WHERE i // c >= d GROUP BY ALL HAVING count(DISTINCT token) >= any_value(need)),
s AS (SELECT rid, count(*) AS n_blocks, max(shared / m) AS score FROM k GROUP BY 1),
n AS (SELECT rid, count(*) AS n_base, min(i) AS first_word, max(i) AS last_word, string_agg(DISTINCT label, ',' ORDER BY label) AS base_labels FROM b GROUP BY 1),
l AS (SELECT rid, string_agg(DISTINCT label, ',' ORDER BY label) AS labels FROM (SELECT rid, label FROM b UNION ALL SELECT rid, label FROM k WHERE naming = named) GROUP BY 1)
SELECT doc_id, len(words) AS n_words, coalesce(n_base, 0) AS n_base, first_word, last_word, coalesce(base_labels, '') AS base_labels, coalesce(labels, '') AS labels,
  CASE WHEN n_base > 0 THEN 1.0::DOUBLE ELSE coalesce(score, 0.0) END AS score, coalesce(n_blocks, 0) AS n_blocks
FROM t LEFT JOIN n USING (rid) LEFT JOIN s USING (rid) LEFT JOIN l USING (rid)"""


def near_duplicates() -> str:
    """Both similarities of every pair that shares a shingle, and the components of what they link.

    The maxima of the probability Jaccard are sums up to and from each shingle, in order of the weights'
    quotient.
    """
    n, least = near_dedup.SHINGLE, near_dedup.SIMILARITY
    return rf"""
WITH RECURSIVE t AS (SELECT doc_id, regexp_extract_all(lower(coalesce(text, '')), '\S+') AS words FROM documents WHERE doc_id IS NOT NULL),
e AS (SELECT DISTINCT doc_id, words, array_to_string(words, ' ') AS copy FROM t),
nodes AS (SELECT copy, min(doc_id) AS node, any_value(words) AS words FROM e GROUP BY 1),
u AS (SELECT node, len(words) AS n, words, unnest(range(1, greatest(len(words) - {n - 1}, 1) + 1)) AS i FROM nodes WHERE len(words) > 0),
s AS (SELECT node, array_to_string(words[i : i + {n - 1}], ' ') AS shingle, 1 + log2(count(*)) AS w FROM u GROUP BY 1, 2),
z AS (SELECT node, count(*) AS size, sum(w) AS total FROM s GROUP BY 1),
met AS (SELECT a.node AS x, b.node AS y, a.w AS p, b.w AS q FROM s a JOIN s b USING (shingle) WHERE a.node < b.node),
pairs AS (SELECT x, y, count(*) AS shared, sum(p) AS sp, sum(q) AS sq FROM met GROUP BY 1, 2),
c AS (SELECT x, y, shared, k.size AS nx, l.size AS ny, k.total - sp AS only_x, l.total - sq AS only_y FROM pairs JOIN z k ON k.node = x JOIN z l ON l.node = y),
j AS (SELECT x, y, sum(1 / ((only_x + above) / p + (only_y + below) / q)) AS alike FROM (
  SELECT x, y, p, q, sum(p) OVER (PARTITION BY x, y ORDER BY p / q DESC ROWS UNBOUNDED PRECEDING) AS above, coalesce(sum(q) OVER (PARTITION BY x, y ORDER BY p / q DESC ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING), 0) AS below
  FROM met) JOIN c USING (x, y) GROUP BY 1, 2),
links AS (SELECT x, y FROM c JOIN j USING (x, y) WHERE shared >= {least} * (nx + ny - shared) - 1e-9 OR alike >= {least} - 1e-9),
sides AS (SELECT x AS a, y AS b FROM links UNION SELECT y, x FROM links),
reach(a, b) AS (SELECT a, b FROM sides UNION SELECT reach.a, sides.b FROM reach JOIN sides ON reach.b = sides.a),
comp AS (SELECT a AS node, least(a, min(b)) AS class_id FROM reach GROUP BY a),
named AS (SELECT copy, node, coalesce(class_id, node) AS class_id FROM nodes LEFT JOIN comp USING (node))
SELECT d.doc_id, node AS copy_of, class_id FROM (SELECT doc_id, array_to_string(regexp_extract_all(lower(coalesce(text, '')), '\S+'), ' ') AS copy FROM documents) d LEFT JOIN named ON d.doc_id IS NOT NULL AND d.copy = named.copy"""


def oracle_sql() -> dict[str, str]:
    """SQL where it can say the whole result; the other operators are tested against plain Python."""
    return {"op4_license_scan": licenses(), "op5_warc": WARC, "op7_quality_ledger": QUALITY, "op9_near_dedup": near_duplicates()}
