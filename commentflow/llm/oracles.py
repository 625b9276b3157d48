"""DuckDB SQL with the results of the queries that SQL can express."""

from __future__ import annotations

from commentflow.llm import licenses

WORDS = r"list_filter(string_split_regex(coalesce(text, ''), '[\x20\x09-\x0D]'), lambda w: w <> '')"

OP1 = rf"""
WITH d AS (
  SELECT row_number() OVER () AS rid, doc_id, {WORDS} AS w,
    list_filter(string_split(coalesce(text, ''), chr(10)),
      lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines
  FROM documents
), tri AS (
  SELECT rid, i, count(*) OVER (PARTITION BY rid, g) AS c FROM (
    SELECT rid, i, w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] AS g
    FROM (SELECT rid, w, unnest(range(1, len(w) - 1)) AS i FROM d))
), rep AS (
  SELECT rid, count(DISTINCT i + k) AS n
  FROM (SELECT rid, i, unnest([0, 1, 2]) AS k FROM tri WHERE c > 1) GROUP BY rid
), m AS (
  SELECT doc_id, len(w) AS n_words, array_to_string(w, '') AS bare, len(lines) AS n_lines,
    len(lines) - len(list_distinct(lines)) AS n_dup_lines, coalesce(n, 0) AS n_repeat_words
  FROM d LEFT JOIN rep USING (rid)
), c AS (
  SELECT doc_id, n_words, length(bare) AS word_chars,
    length(regexp_replace(bare, '[^#*$%&|<>]+', '', 'g')) AS n_symbols,
    n_dup_lines, n_repeat_words, n_lines,
    length(regexp_replace(bare, '\P{{Lu}}+', '', 'g')) AS n_upper,
    length(regexp_replace(bare, '[^!?]+', '', 'g')) AS n_marks
  FROM m
), b AS (
  SELECT *, if(n_words < 50, 1, 0) | if(100 * n_repeat_words > 50 * n_words, 2, 0)
    | if(100 * n_symbols > 10 * n_words, 4, 0) | if(word_chars < 2 * n_words, 8, 0)
    | if(word_chars > 20 * n_words, 16, 0) | if(100 * n_dup_lines > 60 * n_lines, 32, 0)
    | if(100 * n_upper > 40 * word_chars, 64, 0) | if(100 * n_marks > 50 * n_words, 128, 0)
    AS fail_bits
  FROM c
)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
  (fail_bits & 3) <> 0 AS base_failed, fail_bits = 0 AS kept, n_lines, n_upper, n_marks, fail_bits
FROM b
"""


OP6 = rf"""
WITH RECURSIVE d AS (
  SELECT doc_id, {WORDS} AS w FROM (
    SELECT doc_id, translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS text
    FROM documents)
), s AS (
  SELECT DISTINCT doc_id, array_to_string(w[i:i + 4], ' ') AS g FROM (
    SELECT doc_id, w, unnest(range(1, greatest(len(w) - 3, 2))) AS i FROM d WHERE len(w) > 0)
), n AS (
  SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id
), p AS (
  SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS common
  FROM s x JOIN s y ON x.g = y.g AND x.doc_id < y.doc_id GROUP BY ALL
), l AS (
  SELECT a, b FROM p JOIN n na ON na.doc_id = a JOIN n nb ON nb.doc_id = b
  WHERE 100 * common >= 80 * (na.n + nb.n - common)
), e AS (
  SELECT a, b FROM l UNION ALL SELECT b, a FROM l
), r AS (
  SELECT doc_id, doc_id AS c FROM d UNION SELECT e.b, r.c FROM r JOIN e ON e.a = r.doc_id
)
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, min(r.c) AS component_id
FROM d LEFT JOIN n USING (doc_id) JOIN r USING (doc_id) GROUP BY d.doc_id, n.n
"""


OP3 = """
WITH p AS (
  SELECT page_id, coalesce(html, '') AS html, sha1(coalesce(html, '')) AS h FROM pages
), r AS (
  SELECT *, min(page_id) OVER (PARTITION BY html) AS first FROM p
)
SELECT page_id, strlen(html) AS payload_bytes,
  array_to_string(list_transform(range(32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
    CAST(((CAST('0x' || substr(h, CAST(i // 4 * 5 + 1 AS BIGINT), 5) AS BIGINT)
      >> CAST(15 - 5 * (i % 4) AS BIGINT)) & 31) AS BIGINT) + 1, 1)), '') AS payload_digest,
  CASE WHEN page_id = first THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN page_id <> first THEN first END AS refers_to
FROM r
"""


def _op7() -> str:
    out, words, unified = licenses.canonical("_unit", ", 'g'")
    known = ", ".join("('{}', '{}')".format(i, t.replace("'", "''")) for i, t in licenses.KNOWN)

    def digests(table: str) -> str:
        return f"""SELECT * EXCLUDE (_u), md5(if(regexp_matches(_u, ' (?:{words}) '), {unified}, _u)) AS digest
  FROM (SELECT *, ' ' || {out} || ' ' AS _u FROM {table}) WHERE _u <> '  '"""

    return f"""
WITH k AS (SELECT * FROM (VALUES {known}) AS v(license, _unit)),
u AS (
  SELECT doc_id, NULL AS line, text AS _unit FROM documents WHERE text IS NOT NULL
  UNION ALL SELECT doc_id, i - 1, p[i] FROM (
    SELECT doc_id, string_split(text, chr(10)) AS p, unnest(range(1, len(p) + 1)) AS i FROM documents WHERE text IS NOT NULL)
)
SELECT doc_id, CASE WHEN line IS NULL THEN 'text' ELSE 'line' END AS unit, CAST(line AS BIGINT) AS line, license
FROM ({digests('u')}) d JOIN (SELECT DISTINCT digest, license FROM ({digests('k')})) USING (digest)
"""


OP12 = r"""
WITH RECURSIVE f AS (
  SELECT row_number() OVER () AS rid, doc_id, lang, text, CAST(doc_id AS VARCHAR) AS id, concat(
    coalesce(strlen(CAST(doc_id AS VARCHAR)) || ':' || CAST(doc_id AS VARCHAR), '-'),
    coalesce(strlen(source) || ':' || source, '-'), coalesce(strlen(lang) || ':' || lang, '-'),
    coalesce(strlen(CAST(n_chars AS VARCHAR)) || ':' || CAST(n_chars AS VARCHAR), '-')) AS head
  FROM documents
), g AS (
  SELECT rid, doc_id, lang, sha256(head || coalesce(strlen(text) || ':' || text, '-')) AS leaf,
    sha256(head || coalesce(strlen(text) || ':' || translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '-')) AS lowered,
    xor(4294967295, list_reduce(list_concat([CAST(4294967295 AS BIGINT)], flatten(list_transform(range(1, length(id) + 1),
      lambda i: list_concat([CAST(ascii(id[i]) AS BIGINT)], [-1, -1, -1, -1, -1, -1, -1, -1])))),
      lambda c, x: CASE WHEN x >= 0 THEN xor(c, x) ELSE xor(c >> 1, 3988292384 * (c & 1)) END)) AS crc
  FROM f
), d AS (
  SELECT *, row_number() OVER (PARTITION BY lang ORDER BY doc_id NULLS FIRST, leaf) - 1 AS pos,
    count(*) OVER (PARTITION BY lang) AS n
  FROM g
), tree AS (
  SELECT lang, 0 AS lvl, pos, n, leaf AS h FROM d
  UNION ALL
  SELECT lang, lvl + 1, pos // 8, (n + 7) // 8, sha256(string_agg(h, '' ORDER BY pos))
  FROM tree WHERE n > 1 GROUP BY lang, lvl, pos // 8, n
), sub AS (
  SELECT lang, h, row_number() OVER (ORDER BY lang NULLS FIRST) - 1 AS pos, count(*) OVER () AS n
  FROM tree WHERE n = 1
), top AS (
  SELECT 0 AS lvl, pos, n, h FROM sub
  UNION ALL
  SELECT lvl + 1, pos // 8, (n + 7) // 8, sha256(string_agg(h, '' ORDER BY pos))
  FROM top WHERE n > 1 GROUP BY lvl, pos // 8, n
), node AS (
  SELECT rid, d.lang, d.pos >> (3 * k) AS spot, k AS lvl FROM d, range(0, 16) AS r(k)
), low AS (
  SELECT rid, t.lvl AS step, string_agg(h, '' ORDER BY pos) FILTER (pos < spot) AS l,
    string_agg(h, '' ORDER BY pos) FILTER (pos > spot) AS r
  FROM node JOIN tree t ON t.lang IS NOT DISTINCT FROM node.lang AND t.lvl = node.lvl AND t.pos // 8 = spot // 8
  WHERE t.n > 1 GROUP BY rid, t.lvl
), high AS (
  SELECT sub.lang, t.lvl + 100 AS step,
    string_agg(t.h, '' ORDER BY t.pos) FILTER (t.pos < sub.pos >> (3 * t.lvl)) AS l,
    string_agg(t.h, '' ORDER BY t.pos) FILTER (t.pos > sub.pos >> (3 * t.lvl)) AS r
  FROM sub JOIN top t ON t.pos // 8 = sub.pos >> (3 * t.lvl + 3) WHERE t.n > 1 GROUP BY sub.lang, t.lvl
), steps AS (
  SELECT rid, row_number() OVER (PARTITION BY rid ORDER BY step) AS k, coalesce(l, '') AS l, coalesce(r, '') AS r
  FROM (SELECT * FROM low UNION ALL
    SELECT rid, step, l, r FROM d JOIN high ON d.lang IS NOT DISTINCT FROM high.lang)
), fold AS (
  SELECT rid, CAST(1 AS BIGINT) AS k, CASE WHEN crc % 3 = 0 THEN lowered ELSE leaf END AS h FROM d
  UNION ALL
  SELECT rid, k + 1, sha256(l || h || r) FROM fold JOIN steps USING (rid, k)
), proof AS (
  SELECT rid, sha256(string_agg(l || r, '' ORDER BY k)) AS p FROM steps GROUP BY rid
), ended AS (
  SELECT rid, arg_max(h, k) AS folded_root FROM fold GROUP BY rid
), root AS (SELECT h AS root FROM top WHERE n = 1)
SELECT doc_id, leaf, sub.h AS subroot, root, coalesce(p, sha256('')) AS proof_sha256, folded_root,
  folded_root = root AS verified
FROM d JOIN sub ON d.lang IS NOT DISTINCT FROM sub.lang JOIN ended USING (rid) LEFT JOIN proof USING (rid), root
"""


_PLAIN_WORDS = (
    r"list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', "
    r"'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda w: w <> '')"
)

OP13 = rf"""
WITH d AS (
  SELECT row_number() OVER () AS rid, doc_id, {_PLAIN_WORDS} AS w FROM documents
), i AS (
  SELECT item_id, {_PLAIN_WORDS} AS w FROM benchmark
), test AS (
  SELECT DISTINCT item_id, n, array_to_string(w[s : s + n - 1], ' ') AS win
  FROM (SELECT item_id, w, n, unnest(range(1, len(w) - n + 2)) AS s
    FROM (SELECT *, least(len(w), 10) AS n FROM i WHERE len(w) > 0))
), spot AS (
  SELECT rid, n, s, array_to_string(w[s : s + n - 1], ' ') AS win
  FROM (SELECT rid, w, n, unnest(range(1, len(w) - n + 2)) AS s FROM d, (SELECT DISTINCT n FROM test))
), hit AS (
  SELECT rid, n, s, item_id FROM spot JOIN test USING (n, win)
), covered AS (
  SELECT rid, count(DISTINCT p) AS n_hit
  FROM (SELECT DISTINCT rid, unnest(range(s, s + n)) AS p FROM hit) GROUP BY rid
), held AS (
  SELECT rid, count(*) AS n_items, string_agg(id, ',' ORDER BY id) AS ids
  FROM (SELECT DISTINCT rid, CAST(item_id AS VARCHAR) AS id FROM hit WHERE item_id IS NOT NULL) GROUP BY rid
)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
  sha256(coalesce(ids, '')) AS items_sha256, n_hit IS NOT NULL AS contaminated
FROM d LEFT JOIN covered USING (rid) LEFT JOIN held USING (rid)
"""


def oracle_sql() -> dict[str, str]:
    return {"op1_quality": OP1, "op3_warc": OP3, "op6_ngram_join": OP6, "op12_merkle": OP12, "op13_winnowing": OP13, "op7_licenses": _op7()}
