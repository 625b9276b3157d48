"""The same results in SQL, for checking the queries in DuckDB."""

from __future__ import annotations

from commentflow.constants import BUG_TITLE_KEYWORDS, SECURITY_KEYWORDS, TITLE_KEYWORDS

# Character class of Unicode whitespace, as text functions strip it.
WS = r"[\t-\r\x1c-\x1f \x{85}\p{Z}]"

NOW = "TIMESTAMP '2024-02-01 00:00:00'"

# Views the queries start from.
C = """c AS (
  SELECT event_id AS id, 'src' || (user_id % 11) AS repo, user_id % 2 = 1 AS is_pr,
         user_id AS issue_number, 'src' || (user_id % 11) || '#' || user_id AS context_id,
         ts AS created_at, event_type,
         CASE event_type WHEN 'signup' THEN 'issue_body' WHEN 'view' THEN 'pr_body'
              ELSE 'issue_comment' END AS comment_type,
         CAST(json_extract(props, '$.k') AS BIGINT) AS reactions, value AS score
  FROM events)"""
LANDED = "landed AS (SELECT * FROM c WHERE created_at < TIMESTAMP '2024-01-11 00:00:00')"
DROPS = "dropped AS (SELECT *, 3 - least((day(created_at) - 1) // 8, 3) AS landing FROM c)"
STATE = """st AS (
  SELECT repo AS source, max(created_at) AS newest_ts, min(created_at) AS oldest_ts
  FROM landed GROUP BY repo)"""
D = """d AS (
  SELECT doc_id AS id, text, lang, source, source || '#' || (doc_id % 50) AS context_id,
         TIMESTAMP '2024-01-01 00:00:00' + to_hours(CAST(doc_id AS INTEGER)) AS created_at,
         split_part(text, chr(10), 1) AS title, lang || ';' || source AS labels
  FROM documents)"""
S = """s AS (
  SELECT doc_id AS id, CASE WHEN toxic = 1 THEN 'test' ELSE 'validation' END AS split,
         CAST((doc_id * 7919) % 101 AS DOUBLE) / CAST(100 AS DOUBLE) AS score, quality AS y
  FROM labels)"""
L = """l AS (
  SELECT vec_id // 5 AS id, 'ctx' || (vec_id // 50) AS context_id, vec_id % 5 AS window_no,
         CAST(list_sum(list_transform(embedding[1:21], lambda x: CAST(round(CAST(x AS DOUBLE) * 1000000) AS BIGINT))) AS DOUBLE) / 1000000 AS l0,
         CAST(list_sum(list_transform(embedding[22:42], lambda x: CAST(round(CAST(x AS DOUBLE) * 1000000) AS BIGINT))) AS DOUBLE) / 1000000 AS l1,
         CAST(list_sum(list_transform(embedding[43:64], lambda x: CAST(round(CAST(x AS DOUBLE) * 1000000) AS BIGINT))) AS DOUBLE) / 1000000 AS l2, CAST(label % 3 AS BIGINT) AS y
  FROM embeddings),
m AS (SELECT *, greatest(l0, l1, l2) AS top FROM l),
e AS (SELECT *, exp(l0 - top) AS e0, exp(l1 - top) AS e1, exp(l2 - top) AS e2 FROM m),
pr AS (
  SELECT id, context_id, window_no, y, l0, l1, l2, top, e0 / (e0 + e1 + e2) AS p0,
         e1 / (e0 + e1 + e2) AS p1, e2 / (e0 + e1 + e2) AS p2
  FROM e)"""
TOKENS = r"""tok AS (
  SELECT *, list_filter(string_split_regex(text, '[ \t\n\r\f]+'), lambda x: x <> '') AS t FROM d)"""


def windows(cap: int | None = None, content: int = 64, step: int = 48) -> str:
    """tok with its number of windows ``nw``, and the windows themselves."""
    n = f"greatest(CAST(ceil((len(t) - {content}) / CAST({step} AS DOUBLE)) AS BIGINT), 0) + 1"
    if cap:
        n = f"least({n}, {cap})"
    return f"""{TOKENS},
cnt AS (SELECT *, {n} AS nw FROM tok),
win AS (
  SELECT *, array_to_string(t[i * {step} + 1 : i * {step} + {content}], ' ') AS w,
         len(t[i * {step} + 1 : i * {step} + {content}]) AS n_tokens
  FROM (SELECT *, unnest(range(nw)) AS i FROM cnt))"""


def strip(expr: str) -> str:
    return f"regexp_replace({expr}, '^{WS}+|{WS}+\\z', '', 'g')"


WEAK = """CASE
  WHEN source = 'src3' OR contains(lower(title), 'license') OR contains(lower(title), '@')
       OR contains(lower(text), 'license') OR contains(lower(text), '@') THEN 'security'
  WHEN lang = 'de' OR contains(lower(title), 'token') THEN 'bug'
  ELSE 'other' END"""

TIME_TEXTS = """x AS (
  SELECT id, created_at, CASE event_type WHEN 'click' THEN CAST(CAST(floor(epoch(created_at)) AS BIGINT) AS VARCHAR)
              WHEN 'error' THEN 'n/a' WHEN 'purchase' THEN NULL
              ELSE strftime(created_at, '%Y-%m-%dT%H:%M:%SZ') END AS time_text,
         CASE WHEN event_type <> 'error' THEN strftime(created_at, '%Y-%m-%d') END AS day_text
  FROM c)"""

FORUM = """f AS (
  SELECT *, CASE WHEN event_type = 'click' THEN 't1_' ELSE 't3_' END || context_id AS parent_id,
         CASE event_type WHEN 'error' THEN '[removed]' WHEN 'signup' THEN ' [deleted]' || chr(10)
              ELSE event_type END AS body
  FROM c)"""

UPDATED = "up AS (SELECT context_id, max(created_at) AS container_updated_at FROM c GROUP BY context_id)"

LABELLED = """lab AS (
  SELECT cnt.*, CASE WHEN quality = 1 THEN 'security' WHEN toxic = 1 THEN 'bug' ELSE 'other' END AS label
  FROM cnt JOIN labels ON cnt.id = labels.doc_id)"""

WEIGHTS = """wt AS (
  SELECT label, row_number() OVER (ORDER BY label) - 1 AS label_id, n_rows,
         CAST(sum(n_rows) OVER () AS DOUBLE) / (count(*) OVER () * n_rows) AS weight
  FROM (SELECT label, CAST(sum(nw) AS BIGINT) AS n_rows FROM lab GROUP BY label))"""

CURVE = """pts AS (
  SELECT score, sum(y) AS pos, sum(1 - y) AS neg FROM s GROUP BY score),
cum AS (
  SELECT score, CAST(sum(pos) OVER w AS BIGINT) AS tp, CAST(sum(neg) OVER w AS BIGINT) AS fp,
         CAST(sum(pos) OVER () AS BIGINT) AS positives
  FROM pts WINDOW w AS (ORDER BY score DESC)),
curve AS (
  SELECT score, tp, fp, tp / greatest(CAST(tp + fp AS DOUBLE), 1e-9) AS prec,
         tp / greatest(CAST(positives AS DOUBLE), 1e-9) AS rec
  FROM cum)"""

PRED = "p AS (SELECT *, CASE WHEN score >= 0.5 THEN 1 ELSE 0 END AS yhat FROM s)"
OUTCOME = """CASE WHEN y = 1 AND yhat = 1 THEN 'TP' WHEN y = 0 AND yhat = 1 THEN 'FP'
  WHEN y = 0 AND yhat = 0 THEN 'TN' ELSE 'FN' END"""


def topk(order: str, rel: str = "c") -> str:
    return f"""SELECT id, context_id FROM (
  SELECT *, row_number() OVER (PARTITION BY context_id ORDER BY {order}) AS n FROM {rel}) WHERE n <= 2"""


def budget(rel: str, limit: int) -> str:
    return f"""SELECT id, repo, comment_type FROM (
  SELECT r.*, row_number() OVER (PARTITION BY repo ORDER BY is_pr, container_updated_at DESC,
         issue_number, created_at, id) AS n
  FROM {rel} r JOIN up USING (context_id) WHERE comment_type = 'issue_comment') WHERE n <= {limit}
UNION ALL
SELECT id, repo, comment_type FROM {rel} WHERE comment_type <> 'issue_comment'"""


def normalized(expr: str) -> str:
    blanks = r"regexp_replace(%s, '[\t\f\x0B]', ' ', 'g')"
    out = f"regexp_replace({expr}, '[\\x{{200B}}\\x{{200C}}\\x{{200D}}\\x{{FEFF}}]', '', 'g')"
    out = f"replace({blanks % out}, chr(13), chr(10))"
    out = f"regexp_replace(regexp_replace({out}, ' +', ' ', 'g'), '\\n{{3,}}', chr(10) || chr(10), 'g')"
    return strip(out)


def with_(*ctes: str) -> str:
    return "WITH " + ",\n".join(ctes) + "\n"


DRIFT = """q AS (
  SELECT event_id AS id, event_type, CASE event_id % 7
    WHEN 0 THEN '{"k": "' || json_extract_string(props, '$.k') || '"}'
    WHEN 1 THEN substring(props, 1, length(props) - 1)
    WHEN 2 THEN '{"tag": "t' || json_extract_string(props, '$.k') || '", "k": ' || json_extract_string(props, '$.k') || '}'
    WHEN 3 THEN '{"reactions": {"k": ' || json_extract_string(props, '$.k') || '}, "tag": [' || json_extract_string(props, '$.k') || ']}'
    WHEN 4 THEN CASE WHEN event_id % 2 = 0 THEN '{"k": null, "tag": null}' END
    ELSE props END AS payload
  FROM events),
j AS (SELECT *, CASE WHEN json_valid(payload) THEN payload END AS good FROM q)"""
KINDS = """CASE json_type(good, {0}) WHEN 'NULL' THEN 'null' WHEN 'VARCHAR' THEN 'string' WHEN 'BOOLEAN' THEN 'boolean'
    WHEN 'UBIGINT' THEN 'whole' WHEN 'BIGINT' THEN 'whole' WHEN 'DOUBLE' THEN 'number' WHEN 'OBJECT' THEN 'object'
    WHEN 'ARRAY' THEN 'array' END"""
# Full-batch steps of all candidates: one row per candidate with its coefficients in a list
# (feature by feature, class by class).
FIT = """r AS (
  SELECT id % 5 = 0 AS dev, y, [CAST(1 AS DOUBLE), l0 / 4, l1 / 4, l2 / 4] AS x FROM l
), cw AS (
  SELECT y, sum(count(*)) OVER () / (count(*) OVER () * CAST(count(*) AS DOUBLE)) AS w FROM r WHERE NOT dev GROUP BY y
), t AS (
  SELECT row_number() OVER () AS rid, dev, r.y, x, coalesce(w, CAST(1 AS DOUBLE)) AS w FROM r LEFT JOIN cw USING (y)
), tot AS (
  SELECT sum(w) AS total FROM t WHERE NOT dev
), fit AS (
  SELECT CAST(0 AS BIGINT) AS step, CAST(c AS BIGINT) AS c, reg, list_transform(range(12), lambda p: CAST(0 AS DOUBLE)) AS b
  FROM (VALUES (0, 0.001::DOUBLE), (1, 0.01::DOUBLE), (2, 0.1::DOUBLE), (3, 1::DOUBLE)) AS g(c, reg)
  UNION ALL
  SELECT step + 1, c, reg, list(nb ORDER BY p) FROM (
    SELECT step, c, reg, p, any_value(b[p + 1]) - sum(w * (e[p % 3 + 1] / (e[1] + e[2] + e[3]) - CASE WHEN y = p % 3 THEN 1 ELSE 0 END)
        * x[p // 3 + 1]) / any_value(total) - CASE WHEN p >= 3 THEN reg * any_value(b[p + 1]) ELSE 0 END AS nb
    FROM (
      SELECT *, unnest(range(12)) AS p FROM (
        SELECT step, c, reg, b, w, y, x, total, list_transform(z, lambda v: exp(v - list_max(z))) AS e FROM (
          SELECT step, c, reg, b, w, y, x, total, list_transform([0, 1, 2],
            lambda k: x[1] * b[k + 1] + x[2] * b[k + 4] + x[3] * b[k + 7] + x[4] * b[k + 10]) AS z
          FROM fit, t, tot WHERE NOT dev AND step < 12)))
    GROUP BY step, c, reg, p)
  GROUP BY step, c, reg
), last AS (SELECT c, reg, b FROM fit WHERE step = 12)"""
NEW = "fresh AS (SELECT * FROM c WHERE NOT EXISTS (SELECT 1 FROM landed WHERE landed.id = c.id))"
SPLIT = """th AS (SELECT o_custkey, min(o_orderdate) AS first_ts FROM orders GROUP BY o_custkey),
rk AS (SELECT o_custkey, row_number() OVER (ORDER BY first_ts, o_custkey) - 1 AS r, count(*) OVER () AS n FROM th),
sp AS (
  SELECT o_custkey, CASE WHEN r < floor(n * CAST(0.7 AS DOUBLE)) THEN 'train'
         WHEN r < floor(n * CAST(0.7 AS DOUBLE)) + floor(n * CAST(0.15 AS DOUBLE)) THEN 'dev'
         ELSE 'test' END AS split
  FROM rk)"""
METRICS = """k AS (
  SELECT split, count(*) FILTER (WHERE y = 1 AND yhat = 1) AS tp, count(*) FILTER (WHERE y = 0 AND yhat = 1) AS fp,
         count(*) FILTER (WHERE y = 1 AND yhat = 0) AS fn, count(*) FILTER (WHERE y = 0 AND yhat = 0) AS tn
  FROM p GROUP BY split),
r AS (
  SELECT *, tp / greatest(CAST(tp + fp AS DOUBLE), 1e-9) AS pr, tp / greatest(CAST(tp + fn AS DOUBLE), 1e-9) AS rc FROM k)
SELECT split, round(pr, 6) AS precision, round(rc, 6) AS recall,
       round(2 * pr * rc / greatest(pr + rc, 1e-9), 6) AS f1,
       round((tp + tn) / greatest(CAST(tp + tn + fp + fn AS DOUBLE), 1e-9), 6) AS accuracy, tp, fp, fn, tn
FROM r"""


def keywords(columns: tuple[str, ...], words: list[str]) -> str:
    return " OR ".join(f"contains(lower({c}), '{w}')" for c in columns for w in words)


KEYWORD_LIST = "[" + ", ".join(f"'{k}'" for k in TITLE_KEYWORDS) + "]"

SQL: dict[str, str] = {
    "scan_project": "SELECT doc_id, lang, source FROM documents",
    "source_allowlist": with_(C) + """SELECT id, repo FROM c
WHERE repo IN (SELECT 'src' || r_regionkey FROM region)""",
    "flatten_nested": """SELECT 'github_prbody_' || source || '#' || doc_id AS comment_id,
       source || '#pr:' || doc_id AS context_id, 'pr_body' AS comment_type,
       CAST(NULL AS VARCHAR) AS comment_author, text, CAST(NULL AS VARCHAR) AS thread_id
FROM documents
UNION ALL
SELECT 'github_pr_reviewcomment_' || doc_id || '-' || (i - 1), source || '#pr:' || doc_id,
       'review_comment', lang, line, 't' || (i - 1)
FROM (SELECT doc_id, source, lang, unnest(string_split(text, chr(10))) AS line,
             generate_subscripts(string_split(text, chr(10)), 1) AS i FROM documents)""",
    "json_props": "SELECT event_id, CAST(json_extract(props, '$.k') AS BIGINT) AS k FROM events",
    "container_join": """SELECT l_orderkey, CAST(l_linenumber AS BIGINT) AS l_linenumber, l_partkey,
       o_orderstatus, epoch_us(o_orderdate) AS updated_us
FROM lineitem JOIN orders ON l_orderkey = o_orderkey""",
    "union_inputs": """SELECT CAST(0 AS BIGINT) AS src_ord, doc_id AS id, text, lang FROM documents
UNION ALL BY NAME SELECT CAST(1 AS BIGINT) AS src_ord, item_id AS id, text FROM benchmark""",
    "append_unseen": with_(C, LANDED, NEW) + "SELECT id, repo, epoch_us(created_at) AS created_us FROM fresh",
    "dedupe_keep_first": """SELECT doc_id, key FROM (
  SELECT doc_id, md5(text) AS key, row_number() OVER (PARTITION BY md5(text) ORDER BY doc_id) AS n
  FROM documents) WHERE n = 1""",
    "map_core_schema": with_(C) + f"""SELECT 'e' || id AS id, event_type || ' ' || context_id AS text, 'other' AS label,
       CASE event_type WHEN 'signup' THEN 'github' WHEN 'click' THEN 'reddit' ELSE 'unknown' END AS source,
       CASE WHEN event_type = 'error' THEN epoch_us({NOW})
            ELSE epoch_us(date_trunc('second', created_at)) END AS created_us,
       repo || '#n:' || issue_number AS context_id,
       CAST(event_type = 'error' AS BIGINT) AS imputed
FROM c""",
    "row_builders": with_(C) + """SELECT repo, id AS issue_number,
       CASE kind WHEN 'body' THEN CASE WHEN is_pr THEN 'pr_body' ELSE 'issue_body' END
                 WHEN 'comment' THEN 'issue_comment' ELSE 'review_comment' END AS comment_type,
       CASE kind WHEN 'body' THEN CASE WHEN is_pr THEN 'github_prbody_' ELSE 'github_issuebody_' END || repo || '#' || id
                 WHEN 'comment' THEN CASE WHEN is_pr THEN 'github_pr_issuecomment_c' ELSE 'github_issuecomment_c' END || id
                 ELSE 'github_pr_reviewcomment_r' || id END AS comment_id,
       strftime(created_at, '%Y-%m-%dT%H:%M:%SZ') AS comment_created_at,
       CASE WHEN event_type <> 'error' THEN repo END AS comment_author,
       CASE WHEN kind <> 'body' AND event_type = 'view' THEN '' ELSE event_type END AS text,
       CASE WHEN kind = 'body' THEN 'https://h/c' ELSE 'https://h/' || id END AS comment_url,
       repo || CASE WHEN is_pr THEN '#pr:' ELSE '#issue:' END || id AS context_id,
       CASE WHEN kind <> 'review' THEN 'Item ' || issue_number END AS container_title,
       CASE WHEN kind <> 'review' THEN event_type || ';' || repo END AS container_labels,
       CASE WHEN kind = 'review' THEN 'th' || issue_number END AS thread_id,
       CASE WHEN kind = 'body' THEN 0 ELSE reactions END AS reactions
FROM (SELECT *, unnest(['body', 'comment', 'review']) AS kind FROM c)
WHERE kind <> 'review' OR is_pr""",
    "forum_row_builders": with_(C) + """SELECT repo AS subreddit, 'p' || id AS submission_id,
       strftime(created_at, '%Y-%m-%dT%H:%M:%SZ') AS submission_created_utc,
       CASE kind WHEN 'body' THEN 'reddit_postbody_p' ELSE 'c' END || id AS comment_id,
       strftime(CASE WHEN kind = 'reply' AND event_type <> 'click' THEN created_at + INTERVAL 60 SECOND
                     ELSE created_at END, '%Y-%m-%dT%H:%M:%SZ') AS comment_created_utc,
       CASE WHEN kind = 'body' THEN repo END AS comment_author,
       CASE WHEN kind = 'body' THEN context_id WHEN event_type = 'error' THEN '' ELSE event_type END AS comment_body,
       CASE WHEN kind = 'body' THEN 'https://www.reddit.com/r/x' ELSE 'https://www.reddit.com/r/x/c' END AS comment_permalink,
       'https://www.reddit.com/r/x' AS submission_url
FROM (SELECT *, unnest(['body', 'reply']) AS kind FROM c)
WHERE kind = 'reply' OR event_type <> 'view'""",
    "infer_source": """SELECT page_id, CASE WHEN contains(lower(url), 'example.com') THEN 'github'
       WHEN contains(lower(url), 'example.net') THEN 'reddit' ELSE 'unknown' END AS source FROM pages""",
    "null_fill": """SELECT d.doc_id, coalesce(CAST(quality AS VARCHAR), '') AS quality, '' AS container_title
FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id""",
    "bool_normalize": """SELECT d.doc_id, CASE quality WHEN 1 THEN 'true' WHEN 0 THEN 'false' END AS flag
FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id""",
    "ts_coalesce": with_(C, TIME_TEXTS) + """SELECT id, epoch_us(coalesce(
  try_cast(CASE WHEN NOT regexp_full_match(time_text, '[0-9]+') THEN time_text END AS TIMESTAMP),
  try_cast(day_text AS TIMESTAMP))) AS ts_us FROM x""",
    "ts_epoch_or_iso": with_(C, TIME_TEXTS) + f"""SELECT id, CASE
  WHEN regexp_full_match(time_text, '[0-9]+') THEN CAST(time_text AS BIGINT) * 1000000
  ELSE epoch_us(coalesce(try_cast(time_text AS TIMESTAMP), {NOW})) END AS ts_us FROM x""",
    "iso_epoch": with_(C) + """SELECT id, strftime(created_at, '%Y-%m-%dT%H:%M:%SZ') AS iso,
  CAST(floor(epoch(created_at)) AS BIGINT) AS epoch,
  CAST(epoch(date_trunc('second', created_at)) AS BIGINT) AS back FROM c""",
    "light_norm": "SELECT doc_id, " + strip(
        r"""regexp_replace(regexp_replace(regexp_replace(replace(replace(
  ' ' || chr(9) || replace(replace(text, '. ', '.' || chr(9) || '  '), chr(10), chr(13) || chr(10) || chr(10))
      || chr(8203) || ' ' || chr(12) || chr(12288), chr(9), ' '), chr(13), chr(10)),
  '[\x{200B}\x{200C}\x{200D}\x{FEFF}]', '', 'g'), '[ \t\f\x0B]+', ' ', 'g'), '\n{3,}', chr(10) || chr(10), 'g')"""
    ) + " AS text FROM documents",
    "build_context": with_(D) + f"SELECT id, {strip('title')} || ' [' || lang || '][' || source || ']' AS context FROM d",
    "label_list": with_(D) + """SELECT id, array_to_string(list_transform(list_filter(
  string_split(' ' || upper(lang) || ' ;;' || source, ';'), lambda x: x <> ''), lambda x: lower(trim(x))), ';') AS labels FROM d""",
    "domain_prefix": with_(D) + """SELECT id, CASE source WHEN 'src0' THEN '<GITHUB> '
  WHEN 'src1' THEN '<REDDIT> ' ELSE '' END || text AS text FROM d""",
    "weak_label": with_(D) + f"SELECT id, {WEAK} AS label FROM d",
    "label_dist": with_(D) + f"SELECT {WEAK} AS label, count(*) AS n FROM d GROUP BY 1",
    "source_dist": with_(D) + "SELECT source, count(*) AS n FROM d GROUP BY 1",
    "keyword_filter": with_(D) + f"""SELECT id FROM d
WHERE len(list_filter({KEYWORD_LIST}, lambda k: contains(lower(text), k))) > 0""",
    "keyword_title_and_body": with_(D) + """SELECT id FROM d
WHERE (contains(lower(title), 'the') OR contains(lower(title), 'de'))
  AND (contains(lower(text), 'license') OR contains(lower(text), '@') OR contains(lower(text), 'token'))""",
    "noise_filter": with_(D) + f"""SELECT id FROM d
WHERE source <> 'src2' AND NOT contains(lower(text), 'released under the mit license')
  AND len(list_filter(string_split_regex(text, '{WS}+'), lambda x: x <> '')) >= 10""",
    "drop_empty_text": "SELECT conv_id, turn, text FROM conversations WHERE turn > 1 AND " + strip("text") + " <> ''",
    "window_bounds": with_(C, LANDED, STATE) + f"""
SELECT source, 'days' AS mode, epoch_us({NOW}) AS low_us, epoch_us({NOW}) AS high_us FROM st
UNION ALL SELECT source, 'newer', epoch_us(newest_ts + INTERVAL 1 SECOND), epoch_us({NOW}) FROM st
UNION ALL SELECT source, 'older', epoch_us(oldest_ts - INTERVAL 1 SECOND - INTERVAL 30 DAY),
                 epoch_us(oldest_ts - INTERVAL 1 SECOND) FROM st
UNION ALL SELECT source, 'range', epoch_us({NOW} - INTERVAL 30 DAY), epoch_us({NOW} - INTERVAL 7 DAY) FROM st
UNION ALL SELECT source, 'window', epoch_us({NOW} - INTERVAL 1 SECOND), epoch_us({NOW}) FROM st""",
    "window_filter": with_(C, LANDED, STATE) + f"""SELECT id, repo FROM c LEFT JOIN st ON c.repo = st.source
WHERE created_at BETWEEN coalesce(newest_ts + INTERVAL 1 SECOND, {NOW} - INTERVAL 365 DAY) AND {NOW}""",
    "window_filter_days": with_(C) + f"""SELECT id, repo FROM c
WHERE created_at BETWEEN {NOW} - INTERVAL 12 DAY AND {NOW}""",
    "cutoff_filter": with_(C) + "SELECT id, repo FROM c WHERE created_at >= TIMESTAMP '2024-01-20 00:00:00'",
    "backfill_filter": with_(C) + """SELECT c.id, c.repo FROM c LEFT JOIN (
  SELECT repo, min(created_at) AS mark FROM c WHERE created_at >= TIMESTAMP '2024-01-11 00:00:00' GROUP BY repo) k
ON c.repo = k.repo
WHERE created_at >= TIMESTAMP '2024-01-05 00:00:00' AND (mark IS NULL OR created_at < mark)""",
    "freshness_prune_state": with_(C, LANDED, STATE) + f"""SELECT context_id, repo FROM (
  SELECT context_id, repo, max(created_at) AS u FROM c GROUP BY context_id, repo) x LEFT JOIN st ON x.repo = st.source
WHERE u >= coalesce(newest_ts + INTERVAL 1 SECOND, {NOW} - INTERVAL 365 DAY)""",
    "freshness_prune": """SELECT o_orderkey, o_custkey FROM orders
WHERE o_orderdate >= TIMESTAMP '1998-01-01 00:00:00'""",
    "top_level_filter": with_(C, FORUM) + "SELECT id FROM f WHERE starts_with(parent_id, 't3_')",
    "removed_filter": with_(C, FORUM) + "SELECT id FROM f WHERE " + strip("body") + " NOT IN ('[removed]', '[deleted]')",
    "body_policy": with_(C) + "SELECT id, comment_type FROM c WHERE comment_type IN ('issue_body', 'pr_body')",
    "thread_order": with_(C) + """SELECT id, repo, issue_number, row_number() OVER (
  PARTITION BY repo, issue_number
  ORDER BY CASE WHEN comment_type IN ('issue_body', 'pr_body') THEN 0 ELSE 1 END, created_at, id) AS position FROM c""",
    "topk_oldest": with_(C) + topk("created_at, id"),
    "topk_newest": with_(C) + topk("created_at DESC, id"),
    "topk_most_reacted": with_(C) + topk("reactions DESC, created_at DESC, id"),
    "topk_score": with_(C, LANDED, FORUM, f"""g AS (
  SELECT * FROM f WHERE created_at BETWEEN {NOW} - INTERVAL 20 DAY AND {NOW}
    AND NOT EXISTS (SELECT 1 FROM landed WHERE landed.id = f.id)
    AND event_type NOT IN ('click', 'error', 'signup'))""") + topk("score DESC, id", "g"),
    "source_budget": with_(C, LANDED, NEW, UPDATED) + budget("fresh", 50),
    "source_budget_large": with_(C, UPDATED) + budget("c", 1200),
    "limit_rows": with_(D) + "SELECT id, lang FROM d ORDER BY id LIMIT 100",
    "reaction_sum": with_(C) + """SELECT id, CASE event_type WHEN 'error' THEN 0 WHEN 'view' THEN reactions
  ELSE reactions + issue_number END AS reactions FROM c""",
    "source_state": with_(C) + """SELECT repo AS source, epoch_us(max(created_at)) AS newest_us,
  epoch_us(min(created_at)) AS oldest_us FROM c GROUP BY repo""",
    "global_rank": """SELECT o_custkey, row_number() OVER (ORDER BY first_ts, o_custkey) - 1 AS rank
FROM (SELECT o_custkey, min(o_orderdate) AS first_ts FROM orders GROUP BY o_custkey)""",
    "heavy_sources": """SELECT least(count(DISTINCT l_partkey), 20) AS n_listed, true AS within, true AS complete FROM lineitem""",
    "clustered_layout": with_(C) + """SELECT id, repo, epoch_us(created_at) AS created_us FROM c
WHERE repo IN ('src1', 'src4', 'src9') AND created_at >= TIMESTAMP '2024-01-08 00:00:00' AND created_at < TIMESTAMP '2024-01-22 00:00:00'""",
    "score_items": with_(D) + r"""SELECT CASE WHEN id % 3 = 0 THEN CAST(id AS VARCHAR) END AS id,
  CASE WHEN id % 3 = 0 THEN context_id END AS context_id,
  md5(CASE WHEN id % 3 = 0 THEN flat ELSE 'x ' || replace(replace(flat, '"', ''), chr(92), '') END) AS key
FROM (SELECT id, context_id, regexp_replace(text, '[ \t\n\x0B\f\r]+', ' ', 'g') AS flat FROM d)""",
    "payload_check": with_(DRIFT) + f"""SELECT id, CASE WHEN problems = '' THEN k END AS k, CASE WHEN problems = '' THEN tag END AS tag, problems
FROM (SELECT id, CAST(CASE WHEN kk = 'whole' THEN json_extract_string(good, '$.k') END AS BIGINT) AS k,
    CASE WHEN kt = 'string' THEN json_extract_string(good, '$.tag') END AS tag,
    concat_ws(',', CASE WHEN payload IS NULL THEN 'payload:absent' WHEN good IS NULL THEN 'payload:malformed' END,
      CASE WHEN kk IS NULL OR kk = 'null' THEN CASE WHEN good IS NOT NULL THEN concat_ws(':', 'k', 'missing', kk) END
           WHEN kk <> 'whole' THEN 'k:retyped:' || kk END,
      CASE WHEN kt NOT IN ('null', 'string') THEN 'tag:retyped:' || kt END) AS problems
  FROM (SELECT *, {KINDS.format("'$.k'")} AS kk, {KINDS.format("'$.tag'")} AS kt FROM j))""",
    "payload_shapes": with_(DRIFT) + f"""SELECT event_type, path, kind, count(*) AS n
FROM (SELECT event_type, path, CASE WHEN good IS NULL THEN 'malformed' ELSE {KINDS.format("path")} END AS kind
  FROM j, (VALUES ('$.k'), ('$.tag'), ('$.reactions')) AS paths(path) WHERE payload IS NOT NULL)
GROUP BY event_type, path, kind""",
    "length_sketch": with_(TOKENS.replace("tok AS", D + ", tok AS", 1)) + """SELECT lang, name, count(*) AS n_rows, round(avg(len(t)), 6) AS mean,
  CAST(min(len(t)) AS BIGINT) AS min, CAST(max(len(t)) AS BIGINT) AS max, true AS within
FROM tok, (VALUES ('p50'), ('p90'), ('p95'), ('p99')) AS n(name) GROUP BY lang, name""",
    "ml_fit": with_(L, FIT).replace("WITH", "WITH RECURSIVE", 1) + """SELECT c AS candidate, p // 3 AS feature, p % 3 AS class_id, round(b[p + 1], 6) AS value
FROM (SELECT c, b, unnest(range(12)) AS p FROM last)""",
    "ml_choose": with_(L, FIT).replace("WITH", "WITH RECURSIVE", 1) + """, hit AS (
  SELECT c, reg, y = 2 AS truly, list_position(z, list_max(z)) = 3 AS said FROM (
    SELECT c, reg, y, list_transform([0, 1, 2],
      lambda k: x[1] * b[k + 1] + x[2] * b[k + 4] + x[3] * b[k + 7] + x[4] * b[k + 10]) AS z FROM last, t WHERE dev)
), f AS (
  SELECT c, reg, coalesce(2 * count(*) FILTER (truly AND said) / CAST(nullif(count(*) FILTER (truly) + count(*) FILTER (said), 0) AS DOUBLE), 0) AS f1
  FROM hit GROUP BY c, reg
), walk AS (
  SELECT CAST(0 AS BIGINT) AS c, CAST(0 AS BIGINT) AS best, f1 AS top FROM f WHERE c = 0
  UNION ALL
  SELECT f.c, CASE WHEN f1 > top THEN f.c ELSE best END, greatest(f1, top)
  FROM walk JOIN f ON f.c = walk.c + 1 WHERE walk.c - best < 2
)
SELECT c AS candidate, reg, round(f1, 6) AS f1, c = (SELECT best FROM walk ORDER BY c DESC LIMIT 1) AS chosen FROM f""",
    "stream_ingest": with_(C) + "SELECT id, repo, epoch_us(created_at) AS created_us FROM c",
    "stream_state": with_(C) + """SELECT repo AS source, epoch_us(max(created_at)) AS newest_us,
  epoch_us(min(created_at)) AS oldest_us FROM c GROUP BY repo""",
    "stream_select": with_(C, DROPS) + f"""{topk("landing, reactions DESC, created_at DESC, id", "dropped WHERE comment_type = 'issue_comment'")}
UNION ALL SELECT id, context_id FROM c WHERE comment_type <> 'issue_comment'""",
    "stream_budget": with_(C, DROPS) + """SELECT id, repo, comment_type FROM (
  SELECT *, row_number() OVER (PARTITION BY repo ORDER BY landing, is_pr, created_at DESC, issue_number, id) AS b
  FROM (SELECT *, row_number() OVER (PARTITION BY context_id ORDER BY landing, created_at, id) AS n
        FROM dropped WHERE comment_type = 'issue_comment') WHERE n <= 2) WHERE b <= 30
UNION ALL SELECT id, repo, comment_type FROM c WHERE comment_type <> 'issue_comment'""",
    "append_indexed": with_(C, LANDED, NEW) + "SELECT id, repo, epoch_us(created_at) AS created_us FROM fresh",
    "csv_roundtrip": with_(D) + "SELECT id, text, 'o/r' AS repo FROM d WHERE length(text) > 0",
    "jsonl_roundtrip": with_(D) + "SELECT id, text, lang FROM d",
    "core_projection": with_(C) + """SELECT id, event_type AS text, '' AS context, 'other' AS label, 'github' AS source,
  epoch_us(created_at) AS created_at, repo, issue_number, CAST(is_pr AS BIGINT) AS is_pr, comment_type, context_id,
  event_type AS comment_author, 'https://h/' || id AS comment_url, 'https://h/' || repo AS container_url FROM c""",
    "split_sink": with_(SPLIT) + "SELECT o_orderkey, split FROM orders JOIN sp USING (o_custkey)",
    "window_sink": with_(D, windows()) + "SELECT lang AS split, id, count(*) AS n_windows FROM win GROUP BY lang, id",
    "score_sink": with_(S) + "SELECT score, CAST(y AS BIGINT) AS y FROM s",
    "outcome_csv": with_(S, PRED) + f"""SELECT id, split, score AS score_security, CAST(yhat AS BIGINT) AS y_pred_security,
  CAST(y AS BIGINT) AS y_true_security, {OUTCOME} AS type FROM p""",
    "thread_split": with_(SPLIT) + "SELECT o_orderkey, split FROM orders JOIN sp USING (o_custkey)",
    "split_counts": with_(SPLIT) + """SELECT split, count(*) AS n_rows
FROM orders JOIN sp USING (o_custkey) GROUP BY split""",
    "ingest_meta": with_(D, f"w AS (SELECT *, {WEAK} AS label FROM d)") + """
SELECT 'total' AS section, 'rows' AS key, count(*) AS n FROM w
UNION ALL SELECT 'total', 'columns', 6
UNION ALL SELECT 'total', 'first_us', epoch_us(min(created_at)) FROM w
UNION ALL SELECT 'total', 'last_us', epoch_us(max(created_at)) FROM w
UNION ALL SELECT 'label', label, count(*) FROM w GROUP BY label
UNION ALL SELECT 'source', source, count(*) FROM w GROUP BY source""",
    "date_range": with_(C) + """SELECT count(*) AS n_rows, epoch_us(min(created_at)) AS first_us,
  epoch_us(max(created_at)) AS last_us FROM c""",
    "top_sources": with_(C) + "SELECT repo, count(*) AS n FROM c GROUP BY repo ORDER BY n DESC, repo LIMIT 5",
    "token_counts": with_(D, TOKENS) + "SELECT id, len(t) AS n_tokens FROM tok",
    "token_len_filter": with_(D, TOKENS) + "SELECT id FROM tok WHERE len(t) + 2 <= 500",
    "token_truncate": with_(D, TOKENS) + "SELECT id, array_to_string(t[1:64], ' ') AS tokens FROM tok",
    "token_windows": with_(D, windows(8)) + "SELECT id, context_id, i AS window_no, w AS tokens, n_tokens FROM win",
    "length_profile": with_(D, TOKENS, "n AS (SELECT len(t) + 2 AS v FROM tok)") + """
SELECT count(*) AS n_rows, round(avg(v), 6) AS mean, round(stddev_samp(v), 6) AS std, min(v) AS min,
       round(quantile_cont(v, 0.5), 6) AS p50, round(quantile_cont(v, 0.9), 6) AS p90,
       round(quantile_cont(v, 0.95), 6) AS p95, round(quantile_cont(v, 0.99), 6) AS p99, max(v) AS max
FROM n""",
    "expansion_factor": with_(D, windows()) + """SELECT lang, count(*) AS n_docs, CAST(sum(nw) AS BIGINT) AS n_windows,
  round(CAST(sum(nw) AS DOUBLE) / count(*), 6) AS factor FROM cnt GROUP BY lang""",
    "class_weights": with_(D, windows(), LABELLED, WEIGHTS)
    + "SELECT label, label_id, n_rows, round(weight, 6) AS weight FROM wt",
    "label_dictionary": """SELECT doc_id AS id, lang AS label, label_id FROM documents
JOIN (SELECT lang, row_number() OVER (ORDER BY lang) - 1 AS label_id FROM (SELECT DISTINCT lang FROM documents))
USING (lang)""",
    "preprocess_meta": with_(D, windows(), LABELLED, WEIGHTS) + """
SELECT 'count' AS section, lang AS key, CAST(sum(nw) AS DOUBLE) AS v FROM lab GROUP BY lang
UNION ALL SELECT 'weight', CAST(label_id AS VARCHAR), round(weight, 6) FROM wt
UNION ALL SELECT 'label', label, CAST(label_id AS DOUBLE) FROM wt""",
    "softmax": with_(L) + "SELECT id, window_no, round(p0, 6) AS p0, round(p1, 6) AS p1, round(p2, 6) AS p2 FROM pr",
    "class_probs": with_(L) + """SELECT id, window_no, unnest(['bug', 'other', 'security']) AS label,
  unnest([round(p0, 6), round(p1, 6), round(p2, 6)]) AS p FROM pr""",
    "max_pool": with_(L) + """SELECT id, context_id, round(max(p2), 6) AS score,
  CAST(max(CASE WHEN y = 2 THEN 1 ELSE 0 END) AS BIGINT) AS y FROM pr GROUP BY id, context_id""",
    "best_window": with_(L) + """SELECT id, context_id, window_no, round(p2, 6) AS score, round(p0, 6) AS p_bug FROM (
  SELECT *, row_number() OVER (PARTITION BY id, context_id ORDER BY p2 DESC, window_no) AS n FROM pr) WHERE n = 1""",
    "macro_metrics": with_(L, """g AS (
  SELECT y, CASE WHEN l0 = top THEN 0 WHEN l1 = top THEN 1 ELSE 2 END AS yhat FROM pr),
k AS (SELECT y AS c FROM g UNION SELECT yhat FROM g),
q AS (
  SELECT c, count(*) FILTER (WHERE y = c AND yhat = c) AS tp, count(*) FILTER (WHERE y <> c AND yhat = c) AS fp,
         count(*) FILTER (WHERE y = c AND yhat <> c) AS fn
  FROM k CROSS JOIN g GROUP BY c),
v AS (
  SELECT c, CASE WHEN tp + fp = 0 THEN 0 ELSE CAST(tp AS DOUBLE) / (tp + fp) END AS p,
         CASE WHEN tp + fn = 0 THEN 0 ELSE CAST(tp AS DOUBLE) / (tp + fn) END AS r,
         CASE WHEN tp = 0 THEN 0 ELSE 2 * CAST(tp AS DOUBLE) / (2 * tp + fp + fn) END AS f
  FROM q)""") + """
SELECT round((SELECT avg(CASE WHEN y = yhat THEN CAST(1 AS DOUBLE) ELSE 0 END) FROM g), 6) AS accuracy,
       round(avg(p), 6) AS macro_precision, round(avg(r), 6) AS macro_recall, round(avg(f), 6) AS macro_f1,
       round(max(p) FILTER (WHERE c = 2), 6) AS security_precision,
       round(max(r) FILTER (WHERE c = 2), 6) AS security_recall,
       round(max(f) FILTER (WHERE c = 2), 6) AS security_f1
FROM v""",
    "pr_curve": with_(S, CURVE)
    + "SELECT score, tp, fp, round(prec, 6) AS precision, round(rec, 6) AS recall FROM curve",
    "calibrate_threshold": with_(S, CURVE) + """SELECT round(score, 6) AS threshold,
  CAST(0.95 AS DOUBLE) AS target_precision, round(prec, 6) AS precision_at_threshold,
  round(rec, 6) AS recall_at_threshold
FROM curve ORDER BY prec >= 0.95 DESC, CASE WHEN prec >= 0.95 THEN rec ELSE prec END DESC, score DESC LIMIT 1""",
    "binary_metrics": with_(S, PRED, METRICS),
    "triage_flow": with_(D, f"""clean AS (
  SELECT md5(text) AS id, {normalized("text")} AS text, title, context_id, created_at FROM (
    SELECT *, row_number() OVER (PARTITION BY md5(text) ORDER BY created_at) AS n FROM d
    WHERE len(list_filter(string_split_regex(text, '{WS}+'), lambda x: x <> '')) >= 10) WHERE n = 1),
mrg AS (SELECT * FROM clean WHERE text <> ''),
lbl AS (
  SELECT *, CASE WHEN {keywords(("title", "text"), SECURITY_KEYWORDS)} THEN 'security'
                 WHEN {keywords(("title",), BUG_TITLE_KEYWORDS)} THEN 'bug' ELSE 'other' END AS label,
         list_filter(string_split_regex(text, '[ \\t\\n\\r\\f]+'), lambda x: x <> '') AS t
  FROM mrg),
th AS (
  SELECT context_id, row_number() OVER (ORDER BY min(created_at), context_id) - 1 AS r, count(*) OVER () AS n
  FROM lbl GROUP BY context_id),
sp AS (
  SELECT context_id, CASE WHEN r < floor(n * CAST(0.7 AS DOUBLE)) THEN 'train'
         WHEN r < floor(n * CAST(0.7 AS DOUBLE)) + floor(n * CAST(0.15 AS DOUBLE)) THEN 'dev'
         ELSE 'test' END AS split
  FROM th)""") + """
SELECT split, label, count(*) AS n_docs,
  CAST(sum(greatest(CAST(ceil((len(t) - 64) / CAST(48 AS DOUBLE)) AS BIGINT), 0) + 1) AS BIGINT) AS n_windows
FROM lbl JOIN sp USING (context_id) GROUP BY split, label""",
    "evaluate_flow": with_(L, """s AS (
  SELECT CASE WHEN (id // 10) % 2 = 0 THEN 'dev' ELSE 'test' END AS split, id, context_id, max(p2) AS score,
         max(CASE WHEN y = 2 THEN 1 ELSE 0 END) AS y
  FROM pr GROUP BY ALL),
c AS (
  SELECT score, sum(y) OVER w / CAST(count(*) OVER w AS DOUBLE) AS prec,
         sum(y) OVER w / CAST(sum(y) OVER () AS DOUBLE) AS rec
  FROM s WHERE split = 'dev' WINDOW w AS (ORDER BY score DESC)),
thr AS (
  SELECT score AS threshold FROM c
  ORDER BY prec >= 0.5 DESC, CASE WHEN prec >= 0.5 THEN rec ELSE prec END DESC, score DESC LIMIT 1),
p AS (SELECT *, CASE WHEN score >= (SELECT threshold FROM thr) THEN 1 ELSE 0 END AS yhat FROM s)""", METRICS),
    "confusion_matrix": with_(S, PRED) + """SELECT split, CAST(y AS BIGINT) AS y, CAST(yhat AS BIGINT) AS yhat,
  count(*) AS n FROM p GROUP BY ALL""",
    "outcome_rows": with_(S, PRED) + f"""SELECT id, split, score AS score_security, CAST(yhat AS BIGINT) AS y_pred_security,
  CAST(y AS BIGINT) AS y_true_security, {OUTCOME} AS type FROM p""",
    "outcome_counts": with_(S, PRED) + f"SELECT {OUTCOME} AS type, count(*) AS n FROM p GROUP BY 1",
    "score_histogram": with_(S, "r AS (SELECT y, min(score) AS lo, max(score) AS hi FROM s GROUP BY y)") + """
SELECT CAST(y AS BIGINT) AS y, CAST(least(floor((score - lo) / (hi - lo) * 30), 29) AS BIGINT) AS bin, count(*) AS n
FROM s JOIN r USING (y) GROUP BY 1, 2""",
    "triage_band": with_(S) + """SELECT id, CASE WHEN score >= 0.5 THEN 'high'
  WHEN score >= CAST(0.5 AS DOUBLE) - CAST(0.05 AS DOUBLE) THEN 'mid' ELSE 'low' END AS band,
  CAST(score >= 0.5 AS BIGINT) AS is_security FROM s""",
    "composite_key": with_(C) + """SELECT key, split_part(key, '::', 1) AS id_part, split_part(key, '::', 2) AS context_part
FROM (SELECT id || '::' || context_id AS key FROM c)""",
    "score_batch": with_(D, windows(None), """lg AS (
  SELECT id, context_id, i, w, exp((length(w) % 101) / CAST(25 AS DOUBLE) - 2) AS x FROM win),
pp AS (SELECT id, context_id, i, w, x / (2 + x) AS p, 1 / (2 + x) AS pb FROM lg),
bw AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY p DESC, i) AS n FROM pp)""") + """
SELECT id, context_id, round(p, 6) AS score_security, CAST(p >= 0.5 AS BIGINT) AS is_security,
       CASE WHEN p >= 0.5 THEN 'high' WHEN p >= 0.45 THEN 'mid' ELSE 'low' END AS band,
       substring(w, 1, 1000) AS best_snippet, round(pb, 6) AS p_bug, '0.5' AS version_threshold
FROM bw WHERE n = 1""",
}


_DENSE = """s AS (
  SELECT CAST((CAST(l_orderkey * 8 + l_linenumber AS BIGINT) * 7919) % 1000003 AS DOUBLE) / CAST(1000003 AS DOUBLE) AS score,
         CASE WHEN l_returnflag = 'R' THEN 1 ELSE 0 END AS y
  FROM lineitem)"""
SQL["pr_curve_dense"] = SQL["pr_curve"].replace(S, _DENSE)
SQL["calibrate_dense"] = SQL["calibrate_threshold"].replace(S, _DENSE).replace("0.95", "0.3")
# Plugged in, the same tokens and logits give the same rows.
SQL["plugin_tokens_scores"] = SQL["score_batch"]


def oracle_sql() -> dict[str, str]:
    return dict(SQL)
