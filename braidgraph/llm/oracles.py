"""DuckDB SQL of the corpus queries that SQL can express."""

WORD = r"'[^\x20\x09-\x0D]+'"
FOLDED = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

OP3 = rf"""
WITH base AS (
  SELECT doc_id, row_number() OVER () AS r, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), {WORD}) AS ws,
         regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g') AS bare
  FROM documents),
lines AS (
  SELECT r, count(*) AS n_lines, count(*) - count(DISTINCT line) AS n_dup_lines
  FROM (SELECT r, unnest(string_split(t, chr(10))) AS line FROM base)
  WHERE regexp_matches(line, '[^\x20\x09-\x0D]') GROUP BY r),
starts AS (SELECT r, ws, unnest(range(1, len(ws) - 6)) AS i FROM base WHERE len(ws) > 8),
grams AS (SELECT r, i, list_slice(ws, i, i + 7) AS g FROM starts),
twice AS (SELECT r, unnest(list(i)) AS i FROM grams GROUP BY r, g HAVING count(*) > 1),
covered AS (SELECT r, count(DISTINCT i + k) AS n_repeat_words FROM twice, range(8) AS x(k) GROUP BY r),
measured AS (
  SELECT doc_id, ws, len(ws) AS n_words, length(bare) AS word_chars,
         length(bare) - length(regexp_replace(bare, '[#*$%&|<>]', '', 'g')) AS n_symbols,
         coalesce(n_dup_lines, 0) AS n_dup_lines, coalesce(n_repeat_words, 0) AS n_repeat_words, coalesce(n_lines, 0) AS n_lines,
         length(bare) - length(regexp_replace(bare, '[A-Z]', '', 'g')) AS n_upper,
         length(bare) - length(regexp_replace(bare, '[a-z]', '', 'g')) AS n_lower,
         length(bare) - length(regexp_replace(bare, '[!?]', '', 'g')) AS n_marks,
         (SELECT count(*) FROM range(2, len(ws) + 1) AS x(i) WHERE ws[i] = ws[i - 1]) AS n_adjacent
  FROM base LEFT JOIN lines USING (r) LEFT JOIN covered USING (r)),
bits AS (
  SELECT *, (n_words < 20)::INT * 1 + (100 * n_repeat_words > 30 * n_words)::INT * 2 + (100 * n_symbols > 3 * word_chars)::INT * 4
         + (100 * n_dup_lines > 50 * n_lines AND n_lines >= 4)::INT * 8 + (word_chars > 14 * n_words)::INT * 16
         + (word_chars < 2 * n_words)::INT * 32 + (n_upper > n_lower)::INT * 64 + (100 * n_marks > 10 * word_chars)::INT * 128
         + (100 * n_adjacent > 30 * n_words)::INT * 256 AS b
  FROM measured)
SELECT doc_id, n_words::BIGINT AS n_words, word_chars::BIGINT AS word_chars, n_symbols::BIGINT AS n_symbols,
       n_dup_lines::BIGINT AS n_dup_lines, n_repeat_words::BIGINT AS n_repeat_words, (b & 3) <> 0 AS base_failed, b = 0 AS kept,
       b::BIGINT AS failed_bits
FROM bits
"""

OP7 = rf"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all({FOLDED}, {WORD}) AS ws FROM documents),
sets AS (
  SELECT doc_id, CASE WHEN len(ws) >= 3 THEN list_distinct(list_transform(range(1, len(ws) - 1), lambda i: ws[i] || ' ' || ws[i + 1] || ' ' || ws[i + 2]))
                      WHEN len(ws) > 0 THEN [array_to_string(ws, ' ')] ELSE [] END AS s
  FROM w),
elements AS (SELECT doc_id, len(s) AS n, unnest(s) AS e FROM sets),
links AS (
  SELECT a.doc_id AS a, b.doc_id AS b
  FROM elements a JOIN elements b ON a.e = b.e AND a.doc_id <> b.doc_id
  GROUP BY a.doc_id, b.doc_id, a.n, b.n HAVING 100 * count(*) >= 90 * (a.n + b.n - count(*))),
reach AS (
  SELECT doc_id, doc_id AS component_id FROM documents
  UNION SELECT links.b, reach.component_id FROM reach JOIN links ON reach.doc_id = links.a)
SELECT doc_id, len(s)::BIGINT AS n_shingles, (SELECT min(component_id) FROM reach WHERE reach.doc_id = sets.doc_id) AS component_id,
       (SELECT count(*) FROM links WHERE links.a = sets.doc_id) AS n_links
FROM sets
"""

OP8 = rf"""
WITH w AS (SELECT doc_id, row_number() OVER () AS r, regexp_extract_all(coalesce(text, ''), {WORD}) AS ws FROM documents),
starts AS (SELECT doc_id, r, ws, unnest(range(1, len(ws) - 48)) AS i FROM w WHERE len(ws) >= 50),
grams AS (SELECT doc_id, r, i, md5(array_to_string(list_slice(ws, i, i + 49), ' ')) AS g FROM starts),
firsts AS (SELECT doc_id, r, i, min(doc_id) OVER (PARTITION BY g) AS first FROM grams),
gone AS (SELECT DISTINCT r, i + k AS p, true AS lost FROM firsts, range(50) AS x(k) WHERE doc_id > first),
places AS (SELECT doc_id, r, ws, unnest(range(1, len(ws) + 1)) AS p FROM w),
kept AS (
  SELECT r, coalesce(string_agg(ws[p], ' ' ORDER BY p) FILTER (WHERE lost IS NULL), '') AS t, count(*) FILTER (WHERE lost) AS n_removed
  FROM places LEFT JOIN gone USING (r, p) GROUP BY r)
SELECT doc_id, len(ws)::BIGINT AS n_words, coalesce(n_removed, 0)::BIGINT AS n_removed, sha256(coalesce(t, '')) AS kept_sha256
FROM w LEFT JOIN kept USING (r)
"""

OP1 = r"""
WITH docs AS (SELECT doc_id, row_number() OVER () AS r, string_split(text, chr(10)) AS ls FROM documents),
each AS (SELECT doc_id, r, p, ls[p] AS line, list_transform(regexp_extract_all(ls[p], '[^\x20\x09-\x0D]+'),
                lambda w: CASE WHEN regexp_matches(w, '[0-9]') THEN '<*>' ELSE w END) AS ws
         FROM (SELECT *, unnest(range(1, len(ls) + 1)) AS p FROM docs)),
lines AS (SELECT *, array_to_string(ws, ' ') AS k, len(ws) || ' ' || array_to_string(ws[1:3], ' ') AS leaf FROM each WHERE len(ws) > 0),
kinds AS (SELECT k, any_value(leaf) AS leaf, any_value(ws) AS ws, count(DISTINCT doc_id) AS docs FROM lines GROUP BY k),
leaves AS (SELECT leaf FROM kinds WHERE len(ws) >= 8 GROUP BY leaf HAVING sum(docs) >= 10 AND count(*) > 1),
places AS (SELECT k, leaf, len(ws) AS n, docs, ws[p] AS w, p FROM (SELECT *, unnest(range(1, len(ws) + 1)) AS p FROM kinds SEMI JOIN leaves USING (leaf))),
common AS (SELECT leaf, p, w FROM places GROUP BY ALL HAVING sum(docs) >= 10),
shapes AS (SELECT k, leaf || '|' || string_agg(p || ':' || w, ' ' ORDER BY p) AS template FROM places SEMI JOIN common USING (leaf, p, w)
           GROUP BY k, leaf, n HAVING 100 * count(*) >= 75 * n),
named AS (SELECT lines.*, coalesce(template, k) AS template FROM lines LEFT JOIN shapes USING (k)),
recur AS (SELECT template, min(doc_id) AS first FROM named GROUP BY template HAVING count(DISTINCT doc_id) >= 10),
gone AS (SELECT r, p FROM named JOIN recur USING (template) WHERE doc_id > first),
kept AS (SELECT r, string_agg(line, chr(10) ORDER BY p) AS t, count(*) AS n FROM each ANTI JOIN gone USING (r, p) GROUP BY r)
SELECT doc_id, coalesce(t, '') AS text, coalesce(CASE WHEN ls = [''] THEN 0 ELSE len(ls) END, 0)::BIGINT AS n_lines,
       coalesce(len(ls) - coalesce(n, 0), 0)::BIGINT AS n_dropped
FROM docs LEFT JOIN kept USING (r)
"""


def ablations_sql(rules: tuple[tuple[str, int], ...]) -> str:
    """Of the rules (name, bit) of a policy: documents that fail each, that fail it alone, and that pass all."""
    mask = sum(1 << b for _, b in rules)
    names = ", ".join(f"('{name}', {1 << b})" for name, b in rules)
    return f"""
WITH judged AS ({OP3}), bits AS (SELECT failed_bits & {mask} AS b, count(*) AS n FROM judged GROUP BY 1)
SELECT rule, bit::BIGINT AS bit, coalesce(sum(n) FILTER (WHERE b & bit <> 0), 0)::BIGINT AS fail, coalesce(sum(n) FILTER (WHERE b = bit), 0)::BIGINT AS fail_only_this,
       coalesce(sum(n) FILTER (WHERE b = 0), 0)::BIGINT AS pass_all
FROM bits, (VALUES {names}) AS t(rule, bit) GROUP BY rule, bit
"""
