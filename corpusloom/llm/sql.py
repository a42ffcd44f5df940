"""DuckDB SQL for the queries that SQL can express, over views of the driver's tables."""

#: each document with its words in order; lines with \n
_WORDS = r"""
words AS (SELECT doc_id, unnest(ws) AS w, generate_subscripts(ws, 1) AS i
  FROM (SELECT doc_id, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS ws FROM documents WHERE text IS NOT NULL))"""

#: A sketch of up to 2,048 rows is exact, so the quartiles are quantile_disc's while no group is larger.
OP1 = (
    "WITH"
    + _WORDS
    + r""",
grams AS (SELECT doc_id, i, w || ' ' || lead(w, 1) OVER d || ' ' || lead(w, 2) OVER d AS g FROM words WINDOW d AS (PARTITION BY doc_id ORDER BY i)),
twice AS (SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, g) AS n FROM grams WHERE g IS NOT NULL) WHERE n > 1),
repeats AS (SELECT doc_id, count(DISTINCT p) AS n_repeat_words FROM (SELECT doc_id, unnest([i, i + 1, i + 2]) AS p FROM twice) GROUP BY doc_id),
lines AS (SELECT doc_id, l, count(*) AS n FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS l FROM documents) WHERE regexp_matches(l, '[^\x20\x09-\x0D]') GROUP BY doc_id, l),
dups AS (SELECT doc_id, CAST(sum(n - 1) AS BIGINT) AS n_dup_lines, CAST(sum(n) AS BIGINT) AS n_lines FROM lines GROUP BY doc_id),
base AS (SELECT d.doc_id, lang, source,
    coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS n_words,
    coalesce(length(regexp_replace(text, '[\x20\x09-\x0D]', '', 'g')), 0) AS word_chars,
    coalesce(length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')), 0) AS n_symbols,
    coalesce(n_dup_lines, 0) AS n_dup_lines, coalesce(n_lines, 0) AS n_lines, coalesce(n_repeat_words, 0) AS n_repeat_words
  FROM documents d LEFT JOIN repeats USING (doc_id) LEFT JOIN dups USING (doc_id)),
m AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed,
    n_symbols::DOUBLE / nullif(word_chars, 0) AS s, n_repeat_words::DOUBLE / nullif(n_words, 0) AS r,
    n_dup_lines::DOUBLE / nullif(n_lines, 0) AS d, word_chars::DOUBLE / nullif(n_words, 0) AS c FROM base),
q AS (SELECT lang, source, grouping(lang) AS no_lang, grouping(source) AS no_source, count(*) AS n,
    quantile_disc(s, [0.25, 0.75]) AS s, quantile_disc(r, [0.25, 0.75]) AS r, quantile_disc(d, [0.25, 0.75]) AS d, quantile_disc(c, [0.25, 0.75]) AS c
  FROM m WHERE NOT base_failed GROUP BY GROUPING SETS ((lang, source), (lang), ())),
qx AS (SELECT lang, source, no_lang, no_source, n, {'s': s, 'r': r, 'd': d, 'c': c} AS x FROM q),
g AS (SELECT a.lang, a.source, CASE WHEN a.n >= 32 THEN a.x WHEN b.n >= 32 THEN b.x ELSE z.x END AS f
  FROM qx a JOIN qx b ON a.lang IS NOT DISTINCT FROM b.lang AND b.no_lang = 0 AND b.no_source = 1 CROSS JOIN qx z
  WHERE a.no_lang = 0 AND a.no_source = 0 AND z.no_lang = 1)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  NOT base_failed AND coalesce(m.s <= f.s[2] + greatest(3.0::DOUBLE * (f.s[2] - f.s[1]), 0.25::DOUBLE), true)
    AND coalesce(m.r <= f.r[2] + greatest(3.0::DOUBLE * (f.r[2] - f.r[1]), 0.25::DOUBLE), true)
    AND coalesce(m.d <= f.d[2] + greatest(3.0::DOUBLE * (f.d[2] - f.d[1]), 0.25::DOUBLE), true)
    AND coalesce(m.c <= f.c[2] + greatest(3.0::DOUBLE * (f.c[2] - f.c[1]), 3.0::DOUBLE), true)
    AND coalesce(m.c >= f.c[1] - greatest(3.0::DOUBLE * (f.c[2] - f.c[1]), 3.0::DOUBLE), true) AS kept
FROM m LEFT JOIN g ON m.lang IS NOT DISTINCT FROM g.lang AND m.source IS NOT DISTINCT FROM g.source
"""
)

OP3 = r"""
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS e FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT q.vec_id AS query_id, c.vec_id, CAST(list_sum(list_transform(list_zip(q.e, c.e), lambda p: p[1] * p[2])) AS BIGINT) AS score
  FROM v q JOIN v c ON q.vec_id <> c.vec_id WHERE q.vec_id % 50 = 0)
SELECT query_id, CAST(row_number() OVER r AS INTEGER) AS rank, vec_id, score FROM s
WINDOW r AS (PARTITION BY query_id ORDER BY score DESC, vec_id) QUALIFY row_number() OVER r <= 5
"""

#: one text as the operator normalises it
_NORM = r"trim(regexp_replace(lower({0}), '[ \t-\r]+', ' ', 'g'))"
OP2 = rf"""
WITH RECURSIVE c AS (SELECT *, row_number() OVER () AS rid FROM conversations),
l AS (SELECT rid, conv_id, turn, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS i FROM c WHERE text IS NOT NULL),
m AS (SELECT *, length(regexp_replace(regexp_extract(line, '^((?:[ \t]*>)+)[ \t]?', 1), '[^>]', '', 'g')) AS level, regexp_replace(line, '^((?:[ \t]*>)+)[ \t]?', '') AS said FROM l),
n AS (SELECT *, lag(level) OVER (PARTITION BY rid ORDER BY i) AS before FROM m),
r AS (SELECT *, sum(CASE WHEN before IS NULL OR before <> level THEN 1 ELSE 0 END) OVER (PARTITION BY rid ORDER BY i ROWS UNBOUNDED PRECEDING) AS run FROM n),
p AS (SELECT rid, conv_id, turn, run, min(level) AS level, string_agg(said, chr(10) ORDER BY i) AS t FROM r GROUP BY rid, conv_id, turn, run),
b AS (SELECT c.rid, c.conv_id, c.turn, c.role, coalesce(trim(string_agg(t, chr(10) ORDER BY run) FILTER (level = 0), ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), '') AS body,
    CAST(count(t) FILTER (level > 0) AS INTEGER) AS n_quotes, CAST(coalesce(max(level), 0) AS INTEGER) AS quote_depth FROM c LEFT JOIN p ON p.rid = c.rid GROUP BY c.rid, c.conv_id, c.turn, c.role),
s AS (SELECT conv_id, turn, unnest(list_concat([body], list_concat(string_split_regex(body, '\n[ \t]*\n'), string_split(body, chr(10))))) AS t FROM b),
x AS (SELECT conv_id, {_NORM.format("t")} AS h, min(turn) AS origin FROM s WHERE {_NORM.format("t")} <> '' AND turn IS NOT NULL GROUP BY 1, 2),
q AS (SELECT conv_id, turn, level, 0 AS part, {_NORM.format("t")} AS h FROM p WHERE level > 0 UNION
  SELECT conv_id, turn, level, 1 AS part, {_NORM.format("t")} AS h FROM (SELECT conv_id, turn, level, unnest(string_split(t, chr(10))) AS t FROM p WHERE level > 0)),
k AS (SELECT q.conv_id, q.turn, origin, row_number() OVER (PARTITION BY q.conv_id, q.turn ORDER BY level, part, origin DESC) AS place FROM q JOIN x ON x.conv_id = q.conv_id AND x.h = q.h AND origin < q.turn WHERE q.h <> ''),
up AS (SELECT conv_id, turn, origin AS parent FROM k WHERE place = 1),
w AS (SELECT conv_id, turn, parent, parent AS thread, CAST(1 AS BIGINT) AS depth FROM up UNION ALL SELECT w.conv_id, w.turn, w.parent, up.parent, w.depth + 1 FROM w JOIN up ON up.conv_id = w.conv_id AND up.turn = w.thread),
z AS (SELECT conv_id, turn, parent, arg_max(thread, depth) AS thread, max(depth) AS depth FROM w GROUP BY conv_id, turn, parent)
SELECT b.conv_id, row_number() OVER (PARTITION BY b.conv_id ORDER BY coalesce(thread, b.turn) NULLS FIRST, b.turn NULLS FIRST, role NULLS FIRST, body) - 1 AS position,
  b.turn, role, n_quotes, quote_depth, parent AS parent_turn, coalesce(thread, b.turn) AS thread_turn, coalesce(depth, 0) AS depth, body
FROM b LEFT JOIN z ON z.conv_id = b.conv_id AND z.turn = b.turn
"""
