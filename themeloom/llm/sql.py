"""DuckDB SQL of the queries that SQL can express, written on its own from their definitions."""

from __future__ import annotations

BLANKS = r"[\x20\x09-\x0D]+"
WORDS_OF = f"list_filter(string_split_regex(t, '{BLANKS}'), lambda w: w <> '')"

NEAR_DEDUP = f"""
WITH RECURSIVE d AS (SELECT doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents),
w AS (SELECT doc_id, {WORDS_OF} AS ws FROM d),
s AS (SELECT doc_id, CASE WHEN len(ws) = 0 THEN [] WHEN len(ws) < 5 THEN [array_to_string(ws, ' ')]
  ELSE list_distinct(list_transform(range(1, len(ws) - 3), lambda i: array_to_string(ws[i:i + 4], ' '))) END AS sh FROM w),
x AS (SELECT doc_id, len(sh) AS n, unnest(sh) AS h FROM s),
c AS (SELECT a.doc_id AS a, b.doc_id AS b, a.n AS na, b.n AS nb, count(*) AS m FROM x a JOIN x b ON a.h = b.h AND a.doc_id < b.doc_id
  WHERE 100 * least(a.n, b.n) >= 75 * greatest(a.n, b.n) GROUP BY ALL),
l AS (SELECT a, b FROM c WHERE 100 * m >= 75 * (na + nb - m)),
e AS (SELECT a, b FROM l UNION ALL SELECT b, a FROM l),
r AS (SELECT doc_id AS a, doc_id AS b FROM d UNION SELECT r.a, e.b FROM r JOIN e ON r.b = e.a),
k AS (SELECT a AS doc_id, min(b) AS component_id FROM r GROUP BY a)
SELECT s.doc_id, len(sh)::BIGINT AS n_shingles, k.component_id, s.doc_id = k.component_id AS kept FROM s JOIN k USING (doc_id)
"""

QUALITY_RULES = f"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS t FROM documents),
w AS (SELECT rid, {WORDS_OF} AS ws FROM d),
u AS (SELECT rid, unnest(ws) AS w, generate_subscripts(ws, 1) AS i FROM w),
v AS (SELECT rid, i, w, lead(w, 1) OVER o AS b, lead(w, 2) OVER o AS c, lead(w, 3) OVER o AS d, lead(w, 4) OVER o AS e FROM u WINDOW o AS (PARTITION BY rid ORDER BY i)),
f AS (SELECT rid, i, e IS NOT NULL AND count(*) OVER (PARTITION BY rid, w, b, c, d, e) > 1 AS twice FROM v),
g AS (SELECT rid, i, max(twice::INT) OVER (PARTITION BY rid ORDER BY i ROWS BETWEEN 4 PRECEDING AND CURRENT ROW) AS hit FROM f),
h AS (SELECT rid, sum(hit) AS n_repeat_words FROM g GROUP BY rid),
m AS (SELECT rid, doc_id, len(ws) AS n_words, length(regexp_replace(t, '{BLANKS}', '', 'g')) AS word_chars,
  length(regexp_replace(t, '[^#*$%&|<>]', '', 'g')) AS n_symbols,
  list_filter(string_split(t, chr(10)), lambda l: regexp_matches(l, '[^\\x20\\x09-\\x0D]')) AS lines,
  length(regexp_replace(t, '[^A-Z]', '', 'g')) AS n_upper, length(regexp_replace(t, '[^a-z]', '', 'g')) AS n_lower,
  (length(t) - length(replace(t, '!!', ''))) // 2 AS n_bangs FROM d JOIN w USING (rid)),
a AS (SELECT doc_id, n_words, word_chars, n_symbols, len(lines) - len(list_distinct(lines)) AS n_dup_lines, coalesce(n_repeat_words, 0) AS n_repeat_words,
  len(lines) AS n_lines, n_upper, n_lower, n_bangs FROM m LEFT JOIN h USING (rid)),
b AS (SELECT *, (n_words < 10)::BIGINT + 2 * (100 * n_repeat_words > 20 * n_words)::BIGINT + 4 * (10 * n_symbols > 3 * n_words)::BIGINT
  + 8 * (2 * n_dup_lines > n_lines)::BIGINT + 16 * (word_chars > 15 * n_words)::BIGINT + 32 * (word_chars < 2 * n_words)::BIGINT
  + 64 * (n_upper + n_lower >= 40 AND n_upper > n_lower)::BIGINT + 128 * (5 * n_bangs > n_words)::BIGINT + 256 * (n_words > 100000)::BIGINT AS failed_bits FROM a)
SELECT doc_id, n_words::BIGINT AS n_words, word_chars::BIGINT AS word_chars, n_symbols::BIGINT AS n_symbols, n_dup_lines::BIGINT AS n_dup_lines,
  n_repeat_words::BIGINT AS n_repeat_words, (failed_bits & 3) <> 0 AS base_failed, (failed_bits & 255) = 0 AS kept, failed_bits FROM b
"""

HASH32 = "('0x' || substr(md5({}), 1, 8))::BIGINT"

MIXING = f"""
WITH d AS (SELECT doc_id, source, len({WORDS_OF})::BIGINT AS size FROM (SELECT doc_id, source, coalesce(text, '') AS t FROM documents)),
s AS (SELECT source, sum(size)::BIGINT AS source_size FROM d GROUP BY source),
w AS (SELECT *, [1.0, 2.0, 3.0][1 + (row_number() OVER (ORDER BY source IS NULL, source) - 1) % 3]::DOUBLE AS weight, 3.0::DOUBLE * source_size AS most FROM s),
a AS (SELECT *, most / weight AS filled FROM w),
b AS (SELECT *, (sum(source_size) OVER ()::DOUBLE - coalesce(sum(most) OVER o, 0)) / (sum(weight) OVER () - coalesce(sum(weight) OVER o, 0)) AS level
  FROM a WINDOW o AS (ORDER BY filled, source IS NULL, source ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
t AS (SELECT source, source_size, least(most, weight * coalesce((SELECT arg_min(level, filled) FROM b WHERE filled >= level), 0)) AS target,
  {HASH32.format("concat_ws('|', 'mix', 'offset', coalesce(source, ''))")} AS off FROM b),
r AS (SELECT d.doc_id, d.size, t.source, t.source_size, t.target, t.off, CASE WHEN t.source_size > 0 THEN t.target / t.source_size ELSE 0 END AS rate,
  row_number() OVER (PARTITION BY d.source ORDER BY length(bin(size)) * 8 + (((size << 3) >> (length(bin(size)) - 1)) & 7),
    {HASH32.format("concat_ws('|', 'mix', coalesce(d.doc_id::VARCHAR, ''))")}, d.doc_id, d.size) AS k
  FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source),
c AS (SELECT r.*, floor(rate * k + off / 4294967296.0::DOUBLE)::BIGINT - floor(rate * (k - 1) + off / 4294967296.0::DOUBLE)::BIGINT AS copies FROM r)
SELECT doc_id, size, source_size, target, (copies * size)::BIGINT AS taken FROM c
"""

SQL: dict[str, str] = {"op2_near_dedup": NEAR_DEDUP, "op3_quality_rules": QUALITY_RULES, "op5_mixing": MIXING}
