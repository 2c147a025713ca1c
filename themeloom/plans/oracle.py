"""What DuckDB runs for the catalogue's queries, written on its own from the same definitions."""

from __future__ import annotations

from ..functions import text as T


def q(s: str) -> str:
    """A SQL string."""
    return "'" + s.replace("'", "''") + "'"


WS = r"[ \t\r\n]+"
EDGES = r"^[ \t\r\n]+|[ \t\r\n]+$"


def held(col: str) -> str:
    for a in T.ABBREVIATIONS_MANY_DOTS:
        col = f"replace({col}, {q(a)}, replace({q(a)}, '.', chr(1)))"
    return f"regexp_replace({col}, {q('(' + '|'.join(sorted(T.ABBREVIATIONS, key=lambda a: (-len(a), a))) + r')\.')}, '\\1' || chr(1), 'g')"


def parts(col: str) -> str:
    marked = f"regexp_replace(regexp_replace({held(col)}, '\\n+', chr(2), 'g'), '([.!?;])[ \\t\\r]+', '\\1' || chr(2), 'g')"
    plain = f"list_transform(string_split({marked}, chr(2)), lambda p: replace(regexp_replace(p, '{EDGES}', '', 'g'), chr(1), '.'))"
    # An over-long part without commas loses its head step by step; two steps pass 1,600 characters at least.
    last = "1601 - strpos(reverse(left(a.r, 1600)), ' ')"
    size = f"CASE WHEN length(a.r) <= 1600 OR {last} IN (1, 1601) THEN 1600 ELSE {last} - 1 END"
    hard = f"list_reduce(list_prepend({{'o': []::VARCHAR[], 'r': p}}, list_transform(range(2 * (length(p) // 1600) + 4), lambda i: {{'o': []::VARCHAR[], 'r': ''}})), lambda a, x: {{'o': a.o || [left(a.r, {size})], 'r': substr(a.r, {size} + 1)}}).o"
    cut = f"CASE WHEN length(p) < 1604 THEN [p] WHEN contains(p, ',') THEN string_split(p, ',') ELSE {hard} END"
    return f"list_filter(list_transform(flatten(list_transform({plain}, lambda p: {cut})), lambda p: regexp_replace(p, '{EDGES}', '', 'g')), lambda p: p <> '')"


def n_words(col: str) -> str:
    return f"len(list_filter(string_split_regex({col}, '{WS}'), lambda w: w <> ''))"


ENDS = r"[.,;:!?()\[\]\"'“”‘’]+"
STRIP = f"regexp_replace(regexp_replace(w, {q('^' + ENDS + '|' + ENDS + '$')}, '', 'g'), {q('[' + chr(39) + '’‘]s$')}, '')"


def content(col: str) -> str:
    return f"list_distinct(list_filter(list_transform(string_split_regex(lower({col}), '{WS}'), lambda w: {STRIP}), lambda w: length(w) > 2 AND regexp_matches(w, '^\\p{{L}}+$') AND w <> 'the'))"


def squeeze(col: str) -> str:
    return f"trim(regexp_replace({col}, '{WS}', ' ', 'g'))"


def junk(col: str) -> str:
    starts = "^(?:" + "|".join(T.JUNK_STARTS) + ")"
    return f"(length(trim({col})) < 30 OR {n_words(col)} < 5 OR regexp_matches(lower(trim({col})), {q(starts)}))"


def dedup_key(col: str) -> str:
    return f"trim(regexp_replace(regexp_replace(lower({col}), '[^a-z0-9 \\t\\r\\n]', ' ', 'g'), '{WS}', ' ', 'g'))"


def answer_words(col: str) -> str:
    return f"list_filter(string_split_regex(regexp_replace(lower({col}), {q(T.PUNCTUATION)}, '', 'g'), '{WS}'), lambda w: w NOT IN ('', 'a', 'an', 'the'))"


def stem(w: str) -> str:
    cases = "".join(f" WHEN ends_with(lower({w}), '{s}') AND length({w}) > {len(s) + 2} THEN left(lower({w}), length({w}) - {len(s)})" for s in T.STEM_SUFFIXES)
    return f"CASE WHEN length({w}) < 4 THEN lower({w}){cases} WHEN ends_with(lower({w}), 's') AND NOT ends_with(lower({w}), 'ss') THEN left(lower({w}), length({w}) - 1) WHEN ends_with(lower({w}), 'e') THEN left(lower({w}), length({w}) - 1) ELSE lower({w}) END"


def markup(col: str) -> str:
    for pattern, by in T.MARKUP:
        col = f"regexp_replace({col}, {q(pattern)}, {q(by.replace('$1', chr(92) + '1'))}, 'g')"
    return f"regexp_replace({col}, '^\\s+|\\s+$', '', 'g')"


UNITS = f"""units AS (SELECT doc_id, pos, unit FROM (SELECT *, row_number() OVER (PARTITION BY doc_id, lower(unit) ORDER BY pos) AS n
 FROM (SELECT doc_id, unnest(range(len(p))) AS pos, unnest(p) AS unit FROM (SELECT doc_id, {parts("coalesce(text, '')")} AS p FROM documents))) WHERE n = 1)"""
KEPT = UNITS + f""", kept AS (SELECT doc_id, pos, unit, {n_words("unit")} AS n_words FROM (SELECT *, row_number() OVER (PARTITION BY doc_id, {dedup_key("unit")} ORDER BY pos) AS n FROM units WHERE NOT {junk("unit")}) WHERE n = 1)"""
KWS = KEPT + f""", kws AS (SELECT doc_id, pos, unnest({content("unit")}) AS kw FROM kept), df AS (SELECT doc_id, kw, count(*) AS df FROM kws GROUP BY ALL)"""
THEMES = KWS + """, cut AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY df, kw) AS i, least(CAST(floor(count(*) OVER (PARTITION BY doc_id) * 0.9::DOUBLE) AS INT), count(*) OVER (PARTITION BY doc_id) - 1) + 1 AS a FROM df),
 thr AS (SELECT doc_id, df AS threshold FROM cut WHERE i = a),
 themes AS (SELECT doc_id, kw, df, threshold, row_number() OVER (PARTITION BY doc_id ORDER BY df DESC, kw) AS rk FROM df JOIN thr USING (doc_id) WHERE df >= threshold)"""
PATHS = THEMES + """, paths AS (SELECT doc_id, pos, list(kw ORDER BY rk) AS path FROM kws JOIN themes USING (doc_id, kw) GROUP BY ALL)"""
NODES = PATHS + """, pre AS (SELECT doc_id, pos, path, unnest(range(1, len(path) + 1)) AS i FROM paths),
 sup AS (SELECT doc_id, path[1:i] AS node, path[i] AS kw, count(*) AS support FROM pre GROUP BY ALL),
 shares AS (SELECT doc_id, kw, df / max(df) OVER (PARTITION BY doc_id) AS share FROM themes),
 nodes AS (SELECT doc_id, node, kw, len(node) AS depth, support, share * support / sum(support) OVER (PARTITION BY doc_id, kw) AS weight FROM sup JOIN shares USING (doc_id, kw))"""
ROWS = f"""rows_ AS (SELECT conv_id, turn, role, CAST(row_number() OVER (PARTITION BY conv_id ORDER BY turn, role, i) - 1 AS INT) AS row_idx, txt AS text, {n_words("txt")} AS n_words
 FROM (SELECT conv_id, turn, role, unnest(range(len(p))) AS i, unnest(p) AS txt FROM (SELECT *, {parts("coalesce(text, '')")} AS p FROM conversations WHERE role IN ('user', 'assistant'))))"""
QUERY = "qv AS (SELECT embedding AS q FROM embeddings ORDER BY vec_id LIMIT 1), sc AS (SELECT vec_id, label, embedding, list_dot_product(embedding::DOUBLE[], q::DOUBLE[]) AS cos, q FROM embeddings, qv)"
PAIRS = "pairs AS (SELECT a.conv_id * 100000 + a.turn AS id, a.text AS prediction, u.text AS answer FROM conversations a JOIN conversations u ON a.conv_id = u.conv_id AND a.turn = u.turn + 1)"
BRANCHES = QUERY + """, m AS (SELECT label, i, avg(x) AS m, first(qq) AS q FROM (SELECT label, unnest(range(len(embedding))) AS i, unnest(embedding::DOUBLE[]) AS x, unnest(q::DOUBLE[]) AS qq FROM sc) GROUP BY ALL),
 br AS (SELECT label, n_rows, round(greatest(centroid, 0.0), 6) AS centroid, round(peak, 6) AS peak FROM (SELECT label, count(*) AS n_rows, max(cos) AS peak FROM sc GROUP BY label) JOIN (SELECT label, sum(m * q) / sqrt(sum(m * m)) AS centroid FROM m GROUP BY label) USING (label))"""

SQL = {
    "sentence_split": f"WITH {UNITS} SELECT doc_id, CAST(pos AS INT) AS pos, unit FROM units",
    "dedup_keep_first": f"WITH {KEPT} SELECT doc_id, CAST(pos AS INT) AS pos, unit, CAST(n_words AS INT) AS n_words FROM kept",
    "junk_flags": f"WITH {UNITS} SELECT doc_id, CAST(pos AS INT) AS pos, {junk('unit')} AS junk FROM units",
    "filter_counts": f"WITH {UNITS}, m AS (SELECT *, {junk('unit')} AS junk, {dedup_key('unit')} AS key FROM units), r AS (SELECT *, NOT junk AND row_number() OVER (PARTITION BY doc_id, junk, key ORDER BY pos) > 1 AS again FROM m) SELECT doc_id, count(*) AS n_units, count(*) FILTER (junk) AS n_junk, count(*) FILTER (again) AS n_repeats, count(*) FILTER (NOT junk AND NOT again) AS n_kept FROM r GROUP BY doc_id",
    "content_words": f"WITH {KWS} SELECT doc_id, count(*) AS n, count(DISTINCT kw) AS n_distinct FROM kws GROUP BY doc_id",
    "soft_stem": f"WITH {KWS} SELECT DISTINCT kw, {stem('kw')} AS stem FROM kws",
    "norm_hash": f"SELECT doc_id, sha1(lower({squeeze('text')})) AS hash FROM documents",
    "chat_clean": "SELECT conv_id, turn, role, regexp_replace(regexp_replace(regexp_replace(text, '[ \\t]{2,}', ' ', 'g'), '\\n{3,}', chr(10) || chr(10), 'g'), '^[ \\t\\r\\n]+|[ \\t\\r\\n]+$', '', 'g') AS text FROM conversations",
    "clean_markup": f"SELECT page_id, {markup('html')} AS text FROM pages",
    "dedup_key": f"SELECT doc_id, {dedup_key('text')} AS key FROM documents",
    "normalize_answer": f"SELECT item_id, array_to_string({answer_words('text')}, ' ') AS answer FROM benchmark",
    "length_reward": f"SELECT doc_id, CASE WHEN n < 15 THEN 0.30 WHEN n < 20 THEN 0.65 WHEN n < 28 THEN 0.85 WHEN n <= 45 THEN 1.0 ELSE round(0.95 / (1.0 + 0.01 * (n - 45)), 9) END::DOUBLE AS reward FROM (SELECT doc_id, {n_words('text')} AS n FROM documents)",
    "kw_df": f"WITH {KWS} SELECT doc_id, kw, df FROM df",
    "theme_keywords": f"WITH {THEMES} SELECT doc_id, kw, df, threshold, rk FROM themes",
    "trie_paths": f"WITH {PATHS} SELECT doc_id, CAST(pos AS INT) AS pos, array_to_string(path, '>') AS path FROM paths",
    "trie_nodes": f"WITH {NODES} SELECT doc_id, array_to_string(node, '>') AS node, kw, CAST(depth AS INT) AS depth, support, round(weight, 9) AS weight FROM nodes",
    "depth1_branches": f"WITH {NODES} SELECT doc_id, count(*) AS branches FROM nodes WHERE depth = 1 GROUP BY doc_id",
    "doc_mass": f"WITH {NODES} SELECT doc_id, round(sum(weight), 6) AS mass FROM nodes GROUP BY doc_id",
    "fits_whole": f"WITH {KEPT} SELECT doc_id, CAST(sum(n_words) AS BIGINT) AS n_words, sum(n_words) <= 100 AS fits FROM kept GROUP BY doc_id",
    "memory_rows": f"WITH {ROWS} SELECT conv_id, turn, role, row_idx, text, CAST(n_words AS INT) AS n_words FROM rows_",
    "exact_dedupe": f"WITH {ROWS} SELECT conv_id, row_idx, hash FROM (SELECT *, row_number() OVER (PARTITION BY conv_id, hash ORDER BY row_idx) AS n FROM (SELECT *, sha1(lower({squeeze('text')})) AS hash FROM rows_)) WHERE n = 1",
    "eviction_mask": f"WITH {ROWS} SELECT conv_id, row_idx, row_number() OVER (PARTITION BY conv_id ORDER BY row_idx DESC) <= 20 AS alive FROM rows_",
    "episodes": "SELECT event_id, CAST(sum(CASE WHEN gap > 6 * 3600 THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY event_id ROWS UNBOUNDED PRECEDING) AS BIGINT) AS episode FROM (SELECT *, epoch_us(ts) / 1e6 - last_value(epoch_us(ts) / 1e6 IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS gap FROM events)",
    "conversation_sections": f"WITH {ROWS}, l AS (SELECT *, CASE WHEN lag(turn) OVER w IS NOT DISTINCT FROM turn AND lag(role) OVER w IS NOT DISTINCT FROM role THEN 0 ELSE 1 END AS new FROM rows_ WINDOW w AS (PARTITION BY conv_id ORDER BY row_idx)), s AS (SELECT *, CAST(sum(new) OVER (PARTITION BY conv_id ORDER BY row_idx ROWS UNBOUNDED PRECEDING) AS BIGINT) AS section FROM l) SELECT conv_id, section, first(turn) AS turn, first(role) AS role, string_agg(text, ' ' ORDER BY row_idx) AS text FROM s GROUP BY conv_id, section",
    "tail_anchor": f"WITH {ROWS} SELECT conv_id, row_idx, CAST(t AS BIGINT) AS tail_words FROM (SELECT *, sum(n_words) OVER (PARTITION BY conv_id ORDER BY row_idx DESC ROWS UNBOUNDED PRECEDING) AS t FROM rows_) WHERE t <= 120",
    "struct_anchors": f"WITH {ROWS} SELECT conv_id, a.u AS words_used, a.n AS n_taken FROM (SELECT conv_id, list_reduce(list_prepend({{'u': 0::BIGINT, 'n': 0::BIGINT}}, list({{'u': n_words::BIGINT, 'n': 1::BIGINT}} ORDER BY row_idx)), lambda a, x: CASE WHEN a.u + x.u <= 150 THEN {{'u': a.u + x.u, 'n': a.n + 1}} ELSE a END) AS a FROM rows_ GROUP BY conv_id)",
    "fused_short_turns": f"SELECT conv_id, turn, CASE WHEN role = 'user' AND {n_words('text')} <= 8 AND b IS NOT NULL THEN trim(text) || '  [in reply to: \"…' || right(trim(b), 120) || '\"]' ELSE text END AS fused FROM (SELECT *, lag(text) OVER (PARTITION BY conv_id ORDER BY turn) AS b FROM conversations)",
    "conversation_map": f"WITH {ROWS}, w AS (SELECT conv_id, turn, kw, max(s) AS score FROM (SELECT conv_id, turn, sqrt(n_words::DOUBLE) AS s, unnest({content('text')}) AS kw FROM rows_) GROUP BY ALL), t AS (SELECT *, row_number() OVER (PARTITION BY conv_id, turn ORDER BY score DESC, kw) AS n FROM w), l AS (SELECT conv_id, turn, string_agg(kw, ', ' ORDER BY n) AS words FROM t WHERE n <= 3 GROUP BY ALL) SELECT conv_id, turn, words FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS r FROM l) WHERE r <= 20",
    "kv_read_write": f"WITH {ROWS}, w AS (SELECT conv_id, turn, list_distinct(list(kw)) AS own FROM (SELECT conv_id, turn, unnest({content('text')}) AS kw FROM rows_) GROUP BY ALL), b AS (SELECT *, coalesce(lag(own) OVER (PARTITION BY conv_id ORDER BY turn), []) AS before FROM w) SELECT conv_id, turn, CAST(len(list_intersect(own, before)) AS INT) AS n_read, CAST(len(own) - len(list_intersect(own, before)) AS INT) AS n_write FROM b",
    "snapshot_signals": f"WITH {ROWS} SELECT conv_id, count(*) AS n_rows, count(DISTINCT turn) AS n_turns, CAST(sum(n_words) AS BIGINT) AS n_words, round(CASE WHEN sum(n_words) > 0 THEN sum(CASE WHEN role = 'user' THEN n_words ELSE 0 END)::DOUBLE / sum(n_words) END, 6) AS user_share, max(turn) AS last_turn FROM rows_ GROUP BY conv_id",
    "coverage_decay": f"WITH {ROWS}, w AS (SELECT DISTINCT conv_id, turn, last, kw FROM (SELECT conv_id, turn, max(turn) OVER (PARTITION BY conv_id) AS last, unnest({content('text')}) AS kw FROM rows_)), c AS (SELECT conv_id, kw, sum(pow(0.5, (last - turn) / 4.0)) AS c FROM w GROUP BY ALL) SELECT conv_id, kw, round(c, 6) AS coverage FROM c WHERE c >= 0.05",
    "cosine_topk": f"WITH {QUERY} SELECT vec_id, round(cos, 6) AS cos FROM sc ORDER BY sc.cos DESC, vec_id LIMIT 10",
    "branch_scores": f"WITH {BRANCHES} SELECT * FROM br",
    "scope_rule": f"WITH {BRANCHES} SELECT label, centroid >= max(centroid) OVER () - 0.02 OR peak >= max(peak) OVER () - 0.10 AS kept FROM br",
    "relevance_rescale": f"WITH {QUERY}, s AS (SELECT quantile_cont(cos, 0.5) AS mid, max(cos) AS top FROM sc) SELECT vec_id, round(greatest(cos - mid, 0.0) / (top - mid), 6) AS rel FROM sc, s",
    "token_f1": f"WITH {PAIRS}, p AS (SELECT id, w, count(*) AS n FROM (SELECT id, unnest({answer_words('prediction')}) AS w FROM pairs) GROUP BY ALL), a AS (SELECT id, w, count(*) AS n FROM (SELECT id, unnest({answer_words('answer')}) AS w FROM pairs) GROUP BY ALL), s AS (SELECT id, sum(least(p.n, a.n)) AS same FROM p JOIN a USING (id, w) GROUP BY id) SELECT id, round(coalesce(CASE WHEN same > 0 THEN 2.0::DOUBLE * same / (len({answer_words('prediction')}) + len({answer_words('answer')})) END, 0.0), 6) AS f1 FROM pairs LEFT JOIN s USING (id)",
    "verdict": f"WITH {PAIRS}, n AS (SELECT id, array_to_string({answer_words('prediction')}, ' ') AS p, array_to_string({answer_words('answer')}, ' ') AS a FROM pairs) SELECT id, CASE WHEN p = a THEN 'exact' WHEN a <> '' AND contains(' ' || p || ' ', ' ' || a || ' ') THEN 'contains' ELSE 'none' END AS verdict FROM n",
    "score_summary": "SELECT lang AS category, CAST(grouping(lang) AS INT) AS is_total, count(*) AS n, CAST(sum(quality) AS BIGINT) AS n_correct FROM documents JOIN labels USING (doc_id) GROUP BY ROLLUP (lang)",
    "category_fold": "WITH t AS (SELECT source, lang AS category, avg(n_chars) AS score FROM documents GROUP BY ALL) SELECT category, round(avg(score), 6) AS score FROM t GROUP BY category UNION ALL SELECT 'all', round(avg(score), 6) FROM t",
    "comparison_pivot": "WITH w AS (SELECT source AS dataset, max(n_chars) FILTER (lang = 'de') AS de, max(n_chars) FILTER (lang = 'en') AS en, max(n_chars) FILTER (lang = 'es') AS es, max(n_chars) FILTER (lang = 'fr') AS fr FROM documents GROUP BY source) SELECT *, CASE greatest(de, en, es, fr) WHEN de THEN 'de' WHEN en THEN 'en' WHEN es THEN 'es' WHEN fr THEN 'fr' END AS best FROM w",
    "nearest_rank_p95": "SELECT event_type, max(n) AS n, round(avg(value), 6) AS mean, round(max(CASE WHEN i = CAST(round_even(0.95::DOUBLE * (n - 1), 0) AS INT) THEN value END), 6) AS p95 FROM (SELECT *, row_number() OVER (PARTITION BY event_type ORDER BY value) - 1 AS i, count(*) OVER (PARTITION BY event_type) AS n FROM events WHERE value IS NOT NULL) GROUP BY event_type",
    "worker_rollup": "SELECT event_type AS target, count(*) AS calls, count(*) FILTER (value > 50) AS ok, CAST(sum(CAST(floor(value) AS BIGINT)) AS BIGINT) AS tokens, max_by(CASE WHEN value > 50 THEN 'ok' ELSE 'failed' END, event_id) AS last_status FROM events GROUP BY event_type",
    "ask_signals": f"SELECT conv_id, turn, CAST({n_words('text')} AS INT) AS words, CAST(length(text) - length(replace(text, '?', '')) AS INT) AS questions, CAST(len(string_split(text, chr(10))) AS INT) AS lines, contains(text, '@') AS addressed FROM conversations",
    "neighbor_expand": f"WITH {KEPT}, h AS (SELECT doc_id, pos FROM kept WHERE n_words >= 45) SELECT DISTINCT k.doc_id, CAST(k.pos AS INT) AS pos FROM kept k JOIN h ON k.doc_id = h.doc_id AND abs(k.pos - h.pos) <= 1",
}
