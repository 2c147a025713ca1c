"""DuckDB SQL of the further queries, written on its own from the same definitions."""

from __future__ import annotations

from ..functions import chat as C
from ..functions import text as T
from ..operators import code, fewshot, pages
from .oracle import EDGES, STRIP, UNITS, WS, content, n_words, parts, q, squeeze

TXT = "coalesce(text, '')"
WORDS = "list_filter(string_split_regex({}, '" + WS + "'), lambda w: w <> '')"


def matches(col: str, *patterns: str) -> str:
    return "(" + " OR ".join(f"regexp_matches({col}, {q(p)})" for p in patterns) + ")"


def in_list(words) -> str:
    return "(" + ", ".join(q(w) for w in words) + ")"


def code_lines(table: str, key: str, col: str) -> str:
    return f"lines AS (SELECT doc_id, unnest(l) AS line, generate_subscripts(l, 1) AS pos FROM (SELECT {key} AS doc_id, list_filter(list_transform(string_split(coalesce({col}, ''), chr(10)), lambda x: regexp_replace(x, '[ \\t\\r]+$', '')), lambda x: x <> '') AS l FROM {table}))"


def fewshot_case() -> str:
    arms = []
    for name, mark, label, least in fewshot.PATTERNS:
        count = lambda m: f"((length(t) - length(replace(t, {q(m)}, ''))) // {len(m)})"
        cut = f"list_filter(list_transform(string_split(t, {q(mark)})[2:], lambda b: regexp_replace({q(mark)} || b, '{EDGES}', '', 'g')), lambda b: b <> {q(mark.strip())})"
        held = f"len(list_filter({cut}, lambda b: contains(b, {q(label)})))"
        fits = f"{count(mark)} >= {least} AND {count(label)} >= {least} AND greatest({count(mark)}, {count(label)}) <= 3 * least({count(mark)}, {count(label)}) AND {held} >= {least}"
        arms.append(f"WHEN {fits} THEN {{'pattern': {q(name)}, 'n': len({cut})}}")
    return f"SELECT doc_id, r.pattern, r.n::INT AS n_blocks FROM (SELECT doc_id, CASE {' '.join(arms)} ELSE {{'pattern': 'none', 'n': 0}} END AS r FROM (SELECT doc_id, {TXT} AS t FROM documents))"


TOKENS = WORDS.format("line")
SIGNALS = f"g AS (SELECT conv_id, turn, {n_words(TXT)} AS n_words, length({TXT}) - length(replace({TXT}, '?', '')) AS questions, len(string_split({TXT}, chr(10))) AS lines, contains({TXT}, '@') AS addressed FROM conversations)"
FIRED = SIGNALS + ", f AS (SELECT *, n_words > 200 AS a, questions > 0 AND NOT lines > 3 AS b, addressed OR n_words <= 3 AS c FROM g)"
STARTS = [f"^(?:{'|'.join(T.JUNK_STARTS)})", *T.JUNK_INSIDE]
STOP = in_list([*T.QUERY_STOPWORDS, *C.ASKING_WORDS])
NAME_EDGES = "^[.,;:!?()\\[\\]\"'“”‘’]+|[.,;:!?()\\[\\]\"'“”‘’]+$"
JOINED = "(length(w) > 5 AND regexp_matches(w, '^\\p{L}{2,}(?:-\\p{L}{2,})+$'))"
SAID = f"said AS (SELECT conv_id, turn, {parts(TXT)} AS p FROM conversations WHERE role IN ('user', 'assistant'))"

SQL = {
    "code_lines": f"WITH {code_lines('documents', 'doc_id', 'text')} SELECT doc_id, count(*) AS n_lines, sum(length(line))::BIGINT AS n_chars FROM lines GROUP BY doc_id",
    "code_units": f"WITH {code_lines('pages', 'page_id', 'html')}, m AS (SELECT *, {matches('line', code.PATH_LINE, code.SIGNATURE)} AS o, {matches('line', code.PATH_LINE, code.SIGNATURE, code.IMPORT)} AS a FROM lines) SELECT doc_id, count_if(o)::BIGINT AS n_units, count_if(a)::BIGINT AS n_anchors FROM m GROUP BY doc_id",
    "fewshot_detect": fewshot_case(),
    "furniture_removed": f"""WITH p AS (SELECT regexp_extract(url, '^[a-z]+://([^/]+)', 1) AS doc, page_id AS page, string_split(coalesce(regexp_replace(html, '(?i)<(?:br|p|div|li|h\\d|tr)[^>]*>', chr(10), 'g'), ''), chr(10)) AS l FROM pages),
 r AS (SELECT doc, page, len(l) AS n, unnest(l) AS line, generate_subscripts(l, 1) - 1 AS pos FROM p),
 m AS (SELECT *, pos < least({pages.ZONE}, greatest(1, n // 3)) OR pos >= n - least({pages.ZONE}, greatest(1, n // 3)) AS edge, regexp_replace(lower(trim(line)), '\\d+', '#', 'g') AS print FROM r),
 s AS (SELECT doc, print, count(DISTINCT page) AS on_ FROM m WHERE edge AND print <> '' GROUP BY ALL), c AS (SELECT doc, count(DISTINCT page) AS total FROM m GROUP BY doc),
 f AS (SELECT doc, print FROM s JOIN c USING (doc) WHERE on_ >= greatest({pages.LEAST_PAGES}, floor(total * 0.5)))
 SELECT doc, page, count(*) AS n_lines FROM m WHERE NOT (edge AND ((doc, print) IN (SELECT (doc, print) FROM f) OR regexp_matches(line, '^\\s*[-–—]?\\s*(?:[Pp]age\\s+)?\\d{{1,4}}\\s*(?:of\\s+\\d+)?\\s*[-–—]?\\s*$'))) GROUP BY ALL""",
    "table_lines": f"WITH r AS (SELECT doc_id, unnest(l) AS line, (generate_subscripts(l, 1) - 1)::INT AS pos FROM (SELECT doc_id, string_split({TXT}, chr(10)) AS l FROM documents)) SELECT doc_id, pos FROM r WHERE len({TOKENS}) >= 6 AND 2 * len(list_filter({TOKENS}, lambda w: regexp_matches(w, {q(pages.NUMERIC)}))) >= len({TOKENS})",
    "url_placeholder": f"SELECT doc_id, md5(regexp_replace(text, {q(C.URL_TAIL)}, '<url>\\1\\2', 'g')) AS hash, regexp_matches(text, {q(C.URL)}) AS has_url FROM documents",
    "protected_units": f"WITH {UNITS} SELECT doc_id, pos::INT AS pos, length(u) - length(replace(u, '|', '')) >= 2 OR (contains(u, '<url>') AND {n_words('u')} >= 3) OR (length(u) >= 10 AND regexp_matches(u, {q(C.CODE_LIKE)})) AS protected FROM (SELECT *, trim(unit) AS u FROM units)",
    "short_user_units": f"WITH {UNITS} SELECT doc_id, pos::INT AS pos, u <> '' AND (length(u) < 30 OR {n_words('u')} < 5) AND regexp_matches(u, '\\p{{L}}') AND NOT regexp_matches(u, {q(C.URL)}) AND NOT {matches('lower(u)', *STARTS)} AS short FROM (SELECT *, trim(unit) AS u FROM units)",
    "acknowledgements": f"SELECT conv_id, turn, len(list_filter(regexp_extract_all(lower({TXT}), '[a-z]+'), lambda w: length(w) > 2 AND w NOT IN {in_list(['the', *C.ACKNOWLEDGEMENTS])})) = 0 AS ack FROM conversations",
    "summary_asks": f"SELECT conv_id, turn, {matches(squeeze(f'lower({TXT})'), *C.SUMMARY_ASKS)} AS asks FROM conversations",
    "query_keywords": f"SELECT item_id, array_to_string(list_sort(list_distinct(list_filter(list_transform(string_split_regex(lower(text), '{WS}'), lambda w: {STRIP}), lambda w: length(w) >= 2 AND regexp_matches(w, '^\\p{{L}}+$') AND w NOT IN {STOP}))), ',') AS words FROM benchmark",
    "proper_nouns": f"""WITH r AS (SELECT item_id, list_filter(list_transform(string_split_regex(text, '{WS}'), lambda w: regexp_replace(w, {q(NAME_EDGES)}, '', 'g')), lambda w: length(w) >= 2) AS ws FROM benchmark),
 n AS (SELECT item_id, list_filter(ws, lambda w: {JOINED} OR (NOT (length(w) > 3 AND upper(w) = w AND lower(w) <> w) AND regexp_matches(w, '^\\p{{Lu}}'))) AS ws FROM r),
 l AS (SELECT item_id, list_transform(list_transform(ws, lambda w: lower(w)), lambda w: CASE WHEN {JOINED} THEN w ELSE {STRIP} END) AS ws FROM n)
 SELECT item_id, array_to_string(list_sort(list_distinct(list_filter(ws, lambda w: w <> '' AND w NOT IN {in_list([*T.QUESTION_WORDS, *T.QUERY_STOPWORDS])}))), ',') AS names FROM l""",
    "final_line": f"SELECT conv_id, turn, regexp_replace(trim(regexp_replace(coalesce(list_filter(list_transform(string_split({TXT}, chr(10)), lambda x: trim(x)), lambda x: x <> '')[-1], ''), '[*_`#>]+', '', 'g')), '(?i)^(final\\s+answer|the\\s+answer\\s+is|answer\\s+is|answer)\\s*[:\\-]?\\s*', '') AS line FROM conversations",
    "format_age": "SELECT event_id, CASE WHEN s < 60 THEN 'just now' WHEN s < 3600 THEN floor(s / 60)::BIGINT || 'm ago' WHEN s < 86400 THEN floor(s / 3600)::BIGINT || 'h ago' ELSE floor(s / 86400)::BIGINT || 'd ago' END AS age FROM (SELECT event_id, value * 1000 AS s FROM events)",
    "budgets": "SELECT event_id, CASE WHEN b > 0 AND b <= 1 THEN round(b, 9) END AS budget FROM (SELECT event_id, CASE WHEN value > 1 THEN value / 100.0::DOUBLE ELSE value END AS b FROM events)",
    "rule_decisions": f"WITH {FIRED} SELECT conv_id, turn, concat_ws(',', CASE WHEN a THEN 'long' END, CASE WHEN b THEN 'asked' END, CASE WHEN c THEN 'named' END) AS fired, CASE WHEN b THEN 0.3::DOUBLE WHEN a THEN 0.1::DOUBLE END AS budget, CASE WHEN c THEN 'named' WHEN b THEN 'auto' END AS scope FROM f",
    "rule_census": f"WITH {FIRED} SELECT unnest(['long', 'asked', 'named']) AS rule, unnest([count_if(a), count_if(b), count_if(c)])::BIGINT AS fires, count(*) AS asked FROM f",
    "time_windows": """WITH e AS (SELECT event_id, date_trunc('day', ts) AS d, event_id % 6 AS k FROM events), w AS (SELECT event_id,
 CASE k WHEN 0 THEN d - INTERVAL 1 DAY WHEN 1 THEN date_trunc('week', d) - INTERVAL 7 DAY WHEN 2 THEN d - INTERVAL 3 DAY WHEN 3 THEN TIMESTAMP '2024-03-12' WHEN 4 THEN date_trunc('month', d) END AS s,
 CASE k WHEN 0 THEN d WHEN 1 THEN date_trunc('week', d) WHEN 2 THEN d - INTERVAL 2 DAY WHEN 3 THEN TIMESTAMP '2024-03-13' WHEN 4 THEN date_trunc('month', d) + INTERVAL 1 MONTH END AS e FROM e)
 SELECT event_id, epoch(s)::BIGINT AS start_s, epoch(e)::BIGINT AS end_s FROM w""",
    "number_share": f"SELECT doc_id, CASE WHEN len(n) > 0 THEN round(len(list_filter(n, lambda x: x = '1')) / len(n), 9) ELSE 0 END AS share FROM (SELECT doc_id, regexp_extract_all({TXT}, '\\d+') AS n FROM documents)",
    "articles": f"SELECT source AS article, count(*)::INT AS n_questions, {n_words('max(lang)')}::INT AS n_words FROM documents GROUP BY source",
    "sample_records": f"SELECT doc_id, sha1({TXT}) AS _id, {n_words(TXT)}::BIGINT AS length FROM documents",
    "haystacks": f"WITH w AS (SELECT doc_id, {WORDS.format(TXT)} AS w FROM documents), s AS (SELECT doc_id, w, unnest(range(len(w) // 194)) AS slice FROM w) SELECT doc_id, slice::INT AS slice, md5(array_to_string(list_concat(list_concat(w[slice * 194 + 1:slice * 194 + 97], ['The', 'special', 'number', 'is', '4711', '.']), w[slice * 194 + 98:slice * 194 + 194]), ' ')) AS hash FROM s",
    "session_replay": f"""WITH {SAID}, r AS (SELECT conv_id, turn, unnest(p) AS s, generate_subscripts(p, 1) AS i FROM said), h AS (SELECT *, row_number() OVER (PARTITION BY conv_id, sha1(lower({squeeze('s')})) ORDER BY turn, i) AS n FROM r),
 a AS (SELECT conv_id, turn, count(*) AS added FROM h WHERE n = 1 GROUP BY ALL), k AS (SELECT conv_id, kw, min(turn) AS turn FROM (SELECT conv_id, turn, unnest({content('s')}) AS kw FROM h WHERE n = 1) GROUP BY ALL), c AS (SELECT conv_id, turn, count(*) AS fresh FROM k GROUP BY ALL)
 SELECT conv_id, turn, len(p)::BIGINT AS n_rows, coalesce(added, 0)::BIGINT AS n_added, sum(coalesce(added, 0)) OVER o::BIGINT AS n_total, sum(coalesce(added, 0)) OVER o::BIGINT AS n_alive, sum(coalesce(fresh, 0)) OVER o::BIGINT AS n_keywords, false AS late
 FROM said LEFT JOIN a USING (conv_id, turn) LEFT JOIN c USING (conv_id, turn) WINDOW o AS (PARTITION BY conv_id ORDER BY turn)""",
    "tumbling_days": "SELECT epoch(date_trunc('day', ts))::BIGINT AS start_s, count(*) AS n FROM events GROUP BY ALL",
}

