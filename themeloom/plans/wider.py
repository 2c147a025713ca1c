"""Queries of filters, code anchors, retrieval units, encoder windows, decisions and records, each with its SQL where SQL expresses it.

What the given tables lack is planted in their texts alike on both sides, over whole tables; the SQL
states what a planted row must come to, and shares no pattern with the code.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import code, decide, fewshot, filters, segment, whole, windows
from ..sources import files
from . import oracle
from .further import SHORT, TEXT, asked_passages, read, wiki_sql, words

PLANTED = {
    3: "unit || ' See https://a.example/b, too.'",
    5: "'https://a.example/' || repeat('x', 200) || ' and so it goes on'",
    7: "'For additional information on the town and its river we went on.'",
    9: "'3. '",
    11: "'upright=1.2 ' || unit",
}
MARKED_UNIT = "CASE pos % 13 " + " ".join(f"WHEN {k} THEN {v}" for k, v in PLANTED.items()) + " ELSE unit END"


def _fates(s, d):
    units = segment.sentences(read(s, d, "documents")).withColumn("unit", F.expr(MARKED_UNIT))
    return filters.fates(units, aggressive=True, strip_urls=True, lenient=True, keep=F.col("pos") % 17 == 0)


FATES = f"""WITH {oracle.UNITS}, p AS (SELECT doc_id, pos, pos % 13 AS kind, pos % 17 = 0 AS keep, unit AS own, {MARKED_UNIT} AS unit, {wiki_sql("trim('upright=1.2 ' || unit)")} AS cleaned FROM units),
 r AS (SELECT *, CASE WHEN keep THEN 'kept' WHEN {oracle.junk('unit')} AND kind <> 5 AND NOT regexp_matches(lower(trim(unit)), '^([a-z][a-z]+\\s*\\(\\d{{4}}|\\d+\\.\\d+\\s+for\\s+)') THEN 'junk'
 WHEN kind = 11 AND {SHORT.format('cleaned')} THEN 'junk' WHEN kind = 5 OR (kind = 3 AND 20 > 0.4::DOUBLE * length(trim(unit))) THEN 'url' WHEN kind = 7 THEN 'aggressive' ELSE 'kept' END AS first FROM p), v AS (SELECT *, CASE WHEN kind = 3 AND NOT keep AND first = 'kept' THEN own || ' See <url>, too.' ELSE unit END AS shown FROM r),
 k AS (SELECT *, row_number() OVER (PARTITION BY doc_id, first, {oracle.dedup_key('shown')} ORDER BY pos) AS n FROM v),
 f AS (SELECT doc_id, pos, shown, CASE WHEN first = 'kept' AND n > 1 THEN 'repeat' ELSE first END AS fate FROM k)
"""

CODE_LINE = "CASE pos % 6 WHEN 0 THEN 'def f(' || line || ')' WHEN 3 THEN 'import ' || line ELSE line END"
CODE_TEXT = "regexp_replace(coalesce(text, ''), '[.!?] +', chr(10){g})"


def _code(s, d):
    rows = code.lines(read(s, d, "documents").select("doc_id", F.expr(CODE_TEXT.format(g="")).alias("text")))
    return code.units(rows.withColumn("line", F.expr(CODE_LINE)))


CODE = f"""WITH t AS (SELECT doc_id, list_filter(list_transform(string_split({CODE_TEXT.format(g=", 'g'")}, chr(10)), lambda x: regexp_replace(x, '[ \\t\\r]+$', '')), lambda x: x <> '') AS p FROM documents),
 l AS (SELECT doc_id, pos, {CODE_LINE} AS line FROM (SELECT doc_id, unnest(range(len(p)))::INT AS pos, unnest(p) AS line FROM t)),
 n AS (SELECT *, len({words('line')}) AS n_words FROM l),
 b AS (SELECT *, floor(sum(n_words) OVER (PARTITION BY doc_id) * 0.2::DOUBLE)::BIGINT AS budget, sum(n_words) OVER (PARTITION BY doc_id ORDER BY pos DESC ROWS UNBOUNDED PRECEDING) AS after FROM n),
 c AS (SELECT *, after <= floor(budget * 0.9::DOUBLE) AS tail FROM b),
 d AS (SELECT *, floor(budget * greatest(0.0::DOUBLE, least(0.1::DOUBLE, (budget - sum(CASE WHEN tail THEN n_words ELSE 0 END) OVER (PARTITION BY doc_id))::DOUBLE / greatest(budget, 1)))) AS cap FROM c),
 s AS (SELECT doc_id, list_reduce(list_prepend({{'u': 0::BIGINT, 'c': max(cap)::BIGINT, 'o': []::INT[]}}, list({{'u': n_words::BIGINT, 'c': 0::BIGINT, 'o': [pos]}} ORDER BY pos)),
 lambda a, x: CASE WHEN a.u + x.u <= a.c THEN {{'u': a.u + x.u, 'c': a.c, 'o': a.o || x.o}} ELSE a END).o AS o FROM d WHERE NOT tail AND pos % 3 = 0 GROUP BY doc_id)
SELECT doc_id, pos, n_words::INT AS n_words, 'tail' AS kind FROM d WHERE tail UNION ALL SELECT d.doc_id, pos, n_words::INT, 'struct' FROM d JOIN s USING (doc_id) WHERE NOT tail AND list_contains(o, pos)"""


def _paragraphs(s, d):
    """Documents as numbered paragraphs, one a sentence."""
    each = F.transform(T.sentence_parts(F.expr(TEXT)), lambda x, i: F.concat(F.lit("Paragraph "), (i + 1).cast("string"), F.lit(": "), x))
    return read(s, d, "documents").select("doc_id", F.array_join(each, "\n\n").alias("text"))


def _signed(s, d):
    return fewshot.signatures(fewshot.paragraphs(_paragraphs(s, d)))


SIGNED = f"""u AS (SELECT doc_id, unnest(range(len(p)))::BIGINT AS unit, unnest(p) AS body FROM (SELECT doc_id, {oracle.parts(TEXT)} AS p FROM documents)),
 w AS (SELECT *, {words('body')} AS ws FROM u),
 c AS (SELECT *, len(ws) AS n, least(len(ws), 12) + 2 AS sig_cost, 'Paragraph ' || (unit + 1) || ': ' || array_to_string(ws[:12], ' ') || CASE WHEN len(ws) > 12 THEN ' ...' ELSE '' END AS signature FROM w),
 signed AS (SELECT *, greatest(1, n + 2 - sig_cost) AS cost, greatest(0, floor(sum(n) OVER (PARTITION BY doc_id) * 0.2::DOUBLE)::BIGINT - sum(sig_cost) OVER (PARTITION BY doc_id)) AS budget FROM c)"""


def shown_units(s, d):
    """Every third unit is bought whole, whatever it costs."""
    signed = _signed(s, d)
    out = fewshot.shown(signed, signed.filter("unit % 3 = 0").select("doc_id", "unit"))
    return out.select("doc_id", "n_units", "n_full_units", "words_used", F.md5("context").alias("hash"))


SHOWN = f"""WITH {SIGNED} SELECT doc_id, count(*) AS n_units, count_if(unit % 3 = 0)::BIGINT AS n_full_units, sum(sig_cost + CASE WHEN unit % 3 = 0 THEN cost ELSE 0 END)::BIGINT AS words_used,
 md5(string_agg(CASE WHEN unit % 3 = 0 THEN 'Paragraph ' || (unit + 1) || ': ' || body ELSE signature END, chr(10) || chr(10) ORDER BY unit)) AS hash FROM signed GROUP BY doc_id"""


# Words shown of each sentence, and the part of what all sentences have beyond them that is bought.
SENTENCE_HEAD, BOUGHT = 2, 0.5


def retrieved_units(s, d):
    """Every document, as numbered paragraphs, asked the words of one benchmark passage; half of what signatures leave out is bought."""
    numbered = lambda text: "\n\n".join(f"Paragraph {i}: {x}" for i, x in enumerate(whole.sentence_parts(text or ""), 1))
    return fewshot.retrieved(asked_passages(s, d, read(s, d, "documents")), sig_words=SENTENCE_HEAD, rest=BOUGHT, numbered=numbered)


def attention(s, d):
    """A word stands for four letters begun of a token each."""
    sizes = F.transform(T.sentence_parts(F.expr(TEXT)), lambda p: F.ceil(F.length(p) / 4).cast("long"))
    held = read(s, d, "documents").select("doc_id", windows.attention_windows(sizes).alias("w"))
    return held.select("doc_id", F.posexplode("w").alias("window", "x")).select("doc_id", "window", F.array_min("x.positions").alias("first"), F.array_max("x.positions").alias("last"), F.col("x.n_tokens").alias("n_tokens"))


PIECES = "CASE WHEN i % 3 = 1 THEN '##' || w WHEN i % 5 = 0 THEN '▁' || w ELSE w END"


def merged_words(s, d):
    """Words of a text as pieces: every third goes on with the one before."""
    held = read(s, d, "documents").selectExpr("doc_id", f"filter(split({TEXT}, '[ \\\\t\\\\r\\\\n]+'), w -> w <> '') as ws")
    pieces = held.select("doc_id", F.expr(f"transform(ws, (w, i) -> {PIECES})").alias("p"), F.expr("transform(ws, (w, i) -> double(length(w)))").alias("x"))
    merged = pieces.select("doc_id", windows.whole_words(F.col("p"), F.col("x")).alias("m"))
    return merged.select("doc_id", F.size("m").alias("n"), F.md5(F.array_join(F.transform("m", lambda w: F.concat(w["word"], F.lit("="), w["weight"].cast("int").cast("string"), F.lit("@"), F.element_at(w["places"], 1).cast("string"))), " ")).alias("hash"))


MERGED = f"""WITH t AS (SELECT doc_id, {words(TEXT)} AS ws FROM documents), e AS (SELECT doc_id, unnest(range(len(ws))) AS i, unnest(ws) AS w FROM t),
 g AS (SELECT *, sum(CASE WHEN i > 0 AND i % 3 = 1 THEN 0 ELSE 1 END) OVER (PARTITION BY doc_id ORDER BY i ROWS UNBOUNDED PRECEDING) AS g FROM e),
 m AS (SELECT doc_id, g, lower(string_agg(replace(replace(w, '▁', ''), '##', ''), '' ORDER BY i)) AS word, sum(length(w))::INT AS weight, min(i) AS place FROM g GROUP BY ALL)
SELECT t.doc_id, coalesce(count(g), 0)::INT AS n, md5(coalesce(string_agg(word || '=' || weight || '@' || place, ' ' ORDER BY g), '')) AS hash FROM t LEFT JOIN m USING (doc_id) GROUP BY t.doc_id"""

ASKED = "CASE turn % 5 WHEN 0 THEN 'Please sum  this up' WHEN 1 THEN 'an Overview of it' ELSE coalesce(text, '') END"
MODE = "CASE conv_id % 3 WHEN 0 THEN 'auto' WHEN 1 THEN 'off' END"


def summary_turns(s, d):
    rows = read(s, d, "conversations").select("conv_id", "turn", F.expr(ASKED).alias("line"), F.expr(MODE).alias("mode"))
    return rows.select("conv_id", "turn", decide.summary(F.col("mode"), F.col("line"), F.col("turn") % 7 == 0).alias("why"))


def search_gates(s, d):
    p = F.when(F.col("event_id") % 4 != 0, F.col("value") / 100)
    rows = read(s, d, "events").select("event_id", decide.gate(F.when(F.col("event_id") % 3 != 0, "auto").otherwise("off"), p).alias("g"))
    return rows.select("event_id", "g.mode", "g.fired", "g.error")


def scoped_turns(s, d):
    mode = F.element_at(F.array(*map(F.lit, ("auto", "named", "off"))), (F.col("event_id") % 3 + 1).cast("int"))
    found = decide.scope(mode, F.array("event_type"), F.when(F.col("event_id") % 2 == 0, F.array("event_type", F.lit("a"))))
    return read(s, d, "events").select("event_id", F.size(found).alias("n"), F.array_join(found, ",", "-").alias("sources"))


def dated_turns(s, d):
    """Each user asks for one day and month, tried in the years with rows and one without."""
    rows = read(s, d, "events").select("user_id", "ts", F.when(F.col("event_id") % 5 == 0, "file").alias("source"))
    years = files.Window.partitionBy("user_id").orderBy(F.desc("y"))
    tried = rows.filter("source is null").select("user_id", F.year("ts").alias("y")).distinct().unionByName(rows.select("user_id", F.lit(1999).alias("y")).distinct())
    tried = tried.withColumn("nth", F.row_number().over(years)).select("user_id", "nth", F.make_date("y", F.col("user_id") % 12 + 1, F.lit(1)).alias("start"))
    tried = tried.withColumn("end", F.when(F.col("user_id") % 2 == 0, F.add_months("start", 1)).otherwise(F.date_add("start", 9)))
    at = lambda c: F.col(c).cast("timestamp").alias(c)
    return decide.windowed(rows, tried.select("user_id", "nth", at("start"), at("end")), "user_id", "ts").select("user_id", "label", "rows_in", "rows_out", "applied")


DATED = """WITH e AS (SELECT user_id, ts, event_id % 5 = 0 AS file FROM events), y AS (SELECT DISTINCT user_id, year(ts) AS y FROM e WHERE NOT file UNION SELECT DISTINCT user_id, 1999 FROM e),
 t AS (SELECT user_id, y, make_date(y, user_id % 12 + 1, 1) AS a FROM y), w AS (SELECT user_id, a, CASE WHEN user_id % 2 = 0 THEN (a + INTERVAL 1 MONTH)::DATE ELSE a + 9 END AS b FROM t),
 c AS (SELECT w.user_id, a, b, count(ts) FILTER (ts >= a AND ts < b) AS n, count(ts) AS total FROM w LEFT JOIN e ON w.user_id = e.user_id AND NOT file GROUP BY ALL),
 f AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY n > 0 DESC, a DESC) AS r FROM c)
SELECT user_id, CASE WHEN user_id % 2 = 0 THEN strftime(a, '%B %Y') ELSE '1 to 9 ' || strftime(a, '%B %Y') END AS label, n AS rows_in, CASE WHEN n > 0 THEN total - n ELSE 0 END AS rows_out, n > 0 AS applied FROM f WHERE r = 1"""


def fitted_sections(s, d):
    rows = read(s, d, "conversations").select("conv_id", "turn", T.n_words(F.expr(TEXT)).alias("n_words"))
    return decide.fitted(rows, "conv_id", "turn", 60)


FLAT = "doc_id as at, case when doc_id % 9 = 0 then '' else source end as title, text as context"


def nested_records(s, d):
    """Documents as flat rows of their source; every second holds a written list of pairs, some of them torn."""
    pairs = F.expr("case when doc_id % 2 = 0 then case when doc_id % 10 = 0 then '[{torn' else concat('[{''Q'': ''', lang, ''', ''A'': ''x''}, {''question'': ''b'', ''answer'': ''y''}]') end end")
    rows = read(s, d, "documents").selectExpr(*FLAT.split(", "), "lang as question", "'z' as answer", "doc_id", "lang").withColumn("qa_pairs", pairs)
    out = files.nested(rows.drop("doc_id", "lang"))
    said = F.transform("questions", lambda q: F.concat_ws(":", q["id"], q["question"], q["answer"]))
    return out.select("title", "n_words", "n_questions", F.md5(F.array_join(said, ",")).alias("hash"))


NESTED = f"""WITH r AS (SELECT doc_id AS n, CASE WHEN doc_id % 9 = 0 OR source IS NULL OR source = '' THEN 'unknown_' || doc_id ELSE source END AS title, coalesce(text, '') AS context,
 CASE WHEN doc_id % 10 = 0 THEN [] WHEN doc_id % 2 = 0 AND lang IS NOT NULL THEN [{{'i': 0, 'q': lang, 'a': 'x'}}, {{'i': 1, 'q': 'b', 'a': 'y'}}] ELSE [{{'i': NULL, 'q': coalesce(lang, ''), 'a': 'z'}}] END AS q FROM documents),
 g AS (SELECT title, arg_min(context, n) AS context, flatten(list(q ORDER BY n)) AS q FROM r GROUP BY title)
SELECT title, len({words('context')})::INT AS n_words, len(q)::INT AS n_questions, md5(array_to_string(list_transform(q, lambda x, k: title || '__' || coalesce(x.i, k - 1) || ':' || x.q || ':' || x.a), ',')) AS hash FROM g"""

#: name -> (query, SQL)
PAIRS = {
    "unit_fates": (lambda s, d: _fates(s, d).select("doc_id", "pos", "fate", F.md5("unit").alias("hash")), FATES + "SELECT doc_id, pos::INT AS pos, fate, md5(shown) AS hash FROM f"),
    "fate_counts": (lambda s, d: filters.counters(_fates(s, d)), FATES + "SELECT doc_id, " + ", ".join(f"count_if(fate = '{f}')::BIGINT AS {n}" for f, n in (("kept", "n_kept"), ("junk", "n_junk"), ("url", "n_url"), ("aggressive", "n_aggressive"), ("repeat", "n_dedup"))) + " FROM f GROUP BY doc_id"),
    "code_anchors": (lambda s, d: code.anchors(_code(s, d)), CODE),
    "unit_signatures": (lambda s, d: _signed(s, d).select("doc_id", "unit", F.md5("signature").alias("hash"), "sig_cost", "cost", "budget"), f"WITH {SIGNED} SELECT doc_id, unit, md5(signature) AS hash, sig_cost::INT AS sig_cost, cost::INT AS cost, budget::BIGINT AS budget FROM signed"),
    "shown_units": (shown_units, SHOWN),
    "merged_words": (merged_words, MERGED),
    "summary_turns": (summary_turns, f"SELECT conv_id, turn, CASE WHEN turn % 7 = 0 THEN 'marked by /summary' WHEN conv_id % 3 = 0 AND turn % 5 < 2 THEN 'the question asks for a summary' END AS why FROM conversations"),
    "search_gates": (search_gates, "SELECT event_id, CASE WHEN event_id % 3 <> 0 THEN CASE WHEN event_id % 4 <> 0 AND value IS NOT NULL THEN 'auto' ELSE 'unavailable' END END AS mode, CASE WHEN event_id % 3 <> 0 THEN event_id % 4 <> 0 AND coalesce(value / 100 >= 0.999, false) END AS fired, CASE WHEN event_id % 3 <> 0 AND (event_id % 4 = 0 OR value IS NULL) THEN 'no scoring' END AS error FROM events"),
    "scoped_turns": (scoped_turns, "SELECT event_id, CASE event_id % 3 WHEN 0 THEN 1 WHEN 1 THEN CASE WHEN event_id % 2 = 0 THEN 3 ELSE 1 END END::INT AS n, CASE event_id % 3 WHEN 0 THEN event_type WHEN 1 THEN CASE WHEN event_id % 2 = 0 THEN '-,' || event_type || ',a' ELSE '-' END END AS sources FROM events"),
    "dated_turns": (dated_turns, DATED),
    "fitted_sections": (fitted_sections, f"SELECT conv_id, turn, n_words::INT AS n_words FROM (SELECT *, sum(n_words) OVER (PARTITION BY conv_id ORDER BY turn ROWS UNBOUNDED PRECEDING) AS w FROM (SELECT conv_id, turn, len({words(TEXT)}) AS n_words FROM conversations)) WHERE w <= 60"),
    "nested_records": (nested_records, NESTED),
    "session_list": (lambda s, d: files.sessions(read(s, d, "events"), "user_id", "event_type", "ts"), "SELECT user_id, count(DISTINCT event_type) AS n_turns, count(*) AS n_sentences, max(ts) AS modified FROM events GROUP BY user_id"),
}
#: Queries that SQL does not express; tests hold their operators against plain versions.
ALONE = {"retrieved_units": retrieved_units, "attention_windows": attention}

TABLE = {k: f for k, (f, _) in PAIRS.items()} | ALONE
SQL = {k: sql for k, (_, sql) in PAIRS.items()}
