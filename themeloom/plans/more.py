"""Further queries of the catalogue: code, exemplars, pages, chat wording, rules, time windows, metrics, sessions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import chat as C
from ..functions import text as T
from ..functions import when
from ..operators import code, fewshot, legacy_select, metrics, pages, segment
from ..sources import files
from ..streaming import session as streaming
from . import rules

# A small rule book over snapshot signals, for the rule queries.
RULES = [
    rules.Rule("long", "n_words > 200", {"budget": 0.1}),
    rules.Rule("asked", "questions > 0 and not (lines > 3)", {"budget": 0.3, "scope": "auto"}),
    rules.Rule("named", "addressed or words <= 3", {"scope": "named"}),
]
SWITCHES = {"budget": float, "scope": str}
QUERY = "Which river crosses the old town and what did the council decide?"


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def _docs(s, d):
    return read(s, d, "documents")


def _talk(s, d):
    return read(s, d, "conversations")


def _pages(s, d):
    """Pages of one host as pages of one document: the host stands for it."""
    return read(s, d, "pages").select(F.regexp_extract("url", r"^[a-z]+://([^/]+)", 1).alias("host"), "page_id", F.regexp_replace("html", r"(?i)<(?:br|p|div|li|h\d|tr)[^>]*>", "\n").alias("text"))


def signals(s, d):
    t = F.coalesce("text", F.lit(""))
    return _talk(s, d).select(
        "conv_id", "turn", T.n_words(t).alias("words"), T.n_words(t).alias("n_words"), (F.length(t) - F.length(F.replace(t, F.lit("?"), F.lit("")))).alias("questions"), F.size(F.split(t, "\n")).alias("lines"), F.contains(t, F.lit("@")).alias("addressed")
    )


def rule_decisions(s, d):
    out = rules.decided(signals(s, d), RULES, SWITCHES)
    return out.select("conv_id", "turn", F.array_join("fired", ",").alias("fired"), "budget", "scope")


def _pairs(s, d):
    c = _talk(s, d)
    u = c.select("conv_id", (F.col("turn") + 1).alias("turn"), F.col("text").alias("answer"))
    return c.join(u, ["conv_id", "turn"]).select((F.col("conv_id") * 100000 + F.col("turn")).alias("id"), F.col("text").alias("prediction"), "answer")


def legacy(s, d):
    return legacy_select.legacy_of_documents(_docs(s, d), QUERY)


def time_windows(s, d):
    e = read(s, d, "events").select("event_id", F.col("ts").alias("asked"))
    line = F.element_at(F.array(*[F.lit(x) for x in ("what was said yesterday", "notes of last week", "three days ago", "on 12 March 2024", "this month", "no time here")]), (F.pmod("event_id", F.lit(6)) + 1).cast("int"))
    w = e.withColumn("line", line).withColumn("w", when.windows(F.col("line"), F.col("asked")))
    return w.select("event_id", F.unix_seconds("w.start").alias("start_s"), F.unix_seconds("w.end").alias("end_s"))


TABLE = {
    "code_lines": lambda s, d: code.lines(_docs(s, d)).groupBy("doc_id").agg(F.count("*").alias("n_lines"), F.sum(F.length("line")).alias("n_chars")),
    "code_units": lambda s, d: code.units(code.lines(read(s, d, "pages"), "page_id", "html")).groupBy("doc_id").agg(F.max("unit").alias("n_units"), F.count_if("anchor").alias("n_anchors")),
    "code_identifiers": lambda s, d: read(s, d, "pages").select("page_id", F.size(code.identifiers(F.coalesce("html", F.lit("")))).alias("n_names"), F.array_join(F.slice(F.sort_array(code.identifiers(F.coalesce("html", F.lit("")))), 1, 5), ",").alias("first_names")),
    "fewshot_detect": lambda s, d: fewshot.detect(_docs(s, d)).select("doc_id", "pattern", F.size("blocks").alias("n_blocks")),
    "paragraph_units": lambda s, d: fewshot.paragraphs(_docs(s, d)),
    "furniture_removed": lambda s, d: pages.without_furniture(pages.page_lines(_pages(s, d), "host", "page_id", "text")).groupBy("doc", "page").agg(F.count("*").alias("n_lines")),
    "table_lines": lambda s, d: pages.page_lines(_docs(s, d), "doc_id", "doc_id", "text").filter(pages.table_line(F.col("line"))).select(F.col("doc").alias("doc_id"), "pos"),
    "url_placeholder": lambda s, d: _docs(s, d).select("doc_id", F.md5(C.url_placeholder(F.col("text"))).alias("hash"), C.has_url(F.col("text")).alias("has_url")),
    "protected_units": lambda s, d: segment.sentences(_docs(s, d)).select("doc_id", "pos", C.protected(F.col("unit")).alias("protected")),
    "short_user_units": lambda s, d: segment.sentences(_docs(s, d)).select("doc_id", "pos", C.short_user_unit(F.col("unit")).alias("short")),
    "report_junk": lambda s, d: segment.sentences(_docs(s, d)).filter(C.report_junk(F.col("unit"))).select("doc_id", "pos"),
    "acknowledgements": lambda s, d: _talk(s, d).select("conv_id", "turn", C.acknowledgement_only(F.coalesce("text", F.lit(""))).alias("ack")),
    "summary_asks": lambda s, d: _talk(s, d).select("conv_id", "turn", C.summary_ask(F.col("text")).alias("asks")),
    "query_keywords": lambda s, d: read(s, d, "benchmark").select("item_id", F.array_join(F.sort_array(C.query_keywords(F.col("text"))), ",").alias("words")),
    "proper_nouns": lambda s, d: read(s, d, "benchmark").select("item_id", F.array_join(F.sort_array(C.proper_nouns(F.col("text"))), ",").alias("names")),
    "scoring_form": lambda s, d: _talk(s, d).select("conv_id", "turn", C.scoring_form(F.coalesce("text", F.lit(""))).alias("form")),
    "final_line": lambda s, d: _talk(s, d).select("conv_id", "turn", C.final_line(F.coalesce("text", F.lit(""))).alias("line")),
    "format_age": lambda s, d: read(s, d, "events").select("event_id", C.age(F.col("value") * 1000).alias("age")),
    "budgets": lambda s, d: read(s, d, "events").select("event_id", F.round(C.budget(F.col("value")), 9).alias("budget")),
    "rule_decisions": rule_decisions,
    "rule_census": lambda s, d: rules.census(rules.decided(signals(s, d), RULES, SWITCHES), RULES),
    "time_windows": time_windows,
    "number_share": lambda s, d: _docs(s, d).select("doc_id", F.round(metrics.number_share(F.col("text"), F.lit("1")), 9).alias("share")),
    "rouge_l": lambda s, d: _pairs(s, d).select("id", F.round(metrics.rouge(F.col("prediction"), F.col("answer")), 9).alias("score")),
    "code_similarity": lambda s, d: _pairs(s, d).select("id", F.round(metrics.code_similarity(F.coalesce("prediction", F.lit("")), F.col("answer")), 9).alias("score")),
    "articles": lambda s, d: files.by_article(_docs(s, d).select(F.col("source").alias("article"), F.col("lang").alias("context"), F.col("text").alias("question"), F.col("lang").alias("answer"))).select("article", "n_questions", "n_words"),
    "sample_records": lambda s, d: files.normalised(_docs(s, d).selectExpr("cast(null as string) _id", "text context", "cast(null as bigint) length", "cast(null as string) input", "doc_id")).select("doc_id", "_id", "length"),
    "haystacks": lambda s, d: files.haystacks(_docs(s, d), 200, "The special number is 4711 .").select("doc_id", "slice", F.md5("prompt").alias("hash")),
    "session_replay": lambda s, d: streaming.replay(_talk(s, d)),
    "tumbling_days": lambda s, d: streaming.tumbling(read(s, d, "events"), "ts", "1 day").select(F.unix_seconds("start").alias("start_s"), "n"),
    "legacy_select": legacy,
}
