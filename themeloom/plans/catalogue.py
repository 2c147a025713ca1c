"""Queries of the engine's own operators over whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import scoring, segment, select, session, themes, vectors

Query = Callable[[SparkSession, str], DataFrame]


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def _docs(s, d):
    return read(s, d, "documents")


def _units(s, d):
    return segment.sentences(_docs(s, d))


def _kept(s, d):
    return segment.filtered(_units(s, d))


def _kws(s, d):
    return segment.keywords(_kept(s, d))


def _themes(s, d):
    return themes.themes(themes.keyword_df(_kws(s, d)))


def _paths(s, d):
    return themes.paths(_kws(s, d), _themes(s, d))


def _nodes(s, d):
    return themes.nodes(_paths(s, d), _themes(s, d))


def _rows(s, d):
    return session.memory_rows(read(s, d, "conversations"))


def _vectors(s, d):
    return read(s, d, "embeddings")


def _first_vector(s, d):
    return _vectors(s, d).orderBy("vec_id").limit(1)


def _pairs(s, d):
    c = read(s, d, "conversations")
    u = c.select("conv_id", (F.col("turn") + 1).alias("turn"), F.col("text").alias("answer"))
    return c.join(u, ["conv_id", "turn"]).select((F.col("conv_id") * 100000 + F.col("turn")).alias("id"), F.col("text").alias("prediction"), "answer")


def coverage_select(s, d):
    return select.coverage_of_documents(_docs(s, d))


def worker_rollup(s, d):
    e = read(s, d, "events").select(F.col("event_type").alias("target"), F.col("event_id").alias("id"), F.when(F.col("value") > 50, "ok").otherwise("failed").alias("status"), F.lit(0.0).alias("t_start"), F.lit(0.0).alias("t_end"), F.floor("value").alias("tokens"))
    return scoring.worker_rollup(e).drop("seconds")


def neighbor_expand(s, d):
    kept = _kept(s, d)
    near = kept.filter("n_words >= 45").select("doc_id", F.explode(F.array(*[F.col("pos") + k for k in (-1, 0, 1)])).alias("pos")).distinct()
    return kept.join(near, ["doc_id", "pos"], "left_semi").select("doc_id", "pos")


def ask_signals(s, d):
    t = F.col("text")
    return read(s, d, "conversations").select("conv_id", "turn", T.n_words(t).alias("words"), (F.length(t) - F.length(F.replace(t, F.lit("?"), F.lit("")))).alias("questions"), F.size(F.split(t, "\n")).alias("lines"), F.contains(t, F.lit("@")).alias("addressed"))


TABLE: dict[str, Query] = {
    "sentence_split": _units,
    "dedup_keep_first": _kept,
    "junk_flags": lambda s, d: _units(s, d).select("doc_id", "pos", T.is_junk(F.col("unit")).alias("junk")),
    "filter_counts": lambda s, d: segment.filter_counts(_units(s, d)),
    "content_words": lambda s, d: _kws(s, d).groupBy("doc_id").agg(F.count("*").alias("n"), F.countDistinct("kw").alias("n_distinct")),
    "soft_stem": lambda s, d: _kws(s, d).select("kw").distinct().select("kw", T.soft_stem(F.col("kw")).alias("stem")),
    "norm_hash": lambda s, d: _docs(s, d).select("doc_id", T.norm_hash(F.col("text")).alias("hash")),
    "chat_clean": lambda s, d: read(s, d, "conversations").select("conv_id", "turn", "role", T.chat_clean(F.col("text")).alias("text")),
    "clean_markup": lambda s, d: read(s, d, "pages").select("page_id", T.clean_markup(F.col("html")).alias("text")),
    "dedup_key": lambda s, d: _docs(s, d).select("doc_id", T.dedup_key(F.col("text")).alias("key")),
    "normalize_answer": lambda s, d: read(s, d, "benchmark").select("item_id", T.normalize_answer(F.col("text")).alias("answer")),
    "length_reward": lambda s, d: _docs(s, d).select("doc_id", F.round(T.length_reward(T.n_words(F.col("text"))), 9).alias("reward")),
    "kw_df": lambda s, d: themes.keyword_df(_kws(s, d)),
    "theme_keywords": _themes,
    "trie_paths": lambda s, d: _paths(s, d).withColumn("path", F.array_join("path", ">")),
    "trie_nodes": lambda s, d: _nodes(s, d).select("doc_id", F.array_join("node", ">").alias("node"), "kw", "depth", "support", F.round("weight", 9).alias("weight")),
    "depth1_branches": lambda s, d: _nodes(s, d).filter("depth = 1").groupBy("doc_id").agg(F.count("*").alias("branches")),
    "doc_mass": lambda s, d: _nodes(s, d).groupBy("doc_id").agg(F.round(F.sum("weight"), 6).alias("mass")),
    "coverage_select": coverage_select,
    "fits_whole": lambda s, d: _kept(s, d).groupBy("doc_id").agg(F.sum("n_words").alias("n_words")).withColumn("fits", F.col("n_words") <= 100),
    "neighbor_expand": neighbor_expand,
    "memory_rows": _rows,
    "exact_dedupe": lambda s, d: session.exact_dedupe(_rows(s, d)).select("conv_id", "row_idx", "hash"),
    "eviction_mask": lambda s, d: session.eviction_mask(_rows(s, d), 20).select("conv_id", "row_idx", "alive"),
    "episodes": lambda s, d: session.episodes(read(s, d, "events"), "user_id", "ts", "event_id", 6 * 3600.0).select("event_id", "episode"),
    "conversation_sections": lambda s, d: session.sections(_rows(s, d)),
    "tail_anchor": lambda s, d: session.tail_anchor(_rows(s, d), 120).select("conv_id", "row_idx", "tail_words"),
    "struct_anchors": lambda s, d: session.struct_anchors(_rows(s, d), 150),
    "fused_short_turns": lambda s, d: session.fused_short_turns(read(s, d, "conversations")),
    "conversation_map": lambda s, d: session.conversation_map(_rows(s, d)),
    "kv_read_write": lambda s, d: session.read_write(_rows(s, d)),
    "snapshot_signals": lambda s, d: session.snapshot(_rows(s, d)),
    "coverage_decay": lambda s, d: session.decayed_coverage(_rows(s, d)),
    "cosine_topk": lambda s, d: vectors.topk(_vectors(s, d), _first_vector(s, d), 10),
    "branch_scores": lambda s, d: vectors.branch_scores(_vectors(s, d), _first_vector(s, d)),
    "scope_rule": lambda s, d: vectors.scope(vectors.branch_scores(_vectors(s, d), _first_vector(s, d))),
    "relevance_rescale": lambda s, d: vectors.rescaled_relevance(_vectors(s, d), _first_vector(s, d)),
    "near_dup_gate": lambda s, d: vectors.near_dup_gate(_vectors(s, d), 0.9),
    "token_f1": lambda s, d: scoring.token_f1(_pairs(s, d)),
    "verdict": lambda s, d: scoring.verdicts(_pairs(s, d)),
    "score_summary": lambda s, d: scoring.score_summary(_docs(s, d).join(read(s, d, "labels"), "doc_id").select(F.col("lang").alias("category"), F.col("quality").alias("correct"))),
    "category_fold": lambda s, d: scoring.category_fold(_docs(s, d).groupBy("source", F.col("lang").alias("category")).agg(F.avg("n_chars").alias("score"))),
    "comparison_pivot": lambda s, d: scoring.comparison(_docs(s, d).select(F.col("source").alias("dataset"), F.col("lang").alias("target"), F.col("n_chars").alias("score"))),
    "nearest_rank_p95": lambda s, d: scoring.nearest_rank(read(s, d, "events"), "event_type", "value"),
    "worker_rollup": worker_rollup,
    "ask_signals": ask_signals,
}


def queries() -> dict[str, Query]:
    from .further import TABLE as FURTHER
    from .more import TABLE as MORE
    from .wider import TABLE as WIDER

    return TABLE | MORE | FURTHER | WIDER


def oracle_sql() -> dict[str, str]:
    from .further import SQL as FURTHER
    from .oracle import SQL
    from .oracle_more import SQL as MORE
    from .wider import SQL as WIDER

    return SQL | MORE | FURTHER | WIDER
