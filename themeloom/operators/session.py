"""Conversation operators: windows and aggregates keyed by conversation."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T


def memory_rows(messages: DataFrame) -> DataFrame:
    """Sentences of user and assistant messages: conv_id, turn, role, row_idx, text, n_words. Other roles are kept out of memory."""
    said = messages.filter(F.col("role").isin("user", "assistant"))
    rows = said.select("conv_id", "turn", "role", F.posexplode(T.sentence_parts(F.coalesce("text", F.lit("")))).alias("i", "text"))
    order = Window.partitionBy("conv_id").orderBy("turn", "role", "i")
    return rows.select("conv_id", "turn", "role", (F.row_number().over(order) - 1).cast("int").alias("row_idx"), "text", T.n_words(F.col("text")).alias("n_words"))


def exact_dedupe(rows: DataFrame) -> DataFrame:
    """The first row of each normalised hash in its conversation."""
    first = Window.partitionBy("conv_id", "hash").orderBy("row_idx")
    return rows.withColumn("hash", T.norm_hash(F.col("text"))).withColumn("_n", F.row_number().over(first)).filter("_n = 1").drop("_n")


def eviction_mask(rows: DataFrame, cap: int) -> DataFrame:
    """alive: among the newest cap rows of the conversation."""
    newest = Window.partitionBy("conv_id").orderBy(F.desc("row_idx"))
    return rows.withColumn("alive", F.row_number().over(newest) <= cap)


def episodes(rows: DataFrame, key: str, at: str, order: str, gap_s: float) -> DataFrame:
    """Running number of gaps over gap_s seconds since the last known time, in arrival order."""
    line = Window.partitionBy(key).orderBy(order)
    seconds = F.unix_micros(F.col(at).cast("timestamp")) / 1e6
    last = F.last(F.when(F.col(at).isNotNull(), seconds), True).over(line.rowsBetween(Window.unboundedPreceding, -1))
    return rows.withColumn("episode", F.sum(F.when(seconds - last > gap_s, 1).otherwise(0)).over(line.rowsBetween(Window.unboundedPreceding, 0)))


def sections(rows: DataFrame) -> DataFrame:
    """Runs of rows of one turn and role: conv_id, section, turn, role, text."""
    line = Window.partitionBy("conv_id").orderBy("row_idx")
    new = (F.lag("turn").over(line).eqNullSafe(F.col("turn")) & F.lag("role").over(line).eqNullSafe(F.col("role"))).cast("int")
    marked = rows.withColumn("section", F.sum(1 - new).over(line.rowsBetween(Window.unboundedPreceding, 0)))
    grouped = marked.groupBy("conv_id", "section").agg(F.first("turn").alias("turn"), F.first("role").alias("role"), F.sort_array(F.collect_list(F.struct("row_idx", "text"))).alias("held"))
    return grouped.select("conv_id", "section", "turn", "role", F.array_join(F.transform("held", lambda x: x["text"]), " ").alias("text"))


def tail_anchor(rows: DataFrame, cap: int) -> DataFrame:
    """Rows of the suffix whose words stay within cap."""
    back = Window.partitionBy("conv_id").orderBy(F.desc("row_idx")).rowsBetween(Window.unboundedPreceding, 0)
    return rows.withColumn("tail_words", F.sum("n_words").over(back)).filter(F.col("tail_words") <= cap)


def struct_anchors(rows: DataFrame, cap: int) -> DataFrame:
    """First-fit in order: rows over what is left are skipped and later ones still taken."""
    held = rows.groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("row_idx", "n_words"))).alias("rows"))
    fold = f"aggregate(rows, named_struct('used', 0L, 'n', 0L), (a, x) -> if(a.used + x.n_words <= {cap}, named_struct('used', a.used + x.n_words, 'n', a.n + 1L), a))"
    return held.select("conv_id", F.expr(fold).alias("a")).select("conv_id", F.col("a.used").alias("words_used"), F.col("a.n").alias("n_taken"))


def fused_short_turns(messages: DataFrame) -> DataFrame:
    """Short user turns with the end of what they answer."""
    line = Window.partitionBy("conv_id").orderBy("turn")
    before = F.lag("text").over(line)
    short = (F.col("role") == "user") & (T.n_words(F.col("text")) <= 8) & before.isNotNull()
    fused = F.concat(F.trim("text"), F.lit('  [in reply to: "…'), F.expr("right(trim(_before), 120)"), F.lit('"]'))
    return messages.withColumn("_before", before).withColumn("fused", F.when(short, fused).otherwise(F.col("text"))).select("conv_id", "turn", "fused")


def conversation_map(rows: DataFrame, per_turn: int = 3, turns: int = 20) -> DataFrame:
    """The best words of each of the last turns by weight times the root of the row's length."""
    weight = F.sqrt(F.col("n_words").cast("double"))
    words = rows.select("conv_id", "turn", weight.alias("w"), F.explode(T.content_words(F.col("text"))).alias("kw"))
    best = words.groupBy("conv_id", "turn", "kw").agg(F.max("w").alias("score"))
    top = best.withColumn("_n", F.row_number().over(Window.partitionBy("conv_id", "turn").orderBy(F.desc("score"), "kw"))).filter(F.col("_n") <= per_turn)
    line = top.groupBy("conv_id", "turn").agg(F.sort_array(F.collect_list(F.struct("_n", "kw"))).alias("t"))
    line = line.withColumn("_r", F.row_number().over(Window.partitionBy("conv_id").orderBy(F.desc("turn")))).filter(F.col("_r") <= turns)
    return line.select("conv_id", "turn", F.array_join(F.transform("t", lambda x: x["kw"]), ", ").alias("words"))


def read_write(rows: DataFrame) -> DataFrame:
    """Per turn, words shared with the previous turn (read) and new ones (write)."""
    words = rows.select("conv_id", "turn", F.explode(T.content_words(F.col("text"))).alias("kw")).groupBy("conv_id", "turn").agg(F.collect_set("kw").alias("own"))
    before = F.coalesce(F.lag("own").over(Window.partitionBy("conv_id").orderBy("turn")), F.array().cast("array<string>"))
    out = words.withColumn("before", before)
    return out.select("conv_id", "turn", F.size(F.array_intersect("own", "before")).alias("n_read"), F.size(F.array_except("own", "before")).alias("n_write"))


def snapshot(rows: DataFrame) -> DataFrame:
    """Signals of each conversation; shares are null where the whole is 0."""
    user = F.sum(F.when(F.col("role") == "user", F.col("n_words")).otherwise(0))
    total = F.sum("n_words")
    return rows.groupBy("conv_id").agg(
        F.count("*").alias("n_rows"), F.countDistinct("turn").alias("n_turns"), total.alias("n_words"), F.round(F.when(total > 0, user / total), 6).alias("user_share"), F.max("turn").alias("last_turn")
    )


def decayed_coverage(rows: DataFrame, half_life: float = 4.0, floor: float = 0.05) -> DataFrame:
    """Keyword coverage: one for each turn that says it, halved every half_life turns; under floor it is let go."""
    last = F.max("turn").over(Window.partitionBy("conv_id"))
    words = rows.withColumn("_last", last).select("conv_id", "turn", "_last", F.explode(T.content_words(F.col("text"))).alias("kw")).distinct()
    cover = words.groupBy("conv_id", "kw").agg(F.sum(F.pow(F.lit(0.5), (F.col("_last") - F.col("turn")) / F.lit(half_life))).alias("coverage"))
    return cover.filter(F.col("coverage") >= floor).select("conv_id", "kw", F.round("coverage", 6).alias("coverage"))
