"""Roll-ups and checks over ledgers of runs: usage, calls, rounds, scores, censuses, comparisons, resuming."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Rows of a roster or persona table, which people write by hand.
MOST_PERSONAS = 10_000


def usage_totals(rows: DataFrame, keys: list[str], kind: str = "kind", tokens: str = "tokens") -> DataFrame:
    """Per key: read, write and output tokens and their sum, in one pass."""
    of = lambda k: F.sum(F.when(F.col(kind) == k, F.col(tokens)).otherwise(0))
    return rows.groupBy(*keys).agg(of("read").alias("input_cached"), of("write").alias("input"), of("output").alias("output"), F.sum(F.when(F.col(kind).isin("read", "write", "output"), F.col(tokens)).otherwise(0)).alias("total"))


def call_cost(calls: DataFrame, keys: list[str], prompt: str = "prompt_tokens", cached: str = "cached_tokens") -> DataFrame:
    """Per key: calls that were measured at all, and their tokens. A sum over nothing measured is null, not 0; keys without a measured call have no row."""
    seen = calls.filter(F.col(prompt).isNotNull() | F.col(cached).isNotNull())
    return seen.groupBy(*keys).agg(F.count("*").alias("calls"), F.sum(prompt).alias("prompt_tokens"), F.sum(cached).alias("cached_tokens"))


def trace_rollup(rounds: DataFrame, keys: list[str]) -> DataFrame:
    """From rounds with pieces (array of ran, status), protocol_failures, answered_directly and seconds: one row a key."""
    ran = F.filter("pieces", lambda p: F.coalesce(p["ran"], F.lit(False)))
    bad = F.filter(ran, lambda p: ~p["status"].eqNullSafe(F.lit("ok")))
    size = lambda a: F.sum(F.greatest(F.size(a), F.lit(0)))
    return rounds.groupBy(*keys).agg(
        F.count("*").alias("turns"), size(F.col("pieces")).alias("pieces"), size(ran).alias("delegated"), size(bad).alias("failed"), F.sum(F.coalesce("protocol_failures", F.lit(0))).alias("protocol_failures"),
        F.count_if("answered_directly").alias("direct"), F.round(F.sum(F.greatest(F.coalesce("seconds", F.lit(0.0)), F.lit(0.0))), 6).alias("seconds"),
    )


def stop_reasons(calls: DataFrame, key: str, order: str, most_calls: int, most_tokens: int, most_seconds: float) -> DataFrame:
    """Adds stop: the ceiling that a round has reached before each call (interrupted, delegations, tokens, wall), or null."""
    before = Window.partitionBy(key).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    so_far = lambda c: F.coalesce(F.sum(c).over(before), F.lit(0))
    ran = F.col("ran").cast("int")
    interrupted = so_far(F.when(F.col("ran") & (F.col("status") == "aborted"), 1).otherwise(0)) > 0
    why = F.when(interrupted, "interrupted").when(so_far(ran) >= most_calls, "delegations").when(so_far(F.when(F.col("ran"), F.col("tokens")).otherwise(0)) >= most_tokens, "tokens").when(so_far(F.col("seconds")) >= most_seconds, "wall")
    return calls.withColumn("stop", why)


def eval_score(scored: DataFrame, keys: list[str], score: str = "score") -> DataFrame:
    """Per key: mean score times 100, samples and zeros."""
    return scored.groupBy(*keys).agg(F.round(100 * F.avg(score), 2).alias("score"), F.count("*").alias("n_samples"), F.count_if(F.col(score) == 0).alias("n_zero"))


def headline(values: DataFrame, key: str, col: str) -> DataFrame:
    """Per key: mean, median, 95th percentile between neighbours, and the largest."""
    at = lambda share: F.round(F.percentile(col, F.lit(share)), 6)
    return values.groupBy(key).agg(F.round(F.avg(col), 6).alias("mean"), at(0.5).alias("median"), at(0.95).alias("p95"), F.round(F.max(col), 6).alias("max"))


def census(decided: DataFrame, outcome: str, keys: list[str]) -> DataFrame:
    """Turns by what was decided for them."""
    return decided.groupBy(*keys, F.coalesce(outcome, F.lit("none")).alias("outcome")).agg(F.count("*").alias("turns"))


def compression_summary(samples: DataFrame, keys: list[str]) -> DataFrame:
    """From raw_words, kept_words, budget and anchored: words, their ratio, mean use of the budget, anchored samples."""
    used = F.when(F.col("budget") > 0, F.col("kept_words") / F.col("budget"))
    return samples.groupBy(*keys).agg(
        F.count("*").alias("samples"), F.sum("raw_words").alias("raw_words"), F.sum("kept_words").alias("kept_words"), F.round(F.sum("kept_words") / F.sum("raw_words"), 6).alias("ratio"),
        F.round(F.avg(used), 6).alias("utilization"), F.count_if(F.col("anchored") > 0).alias("anchored"),
    )


def run_comparison(base: DataFrame, new: DataFrame, keys: list[str], col: str) -> DataFrame:
    """Keys whose value differs between two runs, or that one of them lacks."""
    a = base.select(*keys, F.col(col).alias("base"), F.lit(True).alias("_in_base"))
    b = new.select(*keys, F.col(col).alias("new"), F.lit(True).alias("_in_new"))
    both = a.join(b, keys, "full_outer")
    what = F.when(F.col("_in_new").isNull(), "gone").when(F.col("_in_base").isNull(), "added").when(~F.col("base").eqNullSafe(F.col("new")), "changed")
    return both.select(*keys, "base", "new", what.alias("change")).filter("change is not null")


def unanswered(items: DataFrame, answers: DataFrame, keys: list[str]) -> DataFrame:
    """What a resumed run still has to ask: items without an answer, equal items once."""
    return items.dropDuplicates(keys).join(answers.select(*keys).distinct(), keys, "left_anti")


def bound_personas(personas: DataFrame, roster: DataFrame, chat: str = "chat") -> DataFrame:
    """name, worker, problem: each persona and why it cannot be bound, null if it can."""
    entries = roster.select(F.col("name").alias("worker"), "role").limit(MOST_PERSONAS)
    names = personas.select(F.col("name").alias("worker"), F.lit(True).alias("is_persona")).distinct().limit(MOST_PERSONAS)
    taken = roster.select("name", F.lit(True).alias("taken")).distinct().limit(MOST_PERSONAS)
    found = personas.join(F.broadcast(taken), "name", "left").join(F.broadcast(names), "worker", "left").join(F.broadcast(entries), "worker", "left")
    riding = F.col("worker") != chat
    why = F.when(F.col("taken"), "name of a roster entry").when(riding & F.col("is_persona"), "rides a persona").when(riding & F.col("role").isNull(), "no such worker").when(riding & (F.col("role") != "worker"), "rides no worker")
    return found.select("name", "worker", why.alias("problem"))


def freshness(selected: DataFrame, keys: list[str], turn: str = "turn") -> DataFrame:
    """Per key the turn that last raised it."""
    return selected.groupBy(*keys).agg(F.max(turn).alias("last_turn"))


def sliding(events: DataFrame, ts: str, width: str, step: str) -> DataFrame:
    """Events in overlapping windows; works on streams too, after a watermark."""
    return events.groupBy(F.window(ts, width, step).alias("w")).agg(F.count("*").alias("n")).select(F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n")


def skip_share(tokens: Column) -> Column:
    """Of the likeliest tokens (array of token, logprob): the mass of yes against no, 0 without either. A token counts once."""
    once = F.filter(tokens, lambda t, i: t["token"].isNotNull() & t["logprob"].isNotNull() & (F.array_position(F.transform(tokens, lambda x: x["token"]), t["token"]) == i + 1))
    mass = lambda word: F.aggregate(F.filter(once, lambda t: F.lower(F.regexp_replace(t["token"], r"[^A-Za-z]", "")) == word), F.lit(0.0), lambda s, t: s + F.exp(t["logprob"].cast("double")))
    return F.when(mass("yes") + mass("no") > 0, mass("yes") / (mass("yes") + mass("no"))).otherwise(0.0)
