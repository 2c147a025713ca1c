"""Answer scoring and run summaries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import chat as C
from ..functions import text as T


def token_f1(pairs: DataFrame) -> DataFrame:
    """From id, prediction, answer: multiset F1 of normalised words."""
    words = lambda c: T.answer_words(F.col(c))
    p = pairs.select("id", F.explode(words("prediction")).alias("w")).groupBy("id", "w").agg(F.count("*").alias("n_p"))
    a = pairs.select("id", F.explode(words("answer")).alias("w")).groupBy("id", "w").agg(F.count("*").alias("n_a"))
    both = p.join(a, ["id", "w"]).groupBy("id").agg(F.sum(F.least("n_p", "n_a")).alias("same"))
    sizes = pairs.select("id", F.size(words("prediction")).alias("n_p"), F.size(words("answer")).alias("n_a"))
    f1 = F.when(F.col("same") > 0, 2.0 * F.col("same") / (F.col("n_p") + F.col("n_a"))).otherwise(0.0)
    return sizes.join(both, "id", "left").select("id", F.round(f1, 6).alias("f1"))


def verdicts(pairs: DataFrame) -> DataFrame:
    """exact, contains or none of the normalised texts."""
    p, a = T.normalize_answer(F.col("prediction")), T.normalize_answer(F.col("answer"))
    held = F.contains(F.concat(F.lit(" "), p, F.lit(" ")), F.concat(F.lit(" "), a, F.lit(" ")))
    return pairs.select("id", F.when(p == a, "exact").when((a != "") & held, "contains").otherwise("none").alias("verdict"))


def matches(pairs: DataFrame) -> DataFrame:
    """From id, prediction, answers (array): the strictest rule by which a reference matches, and the best F1.

    exact: the same scoring form; final: that of the last line; contains: the reference's words in a
    row; else none. A missing prediction or no reference gives none and 0.
    """
    spaced = lambda c: F.concat(F.lit(" "), c, F.lit(" "))
    refs = F.filter(F.transform(F.coalesce("answers", F.array().cast("array<string>")), lambda r: F.trim(r)), lambda r: r.isNotNull() & (r != ""))
    whole, last = C.scoring_form(F.col("prediction")), C.scoring_form(C.final_line(F.col("prediction")))
    held = pairs.select("id", whole.alias("whole"), last.alias("last"), F.transform(refs, C.scoring_form).alias("forms"))
    named = F.filter("forms", lambda r: r != "")
    rule = F.when(F.exists(named, lambda r: r == F.col("whole")), "exact").when(F.exists(named, lambda r: r == F.col("last")), "final").when(F.exists(named, lambda r: F.contains(spaced(F.col("whole")), spaced(r))), "contains")
    split = lambda c: F.filter(F.split(c, " "), lambda w: w != "")

    def f1(ref: Column) -> Column:
        p, g = split(F.col("whole")), split(ref)
        count = lambda a, w: F.size(F.filter(a, lambda x: x == w))
        same = F.aggregate(F.array_intersect(p, g), F.lit(0), lambda n, w: n + F.least(count(p, w), count(g, w)))
        return F.when((F.size(p) == 0) | (F.size(g) == 0), (F.size(p) == F.size(g)).cast("double")).when(same == 0, 0.0).otherwise(2.0 * same / (F.size(p) + F.size(g)))

    best = F.coalesce(F.round(F.array_max(F.transform("forms", f1)), 4), F.lit(0.0))
    return held.select("id", F.coalesce(rule, F.lit("none")).alias("match"), F.when(F.col("whole").isNull(), 0.0).otherwise(best).alias("f1"))


def score_summary(scored: DataFrame) -> DataFrame:
    """Totals and a row for each category, in one pass over grouping sets."""
    return scored.rollup("category").agg(F.grouping("category").alias("is_total"), F.count("*").alias("n"), F.sum("correct").alias("n_correct")).select("category", F.col("is_total").cast("int").alias("is_total"), "n", "n_correct")


def category_fold(tasks: DataFrame) -> DataFrame:
    """Category means, and the mean over tasks as 'all'."""
    by = tasks.groupBy("category").agg(F.round(F.avg("score"), 6).alias("score"))
    return by.unionByName(tasks.agg(F.lit("all").alias("category"), F.round(F.avg("score"), 6).alias("score")))


#: Targets that a table can have as columns.
TARGETS = 1000


def comparison(scores: DataFrame) -> DataFrame:
    """dataset by target, with the best target (the first of equals); null targets are 'null'."""
    scores = scores.withColumn("target", F.coalesce("target", F.lit("null")))
    targets = sorted(r["target"] for r in scores.select("target").distinct().limit(TARGETS + 1).collect())
    if len(targets) > TARGETS:
        raise ValueError(f"over {TARGETS} targets")
    wide = scores.groupBy("dataset").pivot("target", targets).agg(F.round(F.max("score"), 6))
    score = {t: F.col("`" + t.replace("`", "``") + "`") for t in targets}
    best = F.array_max(F.array(*score.values()))
    named = F.coalesce(*[F.when(c == best, F.lit(t)) for t, c in score.items()], F.lit(None).cast("string"))
    return wide.withColumn("best", named)


def nearest_rank(values: DataFrame, key: str, col: str, share: float = 0.95) -> DataFrame:
    """Per key: n, mean, and the value at round(share * (n - 1)) of the sorted ones, halves to even."""
    by = Window.partitionBy(key)
    ranked = values.filter(F.col(col).isNotNull()).withColumn("_i", F.row_number().over(by.orderBy(col)) - 1).withColumn("_n", F.count("*").over(by))
    at = F.bround(F.lit(share) * (F.col("_n") - 1), 0).cast("int")
    return ranked.groupBy(key).agg(F.first("_n").alias("n"), F.round(F.avg(col), 6).alias("mean"), F.round(F.max(F.when(F.col("_i") == at, F.col(col))), 6).alias("p95"))


def worker_rollup(calls: DataFrame) -> DataFrame:
    """From target, id, status, t_start, t_end, tokens: calls, ok, tokens, seconds and the last status."""
    return calls.groupBy("target").agg(
        F.count("*").alias("calls"), F.count_if(F.col("status") == "ok").alias("ok"), F.sum("tokens").alias("tokens"), F.round(F.sum(F.greatest(F.col("t_end") - F.col("t_start"), F.lit(0.0))), 6).alias("seconds"), F.max_by("status", "id").alias("last_status")
    )
