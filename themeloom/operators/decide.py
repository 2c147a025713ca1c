"""What a turn decides before it selects: its mode's settings, a summary, a scope, a window, a search."""

from __future__ import annotations

from itertools import chain

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import chat as C

# Settings of all modes, and what each mode sets beyond or instead.
SETTINGS = {"lam": 0.5, "query_mass": 1.0, "theme_percentile": 0.9}
MODE_SETTINGS = {
    "synthetic": {"theme_percentile": 0.75, "sig_words": 12, "count_min_prefix": 8},
    "code": {"theme_percentile": 0.5, "code_struct_frac": 0.10},
}
# Why a turn is a summary, and the settings of such a turn.
MARKED, WORDED = "marked by /summary", "the question asks for a summary"
SUMMARY_SETTINGS = {"themes": 0.6, "lam": 0.3}
# The probability from which a search is left out, and why one cannot be.
SKIP_FROM, NO_SCORING = 0.999, "no scoring"


def settings(mode: str | None = None, **given) -> dict:
    """What was given, else what the mode sets, else what all modes share. Nulls are not given."""
    if mode is not None and mode not in MODE_SETTINGS:
        raise ValueError(f"no such mode: {mode}")
    return SETTINGS | MODE_SETTINGS.get(mode, {}) | {k: v for k, v in given.items() if v is not None}


def mode_of(synthetic: Column, code: Column) -> Column:
    """synthetic before code; null for neither."""
    return F.when(synthetic, "synthetic").when(code, "code")


def setting(mode: Column, name: str) -> Column:
    """One setting for each row's mode."""
    table = F.create_map(*[F.lit(x) for x in chain.from_iterable((m, float(settings(m)[name])) for m in MODE_SETTINGS if name in settings(m))])
    return F.coalesce(F.element_at(table, mode), F.lit(SETTINGS.get(name)))


def summary(mode: Column, line: Column, marked: Column) -> Column:
    """Why a turn is a summary: marked by hand in any mode, or by its wording under auto; null if it is none."""
    return F.when(marked, MARKED).when((mode == "auto") & C.summary_ask(line), WORDED)


def scope(mode: Column, ruled: Column, named: Column) -> Column:
    """Sources that a turn searches: those of the rule under auto, the conversation and the named ones under named; null (all) otherwise."""
    own = F.array(F.lit(None).cast("string"))
    return F.when(mode == "named", F.array_union(own, F.coalesce(named, F.array().cast("array<string>")))).when(mode == "auto", ruled)


def gate(mode: Column, p_skip: Column) -> Column:
    """mode, fired, error of one turn under auto: a search is left out from SKIP_FROM on; without a probability it is made. Null under any other mode."""
    said = p_skip.isNotNull()
    return F.when(mode == "auto", F.struct(F.when(said, mode).otherwise("unavailable").alias("mode"), F.coalesce(p_skip >= SKIP_FROM, F.lit(False)).alias("fired"), F.when(~said, NO_SCORING).alias("error")))


def dated(start: Column, end: Column) -> Column:
    """[start, end) in words: a day, a month, a year, or a span without what its ends share."""
    last = F.date_sub(end.cast("date"), 1)
    first = start.cast("date")
    say = lambda d, form: F.date_format(d, form)
    to = lambda form: F.concat(say(first, form), F.lit(" to "), say(last, "d MMMM y"))
    whole_months = (F.dayofmonth(first) == 1) & (last == F.last_day(last))
    one_year, one_month = F.year(first) == F.year(last), F.trunc(first, "month") == F.trunc(last, "month")
    whole_year = whole_months & one_year & (F.month(first) == 1) & (F.month(last) == 12)
    return F.when(first == last, say(first, "d MMMM y")).when(whole_months & one_month, say(first, "MMMM y")).when(whole_year, say(first, "y")).when(one_month, to("d")).when(one_year, to("d MMMM")).otherwise(to("d MMMM y"))


def windowed(rows: DataFrame, tried: DataFrame, key: str, at: str) -> DataFrame:
    """The window that each key's turn takes: the first tried (key, nth, start, end) with rows inside, else the first without effect.

    rows with a null time or a source of their own are no reason for a window and are not held out.
    Gives key, start, end, label, rows_in, rows_out, applied. A key's tries are few (its years), so the
    range condition is checked for each row and try of its own key only, and counted before the choice.
    """
    own = rows.filter(F.col("source").isNull() & F.col(at).isNotNull()).groupBy(key, at).agg(F.count("*").alias("_n"))
    inside = (F.col(at) >= F.col("start")) & (F.col(at) < F.col("end"))
    counted = tried.join(own, key, "left").groupBy(key, "nth", "start", "end").agg(F.coalesce(F.sum(F.when(inside, F.col("_n"))), F.lit(0)).alias("rows_in"), F.coalesce(F.sum("_n"), F.lit(0)).alias("_all"))
    order = Window.partitionBy(key).orderBy(F.desc(F.col("rows_in") > 0), "nth")
    first = counted.withColumn("_r", F.row_number().over(order)).filter("_r = 1")
    applied = F.col("rows_in") > 0
    return first.select(key, "start", "end", dated(F.col("start"), F.col("end")).alias("label"), "rows_in", F.when(applied, F.col("_all") - F.col("rows_in")).otherwise(0).alias("rows_out"), applied.alias("applied"))


def fitted(sections: DataFrame, key: str, order: str, cap: int | Column) -> DataFrame:
    """Whole sections from the first on until one does not fit; it and all after it go. sections: key, order, n_words."""
    so_far = Window.partitionBy(key).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    return sections.withColumn("_w", F.sum("n_words").over(so_far)).filter(F.col("_w") <= cap).drop("_w")
