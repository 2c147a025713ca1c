"""Exemplar blocks and enumerated paragraphs: detection, blocks, evenly spaced choice."""

from __future__ import annotations

import math
import re
from collections.abc import Callable
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T
from . import whole

# Name, what opens a block, what labels it, least pairs; tried in this order.
PATTERNS = (("question_type", "Question:", "Type:", 5), ("dialogue_summary", "Dialogue:", "Summary:", 3), ("numbered_paragraphs", "Paragraph ", "Paragraph ", 10), ("passage_qa", "Passage:", "Answer:", 3))
RATIO = 3.0


def occurrences(text: Column, mark: str) -> Column:
    return ((F.length(text) - F.length(F.replace(text, F.lit(mark), F.lit("")))) / len(mark)).cast("int")


def blocks(text: Column, mark: str) -> Column:
    """What follows each mark, with it; text before the first is no block."""
    parts = F.split(text, mark)
    held = F.transform(F.slice(parts, 2, F.greatest(F.size(parts) - 1, F.lit(0))), lambda p: F.trim(F.concat(F.lit(mark), p), F.lit(" \t\r\n")))
    return F.filter(held, lambda b: b != mark.strip())


def detect(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, pattern ('none' if no pattern fits), blocks."""
    text = F.coalesce(text_col, F.lit(""))

    def fits(mark: str, label: str, least: int) -> Column:
        a, b = occurrences(text, mark), occurrences(text, label)
        labelled = F.size(F.filter(blocks(text, mark), lambda x: F.contains(x, F.lit(label))))
        return (a >= least) & (b >= least) & (F.greatest(a, b) <= RATIO * F.least(a, b)) & (labelled >= least)

    name = reduce(lambda c, p: c.when(fits(*p[1:]), p[0]), PATTERNS[1:], F.when(fits(*PATTERNS[0][1:]), PATTERNS[0][0])).otherwise("none")
    out = docs.select(F.col(id_col).alias("doc_id"), name.alias("pattern"), text.alias("_t"))
    cut = reduce(lambda c, p: c.when(F.col("pattern") == p[0], blocks(F.col("_t"), p[1])), PATTERNS[1:], F.when(F.col("pattern") == PATTERNS[0][0], blocks(F.col("_t"), PATTERNS[0][1])))
    return out.select("doc_id", "pattern", F.coalesce(cut, F.array().cast("array<string>")).alias("blocks"))


def even_choice(sizes: list[int], budget: int) -> list[int]:
    """Blocks at even strides that fit, then any others that fit, in the order in which they are taken."""
    n, total = len(sizes), sum(sizes)
    if not n:
        return []
    stride = max(1.0, n / max(1, int(budget * n / total))) if total else 1.0
    spaced = [int(i * stride) for i in range(n) if int(i * stride) < n]
    order = dict.fromkeys([*spaced, *range(n)])
    took, left = [], budget
    for i in order:
        if sizes[i] <= left:
            took.append(i)
            left -= sizes[i]
    return took


def _choose(share: float):
    def chosen(sizes: pd.Series) -> pd.Series:
        return sizes.map(lambda s: even_choice([int(x) for x in s], int(sum(int(x) for x in s) * share)))

    return F.pandas_udf(chosen, "array<int>")


def compress(found: DataFrame, share: float = 0.2) -> DataFrame:
    """doc_id, pattern, n_blocks, n_kept, words_used, context of documents with a pattern: whole blocks, in the order taken."""
    sized = found.filter("pattern != 'none'").withColumn("sizes", F.transform("blocks", T.n_words)).withColumn("took", _choose(share)("sizes"))
    pick = lambda c: F.transform("took", lambda i: F.get(F.col(c), i))
    return sized.select("doc_id", "pattern", F.size("blocks").alias("n_blocks"), F.size("took").alias("n_kept"), F.aggregate(pick("sizes"), F.lit(0), lambda a, x: a + x).alias("words_used"), F.array_join(pick("blocks"), "\n\n").alias("context"))


def paragraphs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, unit, label, body, n_words: a heading 'Paragraph N:' opens a unit and lines after it belong to it; lines before the first are dropped."""
    rows = docs.select(F.col(id_col).alias("doc_id"), F.posexplode(F.split(F.coalesce(text_col, F.lit("")), "\n")).alias("pos", "line")).filter(F.trim("line") != "")
    head = r"(?i)^\s*Paragraph\s+(\d+):\s*(.*)$"
    opens = F.col("line").rlike(head)
    running = Window.partitionBy("doc_id").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumn("unit", F.sum(opens.cast("int")).over(running) - 1).filter("unit >= 0")
    rows = rows.withColumn("label", F.when(opens, F.regexp_extract("line", head, 1).cast("long"))).withColumn("part", F.trim(F.when(opens, F.regexp_extract("line", head, 2)).otherwise(F.col("line"))))
    body = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("pos", "part"))), lambda x: x["part"]), " ")
    out = rows.groupBy("doc_id", "unit").agg(F.max("label").alias("label"), body.alias("body"))
    return out.withColumn("n_words", T.n_words(F.col("body")))


def count_prefixes(units: DataFrame, share: float = 0.2, least: int = 8) -> DataFrame:
    """Per document: every unit's heading and the same number of first words, so equal units stay equal."""
    held = units.groupBy("doc_id").agg(F.sort_array(F.collect_list(F.struct("unit", "label", "body"))).alias("u"), F.floor(F.sum("n_words") * F.lit(share)).cast("long").alias("budget"))
    k = F.greatest(F.lit(least), F.floor(F.col("budget") / F.size("u")).cast("int") - 2)
    words = lambda b: F.filter(F.split(b, r"[ \t\r\n]+"), lambda w: w != "")
    made = F.transform("u", lambda x: F.concat(F.lit("Paragraph "), x["label"].cast("string"), F.lit(": "), F.array_join(F.slice(words(x["body"]), F.lit(1), F.col("k")), " ")))
    return held.withColumn("k", k.cast("int")).select("doc_id", F.size("u").alias("n_units"), "k", F.array_join(made, "\n\n").alias("context"))


def _paragraph(label: Column, body: Column) -> Column:
    return F.concat(F.lit("Paragraph "), label.cast("string"), F.lit(": "), body)


def signatures(units: DataFrame, share: float = 0.2, sig_words: int = 12, rest: float | None = None) -> DataFrame:
    """Units of ``paragraphs`` as what retrieval chooses from: each is shown by its first words at least, and can be bought whole.

    Adds signature, whole, sig_cost, cost (words that the whole unit takes beyond its signature, one at
    least) and budget (share of the document's words that is left when all signatures are shown; or rest
    of what all units cost, where rest is given).
    """
    doc = Window.partitionBy("doc_id")
    words = F.filter(F.split("body", r"[ \t\r\n]+"), lambda w: w != "")
    head = F.array_join(F.slice(words, 1, sig_words), " ")
    out = units.withColumn("sig_cost", F.least(F.size(words), F.lit(sig_words)) + 2)
    out = out.withColumn("signature", _paragraph(F.col("label"), F.concat(head, F.when(F.size(words) > sig_words, " ...").otherwise(""))))
    out = out.withColumn("whole", _paragraph(F.col("label"), F.col("body"))).withColumn("cost", F.greatest(F.lit(1), F.col("n_words") + 2 - F.col("sig_cost")))
    left = F.floor(F.sum("n_words").over(doc) * F.lit(share)) - F.sum("sig_cost").over(doc) if rest is None else F.floor(F.sum("cost").over(doc) * F.lit(rest))
    return out.withColumn("budget", F.greatest(F.lit(0), left).cast("long"))


def shown(signed: DataFrame, chosen: DataFrame) -> DataFrame:
    """Per document: every unit in order, whole where chosen (doc_id, unit) and as its signature elsewhere."""
    marked = signed.join(chosen.select("doc_id", "unit", F.lit(True).alias("_whole")).distinct(), ["doc_id", "unit"], "left")
    text = F.when(F.col("_whole"), F.col("whole")).otherwise(F.col("signature"))
    spent = F.col("sig_cost") + F.when(F.col("_whole"), F.col("cost")).otherwise(0)
    held = F.sort_array(F.collect_list(F.struct("unit", text.alias("text"))))
    return marked.groupBy("doc_id").agg(F.count("*").alias("n_units"), F.count("_whole").alias("n_full_units"), F.sum(spent).alias("words_used"), F.array_join(F.transform(held, lambda x: x["text"]), "\n\n").alias("context"))


HEADING = re.compile(whole.java(r"^\s*Paragraph\s+(\d+):\s*(.*)") + r"(?=(?:\r\n|[\r\x85\u2028\u2029])?\Z)", re.IGNORECASE | re.ASCII)


def paragraphs_of(text: str | None) -> list[tuple[int, str]]:
    """label and body of the units of ``paragraphs``."""
    units: list[tuple[int, list[str]]] = []
    for line in (text or "").split("\n"):
        if not (bare := line.strip(" ")):
            continue
        if head := HEADING.match(line):
            units.append((int(head[1]), [head[2].strip(" ")]))
        elif units:
            units[-1][1].append(bare)
    return [(label, " ".join(parts)) for label, parts in units]


RETRIEVED = "doc_id long, n_units long, n_full_units long, words_used long, context string"


def retrieved(docs: DataFrame, share: float = 0.2, sig_words: int = 12, percentile: float = 0.75, rest: float | None = None, numbered: Callable[[str | None], str] | None = None) -> DataFrame:
    """``retrieve`` of documents that have their terms and stems (null without a question) beside them: read whole, one pass, no shuffle.

    Signatures of short units can cost more than share of a document's words, which leaves nothing to
    choose; rest, if given, stands for share: that part of what all units cost beyond their signatures.
    numbered, if given, makes the enumerated paragraphs of a text first.
    """
    from . import select

    def one(doc_id, text, terms, stems):
        units = paragraphs_of(text if numbered is None else numbered(text))
        if not units:
            return []
        low = [whole.words_of(body.lower()) for _, body in units]
        n_words = [len(own) for own in low]
        sig_costs = [min(n, sig_words) + 2 for n in n_words]
        costs = [max(1, n + 2 - c) for n, c in zip(n_words, sig_costs, strict=True)]
        budget = max(0, math.floor(sum(n_words) * share) - sum(sig_costs)) if rest is None else math.floor(sum(costs) * rest)
        took = set()
        if budget:  # no unit costs less than a word
            kws = [whole.content_words(own) for own in low]
            found = whole.profile(kws, percentile).themes
            asked = select.Asked(terms or [], stems or [], None)
            spoken = [["paragraph", f"{label}:", *own] for (label, _), own in zip(units, low, strict=True)] if asked.terms else [[]] * len(units)
            made = whole.trie(whole.paths(kws, found))
            took = set(select.chosen(costs, budget, made.covers, made.weights, [0.0] * len(made.weights), select.held_terms(spoken, asked), asked)[0].rows)
        texts = []
        for i, (label, body) in enumerate(units):
            if i not in took:
                body = " ".join(whole.words_of(body)[:sig_words]) + (" ..." if n_words[i] > sig_words else "")
            texts.append(f"Paragraph {label}: {body}")
        return [(doc_id, len(units), len(took), sum(sig_costs) + sum(costs[i] for i in took), "\n\n".join(texts))]

    return whole.each(docs, ["doc_id", "text", "terms", "stems"], one, RETRIEVED)


def retrieve(docs: DataFrame, questions: DataFrame, share: float = 0.2, sig_words: int = 12, percentile: float = 0.75) -> DataFrame:
    """Documents of enumerated paragraphs for a question (doc_id, question): the selector buys whole units, all others stay as signatures.

    Documents without such units give no row; those without a question belong to ``count_prefixes``.
    """
    from ..functions import chat as C

    asked = questions.select("doc_id", C.query_keywords(F.col("question")).alias("terms"))
    asked = asked.select("doc_id", "terms", F.transform("terms", T.soft_stem).alias("stems"))
    return retrieved(docs.select("doc_id", "text").join(asked, "doc_id", "left"), share, sig_words, percentile)
