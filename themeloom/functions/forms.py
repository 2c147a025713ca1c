"""Further text forms: page lines, prompts, cuts, and what a model's reply is made of."""

from __future__ import annotations

import json
from collections.abc import Callable
from functools import reduce

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from . import chat as C
from . import text as T

WS = r"[ \t\r\n]+"
# Look-alikes of operators and what they stand for, in texts with an equals sign only.
GLYPHS = ((r"\bX\s+(?=\S*∈)", "Σ "), (r"\bP(?=\S{0,4}\s+\S{1,4}=)", "Σ"), (r"(?<![\w])\[\s+(?=\S*∈)", "∪ "))
# Section names, words that a title leaves in lower case, and the beginnings of headings.
SECTIONS = ("abstract", "references", "bibliography", "acknowledgments", "acknowledgements", "appendix", "introduction", "conclusion", "conclusions", "related work", "limitations", "ethics statement", "contents", "index", "glossary")
MINOR = ("a", "an", "the", "of", "in", "on", "for", "and", "or", "to", "with", "at", "by", "from", "via", "as", "is", "are")
MARKED_HEADING, NUMBERED = r"^#{1,6}\s", r"^(?:\d+(?:\.\d+)*\.?|[A-Z]\.\d+(?:\.\d+)*\.?|[A-Z]\.?|[IVXLC]+\.?|Appendix\s+[A-Z]\d*\.?)\s+\S"
# Wordings about what was said before, and words of the first person.
PAST = (
    r"\b(?:remember|recall|remind)\w*\b", r"\b(?:you|we|i) (?:said|told|mentioned|suggested|recommended|discussed|talked|decided|agreed|asked)\b",
    r"\b(?:last time|earlier|previously|before|again|so far)\b", r"\b(?:last|previous|earlier|first) (?:chat|conversation|talk|session|message)\b",
)
FIRST_PERSON = r"\b(?:i|me|my|mine|myself|we|us|our|ours)\b"
#: Where a word of ASCII letters, digits and underscores begins or ends; Java's \b minds other letters too.
ASCII_EDGE = r"(?:(?<=\w)(?!\w)|(?<!\w)(?=\w))"
#: Words up to which a line can be about the memory itself.
CLAIM_WORDS = 25
# What an answer that was cut says of it, and the tags around a model's thoughts.
CUT_MARKER = "[the rest of this answer was not kept]"
OPENED, CLOSED = r"<think\b[^>]*>", r"</think\s*>"


def glyphs(text: Column) -> Column:
    """Operators that a page reader writes as letters, restored inside formulas."""
    fixed = reduce(lambda c, kv: F.regexp_replace(c, kv[0], kv[1]), GLYPHS, text)
    return F.when(F.contains(text, F.lit("=")), fixed).otherwise(text)


def words_of(text: Column) -> Column:
    return F.filter(F.split(text, WS), lambda w: w != "")


def title_share(words: Column) -> Column:
    """Of the words that a title writes large: the share that is."""
    major = F.filter(words, lambda w: ~F.lower(w).isin(*MINOR))
    large = F.filter(major, lambda w: w.rlike(r"^(?:[\p{Lu}\d]|\(\p{Lu})"))
    return F.when(F.size(major) > 0, F.size(large) / F.size(major)).otherwise(0.0)


def is_heading(line: Column) -> Column:
    """A line that stands over a section: marked, a known name, all capitals, or numbered and written as a title."""
    words = words_of(line)
    n, first = F.size(words), F.get(words, F.lit(0))
    known = F.lower(F.regexp_replace(line, ":+$", "")).isin(*SECTIONS)
    sentence = line.rlike(r"[.!?,;:]$") | line.rlike("[=←→]") | ~line.rlike(r"\p{L}[^\s]*\p{L}")
    capitals = (n <= 8) & line.rlike(r"\p{Lu}") & ~line.rlike(r"\p{Ll}")
    small = ~first.rlike(r"^\d") | (first.rlike(r"^\d{1,2}(?:\.\d{1,2})*\.?$"))
    rest = F.when(line.startswith("Appendix"), F.slice(words, 3, 10)).otherwise(F.slice(words, 2, 10))
    numbered = line.rlike(NUMBERED) & small & (title_share(rest) >= 0.6)
    return F.coalesce((n > 0) & (n <= 10) & (line.rlike(MARKED_HEADING) | known | (~sentence & (capitals | numbered))), F.lit(False))


def identifiers(text: Column) -> Column:
    """Words of a query that are no plain words but have a letter or digit: dates, versions, names in code."""
    cleaned = F.transform(words_of(F.lower(text)), T.strip_word)
    return F.array_distinct(F.filter(cleaned, lambda w: (F.length(w) >= 2) & ~w.rlike(r"^\p{L}+$") & w.rlike(r"[\p{L}\p{N}]")))


def claimed(line: Column, ascii_words: bool = False) -> Column:
    """Why a short line is about the memory itself: summary, past, personal, or null.

    A word ends where no letter of any script follows; with ascii_words, where no ASCII one does.
    """
    low = F.lower(T.squeeze(F.coalesce(line, F.lit(""))))
    says = lambda *patterns: C.any_of(low, [p.replace(r"\b", ASCII_EDGE) if ascii_words else p for p in patterns])
    why = F.when(says(*C.SUMMARY_ASKS), "summary").when(says(*PAST), "past").when(says(FIRST_PERSON), "personal")
    return F.when(T.n_words(F.coalesce(line, F.lit(""))) <= CLAIM_WORDS, why)


def may_hold(line: Column, summary: Column, windowed: Column, named: Column, ascii_words: bool = False) -> Column:
    """ok and why: whether a turn may go without memory when memory holds nothing for it."""
    why = F.when(summary, "summary").when(windowed, "window").when(named, "named").otherwise(claimed(line, ascii_words))
    return F.struct(why.isNull().alias("ok"), why.alias("why"))


def prompt(template: Column, context: Column, asked: Column) -> Column:
    """A task's template with its context and question. What they hold is not read as a place again."""
    parts = F.split(template, r"(?=\{context\}|\{input\})|(?<=\{context\})|(?<=\{input\})")
    filled = F.transform(parts, lambda p: F.when(p == "{context}", F.coalesce(context, F.lit(""))).when(p == "{input}", F.coalesce(asked, F.lit(""))).otherwise(p))
    return F.array_join(filled, "")


def middle_cut(tokens: Column, most: int) -> Column:
    """The first and last half of so many tokens, if there are more; most under 2 cuts nothing."""
    half = most // 2
    if half < 1:
        return tokens
    ends = F.concat(F.slice(tokens, 1, half), F.slice(tokens, F.size(tokens) - half + 1, F.lit(half)))
    return F.when(F.size(tokens) > most, ends).otherwise(tokens)


def capped(answer: Column, cap: int, marker: str = CUT_MARKER) -> Column:
    """An answer cut at the last sentence end, else blank, within cap characters; the marker stands inside the last sentence."""
    window = F.substring(answer, 1, cap)
    whole = F.regexp_extract(window, r"(?s)^(.*[.!?][\"')\]]*)(?=\s)", 1)
    blank = F.regexp_extract(window, r"(?s)^(.+) ", 1)
    kept = F.rtrim(F.when(whole != "", whole).when(blank != "", blank).otherwise(window))
    end = F.when(kept.rlike(r"[.!?]$"), F.right(kept, F.lit(1))).otherwise(F.lit(""))
    body = F.rtrim(F.regexp_replace(kept, r"[.!?]$", ""))
    cut = F.concat(body, F.lit(f" {marker}"), F.when(end == "", ".").otherwise(end))
    return F.when(F.length(answer) > cap, cut).otherwise(answer) if cap else answer


def thoughts(text: Column) -> Column:
    """said and thought: a reply outside and inside its think tags, which may be nested; an open tag reaches to the end.

    All up to the last closing tag before any opening one is a thought that the prompt opened.
    """
    text = F.coalesce(text, F.lit(""))
    prompted = F.regexp_extract(text, rf"(?is)^((?:(?!{OPENED}).)*{CLOSED})", 1)
    parts = F.split(F.substr(text, F.length(prompted) + 1), rf"(?i)(?={OPENED}|{CLOSED})")
    start = F.struct(F.lit(0).alias("depth"), F.lit("").alias("said"), F.regexp_replace(prompted, f"(?i){CLOSED}", "").alias("thought"))

    def step(state: Column, part: Column) -> Column:
        inner = part.rlike(f"(?i)^{OPENED}")
        outer = part.rlike(f"(?i)^{CLOSED}")
        depth = F.when(inner, state["depth"] + 1).when(outer, F.greatest(state["depth"] - 1, F.lit(0))).otherwise(state["depth"])
        plain = F.regexp_replace(part, f"(?i)^(?:{OPENED}|{CLOSED})", "")
        said = F.when(depth == 0, F.concat(state["said"], plain)).otherwise(state["said"])
        thought = F.when(depth > 0, F.concat(state["thought"], plain)).otherwise(state["thought"])
        return F.struct(depth.alias("depth"), said.alias("said"), thought.alias("thought"))

    edge = lambda c: F.regexp_replace(c, r"^\s+|\s+$", "")
    return F.aggregate(parts, start, step, lambda s: F.struct(edge(s["said"]).alias("said"), edge(s["thought"]).alias("thought")))


def first_object(text: Column) -> Column:
    """The first JSON object in a reply, as text; null without one. A decoder reads from each brace, so strings and nesting count."""

    @F.pandas_udf("string")
    def find(texts: pd.Series) -> pd.Series:
        decode = json.JSONDecoder().raw_decode

        def one(t: str | None) -> str | None:
            at = (t or "").find("{")
            while at >= 0:
                try:
                    return t[at : decode(t, at)[1]]
                except ValueError:
                    at = t.find("{", at + 1)
            return None

        return texts.map(one)

    return find(text)


def token_count(text: Column, load: Callable[[], Callable[[str], list]]) -> Column:
    """Tokens by an injected encoder, which each worker loads once; null where it cannot be loaded."""

    @F.pandas_udf("long")
    def count(texts: pd.Series) -> pd.Series:
        try:
            encode = load()
        except Exception:  # an encoder that is not installed leaves the count unknown
            return pd.Series([None] * len(texts), dtype="Int64")
        return texts.map(lambda t: len(encode(t or ""))).astype("Int64")

    return count(text)


def bisected(text: Column, most: int, depth: int = 8) -> Column:
    """A text in word-wise halves until each has at most so many tokens of four characters, in order."""
    parts = F.array(T.squeeze(text))
    over = lambda p: (F.floor(F.length(p) / 4) > most) & (F.size(F.split(p, " ")) > 1)

    def halves(p: Column) -> Column:
        w = F.split(p, " ")
        mid = F.floor(F.size(w) / 2).cast("int")
        return F.when(over(p), F.array(F.array_join(F.slice(w, F.lit(1), mid), " "), F.array_join(F.slice(w, mid + 1, F.size(w)), " "))).otherwise(F.array(p))

    for _ in range(depth):
        parts = F.flatten(F.transform(parts, halves))
    return parts
