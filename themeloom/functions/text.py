"""Scalar text functions as Column expressions; all stay inside the JVM."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# Abbreviations whose periods end no sentence.
ABBREVIATIONS_MANY_DOTS = ("H.R.", "S.J.", "H.J.", "U.S.", "D.C.", "U.K.", "E.U.", "P.L.")
ABBREVIATIONS = (
    "Dr", "Mr", "Mrs", "Ms", "Jr", "Sr", "Prof", "Rev", "Gen", "Lt", "Col", "Sgt", "Cpl", "Pvt", "Maj", "Capt", "Cmdr", "Adm", "Brig",
    "Rep", "Sen", "Gov", "Pres", "Sec", "Dept", "Div", "Assn", "Cong", "Sess", "Rept", "Res", "Stat", "Pub",
    "Corp", "Inc", "Ltd", "Co", "Bros", "Jan", "Feb", "Mar", "Apr", "Jun", "Jul", "Aug", "Sep", "Sept", "Oct", "Nov", "Dec",
    "Vol", "No", "Fig", "Ch", "Ed", "Eq", "p", "pp", "vs", "etc", "approx", "Exec", "Amdt",
)
# Suffixes in the order in which they are tried.
STEM_SUFFIXES = ("ingly", "edly", "ings", "ies", "ied", "ing", "ed", "es", "ly")
# Characters stripped from the ends of a word.
STRIPPED = ".,;:!?()[]\"'“”‘’"
# Words that a query keyword is not.
QUERY_STOPWORDS = (
    "the", "a", "an", "is", "are", "was", "were", "be", "been", "being", "do", "does", "did", "have", "has", "had", "having", "will", "would",
    "shall", "should", "may", "might", "can", "could", "that", "this", "these", "those", "it", "its", "and", "or", "but", "not", "no", "nor", "in",
    "on", "at", "to", "for", "of", "by", "with", "from", "as", "if", "so", "than", "too", "very", "what", "which", "who", "whom", "whose", "where",
    "when", "how", "why",
)
QUESTION_WORDS = ("who", "what", "where", "when", "why", "how", "which", "whose", "whom")

# Characters from which a sentence is over-long (401 tokens at four characters each), and of a cut.
TOO_LONG, CUT = 1604, 1600
EDGE_BLANKS = r"^[ \t\r\n]+|[ \t\r\n]+$"
HOLD = "\x01"  # stands for a protected period
_ENDS = r"[.,;:!?()\[\]\"'“”‘’]+"


def protect_abbreviations(text: Column) -> Column:
    held = reduce(lambda c, a: F.replace(c, F.lit(a), F.lit(a.replace(".", HOLD))), ABBREVIATIONS_MANY_DOTS, text)
    # The period comes first in the pattern, so the alternatives are only tried where one stands.
    return F.regexp_replace(held, f"\\.(?<=(?:{'|'.join(sorted(ABBREVIATIONS, key=lambda a: (-len(a), a)))})\\.)", HOLD)


def squeeze(text: Column) -> Column:
    return F.trim(F.regexp_replace(text, r"[ \t\r\n]+", " "))


def short_parts(part: Column) -> Column:
    """A part as it is; an over-long one cut at its commas, or without any at the last blank of each CUT characters (anywhere, if there is none)."""
    cut = F.regexp_extract_all(part, F.lit(f"([\\s\\S]{{1,{CUT}}}\\z|[\\s\\S]{{1,{CUT - 1}}}(?= )|[\\s\\S]{{{CUT}}})"), 1)
    cut = F.when(F.contains(part, F.lit(",")), F.split(part, ",")).otherwise(cut)
    return F.when(F.length(part) < TOO_LONG, F.array(part)).otherwise(F.transform(cut, lambda c: F.regexp_replace(c, EDGE_BLANKS, "")))


def sentence_parts(text: Column) -> Column:
    """Array of trimmed sentences in order, over-long ones cut, empties gone."""
    split = F.split(protect_abbreviations(text), r"(?<=[.!?;])[ \t\r\n]+|\n+")
    plain = F.transform(split, lambda p: F.replace(F.regexp_replace(p, EDGE_BLANKS, ""), F.lit(HOLD), F.lit(".")))
    return F.filter(F.flatten(F.transform(plain, short_parts)), lambda p: p != "")


def n_words(text: Column) -> Column:
    return F.size(F.filter(F.split(text, r"[ \t\r\n]+"), lambda w: w != ""))


def strip_word(word: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(word, f"^{_ENDS}|{_ENDS}$", ""), "['’‘]s$", "")


def content_words(text: Column) -> Column:
    """Distinct lower-case words of over two letters, letters only, without 'the'."""
    words = F.transform(F.split(F.lower(text), r"[ \t\r\n]+"), strip_word)
    return F.array_distinct(F.filter(words, lambda w: (F.length(w) > 2) & w.rlike(r"^\p{L}+$") & (w != "the")))


def soft_stem(word: Column) -> Column:
    w = F.lower(word)
    n = F.length(w)
    c = F.when(n < 4, w)
    for s in STEM_SUFFIXES:
        c = c.when(w.endswith(s) & (n > len(s) + 2), F.substring(w, F.lit(1), n - len(s)))
    c = c.when(w.endswith("s") & ~w.endswith("ss"), F.substring(w, F.lit(1), n - 1))
    return c.when(w.endswith("e"), F.substring(w, F.lit(1), n - 1)).otherwise(w)


def dedup_key(text: Column) -> Column:
    """Letters outside a-z become blanks."""
    return F.trim(F.regexp_replace(F.regexp_replace(F.lower(text), r"[^a-z0-9 \t\r\n]", " "), r"[ \t\r\n]+", " "))


def norm_hash(text: Column) -> Column:
    return F.sha1(F.lower(squeeze(text)))


def chat_clean(text: Column) -> Column:
    c = F.regexp_replace(F.regexp_replace(text, r"[ \t]{2,}", " "), r"\n{3,}", "\n\n")
    return F.regexp_replace(c, r"^[ \t\r\n]+|[ \t\r\n]+$", "")


# Markup rewrites in order; flags as Java's.
MARKUP = (
    (r"\[\[(?:File|Image):[^\]]*\]\]", ""),
    (r"\[\[Category:[^\]]*\]\]", ""),
    (r"\{\{[^}]*\}\}", ""),
    (r"(?s)<ref[^>]*>.*?</ref>", ""),
    (r"<ref[^/]*/>", ""),
    (r"<[^>]+>", ""),
    (r"\[\[(?:[^|\]]*\|)?([^\]]*)\]\]", "$1"),
    (r"(?i)\b(?:thumb|frameless|frame)\b\s*(?:(?:left|right|center|upright(?:\s*=\s*[\d.]+)?|border|baseline|\d+(?:x\d+)?px)\s*)*", ""),
    (r"(?i)(?:^|\s)(?:right|left|center)\s+(?:thumb|upright)", " "),
    (r"(?i)\bupright\s*=\s*[\d.]+", ""),
    (r"\b\d+x\d+px\b", ""),
    (r"\b\d+px\b", ""),
    (r"\|+", " "),
    (r"  +", " "),
    (r"\n{3,}", "\n\n"),
)


def clean_markup(text: Column) -> Column:
    c = reduce(lambda c, r: F.regexp_replace(c, r[0], r[1]), MARKUP, text)
    return F.regexp_replace(c, r"^\s+|\s+$", "")


URL = r"(?i)https?://\S+|www\.\S+"


def url_share(text: Column) -> Column:
    """Characters of addresses over those of the stripped text."""
    total = F.aggregate(F.regexp_extract_all(text, F.lit(f"({URL.replace('(?i)', '')})"), 1), F.lit(0), lambda a, x: a + F.length(x))
    return total / F.greatest(F.length(F.trim(text)), F.lit(1))


def is_short_junk(text: Column) -> Column:
    t = F.trim(text)
    return (F.length(t) < 30) | (n_words(t) < 5)


# Beginnings that make a sentence junk.
JUNK_STARTS = (
    r"\s*\.\s*$", r"\s*\d+[.)]\s*$", r"\([^)]*\)\s*$", r"[a-z][a-z]+\s*\(\d{4}", r"\d+\.\d+\s+for\s+", r"(ibid|op\.?\s*cit|et\.?\s*al)",
    r"\s*[\[(]?\d+[\])]?\s*$", r"\[\[file:", r"\[\[image:", r"\[\[category:", r"category:", r"\{\{", r"#redirect", r"\s*<ref", r"\s*</ref",
    r"(see also|references|bibliography)\s*:?\s*$", r"(sources|external links|further reading)\s*:?\s*$", r"thumb\b", r"\d+x\d+px\b",
)


# The two of them that prose may begin with too, and the words from which it is taken for prose where asked.
PROSE_STARTS, PROSE_WORDS = (r"[a-z][a-z]+\s*\(\d{4}", r"\d+\.\d+\s+for\s+"), 8
# Image markup anywhere in a sentence, which is junk if little is left without the markup.
JUNK_INSIDE = (
    r"\|(?:thumb|right|left|center|upright|frameless|frame|border|baseline)", r"\|upright\s*=", r"\|\d+x\d+px", r"\|\d+px",
    r"\bthumb\b.*\bupright\b", r"\bright\b\s+thumb\b", r"\bupright\s*=\s*[\d.]+", r"\b\d+x\d+px\b",
)
# Wiki markup and what stays of it, in the order of replacement.
WIKI = (
    (r"(?i)^(?:\s*(?:thumb|right|left|center|upright(?:\s*=[^|]*)?|frameless|frame|border|baseline|\d+(?:x\d+)?px)\s*\|)+", ""),
    (r"\[\[(?:File|Image):[^\]]*\|", ""), (r"\[\[(?:[^|\]]*\|)?([^\]]*)\]\]", "$1"), (r"\{\{[^}]*\}\}", ""), (r"<[^>]+>", ""),
)


def wiki_clean(text: Column) -> Column:
    """Text without image parameters, links, templates, tags and bars at its ends."""
    plain = reduce(lambda c, kv: F.regexp_replace(c, kv[0], kv[1]), WIKI, text)
    for edge in (r"^\s+|\s+$", r"^\|+|\|+$", r"^\s+|\s+$"):
        plain = F.regexp_replace(plain, edge, "")
    return plain


def is_junk(text: Column, lenient: bool = False) -> Column:
    """Too short, begun as headings, references and markup are, or of image markup with little else. Lenient lets long prose begin with a year or a decimal."""
    low = F.lower(F.trim(text))
    begun = low.rlike("^(?:" + "|".join(p for p in JUNK_STARTS if not lenient or p not in PROSE_STARTS) + ")")
    if lenient:
        begun |= (n_words(text) < PROSE_WORDS) & low.rlike("^(?:" + "|".join(PROSE_STARTS) + ")")
    marked = low.rlike("|".join(JUNK_INSIDE)) & is_short_junk(wiki_clean(F.trim(text)))
    return is_short_junk(text) | begun | marked


PUNCTUATION = r"[!\"#$%&'()*+,\-./:;<=>?@\[\\\]^_`{|}~]"


def answer_words(text: Column) -> Column:
    """Lower-case words without ASCII punctuation and articles."""
    words = F.split(F.regexp_replace(F.lower(text), PUNCTUATION, ""), r"[ \t\r\n]+")
    return F.filter(words, lambda w: ~w.isin("", "a", "an", "the"))


def normalize_answer(text: Column) -> Column:
    return F.array_join(answer_words(text), " ")


def length_reward(n: Column) -> Column:
    return F.when(n < 15, 0.30).when(n < 20, 0.65).when(n < 28, 0.85).when(n <= 45, 1.0).otherwise(F.lit(0.95) / (1.0 + 0.01 * (n - 45)))


def question_type(text: Column) -> Column:
    words = F.filter(F.split(F.lower(F.trim(text)), r"[ \t\r\n]+"), lambda w: w != "")
    bare = F.transform(words, lambda w: F.regexp_replace(w, r"^[.,?!:;'\"]+|[.,?!:;'\"]+$", ""))
    asked = F.filter(F.slice(bare, 1, 4), lambda w: w.isin(*QUESTION_WORDS))
    first = F.get(asked, 0)
    at = F.array_position(bare, first)
    second = F.get(bare, at.cast("int"))
    dies = F.arrays_overlap(F.slice(words, F.greatest(at, F.lit(1)).cast("int"), 6), F.array(*[F.lit(w) for w in "die died dies kill killed kills murder murdered".split()]))
    return (
        F.when((first == "how") & second.isin("many", "much"), "how_many")
        .when((first == "how") & second.isin("long", "old"), "when")
        .when((first == "how") & second.isNotNull() & dies, "how_die")
        .when((first == "what") & second.isin("year", "time", "date", "age", "century", "decade", "month", "day"), "when")
        .otherwise(first)
    )
