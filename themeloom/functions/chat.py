"""Chat and answer text as Column expressions: addresses, protected units, wording tests, scoring forms."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import text as T

SPACE = r"[ \t\r\n]+"
URL_TAIL = r"(?i)(?:https?://|www\.)(?:\S*[^\s).,;:\]]([).,;:\]]*)|([).,;:\]]+))"
URL = r"(?i)https?://\S+|www\.\S+"

# Words that only acknowledge.
ACKNOWLEDGEMENTS = (
    "yes", "yeah", "yep", "no", "nope", "sure", "ok", "okay", "correct", "right", "agreed", "first", "second", "third", "one", "two", "option",
    "that", "this",
)
# Asking words that are no content of a query.
ASKING_WORDS = (
    "describe", "describes", "described", "describing", "tell", "tells", "told", "telling", "say", "says", "said", "saying", "happen", "happens",
    "happened", "happening", "call", "calls", "called", "calling", "name", "names", "named", "naming", "passage", "text", "document", "article",
    "story", "context", "mention", "mentions", "mentioned", "according", "based", "follow", "follows", "followed", "following", "main", "thing",
    "things", "way", "ways", "like", "given", "show", "shows", "shown", "showing",
)
# Wordings that ask for a summary.
SUMMARY_ASKS = (
    r"\bsummar(?:y|ize|ise|ies|izing|ising|ized|ised)\b", r"\brecap\b", r"\boverview\b", r"\bsynopsis\b", r"\brundown\b", r"\btl;?dr\b",
    r"\bsum (?:it |this |that |everything |things )?up\b", r"\b(?:main|key) (?:points|takeaways|things)\b", r"\bcatch me up\b", r"\bbring me up to speed\b",
    r"\bwhat (?:did|have|had) we (?:discuss|talk|cover|decide|agree|go over)", r"\bwhat we(?:'ve| have)? (?:discussed|talked about|covered|decided|agreed|gone over)\b",
    r"\beverything (?:we|you)(?:'ve| have)? (?:discussed|talked about|covered|said|told)\b", r"\bso far\b.*\b(?:we|discussed|talked|covered)\b", r"\b(?:we|discussed|talked|covered)\b.*\bso far\b",
)
CODE_LIKE = r"</?[A-Za-z][\w:.-]*[^>]*/?>|::|=>|->|\)\s*\{|\b(?:def|function|class|fn|impl)\s+\w+\s*[(<]|^\s{4,}\S"
# Where a prediction ends, in the order in which they are cut.
PREDICTION_ENDS = (".assistant", "\n\nQuestion", "</s>", "(Document", "\n\nAnswer", "(Passage")
# Ligatures and what they stand for.
LIGATURES = {"ﬀ": "ff", "ﬁ": "fi", "ﬂ": "fl", "ﬃ": "ffi", "ﬄ": "ffl", "ﬅ": "ft", "ﬆ": "st"}


def any_of(text: Column, patterns) -> Column:
    return text.rlike("|".join(f"(?:{p})" for p in patterns))


def has_url(text: Column) -> Column:
    return text.rlike(URL)


def url_dominated(text: Column, share: float = 0.40) -> Column:
    """Addresses make up over share of the stripped text; false for an empty one."""
    bare = F.length(F.trim(text))
    return (bare > 0) & (bare - F.length(F.regexp_replace(F.trim(text), URL, "")) > F.lit(share) * bare)


def url_placeholder(text: Column) -> Column:
    """Each address becomes <url>; closing punctuation that it swallowed stays."""
    return F.regexp_replace(text, URL_TAIL, "<url>$1$2")


def protected(text: Column) -> Column:
    """Tables, text about an address, code: kept whatever the junk rules say."""
    t = F.trim(text)
    bars = F.length(t) - F.length(F.replace(t, F.lit("|"), F.lit("")))
    return (bars >= 2) | (F.contains(t, F.lit("<url>")) & (T.n_words(t) >= 3)) | ((F.length(t) >= 10) & t.rlike(CODE_LIKE))


def junk_by_pattern(text: Column) -> Column:
    low = F.lower(F.trim(text))
    return any_of(low, ["^(?:" + "|".join(T.JUNK_STARTS) + ")", *T.JUNK_INSIDE])


def short_user_unit(text: Column) -> Column:
    """What only the length rule would drop: short, with a letter, neither address nor pattern junk."""
    t = F.trim(text)
    return (t != "") & T.is_short_junk(t) & t.rlike(r"\p{L}") & ~has_url(t) & ~junk_by_pattern(t)


def acknowledgement_only(text: Column) -> Column:
    """Every content word acknowledges; true if there is none."""
    words = F.regexp_extract_all(F.lower(text), F.lit("([a-z]+)"), 1)
    return F.forall(words, lambda w: (F.length(w) <= 2) | w.isin("the", *ACKNOWLEDGEMENTS))


def summary_ask(text: Column) -> Column:
    return any_of(T.squeeze(F.lower(F.coalesce(text, F.lit("")))), SUMMARY_ASKS)


def age(seconds: Column) -> Column:
    """just now, then whole minutes, hours, days."""
    unit = lambda by, name: F.concat(F.floor(seconds / by).cast("string"), F.lit(name))
    return F.when(seconds < 60, "just now").when(seconds < 3600, unit(60, "m ago")).when(seconds < 86400, unit(3600, "h ago")).otherwise(unit(86400, "d ago"))


def budget(value: Column) -> Column:
    """A share of words: 30 is 0.30; null outside (0, 1]."""
    share = F.when(value > 1, value / 100.0).otherwise(value)
    return F.when((share > 0) & (share <= 1), share)


def scrub(line: Column) -> Column:
    """A line out of a page: ligatures opened, odd blanks and control characters gone, no blank before punctuation."""
    c = reduce(lambda c, kv: F.replace(c, F.lit(kv[0]), F.lit(kv[1])), LIGATURES.items(), line)
    c = F.replace(F.regexp_replace(c, r"\(cid:\d+\)", " "), F.lit("\u00ad"), F.lit(""))
    c = F.regexp_replace(c, "[\u00a0\u2000-\u200a\u202f\u205f\u3000\\x00-\\x1f\\x7f\u200b-\u200d\ufeff]", " ")
    return T.squeeze(F.regexp_replace(c, r"\s+([,;:.!?)\]])", "$1"))


def query_keywords(text: Column, extended: bool = True) -> Column:
    """Distinct cleaned words of two letters or more that are no stopwords."""
    stop = [*T.QUERY_STOPWORDS, *(ASKING_WORDS if extended else ())]
    words = F.transform(F.split(F.lower(text), SPACE), T.strip_word)
    return F.array_distinct(F.filter(words, lambda w: (F.length(w) >= 2) & w.rlike(r"^\p{L}+$") & ~w.isin(*stop)))


def proper_nouns(text: Column) -> Column:
    """Distinct names in a query, lower-case: hyphenated compounds, and capitalised words that are neither acronyms nor question or stop words."""
    edges = r"^[.,;:!?()\[\]\"'“”‘’]+|[.,;:!?()\[\]\"'“”‘’]+$"
    raw = F.filter(F.transform(F.split(text, SPACE), lambda w: F.regexp_replace(w, edges, "")), lambda w: F.length(w) >= 2)
    joined = lambda w: (F.length(w) > 5) & w.rlike(r"^\p{L}{2,}(?:-\p{L}{2,})+$")
    acronym = lambda w: (F.length(w) > 3) & (F.upper(w) == w) & (F.lower(w) != w)
    named = F.filter(raw, lambda w: joined(w) | (~acronym(w) & w.rlike(r"^\p{Lu}")))
    low = F.transform(named, lambda w: F.when(joined(w), F.lower(w)).otherwise(T.strip_word(F.lower(w))))
    return F.array_distinct(F.filter(low, lambda w: (w != "") & ~w.isin(*T.QUESTION_WORDS, *T.QUERY_STOPWORDS)))


def with_stems(words: Column) -> Column:
    return F.array_union(words, F.transform(words, T.soft_stem))


# Markup that a score does not see, and labels before an answer.
MARKS = r"[*_`#>]+"
ANSWER_LABEL = r"(?i)^(?:final\s+answer|the\s+answer\s+is|answer\s+is|answer)\s*[:\-]?\s*"


def scoring_form(text: Column) -> Column:
    """Lower case without markup, punctuation and articles; a decimal point stays, a thousands comma goes."""
    c = F.regexp_replace(F.lower(text), MARKS, "")
    c = F.regexp_replace(F.regexp_replace(c, r"(?<=\d),(?=\d{3}\b)", ""), r"(?<=\d)\.(?=\d)", T.HOLD)
    c = F.regexp_replace(c, rf"[^\p{{L}}\p{{N}} \t\r\n{T.HOLD}]", " ")
    return T.squeeze(F.regexp_replace(F.replace(c, F.lit(T.HOLD), F.lit(".")), r"\b(?:a|an|the)\b", " "))


def final_line(text: Column) -> Column:
    """The last line with anything in it, without markup and a leading label; empty if there is none."""
    lines = F.filter(F.transform(F.split(text, "\n"), lambda x: F.trim(x)), lambda x: x != "")
    last = F.coalesce(F.get(lines, F.size(lines) - 1), F.lit(""))
    return F.regexp_replace(F.trim(F.regexp_replace(last, MARKS, "")), ANSWER_LABEL, "")


def prediction(text: Column, first_line: Column) -> Column:
    """A model's output up to the first of the end marks; its first line where first_line holds."""
    cut = F.trim(reduce(lambda c, mark: F.substring_index(c, mark, 1), PREDICTION_ENDS, text), F.lit(" \t\r\n"))
    return F.when(first_line, F.substring_index(cut, "\n", 1)).otherwise(cut)


# Patterns that a sentence answering such a question has, and what it is then multiplied by.
QUESTION_BOOSTS = (
    ("who", r"\b[A-Z][a-z]{2,}\b", 1.4),
    ("when", r"\b\d+\b|(?i:\b(?:January|February|March|April|May|June|July|August|September|October|November|December|Monday|Tuesday|Wednesday|Thursday|Friday|Saturday|Sunday|morning|afternoon|evening|night|yesterday|tomorrow|today|years?|months?|weeks?|days?|hours?|minutes?|century|centuries|decades?|ago|later|earlier)\b)", 1.45),
    ("where", r"\b(?:in|at|near|inside|outside|by|towards?|upon|behind|beside|beneath|above|below|across|along)\s+(?:the\s+)?[A-Z][a-z]{2,}\b", 1.35),
    ("where", r"\b[A-Z][a-z]{2,}\b", 1.15),
    ("how_many", r"\b\d+\b", 1.6),
    ("how_many", r"(?i)\b(?:one|two|three|four|five|six|seven|eight|nine|ten|eleven|twelve|thirteen|fourteen|fifteen|sixteen|seventeen|eighteen|nineteen|twenty|thirty|forty|fifty|sixty|seventy|eighty|ninety|hundred|thousand|million|billion|dozen|score)\b", 1.3),
    ("why", r"(?i)\b(?:because|since|due\s+to|therefore|thus|hence|reasons?|caused?|causing|result(?:ed|ing|s)?|so\s+that|in\s+order\s+to|led\s+to|leading\s+to|owing\s+to)\b", 1.4),
    ("how_die", r"(?i)\b(?:shot|killed|stabbed|hanged?|hung|fell|jumped|drowned|poisoned|murdered|died|death|sword|knife|gun|pistol|throat|blood)\b", 1.5),
)


def question_boost(text: Column, kind: Column) -> Column:
    c = reduce(lambda c, b: c.when((kind == b[0]) & text.rlike(b[1]), b[2]), QUESTION_BOOSTS[1:], F.when((kind == QUESTION_BOOSTS[0][0]) & text.rlike(QUESTION_BOOSTS[0][1]), QUESTION_BOOSTS[0][2]))
    return c.otherwise(1.0)


# Patterns of report text with the number of words under which each makes it junk (null: always).
REPORT_JUNK = (
    (r"(?i)(?:^|\b)(?:See|For)\s+(?:also\s+|current\s+information[^,]*,\s*)?(?:see\s+)?CRS\s+Report\s+[A-Z]?\d+", 50),
    (r"(?i)^For\s+(?:current|legislative|additional|further|more)\s+(?:information|initiatives|details|analysis|discussion|data)", 40),
    (r"(?i)(?:supersedes|replaces|updates|see\s+also)\s+CRS\s+Report", 40),
    (r"(?i)\d{1,3}\s*(?:th|st|nd|rd)\s+Cong\.\s*,?\s*\d+\s*(?:st|nd|rd|th)\s+sess\.", 30),
    (r"(?i)\(Washington,?\s*D\.?C\.?:\s*GPO", 25),
    (r"(?i)^\(?\s*Washington,?\s*D\.?C\.?:\s*(?:GPO|Government Publishing|Government Printing|U\.?S\.?\s*Government)", 25),
    (r"(?i)^(?:H\.?\s*(?:Rept|Res|Con)\.?\s*\d+|S\.?\s*(?:Rept|Res|Con)\.?\s*\d+|P\.?L\.?\s*\d+[-–]\d+)", 20),
    (r"(?i)^(?:January|February|March|April|May|June|July|August|September|October|November|December)\s+\d{1,2},?\s+\d{4}\s*[-–—]\s*$", None),
)
CITATIONS = r"Pub\.?\s*L\.?\s*(?:No\.?)?\s*\d+[-–]\d+|\d+\s+U\.?S\.?C\.?\s*§?\s*\d+|\d+\s+Stat\.?\s*\d+"


def report_junk(text: Column) -> Column:
    """Report and citation lines, each rule with its gate on words."""
    t = F.trim(text)
    n = T.n_words(t)
    cited = F.length(t) - F.length(F.regexp_replace(t, CITATIONS, ""))
    rules = [t.rlike(p) & (F.lit(True) if most is None else n < most) for p, most in REPORT_JUNK]
    both = t.rlike(REPORT_JUNK[3][0]) & t.rlike(REPORT_JUNK[4][0])
    return reduce(lambda a, b: a | b, [url_dominated(t), both, *rules, (2 * cited > F.length(t)) & (n < 30)])
