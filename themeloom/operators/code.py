"""Source code as rows: lines, units, identifiers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Words of programming languages that name nothing.
CODE_WORDS = (
    "def", "class", "return", "import", "from", "as", "if", "elif", "else", "for", "while", "try", "except", "finally", "with", "lambda", "yield",
    "pass", "break", "continue", "raise", "assert", "del", "global", "nonlocal", "in", "is", "not", "and", "or", "none", "true", "false", "self",
    "cls", "init", "print", "args", "kwargs", "public", "private", "protected", "internal", "static", "final", "abstract", "void", "new", "this",
    "super", "extends", "implements", "interface", "enum", "struct", "package", "throws", "throw", "catch", "switch", "case", "default", "do",
    "instanceof", "native", "synchronized", "transient", "volatile", "const", "var", "let", "function", "export", "async", "await", "using",
    "namespace", "override", "virtual", "readonly", "sealed", "out", "ref", "null", "get", "set", "int", "long", "short", "byte", "float", "double",
    "boolean", "bool", "char", "string", "str", "list", "dict", "map", "array", "object", "len", "range", "value", "values", "key", "keys", "item",
    "items",
)
# Lines that open a unit, and parts of compound names.
PATH_LINE = r"^\s*(?://|#|/\*)?\s*[\w.\-]+(?:[/\\][\w.\-]+)+\.[A-Za-z]{1,5}\s*(?:\*/)?\s*$"
SIGNATURE = r"^\s{0,8}(?:(?:(?:public|private|protected|internal|static|final|abstract|sealed|async|export|default)\s+)*(?:def|class|function|interface|enum|struct|trait|impl)\s+\w|(?:public|private|protected|internal|static|final|abstract|async|override|virtual|export)\b[^=;]*\()"
IMPORT = r"^\s*(?:import\s|from\s+\S+\s+import\s|using\s+[\w.]+\s*;|#\s*include\s*[<\"]|require\s*\()"
PARTS = r"([A-Z]+(?=[A-Z][a-z])|[A-Z]?[a-z]+|[A-Z]+|[0-9]+)"


def identifiers(text: Column) -> Column:
    """Distinct lower-case identifiers and, of compound ones, their parts of three letters or more; no language words."""
    found = F.regexp_extract_all(text, F.lit("([A-Za-z_][A-Za-z0-9_]*)"), 1)
    whole = F.filter(F.transform(found, F.lower), lambda w: F.length(w) >= 2)
    split = F.transform(found, lambda w: F.regexp_extract_all(w, F.lit(PARTS), 1))
    parts = F.transform(F.flatten(F.filter(split, lambda p: F.size(p) > 1)), F.lower)
    parts = F.filter(parts, lambda w: (F.length(w) >= 3) & w.rlike("^[a-z]+$"))
    return F.array_except(F.concat(whole, parts), F.array(*[F.lit(w) for w in CODE_WORDS]))


def lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, pos, line: lines with anything in them, blanks at the end gone; pos runs over the kept ones."""
    each = F.filter(F.transform(F.split(F.coalesce(text_col, F.lit("")), "\n"), lambda x: F.regexp_replace(x, r"[ \t\r]+$", "")), lambda x: x != "")
    return docs.select(F.col(id_col).alias("doc_id"), F.posexplode(each).alias("pos", "line"))


def units(rows: DataFrame) -> DataFrame:
    """Adds opens (a path or a signature) and unit, the running number of openings, and anchor (imports too)."""
    opens = F.col("line").rlike(f"(?:{PATH_LINE})|(?:{SIGNATURE})")
    running = Window.partitionBy("doc_id").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    out = rows.withColumn("opens", opens).withColumn("anchor", opens | F.col("line").rlike(IMPORT))
    return out.withColumn("unit", F.sum(F.col("opens").cast("int")).over(running))


def unit_profile(rows: DataFrame) -> DataFrame:
    """Per unit: lines, anchors and its distinct identifiers' number."""
    names = rows.withColumn("name", F.explode_outer(identifiers(F.col("line"))))
    counted = names.groupBy("doc_id", "unit").agg(F.countDistinct("pos").alias("n_lines"), F.countDistinct(F.when(F.col("anchor"), F.col("pos"))).alias("n_anchors"), F.countDistinct("name").alias("n_names"))
    return counted


def query_terms(text: Column, words: int = 200) -> Column:
    """Identifiers of the last words of a text, where a completion would go on."""
    held = F.filter(F.split(text, r"[ \t\r\n]+"), lambda w: w != "")
    return identifiers(F.array_join(F.slice(held, F.greatest(F.size(held) - words, F.lit(0)) + 1, F.lit(words)), " "))


def anchors(rows: DataFrame, budget_share: float = 0.2, tail_share: float = 0.9, struct_share: float = 0.1) -> DataFrame:
    """doc_id, pos, n_words, kind of the lines that are kept whatever else is: tail and struct.

    rows are those of ``units``. The tail is the longest run of last lines within tail_share of the
    budget. Opening and importing lines before it are taken in order as long as each fits what
    struct_share, or the budget after the tail, leaves. A question that brings its own place to go on
    needs a tail of 0.1 only.
    """
    doc = Window.partitionBy("doc_id")
    sized = rows.withColumn("n_words", F.size(F.filter(F.split("line", r"[ \t\r\n]+"), lambda w: w != "")))
    sized = sized.withColumn("budget", F.floor(F.sum("n_words").over(doc) * F.lit(budget_share)))
    after = doc.orderBy(F.desc("pos")).rowsBetween(Window.unboundedPreceding, 0)
    tail = F.sum("n_words").over(after) <= F.floor(F.col("budget") * F.lit(tail_share))
    placed = sized.withColumn("tail", tail)
    used = F.sum(F.when(F.col("tail"), F.col("n_words")).otherwise(0)).over(doc)
    free = F.greatest(F.lit(0.0), F.least(F.lit(struct_share), (F.col("budget") - used) / F.greatest("budget", F.lit(1))))
    placed = placed.withColumn("cap", F.floor(F.col("budget") * free)).filter("tail or anchor")
    line = F.struct("pos", "n_words", "tail")
    held = placed.groupBy("doc_id").agg(F.max("cap").alias("cap"), F.sort_array(F.collect_list(line)).alias("held"))
    start = "named_struct('used', 0L, 'out', cast(array() as array<int>))"
    take = "if(a.used + x.n_words <= cap, named_struct('used', a.used + x.n_words, 'out', array_append(a.out, x.pos)), a)"
    held = held.withColumn("took", F.expr(f"aggregate(filter(held, x -> not x.tail), {start}, (a, x) -> {take}).out"))
    kept = "filter(held, x -> x.tail or array_contains(took, x.pos))"
    return held.select("doc_id", F.expr(f"inline(transform({kept}, x -> named_struct('pos', x.pos, 'n_words', x.n_words, 'kind', if(x.tail, 'tail', 'struct'))))"))


def unit_themes(rows: DataFrame, percentile: float = 0.5) -> tuple[DataFrame, DataFrame]:
    """(keywords, themes) of code lines: identifiers, and each line's unit as one more keyword that is always a theme and leads its path.

    A unit counts one more than the most frequent identifier of its document, whatever its size, so
    the first level of the trie is the document's structure. Both tables are as ``operators.themes``
    takes and makes them.
    """
    from . import themes

    names = rows.select("doc_id", "pos", F.explode(identifiers(F.col("line"))).alias("kw"))
    places = rows.select("doc_id", "pos", F.concat(F.lit("\0unit"), F.col("unit").cast("string")).alias("kw"))
    kws = names.unionByName(places)
    df = themes.keyword_df(kws)
    real = df.filter(~F.startswith("kw", F.lit("\0"))).groupBy("doc_id").agg(F.max("df").alias("_most"))
    found = themes.themes(df, percentile)
    cut = found.groupBy("doc_id").agg(F.max("threshold").alias("threshold"))
    units_ = places.select("doc_id", "kw").distinct().join(real, "doc_id", "left").join(cut, "doc_id", "left")
    units_ = units_.select("doc_id", "kw", (F.coalesce("_most", F.lit(1)) + 1).alias("df"), "threshold")
    both = found.filter(~F.startswith("kw", F.lit("\0"))).select("doc_id", "kw", "df", "threshold").unionByName(units_)
    return kws, both.withColumn("rk", F.row_number().over(Window.partitionBy("doc_id").orderBy(F.desc("df"), "kw")))
