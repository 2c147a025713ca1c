"""Scans and sinks: JSON lines, turns files, plain documents, ledgers, flat metric tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import text as X

# Names under which a turn's text and time are looked for, in this order.
TEXT_KEYS = ("text", "content", "message", "utterance", "question", "prompt")
TIME_KEYS = ("timestamp", "ts", "time", "date")
SAMPLE = "_id string, input string, context string, answers array<string>, all_classes array<string>, length long, dataset string, language string"
LEDGER = "id long, target string, status string, t_start double, t_end double, tokens long, version int"


def json_lines(spark: SparkSession, path: str, schema: str | T.StructType = SAMPLE, first: int | None = None) -> DataFrame:
    """Records of a file of JSON lines; the first ones in file order if asked for. NaN is no number."""
    if first is None:
        return spark.read.option("allowNonNumericNumbers", "false").schema(schema).json(path)
    # An ordered head needs places: a single file's lines are numbered as they are read, and only the head is taken.
    lines = spark.read.text(path).filter(F.trim("value") != "").select("value", "_metadata.file_path", "_metadata.file_block_start", F.monotonically_increasing_id().alias("at"))
    head = lines.orderBy("file_path", "file_block_start", "at").limit(first)
    ddl = schema if isinstance(schema, str) else schema.simpleString()
    return head.select(F.from_json("value", ddl, {"allowNonNumericNumbers": "false"}).alias("r"), "file_path", "file_block_start", "at").orderBy("file_path", "file_block_start", "at").select("r.*")


def documents(spark: SparkSession, path: str) -> DataFrame:
    """path, text of whole plain-text files. A file of another kind is refused by name when it is read; page texts come in as rows (see operators.pages)."""
    found = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("text"))
    known = F.lower("path").rlike(r"\.(?:txt|md|rst|text)$")
    return found.withColumn("text", F.when(known, F.col("text")).otherwise(F.raise_error(F.concat(F.lit("no plain text: "), F.col("path")))))


def normalised(records: DataFrame) -> DataFrame:
    """Samples with an id (of the context, if there is none) and a length in words."""
    context = F.coalesce("context", F.lit(""))
    return records.withColumns({"_id": F.coalesce("_id", F.sha1(context)), "length": F.coalesce("length", X.n_words(context).cast("long")), "context": context, "input": F.coalesce("input", F.lit(""))})


def by_article(questions: DataFrame, top: int | None = None) -> DataFrame:
    """From article, context, question, answer: a row for each article with its questions, most questions first, then longest, then article."""
    grouped = questions.groupBy("article").agg(F.max("context").alias("context"), F.sort_array(F.collect_list(F.struct("question", "answer"))).alias("questions"))
    ranked = grouped.withColumns({"n_questions": F.size("questions"), "n_words": X.n_words(F.coalesce("context", F.lit("")))})
    ordered = ranked.orderBy(F.desc("n_questions"), F.desc("n_words"), "article")
    return ordered if top is None else ordered.limit(top)


def _first_key(columns: list[str], keys: tuple[str, ...]) -> Column:
    found = [F.col(k).cast("string") for k in keys if k in columns]
    return F.coalesce(*found) if found else F.lit(None).cast("string")


def turns(spark: SparkSession, path: str, whole_array: bool = False) -> DataFrame:
    """conv_id, turn, role, text, at from a file of turns: JSON lines, or one JSON array.

    The text and the time come from the first known key that a record has. Times are ISO texts or
    seconds since 1970; a time that is neither is null.
    """
    raw = spark.read.option("multiLine", whole_array).json(path)
    have = raw.columns
    time = _first_key(have, TIME_KEYS)
    at = F.coalesce(F.expr("try_cast(_t as double)").cast("timestamp"), F.expr("try_to_timestamp(_t)"))
    col = lambda c, kind, other: F.coalesce(F.col(c).cast(kind), F.lit(other)) if c in have else F.lit(other).cast(kind)
    out = raw.withColumn("_t", time)
    return out.select(col("conv_id", "string", "").alias("conv_id"), col("turn", "long", 0).alias("turn"), col("role", "string", "user").alias("role"), _first_key(have, TEXT_KEYS).alias("text"), at.alias("at")).filter("text is not null")


def ledger(spark: SparkSession, path: str, version: int = 1, schema: str = LEDGER) -> tuple[DataFrame, DataFrame]:
    """(rows, skipped): readable lines of the version, and counts of torn and of other lines. A torn line costs itself only."""
    lines = spark.read.text(path).filter(F.trim("value") != "")
    read = lines.select(F.from_json("value", schema + ", _torn string", {"columnNameOfCorruptRecord": "_torn", "allowNonNumericNumbers": "false"}).alias("r")).select("r.*")
    torn = F.col("_torn").isNotNull()
    other = ~torn & ~F.coalesce(F.col("version") == version, F.lit(False))
    return read.filter(~torn & ~other).drop("_torn"), read.agg(F.count_if(torn).alias("torn"), F.count_if(other).alias("other_version"), F.max("id").alias("last_id"))


def write_results(results: DataFrame, metadata: DataFrame, path: str) -> None:
    """Results and what is known of them, as two folders of JSON lines beside each other."""
    results.write.mode("overwrite").json(path)
    metadata.write.mode("overwrite").json(f"{path.rstrip('/')}_metadata")


def write_table(rows: DataFrame, path: str) -> None:
    rows.write.mode("overwrite").option("header", True).option("sep", "\t").csv(path)


def haystacks(words: DataFrame, length: int, needle: str, depth: float = 0.5) -> DataFrame:
    """From doc_id and text: prompts of exactly length words with the needle at a relative depth; a document gives as many as it has whole slices, which do not overlap."""
    own = F.filter(F.split(F.coalesce("text", F.lit("")), r"[ \t\r\n]+"), lambda w: w != "")
    stuck = F.split(F.lit(needle), " ")
    room = length - len(needle.split(" "))
    if room < 1:
        raise ValueError("the needle is longer than the prompt")
    at = int(room * depth)
    cut = words.select("doc_id", own.alias("w")).withColumn("n", F.floor(F.size("w") / room).cast("int")).filter("n > 0")
    each = cut.select("doc_id", "w", F.explode(F.sequence(F.lit(0), F.col("n") - 1)).alias("slice"))
    part = lambda lo, n: F.slice("w", F.col("slice") * room + lo + 1, F.lit(n)) if n else F.array().cast("array<string>")
    return each.select("doc_id", "slice", F.array_join(F.concat(part(0, at), stuck, part(at, room - at)), " ").alias("prompt"))


def line_head(rows: DataFrame, key: str, order: str, n: int) -> DataFrame:
    """The first n rows of each key in order."""
    return rows.withColumn("_n", F.row_number().over(Window.partitionBy(key).orderBy(order))).filter(F.col("_n") <= n).drop("_n")


QA = "array<struct<Q:string,question:string,A:string,answer:string>>"


def nested(rows: DataFrame, top: int | None = None) -> DataFrame:
    """From flat rows (at, title, context, qa_pairs, question, answer): a row for each title with its questions in order.

    qa_pairs is a written list, with single or double quotes; one that cannot be read gives no
    question, and a row without it gives its own question and answer. Rows without a title are
    documents of their own. Most questions first, then longest, then first seen. A title's first row
    gives its text. Pairs of a list are numbered within it, lone questions among all of their title.
    """
    title = F.when(F.coalesce("title", F.lit("")) != "", F.col("title")).otherwise(F.concat(F.lit("unknown_"), F.col("at").cast("string")))
    listed = F.coalesce("qa_pairs", F.lit("")) != ""
    read = F.from_json(F.replace("qa_pairs", F.lit("'"), F.lit('"')), QA)
    first = lambda x, *names: F.coalesce(*[F.when(x[n] != "", x[n]) for n in names], F.lit(""))
    pairs = F.transform(read, lambda x, i: F.struct(i.alias("i"), first(x, "Q", "question").alias("question"), first(x, "A", "answer").alias("answer")))
    lone = F.array(F.struct(F.lit(None).cast("int").alias("i"), F.coalesce("question", F.lit("")).alias("question"), F.coalesce("answer", F.lit("")).alias("answer")))
    each = rows.select("at", title.alias("title"), F.coalesce("context", F.lit("")).alias("context"), F.coalesce(F.when(listed, F.coalesce(pairs, F.slice(lone, 1, 0))), lone).alias("q"))
    by = each.groupBy("title").agg(F.min("at").alias("at"), F.min_by("context", "at").alias("context"), F.flatten(F.transform(F.sort_array(F.collect_list(F.struct("at", "q"))), lambda x: x["q"])).alias("q"))
    named = F.transform("q", lambda x, n: F.struct(F.concat("title", F.lit("__"), F.coalesce(x["i"], n).cast("string")).alias("id"), x["question"].alias("question"), x["answer"].alias("answer")))
    out = by.select("title", "context", X.n_words(F.col("context")).alias("n_words"), F.size("q").alias("n_questions"), named.alias("questions"), "at")
    ordered = out.orderBy(F.desc("n_questions"), F.desc("n_words"), "at").drop("at")
    return ordered if top is None else ordered.limit(top)


def dataset_of(path: Column, said: Column, names: tuple[str, ...]) -> Column:
    """The dataset of a file of samples: what its first record says, else its name, else the known name that its name begins with before _ or -; null if none is known."""
    said = F.lower(said)
    stem = F.lower(F.regexp_replace(F.element_at(F.split(path, "/"), -1), r"(?<=[^/])\.[^.]*$", ""))
    known = F.when(said.isin(*names), said).when(stem.isin(*names), stem)
    for n in names:
        known = known.when(F.startswith(stem, F.lit(f"{n}_")) | F.startswith(stem, F.lit(f"{n}-")), n)
    return known


def sessions(rows: DataFrame, key: str, turn: str, at: str) -> DataFrame:
    """Every conversation with its turns, rows and last time, the latest first."""
    out = rows.groupBy(key).agg(F.countDistinct(turn).alias("n_turns"), F.count("*").alias("n_sentences"), F.max(at).alias("modified"))
    return out.orderBy(F.desc("modified"), key)


#: Tables that a saved session must have, with the columns that they are read by.
SESSION_TABLES = {"rows": ("conv_id", "row_idx", "text"), "coverage": ("conv_id", "node", "level")}


def save_sessions(tables: dict[str, DataFrame], path: str, version: int) -> str:
    """Writes the tables as one version beside earlier ones, which stay whole if the write is lost; returns its folder.

    A version counts once all of its tables carry the writer's mark, so a reader never sees a torn one.
    """
    if missing := set(SESSION_TABLES) - set(tables):
        raise ValueError(f"a session needs {sorted(missing)}")
    folder = f"{path.rstrip('/')}/v{version:08d}"
    for name, rows in tables.items():
        rows.write.mode("overwrite").parquet(f"{folder}/{name}")
    return folder


def load_sessions(spark: SparkSession, path: str) -> dict[str, DataFrame]:
    """The tables of the latest whole version. Raises where there is none, or a table lacks a column it is read by."""
    jvm = spark.sparkContext._jvm.org.apache.hadoop.fs
    root = jvm.Path(path)
    fs = root.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    found = sorted((s.getPath().getName() for s in fs.listStatus(root)), reverse=True) if fs.exists(root) else []
    for v in found:
        if v.startswith("v") and all(fs.exists(jvm.Path(f"{path.rstrip('/')}/{v}/{t}/_SUCCESS")) for t in SESSION_TABLES):
            tables = {t: spark.read.parquet(f"{path.rstrip('/')}/{v}/{t}") for t in SESSION_TABLES}
            for t, need in SESSION_TABLES.items():
                if missing := set(need) - set(tables[t].columns):
                    raise ValueError(f"{t} of {v} lacks {sorted(missing)}")
            return tables
    raise FileNotFoundError(f"no whole version under {path}")
