"""Chat formatting by quotation linking, with DataFrame functions only.

A line's quote level is the number of ``>`` that open it. Lines of a message at level 0 are its own;
runs of lines at one level are quoted passages. A passage is normalised (markers off, blanks
squeezed, lower case) and hashed, as a whole and line by line, and joined on (conversation, hash)
to the first message of the conversation that has that line, or that whole, as its own. The
message that most passages of the lowest quoted level with a match come from, the latest of equals,
is the one replied to; it must be an earlier turn. A passage quoted at several levels counts at the lowest. Replies are followed up to the message that starts the
thread by pointer doubling, and conversations are ordered by thread start, then turn, so a message
stands after what it replies to, with its own lines only.

Common lines are summed before they are joined (the first turn of each hash), so a line that many
messages have or quote gives one row, not pairs; no conversation is collected anywhere.

Defined cases: a null text has no lines and an empty body; a message without linked quotes starts a
thread of its own place in the main line (root_turn is its turn); quotes of nothing known are
dropped from the body all the same; null conv_ids are one conversation; rows that repeat a turn are
each given; very long texts are parsed whole; other columns are not read, so their names may clash;
an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Scratch, text_of

MARKS = r"^(?:[ \t]*>)+[ \t]?"


def _level(line: Column) -> Column:
    return F.length(F.regexp_replace(F.regexp_extract(line, r"^((?:[ \t]*>)*)", 1), "[^>]", ""))


def _plain(text: Column) -> Column:
    return F.lower(F.trim(F.regexp_replace(text, r"[ \t\r\n]+", " ")))


def _bare(line: Column) -> Column:
    return F.regexp_replace(line, MARKS, "")


def parsed(messages: DataFrame) -> DataFrame:
    """conv_id, turn, role, body (own lines), levels, and quotes: struct(level, passage) of each run of quoted lines."""
    lines = F.split(text_of("text"), "\n", -1)
    d = messages.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), F.col("role").cast("string").alias("role"), lines.alias("lines"))
    own = F.filter("lines", lambda x: ~x.rlike(r"^[ \t]*>"))
    d = d.withColumn("body", F.regexp_replace(F.regexp_replace(F.array_join(own, "\n"), r"^\s+|\s+$", ""), r"\n{3,}", "\n\n"))
    d = d.withColumn("has", F.exists("lines", lambda x: x.rlike(r"^[ \t]*>")))
    marked = F.transform("lines", lambda x: F.struct(_level(x).alias("level"), _plain(_bare(x)).alias("text")))
    d = d.withColumn("lines", F.when(F.col("has"), marked).otherwise(F.array().cast("array<struct<level:int,text:string>>")))
    grown = "aggregate(lines, array(), (a, x) -> if(x.level = 0, concat(a, array(named_struct('level', 0, 'passage', ''))), if(size(a) > 0 and element_at(a, -1).level = x.level, concat(slice(a, 1, size(a) - 1), array(named_struct('level', x.level, 'passage', trim(concat(element_at(a, -1).passage, ' ', x.text))))), concat(a, array(named_struct('level', x.level, 'passage', x.text))))))"
    typed = grown.replace("array(),", "cast(array() as array<struct<level:int,passage:string>>),", 1)
    d = d.withColumn("passages", F.filter(F.expr(typed), lambda p: (p["level"] > 0) & (p["passage"] != "")))
    quoted = F.filter("lines", lambda x: (x["level"] > 0) & (x["text"] != ""))
    return d.withColumn("quoted", quoted).withColumn("levels", F.coalesce(F.array_max(F.transform("lines", lambda x: x["level"])), F.lit(0))).drop("lines", "has")


def originals(d: DataFrame, wanted: DataFrame) -> DataFrame:
    """conv_id, hash, first_turn of the lines and bodies that someone quotes."""
    own = F.transform(F.filter(F.split("body", "\n"), lambda x: _plain(x) != ""), lambda x: F.md5(_plain(x)))
    keys = d.select("conv_id", "turn", F.explode(F.array_distinct(F.concat(own, F.array(F.md5(_plain(F.col("body"))))))).alias("hash"))
    return keys.join(wanted.select("conv_id", "hash").distinct().withColumnRenamed("conv_id", "_conv"), F.col("conv_id").eqNullSafe(F.col("_conv")) & (keys["hash"] == wanted["hash"]), "left_semi").groupBy("conv_id", "hash").agg(F.min("turn").alias("first_turn"))


def link(d: DataFrame) -> DataFrame:
    """conv_id, turn, reply_to, n_linked of the messages whose quotes are found."""
    lines = F.transform("quoted", lambda x: F.struct(F.md5(x["text"]).alias("hash"), x["level"].alias("level")))
    runs = F.transform("passages", lambda x: F.struct(F.md5(x["passage"]).alias("hash"), x["level"].alias("level")))
    q = d.filter(F.size("quoted") > 0).select("conv_id", "turn", F.explode(F.array_distinct(F.concat(lines, runs))).alias("quote"))
    wanted = q.groupBy("conv_id", "turn", F.col("quote.hash").alias("hash")).agg(F.min("quote.level").alias("level"))
    first = originals(d, wanted).withColumnRenamed("conv_id", "_conv").withColumnRenamed("hash", "_hash")
    found = wanted.join(first, F.col("conv_id").eqNullSafe(F.col("_conv")) & (F.col("hash") == F.col("_hash")) & (F.col("first_turn") < F.col("turn")))
    votes = found.groupBy("conv_id", "turn", "level", "first_turn").agg(F.count("*").alias("n"))
    return votes.groupBy("conv_id", "turn").agg(F.max(F.struct(-F.col("level"), "n", "first_turn"))["first_turn"].alias("reply_to"), F.sum("n").alias("n_linked"))


def threads(links: DataFrame, scratch: Scratch) -> DataFrame:
    """Adds root_turn and depth: what the chain of replies leads to, and its length."""
    at = scratch.cut(links.select("*", F.col("reply_to").alias("root_turn"), F.lit(1).alias("depth")), "links")
    while True:
        up = at.select(F.col("conv_id").alias("_conv"), F.col("turn").alias("_turn"), F.col("root_turn").alias("_root"), F.col("depth").alias("_depth"))
        step = at.join(up, F.col("conv_id").eqNullSafe(F.col("_conv")) & (F.col("root_turn") == F.col("_turn")), "left")
        new = scratch.cut(step.select("conv_id", "turn", "reply_to", "n_linked", F.coalesce("_root", "root_turn").alias("root_turn"), (F.col("depth") + F.coalesce("_depth", F.lit(0))).alias("depth"), F.col("_root").isNotNull().alias("moved")), "links")
        scratch.drop(at)
        if new.filter("moved").isEmpty():
            return new.drop("moved")
        path, at = new._scratch_path, new.drop("moved")
        at._scratch_path = path


def chat_turns(messages: DataFrame) -> DataFrame:
    """conv_id, root_turn, turn, role, reply_to, depth, n_levels, n_quoted, n_linked, body; one row for each row of messages.

    Sorted by (conv_id, root_turn, turn) this is the conversation in reply order, without quotes.
    """
    scratch = Scratch(messages.sparkSession, "chat")
    d = parsed(messages)
    up = threads(link(d), scratch).select(F.col("conv_id").alias("_conv"), F.col("turn").alias("_turn"), "reply_to", "n_linked", "root_turn", "depth")
    out = d.join(up, F.col("conv_id").eqNullSafe(F.col("_conv")) & (F.col("turn") == F.col("_turn")), "left")
    return out.select("conv_id", F.coalesce("root_turn", "turn").alias("root_turn"), "turn", "role", "reply_to", F.coalesce("depth", F.lit(0)).cast("int").alias("depth"), F.col("levels").cast("int").alias("n_levels"), F.size("quoted").alias("n_quoted"), F.coalesce("n_linked", F.lit(0)).cast("long").alias("n_linked"), "body")


def rendered(turns: DataFrame, template: str = "<|{role}|>\n{body}\n") -> DataFrame:
    """Adds formatted: a turn in a chat template's words."""
    head, tail = template.split("{role}")
    middle, tail = tail.split("{body}")
    return turns.withColumn("formatted", F.concat(F.lit(head), F.coalesce("role", F.lit("user")), F.lit(middle), F.col("body"), F.lit(tail)))
