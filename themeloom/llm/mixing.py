"""Mixing sources to target sizes by systematic sampling, with DataFrame functions only.

Every document of a source expects ``target / source_size`` copies. The source's documents stand in
one line, their expected copies are prefix-summed, one offset in [0, 1) is added, and a document is
emitted once for each integer that its stretch of the line crosses. The line goes by size class
first, so every class is taken in proportion and the words taken come close to the target. The
expected copies of a source's documents are equal, so the prefix sum is the rate times an exact
integer rank and has no rounding that grows along the line.

No source meets in one task: a line is cut into (source, size class, slice of a hash), ranks are
taken inside a slice, and slices get their starting ranks from prefix sums over slices within a
class and over classes within a source. Only one row a source is ever ordered globally.

Targets: sources by code point, null last, weigh 1, 2, 3, repeating. Shares stop at ``cap`` times a
source's size and the excess is shared again by weight until none is above; the fixed point of that
is a water level t with target = min(cap * size, weight * t), which prefix sums over the sources
sorted by cap * size / weight give at once.

The one offset of a source is drawn from a hash of the seed and the source, so every document has the
same chance of each copy. What is taken misses a source's target by about one copy of its longest
documents at most, which shows only in sources of few documents.

Defined cases: a null text has size 0; null is a source of its own; if all sizes are 0 every target
is 0 and nothing is taken; an empty table gives an empty result; repeated rows stand in line each;
equal hashes go by doc_id, then size; very long texts only count as their size; columns besides id,
source and text are not read (``mix`` carries them along by place, so names may clash). Reruns agree:
nothing depends on partitions or on chance.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import WORD_PATTERN, Scratch, text_of

WEIGHTS, CAP, SEED = (1, 2, 3), 3, "mix"
#: Rows that one slice of a line may hold, about.
SLICE = 20_000
#: Rows of the tables by source and class that are broadcast, some MB.
BROADCAST_ROWS = 100_000


def words_in(text: Column) -> Column:
    return F.regexp_count(text, F.lit(WORD_PATTERN)).cast("long")


def _hash32(text: Column) -> Column:
    return F.conv(F.substring(F.md5(text), 1, 8), 16, 10).cast("long")


def targets(by_source: DataFrame, weights=WEIGHTS, cap: int = CAP) -> DataFrame:
    """From source and source_size (one row each): adds weight and target."""
    everything = Window.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    ordered = Window.orderBy(F.col("source").isNull(), F.col("source"))
    cycle = F.array(*[F.lit(float(w)) for w in weights])
    w = by_source.withColumn("weight", F.element_at(cycle, (F.pmod(F.row_number().over(ordered) - 1, F.lit(len(weights))) + 1).cast("int")))
    w = w.withColumn("most", F.col("source_size") * F.lit(float(cap))).withColumn("at", F.col("most") / F.col("weight"))
    line = Window.orderBy("at", F.col("source").isNull(), "source")
    before = line.rowsBetween(Window.unboundedPreceding, -1)
    w = w.withColumn("total", F.sum("source_size").over(everything).cast("double")).withColumn("all_weight", F.sum("weight").over(everything))
    left = F.col("total") - F.coalesce(F.sum("most").over(before), F.lit(0.0))
    level = left / (F.col("all_weight") - F.coalesce(F.sum("weight").over(before), F.lit(0.0)))
    w = w.withColumn("level", level)
    w = w.withColumn("level", F.min(F.when(F.col("at") >= F.col("level"), F.struct("at", "level"))).over(everything)["level"])
    return w.select("source", "source_size", "weight", F.least(F.col("most"), F.col("weight") * F.coalesce(F.col("level"), F.lit(0.0))).alias("target"))


def plan(docs: DataFrame, scratch: Scratch, weights=WEIGHTS, cap: int = CAP, seed: str = SEED, slice_rows: int = SLICE) -> DataFrame:
    """From rows with _id, _source and _size: adds source_size, target, copies. Other columns are carried along."""
    rows = docs.withColumn("_bits", F.expr("length(bin(_size))"))
    rows = rows.withColumn("_class", F.expr("cast(_bits * 8 + (shiftright(shiftleft(_size, 3), _bits - 1) & 7) as int)")).drop("_bits")
    key = F.coalesce(F.col("_source"), F.lit(""))
    rows = rows.withColumn("_hash", _hash32(F.concat_ws("|", F.lit(seed), F.coalesce(F.col("_id").cast("string"), F.lit("")))))
    rows = rows.withColumn("_none", F.col("_source").isNull()).withColumn("_key", key)
    classes = rows.groupBy("_none", "_key", "_class").agg(F.count("*").alias("_rows"), F.sum("_size").alias("_words"))
    by_source = classes.groupBy("_none", "_key").agg(F.sum("_words").alias("source_size"))
    wanted = targets(by_source.select(F.when(~F.col("_none"), F.col("_key")).alias("source"), "source_size"), weights, cap)
    offset = _hash32(F.concat_ws("|", F.lit(seed), F.lit("offset"), F.coalesce(F.col("source"), F.lit(""))))
    wanted = wanted.select(F.col("source").isNull().alias("_none"), F.coalesce("source", F.lit("")).alias("_key"), "source_size", "target", F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0).alias("_rate"), offset.alias("_offset"))
    first = Window.partitionBy("_none", "_key").orderBy("_class").rowsBetween(Window.unboundedPreceding, -1)
    starts = classes.withColumn("_class_start", F.coalesce(F.sum("_rows").over(first), F.lit(0)))
    starts = starts.withColumn("_slices", F.ceil(F.col("_rows") / slice_rows)).join(wanted, ["_none", "_key"]).drop("_words", "_rows")
    sliced = rows.join(_small(scratch.cut(starts, "starts")), ["_none", "_key", "_class"]).withColumn("_slice", F.expr("cast(floor(_hash * _slices / 4294967296D) as int)"))
    return _ranked(sliced).withColumn("copies", _copies()).drop("_none", "_key", "_rank", "_rate", "_offset")


def _small(rows: DataFrame) -> DataFrame:
    """A row a source or class is broadcast up to a counted size; past it the join shuffles."""
    return F.broadcast(rows) if rows.count() <= BROADCAST_ROWS else rows


def _copies() -> Column:
    """Integer boundaries that a row's stretch crosses, after the offset."""
    start = F.col("_offset") / F.lit(float(1 << 32))
    upto = lambda r: F.floor(F.col("_rate") * r + start)
    return (upto(F.col("_rank")) - upto(F.col("_rank") - 1)).cast("long")


def _ranked(sliced: DataFrame) -> DataFrame:
    keys = ["_none", "_key", "_class", "_slice"]
    sizes = sliced.filter("_slices > 1").groupBy(*keys).agg(F.count("*").alias("_n"))
    before = Window.partitionBy("_none", "_key", "_class").orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)
    sizes = sizes.withColumn("_slice_start", F.coalesce(F.sum("_n").over(before), F.lit(0))).drop("_n")
    inside = Window.partitionBy(*keys).orderBy("_hash", "_id", "_size")
    out = sliced.withColumn("_at", F.row_number().over(inside)).join(sizes, keys, "left")
    rank = F.col("_at") + F.col("_class_start") + F.coalesce(F.col("_slice_start"), F.lit(0))
    return out.withColumn("_rank", rank).drop("_class", "_slice", "_hash", "_at", "_class_start", "_slice_start", "_slices")


def _narrow(docs: DataFrame, id_col: str, source_col: str, text_col: str) -> DataFrame:
    return docs.select(F.col(id_col).cast("long").alias("_id"), F.col(source_col).cast("string").alias("_source"), words_in(text_of(text_col)).alias("_size"))


def mix_plan(docs: DataFrame, weights=WEIGHTS, cap: int = CAP, seed: str = SEED, id_col: str = "doc_id", source_col: str = "source", text_col: str = "text") -> DataFrame:
    """doc_id, source, size, source_size, target, copies, taken; one row for each row of docs.

    The texts are read once: sizes go to a narrow table in the shared folder and all else reads that.
    """
    scratch = Scratch(docs.sparkSession, "mixing")
    out = plan(scratch.cut(_narrow(docs, id_col, source_col, text_col), "sizes"), scratch, weights, cap, seed)
    return out.select(F.col("_id").alias("doc_id"), F.col("_source").alias("source"), F.col("_size").alias("size"), "source_size", "target", "copies", (F.col("copies") * F.col("_size")).alias("taken"))


def mix(docs: DataFrame, weights=WEIGHTS, cap: int = CAP, seed: str = SEED, id_col: str = "doc_id", source_col: str = "source", text_col: str = "text") -> DataFrame:
    """The mixture itself: every row of docs, with all its columns, as often as it is emitted."""
    inner = docs.toDF(*[f"_c{i}" for i in range(len(docs.columns))])
    at = {c: f"_c{docs.columns.index(c)}" for c in (id_col, source_col, text_col)}
    rows = inner.select("*", F.col(at[id_col]).cast("long").alias("_id"), F.col(at[source_col]).cast("string").alias("_source"), words_in(text_of(at[text_col])).alias("_size"))
    out = plan(rows, Scratch(docs.sparkSession, "mixing"), weights, cap, seed).filter("copies > 0")
    out = out.withColumn("_copy", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int"))))
    return out.select(*[F.col(f"_c{i}").alias(c) for i, c in enumerate(docs.columns)])
