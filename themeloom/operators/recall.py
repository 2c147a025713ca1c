"""What a conversation's memory decides for one turn: evidence, scope, drift, exclusion, the block and its cap."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T
from . import vectors

# Rows of a source from which it is profiled alone, the scale of its df, rows and smoothing of the drift.
OWN_ROWS, DF_SCALE, DRIFT_ROWS, DRIFT_LEAST, DRIFT_SMOOTH = 3, 1000, 12, 6, 0.3


def weighted_df(kws: DataFrame, rows: DataFrame, keys: list[str], weight: float) -> DataFrame:
    """Document frequency in which keywords of assistant and worker rows count weight. kws: keys, row_idx, kw; rows: keys, row_idx, role."""
    w = F.when(F.col("role").isin("assistant", "worker"), F.lit(float(weight))).otherwise(1.0)
    return kws.join(rows.select(*keys, "row_idx", "role"), [*keys, "row_idx"]).groupBy(*keys, "kw").agg(F.sum(w).alias("df"))


def source_profile(kws: DataFrame, rows: DataFrame, percentile: float = 0.9) -> DataFrame:
    """conv_id, kw, df, is_theme over sources profiled apart.

    rows: conv_id, row_idx, source (null: the conversation). Sources of under OWN_ROWS rows fold into
    the conversation; each bucket's df is rescaled by its largest and merged by the larger; a theme of
    one bucket is a theme. The cut is the df at index int(n * percentile) of a bucket's sorted ones.
    """
    big = rows.groupBy("conv_id", "source").agg(F.count("*").alias("n")).filter((F.col("n") >= OWN_ROWS) & F.col("source").isNotNull()).select("conv_id", "source", F.col("source").alias("bucket"))
    bucketed = rows.join(big, ["conv_id", "source"], "left").select("conv_id", "row_idx", F.coalesce("bucket", F.lit("")).alias("bucket"))
    df = kws.join(bucketed, ["conv_id", "row_idx"]).groupBy("conv_id", "bucket", "kw").agg(F.count("*").alias("df"))
    by = Window.partitionBy("conv_id", "bucket")
    n = F.count("*").over(by)
    at = F.least(F.floor(n * F.lit(percentile)), n - 1) + 1
    ranked = df.withColumn("_at", at).withColumn("_i", F.row_number().over(by.orderBy("df", "kw")))
    cut = F.max(F.when(F.col("_i") == F.col("_at"), F.col("df"))).over(by)
    ranked = ranked.withColumn("is_theme", F.col("df") >= cut).withColumn("scaled", F.greatest(F.bround(DF_SCALE * F.col("df") / F.max("df").over(by), 0).cast("long"), F.lit(1)))
    return ranked.groupBy("conv_id", "kw").agg(F.max("scaled").alias("df"), F.max("is_theme").alias("is_theme"))


def surprisal(n: Column, df: Column) -> Column:
    """ln((n + 1) / (df + 1)), a millionth at least."""
    return F.greatest(F.log((n + 1.0) / (df + 1.0)), F.lit(1e-6))


def lexical_mass(hits: DataFrame, sizes: DataFrame, terms: DataFrame, keys: list[str], query_mass: float = 1.0, has_vector: bool = False) -> DataFrame:
    """Per key and term: df, surprisal and weight of the query's terms.

    hits: keys, term, row_idx that hold the term; sizes: keys, n rows; terms: keys, n_terms of the query.
    The lexical mass is what the found terms' surprisal is of all terms' if each were rare.
    """
    df = hits.groupBy(*keys, "term").agg(F.countDistinct("row_idx").alias("df")).join(sizes, keys).join(terms, keys)
    df = df.withColumn("surprisal", surprisal(F.col("n"), F.col("df")))
    all_of = F.sum("surprisal").over(Window.partitionBy(*keys))
    found = F.least(F.lit(1.0), all_of / F.greatest(F.col("n_terms") * F.log((F.col("n") + 1.0) / 2.0), F.lit(1e-9)))
    mass = F.lit(query_mass * (0.5 if has_vector else 1.0)) * found
    return df.select(*keys, "term", "df", F.round("surprisal", 9).alias("surprisal"), F.round(found, 9).alias("match"), F.round(mass * F.col("surprisal") / all_of, 9).alias("weight"))


#: About so many rows of a group, and queries, meet in one matrix product.
SLICE_ROWS, BLOCK_QUERIES = 8192, 500


def _matrix(held: pa.ListArray, lanes: int) -> tuple[np.ndarray, np.ndarray]:
    """Vectors as rows of doubles, and which of them are whole: neither null, nor of another length, nor with a null lane."""
    sizes = np.asarray(pc.fill_null(pc.list_value_length(held), -1))
    values, out, whole = held.flatten(), np.zeros((len(held), lanes)), sizes == lanes
    ends = np.cumsum(np.maximum(sizes, 0))
    flat = np.asarray(pc.fill_null(pc.cast(values, pa.float64()), 0.0))
    holes = np.concatenate([[0], np.cumsum(np.asarray(values.is_null()))])
    whole &= holes[ends] == holes[ends - np.maximum(sizes, 0)]
    out[whole] = flat[(ends[whole] - lanes)[:, None] + np.arange(lanes)]
    return out, whole


def _nearest(group: str, k: int):
    """For each slice and block: of every query the k largest dot products, as a column ``best``."""

    def found(batches):
        for batch in batches:
            for at in range(batch.num_rows):
                column = lambda c: batch.column(c).slice(at, 1)  # noqa: E731, B023
                asked = column("asked").flatten()
                asked_of, held_of = asked.field("query"), column("held").flatten().field("embedding")
                wide = np.asarray(pc.fill_null(pc.list_value_length(asked_of), -1))
                best = [np.empty(0)] * len(asked)
                for lanes in np.unique(wide[wide >= 0]):
                    q, q_whole = _matrix(asked_of, int(lanes))
                    e, e_whole = _matrix(held_of, int(lanes))
                    near = q[q_whole] @ e[e_whole].T
                    if near.shape[1] > k:
                        near = np.partition(near, near.shape[1] - k, axis=1)[:, -k:]
                    for i, own in zip(np.flatnonzero(q_whole), near, strict=True):
                        best[i] = own
                yield pa.RecordBatch.from_arrays([pa.array(column(group).to_pylist() * len(asked), batch.schema.field(group).type), asked.field("query_id"), pa.array(best, pa.list_(pa.float64()))], [group, "query_id", "best"])

    return found


def top_mean(rows: DataFrame, queries: DataFrame, group: str, k: int = 3) -> DataFrame:
    """group, query_id, top: the mean similarity of the k rows of a group nearest to each query.

    Any number of queries (query_id, query): they are cut into blocks and a group's rows into slices, by
    hashes; each slice meets each block in one product, and k numbers a query leave it.
    """
    n_slices, n_blocks = (max(1, -(-df.count() // n)) for df, n in ((rows, SLICE_ROWS), (queries, BLOCK_QUERIES)))
    dealt = lambda c, n: F.pmod(F.xxhash64(c), F.lit(n))
    slices = rows.groupBy(group, dealt("vec_id", n_slices).alias("_slice")).agg(F.collect_list(F.struct("embedding")).alias("held"))
    blocks = queries.groupBy(dealt("query_id", n_blocks).alias("_block")).agg(F.collect_list(F.struct("query_id", "query")).alias("asked"))
    kinds = {f.name: f.dataType.simpleString() for f in [*rows.schema, *queries.schema]}
    near = slices.crossJoin(F.broadcast(blocks)).select(group, "held", "asked").mapInArrow(_nearest(group, k), f"`{group}` {kinds[group]}, query_id {kinds['query_id']}, best array<double>")
    best = F.slice(F.sort_array(F.flatten(F.collect_list("best")), False), 1, k)
    kept = near.groupBy(group, "query_id").agg(best.alias("best"))
    mean = F.when(F.size("best") > 0, F.aggregate("best", F.lit(0.0), lambda a, x: a + x) / F.size("best"))
    return kept.select(group, "query_id", F.round(mean, 4).alias("top"))


def tail_resident(rows: DataFrame, tail: DataFrame) -> DataFrame:
    """conv_id, row_idx of conversation rows that stand word for word in a message of the tail.

    rows: conv_id, row_idx, text, source; tail: conv_id, turn, text, a bounded number of messages a
    conversation. If every row would go, none does.
    """
    norm = lambda c: F.lower(T.squeeze(F.coalesce(c, F.lit(""))))
    hay = tail.select("conv_id", F.concat(F.lit(" "), norm(F.col("text")), F.lit(" ")).alias("hay"))
    hay = hay.groupBy("conv_id").agg(F.array_join(F.sort_array(F.collect_list("hay")), "\n").alias("hay"))
    line = norm(F.col("text"))
    found = rows.join(hay, "conv_id").withColumn("_in", F.col("source").isNull() & (line != "") & F.contains(F.col("hay"), F.concat(F.lit(" "), line, F.lit(" "))))
    every = F.min(F.col("_in").cast("int")).over(Window.partitionBy("conv_id"))
    return found.withColumn("_all", every).filter("_in and _all = 0").select("conv_id", "row_idx")


def candidates(rows: DataFrame, allowed: DataFrame | None = None, excluded: DataFrame | None = None) -> DataFrame:
    """Rows that may be selected: of the allowed sources, then without the excluded; a filter that would leave a conversation nothing is not applied."""

    def narrowed(found: DataFrame, mark: DataFrame, keys: list[str], inside: bool) -> DataFrame:
        mark = mark.toDF(*[f"_m_{k}" for k in keys]).withColumn("_hit", F.lit(True))
        out = found.join(mark, [F.col(k).eqNullSafe(F.col(f"_m_{k}")) for k in keys], "left").select(*found.columns, "_hit")
        keep = F.col("_hit").isNotNull() if inside else F.col("_hit").isNull()
        some = F.max(keep.cast("int")).over(Window.partitionBy("conv_id"))
        return out.withColumn("_keep", keep).withColumn("_some", some).filter("_keep or _some = 0").drop("_hit", "_keep", "_some")

    if allowed is not None:
        rows = narrowed(rows, allowed.select("conv_id", "source").distinct(), ["conv_id", "source"], True)
    if excluded is not None:
        rows = narrowed(rows, excluded.select("conv_id", "row_idx").distinct(), ["conv_id", "row_idx"], False)
    return rows


def drift(rows: DataFrame, key: str, order: str, vector: str, margin: float = 0.1) -> DataFrame:
    """Per row: its similarity to the mean of the DRIFT_ROWS rows before it, the smoothed baseline, and whether the topic shifted.

    The mean needs DRIFT_LEAST rows. The smoothing is a fold in order, done inside a key's array.
    """
    before = Window.partitionBy(key).orderBy(order).rowsBetween(-DRIFT_ROWS, -1)
    held = rows.withColumn("_w", F.collect_list(vector).over(before))
    sums = F.aggregate(F.slice("_w", 2, DRIFT_ROWS), F.transform(F.get("_w", F.lit(0)), lambda x: x.cast("double")), lambda s, v: F.zip_with(s, v, lambda a, b: a + b.cast("double")))
    near = F.when(F.size("_w") >= DRIFT_LEAST, vectors.dot(sums, F.col(vector)) / F.size("_w"))
    line = held.select(key, order, near.alias("near")).groupBy(key).agg(F.sort_array(F.collect_list(F.struct(F.col(order).alias("at"), "near"))).alias("line"))
    none = F.lit(None).cast("double")

    def step(state: Column, x: Column) -> Column:
        base, near = state["base"], x["near"]
        now = F.struct(x["at"].alias("at"), near.alias("near"), base.alias("baseline"), F.coalesce(near < base - margin, F.lit(False)).alias("shifted"))
        after = F.when(near.isNull(), base).when(base.isNull(), near).otherwise(DRIFT_SMOOTH * near + (1 - DRIFT_SMOOTH) * base)
        return F.struct(after.alias("base"), F.concat(state["out"], F.array(now)).alias("out"))

    start = F.struct(none.alias("base"), F.expr("cast(array() as array<struct<at: bigint, near: double, baseline: double, shifted: boolean>>)").alias("out"))
    return line.select(key, F.inline(F.aggregate("line", start, step, lambda s: s["out"]))).withColumnRenamed("at", order)


def orphan_keys(kept: DataFrame, live: DataFrame, keys: list[str]) -> DataFrame:
    """Coverage kept for nodes that the trie no longer has."""
    return kept.join(live.select(*keys).distinct(), keys, "left_anti")


def projected_coverage(row_coverage: DataFrame, path_rows: DataFrame) -> DataFrame:
    """Rows' coverage on the present trie: for each node the sum over rows whose path runs through it."""
    each = path_rows.join(row_coverage, ["doc_id", "pos"]).select("doc_id", "shown", F.explode(F.transform("path", lambda _, i: F.slice("path", F.lit(1), i + 1))).alias("node"))
    return each.groupBy("doc_id", "node").agg(F.sum("shown").alias("coverage"))


def compacted(tail: DataFrame, key: str, order: str, most: int, least: int) -> DataFrame:
    """The verbatim tail after each turn was added and cut back to 2 * least messages whenever it came over 2 * most.

    With every cut the length falls to 2 * least, so what is left after n messages follows from n alone.
    """
    n = F.count("*").over(Window.partitionBy(key))
    at = F.row_number().over(Window.partitionBy(key).orderBy(order))
    cycle = 2 * most + 1 - 2 * least
    left = F.when(n <= 2 * most, n).otherwise(2 * least + F.pmod(n - (2 * most + 1), F.lit(cycle)))
    return tail.withColumn("_left", left).withColumn("_n", n).withColumn("_at", at).filter("_at > _n - _left").drop("_left", "_n", "_at")


def knee(curve: Column, share: float = 0.3) -> Column:
    """Index of the point of an array of values farthest from the chord, among the first share of it."""
    n = F.size(curve)
    span = lambda hi, lo: F.greatest(hi - lo, F.lit(1e-12))
    first, last = F.get(curve, F.lit(0)), F.get(curve, n - 1)
    far = F.transform(curve, lambda y, i: F.struct(F.abs((y - first) / span(last, first) - i / span((n - 1).cast("double"), F.lit(0.0))).alias("far"), (-i).alias("i")))
    head = F.slice(far, F.lit(1), F.greatest(F.floor(n * F.lit(share)).cast("int"), F.lit(1)) + 1)
    return F.when(n < 3, F.greatest(n - 1, F.lit(0))).otherwise(-F.array_max(head)["i"])


def mean_curve(rows: DataFrame, key: str, order: str, vector: str) -> DataFrame:
    """Per row in order: the similarity of the mean so far to the mean of all. Lanes are summed apart, so no key meets in one task."""
    lanes = rows.select(key, order, F.posexplode(vector).alias("lane", "x")).select(key, order, "lane", F.col("x").cast("double").alias("x"))
    now = Window.partitionBy(key, "lane").orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    sums = lanes.withColumn("s", F.sum("x").over(now)).withColumn("t", F.sum("x").over(Window.partitionBy(key, "lane")))
    dots = sums.groupBy(key, order).agg(F.sum(F.col("s") * F.col("t")).alias("st"), F.sum(F.col("s") * F.col("s")).alias("ss"), F.sum(F.col("t") * F.col("t")).alias("tt"))
    return dots.select(key, order, F.when(F.col("ss") * F.col("tt") > 0, F.col("st") / F.sqrt(F.col("ss") * F.col("tt"))).otherwise(0.0).alias("cos"))


def year_candidates(rows: DataFrame, key: str, ts: str, anchor: int) -> DataFrame:
    """Years in which a named day is tried: those with rows, latest first, the anchor's last."""
    years = rows.groupBy(key).agg(F.reverse(F.array_sort(F.collect_set(F.year(ts)))).alias("years"))
    return years.select(key, F.array_distinct(F.concat("years", F.array(F.lit(anchor)))).alias("years"))


def memory_block(rows: DataFrame, key: str, cap: int) -> DataFrame:
    """Per key: the rows in order under headings of their source, as many as fit cap words, with what was cut from the front.

    rows: key, row_idx, source (null: the conversation), text, n_words. The latest rows stay.
    """
    after = Window.partitionBy(key).orderBy(F.desc("row_idx")).rowsBetween(Window.unboundedPreceding, 0)
    kept = rows.withColumn("_w", F.sum("n_words").over(after)).withColumn("_all", F.sum("n_words").over(Window.partitionBy(key)))
    fits = kept.filter(F.col("_w") <= cap)
    line = F.struct("row_idx", F.concat(F.lit("- "), F.col("text")).alias("line"))
    by = fits.groupBy(key, F.coalesce("source", F.lit("")).alias("source")).agg(F.array_join(F.transform(F.sort_array(F.collect_list(line)), lambda x: x["line"]), "\n").alias("lines"), F.sum("n_words").alias("words"), F.max("_all").alias("all_words"))
    head = F.when(F.col("source") == "", "Earlier in this conversation:").otherwise(F.concat(F.lit("From "), F.col("source"), F.lit(":")))
    parts = by.select(key, "words", "all_words", F.struct("source", F.concat(head, F.lit("\n"), "lines").alias("part")).alias("p"))
    return parts.groupBy(key).agg(F.array_join(F.transform(F.sort_array(F.collect_list("p")), lambda x: x["part"]), "\n\n").alias("block"), F.sum("words").alias("words"), (F.max("all_words") - F.sum("words")).alias("cut_words"))


def merged_anchors(anchors: DataFrame, picked: DataFrame, key: str, budget: Column) -> DataFrame:
    """Anchored units first, then the others by rank while they fit the budget: key, pos, anchored. A unit that is both counts once.

    anchors: key, pos, n_words; picked: key, pos, n_words, rank. Units are taken in rank order up to
    the first that does not fit.
    """
    others = picked.join(anchors.select(key, "pos"), [key, "pos"], "left_anti").select(key, "pos", "n_words", F.lit(False).alias("anchored"), (F.col("rank") + 1).alias("rank"))
    both = anchors.select(key, "pos", "n_words", F.lit(True).alias("anchored"), F.lit(0).alias("rank")).unionByName(others)
    so_far = Window.partitionBy(key).orderBy("rank", "pos").rowsBetween(Window.unboundedPreceding, 0)
    return both.withColumn("_w", F.sum("n_words").over(so_far)).filter(F.col("anchored") | (F.col("_w") <= budget)).select(key, "pos", "anchored")
