"""Operators over unit vectors. A query vector is broadcast; rows are never paired all with all."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def dot(a: Column, b: Column) -> Column:
    products = F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double"))
    return F.aggregate(products, F.lit(0.0), lambda s, x: s + x)


def topk(rows: DataFrame, query: DataFrame, k: int) -> DataFrame:
    """The k rows nearest to the one query vector; the query is one row."""
    q = query.select(F.col("embedding").alias("q")).limit(1)
    scored = rows.join(F.broadcast(q)).withColumn("cos", dot(F.col("embedding"), F.col("q")))
    return scored.orderBy(F.desc("cos"), "vec_id").limit(k).select("vec_id", F.round("cos", 6).alias("cos"))


def branch_scores(rows: DataFrame, query: DataFrame) -> DataFrame:
    """Per branch: rows, centroid and peak similarity to the query (at least 0)."""
    q = query.select(F.col("embedding").alias("q")).limit(1)
    scored = rows.join(F.broadcast(q)).withColumn("cos", dot(F.col("embedding"), F.col("q")))
    peaks = scored.groupBy("label").agg(F.count("*").alias("n_rows"), F.max("cos").alias("peak"))
    parts = scored.select("label", F.posexplode("embedding").alias("i", "x"), F.col("q"))
    mean = parts.groupBy("label", "i").agg(F.avg(F.col("x").cast("double")).alias("m"), F.first(F.get("q", F.col("i"))).cast("double").alias("q"))
    centre = mean.groupBy("label").agg((F.sum(F.col("m") * F.col("q")) / F.sqrt(F.sum(F.col("m") * F.col("m")))).alias("centroid"))
    return peaks.join(centre, "label").select("label", "n_rows", F.round(F.greatest("centroid", F.lit(0.0)), 6).alias("centroid"), F.round("peak", 6).alias("peak"))


def scope(scores: DataFrame, near: float = 0.02, peak: float = 0.10) -> DataFrame:
    """Branches close to the best centroid or the best peak."""
    everything = Window.partitionBy(F.lit(1))
    c, p = F.max("centroid").over(everything), F.max("peak").over(everything)
    return scores.withColumn("kept", (F.col("centroid") >= c - near) | (F.col("peak") >= p - peak)).select("label", "kept")


def rescaled_relevance(rows: DataFrame, query: DataFrame) -> DataFrame:
    """max(0, cos - median) over its largest."""
    q = query.select(F.col("embedding").alias("q")).limit(1)
    scored = rows.join(F.broadcast(q)).select("vec_id", dot(F.col("embedding"), F.col("q")).alias("cos"))
    middle = scored.agg(F.expr("percentile(cos, 0.5)").alias("mid"), F.max("cos").alias("top"))
    over = F.greatest(F.col("cos") - F.col("mid"), F.lit(0.0)) / (F.col("top") - F.col("mid"))
    return scored.join(F.broadcast(middle)).select("vec_id", F.round(over, 6).alias("rel"))


def near_dup_gate(rows: DataFrame, tau: float) -> DataFrame:
    """Keep-first within a branch: a row within tau of an earlier kept one is let go."""

    def gate(part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values("vec_id")
        kept, flags = [], []
        for v in part["embedding"]:
            v = np.asarray(v, np.float32)
            hit = bool(kept) and float(np.max(np.stack(kept) @ v)) >= tau
            flags.append(not hit)
            if not hit:
                kept.append(v)
        return pd.DataFrame({"vec_id": part["vec_id"], "label": part["label"], "kept": flags})

    return rows.groupBy("label").applyInPandas(gate, "vec_id long, label int, kept boolean")
