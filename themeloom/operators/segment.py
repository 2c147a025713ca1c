"""Documents to units: sentences in order, the first of equal ones kept."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T


def spread(rows: DataFrame) -> DataFrame:
    """Rows of a scan with fewer splits than cores, dealt over all of them; other scans as they are."""
    cores = rows.sparkSession.sparkContext.defaultParallelism
    return rows.repartition(cores) if rows.rdd.getNumPartitions() < cores else rows


def sentences(docs: DataFrame) -> DataFrame:
    """doc_id, pos (from 0, gaps where repeats were), unit.

    Units are shuffled once, by document. All windows, groups and joins by document that follow keep
    that partitioning, and branches of one plan share its exchange, so texts are split once.
    """
    docs.sparkSession.conf.set("spark.sql.requireAllClusterKeysForCoPartition", "false")
    parts = T.sentence_parts(F.coalesce("text", F.lit("")))
    keyed = spread(docs.select("doc_id", "text")).select("doc_id", F.posexplode(parts).alias("pos", "unit")).repartition("doc_id")
    first = Window.partitionBy("doc_id", F.lower("unit")).orderBy("pos")
    return keyed.withColumn("_n", F.row_number().over(first)).filter("_n = 1").drop("_n")


def filtered(units: DataFrame) -> DataFrame:
    """Units that are not junk, the first of each dedup key, with n_words."""
    kept = units.filter(~T.is_junk(F.col("unit"))).withColumn("key", T.dedup_key(F.col("unit")))
    first = Window.partitionBy("doc_id", "key").orderBy("pos")
    return kept.withColumn("_n", F.row_number().over(first)).filter("_n = 1").select("doc_id", "pos", "unit", T.n_words(F.col("unit")).alias("n_words"))


def filter_counts(units: DataFrame) -> DataFrame:
    """Per document: units, junk, repeats, kept."""
    marked = units.withColumn("junk", T.is_junk(F.col("unit"))).withColumn("key", T.dedup_key(F.col("unit")))
    first = Window.partitionBy("doc_id", "junk", "key").orderBy("pos")
    marked = marked.withColumn("again", ~F.col("junk") & (F.row_number().over(first) > 1))
    return marked.groupBy("doc_id").agg(
        F.count("*").alias("n_units"), F.count_if("junk").alias("n_junk"), F.count_if("again").alias("n_repeats"), F.count_if(~F.col("junk") & ~F.col("again")).alias("n_kept")
    )


def keywords(units: DataFrame) -> DataFrame:
    """doc_id, pos, kw: the content words of each unit."""
    return units.select("doc_id", "pos", F.explode(T.content_words(F.col("unit"))).alias("kw"))
