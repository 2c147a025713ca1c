"""The corpus pipeline: toxicity, quality rules, near-dedup, mixing, packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last return the columns
of documents, so each reads what its predecessor wrote. ``run`` applies them to documents.

Defined cases: null and empty texts have no word, so the quality rules drop them; repeated rows are
judged each, are one node in near-dedup (which keeps the rows of the least id) and stand in the
mixture each; ties are settled by the operators as their docstrings say; very long texts pass whole;
other columns are carried along by place until packing, so names may clash; an empty table, or one of
which a stage drops everything, gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from themeloom.llm import mixing, near_dedup, packing, quality_rules, toxicity
from themeloom.llm.common import Scratch, table


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return toxicity.keep(docs, table(spark, sf_dir, "labels"))


def drop_low_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return quality_rules.keep(docs)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return near_dedup.keep(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.mix(docs)


def pack_windows(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack(docs, chunk=1 << 20)  # beside what the other stages leave in an executor


STAGES = [
    ("toxicity", drop_toxic),
    ("quality rules", drop_low_quality),
    ("minhash near-dedup", drop_near_duplicates),
    ("mixing", mix_sources),
    ("packing", pack_windows),
]

#: Trained scores and tokenizers are beyond SQL. A test runs all of it and holds what each stage keeps, and the packed ids, against plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages; what one keeps is written to the shared folder and reread by the next."""
    scratch = Scratch(spark, "pipeline")
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        kept = scratch.cut(stage(spark, docs, sf_dir), name.replace(" ", "-"))
        scratch.drop(docs)  # what the stage before wrote is not read again
        docs = kept
    return STAGES[-1][1](spark, docs, sf_dir)
