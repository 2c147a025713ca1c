"""The ordered filter of units: exempt, junk, addresses, report lines, repeats."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import chat as C
from ..functions import text as T

KEPT, JUNK, ADDRESS, REPORT, REPEAT = "kept", "junk", "url", "aggressive", "repeat"


def fates(units: DataFrame, aggressive: bool = False, remove_urls: bool = True, strip_urls: bool = False, deduplicate: bool = True, lenient: bool = False, keep: Column | None = None) -> DataFrame:
    """units (doc_id, pos, unit) with the text that goes on and its fate: the first rule that drops it, or kept.

    With strip_urls an address becomes a placeholder, and only a unit that is mostly address goes. A
    unit for which keep is true passes all rules but that against repeats; null counts as false. The
    rule against repeats looks at what the others left, after the placeholders. All rules before it
    are of the row alone; it is the only step by document.
    """
    text = F.coalesce("unit", F.lit(""))
    exempt = F.lit(False) if keep is None else F.coalesce(keep, F.lit(False))
    junk = T.is_junk(text, lenient)
    linked = C.has_url(text) if remove_urls else F.lit(False)
    gone = linked & C.url_dominated(text) if strip_urls else linked
    fate = F.when(exempt, KEPT).when(junk, JUNK).when(gone, ADDRESS)
    shown = F.when(linked & fate.isNull(), C.url_placeholder(text)).otherwise(text) if strip_urls else text
    if aggressive:
        fate = fate.when(C.report_junk(shown), REPORT)
    out = units.withColumns({"fate": fate.otherwise(KEPT), "unit": shown})
    if not deduplicate:
        return out
    order = Window.partitionBy("doc_id", "fate", "_key").orderBy("pos")
    again = (F.col("fate") == KEPT) & (F.row_number().over(order) > 1)
    return out.withColumn("_key", T.dedup_key(F.col("unit"))).withColumn("fate", F.when(again, REPEAT).otherwise(F.col("fate"))).drop("_key")


def counters(judged: DataFrame) -> DataFrame:
    """Per document: units kept and dropped by each rule."""
    count = lambda fate, name: F.count_if(F.col("fate") == fate).alias(name)
    return judged.groupBy("doc_id").agg(count(KEPT, "n_kept"), count(JUNK, "n_junk"), count(ADDRESS, "n_url"), count(REPORT, "n_aggressive"), count(REPEAT, "n_dedup"))
