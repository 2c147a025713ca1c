"""Page lines of laid-out documents: repeated headers and footers, table lines."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T

ZONE, LEAST_PAGES, SHARE = 3, 3, 0.5
NUMERIC = r"^[+\-]?[$€£]?\(?\d[\d.,]*%?\)?$"


def page_lines(pages: DataFrame, doc_col: str, page_col: str, text_col: str) -> DataFrame:
    """doc, page, pos, line."""
    return pages.select(F.col(doc_col).alias("doc"), F.col(page_col).alias("page"), F.posexplode(F.split(F.coalesce(text_col, F.lit("")), "\n")).alias("pos", "line"))


def without_furniture(rows: DataFrame) -> DataFrame:
    """Lines that are not repeated at the top or bottom of at least half of a document's pages (three at least), nor bare page numbers there.

    Numbers do not tell lines apart, so 'Page 3' repeats 'Page 11'.
    """
    page = Window.partitionBy("doc", "page")
    n = F.count("*").over(page)
    zone = F.least(F.lit(ZONE), F.greatest(F.lit(1), F.floor(n / 3)))
    marked = rows.withColumn("_edge", (F.col("pos") < zone) | (F.col("pos") >= n - zone)).withColumn("_print", F.regexp_replace(F.lower(F.trim("line")), r"\d+", "#"))
    total = rows.groupBy("doc").agg(F.countDistinct("page").alias("_pages"))
    seen = marked.filter("_edge and _print != ''").groupBy("doc", "_print").agg(F.countDistinct("page").alias("_on"))
    again = seen.join(total, "doc").filter(F.col("_on") >= F.greatest(F.lit(LEAST_PAGES), F.floor(F.col("_pages") * F.lit(SHARE)))).select("doc", "_print", F.lit(True).alias("_edge"))
    kept = marked.join(again, ["doc", "_print", "_edge"], "left_anti")
    return kept.filter(~(F.col("_edge") & F.col("line").rlike(r"^\s*[-–—]?\s*(?:[Pp]age\s+)?\d{1,4}\s*(?:of\s+\d+)?\s*[-–—]?\s*$"))).select("doc", "page", "pos", "line")


def table_line(line: Column) -> Column:
    """Six tokens or more, half of them numbers."""
    tokens = F.filter(F.split(line, r"[ \t\r\n]+"), lambda w: w != "")
    return (F.size(tokens) >= 6) & (2 * F.size(F.filter(tokens, lambda w: w.rlike(NUMERIC))) >= F.size(tokens))


def table_runs(rows: DataFrame, chunk: int = 6) -> DataFrame:
    """Runs of two or more table lines of a page as units of at most chunk lines: doc, page, run, part, n_lines, unit."""
    order = Window.partitionBy("doc", "page").orderBy("pos")
    marked = rows.withColumn("is_row", table_line(F.col("line")))
    marked = marked.withColumn("run", F.sum((~F.col("is_row")).cast("int")).over(order.rowsBetween(Window.unboundedPreceding, 0))).filter("is_row")
    within = Window.partitionBy("doc", "page", "run")
    marked = marked.withColumn("n", F.count("*").over(within)).filter("n >= 2").withColumn("part", F.floor((F.row_number().over(within.orderBy("pos")) - 1) / chunk))
    text = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("pos", "line"))), lambda x: T.squeeze(x["line"])), "\n")
    return marked.groupBy("doc", "page", "run", "part").agg(F.count("*").alias("n_lines"), text.alias("unit"))
