"""What a reviewer's runs on odd inputs and larger tables found."""

import datetime as dt
import random

import duckdb
import pytest

from pyspark.sql import functions as F

from themeloom.functions import chat as C
from themeloom.functions import forms
from themeloom.functions import text as T
from themeloom.operators import fewshot, legacy_select, segment, select, themes
from themeloom.plans import catalogue, further, wider


def both(spark, folder, name):
    """Rows of a query and of its SQL on the tables of a folder."""
    con = duckdb.connect()
    for f in folder.glob("*.parquet"):
        con.execute(f"CREATE VIEW {f.stem} AS SELECT * FROM '{f}{'/*.parquet' if f.is_dir() else ''}'")
    want = con.execute(catalogue.oracle_sql()[name])
    columns = [c[0] for c in want.description]
    return sorted(map(repr, (tuple(r) for r in catalogue.queries()[name](spark, str(folder)).select(columns).collect()))), sorted(map(repr, want.fetchall()))


@pytest.fixture
def folder(tmp_path):
    return tmp_path


def test_sliding_days_takes_times_to_the_nearest_second(spark, folder):
    at = dt.datetime(2024, 1, 8, 17, 59, 59)
    micros = [0, 499_999, 500_000, 500_001, 999_999, 1_500_000]
    rows = [(i, at + dt.timedelta(microseconds=m)) for i, m in enumerate(micros)]
    spark.createDataFrame(rows, "event_id long, ts timestamp_ntz").write.parquet(str(folder / "events.parquet"))
    got, want = both(spark, folder, "sliding_days")
    assert got == want and "(1704736800, 4)" in got


def test_memory_claims_ends_words_as_its_sql_does(spark, folder):
    said = ["Les oution éouréou.", "ours", "rememberé", "érecap", "a wir us_b", "tell me, é", None]
    t = spark.createDataFrame([(i, 4, "user", x) for i, x in enumerate(said)], "conv_id long, turn long, role string, text string")
    t.write.parquet(str(folder / "conversations.parquet"))
    got, want = both(spark, folder, "memory_claims")
    assert got == want and "(0, 4, 'personal', False, 'personal')" in got
    assert t.filter("conv_id = 0").select(forms.claimed(F.col("text"))).first()[0] is None


def test_evidence_top_takes_any_number_of_queries(spark, folder):
    rows = [(100 * i, [float(i % 7), float(i % 11) - 5], i % 3) for i in range(1010)]
    rows += [(1, [1.0, 2.0], 8), (2, [0.5, -2.0], 8), (3, None, 9), (101_100, None, 0)]
    spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").write.parquet(str(folder / "embeddings.parquet"))
    got, want = both(spark, folder, "evidence_top")
    assert got == want and len(got) == 5 * 1011


PIECES = (
    "Dr. Smith of the U.S. Dept. met Mr. Ólafur's friends, i.e. the council", "see also:", "thumb | right|250px|[[File:a.jpg|cap]] [[Town|the town's]] {{x}}<b> and the river runs on",
    "The river crosses the old town and the mill", "the RIVER crosses the old town and the mill", "The river -- crosses the old town & the mill", "upright=1.2 thumb a b", "42. ", "café naïve über straße groß 東京 town", "𝔘nicode 𐐀𐐁 letters 😀 in the old mill town",
    "[12]", "(see note 4)", "‘quoted’ words’s “and” more words’ of the town hall", "İstanbul ΣΟΦΟΣ town hall river mill", "a,b," * 700, "word " * 400, "x" * 3500, "\x01 held. p. 4 of Vol. 2 and so on", "tab\tand\rreturn of the old town hall", "100x200px image of the town hall mill",
    "The council decided: the mill, the hall and the bridge were sold", "rivers towns mills halls councils", "\u00a0odd\u2003blanks in the town hall mill ", "e.g. p. pp. etc. vs. No. 5",
)


def odd_texts(n=60, seed=3):
    r = random.Random(seed)
    made = ["".join(r.choice(PIECES) + r.choice([". ", "! ", "; ", "\n", " \r\n", ", ", "? "]) for _ in range(r.randint(0, 40))) for _ in range(n)]
    return [None, "", " \n ", *made]


def docs_of(spark, texts):
    return spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")


def by_id(df):
    return {r.doc_id: r.asDict() for r in df.collect()}


def table_parts(docs):
    """The same by plans over rows of units."""
    units = segment.filtered(segment.sentences(docs))
    kws = segment.keywords(units)
    df = themes.keyword_df(kws)
    found = themes.themes(df)
    return units, kws, df, found, themes.paths(kws, found)


def hashed(df):
    return "hashpartitioning" in df._jdf.queryExecution().executedPlan().toString()


def test_coverage_of_documents_equals_the_plan_over_units_without_its_shuffles(spark, data):
    docs = docs_of(spark, odd_texts())
    units, _, _, found, paths = table_parts(docs)
    want = by_id(select.coverage_select(units, paths, themes.nodes(paths, found)))
    got = by_id(select.coverage_of_documents(docs))
    assert got == want and len(got) > 50
    assert not hashed(catalogue.queries()["coverage_select"](spark, data))


def test_query_of_documents_equals_the_plan_over_units_without_its_shuffles(spark, data):
    docs = docs_of(spark, odd_texts(seed=4))
    units, _, _, found, paths = table_parts(docs)
    spoken = C.with_stems(F.filter(F.transform(F.split(F.lower("unit"), C.SPACE), T.strip_word), lambda w: w != ""))
    near = lambda u: F.when(F.col("doc_id") % 3 > 0, F.pmod(F.xxhash64(u), F.lit(1000)) / 1000)
    asked = docs.filter("doc_id % 4 > 0").select("doc_id", C.query_keywords(F.lit("Which rivers crossed the towns of Ólafur?")).alias("terms")).withColumn("stems", F.transform("terms", T.soft_stem))
    seeds = found.filter("rk <= 2 and doc_id % 5 > 0").groupBy("doc_id").agg(F.sort_array(F.collect_list("kw")).alias("k")).filter("size(k) = 2").select("doc_id", F.map_from_arrays(F.array(F.array_join("k", ">"), F.element_at("k", 1)), F.array(F.lit(1.0), F.lit(2.0))).alias("seeds"))
    with_seeds = asked.join(seeds, "doc_id", "left")
    want = by_id(select.query_select(units.withColumn("words", spoken).withColumn("near", near("unit")), paths, themes.nodes(paths, found), with_seeds))
    rows = select.profiled(docs).join(with_seeds, "doc_id", "left").withColumn("near", F.transform("unit", near))
    got = by_id(select.query_of_documents(rows))
    assert got == want and len(got) > 50 and any(r["n_terms_active"] for r in got.values())
    assert not hashed(catalogue.queries()["query_select"](spark, data))


def test_legacy_of_documents_equals_the_plan_over_units_without_its_shuffles(spark, data):
    docs = docs_of(spark, odd_texts(seed=5))
    units, kws, df, found, _ = table_parts(docs)
    for query in ("Where do the rivers of Ólafur cross the Old-Town?", "Who sold 42 mills", ""):
        want = by_id(legacy_select.legacy_select(legacy_select.features(units, kws, df, found, query)))
        got = by_id(legacy_select.legacy_of_documents(docs, query))
        assert got == want and len(got) > 50 and any(r["n_query"] for r in got.values()) == bool(query)
    assert not hashed(catalogue.queries()["legacy_select"](spark, data))


def test_retrieved_equals_the_plan_over_paragraphs_without_its_shuffles(spark, data):
    r = random.Random(6)
    numbered = lambda t: None if t is None else "\n".join(r.choice(["Paragraph {}: ", "  paragraph 0{}:", "", " \t"]).format(i) + x + r.choice(["", "\r", " \r", " "]) for i, x in enumerate((t.split("\n") + ["The river crosses the old town and the hall. " * 3] * 4) * 3))
    docs = docs_of(spark, [*map(numbered, odd_texts(seed=7)), "no such unit", "Paragraph 1: a\rb\nParagraph 2: c d"])
    asked = docs.filter("doc_id % 4 > 0").select("doc_id", F.lit("Which rivers crossed the towns of Ólafur?").alias("question"))
    signed = fewshot.signatures(fewshot.paragraphs(docs), 0.9)
    rows = signed.select("doc_id", F.col("unit").alias("pos"), F.col("whole").alias("unit"), F.col("cost").alias("n_words"), "budget", "body")
    kws = rows.select("doc_id", "pos", F.explode(T.content_words(F.col("body"))).alias("kw"))
    found = themes.themes(themes.keyword_df(kws), 0.75)
    paths = themes.paths(kws, found)
    terms = asked.select("doc_id", C.query_keywords(F.col("question")).alias("terms")).select("doc_id", "terms", F.transform("terms", T.soft_stem).alias("stems"), F.lit(None).cast("map<string,double>").alias("seeds"))
    spoken = C.with_stems(F.filter(F.transform(F.split(F.lower("unit"), C.SPACE), T.strip_word), lambda w: w != ""))
    units = rows.withColumn("words", spoken).withColumn("near", F.lit(None).cast("double")).drop("body")
    took = select.query_select(units, paths, themes.nodes(paths, found), terms).select("doc_id", F.explode("took").alias("unit"))
    want = by_id(fewshot.shown(signed, took))
    got = by_id(fewshot.retrieve(docs, asked, 0.9))
    assert got == want and len(got) > 50 and any(0 < r["n_full_units"] < r["n_units"] for r in got.values())
    assert not hashed(catalogue.queries()["retrieved_units"](spark, data))


def test_retrieved_units_chooses_in_every_document_as_the_plan_over_paragraphs_does(spark, data):
    got = by_id(catalogue.queries()["retrieved_units"](spark, data))
    several = [r for r in got.values() if r["n_units"] > 3]
    assert len(several) > 100 and all(0 < r["n_full_units"] < r["n_units"] for r in several)
    signed = fewshot.signatures(fewshot.paragraphs(wider._paragraphs(spark, data)), sig_words=2, rest=0.5)
    rows = signed.select("doc_id", F.col("unit").alias("pos"), F.col("whole").alias("unit"), F.col("cost").alias("n_words"), "budget", "body")
    kws = rows.select("doc_id", "pos", F.explode(T.content_words(F.col("body"))).alias("kw"))
    found = themes.themes(themes.keyword_df(kws), 0.75)
    paths = themes.paths(kws, found)
    asked = further.asked_passages(spark, data, further.read(spark, data, "documents").select("doc_id")).withColumn("seeds", F.lit(None).cast("map<string,double>"))
    spoken = C.with_stems(F.filter(F.transform(F.split(F.lower("unit"), C.SPACE), T.strip_word), lambda w: w != ""))
    units = rows.withColumn("words", spoken).withColumn("near", F.lit(None).cast("double")).drop("body")
    took = select.query_select(units, paths, themes.nodes(paths, found), asked).select("doc_id", F.explode("took").alias("unit"))
    assert got == by_id(fewshot.shown(signed, took))


def test_alike_rows_are_taken_one_by_one():
    r = random.Random(8)
    for _ in range(300):
        n, m = r.randint(1, 14), r.randint(1, 3)
        kinds = [(r.randint(1, 3), r.sample(range(m), r.randint(0, m))) for _ in range(3)]
        costs, covers = map(list, zip(*(r.choice(kinds) for _ in range(n)), strict=True))
        weights, starts, budget = [r.choice([0.5, 1.0, 2.0]) for _ in range(m)], [0.0] * m, r.randint(0, 12)
        by_row = [[(v, 1.0) for v in own] for own in covers]
        got = select.best_rows(costs, by_row, weights, starts, budget)
        apart = select.best_rows([*costs], [[*own, (m + i, 1.0)] for i, own in enumerate(by_row)], [*weights, *[0.0] * n], [*starts, *[0.0] * n], budget)
        assert got == apart and got.rows == select.greedy(costs, covers, weights, budget)
