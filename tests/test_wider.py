"""Cuts, filters, code anchors, retrieval units, windows, decisions and records: fixtures and plain versions."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from themeloom.functions import text as T
from themeloom.operators import code, decide, fewshot, filters, windows
from themeloom.sources import files


def plain_cut(part):
    if len(part) < 1604:
        return [part]
    if "," in part:
        return [p.strip() for p in part.split(",") if p.strip()]
    out = []
    while part:
        end = len(part) if len(part) <= 1600 else part.rfind(" ", 1, 1600)
        end = 1600 if end < 0 else end
        out.append(part[:end].strip())
        part = part[end:]
    return [p for p in out if p]


def test_over_long_sentences_are_cut(spark):
    r = random.Random(5)
    texts = ["a" * 5000, "b" * 1603, "b" * 1604, "x, " * 900, "c" * 1599 + " " + "d" * 1700, "e" * 1600 + " f", "é😀 " * 1200]
    texts += [" ".join("w" * r.choice((1, 3, 40, 900, 1598, 1599, 1600, 1700)) for _ in range(r.randint(1, 9))) for _ in range(60)]
    got = spark.createDataFrame(list(enumerate(texts)), "i int, t string").select("i", T.sentence_parts(F.col("t")).alias("p")).orderBy("i").collect()
    for row, t in zip(got, texts, strict=True):
        assert list(row.p) == plain_cut(t.strip()), t[:40]


def plain_windows(sizes, room):
    """Sentence by sentence: fill, then begin at the last one again."""
    live, out, i = [k for k, n in enumerate(sizes) if n], [], 0
    while i < len(live):
        held, n, j = [], 0, i
        while j < len(live) and (not held or n + sizes[live[j]] <= room):
            n += min(sizes[live[j]], room) if not held else sizes[live[j]]
            held.append(live[j])
            j += 1
        out.append((held, n))
        i = j if len(held) == 1 else j - 1
    return out


def test_windows_cover_all_sentences():
    r = random.Random(3)
    cases = [[], [0], [5], [600], [510, 1], [1, 510], [0, 0, 3], [255, 255, 255]] + [[r.choice((0, 1, 90, 200, 509, 510, 511, 900)) for _ in range(r.randint(1, 25))] for _ in range(400)]
    for sizes in cases:
        assert [(w["positions"], w["n_tokens"]) for w in windows.cover(np.array(sizes, dtype=np.int64), 510)] == plain_windows(sizes, 510), sizes


def test_pieces_become_words(spark):
    rows = [(1, ["##Un", "##der", "▁The", "town", "##s"], [1.0, 2.0, 4.0, 8.0, 16.0]), (2, [], []), (3, ["A"], [0.5])]
    d = spark.createDataFrame(rows, "i int, p array<string>, x array<double>")
    got = {r.i: [(w["word"], w["weight"], list(w["places"])) for w in r.m] for r in d.select("i", windows.whole_words(F.col("p"), F.col("x")).alias("m")).collect()}
    assert got == {1: [("under", 3.0, [0, 1]), ("the", 4.0, [2]), ("towns", 24.0, [3, 4])], 2: [], 3: [("a", 0.5, [0])]}


LONG = "The town council met by the river and spoke of the old bridge"


def test_filter_order(spark):
    units = [LONG, LONG.upper(), "Short.", f"{LONG} at https://a.example/x.", "https://a.example/" + "x" * 99 + " and so it goes on", "For further information on the town and its river go on", "Short.", None]
    d = spark.createDataFrame([(1, i, u) for i, u in enumerate(units)], "doc_id long, pos int, unit string")
    fate = lambda **k: [(r.fate) for r in filters.fates(d, **k).orderBy("pos").collect()]
    assert fate() == ["kept", "repeat", "junk", "url", "url", "kept", "junk", "junk"]
    assert fate(strip_urls=True, aggressive=True) == ["kept", "repeat", "junk", "kept", "url", "aggressive", "junk", "junk"]
    assert fate(remove_urls=False, deduplicate=False) == ["kept", "kept", "junk", "kept", "kept", "kept", "junk", "junk"]
    assert fate(keep=F.length("unit") < 10) == ["kept", "repeat", "kept", "url", "url", "kept", "repeat", "junk"]
    shown = [r.unit for r in filters.fates(d, strip_urls=True).orderBy("pos").collect()]
    assert shown[3] == f"{LONG} at <url>." and shown[4] == units[4]
    assert filters.counters(filters.fates(d, strip_urls=True, aggressive=True)).collect()[0].asDict() == {"doc_id": 1, "n_kept": 2, "n_junk": 3, "n_url": 1, "n_aggressive": 1, "n_dedup": 1}
    assert filters.fates(d.limit(0)).count() == 0


def test_code_anchors_and_terms(spark):
    lines = ["import os", "def f(x):", "    y = x " + "z " * 40, "src/a/b.py", "def g(x):", "    return compute_sum(x)", "    end = 1"]
    rows = code.units(code.lines(spark.createDataFrame([(1, "\n".join(lines)), (2, None)], "doc_id long, text string")))
    got = {(r.pos, r.kind) for r in code.anchors(rows, 0.2, 0.5, 0.3).collect()}
    assert got == {(5, "tail"), (6, "tail"), (0, "struct"), (3, "struct")}  # 11 of 58 words: 5 for the tail, 3 for openings
    terms = spark.createDataFrame([("old_name " * 5 + "parseRow x_1",)], "t string").select(code.query_terms(F.col("t"), 2).alias("q")).first().q
    assert set(terms) == {"parserow", "parse", "row", "x_1"}
    kws, found = code.unit_themes(rows)
    lead = {r.kw: (r.df, r.rk) for r in found.collect()}
    top = max(df for kw, (df, _) in lead.items() if not kw.startswith("\0"))
    assert all(lead[f"\0unit{u}"][0] == top + 1 for u in range(4)) and {lead[f"\0unit{u}"][1] for u in range(4)} == {1, 2, 3, 4}


def test_retrieval_buys_whole_units(spark):
    text = "\n\n".join(f"Paragraph {i}: " + " ".join(f"{'river' if i == 4 else 'town'}{chr(97 + i)} w{chr(97 + j)}rd{chr(97 + i)}" for j in range(20)) for i in range(1, 9))
    docs = spark.createDataFrame([(1, text), (2, "no units"), (3, None)], "doc_id long, text string")
    asked = spark.createDataFrame([(1, "What stands in rivere?"), (2, "x")], "doc_id long, question string")
    got = fewshot.retrieve(docs, asked, share=0.5).collect()
    assert [r.doc_id for r in got] == [1]
    r = got[0]
    parts = r.context.split("\n\n")
    assert r.n_units == 8 and [p.split(":")[0] for p in parts] == [f"Paragraph {i}" for i in range(1, 9)]
    assert sum(not p.endswith(" ...") for p in parts) == r.n_full_units > 0 and not parts[3].endswith(" ...")
    assert r.words_used == sum(len(p.split()) - p.endswith(" ...") for p in parts) <= 160


def test_settings():
    assert decide.settings() == {"lam": 0.5, "query_mass": 1.0, "theme_percentile": 0.9}
    assert decide.settings("synthetic", lam=0.1, sig_words=None) == {"lam": 0.1, "query_mass": 1.0, "theme_percentile": 0.75, "sig_words": 12, "count_min_prefix": 8}
    with pytest.raises(ValueError, match="no such mode"):
        decide.settings("other")


def test_settings_by_row(spark):
    d = spark.createDataFrame([(True, True), (False, True), (False, False)], "s boolean, c boolean").select(decide.mode_of(F.col("s"), F.col("c")).alias("m"))
    got = [tuple(r) for r in d.select("m", decide.setting(F.col("m"), "theme_percentile"), decide.setting(F.col("m"), "sig_words")).collect()]
    assert got == [("synthetic", 0.75, 12.0), ("code", 0.5, None), (None, 0.9, None)]


def test_windows_in_words(spark):
    rows = [("2024-03-05", "2024-03-06", "5 March 2024"), ("2024-02-01", "2024-03-01", "February 2024"), ("2024-01-01", "2025-01-01", "2024"), ("2024-03-05", "2024-03-09", "5 to 8 March 2024"), ("2024-03-30", "2024-04-03", "30 March to 2 April 2024"), ("2023-12-30", "2024-01-03", "30 December 2023 to 2 January 2024"), ("2023-01-01", "2025-01-01", "1 January 2023 to 31 December 2024")]
    d = spark.createDataFrame(rows, "a string, b string, said string")
    for r in d.select(decide.dated(F.col("a").cast("timestamp"), F.col("b").cast("timestamp")).alias("got"), "said").collect():
        assert r.got == r.said


def test_sections_that_fit(spark):
    d = spark.createDataFrame([("a", 0, 5), ("a", 1, 6), ("a", 2, 1), ("b", 0, 11), ("c", 0, 10)], "k string, i int, n_words int")
    assert {(r.k, r.i) for r in decide.fitted(d, "k", "i", 10).collect()} == {("a", 0), ("c", 0)}


def test_flat_records_become_nested(spark):
    rows = [(0, "t", "one two", "[{'Q': 'q0', 'A': 'a0'}, {'question': 'q1', 'answer': 'a1'}]", None, None), (1, "t", "other", None, "q2", "a2"), (2, "", "x y z", "[{broken", "q", "a"), (3, None, None, "", "q3", None)]
    d = spark.createDataFrame(rows, "at long, title string, context string, qa_pairs string, question string, answer string")
    got = [(r.title, r.context, r.n_words, [tuple(q) for q in r.questions]) for r in files.nested(d).collect()]
    assert got == [("t", "one two", 2, [("t__0", "q0", "a0"), ("t__1", "q1", "a1"), ("t__2", "q2", "a2")]), ("unknown_3", "", 0, [("unknown_3__0", "q3", "")]), ("unknown_2", "x y z", 3, [])]
    assert files.nested(d, 1).count() == 1


def test_datasets_by_record_and_name(spark):
    names = ("qasper", "trec", "trec_long")
    rows = [("/a/x.jsonl", "QASPER"), ("/a/TREC.jsonl", "odd"), ("/a/trec_long-1.jsonl", None), ("/a/trec-dev.v2.jsonl", None), ("/a/trecker.jsonl", None), ("qasper", None)]
    got = spark.createDataFrame(rows, "p string, s string").select(files.dataset_of(F.col("p"), F.col("s"), names).alias("d")).collect()
    assert [r.d for r in got] == ["qasper", "trec", "trec", "trec", None, "qasper"]


def test_sessions_are_saved_whole(spark, tmp_path):
    rows = spark.createDataFrame([(1, 0, "a")], "conv_id long, row_idx long, text string")
    cover = spark.createDataFrame([(1, "n", 0.5)], "conv_id long, node string, level double")
    path = str(tmp_path / "s")
    with pytest.raises(FileNotFoundError):
        files.load_sessions(spark, path)
    files.save_sessions({"rows": rows, "coverage": cover}, path, 1)
    files.save_sessions({"rows": rows.withColumn("text", F.lit("b")), "coverage": cover}, path, 2)
    assert files.load_sessions(spark, path)["rows"].first().text == "b"
    (tmp_path / "s" / "v00000002" / "coverage" / "_SUCCESS").unlink()  # as if the writer was lost
    assert files.load_sessions(spark, path)["rows"].first().text == "a"
    with pytest.raises(ValueError, match="coverage"):
        files.save_sessions({"rows": rows}, path, 3)
