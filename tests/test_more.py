"""Operators that the tables do not exercise or that SQL cannot express, on small fixtures and against plain versions."""

import json
import random
from datetime import datetime, timezone

import numpy as np
import pytest
from pyspark.sql import functions as F

from themeloom.functions import chat, when
from themeloom.operators import code, fewshot, legacy_select, metrics, pages, scoring, vectors
from themeloom.plans import rules
from themeloom.sources import files
from themeloom.streaming import session


def texts(spark, *values):
    return spark.createDataFrame(list(enumerate(values)), "doc_id long, text string")


def column(df):
    return [r[0] for r in df.collect()]


def test_paragraphs_and_count_prefixes(spark):
    d = texts(spark, "lost\nParagraph 1: one two\n\nthree\nparagraph 2: four", None, "no head")
    got = [tuple(r) for r in fewshot.paragraphs(d).orderBy("doc_id", "unit").collect()]
    assert got == [(0, 0, 1, "one two three", 3), (0, 1, 2, "four", 1)]
    assert column(fewshot.count_prefixes(fewshot.paragraphs(d), 1.0).select("context")) == ["Paragraph 1: one two three\n\nParagraph 2: four"]


def test_exemplars_are_whole_blocks(spark):
    block = "Question: what is {}? word word\nType: kind{}\n"
    d = texts(spark, "head\n" + "".join(block.format(i, i) for i in range(20)), "Question: alone")
    found = fewshot.detect(d)
    assert [(r.pattern, len(r.blocks)) for r in found.orderBy("doc_id").collect()] == [("question_type", 20), ("none", 0)]
    kept = fewshot.compress(found, 0.25).collect()
    assert len(kept) == 1 and kept[0].n_kept == 5 and kept[0].words_used == 40
    assert all(b.startswith("Question:") and "Type:" in b for b in kept[0].context.split("\n\n"))


def test_even_choice_keeps_the_budget():
    rng = random.Random(5)
    for _ in range(200):
        sizes = [rng.randint(0, 9) for _ in range(rng.randint(0, 12))]
        budget = rng.randint(0, 30)
        took = fewshot.even_choice(sizes, budget)
        assert len(set(took)) == len(took) and sum(sizes[i] for i in took) <= budget
        assert all(sizes[i] > budget - sum(sizes[j] for j in took) for i in range(len(sizes)) if i not in took)


def test_identifiers(spark):
    got = column(texts(spark, "public int getUserName(m_items) { HTTPServer x2; }").select(code.identifiers(F.col("text"))))[0]
    assert set(got) == {"getusername", "user", "name", "m_items", "httpserver", "http", "server", "x2"}


def test_code_units(spark):
    d = texts(spark, "import os\n\ndef a():\n    return 1\nclass B:\n    x = 2\n")
    got = [(r.line, r.unit, r.anchor) for r in code.units(code.lines(d)).orderBy("pos").collect()]
    assert got == [("import os", 0, True), ("def a():", 1, True), ("    return 1", 1, False), ("class B:", 2, True), ("    x = 2", 2, False)]


def test_furniture_and_tables(spark):
    rows = [("d", p, f"Report of 2020, page {p}\nbody {chr(97 + p)}\nmore {chr(97 + p)}\nrest\nend {chr(97 + p)}\n{p}") for p in range(1, 5)]
    got = pages.without_furniture(pages.page_lines(spark.createDataFrame(rows, "doc string, page int, t string"), "doc", "page", "t"))
    left = {r.line for r in got.collect()}
    assert not any("Report" in x or x.isdigit() for x in left) and "rest" in left and len(left) == 13
    t = texts(spark, "a 1 2 3 4 5\nb 6 7 8 9 10\nplain words\nc 1 2 3 4 5")
    runs = pages.table_runs(pages.page_lines(t, "doc_id", "doc_id", "text")).collect()
    assert [(r.n_lines, r.unit) for r in runs] == [(2, "a 1 2 3 4 5\nb 6 7 8 9 10")]


def test_wording(spark):
    t = F.col("text")
    one = lambda c, *v: column(texts(spark, *v).select(c))
    assert one(chat.url_placeholder(t), "see https://a.b/c?d=1). Or www.x.y, now", "www. none") == ["see <url>). Or <url>, now", "www. none"]
    assert one(chat.url_dominated(t), "https://abcdefghij.example/k x", "just words", "") == [True, False, False]
    assert one(chat.report_junk(t), "See CRS Report R12345 for more.", "S. Rept. 104-12", "March 3, 2004 -", "An ordinary sentence about rivers.") == [True, True, True, False]
    assert one(chat.scoring_form(t), "The **Answer** is 1,000 or 3.14, a-b!") == ["answer is 1000 or 3.14 b"]
    assert one(chat.final_line(t), "thinking\n\n**Answer:** 42\n ", "") == ["42", ""]
    assert one(chat.prediction(t, F.col("doc_id") == 1), "yes\nno\n\nQuestion: x", "yes\nno") == ["yes\nno", "yes"]
    assert one(chat.scrub(t), "e\ufb03cient (cid:12)\u00a0text .") == ["efficient text."]
    assert one(chat.question_boost(t, F.lit("how_many")), "about 12 of them", "twelve of them", "none") == [1.6, 1.3, 1.0]


@pytest.mark.parametrize(
    "line,start,end",
    [
        ("what did I say yesterday?", "2024-05-14", "2024-05-15"),
        ("a couple of days ago", "2024-05-13", "2024-05-14"),
        ("two weeks ago", "2024-04-29", "2024-05-06"),
        ("six months ago", "2023-11-01", "2023-12-01"),
        ("the last 3 days", "2024-05-13", "2024-05-16"),
        ("on monday", "2024-05-13", "2024-05-14"),
        ("last wednesday", "2024-05-08", "2024-05-09"),
        ("2023-02-28", "2023-02-28", "2023-03-01"),
        ("the 8th of March, 2021", "2021-03-08", "2021-03-09"),
        ("December 2020", "2020-12-01", "2021-01-01"),
        ("in June", "2024-06-01", "2024-07-01"),
        ("since 1999", "1999-01-01", "2000-01-01"),
        ("30 February 2023", None, None),
        ("the 8 may be too many", None, None),
        ("", None, None),
        (None, None, None),
    ],
)
def test_named_times(line, start, end):
    asked = datetime(2024, 5, 15, 13, 0, tzinfo=timezone.utc)
    got = when.window(when.named(line, asked), asked.year)
    assert (None if got is None else tuple(f"{x:%Y-%m-%d}" for x in got)) == (None if start is None else (start, end))


def test_rules(spark):
    rows = spark.createDataFrame([(1, 5.0, True, None), (2, None, False, "x"), (3, float("nan"), None, "y")], "id int, a double, b boolean, c string")
    holds = lambda e: [r.id for r in rows.filter(rules.Compiler(e, rows.columns).compile()).orderBy("id").collect()]
    assert holds("a > 3 and a < 9") == [1] and holds("not a > 3 and b == false") == [2] and holds("c == none or b") == [1] and holds("c != none") == [2, 3]
    assert holds("a") == [1] and holds("not (b or a)") == [2, 3] and holds("a <= none") == []
    for bad in ("a >", "(a", "a b", "zzz", "a $ b", "", "and", "(" * 500 + "a"):
        with pytest.raises(rules.RuleError):
            rules.Compiler(bad, rows.columns).compile()
    book = [rules.Rule("r1", "a > 1", {"x": 1}), rules.Rule("r2", "b", {"x": 2})]
    assert [r.x for r in rules.decided(rows, book, {"x": int}).orderBy("id").collect()] == [2, None, 1]
    for wrong in ([book[0], book[0]], [rules.Rule("r", "a", {"y": 1})], [rules.Rule("r", "a", {"x": True})], [rules.Rule("r", "a", {})]):
        with pytest.raises(rules.RuleError):
            rules.checked(wrong, rows.columns, {"x": int})


def slow_common(a, b):
    best = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i, x in enumerate(a):
        for j, y in enumerate(b):
            best[i + 1][j + 1] = best[i][j] + 1 if x == y else max(best[i][j + 1], best[i + 1][j])
    return best[-1][-1]


def test_metrics(spark):
    rng = random.Random(3)
    for _ in range(300):
        a, b = ("".join(rng.choice("abc") for _ in range(rng.randint(0, 12))) for _ in "ab")
        assert metrics.common_length(a, b) == slow_common(a, b)
    assert metrics.rouge_l("a b c", "a b c") == pytest.approx(1) and metrics.rouge_l("", "a") == 0
    d = spark.createDataFrame([("# no\nx = 1\ny", "x = 1", "Paragraph 7", "it is 7 or 8")], "code string, line string, gold string, said string")
    got = d.select(metrics.code_similarity(F.col("code"), F.col("line")), metrics.retrieval(F.col("said"), F.col("gold")), metrics.classification(F.lit("date or city"), F.lit("city"), F.array(F.lit("date"), F.lit("city"), F.lit("cit")))).first()
    assert tuple(got) == (1.0, 0.5, 0.5)


def test_near_dup_gate_is_keep_first(spark):
    rng = np.random.default_rng(2)
    v = rng.normal(size=(60, 8))
    v[30:] = v[:30] + rng.normal(size=(30, 8)) * 0.1
    v = (v / np.linalg.norm(v, axis=1, keepdims=True)).astype(np.float32)
    rows = spark.createDataFrame([(i, i % 2, v[i].tolist()) for i in range(60)], "vec_id long, label int, embedding array<float>")
    kept = []
    for i in range(60):
        if all(j % 2 != i % 2 or float(v[i] @ v[j]) < 0.9 for j in kept):
            kept.append(i)
    assert sorted(r.vec_id for r in vectors.near_dup_gate(rows, 0.9).filter("kept").collect()) == kept


def messages(spark):
    rows = [(1, 0, "user", "One river. Two rivers. One river."), (1, 1, "assistant", "Three lakes! Two rivers."), (1, 2, "system", "Not kept."), (1, 3, "user", "One river. Four hills."), (2, 0, "user", None), (2, 1, "user", "Two rivers.")]
    return spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")


def test_replay_evicts_the_oldest(spark):
    got = [tuple(r)[:7] for r in session.replay(messages(spark), cap=2).orderBy("conv_id", "turn").collect()]
    assert got[:3] == [(1, 0, 3, 2, 2, 2, 4), (1, 1, 2, 1, 3, 2, 4), (1, 3, 2, 2, 5, 2, 4)]
    assert got[3:] == [(2, 0, 0, 0, 0, 0, 0), (2, 1, 1, 1, 1, 1, 2)]


def test_stream_equals_replay(spark, tmp_path):
    m = messages(spark)
    for turn in (0, 1, 3):
        m.filter(F.col("turn") == turn).coalesce(1).write.mode("append").json(str(tmp_path / "in"))
    source = spark.readStream.schema(m.schema).option("maxFilesPerTrigger", 1).json(str(tmp_path / "in"))
    q = session.stream(source, cap=2).writeStream.format("memory").queryName("grown").option("checkpointLocation", str(tmp_path / "ck")).outputMode("append").trigger(availableNow=True).start()
    assert q.awaitTermination(120)
    want = session.replay(m, cap=2)
    assert sorted(map(tuple, spark.table("grown").collect())) == sorted(map(tuple, want.collect()))


def test_legacy_selection_spends_no_more_than_its_budget(spark, data):
    from themeloom.plans.more import legacy

    rows = legacy(spark, data).collect()
    assert rows and all(r.words_used <= r.budget and r.n_selected == len(r.positions) and list(r.positions) == sorted(set(r.positions)) for r in rows)
    assert sum(r.n_selected for r in rows) > 0


def test_purse_buys_once():
    p = legacy_select.Purse([3, 4], 5)
    assert p.buy(0, 5) and not p.buy(0, 5) and not p.buy(1, 5) and p.spent == 3


def test_files(spark, tmp_path):
    one = tmp_path / "a.jsonl"
    one.write_text("\n".join(["", *(json.dumps({"_id": str(i), "context": "w " * i}) for i in range(5))]))
    assert [r._id for r in files.json_lines(spark, str(one), first=2).collect()] == ["0", "1"] and files.json_lines(spark, str(one)).filter("_id is not null").count() == 5
    assert [r.length for r in files.normalised(files.json_lines(spark, str(one), first=3)).collect()] == [0, 1, 2]
    log = tmp_path / "log.jsonl"
    log.write_text('{"id":1,"version":1,"status":"ok"}\n{"id":2,"ver\n{"id":3,"version":9}\n\n')
    rows, skipped = files.ledger(spark, str(log))
    assert [r.id for r in rows.collect()] == [1] and tuple(skipped.first()) == (1, 1, 3)
    t = tmp_path / "t.json"
    t.write_text('[{"conv_id":"c","turn":1,"content":"hi","ts":0},{"conv_id":"c","turn":2,"text":"yo","ts":1.5},{"turn":3}]')
    assert [(r.turn, r.role, r.text) for r in files.turns(spark, str(t), whole_array=True).orderBy("turn").collect()] == [(1, "user", "hi"), (2, "user", "yo")]
    (tmp_path / "x.md").write_text("whole\ntext")
    assert [r.text for r in files.documents(spark, str(tmp_path / "x.md")).collect()] == ["whole\ntext"]
    files.write_results(spark.range(2), spark.range(1), str(tmp_path / "out"))
    assert spark.read.json(str(tmp_path / "out")).count() == 2 and spark.read.json(str(tmp_path / "out_metadata")).count() == 1


def test_comparison_has_every_target(spark):
    rows = [("a", "de", 3), ("a", "it", 9), ("b", None, 5), ("b", "en", 5), ("c", "pt-BR", 1), ("d", "de", None)]
    d = spark.createDataFrame(rows, "dataset string, target string, score int")
    wide = scoring.comparison(d)
    assert sorted(wide.columns) == sorted(["dataset", "de", "en", "it", "null", "pt-BR", "best"])
    assert {r.dataset: r.best for r in wide.collect()} == {"a": "it", "b": "en", "c": "pt-BR", "d": None}
    assert scoring.comparison(d.limit(0)).count() == 0
