"""Ledger, recall and form operators: fixtures, and plain versions of what SQL does not express."""

import shutil
import subprocess
import sys
from pathlib import Path

import numpy as np
import pytest
from pyspark.sql import functions as F

from themeloom.functions import chat, forms
from themeloom.functions import text as T
from themeloom.operators import ledger, recall, scoring
from themeloom.plans import further, rules
from themeloom.sources import files


def each(spark, f, texts):
    d = spark.createDataFrame(list(enumerate(texts)), "i int, t string")
    return [r[1] for r in d.select("i", f(F.col("t"))).orderBy("i").collect()]


def test_the_engine_stands_without_the_training_data_operators(tmp_path):
    """A copy without the two optional folders imports, lists its queries and names none of theirs."""
    root = Path(__file__).resolve().parent.parent
    for part in ("themeloom", "__spark_entry__.py", "corpus_pipeline.py"):
        (shutil.copytree if (root / part).is_dir() else shutil.copy)(root / part, tmp_path / part)
    shutil.rmtree(tmp_path / "themeloom" / "llm", ignore_errors=True)
    said = subprocess.run([sys.executable, "-c", "import __spark_entry__ as e; q = e.queries(); print(len(q), sum(n.startswith('op') and n[2].isdigit() or n == 'pipeline' for n in q), set(e.oracle_sql()) <= set(q))"], cwd=tmp_path, capture_output=True, text=True)
    n, theirs, held = said.stdout.split()
    assert int(n) > 100 and theirs == "0" and held == "True", said.stderr


def test_answers(spark):
    assert each(spark, chat.final_line, ["a\n\n> **42**", "Final answer: x y", "my answer: 3", "", None]) == ["42", "x y", "my answer: 3", "", ""]
    assert each(spark, chat.scoring_form, ["a>b", "The **1,000** or 3.14"]) == ["ab", "1000 or 3.14"]
    rows = [(1, "so\nAnswer: 1,000", ["1000"]), (2, "Paris", ["paris", "x"]), (3, "in the old town of Rome", ["old town"]), (4, None, ["x"]), (5, "x", []), (6, "x y", ["z"]), (7, "x y z", ["y", "x z"])]
    got = {r.id: (r.match, r.f1) for r in scoring.matches(spark.createDataFrame(rows, "id int, prediction string, answers array<string>")).collect()}
    assert got == {1: ("final", 0.5), 2: ("exact", 1.0), 3: ("contains", 0.5714), 4: ("none", 0.0), 5: ("none", 0.0), 6: ("none", 0.0), 7: ("contains", 0.8)}


def test_rules_take_minus_and_null(spark):
    d = spark.createDataFrame([(-2.0, None), (1.0, 3.0)], "words double, cap double")
    book = [rules.Rule("low", "words < -1", {"budget": 0.1}), rules.Rule("open", "cap == null", {"budget": 0.2})]
    got = [r.asDict() for r in rules.decided(d, book, {"budget": float}).collect()]
    assert got[0] != got[1]


def test_a_file_of_another_kind_is_refused(spark, tmp_path):
    (tmp_path / "a.txt").write_text("hello")
    assert [r.text for r in files.documents(spark, str(tmp_path)).collect()] == ["hello"]
    (tmp_path / "b.pdf").write_text("x")
    with pytest.raises(Exception, match="no plain text"):
        files.documents(spark, str(tmp_path)).collect()


def test_page_forms(spark):
    assert each(spark, forms.glyphs, ["L = X i∈N x", "Pn i=1 x", "A = [ x∈B", "X i∈N"]) == ["L = Σ i∈N x", "Σn i=1 x", "A = ∪ x∈B", "X i∈N"]
    lines = ["# Any words at all.", "Conclusions:", "RESULTS AND USE", "3.2 Limits of the Method", "2022 Meeting of the Town", "3.2 limits of the method here", "MAX_RETRIES = 5", "It ends here.", "", "Appendix B Further Proofs", "IV. Data and Tasks"]
    assert each(spark, forms.is_heading, lines) == [True, True, True, True, False, False, False, False, False, True, True]
    assert each(spark, lambda c: T.is_junk(c, lenient=True), ["Wang (2024) proposed a method for all of these tasks", "Wang (2024) said so to them all"]) == [False, True]
    assert each(spark, lambda c: forms.capped(c, 30, "[more]"), ["One. Two is 3.5 long and more of it", "short", "word " * 9, "x" * 40]) == ["One [more].", "short", "word word word word word word [more].", "x" * 30 + " [more]."]


def plain_thoughts(text):
    """Character by character: what stands at depth 0, and the rest."""
    import re

    opened, closed = re.compile(r"<think\b[^>]*>", re.I), re.compile(r"</think\s*>", re.I)
    said, thought, depth, i = [], [], 0, 0
    while (end := closed.search(text)) and not ((o := opened.search(text)) and o.start() < end.start()):
        thought.append(closed.sub("", text[: end.end()]))
        text = text[end.end() :]
    while i < len(text):
        if m := opened.match(text, i):
            depth, i = depth + 1, m.end()
        elif m := closed.match(text, i):
            depth, i = max(0, depth - 1), m.end()
        else:
            (thought if depth else said).append(text[i])
            i += 1
    return "".join(said).strip(), "".join(thought).strip()


def test_replies(spark):
    texts = ["a", "<think>x</think> y", "<think>a<THINK b>c</think >d</think>e", "x</think>y</think>z <think>q", "p</think>q<think>r</think>s</think>t", "<thinking>no", "", "<think>open"]
    got = each(spark, forms.thoughts, texts)
    assert [(r.said, r.thought) for r in got] == [plain_thoughts(t) for t in texts]
    assert each(spark, forms.first_object, ['x {a} {"a": "}{", "b": {"c": 1}} {"d": 2}', "none", None, "{"]) == ['{"a": "}{", "b": {"c": 1}}', None, None, None]
    assert each(spark, forms.identifiers, ["When did v2.1, (foo_bar) ship in 2024?"]) == [["v2.1", "foo_bar", "2024"]]
    assert each(spark, lambda c: forms.token_count(c, lambda: str.split), ["a b", "", None]) == [2, 0, 0]


def test_bisected_units_keep_every_word(spark, data):
    d = spark.read.parquet(f"{data}/documents.parquet").select("doc_id", "text")
    for r in d.select("text", forms.bisected(F.coalesce("text", F.lit("")), 50).alias("p")).collect():
        assert " ".join(r.p).split() == (r.text or "").split()
        assert all(len(x) // 4 <= 50 or " " not in x for x in r.p) or len(r.p) >= 128


def test_drift_and_tail_follow_a_plain_walk(spark, data):
    rows = spark.read.parquet(f"{data}/embeddings.parquet").toPandas().sort_values(["label", "vec_id"])
    got = {(r.label, r.vec_id): r for r in recall.drift(spark.read.parquet(f"{data}/embeddings.parquet"), "label", "vec_id", "embedding").collect()}
    for label, part in rows.groupby("label"):
        base, seen = None, []
        for r in part.itertuples():
            near = float(np.mean(seen[-12:], axis=0) @ np.array(r.embedding, float)) if len(seen) >= 6 else None
            g = got[label, r.vec_id]
            assert (g.near is None) == (near is None) and (near is None or abs(g.near - near) < 1e-6)
            assert (g.baseline is None) == (base is None) and (base is None or abs(g.baseline - base) < 1e-6)
            assert g.shifted == (near is not None and base is not None and near < base - 0.1)
            base = base if near is None else near if base is None else 0.3 * near + 0.7 * base
            seen.append(np.array(r.embedding, float))
    for n in range(1, 30):
        tail = []
        for i in range(n):
            tail.append(i)
            if len(tail) > 2 * 4:
                del tail[: len(tail) - 2 * 2]
        d = spark.createDataFrame([(1, i) for i in range(n)], "k int, i int")
        assert sorted(r.i for r in recall.compacted(d, "k", "i", 4, 2).collect()) == tail


def test_projected_coverage_and_orphans(spark):
    paths = spark.createDataFrame([(1, 0, ["a", "b"]), (1, 1, ["a"]), (1, 2, ["c"])], "doc_id int, pos int, path array<string>")
    shown = spark.createDataFrame([(1, 0, 0.5), (1, 1, 1.0)], "doc_id int, pos int, shown double")
    cover = recall.projected_coverage(shown, paths)
    assert {tuple(r.node): r.coverage for r in cover.collect()} == {("a",): 1.5, ("a", "b"): 0.5}
    kept = spark.createDataFrame([(["a"], 1.0), (["x"], 2.0)], "node array<string>, coverage double")
    assert [r.node for r in recall.orphan_keys(kept, cover, ["node"]).collect()] == [["x"]]


def test_ceilings_and_costs_take_nothing_measured_as_nothing(spark):
    calls = spark.createDataFrame([(1, None, None), (2, 5, None), (2, None, None), (3, 0, 2)], "k int, prompt_tokens int, cached_tokens int")
    assert {r.k: (r.calls, r.prompt_tokens, r.cached_tokens) for r in ledger.call_cost(calls, ["k"]).collect()} == {2: (1, 5, None), 3: (1, 0, 2)}
    one = spark.createDataFrame([([("Yes", -0.1), (" yes", -3.0), ("No", -2.0), ("Yes", -0.1)],), ([("x", 0.0)],)], "t array<struct<token: string, logprob: double>>")
    yes = np.exp(-0.1) + np.exp(-3.0)
    assert [round(r[0], 9) for r in one.select(ledger.skip_share(F.col("t"))).collect()] == [round(yes / (yes + np.exp(-2.0)), 9), 0.0]


@pytest.mark.parametrize("name", sorted(further.TABLE))
def test_every_query_finds_something(spark, data, name):
    assert further.TABLE[name](spark, data).limit(1).count() == 1
