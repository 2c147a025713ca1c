"""The operators against brute force, exact round trips and held-out accuracy, and their defined cases."""

import hashlib
import random
import zlib
from collections import defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from themeloom.llm import chat_format, fingerprints, language_id, license_scan, mixing, near_dedup, packing, quality_rules, queries, token_counts, toxicity
from themeloom.llm.common import table, tokenizer_path

ODD = ["a <|endoftext|> b", "<s> x </s>", "Éá x́ ́y", "ﬁ x\x1cy z\x85w", "İstanbul ΣΑΣ", "don't it's 12345 a1.b2, x9.", "", "   ", "\n\n a", "a\tb\r\n", "한글 각", "x" * 500 + ".,", "▁a▁ b"]
ODD += ["x <|ENDOFTEXT|> y<|EndOfText|>, Z <|StartOfText|>", "A<|endoftext|>B, C", "İ, x İ. y", "क़, x ढ़. य़,\nz", "ড়, ਲ਼. ଡ଼, གྷ, שׁ, x", "J̌ H̱, T̈. W̊ Y̊", "ΑΒ, Éa. Ⅻ, x"]


@pytest.fixture(scope="module")
def docs(spark, data):
    return table(spark, data, "documents").cache()


@pytest.fixture(scope="module")
def odd(spark):
    """Nulls, empties, repeats, one very long text and clashing column names."""
    rows = [(None, None, None, 1), (1, "", "s", 2), (1, "", "s", 2), (2, "a b", None, 3), (3, "a b", "s", 4), (4, "word " * 60_000, "s", 5), (5, "!!! 12", "t", 6), (6, "> q\nx\nx\nx", "t", 7)]
    return spark.createDataFrame(rows, "doc_id long, text string, source string, kept int").selectExpr("*", "'en' lang", "1 size", "2 score", "3 node")


@pytest.fixture(scope="module")
def labels(spark):
    return spark.createDataFrame([(1, 0), (2, 1), (3, None)], "doc_id long, toxic int")


def test_every_operator_takes_odd_and_empty_tables(spark, odd, labels):
    runs = {
        1: license_scan.scan, 2: near_dedup.near_duplicates, 3: lambda d: quality_rules.apply_policy(quality_rules.ledger(d)), 4: language_id.identify, 5: mixing.mix_plan,
        6: lambda d: toxicity.classify(d, labels), 8: token_counts.count_tokens, 9: fingerprints.fingerprints,
    }
    for n, f in runs.items():
        assert f(odd).count() == 8, n
        assert f(odd.limit(0)).count() == 0, n
    assert packing.pack(odd).filter("start = 0").count() == 8
    assert packing.pack(odd.limit(0)).count() == 0
    for f in (quality_rules.keep, near_dedup.keep, mixing.mix, lambda d: toxicity.keep(d, labels)):
        assert f(odd).columns == odd.columns
        assert f(odd).count() >= 0 and f(odd.limit(0)).count() == 0


def test_licenses(spark):
    d = spark.createDataFrame([(1, "x MIT-License y the mit license"), (2, "Licensed under CC BY-NC 4.0."), (3, "mit x license")], "doc_id long, text string")
    got = {r.doc_id: r for r in license_scan.scan(d).collect()}
    assert (got[1].n_words, got[1].n_base, got[1].first_word, got[1].last_word, got[1].base_labels) == (7, 2, 1, 5, "mit")
    assert got[2].labels == "cc-by-nc" and got[2].n_base == 0 and got[2].first_word is None
    assert got[3].labels == "" and got[3].score == 0


def components(texts):
    sets = {k: frozenset(tuple(w[i : i + 5]) for i in range(max(len(w) - 4, 1))) if (w := (t or "").encode().lower().split()) else frozenset() for k, t in texts.items()}
    up = {k: k for k in sets}

    def find(a):
        while up[a] != a:
            a = up[a]
        return a

    keys = sorted(sets)
    for i, a in enumerate(keys):
        for b in keys[i + 1 :]:
            same = len(sets[a] & sets[b])
            if same and 100 * same >= 75 * (len(sets[a]) + len(sets[b]) - same):
                x, y = sorted((find(a), find(b)))
                up[y] = x
    return {k: (len(sets[k]), find(k)) for k in sets}


def test_near_duplicates_equal_brute_force(spark, docs):
    rng = random.Random(3)
    base = [f"w{rng.randrange(5000)}" for _ in range(200)]
    passage = [f"p{i}" for i in range(60)]
    texts = {r.doc_id: r.text for r in docs.collect()}
    for k in range(150):  # near copies of one text, and texts that share a passage
        w = list(base)
        for _ in range(rng.randrange(7)):
            w[rng.randrange(200)] = f"e{rng.randrange(10**6)}"
        texts[10_000 + k] = " ".join(w)
        texts[20_000 + k] = " ".join([f"q{rng.randrange(10**6)}" for _ in range(rng.randrange(5, 60))] + passage)
    d = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in near_dedup.near_duplicates(d).collect()}
    assert got == components(texts)


def test_large_groups_equal_brute_force(spark, monkeypatch):
    """Copies with no middle, copies just under and over the similarity, cut copies, and a passage that is most of many texts."""
    rng = random.Random(8)
    texts, base = {}, [f"w{i}" for i in range(60)]
    for k in range(500):
        w = list(base)
        for _ in range(rng.randrange(1, 4)):
            w[rng.randrange(60)] = f"e{rng.randrange(12)}" if k % 2 else f"e{rng.randrange(10**6)}"
        texts[k] = " ".join(w)
        lo = rng.randrange(20)
        texts[1000 + k] = " ".join(f"v{i}" for i in range(lo, rng.randrange(lo + 40, 90)))
        texts[2000 + k] = " ".join([f"q{rng.randrange(10**6)}" for _ in range(rng.randrange(3, 20))] + [f"p{i}" for i in range(60)])
        w = [f"l{i}" for i in range(300)]
        for _ in range(rng.randrange(3, 9)):
            w[rng.randrange(300)] = f"x{rng.randrange(40)}"
        texts[3000 + k] = " ".join(w)
    want = components(texts)
    d = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    for many, block in ((1500, 200_000), (3, 2_000)):
        monkeypatch.setattr(near_dedup, "MANY", many)
        monkeypatch.setattr(near_dedup, "BLOCK", block)
        assert {r.doc_id: (r.n_shingles, r.component_id) for r in near_dedup.near_duplicates(d).collect()} == want


def test_sets_within_a_sketch_meet_larger_ones(spark):
    """Copies of 60 to 64 shingles inside texts of up to 85: over K, a sketch holds only part of the larger one."""
    rng = random.Random(11)
    texts = {}
    for k, (small, large) in enumerate([(64, 85), (63, 84), (64, 84), (62, 82), (60, 80), (49, 65)] * 25):
        w = [f"w{rng.randrange(10**9)}" for _ in range(large + 4)]
        texts[2 * k], texts[2 * k + 1] = " ".join(w), " ".join(w[: small + 4])
    d = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    got = {r.doc_id: r.component_id for r in near_dedup.near_duplicates(d).collect()}
    assert got == {k: k - k % 2 for k in texts}


def test_pipeline_links_copies_that_differ_by_case(spark, data):
    import corpus_pipeline

    text = "The quick Brown fox jumps over THE lazy dog and runs Away from Étienne"
    d = spark.createDataFrame([(1, text), (2, text.upper()), (3, text.replace("The", "the")), (4, text.replace("É", "é").replace("fox", "cat")), (5, "another text of six words here")], "doc_id long, text string")
    assert sorted(r.doc_id for r in corpus_pipeline.drop_near_duplicates(spark, d, data).collect()) == [1, 4, 5]
    assert np.array_equal(near_dedup.shingle_set(text), near_dedup.shingle_set(text.replace("T", "t")))
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in near_dedup.near_duplicates(d).collect()}
    assert got == components({r.doc_id: r.text for r in d.collect()}) and got[2] == (got[1][0], 1)


def test_quality_measures(docs):
    texts = [r.text for r in docs.collect()] + ["a b c d e a b c d e", "x " * 30, "l\nl\nl\n \n", ""]
    got = quality_rules.measure(texts)
    for i, t in enumerate(texts):
        w = t.encode().split()
        grams = defaultdict(list)
        for j in range(len(w) - 4):
            grams[tuple(w[j : j + 5])].append(j)
        again = {j + k for at in grams.values() if len(at) > 1 for j in at for k in range(5)}
        lines = [x for x in t.split("\n") if x.encode().split()]
        assert got["n_words"][i] == len(w) and got["n_repeat_words"][i] == len(again)
        assert got["word_chars"][i] == sum(len(x.decode()) for x in w)
        assert got["n_symbols"][i] == sum(t.count(c) for c in "#*$%&|<>") and got["n_dup_lines"][i] == len(lines) - len(set(lines))


def test_ablations_follow_from_bits(spark, docs):
    rows = quality_rules.apply_policy(quality_rules.ledger(docs)).cache()
    m = quality_rules.POLICIES["v1"]
    bits = [r.failed_bits & m for r in rows.collect()]
    by = {r.name: 1 << r.bit for r in quality_rules.RULES}
    for r in quality_rules.ablations(rows).collect():
        assert r.failed == sum(b & by[r.rule] != 0 for b in bits) and r.kept_without == sum(b & (m ^ by[r.rule]) == 0 for b in bits)


def test_gradients_are_those_of_the_loss():
    net = language_id.Network(["a", "b", "c"])
    net.p = {k: v.astype(np.float64) for k, v in net.p.items()}
    x = np.concatenate([language_id.spans_of(w)[:, :7] for w in (b"abc", b"hel lo", b"zz")])
    live, y = (x != 0).astype(float), np.array([0, 1, 2])
    letters = live * (x != 32)
    g = net.gradients(x, live, y)

    def loss():
        q, _, _ = net.positions(x, live)
        return -(np.log(q[np.arange(3), :, y]) * letters).sum() / letters.sum()

    for k, v in net.p.items():
        at = (97, 3) if k == "E" else tuple(s // 2 for s in v.shape)
        old = v[at]
        v[at] = old + 1e-3
        hi = loss()
        v[at] = old - 1e-3
        low = loss()
        v[at] = old
        assert abs((hi - low) / 2e-3 - g[k][at]) < 2e-3, k


def plain_state_run(net, raw, d):
    """One direction over one span, position by position, from the definition of the gates."""
    p, h = {k: v.astype(np.float64) for k, v in net.p.items()}, np.zeros(net.hidden)
    sigmoid = lambda x: 1 / (1 + np.exp(-x))
    states = [None] * len(raw)
    for t in range(len(raw)) if d == "f" else reversed(range(len(raw))):
        a = p["E"][raw[t]] @ p[f"W{d}"] + p[f"b{d}"]
        gates = sigmoid(a[: 2 * net.hidden] + h @ p[f"U{d}"])
        z, r = gates[: net.hidden], gates[net.hidden :]
        h = (1 - z) * h + z * np.tanh(a[2 * net.hidden :] + (r * h) @ p[f"Un{d}"])
        states[t] = h
    return states


def test_language_scores_equal_a_plain_network(spark, docs):
    net = language_id.fit(docs.select(F.col("lang").alias("label"), F.col("doc_id").cast("string").alias("key"), F.coalesce("text", F.lit("")).alias("text")))
    rows = [r for r in docs.orderBy("n_chars").limit(40).collect()] + [docs.orderBy(F.desc("n_chars")).first()]
    got = {r.doc_id: r for r in language_id.predict(docs.sparkSession.createDataFrame(rows), net).collect()}
    for row in rows:
        raw, total, n = language_id.folded(row.text or ""), np.zeros(len(net.labels)), 0
        for lo in range(0, len(raw), language_id.SPAN):
            part = raw[lo : lo + language_id.SPAN]
            for f, b, byte in zip(plain_state_run(net, part, "f"), plain_state_run(net, part, "b"), part):
                if byte != 32:
                    s = np.exp(np.concatenate([f, b]) @ net.p["V"] + net.p["c"])
                    total, n = total + s / s.sum(), n + 1
        if n:
            assert got[row.doc_id].score == pytest.approx(total.max() / n, abs=1e-3)
            assert total.max() - total[net.labels.index(got[row.doc_id].lang_pred)] < 1e-3 * n
        else:
            assert (got[row.doc_id].lang_pred, got[row.doc_id].score) == ("und", 0)


def test_language_of_held_out_documents(docs):
    truth = {r.doc_id: r.lang for r in docs.collect()}
    rows = [r for r in language_id.identify(docs).collect() if r.held_out]
    assert np.mean([truth[r.doc_id] == r.lang_pred for r in rows]) > 0.95
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in rows)


def test_targets_are_the_reshared_ones(spark):
    sizes = {"a": 10, "b": 1000, "c": 5, "d": 300, None: 40}
    by = spark.createDataFrame(list(sizes.items()), "source string, source_size long")
    got = {r.source: r.target for r in mixing.targets(by).collect()}
    order = sorted((k for k in sizes if k is not None)) + [None]
    w = {k: (1, 2, 3)[i % 3] for i, k in enumerate(order)}
    capped: set = set()
    while True:
        left = sum(sizes.values()) - sum(3 * sizes[k] for k in capped)
        want = {k: 3 * sizes[k] if k in capped else left * w[k] / sum(w[x] for x in w if x not in capped) for k in w}
        over = {k for k in w if k not in capped and want[k] > 3 * sizes[k]}
        if not over:
            break
        capped |= over
    assert all(abs(got[k] - want[k]) < 1e-6 for k in w)


def test_mixture_is_near_its_targets(docs):
    rows = mixing.mix_plan(docs).toPandas()
    assert (rows["taken"] <= 3 * rows["size"]).all() and (rows["taken"] % rows["size"].clip(lower=1) == 0).all()
    assert rows["taken"].sum() == pytest.approx(rows["size"].sum(), rel=0.1)
    assert sorted(mixing.mix_plan(docs).toPandas()["taken"]) == sorted(rows["taken"])


def test_toxicity_finds_planted_words(spark):
    rng = random.Random(5)
    texts, marks = [], []
    for i in range(600):
        words = [f"w{rng.randrange(400)}" for _ in range(60)]
        if bad := i % 4 == 0:
            words[rng.randrange(60)] = rng.choice(["vilex", "nastyx", "grimly"])
        texts.append((i, ". ".join(" ".join(words[j : j + 10]) for j in range(0, 60, 10))))
        marks.append((i, int(bad)))
    d, y = spark.createDataFrame(texts, "doc_id long, text string"), spark.createDataFrame(marks, "doc_id long, toxic int")
    rows = toxicity.classify(d, y).collect()
    assert np.mean([r.predicted == (r.doc_id % 4 == 0) for r in rows if r.held_out]) > 0.97
    found = toxicity.offending(d, toxicity.fit(d, y)).select("doc_id").distinct().collect()
    assert np.mean([r.doc_id % 4 == 0 for r in found]) > 0.95


def test_quotes_are_linked(spark):
    m = spark.createDataFrame([(1, 0, "user", "Hello there.\nHow are you?"), (1, 1, "assistant", "> Hello there.\n> How  are you?\nFine"), (1, 2, "user", "> > How are you?\n> Fine\n\nGreat"), (1, 3, "user", None), (1, 4, "user", "> unknown\nx"), (None, 0, "user", "abc"), (None, 1, "user", "> ABC\nyes")], "conv_id long, turn long, role string, text string")
    got = {(r.conv_id, r.turn): r for r in chat_format.chat_turns(m).collect()}
    assert [got[1, t].reply_to for t in range(5)] == [None, 0, 1, None, None]
    assert [got[1, t].root_turn for t in range(5)] == [0, 0, 0, 3, 4] and got[1, 2].depth == 2
    assert [got[1, t].body for t in range(1, 5)] == ["Fine", "Great", "", "x"] and got[None, 1].reply_to == 0
    assert chat_format.chat_turns(m.limit(0)).count() == 0


def test_quotes_below_the_first_level_are_linked(spark):
    rows = [(1, 0, "user", "Original words."), (1, 1, "assistant", "An answer.\nMore"), (1, 2, "user", "> X wrote:\n>> Original words.\nYes"), (1, 3, "user", "> An answer.\n>> Original words.\n>>> Yes\nNo"), (1, 4, "user", "> edited\n>> Yes\n>>> An answer.\n>>> More\nOh")]
    m = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    got = {r.turn: r for r in chat_format.chat_turns(m).collect()}
    assert [got[t].reply_to for t in range(5)] == [None, None, 0, 1, 2]
    assert [got[t].n_linked for t in range(5)] == [0, 0, 1, 3, 4] and [got[t].root_turn for t in range(5)] == [0, 1, 0, 1, 0]


def test_token_counts_are_the_librarys(spark, docs):
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=tokenizer_path(token_counts.MODEL))
    texts = ODD + [r.text for r in docs.limit(60).collect()]
    d = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert {r.doc_id: (r.n_tokens, r.n_bytes) for r in token_counts.count_tokens(d).collect()} == {i: (len(sp.encode(t)), len(t.encode())) for i, t in enumerate(texts)}


def plain_likeness(a, b):
    """One less the squared distance of the sketch lanes over their number and both counts of features."""
    if a.tolist() == b.tolist():
        return 1.0
    at = fingerprints.DIGEST
    apart = sum(((int(x) - int(y) + 2**31) % 2**32 - 2**31) ** 2 for x, y in zip(a[at + 1 :], b[at + 1 :]))
    both = float(a[at]) + float(b[at])
    return min(max(1 - apart / fingerprints.SKETCH / max(both, 1), 0), 1 - 1e-9) if both else 0.0


def test_fingerprints_of_repeated_and_missing_ids(spark):
    """Null ids first, then ids; equal ids by a hash of the text: every row meets its next one in any cut into slices."""
    rows = [(None, f"n {i % 7}\nx") for i in range(40)] + [(5, f"five {i} words\nof text {i}") for i in range(60)] + [(i, f"t {i}\n{i} u") for i in range(20)]
    d = spark.createDataFrame(rows, "doc_id long, text string")
    line = [(r.doc_id, r.text) for r in d.orderBy(F.col("doc_id").asc_nulls_first(), F.xxhash64("text"), "text").collect()]
    want = sorted((k or -1, hashlib.sha256((a[: len(a) - len(a) // 4] + b[: len(a) // 4]).encode()).hexdigest()) for (k, a), (_, b) in zip(line, line[1:] + line[:1]))
    for slice_rows in (7, 1000):
        assert sorted((r.doc_id or -1, r.edited_sha256) for r in fingerprints.fingerprints(d, slice_rows=slice_rows).collect()) == want


def test_fingerprints(docs):
    texts = {r.doc_id: r.text for r in docs.collect()}
    ids = sorted(texts)
    rows = {r.doc_id: r for r in fingerprints.fingerprints(docs, slice_rows=37).collect()}
    for i, k in enumerate(ids):
        a, b = texts[k], texts[ids[(i + 1) % len(ids)]]
        new = a[: len(a) - len(a) // 4] + b[: len(a) // 4]
        assert rows[k].edited_sha256 == hashlib.sha256(new.encode()).hexdigest()
        assert rows[k].edited_fingerprint == fingerprints.render(fingerprints.fingerprint(new)) and rows[k].fingerprint == fingerprints.render(fingerprints.fingerprint(a))
        own, new_fp, after = (fingerprints.fingerprint(x) for x in (a, new, b))
        assert rows[k].near_edited == plain_likeness(own, new_fp) and rows[k].near_next == plain_likeness(own, after)
    assert (fingerprints.fingerprint("a b\nc d") == fingerprints.fingerprint("c d\na b")).all()


def test_packing_holds_every_id_once(docs):
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(tokenizer_path(packing.MODEL))
    for text, raw in zip(ODD, packing.token_bytes(pa.array(ODD)), strict=True):
        assert np.frombuffer(raw, "<u4").tolist() == tok.encode(text, add_special_tokens=False).ids
    rows = packing.pack(docs).toPandas()
    for d, part in rows.sort_values("start").groupby("doc_id"):
        text = docs.filter(f"doc_id = {d}").first().text if d < 20 else None
        assert part["start"].tolist() == [0, *part["length"].cumsum().tolist()[:-1]] and part["length"].sum() == part["doc_tokens"].iloc[0]
        if text is not None:
            ids = np.array(tok.encode(text, add_special_tokens=False).ids + [2], "<u4")
            assert all(zlib.crc32(ids[r.start : r.start + r.length].tobytes()) == r.ids_crc32 for r in part.itertuples())
    for _, seq in rows.sort_values("offset").groupby("sequence_id"):
        assert seq["offset"].tolist() == [0, *seq["length"].cumsum().tolist()[:-1]] and seq["length"].sum() <= packing.WINDOW


def test_tightest_window():
    rng = random.Random(1)
    lengths = sorted((rng.randrange(1, 100) for _ in range(200)), reverse=True)
    where, _ = packing.best_fit(lengths, 100)
    rooms: list[int] = []
    for size, w in zip(lengths, where, strict=True):
        fits = [r for r in rooms if r >= size]
        assert (w < len(rooms)) == bool(fits)
        if fits:
            assert rooms[w] == min(fits)
        else:
            rooms.append(100)
        rooms[w] -= size


def test_pipeline_stages_keep_the_columns(spark, data):
    import corpus_pipeline

    docs = table(spark, data, "documents")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, data)
        assert out.columns == docs.columns
    assert set(queries.queries()) >= {"op1_license_scan", "op10_packing"}


def test_licenses_equal_a_plain_scan(spark):
    """Base phrases wherever their words stand in a row, in texts of all sorts of bytes; notices with altered rare words."""
    import re

    rng = random.Random(2)
    parts = ["mit", "MIT", "license", "License", "apache", "general", "public", "the", "x", "é", "-", "9", "\n", " ", "_", "\x7f", "ß", "/"]
    texts = ["".join(rng.choice(parts) + rng.choice(["", " ", " "]) for _ in range(rng.randrange(40))) for _ in range(3000)]
    notice = license_scan.NOTICES[0][1]
    for gone in ("sublicense", "restriction", "documentation", "limitation", "software"):
        texts.append("intro words " + notice.lower().replace(gone, "something") + " and more")
    d = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: r for r in license_scan.scan(d).collect()}
    for i, t in enumerate(texts):
        w = re.findall("[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t))
        at = sorted((k, label) for phrase, label in license_scan.BASE.items() for k in range(len(w)) if w[k : k + len(phrase.split())] == phrase.split())
        r = got[i]
        assert (r.n_words, r.n_base, r.first_word, r.last_word) == (len(w), len(at), at[0][0] if at else None, at[-1][0] if at else None)
        assert r.base_labels == ",".join(sorted({x for _, x in at})) and set(r.base_labels.split(",")) - {""} <= set(r.labels.split(","))
    assert all("mit" in got[i].labels.split(",") for i in range(3000, len(texts)))


def test_toxicity_scores_equal_a_plain_noisy_or(spark, docs, data):
    import re

    labels = table(spark, data, "labels")
    model = toxicity.fit(docs, labels)
    got = {r.doc_id: r.score for r in toxicity.score(docs, model).collect()}
    for r in docs.collect():
        stays = 1.0
        for s in re.split("[.!?\n]", (r.text or "").lower()):
            words = set(re.sub("[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]", " ", s).encode().split())
            if words:
                z = model.bias
                for w in words:
                    t = w.decode()
                    for part in ["=" + t, *("^" + t[:k] for k in range(3, 7) if len(t) >= k)]:
                        z += model.weights.get(int.from_bytes(hashlib.blake2b(part.encode(), digest_size=8).digest(), "little") >> 1, 0.0)
                stays *= 1 - 1 / (1 + np.exp(-z))
        assert got[r.doc_id] == pytest.approx(1 - stays if model.constant is None else model.constant, abs=1e-9)


def plain_threads(messages):
    """turn -> (reply_to, n_linked, root_turn, depth) of one conversation, message by message."""
    import re

    plain = lambda t: re.sub("[ \t\r\n]+", " ", t).strip(" ").lower()
    own, quoted = {}, {}
    for turn, text in messages:
        lines = (text or "").split("\n")
        mine = [x for x in lines if not re.match("[ \t]*>", x)]
        body = re.sub("\n{3,}", "\n\n", "\n".join(mine).strip())
        own[turn] = {plain(x) for x in body.split("\n")} | {plain(body)}
        quoted[turn] = lines
    out = {}
    for turn, lines in quoted.items():
        marked = [(re.match("(?:[ \t]*>)*", x)[0].count(">"), plain(re.sub("^(?:[ \t]*>)+[ \t]?", "", x))) for x in lines]
        items, runs = [(t, level) for level, t in marked if level], []
        for level, t in marked:
            if runs and level and runs[-1][0] == level:
                runs[-1] = (level, (runs[-1][1] + " " + t).strip(" "))
            else:
                runs.append((level, t))
        items += [(t, level) for level, t in runs if level]
        wanted = {}
        for t, level in items:
            if t:
                wanted[t] = min(level, wanted.get(t, level))
        votes = defaultdict(int)
        for t, level in wanted.items():
            first = min((k for k in own if t in own[k]), default=None)
            if first is not None and first < turn:
                votes[level, first] += 1
        if votes:
            best = max(votes, key=lambda v: (-v[0], votes[v], v[1]))
            out[turn] = (best[1], sum(votes.values()))
    full = {}
    for turn in quoted:
        root, depth = turn, 0
        while root in out:
            root, depth = out[root][0], depth + 1
        full[turn] = (*out.get(turn, (None, 0)), root, depth)
    return full


def test_random_threads_equal_a_plain_version(spark):
    rng = random.Random(9)
    rows = []
    for conv in range(60):
        said = []
        for turn in range(rng.randrange(2, 12)):
            lines = [rng.choice(["Yes.", "No  way", "It rains", f"Line {rng.randrange(30)} of it", "", "so"]) for _ in range(rng.randrange(1, 4))]
            for _ in range(rng.randrange(3)):
                if said:
                    old = rng.choice(said).split("\n")
                    lo = rng.randrange(len(old))
                    lines[rng.randrange(len(lines) + 1) : 0] = [rng.choice(["> ", ">", " > "]) + x.upper() if rng.random() < 0.3 else "> " + x for x in old[lo : lo + rng.randrange(1, 4)]]
            said.append("\n".join(lines))
            rows.append((conv, turn, "user", said[-1]))
    d = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    got = {(r.conv_id, r.turn): (r.reply_to, r.n_linked, r.root_turn, r.depth) for r in chat_format.chat_turns(d).collect()}
    want = {(c, t): v for c in range(60) for t, v in plain_threads([(r[1], r[3]) for r in rows if r[0] == c]).items()}
    assert got == want and sum(v[0] is not None for v in want.values()) > 50


def test_packing_ids_of_random_texts_equal_the_librarys():
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(tokenizer_path(packing.MODEL))
    rng = random.Random(4)
    bits = ["a", "B", "İ", "क़", "é", "e\u0301", "ß", "ﬁ", "Σ", "ς", "1", "12", ".", ",", "'s", "'S", "!", "<|endoftext|>", "<|ENDOFTEXT|>", "<|startoftext|>", "\n", "\t", " ", "  ", "한", "中文", "🙂", "\u200b", "\u00a0", "word", "The", "don't", "x.y", "_", "\x1c", "𝐀", "ǅ", "Ⅻ"]
    texts = ["".join(rng.choice(bits) + rng.choice(["", "", " "]) for _ in range(rng.randrange(1, 25))) for _ in range(5000)]
    for text, raw in zip(texts, packing.token_bytes(pa.array(texts)), strict=True):
        assert np.frombuffer(raw, "<u4").tolist() == tok.encode(text, add_special_tokens=False).ids, text


def test_odd_rows_have_their_defined_values(spark, odd, labels):
    by = lambda rows, *cols: sorted((tuple(r[c] for c in ("doc_id", *cols)) for r in rows.collect()), key=lambda t: (t[0] is not None, t[0] or 0, str(t)))
    assert by(license_scan.scan(odd), "n_words", "n_base", "labels") == [(None, 0, 0, ""), (1, 0, 0, ""), (1, 0, 0, ""), (2, 2, 0, ""), (3, 2, 0, ""), (4, 60_000, 0, ""), (5, 1, 0, ""), (6, 4, 0, "")]
    assert by(near_dedup.near_duplicates(odd), "n_shingles", "component_id", "kept") == [(None, 0, None, True), (1, 0, 1, True), (1, 0, 1, True), (2, 1, 2, True), (3, 1, 2, False), (4, 1, 4, True), (5, 1, 5, True), (6, 1, 6, True)]
    rows = quality_rules.apply_policy(quality_rules.ledger(odd))
    assert by(rows, "n_words", "n_dup_lines", "n_repeat_words", "kept") == [(None, 0, 0, 0, False), (1, 0, 0, 0, False), (1, 0, 0, 0, False), (2, 2, 0, 0, False), (3, 2, 0, 0, False), (4, 60_000, 0, 60_000, False), (5, 2, 0, 0, False), (6, 5, 2, 0, False)]
    assert [t[:2] for t in by(language_id.identify(odd), "lang_pred")] == [(None, "und"), (1, "und"), (1, "und"), (2, "en"), (3, "en"), (4, "en"), (5, "und"), (6, "en")]
    assert by(mixing.mix_plan(odd), "size", "source") == [(None, 0, None), (1, 0, "s"), (1, 0, "s"), (2, 2, None), (3, 2, "s"), (4, 60_000, "s"), (5, 2, "t"), (6, 5, "t")]
    assert all(s == 0 for _, s in by(toxicity.classify(odd, labels), "score")[:3])
    assert [t[1:] for t in by(token_counts.count_tokens(odd), "n_bytes", "n_tokens", "over_limit")][:3] == [(0, 0, False)] * 3
    prints = by(fingerprints.fingerprints(odd), "n_chars", "fingerprint", "near_next")
    assert [t[1] for t in prints] == [0, 0, 0, 3, 3, 300_000, 6, 9] and prints[3][2] == prints[4][2] and prints[3][3] == 1.0
    pieces = by(packing.pack(odd), "start", "length", "doc_tokens")
    assert pieces[:3] == [(None, 0, 1, 1), (1, 0, 1, 1), (1, 0, 1, 1)] and sum(t[2] for t in pieces if t[0] == 4) == 60_001
    talk = spark.createDataFrame([(None, None, None, None), (1, 0, "user", "a b"), (1, 0, "user", "a b"), (1, 1, "x", "> a b\n" + "word " * 50_000), (1, 2, "x", "")], "conv_id long, turn long, role string, text string").selectExpr("*", "'h' hash", "1 level", "2 first_turn", "3 body")
    found = sorted((r.conv_id or 0, r.turn or 0, r.reply_to, r.n_linked, len(r.body)) for r in chat_format.chat_turns(talk).collect())
    assert found == [(0, 0, None, 0, 0), (1, 0, None, 0, 3), (1, 0, None, 0, 3), (1, 1, 0, 1, 249_999), (1, 2, None, 0, 0)]


def test_the_pipeline_equals_its_stages_done_plainly(spark, data):
    """Every stage on its predecessor's rows: plain decisions, copies of the mixture, and every id of every copy packed once."""
    from tokenizers import Tokenizer

    import corpus_pipeline

    docs, labels = table(spark, data, "documents"), table(spark, data, "labels")
    texts = {r.doc_id: r.text or "" for r in docs.collect()}
    clean = {r.doc_id for r in toxicity.classify(docs, labels).collect() if r.score < 0.5}
    good = set()
    for k in clean:
        m = quality_rules.measure([texts[k]])
        w, n_words = {x: int(v[0]) for x, v in m.items()}, int(m["n_words"][0])
        letters, lines = w["n_upper"] + w["n_lower"], w["n_lines"]
        bad = n_words < 10 or 100 * w["n_repeat_words"] > 20 * n_words or 10 * w["n_symbols"] > 3 * n_words or 2 * w["n_dup_lines"] > lines
        bad = bad or w["word_chars"] > 15 * n_words or w["word_chars"] < 2 * n_words or (letters >= 40 and w["n_upper"] > w["n_lower"]) or 5 * w["n_bangs"] > n_words
        if not bad:
            good.add(k)
    kept = {k for k, (_, c) in components({k: texts[k] for k in good}).items() if k == c}
    copies = {r.doc_id: r.copies for r in mixing.mix_plan(docs.filter(F.col("doc_id").isin(*kept))).collect()}
    tok = Tokenizer.from_file(tokenizer_path(packing.MODEL))
    rows, seqs = defaultdict(list), defaultdict(list)
    for r in corpus_pipeline.run(spark, data).collect():
        rows[r.doc_id].append(r)
        seqs[r.sequence_id].append((r.offset, r.length))
    assert {k: sum(r.start == 0 for r in v) for k, v in rows.items()} == {k: n for k, n in copies.items() if n}
    for k, v in rows.items():
        n = len(tok.encode(texts[k], add_special_tokens=False).ids) + 1
        assert {r.doc_tokens for r in v} == {n} and sum(r.length for r in v) == n * copies[k]
    for parts in seqs.values():
        ends = [0, *np.cumsum([n for _, n in sorted(parts)]).tolist()]
        assert [o for o, _ in sorted(parts)] == ends[:-1] and ends[-1] <= packing.WINDOW
