import random

import numpy as np
import pyarrow as pa
from corvane.llm.subjects import assign, column_of, fit, mixtures, mixtures_of, parse, sentences, subjects_of, terms

WORDS = {"law": "judge court appeal verdict statute bail".split(), "sport": "goal team referee sprint trophy relay".split()}
FILLER = ["The pacing is slow and it ends well.", "A longer cut exists but adds little.", "The cast is small."]


def corpus(n=240, seed=1):
    rng = random.Random(seed)
    docs, labels, want = [], [], {}
    for i in range(n):
        s = ["law", "sport", None][i % 3]
        text = []
        for _ in range(8):
            if s and rng.random() < 0.7:
                a, b = rng.sample(WORDS[s], 2)
                text.append(f"Between the {a} and the {b} there is little room.")
            else:
                text.append(rng.choice(FILLER))
        if i % 7 == 0:
            other = "sport" if s == "law" else "law"
            text[0] = f"The {WORDS[other][0]} waits for the {WORDS[other][1]}."
        docs.append((i, " ".join(text), "x"))
        want[i] = {s} if s and sum("Between" in t for t in text) >= 2 else set()
        if i % 4 == 0:
            labels.append((i, (s or "none").title(), "r"))
    return docs, labels, want


def test_subjects(spark):
    docs, labels, want = corpus()
    d = spark.createDataFrame([*docs, (9000, None, "x"), (9001, "", "x"), (9002, "goal team. " * 30_000, "x")], "doc_id bigint, text string, subject string")
    lab = spark.createDataFrame([*labels, (99999, "law", "r"), (1, "unknown", "r"), (2, None, "r")], "doc_id bigint, subject string, rater string")
    areas = spark.createDataFrame([("law", "x"), ("sport", "x")], "subject string, note string")
    got = {}
    for r in subjects_of(spark, d, lab, areas).collect():
        got.setdefault(r.doc_id, set()).add(r.subject)
    assert got.pop(9002) == {"sport"}
    assert sum(got.get(i, set()) == w for i, w in want.items()) >= 0.97 * len(want)
    assert subjects_of(spark, d.limit(0), lab, areas).count() == 0


def test_no_labels(spark):
    docs, _, _ = corpus(30)
    d = spark.createDataFrame(docs, "doc_id bigint, text string, lang string")
    none = spark.createDataFrame([], "doc_id bigint, subject string")
    model = fit(d, none, ["law"])
    assert model[1].shape[0] == 4 and assign(d, model, ["law"]).count() >= 0


def test_sentences():
    assert sentences("1\n00:00:00,000 --> 00:00:04,200\nHello there. Go!\n\n2\n") == ["Hello there.", "Go!"]
    assert sentences("<movie>\n<title>Some Name</title><plot>One. Two.</plot>") == ["One.", "Two."]
    assert sentences("第一句。第二句。") == ["第一句。", "第二句。"] and sentences(None) == [] and sentences("no end") == ["no end"]
    assert terms("Das Ende, 2") == ["das", "ende"] and terms("法官说") == ["法官", "官说"]


def test_parse_in_arrays():
    texts = ["1\n00:00:00,000 --> 00:00:04,200\nHello there. Go!\n\n2\n", "<movie>\n<title>Some Name</title><plot>One. Two.</plot>", "第一句。第二句。", None, "", "no end", "Ünïcode “quoted.” İ x² _a_b_ Das Ende, 2?  Nächste…\tÇa va", "法官说。a", "...", "--> x. y", "a" * 50_000 + ". 第" + "長" * 3000, "́ é. \x00x."]
    per_doc, lengths, column = parse(pa.array(texts, pa.string()).slice(0, 12))
    got, at, s = [], 0, 0
    for n in per_doc:
        got.append([])
        for _ in range(n):
            got[-1].append(column[at : at + lengths[s]].tolist())
            at, s = at + lengths[s], s + 1
    assert got == [[[column_of(t) for t in terms(x)] for x in sentences(text)] for text in texts]
    assert [len(x) for x in parse(pa.array([], pa.string()))] == [0, 0, 0]


def test_mixtures_reach_the_same_point():
    rng = np.random.default_rng(3)
    h = rng.random((50, 4)).astype(np.float32)
    sizes = rng.integers(0, 20, 300)
    term = np.concatenate([rng.choice(50, n, replace=False) for n in sizes]).astype(np.int64)
    count = rng.integers(1, 5, len(term)).astype(np.float32)
    w, ratio = mixtures(h, term, count, sizes, 5)
    at = 0
    for i, n in enumerate(sizes):
        x, c, y = np.full(4, 0.25), h[term[at : at + n]].astype(float), count[at : at + n]
        for _ in range(5 if n else 0):
            x = x * ((y / (c @ x)) @ c) + 1e-3
            x /= x.sum()
        assert np.allclose(w[i], x, atol=1e-4) and np.allclose(ratio[at : at + n], y / np.maximum(c @ x, 1e-12), rtol=1e-3)
        at += n


def test_mixtures_alone(spark):
    docs, labels, want = corpus()
    d = spark.createDataFrame([*docs, (None, "goal team.", "x"), (docs[0][0], docs[0][1], "y")], "doc_id bigint, text string, source string")
    lab, areas = spark.createDataFrame(labels, "doc_id bigint, subject string, rater string"), spark.createDataFrame([("law",), ("sport",)], "subject string")
    got = {}
    for r in mixtures_of(spark, d, lab, areas, 0.07).collect():
        got.setdefault(r.doc_id, set()).add(r.subject)
    plain = [i for i, text, _ in docs if all(x in " ".join(FILLER) for x in text.split(". "))]
    assert None not in got and sum(w <= got.get(i, set()) for i, w in want.items()) >= 0.99 * len(want) and not any(i in got for i in plain)


def test_queries_on_stored_tables(spark, tmp_path):
    from corvane.llm import queries

    docs, labels, want = corpus(300, 5)
    docs += [(5000 + i, text, source) for i, (_, text, source) in enumerate(docs[:40])]
    want |= {5000 + i: want[docs[i][0]] for i in range(40)}
    for name, rows, schema in (("documents", docs, "doc_id bigint, text string, source string"), ("subject_label", labels, "doc_id bigint, subject string, rater string"), ("subject_area", [("law", ""), ("sport", "")], "subject string, note string")):
        spark.createDataFrame(rows, schema).write.parquet(f"{tmp_path}/{name}.parquet")
    found = {(r.doc_id, r.subject) for r in queries.p9_found(spark, str(tmp_path)).collect()}
    true = {(i, x) for i, w in want.items() for x in w}
    assert len(found & true) >= 0.98 * len(true) and len(found - true) <= 0.02 * len(found)
    counts = {r.subject: r.documents for r in queries.p9_corpus(spark, str(tmp_path)).collect()}
    assert counts == {x: sum(s == x for _, s in found) for x in ("law", "sport")}
    assert {r.doc_id for r in queries.p9_mixtures(spark, str(tmp_path)).collect()} >= {i for i, _ in found & true}
