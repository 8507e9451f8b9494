import math
import time

import numpy as np
import pandas as pd

from opinara.llm import queries, toxicity


def naive(folded, entries, exceptions):
    best = {}
    spans = [(i, i + len(f) - 1) for x in exceptions for f in [toxicity.fold(x)] for i in range(len(folded)) if folded.startswith(f, i)]
    for e, w in entries.items():
        for i in range(len(folded)):
            if folded.startswith(e, i) and not any(a <= i and i + len(e) - 1 <= b for a, b in spans) and w > best.get(i, 0):
                best[i] = w
    return math.fsum(best.values()), len(best)


def test_matches_equal_naive_search():
    entries = {" idiot ": 2.0, " idi": 1.0, " scum ": 3.0, " trash ": 1.5}
    entries = {" " + toxicity.fold(k).strip() + (" " if k.endswith(" ") else ""): v for k, v in entries.items()}
    auto = toxicity.automaton(entries, ("trash can", "pond scum"))
    for t in ("You IDIOT!", "1d10t idiom", "trash can, trash", "pond scum scum", "", "idiot idiot", "xidiot", "ѕсum", "i​diot", "ｓｃｕｍ"):
        f = toxicity.fold(t)
        got = toxicity.matches(f, auto)
        assert got == naive(f, entries, ("trash can", "pond scum"))
    assert toxicity.matches(toxicity.fold("1D10T ѕсum"), auto)[1] == 2
    assert toxicity.matches(toxicity.fold("a trash can"), auto)[1] == 0


def test_held_out_accuracy(spark):
    sf_dir = "/root/testdata/sf0.1"
    out = queries.op1_toxicity(spark, sf_dir).toPandas()
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").toPandas()
    m = out[out.held_out].merge(labels, on="doc_id")
    assert (m.predicted == m.toxic).mean() > 0.97
    assert out.score.between(0, 1).all() and ((out.score >= 0.7) == (out.predicted == 1)).all()


def test_odd_rows_and_no_labels(spark):
    docs = spark.createDataFrame([(1, None, 1), (2, "", 2), (None, "stupid " * 100000, 3), (4, "you idiot", 4), (4, "you idiot", 5)], "doc_id long, text string, score int")
    labels = spark.createDataFrame([(1, None), (2, 1)], "doc_id long, toxic int")
    model = toxicity.train(docs, labels)
    rows = toxicity.classify(docs, model).collect()
    assert len(rows) == 5 and len({r.score for r in rows if r.doc_id == 4}) == 1
    assert {r.predicted for r in rows if r.doc_id == 4} == {1} and {r.predicted for r in rows if r.doc_id in (1, 2)} == {0}
    assert toxicity.classify(docs.limit(0), model).count() == 0


def test_curve_is_logistic_regression():
    rng = np.random.default_rng(3)
    x = rng.exponential(1, (2000, 2))
    y = (rng.random(2000) < 1 / (1 + np.exp(3 - 2 * x[:, 0] - x[:, 1]))).astype(int)
    assert np.allclose(toxicity.fit_curve(x, y), (-3, 2, 1), atol=0.4)


def test_exceptions_take_linear_time():
    auto = toxicity.automaton({" " + toxicity.fold("trash").strip() + " ": 1.0}, ("trash can",))
    for text, want in (("trash can " * 20000, 0), ("trash can trash " * 10000, 10000)):
        begin = time.time()
        assert toxicity.matches(toxicity.fold(text), auto)[1] == want
        assert time.time() - begin < 5


def test_entries_equal_definition():
    rng = np.random.default_rng(5)
    words = ["".join(rng.choice(list("abcd"), rng.integers(3, 7))) for _ in range(60)]
    texts = [(set(rng.choice(words, 8)) | ({"vile"} if k % 2 and rng.random() < 0.8 else set()), k % 2) for k in range(400)]
    seen: dict = {}
    for own, label in texts:
        entries = set()
        for w in own:
            entries.add(f" {w} ")
            entries |= {f" {w[:n]}" for n in range(4, min(len(w), 12) + 1)}
        for e in entries:
            seen.setdefault(e, [0, 0])[label] += 1
    counts = pd.DataFrame([(e, v[1], v[0]) for e, v in seen.items()], columns=["entry", "pos", "neg"])
    got = toxicity.choose_entries(counts, 200, 200)
    odds = {e: math.log((v[1] + 0.5) / 201) - math.log((v[0] + 0.5) / 201) for e, v in seen.items() if v[1] >= 4}
    assert got and all(abs(w - odds[e]) < 1e-6 and w >= 3 for e, w in got.items())
    assert any("vile" in e for e in got)
    # Whatever passes the thresholds is in or has a shorter or longer entry in.
    for e, w in odds.items():
        if w >= 3:
            assert e in got or any(e.startswith(x) or x.startswith(e) for x in got), e


def test_exceptions_are_learnt_and_the_score_is_the_curve_at_the_sums(spark):
    rows, labels = [], []
    for k in range(1200):
        filler = f"w{k} x{k * 7} y{k * 11}"
        bad = k % 4 == 0
        rows.append((k, f"{filler} p{k} vermin z{k}" if bad else f"{filler} vermin control v{k}" if k % 120 == 1 else filler))
        labels.append((k, int(bad)))
    docs = spark.createDataFrame([(i, t, 1) for i, t in rows], "doc_id long, text string, k0 int")
    model = toxicity.train(docs, spark.createDataFrame(labels, "doc_id long, toxic int"))
    assert any("vermin controi" in x for x in model["exceptions"])
    assert any("vermin" in e for e in model["entries"])
    entries, exceptions, c = model["entries"], model["exceptions"], model["curve"]
    got = {r.doc_id: r for r in toxicity.classify(docs, model).collect()}
    for i, t in rows:
        f = toxicity.fold(t)
        total, n = naive(f, entries, exceptions)
        a, b = (math.log1p(total), total / math.sqrt(len(f.split()) + 30)) if n else (0.0, 0.0)
        p = 1 / (1 + math.exp(-(c[0] + c[1] * a + c[2] * b)))
        assert abs(got[i].score - p) < 1e-9 and got[i].n_matches == n and got[i].predicted == (p >= 0.7)


def test_near_copies_teach_once(spark):
    rows = [(k, "you vile scum of the earth number", 1) for k in range(50)] + [(100 + k, f"text {k * 3} of {k * 5} its own {k * 7}", 1) for k in range(9)]
    out = toxicity.distinct_texts(spark.createDataFrame(rows, "doc_id long, text string, label int")).collect()
    assert len(out) == 10
