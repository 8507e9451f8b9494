import numpy as np
import pyarrow as pa

from opinara.llm import langid, queries, textkit


def slow_bits(text, train, order):
    """Code length by walking the contexts of one tree."""
    counts = {}
    for t in train:
        b = b"\n" * order + t.encode()
        for i in range(order, len(b)):
            for n in range(order + 1):
                counts.setdefault(b[i - n : i], {}).setdefault(b[i], 0)
                counts[b[i - n : i]][b[i]] += 1
    b, total = b"\n" * order + text.encode(), 0.0
    for i in range(order, len(b)):
        for n in range(order, -1, -1):
            own = counts.get(b[i - n : i])
            if own is None:
                continue
            s = sum(own.values()) + len(own)
            if b[i] in own:
                total -= np.log2(own[b[i]] / s)
                break
            total -= np.log2(len(own) / s)
        else:
            total += 8.0
    return total


def test_code_lengths_equal_tree_walk():
    a, b = ["the cat sat on the mat", "that hat", ""], ["der hund und die katze", "schön ß"]
    for order in (1, 2, 3, 5):
        model = langid.Model(["a", "b"], [langid.count_grams(pa.array(x), order) for x in (a, b)], order)
        texts = ["the mat", "katze und cat", "", "zzz ü", "t", None, "the"]
        got = np.concatenate([model.code_lengths(d, o) for _, _, d, o in textkit.doc_chunks(pa.array(texts))])
        want = [[slow_bits(t or "", x, order) for x in (a, b)] for t in texts]
        assert np.allclose(got, want)


def test_held_out_accuracy(spark):
    sf_dir = "/root/testdata/sf0.01"
    out = queries.op4_language(spark, sf_dir).toPandas()
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "lang").toPandas()
    m = out.merge(docs, on="doc_id")
    assert len(out) == len(docs) and (m[m.held_out].lang == m[m.held_out].lang_pred).mean() > 0.97


def test_odd_rows(spark):
    rows = [(1, "the cat sat on the mat and that was it", "en"), (2, "der hund und die katze", "de"), (3, None, "en"), (4, "12 34 !", "de"), (None, "the hat " * 50000, None), (6, "", "en"), (7, "the the", None), (7, "the the", None)] + [(k, "the dog is here", "en") for k in range(10, 20)] + [(k, "der hund ist da", "de") for k in range(20, 30)]
    docs = spark.createDataFrame([(*r, 1.0) for r in rows], "doc_id long, text string, lang string, lang_pred double")
    got = [(r.doc_id, r.lang_pred) for r in langid.predict(docs, langid.train(docs)).collect()]
    assert [x for x in got if x[0] in (None, 3, 4, 6, 7)] == [(3, "und"), (4, "und"), (None, "en"), (6, "und"), (7, "en"), (7, "en")]
    empty = docs.limit(0)
    model = langid.train(empty)
    assert langid.predict(empty, model).count() == 0
    assert {r.lang_pred for r in langid.predict(docs, model).collect()} == {"und"}


def test_any_number_of_languages(spark, monkeypatch):
    """600 languages, each with its own letters; blocks of languages are one model."""
    rows, rng = [], np.random.default_rng(0)
    for k in range(600):
        letters = [chr(0x4E00 + 8 * k + j) for j in range(8)]
        rows += [(10 * k + j, "".join(rng.choice(letters, 30)), f"l{k:03d}") for j in range(6)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(4)
    model = langid.train(docs)
    out = langid.predict(docs, model).toPandas().merge(docs.toPandas(), on="doc_id")
    assert len(model.languages) == 600 and len(model.parts) == 6 and (out.lang_pred == out.lang).mean() > 0.99
    monkeypatch.setattr(langid, "BLOCK", 1000)
    whole = langid.train(docs)
    texts = pa.array([r[1] for r in rows[::97]] + ["abc", "", "漢字"])
    for (_, _, d, o), (_, _, e, f) in zip(textkit.doc_chunks(texts), textkit.doc_chunks(texts), strict=True):
        assert np.allclose(model.code_lengths(d, o), whole.code_lengths(e, f))


def test_long_texts_and_repeated_ids(spark):
    rows = [(1, f"the cat {k}", "en") for k in range(3000)] + [(2, "der hund", "de"), (3, "die katze " * 300_000, "de"), (4, "the dog", "en")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    assert langid.one_text_each(docs, "lang", "doc_id").count() == 4
    got = {r.doc_id: r.lang_pred for r in langid.predict(docs, langid.train(docs)).collect()}
    assert got[3] == "de" and got[1] == "en"
    odd = spark.createDataFrame([("7", "the cat", "en"), ("x", "the dog", "en"), (None, "the", None)], "doc_id string, text string, lang string")
    assert sorted((r.doc_id is None, r.lang_pred) for r in langid.predict(odd, langid.train(odd)).collect()) == [(False, "en"), (True, "en"), (True, "en")]
