import sys

import pytest

corpus_pipeline = pytest.importorskip("corpus_pipeline")

from opinara.llm import decontam, mixing, quality  # noqa: E402
from tests.llm import test_decontam, test_mixing, test_ngram_join, test_substring_dedup  # noqa: E402


def test_stages_match_brute_force(spark, sf_dir):
    """Each stage's rows against brute force on that stage's own input."""
    columns = spark.read.parquet(f"{sf_dir}/documents.parquet").columns
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").collect()]
    stages = dict(corpus_pipeline.STAGES)

    kept = stages["quality classifier"](spark, docs, sf_dir)
    rows = kept.collect()
    model = quality.train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    good = {r.doc_id for r in quality.classify(docs, model).where("score >= 0.5").collect()}
    assert {r.doc_id for r in rows} == good and kept.columns == columns
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{sf_dir}/labels.parquet").collect()}
    assert sum(labels.get(r.doc_id) == 0 for r in rows) <= 3

    docs = spark.createDataFrame(rows, kept.schema)
    kept = stages["n-gram Jaccard join"](spark, docs, sf_dir)
    want = test_ngram_join.brute([(r.doc_id, r.text) for r in rows])
    wordless = {i for i, r in enumerate(rows) if not test_ngram_join.word_list(r.text)}
    first = {want[i][0] for i in want if i not in wordless} | {rows[i].doc_id for i in wordless}
    rows = kept.collect()
    assert {r.doc_id for r in rows} == first and len(rows) == len(first) and kept.columns == columns

    docs = spark.createDataFrame(rows, kept.schema)
    test_substring_dedup.KEYS.update({r.t: r.k for r in docs.selectExpr("coalesce(text, '') t", "xxhash64(coalesce(text, '')) k").collect()})
    want = {r[0]: r for r in test_substring_dedup.brute([(r.doc_id, r.text) for r in rows])}
    kept = stages["suffix-array dedup"](spark, docs, sf_dir)
    rows = kept.collect()
    assert {r.doc_id for r in rows} == {i for i, r in want.items() if r[2] < r[1] or r[1] == 0} and kept.columns == columns
    assert all(r.n_chars == len(r.text) and abs(len(r.text.encode()) - (want[r.doc_id][1] - want[r.doc_id][2])) <= 6 * want[r.doc_id][3] for r in rows)

    docs = spark.createDataFrame(rows, kept.schema)
    kept = stages["benchmark decontamination"](spark, docs, sf_dir)
    wins = {tuple(w[k : k + 10]) for _, t in items if (w := test_decontam.words(t)) for k in range(max(1, len(w) - 9))}
    sizes = {len(w) for w in wins}
    bad = {r.doc_id for r in rows if any(tuple(w[k : k + n]) in wins for w in [test_decontam.words(r.text)] for n in sizes for k in range(len(w) - n + 1))}
    rows2 = kept.collect()
    assert {r.doc_id for r in rows2} == {r.doc_id for r in rows} - bad and kept.columns == columns

    docs = spark.createDataFrame(rows2, kept.schema)
    out = stages["mixing sources to target weights"](spark, docs, sf_dir).collect()
    per = {}
    for r in rows2:
        per[r.source] = per.get(r.source, 0) + 1
    total = sum(n**mixing.TEMPERATURE for n in per.values())
    rate = {s: n**mixing.TEMPERATURE * len(rows2) / total / n for s, n in per.items()}
    want = {r.doc_id: test_mixing.poisson_inverse(test_mixing.uniform(17, r.doc_id), rate[r.source]) for r in rows2}
    got = {}
    for r in out:
        got[r.doc_id] = got.get(r.doc_id, 0) + 1
    assert got == {k: v for k, v in want.items() if v}


def test_run_equals_stages_in_turn(spark, sf_dir):
    out = corpus_pipeline.run(spark, sf_dir)
    assert out.count() > 0 and set(corpus_pipeline.COLUMNS) < set(out.columns)
    assert decontam.WINDOW == 10 and "corpus_pipeline" in sys.modules


#: Columns with the names that the operators use inside.
EXTRA = ["0.5 score", "'x' kept", "7 key", "1 nth", "3 row"] + [f"'{c}' `{c}`" for c in ("_key", "_id", "_rows", "_stay", "_drop", "_own", "own", "bad", "carried", "_carried2", "_u", "_n", "_s", "_cdf", "n", "u", "s", "id", "cut", "label", "predicted", "held_out", "class_id", "rep", "root", "contaminated", "a.b")]


def test_odd_documents_pass_every_stage(spark, sf_dir, tmp_path):
    import shutil

    for t in ("labels", "benchmark"):
        shutil.copy(f"{sf_dir}/{t}.parquet", tmp_path / f"{t}.parquet")
    good = spark.read.parquet(f"{sf_dir}/documents.parquet").selectExpr("doc_id", "text", "lang", "source", "n_chars", *EXTRA)
    odd = spark.createDataFrame([(None, "short text of no one", None, None, None), (900001, None, "en", "s", 1), (900002, "", None, "s", 0), (900003, "y " * 150000, "en", None, 2), (900004, "twice the same row", "en", "s", 3), (900004, "twice the same row", "en", "s", 3)], "doc_id long, text string, lang string, source string, n_chars long").selectExpr("*", *EXTRA)
    docs = good.unionByName(odd)
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, str(tmp_path))
        assert set(docs.columns) <= set(out.columns), name
        if name != corpus_pipeline.STAGES[-1][0]:
            assert out.columns == docs.columns
            assert out.where("score <> 0.5 or kept <> 'x' or key <> 7 or _key <> '_key' or _own <> '_own' or `a.b` <> 'a.b'").count() == 0
            assert stage(spark, docs.limit(0), str(tmp_path)).count() == 0
        rows = out.collect()
        assert len([r for r in rows if r.doc_id == 900004]) <= 2
        docs = spark.createDataFrame(rows, out.schema)
