import math
import re

import numpy as np
import pyarrow as pa

from opinara.llm import queries, quality


def test_density_difference_matches_definition():
    rng = np.random.default_rng(0)
    x = np.concatenate([rng.normal(0, 1, (200, 3)), rng.normal(1, 2, (300, 3))])
    y = np.repeat([0, 1], [200, 300])
    m = quality.fit(x, y)
    z = (x[:5] - m["centre"]) / m["scale"]
    want = []
    for k in (0, 1):
        cov = np.linalg.inv(m["factor"][k].T @ m["factor"][k])
        d = z - m["mean"][k]
        want.append(-0.5 * np.einsum("ij,jk,ik->i", d, np.linalg.inv(cov), d) - 0.5 * np.log(np.linalg.det(cov)))
    assert np.allclose(quality.score(x[:5], m), 1 / (1 + np.exp(want[0] - want[1])))


def test_held_out_accuracy(spark, sf_dir):
    out = queries.op6_quality(spark, sf_dir).toPandas()
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").toPandas()
    assert len(out) == spark.read.parquet(f"{sf_dir}/documents.parquet").count()
    m = out[out.held_out].merge(labels, on="doc_id")
    assert (m.predicted == m.quality).mean() > 0.9
    assert out.score.between(0, 1).all()


def test_odd_rows(spark):
    rows = [(1, None, "en", 3), (2, "", "en", 0), (None, "a " * 200000, None, None), (4, "Same text.", "x", 1), (4, "Same text.", "y", 2)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, predicted string, score int")
    labels = spark.createDataFrame([(1, 0), (4, None), (None, 1)], "doc_id long, quality int")
    out = quality.classify(docs, quality.train(docs, labels)).collect()
    assert len(out) == 5 and {r.score for r in out} == {0.5}
    assert quality.classify(docs.limit(0), None).count() == 0
    rng = np.random.default_rng(1)
    model = quality.fit(rng.normal(0, 1, (50, len(quality.FEATURES))), np.arange(50) % 2)
    out = quality.classify(docs, model).collect()
    assert all(0 <= r.score <= 1 for r in out)
    assert len({r.score for r in out if r.doc_id == 4}) == 1 and len({r.score for r in out if r.doc_id in (1, 2)}) == 1


def slow_statistics(text):
    raw = (text or "").encode()
    marks = b".,;:'\"-?"
    symbol = [c for c in range(33, 127) if not chr(c).isalnum() and c not in marks]
    n = lambda f: sum(f(c) for c in raw)
    upper, lower, digits = n(lambda c: 65 <= c <= 90), n(lambda c: 97 <= c <= 122), n(lambda c: 48 <= c <= 57)
    symbols, high, marked = n(lambda c: c in symbol), n(lambda c: c >= 128), n(lambda c: c in marks)
    letters, chars = upper + lower, upper + lower + digits + symbols + high + marked
    words = re.findall(rb"[^\x20\x09-\x0D]+", raw)
    low = [bytes(c + 32 if 65 <= c <= 90 else c for c in w) for w in words]
    same = sum(a == b for a, b in zip(low, low[1:], strict=False))
    # Bytes without a name: symbols, sentence marks, control bytes and 127.
    named = lambda c: 48 <= c <= 57 or 65 <= c <= 90 or 97 <= c <= 122 or c >= 128
    bare = sum(not any(map(named, w)) for w in words)
    ends = sum(w[-1] in symbol for w in words)
    short = sum(len(w) <= 3 for w in words)
    pairs = list(zip(low, low[1:], strict=False))
    again = len(pairs) - len(set(pairs))
    lines = [x for x in raw.split(b"\n") if x]
    share = lambda c, t, prior, k: (c + prior * k) / (t + k)
    return [
        math.sqrt(share(upper, letters, 0.03, 60)), math.sqrt(share(symbols, chars, 0.002, 300)), math.sqrt(share(bare, len(words), 0.005, 20)),
        math.sqrt(share(same, len(words), 0.01, 20)), math.sqrt(share(again, 4 * len(words) ** 0.7, 0.05, 40)), math.sqrt(share(ends, len(words), 0.005, 20)),
        math.log(share(chars, len(words), 5.0, 20)), share(short, len(words), 0.35, 20), math.sqrt(share(digits, chars, 0.01, 200)),
        math.sqrt(share(len(lines) - len(set(lines)), len(lines), 0.02, 10)),
    ]


def test_statistics_equal_brute_force(spark, sf_dir):
    texts = [r.text for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("text").collect()]
    texts += [None, "", " \n\n ", "a a a a b a a", "x\nx\n\nx\ny", "?!#$% 12 ÄÖ a!", "The the THE", "w " * 3000]
    got = quality.batch_statistics(pa.array(texts, pa.string()))
    assert np.allclose(got, [slow_statistics(t) for t in texts])
