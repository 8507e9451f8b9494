import random
import re

import numpy as np
import pytest

from opinara.llm import joins
from opinara.llm import ngram_join as nj
from opinara.llm import textkit as tk

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def word_list(text):
    return WORD.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))


def shingle_set(text):
    w = word_list(text)
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def brute(rows, threshold=0.8):
    """{index: (class, links, component)} from all pairs through an inverted index."""
    sets = [shingle_set(t) for _, t in rows]
    index = {}
    for i, s in enumerate(sets):
        for x in s:
            index.setdefault(x, []).append(i)
    root, links = list(range(len(rows))), [0] * len(rows)

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, s in enumerate(sets):
        common = {}
        for x in s:
            for j in index[x]:
                if j < i:
                    common[j] = common.get(j, 0) + 1
        for j, n in common.items():
            if n >= threshold * (len(s) + len(sets[j]) - n):
                links[i] += 1
                links[j] += 1
                root[find(i)] = find(j)
    members = {}
    for i in range(len(rows)):
        members.setdefault(find(i), []).append(i)
    out = {}
    for own in members.values():
        ids = [rows[i][0] for i in own if rows[i][0] is not None]
        for i in own:
            out[i] = (min(ids) if ids else None, links[i], own[0])
    return out


def make(seed=1):
    rng = random.Random(seed)
    vocab = [f"w{k}" for k in range(3000)]
    base = [[rng.choice(vocab) for _ in range(rng.randint(3, 200))] for _ in range(60)]
    rows, k = [], 0
    for b in base:
        for _ in range(rng.choice([1, 1, 2, 4])):
            t = list(b)
            for _ in range(rng.choice([0, 0, 1, 2, 4, 8])):
                t[rng.randrange(len(t))] = rng.choice(vocab)
            rows.append((k, " ".join(t)))
            k += 1
    hot = [rng.choice(vocab) for _ in range(150)]
    for _ in range(60):  # one large group of near copies
        t = list(hot)
        for _ in range(rng.randint(0, 3)):
            t[rng.randrange(len(t))] = rng.choice(vocab)
        rows.append((k, " ".join(t)))
        k += 1
    rows += [(k, None), (k + 1, ""), (k + 2, "!!! ?"), (None, rows[0][1]), (5, rows[9][1].upper() + "!"), (k + 3, "One two"), (k + 4, "one, TWO"), (k + 5, "x " * 50000), (k + 6, "x " * 40000), (7, rows[7][1]), (7, rows[7][1])]
    rng.shuffle(rows)
    return rows


@pytest.mark.parametrize(("block", "hot", "broadcast"), [(384, 1000, 500_000), (16, 1000, 500_000), (16, 4, 500_000), (16, 4, 0)])
def test_equals_brute_force(spark, monkeypatch, block, hot, broadcast):
    monkeypatch.setattr(nj, "BLOCK", block)
    monkeypatch.setattr(joins, "HOT_KEY", hot)
    monkeypatch.setattr(joins, "MAX_BROADCAST", broadcast)
    rows = make()
    docs = spark.createDataFrame([(i, t, "a", "b") for i, t in rows], "doc_id long, text string, n_links string, first string")
    got = nj.near_duplicates(docs).collect()
    want = brute(rows)
    key = lambda x: str(x)
    assert sorted(((r.doc_id, r.class_id, r.n_links) for r in got), key=key) == sorted(((rows[i][0], *v[:2]) for i, v in want.items()), key=key)
    # One document of each class is first, wordless texts each stand alone.
    alone = sum(not word_list(t) for _, t in rows)
    classes = {v[2] for i, v in want.items() if word_list(rows[i][1])}  # two classes may have one class_id, as ids repeat
    assert sum(r.first for r in got) == len(classes) + alone


def test_keep_first(spark):
    rows = make(3)
    docs = spark.createDataFrame([(i, t, "a") for i, t in rows], "doc_id long, text string, lang string")
    kept = nj.keep_first(docs)
    assert kept.columns == docs.columns
    want = brute(rows)
    classes = {v[2] for i, v in want.items() if word_list(rows[i][1])}  # two classes may have one class_id, as ids repeat
    alone = sum(not word_list(t) for _, t in rows)
    assert kept.count() == len(classes) + alone
    assert nj.keep_first(docs.limit(0)).count() == 0


def test_posterior_bound():
    # P(similarity >= t | m of n) under a uniform prior, by numerical integration.
    x = np.linspace(0, 1, 200001)[1:-1]
    for n in nj.STEPS:
        m = nj.least_matches(n, 0.8, 1e-6)
        for k in (m - 1, m):
            density = np.exp(k * np.log(x) + (n - k) * np.log1p(-x))
            tail = density[x >= 0.8].sum() / density.sum()
            assert (tail >= 1e-6) == (k >= m)


def test_signature_estimates_similarity():
    rng = np.random.default_rng(0)
    a = rng.integers(0, 1 << 63, 1000).astype(np.uint64)
    b = np.concatenate([a[:800], rng.integers(0, 1 << 63, 200).astype(np.uint64)])
    sig = nj.signatures(tk.mix(np.concatenate([a, b])), np.array([0, 1000, 2000]))
    assert abs((sig[0] == sig[1]).mean() - 800 / 1200) < 0.15


def test_keep_first_carries_columns_of_any_name(spark):
    names = ["_key", "_id", "_rows", "_stay", "_drop", "_n", "row", "id", "key", "stay", "text_key", "rows", "first", "a.b"]
    docs = spark.createDataFrame([(k, t, *[f"{c}{k}" for c in names]) for k, t in [(1, "a b c d e f"), (2, "A b c d e f!"), (3, None), (4, "x y"), (4, "x y"), (None, "x, y")]], ["doc_id", "text", *names])
    kept = nj.keep_first(docs)
    assert kept.columns == docs.columns
    rows = kept.collect()
    assert sorted(r.doc_id for r in rows) == [1, 3, 4]
    assert all(r[c] == f"{c}{r.doc_id}" for r in rows for c in names)


@pytest.mark.parametrize(("hot", "broadcast"), [(1000, 500_000), (2, 500_000), (2, 0)])
@pytest.mark.parametrize("how", ["inner", "left"])
def test_join_by_size_is_a_join(spark, monkeypatch, hot, broadcast, how):
    monkeypatch.setattr(joins, "HOT_KEY", hot)
    monkeypatch.setattr(joins, "MAX_BROADCAST", broadcast)
    rows = spark.createDataFrame([(k % 5 if k < 40 else k, k) for k in range(50)], "a long, b long")
    table = rows.where("a < 45").groupBy("a").count().withColumnRenamed("count", "n")
    got = joins.join_by_size(rows, table, ["a"], how=how)
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, rows.join(table, ["a"], how).select(*got.columns).collect()))


def test_recall_at_the_threshold(spark):
    """Queries with an id divisible by 20 against all rows, by brute force on whole shingle sets."""
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text")
    rows = [tuple(r) for r in docs.collect()]
    got = {r.doc_id: r.n_links for r in nj.near_duplicates(docs).collect()}
    want = brute(rows)
    wanted = sum(v[1] for i, v in want.items() if rows[i][0] % 20 == 0)
    found = sum(min(got[rows[i][0]], v[1]) for i, v in want.items() if rows[i][0] % 20 == 0)
    assert wanted and found / wanted > 0.999 and all(got[rows[i][0]] <= v[1] for i, v in want.items())
