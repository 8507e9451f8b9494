import hashlib
import re

import pandas as pd
import pytest

from opinara.llm import decontam

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
SCHEMA = "doc_id long, text string, item_id string, source string"


def words(text):
    return WORD.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))


def brute(docs, items):
    out = []
    wins = [(i, w[k : k + 10]) for i, t in items if (w := words(t)) for k in range(max(1, len(w) - 9))]
    for doc_id, text in docs:
        w, hit, own = words(text), set(), set()
        for i, win in wins:
            for s in range(len(w) - len(win) + 1):
                if w[s : s + len(win)] == win:
                    hit |= set(range(s, s + len(win)))
                    own.add(i)
        out.append((doc_id, len(w), len(hit), len(own), hashlib.sha256(",".join(sorted(map(str, own))).encode()).hexdigest(), len(hit) > 0))
    return sorted(out, key=str)


def run(spark, docs, items, **kw):
    d = spark.createDataFrame([(i, t, "x", None) for i, t in docs], SCHEMA)
    b = spark.createDataFrame(items, "item_id long, text string")
    return decontam.decontaminate(d, b, **kw)


LONG = " ".join(f"w{k}" for k in range(40))
ITEMS = [(1, LONG), (2, "Alpha beta, gamma"), (3, None), (4, "!!"), (5, " ".join(f"w{k}" for k in range(12))), (10, "alpha BETA gamma"), (7, "na na na na")]
DOCS = [(1, "zz " + LONG.upper() + " q " + LONG), (2, None), (3, ""), (4, "alpha-beta gamma beta gamma alpha beta gamma"), (None, "Alpha beta gamma"), (4, "na na na na na na"), (6, " ".join(f"w{k}" for k in range(9))), (7, "é " * 50 + " ".join(f"w{k}" for k in range(3, 13))), (8, "x " * 9000 + LONG)]


def test_matches_brute_force(spark):
    out = run(spark, DOCS, ITEMS)
    got = [tuple(r)[:6] for r in out.collect()]
    assert sorted(got, key=str) == brute(DOCS, [x for x in ITEMS])


def test_blocks_give_the_same(spark):
    a = sorted((tuple(r) for r in run(spark, DOCS, ITEMS).collect()), key=str)
    assert sorted((tuple(r) for r in run(spark, DOCS, ITEMS, limit=100).collect()), key=str) == a


def test_items_without_an_id_count_as_hits_only(spark):
    items = [(None, "alpha beta gamma"), ((1 << 60) + 1, "na na na na"), (None, None)]
    none, one = (hashlib.sha256(x).hexdigest() for x in (b"", str((1 << 60) + 1).encode()))
    docs = [(1, "x alpha beta gamma"), (2, "na na na na alpha beta gamma"), (3, "alpha beta")]
    want = [(1, 4, 3, 0, none, True), (2, 7, 7, 1, one, True), (3, 2, 0, 0, none, False)]
    for limit in (decontam.BLOCK_BYTES, 10):
        assert sorted(tuple(r)[:6] for r in run(spark, docs, items, limit=limit).collect()) == want


def test_empty_tables(spark):
    assert run(spark, [], ITEMS).count() == 0
    assert [r.n_hit for r in run(spark, [(1, "a b")], []).collect()] == [0]


def test_proximity_in_any_order(spark):
    docs = [(1, "gamma x alpha y beta"), (2, "gamma " + "x " * 20 + "alpha beta"), (3, "alpha beta")]
    got = {r.doc_id: (r.n_items, r.n_near_items) for r in run(spark, docs, [(1, "alpha beta gamma")], span=6).collect()}
    assert got == {1: (0, 1), 2: (0, 0), 3: (0, 0)}


def test_whole_table_against_brute_force(spark, sf_dir):
    import pyarrow.parquet as pq

    docs = pq.read_table(f"{sf_dir}/documents.parquet").to_pandas()
    items = pq.read_table(f"{sf_dir}/benchmark.parquet").to_pandas()
    items = list(zip(items.item_id, items.text, strict=True))
    vocab = {tuple(w[k : k + 10]) for _, t in items if (w := words(t)) for k in range(max(1, len(w) - 9))}
    firsts = {w[0] for w in vocab}
    few = [(i, t) for i, t in zip(docs.doc_id, docs.text, strict=True) if any(tuple(w[k : k + 10]) in vocab for w in [words(t)] for k in range(len(w)) if w[k] in firsts)]
    out = decontam.decontaminate(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet")).toPandas()
    assert len(out) == len(docs)
    got = out[out.contaminated].drop(columns="n_near_items").itertuples(index=False, name=None)
    assert sorted(got, key=str) == brute(few, items)


def test_item_ids_of_any_type(spark):
    docs = spark.createDataFrame([(1, "x alpha beta gamma"), (2, "na na na na")], "doc_id long, text string")
    items = spark.createDataFrame([("q-1", "alpha beta gamma"), ("10", "alpha beta gamma"), (None, "na na na na")], "item_id string, text string")
    got = {r.doc_id: (r.n_items, r.items_sha256, r.contaminated) for r in decontam.decontaminate(docs, items).collect()}
    assert got == {1: (2, hashlib.sha256(b"10,q-1").hexdigest(), True), 2: (0, hashlib.sha256(b"").hexdigest(), True)}


def test_index_holds_the_postings_of_every_word(spark):
    import numpy as np

    docs = spark.createDataFrame([(1, "a b a"), (2, "c, B!"), (3, None)], "doc_id long, text string").coalesce(1)
    rows = decontam.build_index(docs).collect()
    seen = {}
    for r in rows:
        terms, counts, places = np.frombuffer(r.terms, np.uint64), np.frombuffer(r.counts, np.int64), np.frombuffer(r.positions, np.uint32)
        base = np.frombuffer(r.base, np.int64)
        for t, p in zip(np.repeat(terms, counts), places, strict=True):
            d = int(np.searchsorted(base, p, "right")) - 1
            seen.setdefault(int(t), []).append((int(np.frombuffer(r.doc_ids, np.int64)[d]), int(p - base[d])))
    want = dict(zip(map(int, decontam.tk.hash_words(["a", "b", "c"])), [[(1, 0), (1, 2)], [(1, 1), (2, 1)], [(2, 0)]], strict=True))
    assert seen == want
