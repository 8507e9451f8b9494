import math
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from opinara.llm import maxent_lm as lm
from opinara.llm import queries

TOKEN = re.compile(r"[^\x20\x09-\x0D]+")


def token_list(text):
    return [*TOKEN.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")), None]


def brute(rows):
    held = [i is not None and zlib.crc32(str(i).encode()) % 10 == 0 for i, _ in rows]
    counts = Counter(t for (_, text), h in zip(rows, held, strict=True) if not h for t in token_list(text))
    n, v = sum(counts.values()), len(counts)
    return [(i, h, len(w := token_list(t)), sum(x in counts for x in w), n, sum(math.log10((counts[x] + 0.1) / (n + 0.1 * (v + 1))) for x in w)) for (i, t), h in zip(rows, held, strict=True)]


ROWS = [(k, " ".join(f"t{(k * j) % 17}" for j in range(k))) for k in range(60)] + [(None, "A a B\n\nb"), (7, None), (7, None), (100, ""), (101, "never seen before " * 300), (102, "Ünï x y")]


@pytest.mark.parametrize("head", [1 << 18, 3])
def test_baseline_equals_brute_force(spark, head):
    docs = spark.createDataFrame([(i, t, 1.0) for i, t in ROWS], "doc_id long, text string, score double")
    got = sorted((tuple(r) for r in lm.language_scores(docs, head=head).collect()), key=str)
    want = sorted(brute(ROWS), key=str)
    assert [g[:5] for g in got] == [w[:5] for w in want]
    assert np.allclose([g[5] for g in got], [w[5] for w in want], rtol=1e-9)
    assert all(g[6] < 0 for g in got)


def random_model(seed=0, kinds=6000):
    rng = np.random.default_rng(seed)
    hashes = rng.integers(0, 1 << 63, kinds).astype(np.uint64)
    counts = np.sort(rng.integers(1, 500, kinds))[::-1]
    own = (hashes[lm.CLASSES * lm.SIZE :] % np.uint64(lm.SIZE)).astype(int)
    tail = (np.bincount(own, counts[lm.CLASSES * lm.SIZE :], lm.SIZE).astype(np.int64), np.bincount(own, minlength=lm.SIZE))
    m = lm.Model(hashes, counts, int(counts.sum()), kinds, tail)
    m.class_weights[:] = rng.normal(0, 1, m.class_weights.shape)
    m.token_weights[:] = rng.normal(0, 1, m.token_weights.shape)
    return m


def test_probabilities_sum_to_one():
    m = random_model()
    unknown = np.arange(lm.SIZE, dtype=np.uint64)  # one of each kind
    every = np.concatenate([m.head, unknown])
    rank = np.concatenate([np.arange(len(m.head)), np.full(lm.SIZE, -1)])
    context = np.repeat(lm.context_rows(m.head[:5], np.array([0, 5]))[3:4], len(every), 0)
    p = np.exp(lm.score_positions(m, every, rank, context))
    base = (np.concatenate([m.counts, np.zeros(lm.SIZE)]) + 0.1) / m.total
    outer = (rank < 0) | (rank >= lm.CLASSES * lm.SIZE)
    p = np.where(outer, p * base / m.tail_mass[(every % np.uint64(lm.SIZE)).astype(int)], p)
    assert abs(p.sum() - 1) < 1e-4


def test_score_equals_the_definition(spark):
    """Log probabilities from weights and contexts one position at a time, in plain Python."""
    docs = spark.createDataFrame(ROWS[:40], "doc_id long, text string")
    rows = lm.prepare(docs)
    counts = lm.count_tokens(rows)
    m = lm.train(rows, counts, rounds=1)
    rng = np.random.default_rng(3)
    m.class_weights[:], m.token_weights[:] = rng.normal(0, 1, m.class_weights.shape), rng.normal(0, 1, m.token_weights.shape)
    known = {r.token % (1 << 64): r.c for r in counts.collect()}
    ranks = {int(h): k for k, h in enumerate(m.head)}
    mask = (1 << 64) - 1
    mix = lambda x: int(lm.tk.mix(np.array([x & mask], np.uint64))[0])
    end, base = int(lm.END), int(lm.tk.BASE)

    def one(history, token):
        a, b = mix((history[-1] if history else end) + 1), mix((history[-2] if len(history) > 1 else end) + 2)
        context = [a, b, mix(a * 3 + b)]
        r = ranks.get(token, -1)
        k, place = (r // 64, r % 64) if 0 <= r < 63 * 64 else (63, token % 64)
        x = m.class_bias.astype(float) + sum(m.class_weights[c % m.rows].astype(float) for c in context)
        y = m.token_bias[k].astype(float) + sum(m.token_weights[mix(c + (k + 1) * base) % m.rows].astype(float) for c in context)
        value = x[k] - np.log(np.exp(x - x.max()).sum()) - x.max() + y[place] - np.log(np.exp(y - y.max()).sum()) - y.max()
        if k == 63:
            value += math.log((known.get(token, 0) + 0.1) / m.total / m.tail_mass[place])
        return value / math.log(10)

    for r, (_, text) in zip(sorted(lm.score(rows, counts, m).collect(), key=lambda r: r.n_tokens), sorted(ROWS[:40], key=lambda r: len(token_list(r[1]))), strict=True):
        words = [w for w in token_list(text) if w is not None]
        hashes = [*map(int, lm.tk.hash_words(words)), end]
        assert abs(r.score - sum(one(hashes[:k], h) for k, h in enumerate(hashes))) < 1e-3 * len(hashes)


@pytest.mark.parametrize("fan", [64, 2])
def test_the_model_does_not_depend_on_partitions(spark, monkeypatch, fan):
    monkeypatch.setattr(lm, "SHARD_TOKENS", 300)
    monkeypatch.setattr(lm, "FAN", fan)
    docs = spark.createDataFrame(ROWS, "doc_id long, text string")
    models = []
    for n in (4, 40):
        rows = lm.prepare(docs.repartition(n))
        counts = lm.count_tokens(rows)
        models.append(lm.train(rows, counts))
    assert lm.shard_count(models[0].n_tokens) > 2 and np.abs(models[0].token_weights).max() > 0
    assert all(np.array_equal(getattr(models[0], k), getattr(models[1], k)) for k in ("class_weights", "token_weights"))


def test_sizes_grow_with_the_corpus():
    assert [lm.table_rows(n) >> 13 for n in (0, 1 << 26, 1 << 30, 1 << 40, 1 << 50)] == [1, 1, 4, 16, 16]
    assert [lm.shard_count(n) for n in (0, 1, 32 << 20, 128 << 20, 1 << 43)] == [1, 1, 32, 64, 16384]


def test_descent_equals_plain_sums():
    rng = np.random.default_rng(4)
    for n in (1, 50, 4096):
        rows = np.minimum(rng.zipf(1.3, (n, 3)), 999).astype(np.int32)
        g = rng.normal(0, 1, (n, 8)).astype(np.float32)
        w, s = np.zeros((1000, 8), np.float32), np.full(1000, 1e-3, np.float32)
        lm._descend(w, s, rows, g)
        total = np.zeros((1000, 8))
        for k in range(3):
            np.add.at(total, rows[:, k], g.astype(float))
        want = 1e-3 + (total**2).mean(1)
        assert np.allclose(s, want, rtol=1e-4) and np.allclose(w, -total * (lm.STEP / np.sqrt(want + 1e-6))[:, None], atol=1e-4)


def test_gradient_is_that_of_the_likelihood():
    rng = np.random.default_rng(1)
    weights = rng.normal(0, 0.1, (8, 5)).astype(np.float64)
    rows, target, bias = rng.integers(0, 8, (6, 3)), rng.integers(0, 5, 6), rng.normal(0, 1, 5)
    loss = lambda w: -lm._log_softmax_at(lm._logits(bias, w, rows), target).sum()
    logits = lm._logits(bias, weights, rows)
    g = np.exp(logits - logits.max(1)[:, None])
    g /= g.sum(1)[:, None]
    g[np.arange(6), target] -= 1
    full = np.zeros_like(weights)
    for k in range(3):
        np.add.at(full, rows[:, k], g)
    for i, j in ((0, 0), (3, 4), (7, 2)):
        e = np.zeros_like(weights)
        e[i, j] = 1e-6
        assert abs((loss(weights + e) - loss(weights - e)) / 2e-6 - full[i, j]) < 1e-5


def test_model_beats_baseline_on_held_out_texts(spark):
    out = queries.op9_maxent_lm(spark, "/root/testdata/sf0.1").toPandas()
    held = out[out.held_out]
    assert len(out) == 10000 and held.score.sum() > held.base_score.sum()
    assert (out.n_known <= out.n_tokens).all()


@pytest.mark.parametrize("tail", [False, True])
def test_token_factor_learns_from_both_words_together(tail):
    # The third token is the exclusive or of the two before it: neither of them alone says anything about it.
    rng = np.random.default_rng(2)
    kinds = np.array([11, 22, 33, 44, 55, 66], np.uint64)  # all in one class, or all in the tail
    head = np.zeros(0, np.uint64) if tail else np.append(kinds, lm.END)
    own = np.bincount(np.append(kinds, lm.END).astype(np.int64) % lm.SIZE, minlength=lm.SIZE) if tail else np.zeros(lm.SIZE, np.int64)
    m = lm.Model(head, np.full(len(head), 1000), 7000, 7, (own * 1000, own))
    learner = lm.Learner(m)
    a, b = rng.integers(0, 2, 4000), rng.integers(0, 2, 4000)
    hashes = np.stack([kinds[a], kinds[2 + b], kinds[4 + (a ^ b)], np.full(4000, lm.END)], 1).ravel()
    first = np.arange(4001) * 4
    for _ in range(10):
        learner.add(hashes, first)
    learner.finish()
    assert learner.n == 10 * len(hashes)
    p = np.exp(lm.score_positions(m, hashes, m.rank(hashes), lm.context_rows(hashes, first)))
    assert p[2::4].mean() > 0.9


def test_tokens_end_every_text():
    got = [(lo, hi, h, f) for lo, hi, h, f in lm.tokens(pa.array(["a b", None, "", "c"]))]
    assert len(got) == 1 and got[0][3].tolist() == [0, 3, 4, 5, 7]
    assert (got[0][2][[2, 3, 4, 6]] == lm.END).all() and (got[0][2] == lm.END).sum() == 4


def test_empty_table(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert lm.language_scores(docs).count() == 0
    held = next(i for i in range(100) if zlib.crc32(str(i).encode()) % 10 == 0)
    only = spark.createDataFrame([(held, "a b")], "doc_id long, text string")
    r = lm.language_scores(only).collect()[0]
    assert (r.n_tokens, r.n_known, r.train_tokens, r.base_score) == (3, 0, 0, 0.0)


def test_most_frequent_tokens_fit(spark):
    counts = spark.createDataFrame([(k, max(1, 400 // (k + 1))) for k in range(500)], "token long, c long")
    for head in (1, 7, 60, 1000):
        got = {r.token for r in lm.most_frequent(counts, head).collect()}
        assert len(got) <= head and got == set(range(len(got)))
        least = max(1, 400 // (len(got) + 1)) if len(got) < 500 else 0
        assert len(got) + sum(1 for k in range(500) if max(1, 400 // (k + 1)) == least) > head or len(got) == 500
    assert lm.most_frequent(counts.limit(0), 5).count() == 0
