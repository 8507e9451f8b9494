import math
from itertools import combinations

import numpy as np
import pytest
from pyspark.sql import functions as F

from opinara.functions import stats
from opinara.operators import curves, dimension, knn, places, resampling, semantic, subsets
from opinara.plans import catalogue


def pair_rows(rng, topics, societies, missing=0.0):
    return [(s, a, b, float(rng.random())) for s in societies for a, b in combinations(topics, 2) if rng.random() >= missing]


@pytest.mark.parametrize(("n", "size", "missing"), [(9, 7, 0.0), (12, 5, 0.3), (23, 3, 0.2)])
def test_subset_means_of_all_sets(spark, monkeypatch, n, size, missing):
    monkeypatch.setattr(subsets, "STEP", 100)
    topics = [f"t{k:02d}" for k in range(n)]
    rows = pair_rows(np.random.default_rng(n), topics, "AB", missing)
    df = spark.createDataFrame([*rows, ("A", topics[0], "other", 1.0), ("A", topics[1], topics[0][:2], 2.0), ("C", topics[0], topics[1], None)], "society string, t1 string, t2 string, y double")
    value = {(s, a, b): y for s, a, b, y in rows}
    want, whole = {}, {}
    for s in "AB":
        for k, c in enumerate(combinations(topics, size)):
            seen = [value[s, a, b] for a, b in combinations(c, 2) if (s, a, b) in value]
            if seen:
                want[s, k] = (len(seen), round(sum(seen) / len(seen), 9))
            if len(seen) == math.comb(size, 2):
                whole[s, k] = want[s, k]
    want |= {("C", k): (1, None) for k, c in enumerate(combinations(topics, size)) if c[:2] == tuple(topics[:2])}  # its pair has no value
    for complete, expected in ((False, want), (True, whole)):
        got = {(r.society, r.subset): (r.pairs, None if r.mean is None else round(r.mean, 9)) for r in subsets.subset_means(df, topics, size, complete=complete).collect()}
        assert got == expected


def test_zeta_and_unranking():
    rng = np.random.default_rng(1)
    square = rng.random((7, 7))
    square = square + square.T
    z = subsets.zeta(square)
    for m in range(1 << 7):
        own = [k for k in range(7) if m >> k & 1]
        assert abs(z[m] - sum(square[a, b] for a, b in combinations(own, 2))) < 1e-9
    for n, size in ((6, 3), (5, 5), (8, 1), (150, 2)):
        assert subsets.unrank(np.arange(math.comb(n, size)), n, size).tolist() == [list(c) for c in combinations(range(n), size)]


def test_gaps_and_grids_equal_the_product(spark):
    rng = np.random.default_rng(2)
    means = {s: np.round(rng.normal(m, 1, k) * 64) / 64 for s, m, k in (("A", 0, 300), ("B", 1, 170), ("C", 5, 1))}
    df = spark.createDataFrame([(s, float(v)) for s, x in means.items() for v in x], "society string, mean double").repartition(3)
    marks = {("A", "B"): (0.5, 1.25)}  # exact in binary, so that ties count alike
    got = {(r.a, r.b): r for r in subsets.set_gaps(df, [("A", "B"), ("A", "C"), ("C", "B")], marks).collect()}
    for (a, b), r in got.items():
        gap = np.abs(means[a][:, None] - means[b][None])
        assert r.combinations == gap.size and np.allclose([r.mean_gap, r.min_gap, r.max_gap], [gap.mean(), gap.min(), gap.max()])
        assert np.allclose(r.below, [(gap < t).mean() for t in marks.get((a, b), ())])
    rows = [(s, k, float(rng.random()), float(rng.random())) for s in "ABC" for k in range(6)]
    grid = subsets.dispersion_grid(spark.createDataFrame(rows, "society string, subset int, off double, on double"), "ABC")
    got = sorted((round(r.off, 9), round(r.on, 9)) for r in grid.collect())
    by = {s: [r for r in rows if r[0] == s] for s in "ABC"}
    assert got == sorted((round(float(np.std([x[2], y[2], z[2]])), 9), round(float(np.std([x[3], y[3], z[3]])), 9)) for x in by["A"] for y in by["B"] for z in by["C"])


def test_keyed_permutations_are_permutations():
    for n in (1, 2, 3, 17, 64, 1000):
        out = resampling.permuted(np.arange(n), n, np.arange(40, dtype=np.uint64))
        assert all(sorted(r) == list(range(n)) for r in out)
        part = resampling.permuted(np.arange(n // 2, n), n, np.arange(40, dtype=np.uint64))
        assert (part == out[:, n // 2 :]).all()
    out = resampling.permuted(np.arange(50), 50, np.arange(4000, dtype=np.uint64))
    assert len({tuple(r) for r in out}) == 4000
    hits = np.array([[np.count_nonzero(out[:, i] == j) for j in range(50)] for i in range(50)])
    assert abs(((hits - 80) ** 2 / 80).sum() / 49**2 - 1) < 0.2  # chi square over its degrees of freedom


def test_shuffles_in_blocks_equal_whole_ones_and_the_closed_form(spark, monkeypatch):
    rng = np.random.default_rng(3)
    x = rng.normal(size=900)
    rows = [("a", "b", float(v), float(v + w)) for v, w in zip(x, rng.normal(size=900), strict=True)] + [("a", "c", 1.0, 2.0)] * 3 + [("b", "c", 1.0, 2.0), ("b", "d", None, 1.0), ("b", "d", 1.0, 2.0), ("b", "d", 2.0, 1.0)]
    df = spark.createDataFrame(rows, "t1 string, t2 string, x double, y double").repartition(5)
    whole = {(r.t1, r.t2): r for r in resampling.shuffled_correlations(df, 1500).collect()}
    monkeypatch.setattr(resampling, "BLOCK", 200)
    parts = {(r.t1, r.t2): r for r in resampling.shuffled_correlations(df, 1500).collect()}
    r = whole["a", "b"]
    assert r.n == 900 and abs(r.r - np.corrcoef([q[2] for q in rows[:900]], [q[3] for q in rows[:900]])[0, 1]) < 1e-9
    assert abs(r.shuffled_mean) < 5 / 899**0.5 / 1500**0.5 and abs(r.shuffled_sd * 899**0.5 - 1) < 5 / 3000**0.5
    for k, w in whole.items():
        assert k in parts and all(a is None and b is None or abs(a - b) < 1e-9 for a, b in zip(w[2:], parts[k][2:], strict=True))
    assert whole["a", "c"][2:] == (3, None, None, None) and whole["b", "c"].n == 1 and whole["b", "d"].n == 2


def test_shuffles_of_more_than_two_million_rows(spark):
    df = spark.range(2_100_000).selectExpr("'a' t1", "'b' t2", "cast(pmod(xxhash64(id), 100003) as double) x", "cast(pmod(xxhash64(id, 7), 100003) as double) y")
    r = resampling.shuffled_correlations(df, 60).first()
    exact = 1 / (r.n - 1) ** 0.5
    assert r.n == 2_100_000 and abs(r.shuffled_mean) < 5 * exact / 60**0.5 and abs(r.shuffled_sd / exact - 1) < 5 / 120**0.5


def test_rank_differences_equal_plain_loops(spark, monkeypatch):
    monkeypatch.setattr(resampling, "WEIGHED", 7)
    rng = np.random.default_rng(4)
    rows = [(s, t, k, rng.normal(size=5).tolist(), float(rng.integers(1, 9))) for s in "ab" for t in "xyz" for k in range(12 + 8 * (s == "a"))]
    rows += [("a", "x", 99, None, 1.0), ("b", "y", 98, [1.0] * 5, None), ("c", "x", 1, [1.0] * 5, 1.0)]
    df = spark.createDataFrame(rows, "source string, topic string, word long, vector array<double>, weight double")
    keys = {(r.source, r.topic, r.word): r.k for r in df.select("source", "topic", "word", F.xxhash64(F.lit(5), "source", "topic", "word").alias("k")).collect()}
    used = [r for r in rows[:-1] if r[3] is not None and r[4] is not None]

    def ranks(draw):
        out = []
        for s in "ab":
            c = []
            for t in "xyz":
                own = [r for r in used if r[:2] == (s, t)]
                e = [1.0 if draw is None else float(resampling.exponentials(np.array([keys[r[:3]]], np.int64).view(np.uint64), np.array([draw]))[0, 0]) for r in own]
                v = sum(w * r[4] * np.array(r[3]) for w, r in zip(e, own, strict=True))
                c.append(v / np.linalg.norm(v))
            m = stats.spectrum(np.array(c) @ np.array(c).T)
            out.append((m["pr"], m["erank"]))
        return out[0][0] - out[1][0], out[0][1] - out[1][1]

    got = {r.measure: r for r in resampling.rank_differences(df, "a", "b", draws=230, seed=5).collect()}
    draws = np.array([ranks(d) for d in range(230)])
    for k, m in enumerate(("pr", "erank")):
        assert abs(got[m].difference - ranks(None)[k]) < 1e-9
        assert np.allclose([got[m].lo, got[m].hi], np.quantile(draws[:, k], [0.025, 0.975]))
    e = resampling.exponentials(np.arange(20_000, dtype=np.uint64), np.arange(3))
    assert abs(e.mean() - 1) < 0.02 and abs(e.var() - 1) < 0.05 and abs(np.corrcoef(e.T)[0, 1]) < 0.03


@pytest.mark.parametrize("weighted", [False, True])
def test_binned_densities_are_near_the_exact_ones(spark, weighted):
    rng = np.random.default_rng(5)
    x = np.concatenate([rng.normal(0, 1, 3000), rng.normal(8, 0.2, 500)])
    w = rng.random(len(x)) + 0.1
    rows = [("g", float(a), float(b)) for a, b in zip(x, w, strict=True)] + [("one", 1.0, 1.0), ("flat", 2.0, 1.0), ("flat", 2.0, 1.0), ("g", None, 1.0), ("g", 1.0, -1.0 if weighted else None)][: 5 if weighted else 4]
    df = spark.createDataFrame(rows, "g string, x double, w double")
    got = curves.density_curve(df, "g", "x", 60, "w" if weighted else None).orderBy("x").collect()
    assert {r.g for r in got} == {"g"}
    at = np.array([r.x for r in got])
    own = w if weighted else None
    exact = stats.kde(x, at, own)
    p = np.ones(len(x)) / len(x) if own is None else own / own.sum()
    m = (p * x).sum()
    h = math.sqrt((p * (x - m) ** 2).sum() / (1 - (p**2).sum()) * (p**2).sum() ** 0.4)
    bound = ((x.max() - x.min()) / 4096 / h) ** 2 / 8 / (h * math.sqrt(2 * math.pi))
    assert np.abs(np.array([r.density for r in got]) - exact).max() <= bound + 1e-12


def test_local_lines_equal_the_windowed_ones(spark):
    rng = np.random.default_rng(6)
    rows = [(g, float(np.round(a, 1)), float(b), float(c)) for g, n in (("a", 120), ("b", 7)) for a, b, c in rng.random((n, 3))] + [("c", 1.0, float(k), 1.0) for k in range(4)] + [("d", 1.0, 2.0, 1.0), ("a", None, 1.0, 1.0), ("a", 0.5, None, 1.0)]
    df = spark.createDataFrame(rows, "g string, x double, y double, w double").repartition(4)
    got = {(r.g, r.span, r.fit, round(r.x, 9)): r.value for r in curves.local_lines(df, "g", "x", "y", {"raw": None, "own": "w"}, (0.3, 0.5, 0.7), 11).collect()}
    for g in "abcd":
        own = np.array([r[1:] for r in rows if r[0] == g and r[1] is not None and r[2] is not None])
        at = np.linspace(own[:, 0].min(), own[:, 0].max(), 11)
        for span in (0.3, 0.5, 0.7):
            for fit, w in (("raw", None), ("own", own[:, 2])):
                want = stats.loess(own[:, 0], own[:, 1], at, span, w)
                assert np.allclose([got[g, span, fit, round(float(p), 9)] for p in at], want, atol=1e-6), (g, span, fit)


def test_scores_by_pattern_equal_a_solve_for_each_row(spark):
    rng = np.random.default_rng(7)
    columns, x = rng.normal(size=(6, 3)), rng.normal(size=(400, 6))
    x[rng.random(x.shape) < 0.4] = np.nan
    x[0] = np.nan
    df = spark.createDataFrame([(k, [None if math.isnan(v) else float(v) for v in r]) for k, r in enumerate(x)], "user_id long, x array<double>")
    got = {r.user_id: r.coordinates for r in dimension.pattern_scores(df, columns, "user_id", 1e-6).collect()}
    for k, r in enumerate(x):
        seen = ~np.isnan(r)
        b = columns[seen]
        assert np.allclose(got[k], np.linalg.solve(b.T @ b + 1e-6 * np.eye(3), b.T @ r[seen]), rtol=1e-5, atol=1e-8)
    factors = dimension.PatternFactors(columns, 1e-6)
    factors.KEPT = 3
    assert np.allclose(factors.scores(x), dimension.PatternFactors(columns, 1e-6).scores(x)) and len(factors.known) <= 3


def test_nearest_pairs_of_incomplete_rows(spark, sf_dir, monkeypatch):
    monkeypatch.setattr(semantic, "PAIR_BLOCK", 40)
    values = catalogue._user_values(spark, sf_dir)
    topics = sorted(values.select("topic").distinct().toPandas()["topic"])
    pairs = [(r.a, r.b, r.distance) for r in semantic.pair_distances(values, [(topics, 5.0)]).collect()]
    want: dict = {}
    for a, b, d in [*pairs, *((b, a, d) for a, b, d in pairs)]:
        if d > 0:
            want.setdefault(a, []).append((round(d, 9), b))
    got: dict = {}
    for r in sorted(semantic.nearest_pairs(values, [(topics, 5.0)], 4).collect(), key=lambda r: (r.word, r["rank"])):
        got.setdefault(r.word, []).append((round(r.distance, 9), r.neighbour))
    assert got == {k: sorted(v)[:4] for k, v in want.items()}


def test_dimension_estimate_equals_the_routines(spark, sf_dir):
    values = catalogue._user_values(spark, sf_dir)
    r = dimension.estimate(values).first()
    x = np.array([c.coordinates for c in dimension.spectral_coordinates(values).collect()])
    d = np.sort(np.sqrt(((x[:, None] - x[None]) ** 2).sum(2)), 1)[:, 1:]
    assert knn.CELL and abs(r.mle - stats.levina_bickel(d[:, :30])[0]) < 1e-6
    assert abs(r.two_nn - stats.two_nn(d[:, 0], d[:, 1])) < 0.05 * r.two_nn


def test_only_words_that_begin_a_place_are_compared(spark):
    texts = spark.createDataFrame([(1, "in New York city"), (2, "york new york"), (3, "new"), (4, None), (4, "City"), (4, "City")], "doc_id long, text string")
    names = spark.createDataFrame([("new york", "NY", 0), ("new york city", "NYC", 1), ("city", "C", 2)], "place string, code string, level int")
    found = places.gazetteer_matches(texts, names, "doc_id", "text")
    assert sorted((r.doc_id, r.place, r.code, r.start, r.words) for r in found.collect()) == [(1, "new york", "NY", 1, 2), (2, "new york", "NY", 1, 2), (4, "city", "C", 0, 1), (4, "city", "C", 0, 1)]
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert "posexplode" in plan and "transform(sequence" not in plan
