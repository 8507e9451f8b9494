import math
from itertools import combinations, product

import numpy as np
import pytest
from pyspark.sql import functions as F

from opinara.functions import stats
from opinara.operators import portraits, sensitivity, spectral


def covariance_rows(squares, names):
    return [(s, names[i], names[j], float(c[i, j])) for s, c in squares.items() for i in range(len(names)) for j in range(i, len(names))]


def test_subset_spectra_equal_single_decompositions(spark, monkeypatch):
    monkeypatch.setattr(sensitivity, "CELLS", 64)  # many blocks of subsets
    rng, names = np.random.default_rng(0), [f"t{k}" for k in range(6)]
    squares = {}
    for s in ("a", "b"):
        x = rng.normal(size=(6, 6))
        squares[s] = (x + x.T) / 2  # eigenvalues of both signs, as pairwise available rows may give
    rows = [*covariance_rows(squares, names), ("a", "t0", "other", 9.0), ("a", "t9", "t9", 9.0), ("c", "t1", "t1", 2.0), ("c", "t2", "t2", None), ("n", "t0", "t0", -1.0)]
    cov = spark.createDataFrame(rows, "society string, t1 string, t2 string, cov double").repartition(3)
    squares |= {"c": np.diag([0, 2.0, 0, 0, 0, 0]), "n": np.diag([-1.0, 0, 0, 0, 0, 0])}
    for size in (1, 3, 6):
        got = {(r.society, r.subset): (r.pr, r.erank, r.srank) for r in sensitivity.subset_spectra(cov, names, size, ("society",)).collect()}
        assert len(got) == 4 * math.comb(6, size)
        for s, c in squares.items():
            for k, m in enumerate(combinations(range(6), size)):
                want = stats.spectrum(c[np.ix_(m, m)])
                for g, w in zip(got[s, k], want.values(), strict=True):
                    assert (g is None) if math.isnan(w) else abs(g - w) < 1e-9
    one = sensitivity.subset_spectra(cov.where("society = 'a'"), names, 6, ("society",), 0.5).first()
    assert abs(one.pr - stats.spectrum(squares["a"] + 0.5 * np.eye(6))["pr"]) < 1e-9
    assert sensitivity.subset_spectra(cov.where("false"), names, 3, ("society",)).count() == 0
    with pytest.raises(ValueError):
        sensitivity.subset_spectra(cov, names, 7, ("society",))


def test_range_grid_is_the_product(spark):
    rng, names, n = np.random.default_rng(1), ["x", "y", "z"], 5
    v = rng.random((3, n, 2))
    rows = [(s, k, float(v[i, k, 0]), float(v[i, k, 1])) for i, s in enumerate(names) for k in range(n)] + [("other", 0, 9.0, 9.0)]
    values = spark.createDataFrame(rows, "society string, subset long, off double, on double")
    got = sensitivity.range_grid(values, names, n).orderBy("combination").collect()
    want = []
    for digits in product(range(n), repeat=3):  # the last society turns slowest in the numbers
        own = np.array([v[i, d] for i, d in enumerate(digits[::-1])])
        up = own[:, 1] - own[:, 0]
        off, on = np.ptp(own[:, 0]), np.ptp(own[:, 1])
        want.append((off, on, off / on, bool(up[0] > 0 and (up[1:] < 0).all())))
    assert len(got) == n**3 and all(np.allclose(g[1:4], w[:3]) and g.opposed == w[3] for g, w in zip(got, want, strict=True))
    s = sensitivity.range_summary(sensitivity.range_grid(values, names, n)).first()
    ratio = np.array([w[2] for w in want])
    assert s.combinations == 125 and abs(s.ratio_median - np.median(ratio)) < 1e-9 and abs(s.ratio_p5 - np.percentile(ratio, 5)) < 1e-9
    assert abs(s.share_opposed - np.mean([w[3] for w in want])) < 1e-9 and abs(s.on_max - max(w[1] for w in want)) < 1e-9
    lacking = sensitivity.range_grid(values.where("not (society = 'y' and subset = 2)"), names, n).where("off is null and on is null and ratio is null and opposed is null")
    assert lacking.count() == 25


def pair_rows(seed=2):
    rng, rows = np.random.default_rng(seed), []
    for s, (level, n) in {"a": (0.1, 20), "b": (0.3, 15), "c": (0.2, 25)}.items():
        for k in range(n):
            x = rng.random() + level
            rows.append((s, f"t{k}", "u", float(x), float(np.clip(level + 0.3 * x + 0.1 * rng.normal(), 0, 1))))
    return rows


def test_variance_shares_equal_regressions(spark):
    rows = pair_rows()
    bad = [("a", "n", "u", None, 0.5), ("a", "m", "u", 0.5, None), (None, "o", "u", 0.5, 0.5)]
    df = spark.createDataFrame([*rows, *bad], "society string, t1 string, t2 string, x double, y double").repartition(4)
    x, r = np.array([q[3] for q in rows]), np.array([q[4] for q in rows])
    dummies = np.column_stack([[q[0] == s for q in rows] for s in "bc"]).astype(float)
    point = {q.scale: q for q in sensitivity.variance_shares(df).collect()}
    drawn = {q.scale: q for q in sensitivity.variance_shares(df, 400, 1).collect()}
    for scale, y in {"r": r, "z": np.arctanh(np.minimum(r, 1 - 1e-12))}.items():
        want = stats.shapley_r2(y, {"society": dummies, "similarity": x[:, None]})
        alone = stats.shapley_r2(y, {"society": dummies})["total"], stats.shapley_r2(y, {"similarity": x[:, None]})["total"]
        for q in (point[scale], drawn[scale]):
            assert q.pairs == 60 and all(abs(q[k] - want[k]) < 1e-9 for k in ("society", "similarity", "total")) and abs(q.unexplained + q.total - 1) < 1e-12
            assert abs(q.society_first - alone[0]) < 1e-9 and abs(q.similarity_first - alone[1]) < 1e-9
            assert abs(q.society_last - (want["total"] - alone[1])) < 1e-9 and abs(q.similarity_last - (want["total"] - alone[0])) < 1e-9
            assert abs((q.society_first + q.society_last) / 2 - q.society) < 1e-9
        rng, reps = np.random.default_rng(3), []
        for _ in range(400):
            at = np.concatenate([rng.choice(np.flatnonzero([q[0] == s for q in rows]), size=sum(q[0] == s for q in rows)) for s in "abc"])
            reps.append(stats.shapley_r2(y[at], {"society": dummies[at], "similarity": x[at, None]})["society"])
        lo, hi = np.quantile(reps, [0.025, 0.975])
        assert abs(drawn[scale].society_lo - lo) < 0.06 and abs(drawn[scale].society_hi - hi) < 0.06
    flat = sensitivity.variance_shares(df.withColumn("x", F.lit(1.0) + F.col("x") * 0)).where("scale = 'r'").first()
    assert abs(flat.similarity) < 1e-12 and abs(flat.society - flat.total) < 1e-12
    assert sensitivity.variance_shares(df.withColumn("y", F.lit(0.25))).where("society is null and total is null").count() == 2
    assert sensitivity.variance_shares(df.where("false")).count() == 0


def test_levels_and_ranges(spark):
    rows = [("m1", *q) for q in pair_rows()] + [("m2", *q) for q in pair_rows(5)] + [(None, "a", "q", "u", 0.1, 0.1), ("m1", "a", "r", "u", 0.1, None)]
    df = spark.createDataFrame(rows, "medium string, society string, t1 string, t2 string, x double, y double").repartition(3)
    got = {(q.medium, q.society): q for q in sensitivity.level_frame(df, 500).collect()}
    assert len(got) == 6
    for m in ("m1", "m2"):
        y = {s: np.array([q[5] for q in rows if q[0] == m and q[1] == s and q[5] is not None]) for s in "abc"}
        means = {s: v.mean() for s, v in y.items()}
        for s, v in y.items():
            q = got[m, s]
            assert abs(q.value - means[s]) < 1e-12 and abs(q.range - (max(means.values()) - min(means.values()))) < 1e-12
            half = 1.96 * v.std() / len(v) ** 0.5
            assert abs(q.value_lo - (means[s] - half)) < 0.3 * half and abs(q.value_hi - (means[s] + half)) < 0.3 * half and q.range_lo < q.range < q.range_hi


def test_draws_do_not_depend_on_partitions(spark):
    rows = pair_rows()
    a, b = (spark.createDataFrame(rows, "society string, t1 string, t2 string, x double, y double").repartition(n) for n in (1, 7))
    a, b = ({q.scale: tuple(q)[1:] for q in sensitivity.variance_shares(d, 50).collect()} for d in (a, b))
    assert all(np.allclose(a[s], b[s], atol=1e-12) for s in ("r", "z"))


@pytest.mark.parametrize("stretch", [1.0, 2.5])
def test_ellipses_are_those_of_the_stretched_clouds(spark, stretch):
    rng, data = np.random.default_rng(4), {}
    for g, r in (("plus", 0.6), ("minus", -0.4), (None, 0.1)):
        z = rng.multivariate_normal([0, 0], [[1, r], [r, 1]], size=50)
        data[g] = z * [2.0, 0.5] + [1.0, -3.0]
    rows = [(g, float(a), float(b)) for g, v in data.items() for a, b in v] + [("plus", None, 1.0), ("few", 1.0, 2.0), *[("flat", 1.0, float(k)) for k in range(9)]]
    df = spark.createDataFrame(rows, "g string, x double, y double").repartition(3)
    found = {q.g: q for q in portraits.ellipses(df, ["g"], stretch=stretch).collect()}
    assert set(found) == set(data)
    cloud: dict = {}
    for q in portraits.stretched_points(df, ["g"], stretch=stretch).collect():
        cloud.setdefault(q.g, []).append((q.zx, q.zy))
    assert set(cloud) == set(data)
    for g, q in found.items():
        z = (data[g] - data[g].mean(0)) / data[g].std(0)
        values, vectors = np.linalg.eigh(np.cov(z.T))
        assert q.n == 50 and abs(q.major**2 - values[1] ** stretch) < 1e-9 and abs(q.minor**2 - values[0] ** stretch) < 1e-9
        axis = np.array([math.cos(math.radians(q.angle)), math.sin(math.radians(q.angle))])
        assert abs(abs(axis @ vectors[:, 1]) - 1) < 1e-9
        assert np.allclose(np.cov(np.array(cloud[g]).T), (vectors * values**stretch) @ vectors.T)
        outline = portraits.outlines(portraits.ellipses(df, ["g"], stretch=stretch), ["g"], 2.0, 16).where(F.col("g").eqNullSafe(F.lit(g))).orderBy("point").collect()
        p = np.array([(o.x, o.y) for o in outline])
        inside = np.linalg.inv((vectors * values**stretch) @ vectors.T)
        assert len(p) == 16 and np.allclose(np.einsum("ki,ij,kj->k", p, inside, p), 4.0) and np.allclose(p[0], 2 * q.major * axis)


def test_components_of_complete_rows(spark):
    rng = np.random.default_rng(5)
    x = rng.normal(size=(60, 3)) @ rng.normal(size=(3, 3)) + 4
    rows = [(k, *map(float, v)) for k, v in enumerate(x)] + [(100, None, 1.0, 1.0), (101, None, None, None)]
    wide = spark.createDataFrame(rows, "user long, a double, b double, c double").repartition(3)
    found = portraits.listwise_components(wide, ["a", "b", "c"])
    got = found.orderBy("component").collect()
    values, vectors = np.linalg.eigh(np.cov(x.T))
    for q, value, v in zip(got, values[::-1], vectors.T[::-1], strict=True):
        own = np.array([q.loadings[c] for c in "abc"])
        assert q.n == 60 and abs(q.eigenvalue - value) < 1e-9 and abs(q.share - value / values.sum()) < 1e-9 and abs(abs(own @ v) - 1) < 1e-9 and own[np.abs(own).argmax()] > 0
        assert np.allclose([q.means[c] for c in "abc"], x.mean(0))
    scores = {(q.user, q.component): q.score for q in portraits.listwise_scores(wide, ["a", "b", "c"], found, ["user"]).collect()}
    assert len(scores) == 180
    for q in got:
        own = np.array([q.loadings[c] for c in "abc"])
        assert np.allclose([scores[k, q.component] for k in range(60)], (x - x.mean(0)) @ own)
    assert portraits.listwise_components(wide.where("user = 3"), ["a", "b", "c"]).count() == 0
    assert portraits.listwise_scores(wide.where("false"), ["a", "b", "c"], found, ["user"]).count() == 0


def test_rebuilt_covariance(spark):
    rng = np.random.default_rng(6)
    rows = [(y, u, t, float(rng.normal())) for y in (1, 2) for u in range(30) for t in "abcd" if rng.random() < 0.7]
    values = spark.createDataFrame(rows, "year int, user_id long, topic string, value double")
    want = {(r.year, r.t1, r.t2): r["cov"] for r in spectral.available_covariance(values, ("year",)).collect()}
    got = {(r.year, r.t1, r.t2): r["cov"] for r in portraits.rebuilt_covariance(spectral.loading_report(values)).collect()}
    assert got.keys() == want.keys() and all(abs(got[k] - v) < 1e-9 for k, v in want.items())


def test_identical_items(spark):
    rows = [("i", s, t, v) for s in "ab" for t in "xyz" for v in (1.0, 2.0)] + [("i", "a", "only a", 1.0), ("i", "b", "only a", None), ("i", "c", "x", 1.0), ("j", "a", "x", 1.0), (None, "a", "x", 1.0)]
    values = spark.createDataFrame(rows, "items string, society string, topic string, value double")
    kept = sensitivity.common_topics(values, ("a", "b"), ("items",)).collect()
    assert sorted(map(tuple, kept)) == sorted(("i", s, t, v) for s in "ab" for t in "xyz" for v in (1.0, 2.0))
    pairs = [(m, *q) for m, seed in (("m1", 2), ("m2", 5)) for q in pair_rows(seed)] + [("m1", "a", "n", "u", 0.0, None), ("m3", "a", "n", "u", 0.0, 0.5)]
    df = spark.createDataFrame(pairs, "items string, society string, t1 string, t2 string, x double, y double").repartition(3)
    got = {q["items"]: q for q in sensitivity.level_gaps(df, "a", "b", draws=500).collect()}
    assert set(got) == {"m1", "m2"}
    for m, q in got.items():
        a, b = (np.array([p[5] for p in pairs if p[0] == m and p[1] == s and p[5] is not None]) for s in "ab")
        assert (q.pairs_first, q.pairs_second) == (20, 15) and np.allclose([q.mean_first, q.mean_second, q.gap, q.ratio], [a.mean(), b.mean(), a.mean() - b.mean(), a.mean() / b.mean()])
        half = 1.96 * (a.var() / len(a) + b.var() / len(b)) ** 0.5
        assert abs(q.gap_lo - (q.gap - half)) < 0.3 * half and abs(q.gap_hi - (q.gap + half)) < 0.3 * half and q.ratio_lo < q.ratio < q.ratio_hi


def test_spectral_table_is_the_spectra_with_limits(spark):
    rng, rows, full = np.random.default_rng(7), [], {}
    for s, spread in (("a", 1.5), ("b", 0.2)):
        x = rng.normal(size=(150, 4)) + spread * rng.normal(size=(150, 1))
        full[s] = x
        rows += [(s, u, f"t{j}", float(v)) for u, r in enumerate(x) for j, v in enumerate(r)]
    rows += [("b", 1, "t9", None), (None, 1, "t0", 1.0)]
    values = spark.createDataFrame(rows, "society string, user_id long, topic string, value double").repartition(3)
    got = {q.society: q for q in spectral.spectral_table(values, 400, by=("society",)).collect()}
    assert set(got) == {"a", "b"}
    for s, x in full.items():
        want, reps = stats.spectrum(np.cov(x.T)), []
        for _ in range(400):
            reps.append(stats.spectrum(np.cov(x[rng.integers(0, 150, 150)].T))["pr"])
        q = got[s]
        assert q.k == 4 and all(abs(q[m] - want[m]) < 1e-9 for m in want) and abs(q.pr_per_topic - want["pr"] / 4) < 1e-9
        lo, hi = np.quantile(reps, [0.025, 0.975])
        assert abs(q.pr_lo - lo) < 0.3 * (hi - lo) and abs(q.pr_hi - hi) < 0.3 * (hi - lo)
    years = values.where("society is not null").withColumn("year", F.when(F.col("society") == "a", 1).otherwise(2)).withColumn("society", F.lit("all"))
    one = spectral.spectral_table(years, 20, by=("society",), over=("year",)).first()
    assert abs(one.pr - (got["a"].pr + got["b"].pr) / 2) < 1e-9


@pytest.mark.parametrize("share", [0.0, 0.1, 0.35, 1.0])
def test_top_share_numbers_only_ties(spark, share):
    from opinara.operators import text

    rng = np.random.default_rng(8)
    rows = [(t, f"w{k:03d}", int(rng.integers(1, 4 + 3 * (k % 5)))) for t, n in (("a", 70), ("b", 9), (None, 21)) for k in range(n)] + [("flat", f"w{k}", 1) for k in range(40)]
    counts = spark.createDataFrame(rows, "topic string, word string, count long").repartition(5)
    want = set()
    for t in {r[0] for r in rows}:
        own = sorted((r for r in rows if r[0] == t), key=lambda r: (-r[2], r[1]))
        want |= set(own[: math.floor(len(own) * share)])
    got = text.top_share(counts, share).collect()
    assert len(got) == len(want) and {tuple(r) for r in got} == want
