"""Operators on small hand-made inputs: nulls, ties, empty tables, constants."""

import statistics

import numpy as np
import pytest
from pyspark.sql import functions as F

from opinara.functions import stats
from opinara.operators import adjustment, correlation, dimension, labels, panel, ranks, semantic, simulation, spectral
from opinara.plans import catalogue, report
from opinara.sources import adapters as ad


def test_constant_and_single_rows_have_no_correlation(spark):
    pairs = spark.createDataFrame([("a", "b", 1.0, 2.0), ("a", "b", 1.0, 3.0), ("a", "c", 1.0, 2.0)], "t1 string, t2 string, x double, y double")
    assert {(r.t2, r.n, r.r) for r in correlation.pairwise(pairs).collect()} == {("b", 2, None), ("c", 1, None)}


def test_topic_pairs_skip_nulls(spark):
    v = spark.createDataFrame([(1, 1, "a", 0.5), (1, 1, "b", None), (1, 1, "c", 0.1), (2, 1, "a", 1.0)], "user_id long, year int, topic string, value double")
    assert [tuple(r) for r in correlation.topic_pairs(v).collect()] == [(1, 1, "a", "c", 0.5, 0.1)]
    assert correlation.topic_pairs(v.limit(0)).count() == 0


def test_spectra_of_independent_topics(spark):
    v = spark.range(4000).selectExpr("id user_id", "1 year", "explode(array(0,1,2)) t").selectExpr("user_id", "year", "concat('t', t) topic", "cast(pmod(xxhash64(user_id, t), 1000) as double) / 1000 value")
    r = spectral.spectra(v).first()
    assert abs(r.pr - 3) < 0.05 and abs(r.erank - 3) < 0.05
    b = spectral.bootstrap_spectra(v, 20).first()
    assert b.pr_lo <= b.pr_hi and abs(b.pr - r.pr) < 1e-9


def test_majority_and_kappa(spark):
    rows = spark.createDataFrame([(1, 1, 1, 1), (2, 1, 1, 0), (3, 1, 0, -99), (4, None, None, 2), (5, None, None, None)], "post_id long, a int, b int, c int")
    got = {r.post_id: (r.agreement_count, r.agreement_value) for r in labels.majority(rows, ["a", "b", "c"]).collect()}
    assert got == {1: (3, 1), 2: (2, 1), 3: (1, None), 4: (1, None), 5: (0, None)}
    same = rows.where("post_id = 1")
    assert labels.cohen_kappa(same, ["a", "b"]).first().kappa is None


def test_user_repair_and_unique_keys(spark):
    rows = spark.createDataFrame([(1, "7"), (2, "bad"), (3, "bad")], "post_id long, user_id string")
    fix = spark.createDataFrame([(2, 9)], "post_id long, new_user_id long")
    assert sorted(map(tuple, panel.repair_users(rows, fix).collect())) == [(1, 7), (2, 9)]
    with pytest.raises(ValueError):
        panel.assert_unique(rows, ["user_id"])


def test_centroids(spark):
    v = spark.createDataFrame([(1, 0, [1.0, 0.0], 1.0), (2, 0, [0.0, 1.0], 3.0), (3, 1, [1.0, 1.0], 1.0), (4, 1, None, 1.0)], "word long, topic int, vector array<double>, weight double")
    c = {r.topic: r.centroid for r in semantic.centroids(v).collect()}
    assert c == {0: [0.25, 0.75], 1: [1.0, 1.0]}


def brute_distances(people, bags, least=2):
    out = {}
    for a in people:
        for b in people:
            found = []
            for topics, k in bags:
                both = [t for t in topics if t in people[a] and t in people[b]]
                if len(both) >= least:
                    found.append((k / len(both) * sum((people[a][t] - people[b][t]) ** 2 for t in both)) ** 0.5)
            if a < b and found:
                out[a, b] = round(statistics.median(found), 9)
    return out


def test_distances_of_all_pairs_in_blocks(spark, sf_dir, monkeypatch):
    monkeypatch.setattr(semantic, "PAIR_BLOCK", 40)
    values = catalogue._user_values(spark, sf_dir)
    got = {(r.a, r.b): r.distance for r in semantic.missing_corrected_distance(values, n_topics=5).collect()}
    people: dict = {}
    for r in catalogue._user_values(spark, sf_dir).collect():
        people.setdefault(r.user_id, {})[r.topic] = r.value
    assert len(people) > 80
    topics = list(ad.ORDER_TOPICS)
    want = brute_distances(people, [(topics, 5.0)])
    assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 2e-6 for k in want)
    rng = np.random.default_rng(0)
    bags = [(sorted(rng.choice(topics, 4, replace=False)), 4.0) for _ in range(5)]
    rows = dimension.bagged_distances(values, topics).collect()
    got, want = {(r.a, r.b): r.distance for r in rows}, brute_distances(people, bags)
    assert len(rows) == len(got) and got.keys() == want.keys() and all(abs(got[k] - want[k]) < 2e-6 for k in want)
    # The registered query: ids divisible by 20 against all.
    rows = catalogue.QUERIES["bagged_distances"](spark, sf_dir).collect()
    both = want | {(b, a): d for (a, b), d in want.items()}
    wanted = {k: d for k, d in both.items() if k[0] % 20 == 0}
    got = {(r.a, r.b): r.distance for r in rows}
    assert len(rows) == len(got) and got.keys() == wanted.keys() and all(abs(got[k] - wanted[k]) < 2e-6 for k in wanted)


def test_whole_jobs_of_the_vector_queries(spark, sf_dir, monkeypatch):
    rows = catalogue.QUERIES["cosine_pairs"](spark, sf_dir).collect()
    vectors = {r.word: (r.topic, np.array(r.vector, float)) for r in ad.keyword_vectors(spark, sf_dir).collect()}
    topics = sorted({t for t, _ in vectors.values()})
    centre = {r.topic: np.array(r.centroid) for r in catalogue._centroids(spark, sf_dir).collect()}
    assert len(rows) == len(vectors) * len(topics) == len({(r.word, r["query"]) for r in rows})
    for r in rows:
        x, c = vectors[r.word][1], centre[r["query"]]
        assert abs(r.similarity - x @ c / np.linalg.norm(x) / np.linalg.norm(c)) < 2e-6
    pairs = {r.pair for r in catalogue.QUERIES["word_matching"](spark, sf_dir).select("pair").distinct().collect()}
    assert pairs == {f"{a}_{b}" for a in topics for b in topics if a < b}
    asked = []
    monkeypatch.setattr(dimension, "levina_bickel", lambda n, *k: asked.append((n.agg({"rank": "max"}).first()[0], *k)) or n.selectExpr("1 points", "1.0 dimension", "1.0 lo", "1.0 hi"))
    catalogue.QUERIES["levina_bickel_dimension"](spark, sf_dir)
    assert asked == [(30, 10, 30)]


def test_thinned_values_spectra_equal_a_loop(spark):
    import hashlib

    rng = np.random.default_rng(8)
    values = [(u, t, float(rng.normal() + (u % 3))) for u in range(200) for t in "abc"]
    rows = simulation.thinned(spark.createDataFrame(values, "user_id long, topic string, value double"), (0.0, 0.6), 2, seed=3)
    h = lambda *x: (int(hashlib.md5(":".join(map(str, (3, *x))).encode()).hexdigest()[:10], 16) + 0.5) / 2**40
    got = {(r.pattern, r.missing, r.rep): r for r in spectral.spectra(rows, ("pattern", "missing", "rep")).collect()}
    assert len(got) == 8
    for (pattern, missing, rep), r in got.items():
        x = np.full((200, 3), np.nan)
        for u, t, v in values:
            share = 1 - missing if pattern == "random" else min(1.0, simulation.row_scale(1 - missing) * -np.log(h("u", rep, u)))
            if h("e", rep, u, t) < share:
                x[u, "abc".index(t)] = v
        seen = ~np.isnan(x)
        z = np.where(seen, x, 0)
        s = stats.spectrum(stats.available_covariance(z.T @ z, (seen.T.astype(float) @ seen), z.sum(0) / seen.sum(0)))
        assert abs(r.pr - s["pr"]) < 1e-6 and abs(r.erank - s["erank"]) < 1e-6
        assert missing == 0 or abs(seen.mean() - 0.4) < 0.08
    for share in (0.1, 0.5, 0.9):
        s = simulation.row_scale(share)
        assert abs(np.minimum(1, s * rng.exponential(size=200_000)).mean() - share) < 0.005


@pytest.mark.parametrize("pattern", ["random", "rows"])
def test_simulated_matrix_in_parts(monkeypatch, pattern):
    monkeypatch.setattr(simulation, "PART", 300)
    parts = list(simulation.manifold_parts(6, 1000, 2, 0.3, 1, pattern))
    whole = tuple(np.concatenate(x) for x in zip(*parts, strict=True))
    assert whole[0].shape == (1000, 6) and len(parts) == 4
    a, b = simulation.observed_spectrum(parts), simulation.observed_spectrum([whole])
    assert a.keys() == b.keys() and all(abs(a[k] - b[k]) < 1e-6 for k in a)
    assert abs(a["observed_share"] - 0.7) < 0.04
    x = simulation.manifold(6, 1000, 2, 0.3, 1, pattern)
    assert np.array_equal(np.isnan(x), whole[1] == 0) and np.allclose(np.nan_to_num(x), whole[0])
    # Complete points lie in a subspace of two dimensions.
    full = x[~np.isnan(x).any(1)]
    assert np.linalg.matrix_rank(full, tol=1e-4) == 2
    with pytest.raises(ValueError):
        next(simulation.manifold_parts(6, 10, 2, 0.3, 1, "no such"))


def test_rows_and_columns_are_observed_in_proportion():
    rng = np.random.default_rng(0)
    active, asked = rng.exponential(size=5000), np.linspace(0.5, 1.5, 20)
    for share in (0.05, 0.3, 0.9):
        scale = simulation.observation_scale(active, asked, share)
        assert abs(np.minimum(scale * np.outer(active, asked), 1).mean() - share) < 1e-6


def test_bootstrap_weights_are_poisson_and_sums_are_weighted(spark):
    keys = np.random.default_rng(0).integers(0, 1 << 63, 4000).astype(np.uint64)
    w = spectral.replicate_weights(keys, np.arange(50))
    assert (w[0] == 1).all() and abs(w[1:].mean() - 1) < 0.01 and abs(w[1:].var() - 1) < 0.02
    assert abs(np.corrcoef(w[1], w[2])[0, 1]) < 0.06
    v = spark.createDataFrame([(u, y, f"t{t}", float((u * 7 + t * 3 + y) % 5)) for u in range(40) for t in range(3) for y in (1, 2) if (u + t) % 4], "user_id long, year int, topic string, value double")
    got = {(r.year, r.draw, r.t1, r.t2): (r.n, r.sxy) for r in spectral.bootstrap_sums(v, ["t0", "t1", "t2"], 3, 0, ("year",), "user_id").collect()}
    rows = v.selectExpr("*", "xxhash64(0, year, user_id) h").collect()
    for y in (1, 2):
        for d in range(4):
            own = {u: spectral.replicate_weights(np.array([h]), np.array([d]))[0, 0] for u, h in {(r.user_id, r.h) for r in rows if r.year == y}}
            x = {(r.user_id, r.topic): r.value for r in rows if r.year == y}
            n = sum(own[u] for u in own if (u, "t0") in x and (u, "t2") in x)
            s = sum(own[u] * x[u, "t0"] * x[u, "t2"] for u in own if (u, "t0") in x and (u, "t2") in x)
            assert np.allclose(got[y, d, "t0", "t2"], (n, s))


@pytest.mark.parametrize("parts", [1, 7])
def test_running_sums_over_ranges(spark, parts):
    rows = [("ab"[k % 2] if k % 5 else None, k * 37 % 101, k % 4) for k in range(100)]
    spark.conf.set("spark.sql.shuffle.partitions", str(parts))
    df = spark.createDataFrame(rows, "g string, o int, v int")
    got = {(r.g, r.o): (r.upto, r.below) for r in ranks.running_sums(ranks.running_sums(df, ["g"], ["o"], "v", "upto"), ["g"], ["o"], "v", "below", False).collect()}
    spark.conf.set("spark.sql.shuffle.partitions", "4")
    for g, o, v in rows:
        upto = sum(x for h, p, x in rows if h == g and p <= o)
        assert got[g, o] == (upto, upto - v)


def test_no_window_over_all_rows_in_one_task(spark, sf_dir):
    for name in ("spearman", "probability_auc", "stratified_sample", "twonn_dimension"):
        plan = catalogue.QUERIES[name](spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
        assert "Window" not in plan or "_part" in plan or "Exchange SinglePartition" not in plan, name


def test_coordinates_and_spaces(spark):
    rng = np.random.default_rng(5)
    x = rng.normal(size=(400, 2)) @ rng.normal(size=(2, 6))
    v = spark.createDataFrame([(i, f"t{j}", float(x[i, j])) for i in range(400) for j in range(6) if rng.random() < 0.8], "user_id long, topic string, value double")
    c = dimension.spectral_coordinates(v, 2).collect()
    assert all(len(r.coordinates) == 2 for r in c)
    assert dimension.chosen_rank(3.2, 4.6, 9) == 5 and dimension.chosen_rank(1.2, float("nan"), 9) == 2 and dimension.chosen_rank(9, 20.0, 6) == 6
    r = dimension.estimate(v, "spectral").first()
    assert abs(r.pr - 2) < 0.8 and abs(r.mle - 2) < 1 and r.mle_lo < r.mle < r.mle_hi and 1 < r.two_nn < 4
    raw = dimension.estimate(v, "raw", k1=5, k2=12).first()
    assert dimension.estimate(v, "bagged", k1=5, k2=12).first().mle > 0
    assert raw.mle > 0 and dimension.estimate(v, None).first().mle is None
    with pytest.raises(ValueError):
        dimension.estimate(v, "no such")
    assert dimension.auto_parameters(0.04, 9) == {"least": 1, "size": 9, "bags": 60}


def test_level_summary_limits(spark):
    rng = np.random.default_rng(1)
    rows = [(s, f"a{k}", f"b{k}", 0.0, float(abs(rng.normal(m, 0.05)))) for s, m in (("x", 0.4), ("y", 0.2)) for k in range(36)]
    got = {(r.what, r.society): r for r in adjustment.level_summary(spark.createDataFrame(rows, "society string, t1 string, t2 string, x double, y double"), "x").collect()}
    assert all(r.lo <= r.value <= r.hi for r in got.values()) and abs(got["ratio", "y"].value - 2) < 0.4
    own = [r[4] for r in rows if r[0] == "x"]
    half = 1.96 * np.std(own) / 6
    assert abs((got["mean", "x"].hi - got["mean", "x"].lo) / 2 - half) < 0.3 * half


def test_tasks_and_command_line(capsys):
    from opinara.__main__ import main
    from opinara.plans import tasks

    assert len(tasks.TASKS) == 11 and [r.code for r in tasks.task("main", ["GB", "US"]).regions] == ["US", "GB"]
    for bad in (lambda: tasks.task("no such"), lambda: tasks.task("main", "US,XX")):
        with pytest.raises(ValueError):
            bad()
    assert main(["list"]) == 0 and main(["sql", "pairwise_pearson"]) == 0 and main(["tasks"]) == 0
    assert "pairwise_pearson" in capsys.readouterr().out


def test_noise_lowers_reliability(spark):
    v = spark.range(5000).selectExpr("id user_id", "'t' topic", "cast(pmod(xxhash64(id), 1000) as double) value")
    base = v.agg(F.var_samp("value")).first()[0]
    got = simulation.noisy_reliability(v, 0.5, 1).agg(F.var_samp("value")).first()[0]
    assert 1.8 < got / base < 2.2


def test_bounds_are_checked(spark, monkeypatch):
    monkeypatch.setattr(adjustment, "MAX_PAIRS", 1)
    pairs = spark.createDataFrame([("s", 1.0, 1.0)] * 2, "society string, x double, y double")
    with pytest.raises(ValueError):
        adjustment.shapley(pairs, "s")


def test_report(spark, sf_dir):
    parts = [p for p in report.PARTS if p.query in ("dispersion_ratio", "eta_squared")]
    text = report.build_report(spark, sf_dir, parts)
    assert text.count("Part ") == 2 and "Calculation:" in text
    assert {p.query for p in report.PARTS} <= set(catalogue.QUERIES)


def test_sections(spark, sf_dir, tmp_path):
    parts = [p for p in report.PARTS if p.query in ("dispersion_ratio", "common_support")]
    assert report.write_sections(spark, sf_dir, str(tmp_path), parts) == [p.query for p in parts]
    assert [df.count() for df in report.keep_sections(spark, str(tmp_path), ["common_support", "eta_squared"])] == [1]
