import numpy as np
import pytest

from opinara.operators import dimension, incomplete, knn, semantic
from opinara.plans import catalogue


def frame(spark, x):
    rows = [(k, f"t{c}", float(v)) for k, row in enumerate(x) for c, v in enumerate(row) if v == v]
    return spark.createDataFrame(rows, "user_id long, topic string, value double").repartition(5)


def brute(x, bags, k, least=2):
    d, _ = semantic._bag_distances(x, x, [([int(t[1:]) for t in topics], size) for topics, size in bags], least)
    return {q: [(r, round(a, 9), j) for r, (a, j) in enumerate(sorted((d[q, j], j) for j in range(len(x)) if d[q, j] > 0)[:k], 1)] for q in range(len(x))}


@pytest.mark.parametrize(("width", "kinds", "bags"), [(4, 0, 1), (5, 6, 1), (7, 0, 1), (4, 3, 3)])
def test_equals_all_distances(spark, monkeypatch, width, kinds, bags):
    """Trees over patterns and plain comparison, with slices that meet in several tasks, ties, copies and rows of one topic."""
    for name, size in (("CHUNK", 40), ("SLICE", 90), ("STREAMED", 2)):
        monkeypatch.setattr(incomplete, name, size)
    monkeypatch.setattr(knn, "LEAF", 4)
    monkeypatch.setattr(knn, "SEEDS", 2)
    rng = np.random.default_rng(width)
    x = rng.integers(0, kinds, (500, width)).astype(float) if kinds else rng.normal(size=(500, width))
    x[rng.random(x.shape) < 0.25] = np.nan
    x[100:160] = x[3]  # more copies than neighbours
    x[200, 1:], x[200, 0] = np.nan, 1.0
    x = x[~np.isnan(x).all(1)]
    names = [f"t{c}" for c in range(width)]
    use = [(names[b : b + width - bags + 1], float(width)) for b in range(bags)]
    got: dict = {q: [] for q in range(len(x))}
    for r in semantic.nearest_pairs(frame(spark, x), use, 6).collect():
        got[r.word].append((r["rank"], round(r.distance, 9), r.neighbour))
    assert {q: sorted(v) for q, v in got.items()} == brute(x, use, 6)


def test_no_row_is_copied_for_blocks(spark, monkeypatch):
    monkeypatch.setattr(semantic, "PAIR_BLOCK", 10)
    x = np.random.default_rng(3).normal(size=(200, 3))
    found = incomplete.nearest_lists(frame(spark, x), [(["t0", "t1", "t2"], 3.0)], 4)
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "Generate" not in plan and "CartesianProduct" in plan and "Window" not in plan


def test_trees_leave_most_rows_out(monkeypatch):
    x = np.random.default_rng(4).normal(size=(20_000, 3))
    tree = knn.Tree(x, np.arange(len(x)))
    met, plain = [], tree._rows
    monkeypatch.setattr(tree, "_rows", lambda leaves: met.append(len(found := plain(leaves))) or found)
    i, j, d = tree.best(x[:500], np.full(500, np.inf), 11)
    want = knn.best(x[:500], x, np.arange(len(x)), np.full(500, np.inf), 11)
    assert all(np.array_equal(a, b) for a, b in zip((i, j, d), want, strict=True))
    assert max(np.diff(tree.starts)) <= knn.LEAF and np.mean(met) < len(x) / 4


def test_spaces_of_the_same_distances_are_searched_once(spark, sf_dir, monkeypatch):
    asked, plain = [], incomplete.nearest_lists
    monkeypatch.setattr(incomplete, "nearest_lists", lambda v, bags, *a: asked.append(bags) or plain(v, bags, *a))
    rows = {r.space: r for r in catalogue.QUERIES["dimension_spaces"](spark, sf_dir).collect()}
    assert len(asked) == 1 and list(rows) == ["spectral", "raw", "bagged", "none"]
    assert rows["raw"].mle == rows["bagged"].mle and rows["raw"].two_nn == rows["bagged"].two_nn


def test_estimates_of_points_equal_those_of_pairs(spark):
    rng = np.random.default_rng(5)
    lists = [(q, [0.0] * int(z) + np.sort(rng.random(n)).tolist()) for q, (z, n) in enumerate(zip(rng.integers(0, 4, 240), rng.integers(0, 13, 240), strict=True))]
    lists += [(1000, [2.0] * 12), (1001, [])]
    df = spark.createDataFrame(lists, "word long, distances array<double>")
    each = dimension.point_estimates(df, 4, 8)
    pairs = df.selectExpr("word", "posexplode(distances) (at, distance)").selectExpr("word", "at + 1 rank", "distance")
    want, got = dimension.levina_bickel(pairs, 4, 8).first(), dimension.mean_dimension(each, 8).first()
    assert want.points == got.points > 20 and all(abs(want[c] - got[c]) < 1e-9 for c in ("dimension", "lo", "hi"))
    want, got = semantic.twonn_dimension(pairs).first(), semantic.twonn_of(each.select("word", "r1", "r2").where("r1 is not null and r2 is not null")).first()
    assert want.points == got.points > 20 and abs(want.dimension - got.dimension) < 1e-9


def test_equal_rows_have_equal_coordinates():
    """At any place and in any company: otherwise copies are neighbours at a distance of a last bit."""
    rng = np.random.default_rng(6)
    columns, x = rng.normal(size=(7, 6)), rng.normal(size=(300, 7))
    x[::3] = x[0]
    factors = dimension.PatternFactors(columns, 1e-6)
    parts = [factors.scores(x[s : s + n]) for s, n in ((0, 1), (0, 4), (3, 40), (0, 300))]
    assert all((part[::3] == parts[0][0]).all() for part in parts)


def test_neighbours_at_one_distance_give_no_estimate(spark):
    """Each has an estimate without bound, not one of a rounding error."""
    lists = [(k, [float(d)] * 30) for k, d in enumerate(np.random.default_rng(7).random(200))] + [(900, [0.1 + 0.01 * k for k in range(30)])]
    df = spark.createDataFrame(lists, "word long, distances array<double>")
    assert [r.word for r in dimension.point_estimates(df).where("d is not null").collect()] == [900]
