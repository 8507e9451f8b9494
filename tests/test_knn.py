import numpy as np
import pytest

from opinara.operators import knn


def brute(ids, x, k):
    out = {}
    for i, w in enumerate(ids):
        d = np.sqrt(((x - x[i]) ** 2).sum(1))
        order = [j for j in np.lexsort((ids, d)) if ids[j] != w][:k]
        out[int(w)] = [(int(ids[j]), float(d[j])) for j in order]
    return out


def found(spark, ids, x, k, parts=4):
    rows = spark.createDataFrame([(int(i), v.tolist()) for i, v in zip(ids, x, strict=True)], "word long, vector array<double>").repartition(parts)
    out: dict = {}
    for r in sorted(knn.neighbours(rows, k).collect(), key=lambda r: (r.word, r.rank)):
        out.setdefault(r.word, []).append((r.neighbour, r.distance))
    return out


@pytest.mark.parametrize(("dims", "cell", "queries"), [(2, 64, 1 << 17), (3, 40, 16), (16, 100, 1 << 17)])
def test_equals_brute_force(spark, monkeypatch, dims, cell, queries):
    monkeypatch.setattr(knn, "CELL", cell)
    monkeypatch.setattr(knn, "QUERIES", queries)
    rng = np.random.default_rng(dims)
    x = rng.normal(size=(700, dims)) * rng.choice([0.1, 1, 5], 700)[:, None]
    x[100:150] = np.round(x[100:150])  # ties
    x[300:420] = x[7]  # one common vector
    ids = rng.permutation(2000)[:700]
    assert found(spark, ids, x, 5) == brute(ids, x, 5)


def test_five_thousand_points_against_brute_force(spark):
    rng = np.random.default_rng(9)
    x = rng.normal(size=(5000, 6))
    ids = np.arange(5000)
    assert found(spark, ids, x, 10) == brute(ids, x, 10)


def test_cells_out_of_reach_are_not_visited(spark, monkeypatch):
    """Clusters far apart: a query meets the slices of its own cluster only."""
    monkeypatch.setattr(knn, "CELL", 64)
    rng = np.random.default_rng(1)
    x = np.concatenate([c + rng.normal(size=(100, 2)) * 0.01 for c in ([0, 0], [100, 0], [0, 100], [100, 100], [500, 500])])
    pivots = x[[5, 105, 205, 305, 405]]
    cells = knn.Cells(pivots)
    cell, apart = cells.place(x)
    for c in range(5):
        cells.near[c], cells.far[c], cells.slices[c] = apart[cell == c].min(), apart[cell == c].max(), 1
    i, j = cells.reached(x, cell, np.full(len(x), 0.5))
    assert (cell[i] == j).all() and len(i) == len(x)
    assert found(spark, np.arange(500), x, 3) == brute(np.arange(500), x, 3)


def test_odd_rows_and_few(spark):
    rows = [(1, [0.0, 1.0]), (2, None), (None, [0.0, 0.0]), (3, [float("nan"), 1.0]), (4, [None, 1.0]), (5, [0.0, 2.0]), (6, [float("inf"), 0.0])]
    df = spark.createDataFrame(rows, "word long, vector array<double>")
    assert sorted(map(tuple, knn.neighbours(df, 4).collect())) == [(1, 5, 1.0, 1), (5, 1, 1.0, 1)]
    assert knn.neighbours(df.where("word = 2"), 4).count() == 0
