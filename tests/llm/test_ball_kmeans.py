import hashlib
import math

import duckdb
import numpy as np
import pytest

from opinara.llm import ball_kmeans as bk

SCHEMA = "vec_id long, embedding array<double>, label int, cluster string, v string"


def brute(rows, dims, k, rounds, scale, salt="1"):
    kept = [(i, [math.floor(scale * x) for x in v]) for i, v, *_ in rows if v is not None and len(v) == dims and all(x is not None and math.isfinite(x) for x in v)]
    order = sorted(kept, key=lambda r: ((r[0] is None, "" if r[0] is None else hashlib.sha256(f"{salt}:{r[0]}".encode()).hexdigest()), r[1]))
    centres = [v for _, v in order[:k]]
    dist = lambda a, b: sum((x - y) ** 2 for x, y in zip(a, b, strict=True))
    near = lambda v: min((dist(v, c), j) for j, c in enumerate(centres))
    for _ in range(rounds):
        at = [near(v)[1] for _, v in kept]
        for j in range(len(centres)):
            mine = [v for (_, v), a in zip(kept, at, strict=True) if a == j]
            if mine:
                centres[j] = [sum(c) // len(mine) for c in zip(*mine, strict=True)]
    out = [(i, *near(v)[::-1]) for i, v in kept]
    total = {}
    for _, j, d in out:
        total[j] = total.get(j, 0) + d
    sha = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centres]
    return sorted(((i, j, d, total[j], sum(total.values()), sha[j]) for i, j, d in out), key=str)


@pytest.mark.parametrize(("dims", "k", "spread", "seed"), [(3, 5, 0.02, 1), (8, 16, 1.0, 2), (2, 4, 0.0, 3)])
def test_equals_brute_force_with_ties_and_odd_rows(spark, dims, k, spread, seed):
    rng = np.random.default_rng(seed)
    middles = rng.normal(size=(6, dims))
    rows = [(int(i), [float(x) for x in middles[i % 6] + spread * rng.normal(size=dims)], 1, "c", "v") for i in range(300)]
    rows += [(i % 7, rows[0][1], 2, None, None) for i in range(60)]  # one common vector, repeated ids and rows
    rows += [(None, rows[3][1], None, None, None), (None, None, 1, "", ""), (900, [1.0] * (dims + 1), 1, "", ""), (901, [], 1, "", "")]
    rows += [(902, [math.nan] * dims, 1, "", ""), (903, [math.inf] + [0.0] * (dims - 1), 1, "", ""), (904, [None] + [0.0] * (dims - 1), 1, "", "")]
    df = spark.createDataFrame(rows, SCHEMA).repartition(5)
    got = sorted((tuple(r) for r in bk.ball_kmeans(df, dims=dims, k=k, rounds=3).collect()), key=str)
    assert got == brute(rows, dims, k, 3, 64)


def test_empty_few_and_huge_components(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert bk.ball_kmeans(empty).count() == 0
    assert bk.ball_kmeans(empty).columns == ["vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"]
    few = spark.createDataFrame([(1, [0.0, 1.0], 1, "", ""), (2, [1e300, -1e300], 1, "", "")], SCHEMA)
    got = {r.vec_id: (r.distance, r.inertia) for r in bk.ball_kmeans(few, dims=2).collect()}
    assert got == {1: (0, 0), 2: (0, 0)}


def test_only_neighbours_are_compared_and_the_core_is_left_alone():
    centres = np.array([[0, 0], [100, 0], [0, 90], [10_000, 0]])
    balls = bk.Balls(centres, [30, 60, 200, 5])
    assert [n.tolist() for n in balls.near] == [[], [0], [0, 1], []]
    x = np.array([[0, 29], [0, 30], [0, 45], [50, 0], [49, 0]])
    got, d = balls.assign(x, np.array([0, 0, 2, 1, 1]))
    assert got.tolist() == [0, 0, 0, 0, 0] and d.tolist() == [841, 900, 2025, 2500, 2401]


def test_sql_on_ties(spark, tmp_path):
    rng = np.random.default_rng(5)
    rows = [(int(i), [float(x) for x in rng.integers(-2, 3, 64) / 8]) for i in range(200)] + [(3, [0.0] * 64)] * 40 + [(None, [0.5] * 64)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    df.write.parquet(f"{tmp_path}/e")
    want = duckdb.sql(f"SELECT vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256 FROM ({bk.oracle_sql(table=f"'{tmp_path}/e/*.parquet'")})").fetchall()
    assert sorted(map(tuple, bk.ball_kmeans(df).collect()), key=str) == sorted(want, key=str)
