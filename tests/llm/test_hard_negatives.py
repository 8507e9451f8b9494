import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from opinara.llm import hard_negatives as hn

SCHEMA = "vec_id long, embedding array<double>, label int, a string, score string"


def brute(rows, every, positives=5, negatives=10, low=30, high=90, scale=256):
    kept = [(i, [math.floor(scale * x) for x in v], lab) for i, v, lab, *_ in rows if lab is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    order = lambda r: (-r[0], r[1] is None, r[1] or 0)
    out = []
    for n, (i, v, lab) in enumerate(kept):
        if i is None or i % every:
            continue
        scored = [(sum(x * y for x, y in zip(v, w, strict=False)), j, other) for m, (j, w, other) in enumerate(kept) if m != n]
        for ps, p, _ in sorted((r for r in scored if r[2] == lab), key=order)[:positives]:
            fit = sorted((r for r in scored if r[2] != lab and low * ps <= 100 * r[0] <= high * ps), key=order)[:negatives]
            out += [(i, p, k + 1, j, ps, s) for k, (s, j, _) in enumerate(fit)]
    return sorted(out, key=str)


def found(df, every, **more):
    return sorted((tuple(r) for r in hn.hard_negatives(df, F.col("vec_id") % every == 0, F.col("label"), **more).collect()), key=str)


@pytest.mark.parametrize(("dims", "values", "seed"), [(6, 2, 1), (16, 40, 2), (3, 1, 3)])
def test_equals_brute_force_with_ties_copies_and_odd_rows(spark, monkeypatch, dims, values, seed):
    monkeypatch.setattr(hn, "BLOCK", 12)
    rng = np.random.default_rng(seed)
    rows = [(int(i), [float(x) for x in (rng.integers(-values, values + 1, dims) + 0.5) / 256], int(rng.integers(0, 3)), "x", "y") for i in range(250)]
    rows += [(300 + i, rows[10][1], i % 2, None, None) for i in range(60)]  # one common vector under many ids
    rows += [rows[0]] * 3 + [(10, rows[11][1], 1, "", "")] * 2 + [(None, rows[5][1], 0, "", ""), (None, rows[6][1], 2, "", "")]
    rows += [(20, None, 1, "", ""), (30, rows[1][1], None, "", ""), (40, [None] * dims, 1, "", ""), (50, [math.nan] * dims, 1, "", ""), (60, [], 1, "", "")]
    rows += [(70, rows[2][1][:-1], 2, "", ""), (80, [*rows[2][1], 0.1], 0, "", "")]  # shorter and longer vectors
    df = spark.createDataFrame(rows, SCHEMA).repartition(6)
    assert found(df, 10) == brute(rows, 10)


def test_many_tasks_and_empty(spark, monkeypatch):
    monkeypatch.setattr(hn, "MANY_TASKS", 2)
    rng = np.random.default_rng(4)
    rows = [(int(i), [float(x) for x in rng.normal(size=8)], i % 4, "x", "y") for i in range(400)]
    df = spark.createDataFrame(rows, SCHEMA).repartition(8)
    assert found(df, 20, positives=3, negatives=4) == brute(rows, 20, 3, 4)
    assert found(spark.createDataFrame([], SCHEMA), 10) == []
    assert found(df.where("vec_id % 20 <> 0"), 20) == []


def test_intervals_tighten_and_drop_pairs():
    rng = np.random.default_rng(6)
    a, x = rng.integers(-80, 80, (5, 32)), rng.integers(-80, 80, (300, 32))
    exact = a @ x.T
    floors, tops = np.sort(exact, 1)[:, [-20, 100]], np.sort(exact, 1)[:, [-3, 110]]
    alive = rng.random(exact.shape) < 0.7
    at, row, score = hn.qualified(a, x, alive, floors, tops)
    inside = ((exact[..., None] >= floors[:, None]) & (exact[..., None] <= tops[:, None])).any(2) & alive
    assert set(zip(at, row, strict=True)) == set(zip(*np.nonzero(inside), strict=True))
    assert (score == exact[at, row]).all()
    for values in ([0, 0], [-1, 0], [-128, 127], [5, 3], [-(1 << 25), 1 << 25]):
        x = np.array([values])
        assert (sum(w * p.astype(np.int64) for w, p in hn.planes(x)) == x).all()
