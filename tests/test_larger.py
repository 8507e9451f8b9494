"""Faults that only larger tables or several executors show, in small."""

import hashlib
import random
import time

import duckdb
import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import functions as F

from opinara.functions import stats
from opinara.operators import correlation, resampling, semantic
from opinara.plans import catalogue
from opinara.sources import readers, sinks


def test_least_row_by_the_one_number_of_the_sql(spark, tmp_path):
    rows = [("A", "F", 100.00, 2_000_000, 1), ("A", "F", 100.01, 1, 1), ("N", "O", None, 1, 1), ("N", "O", 5.0, 3, 2), ("R", "F", None, 4, 1)]
    spark.createDataFrame(rows, "l_returnflag string, l_linestatus string, l_extendedprice double, l_orderkey long, l_linenumber int").coalesce(1).write.parquet(str(tmp_path / "lineitem.parquet"))
    got = {tuple(r) for r in catalogue.QUERIES["least_row_per_group"](spark, str(tmp_path)).collect()}
    con = duckdb.connect()
    con.execute(f"CREATE VIEW lineitem AS SELECT * FROM '{tmp_path}/lineitem.parquet/*.parquet'")
    assert got == set(con.execute(catalogue.SQL["least_row_per_group"]).fetchall()) == {("A", "F", 11), ("N", "O", 32), ("R", "F", None)}


def test_spearman_of_values_that_are_never_computed_alike(spark):
    """As means are, whose parts arrive in another order each time."""

    @F.pandas_udf("double")
    def shaken(x: pd.Series) -> pd.Series:
        return x.map(lambda v: v + random.SystemRandom().random() * 1e-9)

    rows = spark.range(400).selectExpr("'a' t1", "'b' t2", "cast(pmod(id * 7919, 400) as double) x", "cast(pmod(id * 104729, 389) + id as double) y")
    shaking = rows.select("t1", "t2", shaken.asNondeterministic()("x").alias("x"), "y")
    got = correlation.spearman(shaking, "x", "y", ("t1", "t2")).collect()
    f = rows.toPandas()
    assert len(got) == 1 and got[0].n == 400 and abs(got[0].rho - stats.spearman(f["x"].to_numpy(), f["y"].to_numpy())) < 1e-9


def test_shuffles_in_several_bins_have_the_closed_forms_mean_and_sd(spark, monkeypatch):
    """Bins of few places: each draw still permutes all rows."""
    monkeypatch.setattr(resampling, "BIN", 256)
    rng = np.random.default_rng(5)
    x, y = rng.normal(size=(2, 1500))
    df = spark.createDataFrame([("a", "b", float(v), float(w)) for v, w in zip(x, y, strict=True)] + [("a", None, 1.0, 2.0), ("a", None, 2.0, 5.0)], "t1 string, t2 string, x double, y double").repartition(7)
    got = {r.t2: r for r in resampling.shuffled_correlations(df, 2000).collect()}
    r = got["b"]
    assert r.n == 1500 and abs(r.shuffled_mean) < 5 / 1499**0.5 / 2000**0.5 and abs(r.shuffled_sd * 1499**0.5 - 1) < 5 / 4000**0.5
    assert got[None].n == 2 and abs(got[None].shuffled_sd - 1) < 0.01


def test_ten_thousand_shuffles_of_a_long_pair(spark):
    df = spark.range(400_000).selectExpr("'a' t1", "'b' t2", "cast(pmod(xxhash64(id), 100003) as double) x", "cast(pmod(xxhash64(id, 7), 100003) as double) y")
    resampling.shuffled_correlations(df, 20).collect()
    start = time.monotonic()
    r = resampling.shuffled_correlations(df, 10_000).first()
    assert time.monotonic() - start < 60
    assert abs(r.shuffled_mean) < 5 / r.n**0.5 / 100 and abs(r.shuffled_sd * (r.n - 1) ** 0.5 - 1) < 5 / 20_000**0.5


def test_distances_of_more_queries_than_may_be_broadcast(spark, monkeypatch):
    monkeypatch.setattr(semantic, "MAX_TOPICS", 20)
    monkeypatch.setattr(semantic, "PAIR_BLOCK", 16)
    x = np.random.default_rng(6).normal(size=(90, 5))
    rows = [(k, v.tolist()) for k, v in enumerate(x)]
    points = spark.createDataFrame([*rows, (90, None), (91, [1.0, None, 1.0, 1.0, 1.0]), (92, [1.0, float("nan"), 1.0, 1.0, 1.0]), (93, [1.0])], "word long, vector array<double>")
    got = {(r.query, r.word): r.distance for r in semantic.point_distances(points, points.where("word % 2 = 0")).collect()}
    want = {(q, w): float(np.sqrt(((x[q] - x[w]) ** 2).sum())) for q in range(0, 90, 2) for w in range(90) if q != w}
    assert set(got) == set(want) | {(q, 93) for q in range(0, 90, 2)}
    assert all(abs(got[k] - d) < 1e-9 for k, d in want.items()) and all(got[q, 93] is None for q in range(0, 90, 2))


def test_points_are_not_copied_for_blocks_of_queries(spark, monkeypatch):
    monkeypatch.setattr(semantic, "PAIR_BLOCK", 10)
    x = np.random.default_rng(7).normal(size=(200, 4))
    points = spark.createDataFrame([(str(k), v.tolist()) for k, v in enumerate(x)], "word string, vector array<double>")
    found = semantic.point_distances(points, points.where("word like '%5'"))
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "Generate" not in plan and "CartesianProduct" in plan
    got = {(r.query, r.word): r.distance for r in found.collect()}
    assert len(got) == 20 * 199 and all(abs(d - np.sqrt(((x[int(q)] - x[int(w)]) ** 2).sum())) < 1e-12 for (q, w), d in got.items())


def test_matrix_of_more_rows_than_one_file_has(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(sinks, "ONE_FILE_ROWS", 50)
    monkeypatch.setattr(sinks, "MATRIX_ROWS", 30)
    rows = [(k * 7 % 1009, t, k + j / 4) for k in range(100) for j, t in enumerate("xyz") if (k + j) % 3 != 0]
    values = spark.createDataFrame([*rows, (5000, "x", None), (None, "y", 1.0), (5001, "w", 1.0)], "user_id long, topic string, value double").repartition(6)
    path = str(tmp_path / "large.npz")
    sinks.write_matrix(values, path, ["x", "y", "z"])
    got = {(r.row_id, r.topic, r.value) for r in readers.read_matrix(spark, path, ["x", "y", "z"]).collect()}
    at = {u: k for k, u in enumerate(sorted({r[0] for r in rows}))}
    assert got == {(at[u], t, v) for u, t, v in rows} and len(list((tmp_path / "large.npz").iterdir())) >= 4


def test_bags_that_are_alike_are_computed_once(monkeypatch):
    rng = np.random.default_rng(8)
    left, right = (np.where(rng.random((n, 4)) < 0.3, np.nan, rng.normal(size=(n, 4))) for n in (30, 50))
    bag = ([0, 1, 2, 3], 4.0)
    one, common = semantic._bag_distances(left, right, [bag], 2)
    calls, plain = [], np.sqrt
    monkeypatch.setattr(semantic.np, "sqrt", lambda *a, **k: calls.append(1) or plain(*a, **k))
    many, again = semantic._bag_distances(left, right, [bag] * 20, 2)
    assert len(calls) == 1 and np.array_equal(one, many, equal_nan=True) and (common == again).all()


def test_candidates_of_nearest_pairs_are_few(spark, monkeypatch):
    """A row's k nearest leave each slice, not each block."""
    monkeypatch.setattr(semantic, "PAIR_BLOCK", 20)
    rng = np.random.default_rng(9)
    x = np.where(rng.random((160, 3)) < 0.2, np.nan, rng.integers(0, 6, (160, 3)).astype(float))
    values = spark.createDataFrame([(k, t, float(v)) for k, row in enumerate(x) for t, v in zip("abc", row, strict=True) if v == v], "user_id long, topic string, value double")
    got = {}
    for r in semantic.nearest_pairs(values, [(["a", "b", "c"], 3.0)], 5).collect():
        got.setdefault(r.word, []).append((r.rank, r.distance, r.neighbour))
    d, _ = semantic._bag_distances(x, x, [([0, 1, 2], 3.0)], 2)
    for k in range(160):
        want = sorted((d[k, j], j) for j in range(160) if j != k and d[k, j] > 0)[:5]
        assert [(r, round(a, 9), j) for r, a, j in sorted(got.get(k, []))] == [(r, round(a, 9), j) for r, (a, j) in enumerate(want, 1)]


def test_neighbours_are_computed_once(spark):
    made = spark.sparkContext.accumulator(0)

    @F.udf("double")
    def counted(v):
        made.add(1)
        return v

    rows = spark.range(200).selectExpr("id word", "explode(array(1, 2)) rank", "1 + pmod(id * 7919, 101) / 100 d").selectExpr("word", "rank", "d * rank distance")
    semantic.twonn_dimension(rows.withColumn("distance", counted.asNondeterministic()("distance"))).collect()
    assert made.value == 400


def test_blocks_of_query_distances_are_shuffled_once(spark, monkeypatch):
    """What is shuffled grows with the rows, not with the blocks that they meet."""
    monkeypatch.setattr(semantic, "PAIR_BLOCK", 5)
    x = np.random.default_rng(10).normal(size=(120, 3))
    values = spark.createDataFrame([(k, t, float(v)) for k, row in enumerate(x) for t, v in zip("abc", row, strict=True)], "user_id long, topic string, value double")
    found = semantic.query_distances(values, values.where("user_id % 4 = 0"), [(["a", "b", "c"], 3.0)])
    got = {(r.a, r.b): r.distance for r in found.collect()}
    assert got.keys() == {(a, b) for a in range(0, 120, 4) for b in range(120) if a != b}
    assert all(abs(d - float(np.sqrt(((x[a] - x[b]) ** 2).sum()))) < 1e-9 for (a, b), d in got.items())
    assert "explode" not in found._jdf.queryExecution().optimizedPlan().toString()


def test_a_few_groups_are_not_shuffled_by_group(spark, monkeypatch):
    """Joins with numbers of a few groups are broadcast, whatever Spark thinks of their size."""
    from opinara.operators import curves, ranks

    monkeypatch.setattr(ranks, "cut_lineage", lambda df, name: df)
    monkeypatch.setattr(curves, "cut_lineage", lambda df, name: df)
    rows = spark.range(300).selectExpr("if(id % 2 = 0, 'a', 'b') g", "cast(pmod(id * 7919, 101) as double) x", "cast(id % 7 as double) y")
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plans = [f._jdf.queryExecution().executedPlan().toString() for f in (curves.density_curve(rows, "g", "x"), ranks.numbered(rows, ["g"], [F.col("x"), F.col("y")]))]
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    assert not any("SortMergeJoin" in p or "ShuffledHashJoin" in p for p in plans)


def test_correlations_behind_subset_means_are_computed_once(spark):
    from opinara.operators import subsets

    made = spark.sparkContext.accumulator(0)

    @F.udf("double")
    def counted(v):
        made.add(1)
        return v

    pairs = spark.createDataFrame([(s, t, u, (ord(t) + 2 * ord(u)) / 400) for s in "AB" for t in "abcd" for u in "abcd" if t < u], "society string, t1 string, t2 string, y double")
    means = subsets.subset_means(pairs.withColumn("y", counted.asNondeterministic()("y")), list("abcd"), 3)
    subsets.set_gaps(means, [("A", "B")], {("A", "B"): (0.1,)}).collect()
    assert made.value == 12


def test_slices_of_points_are_bounded(spark, monkeypatch):
    from opinara.operators import knn

    monkeypatch.setattr(knn, "CELL", 10)
    monkeypatch.setattr(knn, "SLICES", 8)
    held = []
    plain = knn._copies
    monkeypatch.setattr(knn, "_copies", lambda begun, cells, count: held.append(cells) or plain(begun, cells, count))
    x = np.random.default_rng(11).normal(size=(900, 8))
    points = spark.createDataFrame([(k, v.tolist()) for k, v in enumerate(x)], "word long, vector array<double>")
    got: dict = {}
    for r in knn.neighbours(points, 2).collect():
        got.setdefault(r.word, []).append((r.rank, r.neighbour))
    d = ((x[:, None] - x[None]) ** 2).sum(2)
    np.fill_diagonal(d, np.inf)
    assert {k: [j for _, j in sorted(v)] for k, v in got.items()} == {k: np.argsort(d[k])[:2].tolist() for k in range(900)}
    assert held[0].slices.sum() <= 3 * 8


def test_thinned_entries_are_dealt_out_once(spark):
    """Copies of entries for shares and patterns are made after the shuffle, and after an entry is hashed."""
    from opinara.operators import simulation, spectral

    values = spark.range(60).selectExpr("id % 20 user_id", "concat('t', id div 20) topic", "cast(id * 7 % 11 as double) value")
    thin = simulation.thinned(values, (0.0, 0.5), 2)
    plan = spectral.cross_sums(thin, ("pattern", "missing", "rep"))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning(user_id") == 1 and "Exchange hashpartitioning(pattern#" in plan
    assert "user_id" not in plan[plan.index("Exchange hashpartitioning(pattern#") :].splitlines()[0]


def test_numbered_rows_are_shuffled_once(spark):
    """Numbers come from the ids of stored ranges: no second shuffle by range and group, where several may meet in one task."""
    from opinara.operators import ranks

    rows = [("ab"[k % 2] if k % 5 else None, k * 37 % 101, k) for k in range(100)]
    for by in (["g"], []):
        found = ranks.numbered(spark.createDataFrame(rows, "g string, o int, v int").repartition(5), by, [F.col("o")])
        plan = found._jdf.queryExecution().executedPlan().toString()
        assert "Exchange hashpartitioning" not in plan and "Window" not in plan
        own = lambda g: [o for h, o, _ in rows if h == g or not by]
        assert {(r.g, r.o, r.v, r._n, r._size) for r in found.collect()} == {(g, o, v, sum(p <= o for p in own(g)), len(own(g))) for g, o, v in rows}


def test_local_lines_meet_few_rows_one_by_one(spark, monkeypatch):
    """Windows of many rows, equal and unequal, are found from every eighth row and the rows near their ends."""
    from opinara.operators import curves

    monkeypatch.setattr(curves, "EVERY", 8, raising=False)
    stored = {}
    plain = curves.cut_lineage
    monkeypatch.setattr(curves, "cut_lineage", lambda df, name: stored.setdefault(name, plain(df, name)))
    rng = np.random.default_rng(12)
    x = {"ties": np.floor(rng.random(700) ** 3 * 9), "steep": rng.random(601) ** 6, "level": np.ones(40), "gap": np.repeat([0.0, 50.0, 51.0], [90, 1, 9]), "two": np.array([1.0, 3.0])}
    rows = [(g, float(a), *map(float, rng.random(2))) for g, own in x.items() for a in own]
    df = spark.createDataFrame(rows, "g string, x double, y double, w double").repartition(6)
    got = {(r.g, r.span, r.fit, round(r.x, 9)): r.value for r in curves.local_lines(df, "g", "x", "y", {"raw": None, "own": "w"}, (0.04, 0.3, 1.0), 7).collect()}
    for g in x:
        own = np.array([r[1:] for r in rows if r[0] == g])
        at = np.linspace(own[:, 0].min(), own[:, 0].max(), 7)
        for span in (0.04, 0.3, 1.0):
            for fit, w in (("raw", None), ("own", own[:, 2])):
                want = stats.loess(own[:, 0], own[:, 1], at, span, w)
                assert np.allclose([got[g, span, fit, round(float(p), 9)] for p in at], want, atol=1e-6), (g, span, fit)
    assert stored["coarse"].count() <= len(rows) / 8 + 2 * len(x)
    assert stored["fine"].groupBy("g", "span", "j").count().agg(F.max("count")).first()[0] <= 2 * 8 + 1


def _hashed(text: str) -> float:
    return (int(hashlib.md5(text.encode()).hexdigest()[:10], 16) + 0.5) / float(1 << 40)


def test_md5_of_many_texts_at_once(monkeypatch):
    from opinara.functions import hashes

    monkeypatch.setattr(hashes, "ROWS", 7)
    monkeypatch.setattr(hashes, "SIDE", 20)
    texts = ["", "é:22", *["x" * n for n in range(40, 70)], "y" * 119, "y" * 120, "z" * 500]
    tails = pa.array(["before", *texts])[1:]
    for heads in (["1:1:", "1:2:", "2:7:"], ["1:100:"], [""], ["h" * 70, "i" * 70]):
        got = hashes.md5_numbers([h.encode() for h in heads], tails)
        assert [[(x + 0.5) / float(1 << 40) for x in row] for row in got.tolist()] == [[_hashed(h + t) for t in texts] for h in heads]
    assert hashes.md5_numbers([b"1:"], tails[:0]).shape == (1, 0)
    z = hashes.hashed_normals(8, range(8, 13), tails)
    for k, t in enumerate(texts):
        want = [np.sqrt(-2 * np.log(_hashed(f"9:{d}:{t}"))) * np.cos(2 * np.pi * _hashed(f"10:{d}:{t}")) for d in range(8, 13)]
        assert np.allclose(z[k], want, rtol=1e-12, atol=1e-12)


def test_noise_is_hashed_for_many_values_at_once(spark, monkeypatch):
    from opinara.operators import simulation

    monkeypatch.setattr(simulation, "DRAWS", 4, raising=False)
    rows = [(u, t, float(u * 7 % 11) if u != 5 else None) for u in range(30) for t in ("1-ä", "b")] + [(None, "b", 2.0), (3, None, 1.0), (9, "alone", 1.0)]
    values = spark.createDataFrame(rows, "user_id long, topic string, value double").repartition(3)
    found = simulation.noisy_reliability(values, 0.7, 11, seed=3)
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "md5" not in plan and plan.count("ArrowEvalPython") == 1
    assert found.columns == ["topic", "user_id", "value", "draw"]
    got = {(r.topic, r.user_id, r.draw): r.value for r in found.collect()}
    assert got.keys() == {(t, u, d) for u, t, _ in rows if t for d in range(1, 12)}
    var = {t: np.var([v for _, s, v in rows if s == t and v is not None], ddof=1) for t in ("1-ä", "b")}
    for u, t, v in rows:
        for d in range(1, 12) if t else ():
            if t == "alone" or u is None or v is None:
                assert got[t, u, d] is None
                continue
            z = np.sqrt(-2 * np.log(_hashed(f"4:{d}:{t}:{u}"))) * np.cos(2 * np.pi * _hashed(f"5:{d}:{t}:{u}"))
            assert abs(got[t, u, d] - (v + np.sqrt(var[t] * 0.3 / 0.7) * z)) < 1e-9


def test_noise_of_values_of_no_user_is_that_of_the_sql(spark, tmp_path):
    rows = [(k, None if k % 7 == 0 else k % 9, f"{k % 3}-T", 50_000.0 + 997 * k) for k in range(60)]
    spark.createDataFrame(rows, "o_orderkey long, o_custkey long, o_orderpriority string, o_totalprice double").selectExpr("*", "timestamp '1995-01-01' o_orderdate").coalesce(1).write.parquet(str(tmp_path / "orders.parquet"))
    got = {tuple(r) for r in catalogue.QUERIES["noisy_reliability"](spark, str(tmp_path)).collect()}
    con = duckdb.connect()
    con.execute(f"CREATE VIEW orders AS SELECT * FROM '{tmp_path}/orders.parquet/*.parquet'")
    assert len(got) == 300 and got == set(con.execute(catalogue.SQL["noisy_reliability"]).fetchall())
