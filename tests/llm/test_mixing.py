import math

import duckdb
import pytest
from pyspark.sql import functions as F

from opinara.llm import mixing

SCHEMA = "doc_id long, text string, source string, copy_no string"


def poisson_inverse(u, rate):
    k, p, cum = 0, math.exp(-rate), math.exp(-rate)
    while cum <= u:
        k += 1
        p *= rate / k
        cum += p
    return k


def uniform(seed, doc_id):
    import hashlib

    return int(hashlib.md5(f"{seed}:{'null' if doc_id is None else doc_id}".encode()).hexdigest()[:13], 16) / 2**52


def test_counts_follow_the_inverse_distribution(spark):
    rows = [(i, "t", "hot" if i % 3 else None if i % 2 else "rare", "x") for i in range(600)] + [(None, None, "hot", None)]
    docs = spark.createDataFrame(rows, SCHEMA)
    out = mixing.mix_sources(docs, weights={"hot": 1.0, "rare": 2.0}, other_weight=1.0, seed=5).collect()
    n = {s: sum(r[2] == s for r in rows) for s in ("hot", "rare", None)}
    rate = {s: w * len(rows) / 4.0 / n[s] for s, w in (("hot", 1.0), ("rare", 2.0), (None, 1.0))}
    want = {r[0]: poisson_inverse(uniform(5, r[0]), rate[r[2]]) for r in rows}
    got: dict = {}
    for r in out:
        got[r.doc_id] = got.get(r.doc_id, 0) + 1
    assert got == {k: v for k, v in want.items() if v}
    assert [r.mix_key for r in out] == sorted(r.mix_key for r in out)


def test_shares_approach_the_target(spark):
    docs = spark.range(30000).selectExpr("id doc_id", "'t' text", "if(id % 10 < 7, 'a', 'b') source")
    got = {r.source: r["count"] for r in mixing.mix_sources(docs, weights={"a": 1, "b": 3}).groupBy("source").count().collect()}
    assert abs(got["a"] - 7500) < 300 and abs(got["b"] - 22500) < 600


def test_empty_zero_weight_and_too_high_rate(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert mixing.mix_sources(empty).count() == 0
    docs = spark.createDataFrame([(1, "t", "a", "x"), (2, "t", "b", "x")], SCHEMA)
    assert mixing.mix_sources(docs, weights={"a": 0.0, "b": 1.0}, size=2).where("source = 'a'").count() == 0
    with pytest.raises(ValueError):
        mixing.mix_sources(docs, size=10_000)


def test_means_of_any_size(spark):
    # Default weights: the one row of the rare source has a mean of 799, over the most of a single draw.
    docs = spark.range(640_001).selectExpr("id doc_id", "'t' text", "if(id = 5, null, 'a') source")
    rate = 640_001 / (640_000**0.5 + 1)
    got = mixing.mix_sources(docs).where("source is null").agg({"copy_no": "max", "*": "count"}).first()
    want = poisson_inverse(uniform(17, 5), rate / 2) + poisson_inverse(uniform(17, "part2:5"), rate / 2)
    assert tuple(got) == (want, want) and abs(want - rate) < 150
    # Mean and variance of the sums are those of a Poisson count of the whole mean.
    some = spark.range(120_000).selectExpr("id doc_id", "'t' text", "if(id < 100, 'b', 'a') source")
    c = [r["count"] for r in mixing.mix_sources(some, weights={"a": 0.0, "b": 1.0}).groupBy("doc_id").count().collect()]
    mean = sum(c) / len(c)
    assert len(c) == 100 and abs(mean - 1200) < 5 * (1200 / 100) ** 0.5
    assert 0.5 < sum((x - mean) ** 2 for x in c) / 99 / 1200 < 1.7


def test_sql_draws_means_of_any_size(spark, tmp_path):
    docs = spark.range(640_001).selectExpr("id doc_id", "'t' text", "if(id = 5, null, 'a') source")
    docs.write.parquet(f"{tmp_path}/docs")
    sql = mixing.oracle_sql(docs=f"'{tmp_path}/docs/*.parquet'", columns="doc_id, text, source")
    want = duckdb.sql(f"SELECT source, count(*), sum(copy_no), sum(mix_key) FROM ({sql}) GROUP BY source ORDER BY source").fetchall()
    got = mixing.mix_sources(docs).groupBy("source").agg(F.count("*"), F.sum("copy_no"), F.sum(F.col("mix_key").cast("decimal(38,0)"))).orderBy(F.col("source").asc_nulls_last()).collect()
    assert [(r[0], *map(int, r[1:])) for r in got] == [(w[0], *map(int, w[1:])) for w in want]
    assert got[1][0] is None and got[1][1] > mixing.MAX_RATE


def test_no_python_in_the_plan(spark):
    docs = spark.createDataFrame([(1, "t", "a", "x")], SCHEMA)
    plan = mixing.mix_sources(docs)._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Cartesian" not in plan


def test_columns_of_any_name_survive(spark):
    names = ["_u", "_n", "_s", "_cdf", "_parts", "n", "u", "s", "id", "row", "parts", "cdf", "rate", "a.b"]
    docs = spark.createDataFrame([(k, "t", "ab"[k % 2], *[f"{c}{k}" for c in names]) for k in range(50)], ["doc_id", "text", "source", *names])
    out = mixing.mix_sources(docs)
    assert out.columns == [*docs.columns, "copy_no", "mix_key"]
    for r in out.collect():
        assert all(r[c] == f"{c}{r.doc_id}" for c in names)
