"""Operators behind loaded tables: topic files in several layouts, carried columns, coverage by topic, stored centroids, weights of a medium."""

import numpy as np
import pytest

from opinara.operators import adjustment, labels, panel, semantic
from opinara.plans import loaders


def test_medium_weights(spark):
    rows = [("off", s, f"a{i}", "b", x, x * 2) for s, shift in (("A", 0.0), ("B", 0.1)) for i, x in enumerate(np.linspace(0.1 + shift, 0.6 + shift, 9).tolist())]
    rows += [("on", "C", f"a{i}", "b", 0.1 * i, 0.5) for i in range(5)] + [("on", "D", f"a{i}", "b", 0.12 * i, None if i == 1 else 0.4) for i in range(5)]
    pairs = spark.createDataFrame(rows, "medium string, society string, t1 string, t2 string, x double, y double")

    def want(own, ref):
        kernel = lambda at, points: np.exp(-((at[:, None] - points[None]) ** 2) / (2 * np.var(points, ddof=1) * len(points) ** -0.4)).sum(1) / (len(points) * np.sqrt(2 * np.pi * np.var(points, ddof=1) * len(points) ** -0.4))
        w = np.ones(len(own)) if own is ref else kernel(own, ref) / kernel(own, own)
        return w / w.sum()

    for supported in (False, True):
        got = adjustment.medium_weights(pairs, "B", supported).toPandas()
        assert set(zip(got.medium, got.reference, got.society)) == {("off", "B", "A"), ("off", "B", "B"), ("on", "C", "C"), ("on", "C", "D")}
        spans = {"off": (0.2, 0.6) if supported else (0.1, 0.7), "on": (0.0, 0.4) if supported else (0.0, 0.48)}
        for (medium, reference), f in got.groupby(["medium", "reference"]):
            assert spans[medium][0] - 1e-9 <= f.x.min() and f.x.max() <= spans[medium][1] + 1e-9
            assert len(f) == {("off", False): 18, ("off", True): 14, ("on", False): 9, ("on", True): 8}[medium, supported]
            ref = f[f.society == reference].x.to_numpy()
            for society, g in f.groupby("society"):
                own = ref if society == reference else g.x.to_numpy()
                np.testing.assert_allclose(g.w.to_numpy(), want(own, ref), rtol=1e-9)
    assert adjustment.medium_weights(pairs.where("false"), "B").count() == 0
    flat = spark.createDataFrame([("m", "A", "a", "b", 0.5, 0.1), ("m", "A", "a", "c", 0.5, 0.1), ("m", "B", "a", "b", 0.1, 0.1), ("m", "B", "a", "c", 0.4, 0.1), (None, "A", "a", "d", 0.1, 0.1)], pairs.schema)
    assert [(r.society, r.w) for r in adjustment.medium_weights(flat, "B").orderBy("society").collect()] == [("A", None)] * 2 + [("B", 0.5)] * 2


def test_centroid_agreement(spark):
    table = lambda rows: spark.createDataFrame(rows, "topic int, centroid array<double>")
    got = semantic.centroid_agreement(table([(1, [1.0, 0.0]), (2, [1.0, 1.0]), (3, [0.0, 0.0]), (4, [1.0]), (5, [1.0])]), table([(1, [2.0, 0.0]), (2, [0.0, 3.0]), (3, [1.0, 0.0]), (4, [1.0, 0.0]), (6, [1.0])]))
    assert {r.topic: r.cosine and round(r.cosine, 9) for r in got.collect()} == {1: 1.0, 2: round(0.5**0.5, 9), 3: None, 4: None, 5: None, 6: None}
    assert {round(r.least, 9) for r in got.collect()} == {round(0.5**0.5, 9)}
    assert semantic.centroid_agreement(table([]), table([])).count() == 0


def test_merge_raters_carries(spark):
    a = spark.createDataFrame([(1, 2, "x"), (2, None, "y"), (1, 1, "w"), (4, 0, None)], "post_id int, label int, text string")
    b = spark.createDataFrame([(1, -1), (3, 5)], "post_id int, label int")
    got = {tuple(r) for r in labels.merge_raters([("a", a), ("b", b)], carry=("text",)).collect()}
    assert got == {(1, 2, -1, "x"), (2, None, None, "y"), (3, None, 5, None), (4, 0, None, None)}
    assert labels.merge_raters([("a", a), ("b", b)]).columns == ["post_id", "a", "b"]


def test_coverage_of_topics(spark):
    rows = spark.createDataFrame([(1, "u", 7), (1, "v", 7), (2, "u", 7), (2, "u", 7), (3, None, 8)], "user_id int, topic string, year int")
    got = {r.year: r.asDict() for r in panel.coverage(rows, 2, topics=("u", "v", "none")).collect()}
    assert got[7] == {"year": 7, "users": 2, "users_2plus": 1, "mean_topics": 1.5, "observed_share": 0.75, "users_u": 2, "users_v": 1, "users_none": 0}
    assert got[8]["users"] == 1 and got[8]["users_u"] == 0


def test_topic_opinions(spark, tmp_path):
    write = lambda rows, schema, path: spark.createDataFrame(rows, schema).write.parquet(f"{tmp_path}/{path}")
    write([("1", 1.0, None), ("2", None, None), ("x", 1.0, 1.0), ("3", 0.0, 1.0), (None, 2.0, 2.0)], "user_id string, `2019` double, `20.20` double", "merged-a.parquet")
    write([("9", 9.0)], "user_id string, `2019` double", "us/merged-a.parquet")
    write([(3, 2.0), (3, 1.0), (4, -1.0)], "user_id long, avg double", "b/avg_opinion.parquet")
    got = {tuple(r) for r in loaders.topic_opinions(spark, str(tmp_path), ["a", "b"]).collect()}
    assert got == {("a", 1, 1.0, 1), ("a", 3, 0.5, 2), ("b", 3, 1.5, 2), ("b", 4, -1.0, 1)}
    few = loaders.topic_opinions(spark, str(tmp_path), ["a", "b"], spark.createDataFrame([(3,)], "user_id long"))
    assert {tuple(r) for r in few.collect()} == {("a", 3, 0.5, 2), ("b", 3, 1.5, 2)}
    with pytest.raises(FileNotFoundError, match="merged-c.parquet.*c/avg_opinion.parquet"):
        loaders.topic_opinions(spark, str(tmp_path), ["a", "c"])
