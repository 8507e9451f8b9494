import io
import json
import tarfile
from datetime import date

import numpy as np
import pandas as pd
import pytest

from opinara.sources import readers, sinks


def test_mixed_lines(spark, tmp_path):
    lines = ['x\t{"id": "1", "text": "a"}', "\t".join(["2", "b"] + ["z"] * 23), '"3","c, d"', "junk", "x\t{broken"]
    (tmp_path / "in.txt").write_text("\n".join(lines))
    df = readers.parse_mixed_lines(readers.read_lines(spark, str(tmp_path / "in.txt")), "id string, text string", ["id", "text"], "id string, text string")
    assert sorted(map(tuple, df.collect())) == [("1", "a"), ("2", "b"), ("3", "c, d")]


def test_ids_and_responses(spark, tmp_path):
    (tmp_path / "ids.json").write_text("[3, 1, 3, \"x\"]")
    assert sorted(r.user_id for r in readers.read_id_list(spark, str(tmp_path / "ids.json")).collect()) == [1, 3]
    msg = lambda t: [{"message": {"content": t}}]
    rows = [{"custom_id": "a", "choices": msg("1")}, {"custom_id": "b", "response": {"body": {"choices": msg("2")}}}, {"custom_id": "c"}, {"custom_id": "d", "choices": []}]
    (tmp_path / "r.jsonl").write_text("\n".join(map(json.dumps, rows)))
    assert sorted(map(tuple, readers.read_responses(spark, str(tmp_path / "r.jsonl")).collect())) == [("a", "1"), ("b", "2")]


def test_matrices(spark, tmp_path):
    dense = np.array([[1.0, np.nan], [np.nan, 2.0]])
    np.save(tmp_path / "a.npy", dense)
    np.savez(tmp_path / "b.npz", data=np.array([5.0, np.nan]), indices=np.array([1, 0]), indptr=np.array([0, 1, 2]), shape=np.array([2, 2]))
    got = {(r.file[-5:], r.row_id, r.topic, r.value) for r in readers.read_matrix(spark, str(tmp_path / "*.np*"), ["x", "y"]).collect()}
    assert got == {("a.npy", 0, "x", 1.0), ("a.npy", 1, "y", 2.0), ("b.npz", 0, "y", 5.0)}


def test_archives_stata_and_logs(spark, tmp_path):
    with tarfile.open(tmp_path / "t.tar.gz", "w:gz") as t:
        for name in ("2020-01-02.txt", "2020-01-01.txt"):
            info = tarfile.TarInfo(name)
            info.size = 2
            t.addfile(info, io.BytesIO(b"hi"))
    got = readers.read_tar_members(spark, str(tmp_path / "t.tar.gz")).collect()
    assert [r.member for r in got] == ["2020-01-01.txt", "2020-01-02.txt"] and bytes(got[0].content) == b"hi"
    pd.DataFrame({"country": [826, 250], "v": [1.0, 2.5]}).to_stata(tmp_path / "s.dta", write_index=False)
    assert sorted(map(tuple, readers.read_stata(spark, str(tmp_path / "s.dta"), "country long, v double").collect())) == [(250, 2.5), (826, 1.0)]
    logs = spark.createDataFrame([("f", 1, "auc: 0.5"), ("f", 2, " auc: 0.75 "), ("f", 3, "note: x"), ("f", 4, "rmse: nan")], "file string, line_no long, value string")
    assert {r.name: r.value for r in readers.read_last_metrics(logs).where("name = 'auc'").collect()} == {"auc": 0.75}


def test_files_too_large_are_named(spark, tmp_path, monkeypatch):
    np.save(tmp_path / "small.npy", np.ones((1, 2)))
    np.save(tmp_path / "large.npy", np.ones((50, 2)))
    monkeypatch.setattr(readers, "MAX_WHOLE_FILE", 500)
    for read in (lambda p: readers.read_matrix(spark, p, ["x", "y"]), lambda p: readers.read_tar_members(spark, p), lambda p: readers.read_stata(spark, p, "v double")):
        with pytest.raises(ValueError, match=r"large\.npy") as found:
            read(str(tmp_path / "*.npy"))
        assert "small.npy" not in str(found.value)
    assert readers.read_matrix(spark, str(tmp_path / "small.npy"), ["x", "y"]).count() == 2


def test_sinks(spark, tmp_path):
    df = spark.range(100).selectExpr("id post_id", "concat('t', id) text", "cast(2000 + id % 2 as int) year")
    path = str(tmp_path / "out")
    assert sinks.write_once(df, path) and not sinks.write_once(df, path) and readers.read_if_exists(spark, path).count() == 100
    assert readers.read_if_exists(spark, str(tmp_path / "none")) is None
    sinks.write_bounded(df, str(tmp_path / "years"), rows=20)
    assert spark.read.parquet(str(tmp_path / "years")).groupBy("year").count().count() == 2
    with pytest.raises(Exception, match="already exists"):
        sinks.write_bounded(df, str(tmp_path / "years"))
    b = sinks.request_batches(df.unionAll(df), "label", "m", 40)
    assert b.count() == 100 and b.groupBy("batch").count().agg({"count": "max"}).first()[0] <= 40
    assert json.loads(b.where("custom_id = '7'").first().value)["body"]["messages"][1]["content"] == "t7"
    assert sinks.dated("a/b.csv", date(2020, 1, 2)) == "a/20200102_b.csv"
    old = spark.createDataFrame([(1, 5), (2, None)], "post_id long, relevance int")
    new = spark.createDataFrame([(2, 1)], "post_id long, relevance int")
    assert sorted(map(tuple, sinks.update_predictions(old, new, "relevance").collect())) == [(1, 5), (2, 1)]
