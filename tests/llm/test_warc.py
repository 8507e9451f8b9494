import gzip
import hashlib
import pathlib
import uuid

import duckdb
import pytest

from opinara.llm import warc

SCHEMA = "page_id long, url string, html string, digest string, bytes string"


def brute(rows, least=1000):
    out = []
    for i, url, html, *_ in rows:
        same = [p for p, _, h, *_ in rows if (h or "") == (html or "") and p is not None]
        size = len((html or "").encode())
        last = max(same) if same and size >= least else i
        again = last != i
        out.append((i, size, hashlib.sha1((html or "").encode()).hexdigest(), "revisit" if again else "response", last if again else None, url))
    return sorted(out, key=str)


ROWS = [(i, f"http://example.com/{i}?q=%20x", f"<p>{i}</p>" * (200 if i % 2 else 2), "d", "b") for i in range(40)]
ROWS += [(100 + i, "http://example.org/same", "é" * 500, None, None) for i in range(30)] + [(200, "u", "é" * 499 + "a", "", "")] * 3 + [(201, "u", "é" * 499 + "a", "", "")] * 2
ROWS += [(None, "null id", "é" * 500, "", ""), (None, "a", "z" * 2000, "", ""), (None, "b", "z" * 2000, "", ""), (300, None, None, "", ""), (301, "", "", "", ""), (302, "x", "WARC/1.1\r\n\r\n" * 3, "", "")]
ROWS += [(303, "long", "0123456789" * 600_000, "", "")]


def test_round_trip_equals_brute_force(spark):
    df = spark.createDataFrame(ROWS, SCHEMA).repartition(4)
    got = warc.archive_pages(df).collect()
    assert sorted((tuple(r)[:6] for r in got), key=str) == brute(ROWS)
    assert all(r.block_ok for r in got)
    assert warc.archive_pages(spark.createDataFrame([], SCHEMA)).count() == 0


def test_sql_on_odd_rows(spark, tmp_path):
    df = spark.createDataFrame(ROWS, SCHEMA)
    df.write.parquet(f"{tmp_path}/p")
    want = duckdb.sql(f"SELECT page_id, payload_bytes, payload_digest, record_type, refers_to, url FROM ({warc.oracle_sql(table=f"'{tmp_path}/p/*.parquet'")})").fetchall()
    assert sorted((tuple(r)[:6] for r in warc.archive_pages(df).collect()), key=str) == sorted(want, key=str)


def test_the_join_of_many_repeated_payloads_keeps_all(spark, monkeypatch):
    monkeypatch.setattr(warc, "MAX_BROADCAST", 0)
    got = warc.archive_pages(spark.createDataFrame(ROWS, SCHEMA)).collect()
    assert sorted((tuple(r)[:6] for r in got), key=str) == brute(ROWS)


def test_selected_records_come_with_their_bytes(spark, monkeypatch):
    monkeypatch.setattr(warc, "ARCHIVE", 4000)
    index = warc.write_archives(spark.createDataFrame(ROWS, SCHEMA).repartition(2))
    assert index.select("archive").distinct().count() > 2
    some = {r.page_id: r for r in warc.read_records(index.where("page_id % 3 = 0 and record_type = 'response'"), payload=True).collect()}
    plain = {r[0]: r[2] or "" for r in ROWS if r[0] is not None}
    assert some and all(k % 3 == 0 and r.payload.decode() == plain[k] and r.payload_digest == r.digest for k, r in some.items())
    # A stale or wrong range is told, not guessed.
    wrong = index.limit(1).selectExpr("archive", "offset + 1 as offset", "length")
    assert warc.read_records(wrong).first().record_type == "damaged"


def test_archives_are_indexed_again_plain_gzipped_and_damaged(spark, tmp_path):
    index = warc.write_archives(spark.createDataFrame(ROWS, SCHEMA).repartition(2))
    names = [r.archive for r in index.select("archive").distinct().collect()]
    key = lambda df: sorted((tuple(r) for r in df.select("archive", "offset", "length", "url", "digest", "record_type", "page_id", "refers_to", "payload_bytes").collect()), key=str)
    assert key(warc.index_archives(spark, names)) == key(index)
    records = [warc.record(i, f"http://e.org/{i}", b"p" * i * 997, hashlib.sha1(b"p" * i * 997).hexdigest(), None) for i in range(9)]
    plain = tmp_path / "plain.warc"
    plain.write_bytes(b"".join(records))
    found = warc.index_archives(spark, [f"file://{plain}"])
    assert [r.page_id for r in found.orderBy("offset").collect()] == list(range(9))
    assert {r.page_id: len(r.payload) for r in warc.read_records(found, payload=True).collect()} == {i: i * 997 for i in range(9)}
    torn = tmp_path / "torn.warc.gz"
    members = [warc.gzip_member(r) for r in records]
    members[3] = members[3][:-20]
    members[5] = gzip.compress(b"no record")
    torn.write_bytes(b"junk\x1f\x8b" + b"".join(members))
    got = [r.page_id for r in warc.index_archives(spark, [f"file://{torn}"]).orderBy("offset").collect()]
    assert got == [0, 1, 2, 4, 6, 7, 8]


def test_records_follow_the_standard():
    r = warc.record(7, "http://e.org/a\r\nb ", b"", "d" * 40, 9)
    head, _, block = r.partition(b"\r\n\r\n")
    fields = warc.headers(head)
    assert fields[""] == "WARC/1.1" and fields["warc-type"] == "revisit" and fields["warc-target-uri"] == "http://e.org/a%0D%0Ab%20"
    assert int(fields["content-length"]) == len(block) - 4 and r.endswith(b"\r\n\r\n")
    assert uuid.UUID(fields["warc-record-id"][10:-1]) and warc.record_id(9, "d" * 40, "response") == fields["warc-refers-to"]
    for bad in (b"", b"WARC/1.1\r\n", r[:-6], b"WARC/1.1\r\nContent-Length: -4\r\n\r\n", b"WARC/1.1\r\nContent-Length: 9999999999999999999999\r\n\r\n"):
        assert warc.parse(bad) is None


@pytest.mark.parametrize("name", ["a/b", "/x/y"])
def test_paths_without_a_scheme(name, tmp_path):
    target = tmp_path / name.strip("/")
    store, path = warc.open_store(f"file:{target}")
    store.create_dir(path, recursive=True)
    assert pathlib.Path(target).is_dir()
