"""WARC archives: an index first, then coalesced reads of the records it selects.

``write_archives`` writes one record for each row, a gzip member of its own, and returns the index: archive, offset, length,
URL and digest of every record.  Of records with equal payloads of at least ``least`` bytes the one of the largest id is
written in full (``response``); the others refer to it (``revisit``) and repeat its headers only.  ``index_archives`` makes
the same index for archives that others wrote, gzipped by record or plain, by one pass over each of them.

``read_records`` takes any selection of index rows.  It deals them out by ranges of (archive, offset), so that a task has
neighbours; there, sorted ranges with small gaps become one read of at most ``WINDOW`` bytes (or one record).  Archives are
opened through ``pyarrow.fs`` by their URI, so that any store that it knows (file, hdfs, s3, gs, abfs) will do.  Nothing is written
but complete archives: a task that is run again writes new ones, and only those count whose index rows Spark has committed.

Edge cases: a null payload is an empty one; a null URL has no WARC-Target-URI and reads as null; control characters in
URLs, and spaces at their ends, are percent-encoded in the record and stay so; a null id has no Page-ID and, among equal payloads, is
smaller than all others; rows that share the largest id are all written in full; repeated rows get equal records;
no rows give no archives; damage is skipped up to the next record's start when archives are indexed, and a range that holds no
record reads as a record of type ``damaged``; other columns of the pages are ignored, whatever their names.
"""

from __future__ import annotations

import hashlib
import re
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.fs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from opinara.llm.joins import MAX_BROADCAST, join_by_size
from opinara.session import Scratch, cut_lineage, shared_folder, small_batches

#: Bytes after which an archive is complete; bytes of one read, and of a gap that is read along.
ARCHIVE, WINDOW, GAP = 256 << 20, 4 << 20, 64 << 10
#: Bytes of selected records for one task.
TASK = 32 << 20
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
INDEX = "archive string, offset long, length long, url string, digest string, record_type string, page_id long, refers_to long, payload_bytes long"
#: When the pages were fetched isn't known; a fixed date keeps equal rows equal.
DATE = "1970-01-01T00:00:00Z"
_START = re.compile(rb"WARC/1\.[01]\r\n")


def open_store(uri: str) -> tuple[pa.fs.FileSystem, str]:
    """The store of a folder or archive and the path in it."""
    return pa.fs.FileSystem.from_uri(uri if "://" in uri or not uri.startswith("file:") else "file://" + uri[5:])


def escaped(url: str) -> str:
    """``url`` for a header line: control characters, and spaces at its ends, are percent-encoded."""
    return re.sub(r"[\x00-\x1f\x7f]|^ +| +$", lambda m: "".join(f"%{ord(c):02X}" for c in m[0]), url)


def record_id(page_id: int | None, digest: str, kind: str) -> str:
    return f"<urn:uuid:{uuid.UUID(hashlib.sha256(f'{page_id}:{digest}:{kind}'.encode()).hexdigest()[:32])}>"


def record(page_id: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None) -> bytes:
    """One WARC/1.1 record; a revisit (``refers_to``) has the HTTP header alone, which keeps the payload's length."""
    kind = "revisit" if refers_to is not None else "response"
    block = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block += b"" if kind == "revisit" else payload
    lines = ["WARC/1.1", f"WARC-Type: {kind}", f"WARC-Record-ID: {record_id(page_id, digest, kind)}", f"WARC-Date: {DATE}"]
    lines += [] if url is None else [f"WARC-Target-URI: {escaped(url)}"]
    lines += [] if page_id is None else [f"Page-ID: {page_id}"]
    if kind == "revisit":
        lines += [f"WARC-Profile: {PROFILE}", f"WARC-Refers-To: {record_id(refers_to, digest, 'response')}", f"Refers-To-Page-ID: {refers_to}"]
    lines += [f"WARC-Payload-Digest: sha1:{digest}", f"WARC-Block-Digest: sha1:{hashlib.sha1(block).hexdigest()}", "Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def gzip_member(data: bytes, level: int = 1) -> bytes:
    packer = zlib.compressobj(level, zlib.DEFLATED, 31)
    return packer.compress(data) + packer.flush()


def headers(data: bytes) -> dict[str, str]:
    """Header fields by lower-case name; folded lines join the one before; the first line is at ``""``."""
    lines = re.sub(rb"\r?\n[ \t]+", b" ", data).split(b"\n")
    found = {"": lines[0].rstrip(b"\r").decode("utf-8", "replace")}
    for line in lines[1:]:
        name, colon, value = line.partition(b":")
        if colon:
            found.setdefault(name.strip().decode("latin-1").lower(), value.strip().decode("utf-8", "replace"))
    return found


def number(text: str | None) -> int | None:
    return int(text) if text is not None and re.fullmatch(r"-?\d{1,18}|-?9\d{18}", text) else None


def parse(data: bytes) -> dict | None:
    """The fields of the record that ``data`` holds; None if it holds none or less than its Content-Length."""
    start = _START.match(data)
    end = data.find(b"\r\n\r\n") if start else -1
    head = headers(data[:end]) if end >= 0 else {}
    size = number(head.get("content-length"))
    if size is None or size < 0 or len(data) < end + 4 + size:
        return None
    block = data[end + 4 : end + 4 + size]
    payload, stated = block, None
    if head.get("content-type", "").replace(" ", "").startswith("application/http"):
        cut = block.find(b"\r\n\r\n")
        stated = number(headers(block[: max(cut, 0)]).get("content-length"))
        payload = block[cut + 4 :] if cut >= 0 else block
    digest = head.get("warc-payload-digest", "")
    kind = head.get("warc-type", "")
    return {
        "record_type": kind,
        "url": head.get("warc-target-uri"),
        "digest": digest.removeprefix("sha1:") or None,
        "page_id": number(head.get("page-id")),
        "refers_to": number(head.get("refers-to-page-id")),
        "payload": None if kind == "revisit" else payload,
        "payload_bytes": stated if kind == "revisit" else len(payload),
        "block_ok": head.get("warc-block-digest") in (None, "sha1:" + hashlib.sha1(block).hexdigest()),
        "headers": head,
        "size": end + 4 + size,
    }


def originals(pages: DataFrame, least: int) -> DataFrame:
    """(digest, bytes, last, n): the payloads of ``least`` bytes or more that several rows have, and their largest id."""
    return pages.where(F.col("bytes") >= least).groupBy("key", "bytes").agg(F.max("page_id").alias("last"), F.count(F.lit(1)).alias("n")).where("n > 1")


def write_archives(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", payload: Column | None = None, folder: str | None = None, least: int = 1000) -> DataFrame:
    """Writes ``pages`` as WARC archives below ``folder`` (the shared one by default); returns their index, stored.

    ``payload`` is a column of text or bytes (``html`` by default).  Equal payloads are told by their length and SHA-256."""
    spark = pages.sparkSession
    small_batches(spark)
    folder = folder or f"{shared_folder(spark)}/warc-{uuid.uuid4().hex}"
    store, path = open_store(folder)
    store.create_dir(path, recursive=True)
    body = F.coalesce((F.col("html") if payload is None else payload).cast("binary"), F.lit(b""))
    rows = pages.select(F.col(f"`{id_col}`").cast("long").alias("page_id"), F.col(f"`{url_col}`").cast("string").alias("url"), body.alias("payload"))
    rows = rows.withColumn("bytes", F.octet_length("payload").cast("long")).withColumn("key", F.sha2("payload", 256))
    repeated = cut_lineage(originals(rows.select("page_id", "bytes", "key"), least), "repeated")
    # The payloads themselves are shuffled only if there are more repeated ones than may be broadcast.
    if repeated.limit(MAX_BROADCAST + 1).count() <= MAX_BROADCAST:
        rows = rows.join(F.broadcast(repeated.drop("n")), ["key", "bytes"], "left")
    else:
        rows = join_by_size(rows, repeated, ["key", "bytes"], how="left")
    refers = F.when(F.col("last").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("last")), F.col("last"))
    rows = rows.select("page_id", "url", "payload", refers.alias("refers_to"))

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, path = open_store(folder)
        out, name, at = None, "", 0
        for b in batches:
            index = []
            for page_id, url, data, refers_to in zip(*(c.to_pylist() for c in b.columns), strict=True):
                if out is None or at >= ARCHIVE:
                    if out is not None:
                        out.close()
                    name = f"{uuid.uuid4().hex}.warc.gz"
                    out, at = store.open_output_stream(f"{path}/{name}", compression=None), 0
                digest = hashlib.sha1(data).hexdigest()
                packed = gzip_member(record(page_id, url, data, digest, refers_to))
                out.write(packed)
                index.append((f"{folder}/{name}", at, len(packed), url, digest, "response" if refers_to is None else "revisit", page_id, refers_to, len(data)))
                at += len(packed)
            if index:
                yield _index_batch(index)
        if out is not None:
            out.close()  # a failure here fails the task, and its rows with it

    return cut_lineage(rows.mapInArrow(write, INDEX), "warc-index")


_TYPES = [pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.int64(), pa.int64(), pa.int64()]
_NAMES = [c.strip().split(" ")[0] for c in INDEX.split(",")]


def _index_batch(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), _TYPES, strict=True)], names=_NAMES)


def scan(stream, size: int) -> Iterator[tuple[int, int, dict]]:
    """(offset, length, fields) of each record of an open archive of ``size`` bytes, gzipped by record or plain.

    Holds one record and one chunk at a time.  What is no record is skipped up to the next start of one."""
    data, base = b"", 0  # the bytes [base, base + len(data)) of the archive

    def more() -> bool:
        nonlocal data
        got = stream.read_at(min(WINDOW, size - base - len(data)), base + len(data)) if base + len(data) < size else b""
        data += got
        return bool(got)

    while True:
        if len(data) < 12 and not more() and not data:
            return
        found, used = None, 0
        if data[:2] == b"\x1f\x8b":
            unpacker, out, fed = zlib.decompressobj(31), [], 0
            try:
                while not unpacker.eof:
                    if fed == len(data) and not more():
                        break
                    out.append(unpacker.decompress(data[fed:]))
                    fed = len(data)
            except zlib.error:
                out = []
            if unpacker.eof:
                used = len(data) - len(unpacker.unused_data)
                found = parse(b"".join(out))
        elif data[:5] == b"WARC/":
            while (end := data.find(b"\r\n\r\n")) < 0 and len(data) < WINDOW and more():
                pass
            want = number(headers(data[: max(end, 0)]).get("content-length"))
            want = end + 8 + want if end >= 0 and want is not None else 0
            while len(data) < want and more():
                pass
            found = parse(data[:want]) if want else None
            used = min(want, len(data))
        if found:
            yield base, used, found
            data, base = data[used:], base + used
            continue
        # Not a record: go on at the next place that looks like one (after a whole foreign gzip member, if there is one).
        step = used or 1
        while True:
            places = [p for p in (data.find(b"\x1f\x8b", step), data.find(b"WARC/1.", step)) if p >= 0]
            if places:
                data, base = data[min(places) :], base + min(places)
                break
            keep = data[-8:] if len(data) - 8 >= step else data[step:]
            base, data, step = base + len(data) - len(keep), keep, 0
            if not more():
                return


def index_archives(spark: SparkSession, archives: list[str] | DataFrame) -> DataFrame:
    """The index of existing archives (URIs, or a column ``archive`` of them); one task reads one archive at a time."""
    paths = spark.createDataFrame([(a,) for a in archives], "archive string") if isinstance(archives, list) else archives.select("archive")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for uri in b.column(0).to_pylist():
                store, path = open_store(uri)
                rows: list[tuple] = []
                with store.open_input_file(path) as stream:
                    for at, length, r in scan(stream, stream.size()):
                        rows.append((uri, at, length, r["url"], r["digest"], r["record_type"], r["page_id"], r["refers_to"], r["payload_bytes"]))
                        if len(rows) == 1000:
                            yield _index_batch(rows)
                            rows = []
                if rows:
                    yield _index_batch(rows)

    return paths.repartition("archive").mapInArrow(run, INDEX)


RECORD = "archive string, offset long, record_type string, url string, page_id long, refers_to long, digest string, payload_bytes long, payload_digest string, block_ok boolean"


def read_records(index: DataFrame, payload: bool = False) -> DataFrame:
    """The records of the selected index rows, one for each: their header fields and what the stored bytes say.

    ``digest`` is the header's; ``payload_digest`` is taken from the bytes that were read (for a revisit, which has none, it is
    the header's).  With ``payload`` the bytes come along."""
    spark = index.sparkSession
    small_batches(spark)
    total = index.agg(F.sum("length")).first()[0] or 0
    parts = max(spark.sparkContext.defaultParallelism, -(-total // TASK))
    rows = index.select("archive", "offset", "length").repartitionByRange(parts, "archive", "offset").sortWithinPartitions("archive", "offset")

    def ranges(batches: Iterator[pa.RecordBatch]) -> Iterator[list[tuple[str, int, int]]]:
        """Runs of rows that one read covers."""
        held: list[tuple[str, int, int]] = []
        for b in batches:
            for row in zip(*(c.to_pylist() for c in b.columns), strict=True):
                if held and (row[0] != held[0][0] or row[1] - held[-1][1] - held[-1][2] > GAP or row[1] + row[2] - held[0][1] > WINDOW):
                    yield held
                    held = []
                held.append(row)
        if held:
            yield held

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        opened, stream = None, None
        for held in ranges(batches):
            uri, start = held[0][0], held[0][1]
            if opened != uri:
                if stream is not None:
                    stream.close()
                store, path = open_store(uri)
                opened, stream = uri, store.open_input_file(path)
            data = stream.read_at(max(o + n for _, o, n in held) - start, start)
            out = []
            for _, offset, length in held:
                raw = data[offset - start : offset - start + length]
                try:
                    found = parse(zlib.decompress(raw, 31) if raw[:2] == b"\x1f\x8b" else raw)
                except zlib.error:
                    found = None
                found = found or dict.fromkeys(("url", "page_id", "refers_to", "digest", "payload_bytes", "payload"), None) | {"record_type": "damaged", "block_ok": False}
                body = found["payload"]
                digest = hashlib.sha1(body).hexdigest() if body is not None else found["digest"]
                out.append((uri, offset, found["record_type"], found["url"], found["page_id"], found["refers_to"], found["digest"], found["payload_bytes"], digest, found["block_ok"], *([body] if payload else [])))
            types = [pa.string(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.bool_(), *([pa.binary()] if payload else [])]
            names = [c.strip().split(" ")[0] for c in RECORD.split(",")] + (["payload"] if payload else [])
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), types, strict=True)], names=names)
        if stream is not None:
            stream.close()

    return rows.mapInArrow(run, RECORD + (", payload binary" if payload else ""))


def archive_pages(pages: DataFrame) -> DataFrame:
    """Pages written as archives and read back: (page_id, payload_bytes, payload_digest, record_type, refers_to, url, block_ok)."""
    with Scratch(pages.sparkSession):
        back = read_records(write_archives(pages))
    return back.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "url", "block_ok")


def oracle_sql(least: int = 1000, table: str = "pages") -> str:
    """DuckDB SQL for ``archive_pages(pages)``."""
    return f"""
WITH x AS (SELECT page_id, url, encode(coalesce(html, '')) AS body FROM {table}),
y AS (SELECT page_id, url, octet_length(body)::BIGINT AS payload_bytes, sha1(body) AS payload_digest, max(page_id) OVER (PARTITION BY body) AS last FROM x),
z AS (SELECT *, payload_bytes >= {least} AND last IS NOT NULL AND page_id IS DISTINCT FROM last AS again FROM y)
SELECT page_id, payload_bytes, payload_digest, CASE WHEN again THEN 'revisit' ELSE 'response' END AS record_type, CASE WHEN again THEN last END AS refers_to, url, TRUE AS block_ok FROM z"""
