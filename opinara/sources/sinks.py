"""Writers: partitioned tables, request batches, size-bounded files, reports."""

from __future__ import annotations

import io
import zipfile
from collections.abc import Sequence
from datetime import date
from xml.sax.saxutils import escape

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from opinara.operators.ranks import numbered
from opinara.session import cut_lineage
from opinara.sources.readers import exists

#: Requests in one batch file.
BATCH_LIMIT = 49_999
#: Rows in one file of a year.
FILE_ROWS = 840_000


def write_partitioned(df: DataFrame, path: str, by: Sequence[str], overwrite: bool = False) -> None:
    """One folder per key.  Without ``overwrite`` an existing target is refused."""
    df.write.mode("overwrite" if overwrite else "errorifexists").partitionBy(*by).parquet(path)


def write_once(df: DataFrame, path: str, force: bool = False) -> bool:
    """Writes unless the target exists; tells whether it wrote."""
    if not force and exists(df.sparkSession, path):
        return False
    df.write.mode("overwrite").parquet(path)
    return True


def write_bounded(df: DataFrame, path: str, year: str = "year", rows: int = FILE_ROWS) -> None:
    """Files of at most ``rows`` rows, none across years; an existing target is refused.

    A year's rows go to as many tasks as it has full files, so that no task writes a whole large year."""
    sizes = df.groupBy(F.col(year).alias("_y")).agg(F.ceil(F.count(F.lit(1)) / rows).cast("int").alias("_parts"))
    salted = df.join(F.broadcast(sizes), F.col(year).eqNullSafe(F.col("_y")), "left")  # one row a year
    dealt = salted.withColumn("_part", F.pmod(F.xxhash64(*df.columns), F.coalesce("_parts", F.lit(1)))).repartition(year, "_part").drop("_y", "_parts", "_part")
    dealt.sortWithinPartitions(year).write.option("maxRecordsPerFile", rows).mode("errorifexists").partitionBy(year).parquet(path)


def write_csv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("header", "true").csv(path)


def write_json(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path)


def request_batches(posts: DataFrame, system: str, model: str, limit: int = BATCH_LIMIT) -> DataFrame:
    """(batch, custom_id, value): one JSON request per distinct post_id, in batches of at most ``limit``.

    Batch numbers come from hashes, so no global numbering is needed; with a margin for uneven hashing each batch stays
    below the limit, which is checked."""
    distinct = posts.dropDuplicates(["post_id"])
    n = distinct.count()
    room = max(1.0, limit - 5 * limit**0.5)  # five standard deviations of a batch's size
    batches = max(1, int(-(-n // room))) if n > limit else 1
    body = F.to_json(F.struct(F.col("post_id").cast("string").alias("custom_id"), F.lit("POST").alias("method"), F.struct(F.lit(model).alias("model"), F.array(F.struct(F.lit("system").alias("role"), F.lit(system).alias("content")), F.struct(F.lit("user").alias("role"), F.col("text").alias("content"))).alias("messages")).alias("body")))
    out = distinct.select(F.pmod(F.xxhash64("post_id"), F.lit(batches)).cast("int").alias("batch"), F.col("post_id").cast("string").alias("custom_id"), body.alias("value"))
    over = out.groupBy("batch").count().where(F.col("count") > limit).limit(1).collect()
    if over:
        raise ValueError(f"batch of {over[0]['count']} requests; the limit is {limit}")
    return out


def dated(path: str, day: date) -> str:
    """``folder/name`` as ``folder/YYYYMMDD_name``."""
    folder, _, name = path.rpartition("/")
    return f"{folder}{'/' if folder else ''}{day:%Y%m%d}_{name}"


def update_predictions(rows: DataFrame, predictions: DataFrame, column: str, key: str = "post_id") -> DataFrame:
    """``rows`` with a column set from predictions; rows without one keep what they had."""
    new = predictions.select(key, F.col(column).alias("_new"))
    old = F.col(column) if column in rows.columns else F.lit(None)
    return rows.join(new, key, "left").withColumn(column, F.coalesce("_new", old)).drop("_new")


#: Rows that a file of one piece (Excel, Stata, word vectors) may have: it is made on the driver.
ONE_FILE_ROWS = 1_000_000
#: Rows of one file of a matrix.
MATRIX_ROWS = 100_000


def write_bytes(spark: SparkSession, path: str, data: bytes, overwrite: bool = True) -> None:
    """A file of given bytes, through the file system that its path names."""
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    out = target.getFileSystem(spark._jsc.hadoopConfiguration()).create(target, overwrite)
    try:
        for k in range(0, len(data), 1 << 20):
            out.write(bytearray(data[k : k + (1 << 20)]))
    finally:
        out.close()


def one_file(df: DataFrame) -> pd.DataFrame:
    """``df`` on the driver; ValueError if it has more than ``ONE_FILE_ROWS`` rows."""
    if df.limit(ONE_FILE_ROWS + 1).count() > ONE_FILE_ROWS:
        raise ValueError(f"more than {ONE_FILE_ROWS} rows can't go into one file: write Parquet")
    return df.toPandas()


def write_stata(df: DataFrame, path: str) -> None:
    raw = io.BytesIO()
    one_file(df).to_stata(raw, write_index=False, version=118)
    write_bytes(df.sparkSession, path, raw.getvalue())


def write_pickle(df: DataFrame, path: str) -> None:
    raw = io.BytesIO()
    one_file(df).to_pickle(raw)
    write_bytes(df.sparkSession, path, raw.getvalue())


def write_excel(sheets: dict[str, DataFrame], path: str) -> None:
    """A workbook of one sheet for each table, cells as inline text or numbers."""
    spark = next(iter(sheets.values())).sparkSession
    head = '<?xml version="1.0" encoding="UTF-8" standalone="yes"?>'
    main, rel = "http://schemas.openxmlformats.org/spreadsheetml/2006/main", "http://schemas.openxmlformats.org/officeDocument/2006/relationships"
    kinds = "http://schemas.openxmlformats.org/package/2006"

    def letter(k: int) -> str:
        return (letter(k // 26 - 1) if k >= 26 else "") + chr(65 + k % 26)

    def cell(r: int, k: int, v) -> str:
        if v is None or v != v:
            return ""
        if isinstance(v, int | float | np.integer | np.floating) and not isinstance(v, bool):
            return f'<c r="{letter(k)}{r}"><v>{v}</v></c>'
        return f'<c r="{letter(k)}{r}" t="inlineStr"><is><t xml:space="preserve">{escape(str(v))}</t></is></c>'

    raw = io.BytesIO()
    with zipfile.ZipFile(raw, "w", zipfile.ZIP_DEFLATED) as z:
        numbers = range(1, len(sheets) + 1)
        z.writestr("[Content_Types].xml", head + f'<Types xmlns="{kinds}/content-types"><Default Extension="rels" ContentType="application/vnd.openxmlformats-package.relationships+xml"/><Override PartName="/xl/workbook.xml" ContentType="application/vnd.openxmlformats-officedocument.spreadsheetml.sheet.main+xml"/>' + "".join(f'<Override PartName="/xl/worksheets/sheet{k}.xml" ContentType="application/vnd.openxmlformats-officedocument.spreadsheetml.worksheet+xml"/>' for k in numbers) + "</Types>")
        z.writestr("_rels/.rels", head + f'<Relationships xmlns="{kinds}/relationships"><Relationship Id="r1" Type="{rel}/officeDocument" Target="xl/workbook.xml"/></Relationships>')
        z.writestr("xl/_rels/workbook.xml.rels", head + f'<Relationships xmlns="{kinds}/relationships">' + "".join(f'<Relationship Id="r{k}" Type="{rel}/worksheet" Target="worksheets/sheet{k}.xml"/>' for k in numbers) + "</Relationships>")
        z.writestr("xl/workbook.xml", head + f'<workbook xmlns="{main}" xmlns:r="{rel}"><sheets>' + "".join(f'<sheet name="{escape(n)}" sheetId="{k}" r:id="r{k}"/>' for k, n in zip(numbers, sheets, strict=True)) + "</sheets></workbook>")
        for k, df in zip(numbers, sheets.values(), strict=True):
            frame = one_file(df)
            rows = [list(frame.columns), *frame.itertuples(index=False, name=None)]
            z.writestr(f"xl/worksheets/sheet{k}.xml", head + f'<worksheet xmlns="{main}"><sheetData>' + "".join(f'<row r="{r}">' + "".join(cell(r, c, v) for c, v in enumerate(values)) + "</row>" for r, values in enumerate(rows, 1)) + "</sheetData></worksheet>")
    write_bytes(spark, path, raw.getvalue())


def sparse_rows(row: np.ndarray, column: np.ndarray, value: np.ndarray, ids: np.ndarray, width: int, first: int) -> bytes:
    """An .npz file of compressed sparse rows, sorted by row from 0; ``first`` is the whole matrix's number of its first row."""
    raw = io.BytesIO()
    ends = np.searchsorted(row, np.arange(len(ids) + 1)).astype(np.int64)
    np.savez_compressed(raw, data=value, indices=column.astype(np.int32), indptr=ends, shape=np.array([len(ids), width]), ids=ids, first=np.int64(first))
    return raw.getvalue()


def write_matrix(values: DataFrame, path: str, topics: Sequence[str], key: str = "user_id", rows: int | None = None) -> None:
    """A period's opinions (key, topic, value) as compressed sparse rows in .npz files, rows by key, columns by topic.

    Up to ``rows`` (``MATRIX_ROWS``) keys make one file ``path``; more make a folder of that name with files of as many rows, each
    written by a task, which tell the number of their first row.  A task that runs again writes the same file."""
    limit = rows or MATRIX_ROWS
    known = values.where(F.col("value").isNotNull() & F.col(key).isNotNull() & F.col("topic").isin(list(topics)))
    at = F.element_at(F.create_map(*[c for k, t in enumerate(topics) for c in (F.lit(t), F.lit(k))]), F.col("topic"))
    entries = known.groupBy(F.col(key).alias("id")).agg(F.array_sort(F.collect_list(F.struct(at.alias("c"), F.col("value").cast("double").alias("v")))).alias("e"))
    entries = cut_lineage(entries, "entries")
    placed = numbered(entries, [], [F.col("id")]).select(F.floor((F.col("_n") - 1) / limit).alias("part"), (F.col("_n") - 1).alias("row"), "id", "_size", "e")
    width = len(topics)

    def packed(t: pa.Table) -> bytes:
        t = t.sort_by("row").combine_chunks()
        lists = t["e"].chunk(0) if t.num_rows else pa.array([], t.schema.field("e").type)
        flat = lists.flatten()
        of = np.repeat(np.arange(t.num_rows), pc.list_value_length(lists).to_numpy(zero_copy_only=False))
        return sparse_rows(of, flat.field("c").to_numpy(zero_copy_only=False), flat.field("v").to_numpy(zero_copy_only=False), t["id"].to_numpy(), width, t["row"][0].as_py() if t.num_rows else 0)

    n = entries.count()
    if n <= limit:
        return write_bytes(values.sparkSession, path, packed(placed.toArrow()))

    def write(key: tuple, t: pa.Table) -> pa.Table:
        store, folder = pa.fs.FileSystem.from_uri(path if "://" in path or not path.startswith("file:") else "file://" + path[5:])
        store.create_dir(folder, recursive=True)
        with store.open_output_stream(f"{folder}/part-{key[0].as_py():06d}.npz", compression=None) as out:
            out.write(packed(t))
        return pa.table({"rows": pa.array([t.num_rows], pa.int64())})

    written = placed.groupBy("part").applyInArrow(write, "rows long").agg(F.sum("rows")).first()[0]
    if written != n:
        raise ValueError(f"{written} of {n} rows were written to {path}")


def write_word_vectors(vectors: DataFrame, path: str, binary: bool = False) -> None:
    """A word2vec file of (word, vector), words in order."""
    rows = one_file(vectors.orderBy("word"))
    x = np.array(rows["vector"].tolist(), "<f4")
    head = f"{x.shape[0]} {x.shape[1] if len(x) else 0}\n".encode()
    if binary:
        body = b"".join(str(w).encode() + b" " + v.tobytes() for w, v in zip(rows["word"], x, strict=True))
    else:
        body = "".join(f"{w} " + " ".join(repr(float(a)) for a in v) + "\n" for w, v in zip(rows["word"], x, strict=True)).encode()
    write_bytes(vectors.sparkSession, path, head + body)


def write_days(df: DataFrame, path: str, day: str, key: str, order: str) -> None:
    """One folder a day, each key once (its first row in ``order``); days that come again replace what was there, others
    stay."""
    first = df.groupBy(day, key).agg(F.min(F.struct(order, *[c for c in df.columns if c not in (day, key, order)])).alias("_r")).select(day, key, "_r.*")
    first.repartition(day).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(day).parquet(path)


def append_csv(df: DataFrame, path: str) -> None:
    """Rows added to a CSV table."""
    df.write.mode("append").option("header", "true").csv(path)


def slim_predictions(rows: DataFrame, columns: Sequence[str], key: str = "post_id") -> DataFrame:
    """The key and the prediction columns of rows that have any prediction."""
    any_ = F.lit(False)
    for c in columns:
        any_ = any_ | F.col(c).isNotNull()
    return rows.where(any_).select(key, *columns)
