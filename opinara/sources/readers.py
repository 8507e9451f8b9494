"""Scans: columnar, delimited, line-oriented, archived and matrix inputs as DataFrames."""

from __future__ import annotations

import io
import pickle
import re
import tarfile
import zipfile
from collections.abc import Iterator, Sequence
from xml.etree import ElementTree

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: A file that one Python task opens as a whole.
MAX_WHOLE_FILE = 512 << 20


def read_parquet(spark: SparkSession, path: str | Sequence[str], columns: Sequence[str] | None = None, require: Sequence[str] = ()) -> DataFrame | None:
    """Parquet with a projection; None if a required column is missing from the merged schema."""
    df = spark.read.option("mergeSchema", "true").parquet(*([path] if isinstance(path, str) else path))
    if not set(require) <= set(df.columns):
        return None
    return df.select(*columns) if columns else df


def read_years(spark: SparkSession, folder: str, year: int | str) -> DataFrame:
    """All files of a folder whose names begin with a year, with the date of each in ``file_date``."""
    return with_file_date(spark.read.parquet(f"{folder}/{year}-*.parquet"))


def with_file_date(df: DataFrame) -> DataFrame:
    return df.withColumn("file_date", F.regexp_extract(F.input_file_name(), r"(\d{4}-\d{2}-\d{2})[^/]*$", 1).try_cast("date"))


def read_csv(spark: SparkSession, path: str, schema: str, columns: Sequence[str] | None = None) -> DataFrame:
    df = spark.read.csv(path, header=True, schema=schema, mode="PERMISSIVE")
    return df.select(*columns) if columns else df


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    """One row per line, in splits; bytes that aren't UTF-8 become replacement characters."""
    return spark.read.text(path)


def parse_mixed_lines(lines: DataFrame, json_schema: str, tsv_columns: Sequence[str], csv_schema: str | None = None, least_fields: int = 24) -> DataFrame:
    """Lines of three layouts as rows of text columns, malformed lines left out: JSON after a tab; tab-separated with at
    least ``least_fields`` fields; quoted CSV (with ``csv_schema``)."""
    value = F.col("value")
    cells = F.split(value, "\t")
    names = list(tsv_columns)
    is_json = F.trim(F.element_at(cells, -1)).startswith("{")
    parsed = F.from_json(F.element_at(cells, -1), json_schema, {"mode": "PERMISSIVE"})
    as_json = lines.where(is_json).select(parsed.alias("j")).where("j is not null").select(*[F.col(f"j.{c}").cast("string").alias(c) for c in names])
    as_tsv = lines.where(~is_json & (F.size(cells) >= least_fields)).select(*[cells[k].alias(c) for k, c in enumerate(names)])
    out = as_json.unionByName(as_tsv)
    if csv_schema:
        rows = lines.where(~is_json & (F.size(cells) < least_fields) & value.startswith('"')).select(F.from_csv(value, csv_schema).alias("c")).where("c is not null")
        out = out.unionByName(rows.select(*[F.col(f"c.{c}").cast("string").alias(c) for c in names]))
    any_value = F.lit(False)
    for c in names:
        any_value = any_value | F.col(c).isNotNull()
    return out.where(any_value)


def read_id_list(spark: SparkSession, path: str, name: str = "user_id") -> DataFrame:
    """A JSON array of ids as a distinct column."""
    text = spark.read.text(path, wholetext=True)
    return text.select(F.explode(F.from_json("value", "array<string>")).alias("v")).select(F.col("v").try_cast("long").alias(name)).where(F.col(name).isNotNull()).distinct()


RESPONSE = "custom_id string, choices array<struct<message:struct<content:string>>>, response struct<body:struct<choices:array<struct<message:struct<content:string>>>>>"


def read_responses(spark: SparkSession, path: str) -> DataFrame:
    """(custom_id, content) of batch answers in either of two shapes; lines without content are left out."""
    df = spark.read.schema(RESPONSE).json(path)
    content = F.coalesce(F.try_element_at(F.col("choices.message.content"), F.lit(1)), F.try_element_at(F.col("response.body.choices.message.content"), F.lit(1)))
    return df.select("custom_id", content.alias("content")).where("content is not null")


def whole_files(spark: SparkSession, path: str) -> DataFrame:
    """Files with their content, for decoders that need a file as a whole; ValueError names files too large for that."""
    files = spark.read.format("binaryFile").load(path)
    large = [r.path for r in files.where(F.col("length") > MAX_WHOLE_FILE).select("path").limit(20).collect()]
    if large:
        raise ValueError(f"files of more than {MAX_WHOLE_FILE} bytes can't be decoded whole: {', '.join(sorted(large))}")
    return files


def read_stata(spark: SparkSession, path: str, schema: str, columns: Sequence[str] | None = None) -> DataFrame:
    """Stata microdata: files are listed and read by Spark, each decoded by one task."""
    files = whole_files(spark, path)

    def decode(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            for raw in f["content"]:
                yield pd.read_stata(io.BytesIO(raw), columns=list(columns) if columns else None, convert_categoricals=False)

    return files.select("content").mapInPandas(decode, schema)


def read_tar_members(spark: SparkSession, path: str, suffix: str = "") -> DataFrame:
    """(archive, member, content) of tar archives, members by name."""
    files = whole_files(spark, path)

    def members(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            for name, raw in zip(f["path"], f["content"], strict=True):
                with tarfile.open(fileobj=io.BytesIO(raw)) as t:
                    for m in sorted((m for m in t.getmembers() if m.isfile() and m.name.endswith(suffix)), key=lambda m: m.name):
                        yield pd.DataFrame({"archive": [name], "member": [m.name], "content": [t.extractfile(m).read()]})

    return files.select("path", "content").mapInPandas(members, "archive string, member string, content binary")


def read_matrix(spark: SparkSession, path: str, names: Sequence[str]) -> DataFrame:
    """(file, row_id, topic, value) from .npz (compressed sparse rows, else its first array) and .npy files; missing
    entries have no row.  Rows are numbered by file, or on from the ``first`` that a part of a larger matrix tells."""
    files = whole_files(spark, path)

    def decode(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            for name, raw in zip(f["path"], f["content"], strict=True):
                data = np.load(io.BytesIO(raw), allow_pickle=False)
                if isinstance(data, np.ndarray):
                    dense = data
                elif {"data", "indices", "indptr", "shape"} <= set(data.files):
                    rows = np.repeat(np.arange(len(data["indptr"]) - 1), np.diff(data["indptr"]))
                    ok = ~np.isnan(data["data"])
                    yield pd.DataFrame({"file": name, "row_id": rows[ok] + (int(data["first"]) if "first" in data.files else 0), "topic": np.array(names, object)[data["indices"][ok]], "value": data["data"][ok].astype(float)})
                    continue
                else:
                    dense = data[data.files[0]]
                if dense.ndim != 2:
                    raise ValueError(f"{name} holds no matrix")
                r, c = np.nonzero(~np.isnan(dense))
                yield pd.DataFrame({"file": name, "row_id": r, "topic": np.array(names, object)[c], "value": dense[r, c].astype(float)})

    return files.select("path", "content").mapInPandas(decode, "file string, row_id long, topic string, value double")


def schema_names(spark: SparkSession, path: str) -> list[str]:
    """Column names from a file's footer, without reading rows."""
    return spark.read.parquet(path).columns


def read_pickles(spark: SparkSession, path: str, schema: str, columns: Sequence[str] | None = None) -> DataFrame:
    """Pickled pandas frames, one file a task.  Unpickling runs code: for files of one's own only."""
    files = whole_files(spark, path)

    def decode(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            for raw in f["content"]:
                one = pickle.loads(raw)  # noqa: S301
                yield one[list(columns)] if columns else one

    return files.select("content").mapInPandas(decode, schema)


_SHEET = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"


def sheet_rows(raw: bytes, sheet: str) -> list[list[str | None]]:
    """The cells of a workbook's sheet as text."""
    book = zipfile.ZipFile(io.BytesIO(raw))
    names = [s.get("name") for s in ElementTree.fromstring(book.read("xl/workbook.xml")).iter(f"{_SHEET}sheet")]
    if sheet not in names:
        raise ValueError(f"no sheet {sheet!r}: the workbook has {names}")
    shared = [] if "xl/sharedStrings.xml" not in book.namelist() else ["".join(t.text or "" for t in si.iter(f"{_SHEET}t")) for si in ElementTree.fromstring(book.read("xl/sharedStrings.xml")).iter(f"{_SHEET}si")]
    out: list[list[str | None]] = []
    for row in ElementTree.fromstring(book.read(f"xl/worksheets/sheet{names.index(sheet) + 1}.xml")).iter(f"{_SHEET}row"):
        cells: dict[int, str | None] = {}
        for c in row.iter(f"{_SHEET}c"):
            column = 0
            for letter in re.match(r"[A-Z]+", c.get("r", "A")).group():
                column = column * 26 + ord(letter) - 64
            v = c.find(f"{_SHEET}v")
            text = "".join(t.text or "" for t in c.iter(f"{_SHEET}t")) if c.get("t") == "inlineStr" else None if v is None else v.text
            cells[column - 1] = shared[int(text)] if c.get("t") == "s" and text is not None else text
        out.append([cells.get(k) for k in range(max(cells, default=-1) + 1)])
    return out


def read_excel(spark: SparkSession, path: str, sheet: str, names: Sequence[str]) -> DataFrame:
    """A sheet of workbooks as text columns, the header row left out and columns found by their header; one file a task."""
    files = whole_files(spark, path)

    def decode(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            for raw in f["content"]:
                rows = sheet_rows(raw, sheet)
                at = [rows[0].index(n) for n in names] if rows else []
                yield pd.DataFrame([[r[k] if k < len(r) else None for k in at] for r in rows[1:]], columns=list(names), dtype=object)

    return files.select("content").mapInPandas(decode, ", ".join(f"`{n}` string" for n in names))


def read_word_vectors(spark: SparkSession, path: str) -> DataFrame:
    """(word, vector) of a word2vec text file: a line for each word; the line with the numbers of words and dimensions is
    left out.  Read in splits."""
    parts = F.split(F.rtrim(F.col("value")), " ")
    rows = spark.read.text(path).select(F.get(parts, F.lit(0)).alias("word"), F.slice(parts, 2, F.size(parts)).alias("rest")).where(F.size("rest") > 1)
    return rows.select("word", F.transform("rest", lambda v: v.cast("float")).alias("vector"))


def read_word_vectors_binary(spark: SparkSession, path: str) -> DataFrame:
    """(word, vector) of word2vec binary files, one file a task."""
    files = whole_files(spark, path)

    def decode(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            for raw in f["content"]:
                head, _, body = bytes(raw).partition(b"\n")
                n, size = map(int, head.split())
                at, words, vectors = 0, [], []
                for _ in range(n):
                    end = body.index(b" ", at)
                    words.append(body[at:end].decode("utf-8", "replace").lstrip("\n"))
                    vectors.append(np.frombuffer(body, "<f4", size, end + 1))
                    at = end + 1 + 4 * size
                    if len(words) == 4096:
                        yield pd.DataFrame({"word": words, "vector": vectors})
                        words, vectors = [], []
                if words:
                    yield pd.DataFrame({"word": words, "vector": vectors})

    return files.select("content").mapInPandas(decode, "word string, vector array<float>")


def first_without(spark: SparkSession, paths: Sequence[str], column: str) -> str | None:
    """The first path, in the order of names, whose schema lacks a column: how far a job that adds it has come."""
    return next((p for p in sorted(paths) if column not in schema_names(spark, p)), None)


def read_last_metrics(lines: DataFrame, key: str = "file") -> DataFrame:
    """(file, name, value) of the last ``name: number`` line of each name in log lines (file, line_no, value)."""
    name, number = F.regexp_extract("value", r"^\s*([A-Za-z_]+):\s*(-?[0-9.eE+\-]+|nan)\s*$", 1), F.regexp_extract("value", r"^\s*([A-Za-z_]+):\s*(-?[0-9.eE+\-]+|nan)\s*$", 2)
    found = lines.select(key, "line_no", name.alias("name"), number.try_cast("double").alias("number")).where("name <> ''")
    return found.groupBy(key, "name").agg(F.max_by("number", "line_no").alias("value"))


def exists(spark: SparkSession, path: str) -> bool:
    """Whether a path (or pattern) exists, asked of the file system that it names."""
    jvm = spark._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    found = p.getFileSystem(spark._jsc.hadoopConfiguration()).globStatus(p)
    return found is not None and len(found) > 0


def read_if_exists(spark: SparkSession, path: str) -> DataFrame | None:
    return spark.read.parquet(path) if exists(spark, path) else None
