"""A store of results: kept by a fingerprint of inputs and parameters, published whole or not at all, reused only when they match."""

from __future__ import annotations

import hashlib
import json
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from opinara.session import shared_folder

VERSION = 1


def fingerprint(spark: SparkSession, inputs: list[str], parameters: dict) -> str:
    """A hash of the parameters and of the name, length and time of change of every file of the inputs."""
    seen = []
    for path in sorted(inputs):
        target = spark._jvm.org.apache.hadoop.fs.Path(path)
        fs = target.getFileSystem(spark._jsc.hadoopConfiguration())
        if not fs.exists(target):
            raise FileNotFoundError(path)
        if fs.getFileStatus(target).isFile():
            f = fs.getFileStatus(target)
            seen.append((path, f.getLen(), f.getModificationTime()))
        else:
            files = fs.listFiles(target, True)
            while files.hasNext():
                f = files.next()
                seen.append((f.getPath().toString(), f.getLen(), f.getModificationTime()))
    return hashlib.sha256(json.dumps([VERSION, sorted(seen), parameters], sort_keys=True, default=str).encode()).hexdigest()


class ResultStore:
    """Results below one folder of a store that all executors share; a result is a folder with its table and its manifest.

    A result is written under a name of its own, its manifest last, and then renamed to its fingerprint: readers see all of it or
    nothing, and of two writers at once one is kept.  A result whose manifest is missing, does not match what is asked or
    states other columns or another number of rows than the table has is made again."""

    def __init__(self, spark: SparkSession, folder: str | None = None):
        self.spark = spark
        self.folder = (folder or f"{shared_folder(spark)}/results").rstrip("/")
        #: What happened: (name, "hit" or "miss").
        self.log: list[tuple[str, str]] = []

    def _path(self, *parts: str):
        return self.spark._jvm.org.apache.hadoop.fs.Path("/".join((self.folder, *parts)))

    def _fs(self):
        return self._path().getFileSystem(self.spark._jsc.hadoopConfiguration())

    def manifest(self, name: str, mark: str) -> dict | None:
        fs, path = self._fs(), self._path(name, mark, "manifest.json")
        if not fs.exists(path):
            return None
        text = "\n".join(r.value for r in self.spark.read.text(path.toString()).collect())
        try:
            found = json.loads(text)
        except ValueError:
            return None
        return found if isinstance(found, dict) else None

    def get(self, name: str, inputs: list[str], parameters: dict) -> DataFrame | None:
        """The kept result, or None."""
        mark = fingerprint(self.spark, inputs, parameters)
        known = self.manifest(name, mark)
        if known is None or known.get("fingerprint") != mark or known.get("parameters") != json.loads(json.dumps(parameters, default=str)):
            return None
        if not self._fs().exists(self._path(name, mark, "table")):
            return None
        table = self.spark.read.parquet(self._path(name, mark, "table").toString())
        return table if table.schema.json() == known.get("schema") and table.count() == known.get("rows") else None

    def put(self, name: str, inputs: list[str], parameters: dict, result: DataFrame) -> DataFrame:
        """Writes and publishes a result; returns it as kept."""
        mark = fingerprint(self.spark, inputs, parameters)
        fs, draft = self._fs(), f".{uuid.uuid4().hex}"
        table = self._path(name, draft, "table").toString()
        result.write.parquet(table)
        kept = self.spark.read.parquet(table)
        manifest = {"name": name, "fingerprint": mark, "parameters": json.loads(json.dumps(parameters, default=str)), "schema": kept.schema.json(), "rows": kept.count(), "inputs": sorted(inputs)}
        out = fs.create(self._path(name, draft, "manifest.json"), True)
        try:
            out.write(bytearray(json.dumps(manifest, indent=1).encode()))
        finally:
            out.close()
        final = self._path(name, mark)
        if fs.exists(final) and self.get(name, inputs, parameters) is None:
            fs.delete(final, True)  # one that nobody can use
        if fs.exists(final) or not fs.rename(self._path(name, draft), final):
            fs.delete(self._path(name, draft), True)  # another writer was first
        return self.spark.read.parquet(self._path(name, mark, "table").toString())

    def get_or_make(self, name: str, inputs: list[str], parameters: dict, make: Callable[[], DataFrame]) -> DataFrame:
        found = self.get(name, inputs, parameters)
        self.log.append((name, "miss" if found is None else "hit"))
        return self.put(name, inputs, parameters, make()) if found is None else found

    def entries(self) -> DataFrame:
        """(name, fingerprint, rows, parameters) of all published results, by their manifests."""
        fs, rows = self._fs(), []
        if fs.exists(self._path()):
            for d in fs.listStatus(self._path()):
                for r in fs.listStatus(d.getPath()):
                    name, mark = d.getPath().getName(), r.getPath().getName()
                    if not mark.startswith(".") and (m := self.manifest(name, mark)) is not None:
                        rows.append((name, mark, m["rows"], json.dumps(m["parameters"], sort_keys=True)))
        return self.spark.createDataFrame(rows, "name string, fingerprint string, rows long, parameters string")
