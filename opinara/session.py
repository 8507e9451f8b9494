"""Session construction and the shared scratch folder.

Operators never create sessions; they take the one they are given.  What must be cut out of the lineage is
written below ``spark.checkpoint.dir``, the only folder that the driver and all executors are sure to share.
"""

from __future__ import annotations

import tempfile
import uuid
from contextvars import ContextVar, Token

from pyspark.sql import DataFrame, SparkSession

CHECKPOINT_DIR = "spark.checkpoint.dir"
ARROW_BYTES = 8 << 20


def build_session(app: str = "opinara", master: str | None = None, **conf: str) -> SparkSession:
    """A session with the settings that the operators assume; ``conf`` overrides them."""
    settings = {
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        "spark.ui.enabled": "false",
    } | {k.replace("__", "."): v for k, v in conf.items()}
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    return builder.config(map=settings).getOrCreate()


def shared_folder(spark: SparkSession) -> str:
    """The cluster's ``spark.checkpoint.dir``; a temporary folder only for single-JVM masters that set none."""
    folder = spark.conf.get(CHECKPOINT_DIR, None) or spark.sparkContext.getConf().get(CHECKPOINT_DIR)
    if folder:
        return folder.rstrip("/")
    master = spark.sparkContext.master
    if master != "local" and not master.startswith("local["):
        raise RuntimeError(f"{CHECKPOINT_DIR} is unset on {master}: name a folder that all executors share")
    folder = "file://" + tempfile.mkdtemp(prefix="opinara-")
    spark.conf.set(CHECKPOINT_DIR, folder)
    return folder


def small_batches(spark: SparkSession, limit: int = ARROW_BYTES) -> None:
    """Lowers the size of Arrow batches to Python workers, so that texts of any length take bounded memory there.

    The setting is the session's and is read when a query runs, so it stays; a lower one of the user's is kept."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    now = spark.conf.get(key, None)
    digits = "".join(c for c in now or "" if c.isdigit())
    if now is None or not digits or not now.rstrip("b").isdigit() or int(digits) > limit or int(digits) <= 0:
        spark.conf.set(key, str(limit))


class Scratch:
    """The stored tables of one piece of work; only their owner deletes them.

    ``with Scratch(spark) as scratch`` also takes what ``cut_lineage`` writes inside the block, in this thread, unless an
    inner block takes it.  Work in other threads, or before and after the block, keeps its tables."""

    def __init__(self, spark: SparkSession):
        self.spark = spark
        self.tables: list[tuple[DataFrame, str]] = []
        self._outer: list[Token] = []

    def __enter__(self) -> Scratch:
        self._outer.append(_scope.set(self))
        return self

    def __exit__(self, *_: object) -> None:
        _scope.reset(self._outer.pop())

    def store(self, df: DataFrame, name: str = "cut") -> DataFrame:
        """``df``, written as Parquet to the shared folder and read back."""
        path = f"{shared_folder(self.spark)}/{name}-{uuid.uuid4().hex}"
        df.write.option("compression", "zstd").parquet(path)
        table = self.spark.read.schema(df.schema).parquet(path)
        self.tables.append((table, path))
        return table

    def drop(self, *tables: DataFrame) -> None:
        """Deletes these tables; DataFrames that still read them are lost."""
        for _, path in (x for x in self.tables if any(x[0] is t for t in tables)):
            target = self.spark._jvm.org.apache.hadoop.fs.Path(path)
            target.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(target, True)
        self.tables = [x for x in self.tables if not any(x[0] is t for t in tables)]

    def clear(self, *keep: DataFrame) -> None:
        """Deletes all tables but these."""
        self.drop(*(t for t, _ in self.tables if not any(t is k for k in keep)))


_scope: ContextVar[Scratch | None] = ContextVar("scratch", default=None)


def cut_lineage(df: DataFrame, name: str = "cut") -> DataFrame:
    """Writes ``df`` as Parquet to the shared folder and returns the table read back.

    Unlike a local checkpoint the copy outlives any executor, and unlike ``checkpoint()`` it is columnar and
    compressed, so that later passes read only the columns they need.  It belongs to the ``Scratch`` whose block this is
    called in, if any.
    """
    return (_scope.get() or Scratch(df.sparkSession)).store(df, name)
