"""Subspaces that the word vectors of topics span, from one d x d sum of products for each topic.

Everything asked of a topic's cloud of unit vectors X (its singular values, its distance from another span) depends on X'X alone,
which tasks sum over their own words.  So clouds of any size are handled whole; what is gathered is topics x d x d."""

from __future__ import annotations

from collections.abc import Iterator
from math import comb

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from opinara.functions.arrays import list_matrix
from opinara.operators.subsets import unrank

#: Bytes of all topics' sums that the driver and each task may hold.
MAX_BYTES = 512 << 20
#: Share of the largest singular value under which one counts as zero: what sums of products can tell apart in doubles.
TOLERANCE = 1e-7


def gram_sums(rows: DataFrame) -> DataFrame:
    """(topic, words, gram, centroid): of each topic's unit word vectors the d x d sum of products (row by row), and the weighted
    mean of its raw vectors.  ``rows`` is (topic, word, vector, weight); null and zero vectors are left out."""
    kind = dict(rows.dtypes)["topic"]
    known = rows.where("vector is not null and topic is not null").select("topic", F.col("vector").cast("array<double>").alias("vector"), F.coalesce(F.col("weight").cast("double"), F.lit(0.0)).alias("weight"))
    known = known.where(F.exists("vector", lambda v: v != 0) & ~F.exists("vector", lambda v: v.isNull() | F.isnan(v)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict = {}
        for b in batches:
            topics = np.array(b.column(0).to_pylist(), object)
            x, w = list_matrix(b.column(1)), b.column(2).to_numpy()
            for t in set(topics.tolist()):
                own = topics == t
                unit = x[own] / np.linalg.norm(x[own], axis=1, keepdims=True)
                part = [own.sum(), unit.T @ unit, w[own] @ x[own], w[own].sum()]
                held[t] = [p + q for p, q in zip(held[t], part, strict=True)] if t in held else part
        if held:
            n, g, c, w = zip(*held.values(), strict=True)
            yield pa.RecordBatch.from_arrays([pa.array(list(held), b.schema.field(0).type), pa.array([int(v) for v in n]), pa.array([v.ravel().tolist() for v in g], pa.list_(pa.float64())), pa.array([v.tolist() for v in c], pa.list_(pa.float64())), pa.array([float(v) for v in w])], names=["topic", "n", "g", "c", "w"])

    parts = known.mapInArrow(run, f"topic {kind}, n long, g array<double>, c array<double>, w double")
    total = lambda name: parts.select("topic", F.posexplode(name).alias("pos", "v")).groupBy("topic", "pos").agg(F.sum("v").alias("v")).groupBy("topic").agg(F.array_sort(F.collect_list(F.struct("pos", "v"))).alias("x")).select("topic", F.col("x.v").alias(name))
    sizes = parts.groupBy("topic").agg(F.sum("n").alias("words"), F.sum("w").alias("w"))
    out = sizes.join(total("g"), "topic").join(total("c"), "topic")
    return out.select("topic", "words", F.col("g").alias("gram"), F.transform("c", lambda v: F.try_divide(v, F.col("w"))).alias("centroid"))


class Spans:
    """The sums of all topics, in the topics' order."""

    def __init__(self, sums: DataFrame):
        size = sums.agg(F.sum(F.size("gram").cast("long") * 8)).first()[0] or 0
        if size > MAX_BYTES:
            raise ValueError(f"the topics' sums take {size} bytes, over {MAX_BYTES}")
        rows = sums.orderBy("topic").collect()
        self.topics = [r.topic for r in rows]
        self.words = [r.words for r in rows]
        d = int(round(len(rows[0].gram) ** 0.5)) if rows else 0
        self.gram = np.array([r.gram for r in rows], float).reshape(len(rows), d, d)
        self.centroid = np.array([r.centroid for r in rows], float).reshape(len(rows), d)

    def basis(self, members: np.ndarray) -> np.ndarray:
        """An orthonormal basis of what the words of these topics span, as columns."""
        values, vectors = np.linalg.eigh(self.gram[members].sum(0))
        return vectors[:, values > max(values[-1], 0.0) * TOLERANCE**2 + 1e-14 * max(values[-1], 0.0)]

    def residuals(self, target: int, members: np.ndarray) -> tuple[float, float, int]:
        """Share of the target's centroid and of its cloud outside the span of other topics, and the span's rank."""
        q = self.basis(members)
        c, g = self.centroid[target], self.gram[target]
        length = np.linalg.norm(c)
        outside = c - q @ (q.T @ c)
        cloud = max(0.0, 1 - np.trace(q.T @ g @ q) / np.trace(g))
        return float(np.linalg.norm(outside) / length) if length > 0 else float("nan"), float(cloud**0.5), q.shape[1]


def singular_values(sums: DataFrame, top: int = 10) -> DataFrame:
    """One row of the stacked unit vectors of all topics: words, dimensions, rank, effective rank (participation ratio of the squared
    singular values), condition and the ``top`` largest singular values."""
    s = Spans(sums)
    values = np.clip(np.linalg.eigvalsh(s.gram.sum(0))[::-1], 0, None) if s.topics else np.zeros(0)
    sigma = np.sqrt(values)
    kept = sigma[sigma > (sigma[0] if len(sigma) else 0) * TOLERANCE]
    pr = float(values.sum() ** 2 / (values**2).sum()) if len(kept) else None
    row = (sum(s.words), len(values), len(kept), pr, float(kept[0] / kept[-1]) if len(kept) else None, sigma[:top].tolist())
    return sums.sparkSession.createDataFrame([row], "words long, dimensions int, rank int, effective_rank double, condition double, singular_values array<double>")


def expressibility(sums: DataFrame, sizes: list[int] | None = None) -> DataFrame:
    """(topic, size, measure, residual, rank, others): for each topic and number of other topics, the choice of them whose words' span
    leaves least of the topic's centroid, and of its cloud of words.

    All choices are tried; executors unrank them from their numbers.  Ties go to the first choice in lexicographic order."""
    spark, s = sums.sparkSession, Spans(sums)
    n = len(s.topics)
    kind = dict(sums.dtypes)["topic"]
    schema = f"topic {kind}, size int, measure string, residual double, rank int, others array<{kind}>"
    jobs = [(t, k, lo, min(lo + 64, comb(n - 1, k))) for t in range(n) for k in (sizes or range(1, n)) if k < n for lo in range(0, comb(n - 1, k), 64)]
    if not jobs:
        return spark.createDataFrame([], schema)
    shared = spark.sparkContext.broadcast(s)
    tasks = spark.createDataFrame(jobs, "t int, k int, lo long, hi long").repartition(min(len(jobs), 4 * spark.sparkContext.defaultParallelism))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shared.value
        for b in batches:
            for t, k, lo, hi in zip(*(c.to_pylist() for c in b.columns), strict=True):
                others = np.array([i for i in range(len(own.topics)) if i != t])
                found = [(*own.residuals(t, others[m]), m) for m in unrank(np.arange(lo, hi), len(others), k)]
                out = []
                for at, measure in ((0, "centroid"), (1, "cloud")):
                    j = min(range(len(found)), key=lambda i: (round(found[i][at], 12), i))
                    out.append((own.topics[t], k, measure, found[j][at], found[j][2], [own.topics[i] for i in others[found[j][3]]], lo + j))
                names = ["topic", "size", "measure", "residual", "rank", "others", "number"]
                topic = pa.array([own.topics[0]]).type
                types = [topic, pa.int32(), pa.string(), pa.float64(), pa.int32(), pa.list_(topic), pa.int64()]
                yield pa.RecordBatch.from_arrays([pa.array(c, y) for c, y in zip(zip(*out, strict=True), types, strict=True)], names=names).cast(target)

    target = pa.schema([("topic", _arrow(kind)), ("size", pa.int32()), ("measure", pa.string()), ("residual", pa.float64()), ("rank", pa.int32()), ("others", pa.list_(_arrow(kind))), ("number", pa.int64())])
    found = tasks.mapInArrow(run, schema + ", number long")
    best = found.groupBy("topic", "size", "measure").agg(F.min_by(F.struct("residual", "rank", "others"), F.struct(F.round("residual", 12), "number")).alias("x"))
    return best.select("topic", "size", "measure", "x.*")


def _arrow(kind: str) -> pa.DataType:
    return {"int": pa.int32(), "bigint": pa.int64(), "string": pa.string()}[kind]
