"""Hard-negative mining by bit-sliced integer products.

A component of b bits is b bit-planes.  Products with an anchor are summed plane by plane, the most significant first; what
the planes still to come can add lies between the sums of the anchor's negative and of its positive components, times the
value of all remaining bits.  So every plane halves the interval of a score, and a candidate whose interval can no longer
qualify is dropped: for a positive, when it ends below the score of the last place of the anchor's list; for a negative,
when it meets none of the anchor's score bands above the last places of their lists.  While most pairs are alive the planes
are matrix products; afterwards only the pairs that are left are gathered.  Scores of the pairs that survive all planes are
exact integers.

The anchors are the stated query set.  They are broadcast in blocks of at most about ``BLOCK`` vectors, each block passes once
over all rows for the positives and once for the negatives, and a task keeps the best few of each list: no pairs leave it.
Lists of many tasks are cut in two steps, so that no task merges an unbounded list.

Edge cases: a null label, a null vector, a null or non-finite component leave out the row, as anchor too; a row with a null id
is no anchor and comes after all others of its score; missing components of shorter vectors count as zeros; identical rows
count each time, and of the copies of an anchor's own row only one is the anchor itself; anchors that are identical get
their rows each; an anchor without positives or a band without negatives gives no rows; columns of other names are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from math import ceil

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from opinara.llm.vectors import integer_vectors, matrix
from opinara.session import Scratch

#: Anchors of a broadcast block (about; they are dealt out by hash), and of one matrix product with ``ROWS`` rows.
BLOCK, ANCHORS, ROWS = 50_000, 256, 2048
#: Tasks from which on the best of each list are taken in two steps, and the parts of the first step.
MANY_TASKS, PARTS = 64, 32
LEAST, MOST = np.iinfo(np.int64).min, np.iinfo(np.int64).max


def planes(x: np.ndarray) -> list[tuple[int, np.ndarray]]:
    """(weight, 0/1 matrix) of the bit-planes of integers in two's complement, the sign first."""
    bits = max(int(abs(int(x.min(initial=0))) - 1).bit_length() if x.min(initial=0) < 0 else 0, int(x.max(initial=0)).bit_length())
    return [((-1 if j == bits else 1) << j, ((x >> j) & 1).astype(np.float64)) for j in range(bits, -1, -1)]


def qualified(anchors: np.ndarray, rows: np.ndarray, alive: np.ndarray, floors: np.ndarray, tops: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(anchor, row, score) of the pairs of ``alive`` whose score lies in one of the anchor's ranges [floor, top].

    ``floors`` and ``tops`` have a column for each range; a floor above all scores closes a range."""
    real = anchors.astype(np.float64)
    up, down = np.maximum(anchors, 0).sum(1), np.minimum(anchors, 0).sum(1)
    sums = np.zeros(alive.shape, np.int64)
    left = planes(rows)
    while left and np.count_nonzero(alive) * 8 > alive.size:
        weight, plane = left.pop(0)
        # A sum of plane products is below 2**53, so the floating-point product is exact.
        sums += weight * (real @ plane.T).astype(np.int64)
        rest = abs(weight) - 1
        low, high = sums + (down * rest)[:, None], sums + (up * rest)[:, None]
        inside = np.zeros(alive.shape, bool)
        for k in range(floors.shape[1]):
            inside |= (high >= floors[:, k, None]) & (low <= tops[:, k, None])
        alive = alive & inside
    a, r = np.nonzero(alive)
    score = sums[a, r]
    step = max(1, (1 << 22) // max(1, anchors.shape[1]))
    for weight, plane in left:
        if not len(a):
            break
        for lo in range(0, len(a), step):
            score[lo : lo + step] += weight * np.einsum("ij,ij->i", real[a[lo : lo + step]], plane[r[lo : lo + step]]).astype(np.int64)
        rest = abs(weight) - 1
        low, high = score + down[a] * rest, score + up[a] * rest
        keep = ((high[:, None] >= floors[a]) & (low[:, None] <= tops[a])).any(1)
        a, r, score = a[keep], r[keep], score[keep]
    return a, r, score


@dataclass
class Best:
    """The first ``n`` of each list by falling score, then rising id."""

    lists: int
    n: int

    def __post_init__(self) -> None:
        self.score = np.full((self.lists, self.n), LEAST, np.int64)
        self.id = np.full((self.lists, self.n), MOST, np.int64)
        self.mark = np.zeros((self.lists, self.n), np.int8)

    def add(self, at: np.ndarray, score: np.ndarray, ids: np.ndarray, mark: np.ndarray) -> None:
        """Takes in candidates of the lists ``at``; ``mark`` travels with them."""
        last, last_id = self.score[at, -1], self.id[at, -1]
        new = (score > last) | ((score == last) & (ids < last_id))
        at, score, ids, mark = at[new], score[new], ids[new], mark[new]
        if not len(at):
            return
        held = np.unique(at)
        every = np.concatenate([np.repeat(held, self.n), at])
        score, ids, mark = (np.concatenate([old[held].ravel(), x]) for old, x in ((self.score, score), (self.id, ids), (self.mark, mark)))
        order = np.lexsort((ids, -np.maximum(score, -MOST), every))
        every, score, ids, mark = every[order], score[order], ids[order], mark[order]
        first = np.flatnonzero(np.diff(every, prepend=-1))
        place = np.arange(len(every)) - np.repeat(first, np.diff([*first, len(every)]))
        keep = place < self.n
        self.score[every[keep], place[keep]] = score[keep]
        self.id[every[keep], place[keep]] = ids[keep]
        self.mark[every[keep], place[keep]] = mark[keep]


class Block:
    """Anchors of one block: number, label, id and vector, and the positives' scores once they are known."""

    def __init__(self, table: pa.Table):
        t = table.combine_chunks()
        self.key = t["a"].to_numpy()
        self.id = t["id"].to_numpy()
        self.label = t["label"].to_numpy()
        self.v = matrix(t["v"].chunk(0) if t.num_rows else pa.array([], pa.list_(pa.int32())))

    def parts(self, width: int) -> Iterator[tuple[slice, np.ndarray]]:
        """Slices of the anchors with their vectors, of the rows' width."""
        for lo in range(0, len(self.key), ANCHORS):
            part = slice(lo, lo + ANCHORS)
            yield part, np.pad(self.v[part], ((0, 0), (0, max(0, width - self.v.shape[1]))))


def _rows(batches: Iterator[pa.RecordBatch], width: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    for b in batches:
        for lo in range(0, b.num_rows, ROWS):
            part = b.slice(lo, ROWS)
            yield part.column(0).fill_null(MOST).to_numpy(), part.column(1).to_numpy(), matrix(part.column(2), width)


def _found(best: Best, key: np.ndarray, lists: int) -> pa.RecordBatch:
    at, place = np.nonzero(best.score > LEAST)
    ids = best.id[at, place]
    columns = [pa.array(key[at // lists]), pa.array((at % lists + 1).astype(np.int32)), pa.array(ids, mask=ids == MOST), pa.array(best.score[at, place]), pa.array(best.mark[at, place] > 0)]
    return pa.RecordBatch.from_arrays(columns, names=["a", "list", "id", "score", "own"])


_FOUND = "a long, list int, id long, score long, own boolean"


def local_positives(rows: DataFrame, block, n: int) -> DataFrame:
    """Of each task, the n + 1 best rows of each anchor's label; ``own`` marks those that equal the anchor."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = block.value
        best = Best(len(own.key), n + 1)
        for ids, label, x in _rows(batches, own.v.shape[1]):
            for part, v in own.parts(x.shape[1]):
                alive = own.label[part, None] == label
                a, r, score = qualified(v, x, alive, best.score[part, -1:], np.full((len(v), 1), MOST))
                same = (own.id[part][a] == ids[r]) & (v[a] == x[r]).all(1)
                best.add(a + part.start, score, ids[r], same.astype(np.int8))
        yield _found(best, own.key, 1)

    return rows.select("id", "label", "v").mapInArrow(run, _FOUND)


def local_negatives(rows: DataFrame, block, bands, n: int) -> DataFrame:
    """Of each task, the n best rows of other labels in each band of each anchor."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, (floors, tops) = block.value, bands.value
        lists = floors.shape[1]
        best = Best(len(own.key) * lists, n)
        for ids, label, x in _rows(batches, own.v.shape[1]):
            for part, v in own.parts(x.shape[1]):
                last = best.score[:, -1].reshape(-1, lists)[part]
                alive = own.label[part, None] != label
                least = np.maximum(floors[part], last)
                a, r, score = qualified(v, x, alive, least, tops[part])
                for k in range(lists):
                    ok = (score >= least[a, k]) & (score <= tops[part][a, k])
                    best.add((a[ok] + part.start) * lists + k, score[ok], ids[r[ok]], np.zeros(int(ok.sum()), np.int8))
        yield _found(best, own.key, lists)

    return rows.select("id", "label", "v").mapInArrow(run, _FOUND)


def _first(found: DataFrame, n: int, tasks: int) -> DataFrame:
    """The n first of each list of all tasks, with their ``rank``."""
    by = [F.col("score").desc(), F.col("id").asc_nulls_last(), F.col("own").desc()]
    rank = lambda *keys: F.row_number().over(Window.partitionBy(*keys).orderBy(*by))
    if tasks > MANY_TASKS:
        found = found.withColumn("part", F.spark_partition_id() % PARTS)
        found = found.withColumn("rank", rank("a", "list", "part")).where(F.col("rank") <= n).drop("part")
    return found.withColumn("rank", rank("a", "list")).where(F.col("rank") <= n)


def _bands(key: np.ndarray, first: pa.Table, positives: int, low: int, high: int) -> tuple[np.ndarray, np.ndarray]:
    """Least and largest score of a negative for each anchor and positive; low * p <= 100 * s <= high * p."""
    floors, tops = np.full((len(key), positives), MOST), np.full((len(key), positives), LEAST)
    order = np.argsort(key)
    at = order[np.searchsorted(key, first["a"].to_numpy(), sorter=order)]
    p, k = first["score"].to_numpy(), first["rank"].to_numpy() - 1
    floors[at, k], tops[at, k] = -(-low * p // 100), high * p // 100
    return floors, tops


def hard_negatives(
    df: DataFrame,
    is_anchor: Column,
    label: Column,
    id_col: str = "vec_id",
    vector: str = "embedding",
    positives: int = 5,
    negatives: int = 10,
    low: int = 30,
    high: int = 90,
    scale: int = 256,
) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score) for the rows of ``is_anchor``.

    Positives are the first other rows of the anchor's label; for each of them come the first rows of other labels whose
    score is between ``low`` and ``high`` per cent of the positive's.  ``is_anchor`` and ``label`` are columns of ``df``; ids and
    labels are integers."""
    spark, scratch = df.sparkSession, Scratch(df.sparkSession)
    marked = df.select(F.col(f"`{id_col}`").cast("long").alias("id"), label.cast("long").alias("label"), F.coalesce(is_anchor, F.lit(False)).alias("anchor"), F.col(f"`{vector}`").alias("v")).where("label is not null")
    rows = scratch.store(integer_vectors(marked, F.col("v"), scale, id=F.col("id"), label=F.col("label"), anchor=F.col("anchor")), "vectors")
    anchors = rows.where("anchor and id is not null").groupBy("id", "label", "v").agg(F.count(F.lit(1)).alias("copies"))
    anchors = scratch.store(anchors.withColumn("a", F.monotonically_increasing_id()), "anchors")
    tasks = rows.rdd.getNumPartitions()
    blocks = max(1, ceil(anchors.count() / BLOCK))
    parts = [_mined(spark, scratch, rows, anchors.where(F.pmod(F.xxhash64("a"), F.lit(blocks)) == b), tasks, positives, negatives, low, high) for b in range(blocks)]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionAll(p)
    scratch.drop(rows)
    return out.withColumn("copy", F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies")))).drop("copies", "copy")


def _mined(spark, scratch: Scratch, rows: DataFrame, anchors: DataFrame, tasks: int, positives: int, negatives: int, low: int, high: int) -> DataFrame:
    """The stored result of one block of anchors."""
    own = Block(anchors.select("a", "id", "label", "v").toArrow())
    block = spark.sparkContext.broadcast(own)
    first = _first(local_positives(rows, block, positives), positives + 1, tasks)
    # Without the anchor itself: the first of the rows that equal it, if one is among the best, or else the last.
    itself = F.min(F.when(F.col("own"), F.col("rank"))).over(Window.partitionBy("a"))
    others = first.withColumn("itself", F.coalesce(itself, F.lit(positives + 1))).where("rank <> itself")
    first = others.withColumn("rank", F.when(F.col("rank") > F.col("itself"), F.col("rank") - 1).otherwise(F.col("rank")))
    first = scratch.store(first.select("a", "rank", "id", "score"), "positives")
    bands = spark.sparkContext.broadcast(_bands(own.key, first.toArrow(), positives, low, high))
    found = _first(local_negatives(rows, block, bands, negatives), negatives, tasks).select("a", "list", "rank", F.col("id").alias("negative_id"), F.col("score").alias("negative_score"))
    named = first.select("a", F.col("rank").alias("list"), F.col("id").alias("positive_id"), F.col("score").alias("positive_score"))
    out = found.join(named, ["a", "list"]).join(anchors.select("a", F.col("id").alias("anchor_id"), "copies"), "a")
    out = scratch.store(out.select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score", "copies"), "mined")
    block.destroy()
    bands.destroy()
    scratch.drop(first)
    return out


def oracle_sql(every: int = 100, positives: int = 5, negatives: int = 10, low: int = 30, high: int = 90, scale: int = 256, label: str = "label", table: str = "embeddings") -> str:
    """DuckDB SQL for ``hard_negatives(embeddings, vec_id % every = 0, label)`` by comparing each anchor with every row."""
    product = "coalesce(list_sum(list_transform(list_zip(a.v, x.v), lambda z: coalesce(z[1], 0) * coalesce(z[2], 0))), 0)::BIGINT"
    return f"""
WITH x AS (SELECT row_number() OVER () AS i, vec_id, {label} AS label, list_transform(embedding, lambda e: floor({scale} * e::DOUBLE)::BIGINT) AS v FROM {table}
  WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda e: e IS NULL OR NOT isfinite(e))) = 0),
p AS (SELECT a.i, a.vec_id AS anchor_id, x.vec_id, a.label = x.label AS same, {product} AS s FROM x AS a JOIN x ON a.i <> x.i WHERE a.vec_id % {every} = 0),
best AS (SELECT i, anchor_id, vec_id AS positive_id, s AS positive_score, row_number() OVER (PARTITION BY i ORDER BY s DESC, vec_id NULLS LAST) AS k FROM p WHERE same QUALIFY k <= {positives})
SELECT anchor_id, positive_id, row_number() OVER (PARTITION BY b.i, b.k ORDER BY s DESC, vec_id NULLS LAST)::INT AS rank, vec_id AS negative_id, positive_score, s AS negative_score
FROM best AS b JOIN p USING (i, anchor_id) WHERE NOT same AND {low} * positive_score <= 100 * s AND 100 * s <= {high} * positive_score
QUALIFY rank <= {negatives}"""
