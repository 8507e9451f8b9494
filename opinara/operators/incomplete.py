"""Exact nearest neighbours of rows with missing entries.

Distances over different topics obey no triangle inequality, but all rows that share the same topics with a query lie in one
Euclidean space.  Over few topics, the rows of each pattern of observed topics are therefore searched in one tree for each set of
topics that they can share with a pattern; a query's bound from one tree narrows the next.  Over many topics, and for medians over
different bags, every query is compared with every row.

Queries are cut into chunks of alike rows, rows into slices, each packed into one row of arrays; every chunk streams all slices past
the lists of its best, so that nothing is copied in a shuffle and only ``k`` neighbours of a query leave a task.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from opinara.functions.arrays import list_matrix
from opinara.operators import knn
from opinara.session import cut_lineage, small_batches

#: Queries of a chunk, rows of a slice, slices that one task streams, topics up to which patterns have trees.
CHUNK, SLICE, STREAMED, PATTERN_TOPICS = 8192, 1 << 18, 8, 6


class Lists:
    """The ``k`` nearest found so far of some queries, by (distance, id)."""

    def __init__(self, ids: np.ndarray, k: int):
        self.queries = ids
        self.distances, self.ids = np.full((len(ids), k), np.inf), np.empty((len(ids), k), ids.dtype)

    def add(self, i: np.ndarray, ids: np.ndarray, d: np.ndarray) -> None:
        rows = np.unique(i)
        r, c = np.nonzero(np.isfinite(self.distances[rows]))
        i, ids, d = (np.concatenate(v) for v in ((rows[r], i), (self.ids[rows[r], c], ids), (self.distances[rows[r], c], d)))
        i, at, d = knn.first_of(i, np.arange(len(i)), d, ids, self.distances.shape[1])
        rank = np.arange(len(i)) - np.searchsorted(i, i)
        self.distances[rows] = np.inf
        self.distances[i, rank], self.ids[i, rank] = d, ids[at]

    def batch(self, kind: pa.DataType) -> pa.RecordBatch:
        has = np.isfinite(self.distances)
        some = has.any(1)
        offsets = pa.array(np.concatenate([[0], np.cumsum(has[some].sum(1))]).astype(np.int32))
        lists = [pa.ListArray.from_arrays(offsets, v) for v in (pa.array(self.distances[has]), pa.array(self.ids[has], kind))]
        return pa.RecordBatch.from_arrays([pa.array(self.queries[some], kind), *lists], names=["word", "distances", "neighbours"])


def patterns(x: np.ndarray) -> np.ndarray:
    """The observed columns of each row, as bits."""
    return (~np.isnan(x)) @ (1 << np.arange(x.shape[1]))


def few_copies(y: np.ndarray, ids: np.ndarray, k: int) -> tuple[np.ndarray, int]:
    """The rows that are left when only the first ``k`` of equal rows by id are kept; how many equal ones are left at most."""
    order = np.lexsort((ids, *y.T))
    new = np.ones(len(y), bool)
    new[1:] = (y[order][1:] != y[order][:-1]).any(1)
    copy = np.arange(len(y)) - np.maximum.accumulate(np.where(new, np.arange(len(y)), 0))
    return order[copy < k], min(k, int(copy.max(initial=0)) + 1)


def search(found: Lists, x: np.ndarray, y: np.ndarray, ids: np.ndarray, size: float, least: int) -> None:
    """Adds the nearest rows of ``y`` to the lists of the queries ``x``, by trees over the rows that share the same topics."""
    k = found.distances.shape[1]
    theirs, own = patterns(y), patterns(x)
    for p in np.unique(own):
        asked = np.flatnonzero(own == p)
        shared = theirs & p
        sets = [(s, np.flatnonzero(shared == s)) for s in np.unique(shared).tolist() if s.bit_count() >= max(least, 1)]
        # The densest first: their neighbours bound the rest.
        for s, at in sorted(sets, key=lambda t: len(t[1]) ** (-1 / t[0].bit_count())):
            use = [c for c in range(x.shape[1]) if s >> c & 1]
            of, rows = x[np.ix_(asked, use)], y[np.ix_(at, use)]
            kept, copies = few_copies(rows, ids[at], k)  # those at no distance don't count: at most so many more are asked for
            rows, words = rows[kept], ids[at[kept]]
            scale = size / len(use)
            bound = found.distances[asked, -1] * (scale**-0.5 * (1 + knn.SLACK))
            i, j, _ = knn.Rows(rows, words).best(of, bound, k + copies + 2)
            total = np.zeros(len(i))
            for c in range(len(use)):
                total += np.square(of[i, c] - rows[j, c])
            d = np.sqrt(total * size / len(use))
            near = (d > 0) & (d <= found.distances[asked[i], -1])
            found.add(asked[i[near]], words[j[near]], d[near])


def compare(found: Lists, x: np.ndarray, y: np.ndarray, ids: np.ndarray, columns: list, least: int) -> None:
    """Adds the nearest rows of ``y`` to the lists of the queries ``x``, by all distances."""
    from opinara.operators.semantic import PAIR_BLOCK, STRIP, _bag_distances

    k = found.distances.shape[1]
    for lo in range(0, len(y), 8 * PAIR_BLOCK):
        z, names = y[lo : lo + 8 * PAIR_BLOCK], ids[lo : lo + 8 * PAIR_BLOCK]
        for s in range(0, len(x), STRIP):
            d, _ = _bag_distances(x[s : s + STRIP], z, columns, least)
            d[~(d > 0) | (found.queries[s : s + STRIP, None] == names[None])] = np.inf
            # All that are no farther than the k-th, ties too.
            last = found.distances[s : s + STRIP, -1]
            if d.shape[1] > k:
                last = np.minimum(last, np.partition(d, k - 1, axis=1)[:, k - 1])
            i, j = np.nonzero((d <= last[:, None]) & np.isfinite(d))
            found.add(i + s, names[j], d[i, j])


def placed(x: np.ndarray, middle: float, spread: float) -> tuple[np.ndarray, np.ndarray]:
    """(pattern, place) of rows: places are numbers along a curve through the cells of a grid, so that near numbers are near rows."""
    width, bits = x.shape[1], min(12, 62 // max(1, x.shape[1]))
    share = 1 / (1 + np.exp(-np.clip(1.7 * (np.nan_to_num(x, nan=middle) - middle) / spread, -50, 50)))
    cell, place = np.minimum(share * 2**bits, 2**bits - 1).astype(np.int64), np.zeros(len(x), np.int64)
    for b in range(bits):
        for c in range(width):
            place |= (cell[:, c] >> b & 1) << (b * width + c)
    return patterns(x).astype(np.int64), place


def packed(rows: DataFrame, names: tuple[str, str], kind: str, most: int) -> DataFrame:
    """The (key, x) rows of each partition as rows of two arrays, of at most ``most`` rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [b for b in batches if b.num_rows]
        if not held:
            return
        t = pa.Table.from_batches(held).combine_chunks()
        for s in range(0, len(t), most):
            ids, x = t.column(0).chunk(0)[s : s + most], list_matrix(t.column(1).chunk(0)[s : s + most])
            lists = [pa.ListArray.from_arrays(pa.array([0, len(v)], pa.int32()), v) for v in (ids, pa.array(x.ravel()))]
            yield pa.RecordBatch.from_arrays(lists, names=list(names))

    return rows.mapInArrow(run, f"{names[0]} array<{kind}>, {names[1]} array<double>")


def nearest_lists(values: DataFrame, bags: Sequence[tuple[Sequence[str], float]], k: int, key: str = "user_id", least: int = 2) -> DataFrame:
    """(word, distances, neighbours): the k nearest rows at a positive distance by (distance, key), by the distances of
    ``semantic.pair_distances``."""
    from opinara.operators.dimension import topic_arrays

    small_batches(values.sparkSession)
    names = sorted({t for topics, _ in bags for t in topics})
    at = {t: j for j, t in enumerate(names)}
    columns = [([at[t] for t in topics], float(size)) for topics, size in bags]
    kind, width = dict(values.dtypes)[key], len(names)
    trees = len({(*use, size) for use, size in columns}) == 1 and width <= PATTERN_TOPICS
    rows = cut_lineage(topic_arrays(values, names, key), "rows")
    n = rows.count()
    parallel = values.sparkSession.sparkContext.defaultParallelism
    chunks, slices = max(1, -(-n // CHUNK), min(2 * parallel, -(-n // 1000))), max(1, -(-n // SLICE))
    if trees:
        m = values.agg(F.avg("value").alias("middle"), F.stddev_pop("value").alias("spread")).first()
        middle, spread = m.middle or 0.0, m.spread or 1.0

        def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                found = placed(list_matrix(b.column(1), width), middle, spread)
                yield pa.RecordBatch.from_arrays([*b.columns, *map(pa.array, found)], names=[key, "x", "pattern", "place"])

        asked = rows.mapInArrow(place, f"{key} {kind}, x array<double>, pattern long, place long")
        asked = asked.repartitionByRange(chunks, "pattern", "place", F.xxhash64(key)).select(key, "x")
    else:
        asked = rows.repartition(chunks, F.xxhash64(key))
    data = cut_lineage(packed(rows.repartition(slices, F.xxhash64(key)), ("b", "y"), kind, SLICE), "slices")
    parts = -(-slices // STREAMED)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found, x, first, typed = None, None, None, None
        for batch in batches:
            for r in range(batch.num_rows):
                own, ids = batch.column(0)[r].values, batch.column(2)[r].values.to_numpy(zero_copy_only=False)
                y = batch.column(3)[r].values.to_numpy(zero_copy_only=False).reshape(len(ids), width)
                if found is None or own[0] != first:  # the next chunk
                    if found:
                        yield found.batch(typed)
                    first, typed = own[0], own.type
                    found, x = Lists(own.to_numpy(zero_copy_only=False), k), batch.column(1)[r].values.to_numpy(zero_copy_only=False).reshape(len(own), width)
                if trees:
                    search(found, x, y, ids, columns[0][1], least)
                else:
                    compare(found, x, y, ids, columns, least)
        if found:
            yield found.batch(typed)

    met = packed(asked, ("a", "x"), kind, 2 * CHUNK).hint("shuffle_replicate_nl").crossJoin(data.coalesce(parts))
    out = met.mapInArrow(run, f"word {kind}, distances array<double>, neighbours array<{kind}>")
    if parts > 1:
        both = out.groupBy("word").agg(F.flatten(F.collect_list(F.arrays_zip("distances", "neighbours"))).alias("l"))
        out = both.select("word", F.slice(F.array_sort("l"), 1, k).alias("l")).select("word", "l.distances", "l.neighbours")
    return out
