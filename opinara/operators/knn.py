"""Exact nearest neighbours of all rows among all rows: a join over Voronoi cells, pruned by the triangle inequality.

1. Equal vectors become one query, and as data at most k + 1 of them (those of least word) matter to anybody.
2. Pivots, a hashed sample of the vectors of bounded size, cut the space into cells; a cell of many points is dealt into slices,
   so that no task holds more than about ``CELL`` points at once, or of many points a share 2 / ``SLICES``.
3. Each query meets its own slice.  Its distance to the (k + 1)-th point there bounds that of its true neighbours.
4. A query goes on to the other cells that its bound may reach: by the cell's ring around its pivot, or by the hyperplane
   between the two pivots.  Cells that many queries reach are copied for parts of them.  A task holds one slice and streams
   the queries past it.

Points never go through the driver; it holds the pivots and three numbers for each cell.  In few dimensions a query reaches few
cells; in many dimensions no exact method can leave out much, and each query meets nearly every slice; as there are about ``2 * SLICES`` of them at most, copies grow with the queries.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from opinara.functions.arrays import list_matrix, runs
from opinara.session import Scratch

#: Points of a slice (about), pivots at most, queries of one product, copies of queries in one batch.
CELL, PIVOTS, STEP, COPIES = 4096, 2048, 512, 8192
#: Cells that points are cut into (about): with more points cells grow, so that a query is copied to a bounded number of slices.
SLICES = 64
#: Query copies of a slice from which on it is dealt with in several tasks.
QUERIES = 1 << 17
#: Rows of a box of a slice's tree at most; dimensions up to which trees leave much out; rows (times those wanted) that bound the rest.
LEAF, TREE_DIMS, SEEDS = 24, 8, 32
#: Bounds are widened by this share (and as much in units of the largest square), more than rounding can move them.
SLACK = 1e-9


def squares(q: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Squared distances by one matrix product, exact up to rounding."""
    return np.maximum((q * q).sum(1)[:, None] + (x * x).sum(1) - 2 * (q @ x.T), 0.0)


def best(q: np.ndarray, x: np.ndarray, words: np.ndarray, bound: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query, row, distance): for each query its first ``n`` rows by (distance, word) among those within its bound."""
    found = []
    step = max(1, min(STEP, STEP * CELL // max(1, len(x))))  # bounds the product
    for s in range(0, len(q), step):
        part = q[s : s + step]
        rough = squares(part, x)
        slack = SLACK * (1 + (part * part).sum(1) + (x * x).sum(1).max(initial=0.0))
        line = bound[s : s + step] ** 2
        if len(x) > n:
            line = np.minimum(line, np.partition(rough, n - 1, axis=1)[:, n - 1])
        i, j = np.nonzero(rough <= (line + slack)[:, None])
        d = np.sqrt(((part[i] - x[j]) ** 2).sum(1))
        keep = d <= bound[s : s + step][i]
        i, j, d = i[keep], j[keep], d[keep]
        order = np.lexsort((words[j], d, i))
        i, j, d = i[order], j[order], d[order]
        first = np.searchsorted(i, np.arange(len(part)))
        keep = np.arange(len(i)) - first[i] < n
        found.append((i[keep] + s, j[keep], d[keep]))
    return tuple(np.concatenate(c) for c in zip(*found, strict=True)) if found else (np.zeros(0, int), np.zeros(0, int), np.zeros(0))


def first_of(i: np.ndarray, j: np.ndarray, d: np.ndarray, words: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of (query, row, distance) the first ``n`` of each query by (distance, word), in that order."""
    order = np.lexsort((words, d, i))
    i, j, d = i[order], j[order], d[order]
    keep = np.arange(len(i)) - np.searchsorted(i, i) < n
    return i[keep], j[keep], d[keep]


class Tree:
    """Rows in boxes of about ``LEAF`` that halve them again and again along the widest side; for few dimensions."""

    def __init__(self, x: np.ndarray, words: np.ndarray):
        order, self.starts = halves(x)
        self.x, self.words, self.rows = x[order], words[order], order
        self.low, self.high = (f.reduceat(self.x, self.starts[:-1]) if len(x) else self.x for f in (np.minimum, np.maximum))
        square = (self.x * self.x).sum(1)
        self.wide, self.top = np.concatenate([self.x, square[:, None]], 1), square.max(initial=0.0)

    def best(self, q: np.ndarray, bound: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """As ``best``: queries of one box look only into the boxes that their bounds reach."""
        found = [(np.zeros(0, int), np.zeros(0, int), np.zeros(0))]
        order, starts = halves(q)
        seeds = -(-SEEDS * n // LEAF)
        for lo, hi in zip(starts[:-1], starts[1:], strict=True):
            own = order[lo:hi]
            part, line = q[own], bound[own]
            square = (part * part).sum(1)
            slack = SLACK * (1 + square.max() + self.top)
            gap = np.zeros(len(self.low))
            for c in range(q.shape[1]):
                side = np.maximum(np.maximum(self.low[:, c] - part[:, c].max(), part[:, c].min() - self.high[:, c]), 0.0)
                gap += side * side
            reached = np.flatnonzero(gap <= line.max() ** 2 + slack)
            if len(reached) > 2 * seeds:  # the n-th of the nearest boxes' rows bounds the true one
                first = self._rows(np.argpartition(gap, seeds)[:seeds])
                line = np.minimum(line, np.sqrt(np.partition(squares(part, self.x[first]), n - 1, axis=1)[:, n - 1] + 2 * slack))
                reached = np.flatnonzero(gap <= line.max() ** 2 + slack)
            at = self._rows(reached)
            pairs = [(np.zeros(0, int), np.zeros(0, int))]
            left = np.concatenate([-2 * part, np.ones((len(part), 1))], 1)
            limit = (line * line + slack - square)[:, None]
            for s in range(0, len(at), CELL):
                i, j = np.nonzero(left @ self.wide[at[s : s + CELL]].T <= limit)
                pairs.append((i, at[s + j]))
            i, j = (np.concatenate(c) for c in zip(*pairs, strict=True))
            d = np.sqrt(((part[i] - self.x[j]) ** 2).sum(1))
            near = d <= line[i]
            i, j, d = first_of(i[near], j[near], d[near], self.words[j[near]], n)
            found.append((own[i], self.rows[j], d))
        i, j, d = (np.concatenate(c) for c in zip(*found, strict=True))
        back = np.argsort(i, kind="stable")
        return i[back], j[back], d[back]

    def _rows(self, leaves: np.ndarray) -> np.ndarray:
        size = self.starts[leaves + 1] - self.starts[leaves]
        return np.arange(size.sum()) + np.repeat(self.starts[leaves] - np.cumsum(size) + size, size)


def halves(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """An order of the rows and the starts (and end) of the boxes of at least ``LEAF // 2`` and at most ``LEAF`` rows in it."""
    order, starts, todo = np.arange(len(x)), [], [(0, len(x))] if len(x) else []
    while todo:
        lo, hi = todo.pop()
        if hi - lo <= LEAF:
            starts.append(lo)
            continue
        part = x[order[lo:hi]]
        c, middle = int((part.max(0) - part.min(0)).argmax()), (hi - lo) // 2
        order[lo:hi] = order[lo:hi][np.argpartition(part[:, c], middle)]
        todo += [(lo + middle, hi), (lo, lo + middle)]
    return order, np.array([*starts, len(x)])


class Rows:
    """Rows to be searched for nearest ones: in a tree where that pays, else by comparing all."""

    def __init__(self, x: np.ndarray, words: np.ndarray):
        self.x, self.words = x, words
        self.tree = Tree(x, words) if x.shape[1] <= TREE_DIMS and len(x) > 8 * LEAF else None

    def best(self, q: np.ndarray, bound: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        return self.tree.best(q, bound, n) if self.tree else best(q, self.x, self.words, bound, n)


class Cells:
    """Pivots with what bounds the points of their cells."""

    def __init__(self, pivots: np.ndarray):
        self.pivots = pivots
        self.near, self.far = np.full(len(pivots), np.inf), np.full(len(pivots), -np.inf)
        self.slices, self.parts = np.zeros(len(pivots), np.int64), np.ones(len(pivots), np.int64)
        self.apart = np.sqrt(squares(pivots, pivots))

    def place(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The cell of each point and its distance to the pivot."""
        cell = np.concatenate([squares(x[s : s + STEP], self.pivots).argmin(1) for s in range(0, len(x), STEP)] or [np.zeros(0, int)])
        return cell, np.sqrt(((x - self.pivots[cell]) ** 2).sum(1))

    def reached(self, x: np.ndarray, cell: np.ndarray, bound: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(query, cell) of the cells that may hold a point within the query's bound."""
        d = np.sqrt(squares(x, self.pivots))
        own = d[np.arange(len(x)), cell]
        # Points of another cell are nearer to its pivot than to this one's: beyond the hyperplane between the two.
        with np.errstate(invalid="ignore", divide="ignore"):
            plane = (d * d - (own * own)[:, None]) / (2 * self.apart[cell])
        plane = np.where(self.apart[cell] > 0, plane, 0.0)
        least = np.maximum(np.maximum(d - self.far, self.near - d), plane)
        slack = SLACK * (1 + d * d + np.square(self.pivots).sum(1).max(initial=0.0)) ** 0.5 * 1e2
        return np.nonzero((least <= bound[:, None] + slack) & (self.slices > 0))


def neighbours(rows: DataFrame, k: int) -> DataFrame:
    """(word, neighbour, distance, rank): the k nearest other words of every (word, vector) of ``rows``, by (distance, word).

    Words are distinct integers and vectors have one length; rows with a null word, vector or component, or one that is not
    finite, are left out.  Fewer than k other words give as many neighbours."""
    out = neighbour_lists(rows, k).select("word", F.posexplode("list").alias("at", "x"))
    return out.select("word", F.col("x.neighbour").alias("neighbour"), F.col("x.distance").alias("distance"), (F.col("at") + 1).alias("rank"))


def neighbour_lists(rows: DataFrame, k: int) -> DataFrame:
    """(word, list): as ``neighbours``, with one array of (distance, neighbour) for each word."""
    spark, scratch = rows.sparkSession, Scratch(rows.sparkSession)
    whole = ~F.exists("vector", lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == float("inf")))
    asked = rows.select(F.col("word").cast("long").alias("word"), F.col("vector").cast("array<double>").alias("vector")).where("word is not null and vector is not null").where(whole)
    asked = asked.withColumn("h1", F.xxhash64("vector")).withColumn("h2", F.xxhash64(F.lit("second"), "vector"))
    same = Window.partitionBy("h1", "h2").orderBy("word").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    points = asked.withColumn("copy", F.row_number().over(same)).withColumn("query", F.first("word").over(same)).where(F.col("copy") <= k + 1)
    points = scratch.store(points.select("query", "word", "h1", "h2", "vector"), "points")
    n = points.count()
    cell = max(CELL, -(-2 * n // SLICES))
    sample = points.where("query = word").orderBy(F.xxhash64("vector"), "word").limit(max(1, min(PIVOTS, 2 * n // cell)))
    pivots = np.array([r.vector for r in sample.select("vector").collect()], np.float64)
    if not n:
        return asked.select("word", F.array(F.struct(F.lit(0.0).alias("distance"), F.col("word").alias("neighbour"))).alias("list")).where("false")
    cells = Cells(pivots)
    placed = _placed(points, cells)
    for r in placed.groupBy("cell").agg(F.count(F.lit(1)).alias("n"), F.min("apart").alias("near"), F.max("apart").alias("far")).collect():
        cells.near[r.cell], cells.far[r.cell], cells.slices[r.cell] = r.near, r.far, -(-2 * r.n // cell) if r.n > cell else 1
    slices = spark.createDataFrame([(i, int(s)) for i, s in enumerate(cells.slices)], "cell int, slices int")
    placed = placed.join(F.broadcast(slices), "cell").withColumn("slice", F.pmod(F.xxhash64("word"), F.col("slices")).cast("int"))
    placed = scratch.store(placed.select("cell", "slice", "query", "word", "vector"), "cells")
    begun = scratch.store(_own_slices(placed, k + 1), "begun")
    parts = _copies(begun, cells, True).groupBy("cell").agg(F.sum("n").alias("n")).collect()
    for r in parts:
        cells.parts[r.cell] = -(-r.n // (QUERIES * max(1, int(cells.slices[r.cell]))))
    found = begun.select("query", F.explode(F.arrays_zip("words", "distances")).alias("f")).select("query", F.col("f.words").alias("neighbour"), F.col("f.distances").alias("distance"))
    if len(pivots) > 1 or cells.slices.max() > 1:
        found = found.unionAll(_met(placed, _copies(begun, cells, False), cells, k + 1))
    first = Window.partitionBy("query").orderBy("distance", "neighbour")
    found = found.withColumn("n", F.row_number().over(first)).where(F.col("n") <= k + 1)
    lists = found.groupBy("query").agg(F.array_sort(F.collect_list(F.struct("distance", "neighbour"))).alias("list"))
    named = points.where("query = word").select("query", "h1", "h2").join(lists, "query").select("h1", "h2", "list")
    others = F.slice(F.filter("list", lambda x: x["neighbour"] != F.col("word")), 1, k)
    return asked.select("word", "h1", "h2").join(named, ["h1", "h2"]).select("word", others.alias("list"))


def _placed(points: DataFrame, cells: Cells) -> DataFrame:
    shared = points.sparkSession.sparkContext.broadcast(cells)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            cell, apart = shared.value.place(list_matrix(b.column(2), shared.value.pivots.shape[1]))
            yield pa.RecordBatch.from_arrays([pa.array(cell, pa.int32()), pa.array(apart), *b.columns], names=["cell", "apart", "query", "word", "vector"])

    return points.select("query", "word", "vector").mapInArrow(run, "cell int, apart double, query long, word long, vector array<double>")


def _own_slices(placed: DataFrame, n: int) -> DataFrame:
    """(cell, slice, query, vector, bound, words, distances): each query with the first ``n`` of its own slice."""

    def one(rows: pa.Table) -> pa.RecordBatch:
        rows = rows.combine_chunks()
        query, word = rows["query"].to_numpy(), rows["word"].to_numpy()
        x = list_matrix(rows["vector"].chunk(0))
        mine = np.flatnonzero(query == word)
        i, j, d = Rows(x, word).best(x[mine], np.full(len(mine), np.inf), n)
        sizes = np.bincount(i, minlength=len(mine))
        ends = np.cumsum(sizes)
        bound = np.where(sizes >= n, d[np.maximum(ends - 1, 0)] if len(d) else np.inf, np.inf)
        offsets = pa.array(np.concatenate([[0], ends]).astype(np.int32))
        lists = [pa.ListArray.from_arrays(offsets, pa.array(v)) for v in (word[j], d)]
        at = pa.array(mine)
        return pa.RecordBatch.from_arrays([rows["cell"].chunk(0).take(at), rows["slice"].chunk(0).take(at), pa.array(word[mine]), rows["vector"].chunk(0).take(at), pa.array(bound), *lists], names=["cell", "slice", "query", "vector", "bound", "words", "distances"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        last = None
        for b in batches:
            keys = np.stack([b.column(c).to_numpy() for c in (0, 1)], 1)
            for lo, hi in runs(keys):
                key = tuple(keys[lo])
                if held and key != last:
                    yield one(pa.Table.from_batches(held))
                    held = []
                last = key
                held.append(b.slice(lo, hi - lo))
        if held:
            yield one(pa.Table.from_batches(held))

    dealt = placed.repartition("cell", "slice").sortWithinPartitions("cell", "slice")
    return dealt.mapInArrow(run, "cell int, slice int, query long, vector array<double>, bound double, words array<long>, distances array<double>")


def _copies(begun: DataFrame, cells: Cells, count: bool) -> DataFrame:
    """One row for each query and slice it still has to meet, or the numbers of them by cell."""
    shared = begun.sparkSession.sparkContext.broadcast(cells)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shared.value
        total = np.zeros(len(own.pivots), np.int64)
        for b in batches:
            for s in range(0, b.num_rows, STEP):
                part = b.slice(s, STEP)
                cell, slice_, query = (part.column(c).to_numpy() for c in (0, 1, 2))
                i, j = own.reached(list_matrix(part.column(3)), cell, part.column(4).to_numpy())
                times = own.slices[j]
                i, j = np.repeat(i, times), np.repeat(j, times)
                to = np.arange(len(i)) - np.repeat(np.cumsum(times) - times, times)
                new = ~((j == cell[i]) & (to == slice_[i]))
                i, j, to = i[new], j[new], to[new]
                if count:
                    total += np.bincount(j, minlength=len(total))
                    continue
                salt = (query[i] % own.parts[j]).astype(np.int32)
                for lo in range(0, len(i), COPIES):
                    at = pa.array(i[lo : lo + COPIES])
                    keys = [pa.array(v[lo : lo + COPIES], pa.int32()) for v in (j, to, salt)]
                    yield pa.RecordBatch.from_arrays([*keys, pa.array(np.ones(len(at), np.int32)), part.column(2).take(at), part.column(4).take(at), part.column(3).take(at)], names=_MEET)
        if count:
            seen = np.flatnonzero(total)
            yield pa.RecordBatch.from_arrays([pa.array(seen, pa.int32()), pa.array(total[seen])], names=["cell", "n"])

    rows = begun.select("cell", "slice", "query", "vector", "bound")
    return rows.mapInArrow(run, "cell int, n long" if count else "cell int, slice int, part int, side int, id long, bound double, vector array<double>")


_MEET = ["cell", "slice", "part", "side", "id", "bound", "vector"]


def _met(placed: DataFrame, copies: DataFrame, cells: Cells, n: int) -> DataFrame:
    """(query, neighbour, distance): the first ``n`` of every slice that a query was sent to, within its bound."""
    spark = placed.sparkSession
    parts = spark.createDataFrame([(i, int(p)) for i, p in enumerate(cells.parts)], "cell int, parts int")
    data = placed.join(F.broadcast(parts), "cell").select("cell", "slice", F.explode(F.sequence(F.lit(0), F.greatest(F.col("parts"), F.lit(1)) - 1)).alias("part"), F.lit(0).alias("side"), F.col("word").alias("id"), F.lit(0.0).alias("bound"), "vector")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        last, rows = None, None
        for b in batches:
            keys = np.stack([b.column(c).to_numpy() for c in range(4)], 1)
            for lo, hi in runs(keys):
                key, part = tuple(keys[lo, :3]), b.slice(lo, hi - lo)
                if keys[lo, 3] == 0:
                    held = [*held, part] if key == last else [part]
                    last, rows = key, None
                    continue
                if key != last:
                    continue  # a slice without points
                if rows is None:
                    t = pa.Table.from_batches(held).combine_chunks()
                    rows = Rows(list_matrix(t["vector"].chunk(0)), t["id"].to_numpy())
                i, j, d = rows.best(list_matrix(part.column(6)), part.column(5).to_numpy(), n)
                yield pa.RecordBatch.from_arrays([part.column(4).take(pa.array(i)), pa.array(rows.words[j]), pa.array(d)], names=["query", "neighbour", "distance"])

    dealt = data.unionAll(copies).repartition("cell", "slice", "part").sortWithinPartitions("cell", "slice", "part", "side")
    return dealt.mapInArrow(run, "query long, neighbour long, distance double")


