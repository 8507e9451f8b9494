"""Sensitivity to the choice of topics: statistics of all subsets of a size, and of all combinations of several societies' subsets.

A subset is a number; executors unrank numbers to topics, so no list of subsets is made on the driver or broadcast.  Up to
``ZETA`` topics, the sums over the pairs inside every subset come from one sum-over-subsets (zeta) transform of the pairs'
values over bitmasks; beyond, from the pairs of the unranked topics."""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from math import comb

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from opinara.session import cut_lineage

#: Topics up to which a transform over all bitmasks is made; numbers of subsets that one step of a task unranks.
ZETA, STEP = 20, 1 << 14
#: Subsets of a society whose means may be held by each task (8 bytes each).
MAX_MEANS = 4_000_000


def unrank(numbers: np.ndarray, n: int, size: int) -> np.ndarray:
    """Members (rows of ``size`` positions) of the subsets of ``n`` with these numbers in lexicographic order."""
    out = np.zeros((len(numbers), size), np.int64)
    rest, left = numbers.astype(np.int64).copy(), np.full(len(numbers), size)
    choose = np.array([[comb(a, b) for b in range(size + 1)] for a in range(n + 1)], np.int64)
    for e in range(n):
        # The subsets that go on with e come first: as many as the rest can be chosen from what follows.
        with_e = choose[n - e - 1][np.maximum(left - 1, 0)]
        take = (left > 0) & (rest < with_e)
        at = np.flatnonzero(take)
        out[at, size - left[at]] = e
        left[at] -= 1
        rest[~take] -= with_e[~take]
    return out


def zeta(square: np.ndarray) -> np.ndarray:
    """For every bitmask of topics, the sum of the (symmetric) values of the pairs inside it."""
    n = len(square)
    total = np.zeros(1 << n)
    for b in range(n):
        # Pairs of b with the lower topics: sums over subsets of single values, doubled bit by bit.
        own = np.zeros(1)
        for a in range(b):
            own = np.concatenate([own, own + square[a, b]])
        total[1 << b : 2 << b] = total[: 1 << b] + own
    return total


class SubsetSums:
    """Of the pairs inside subsets of topics: the sum of their values, how many have one, and how many there are."""

    def __init__(self, i: np.ndarray, j: np.ndarray, y: np.ndarray, n: int):
        self.squares = np.zeros((3, n, n))
        known = ~np.isnan(y)
        for k, v in enumerate((np.where(known, y, 0.0), known, 1)):
            self.squares[k, i, j] = self.squares[k, j, i] = v
        self.tables = [zeta(s) for s in self.squares] if n <= ZETA else None

    def of(self, members: np.ndarray) -> np.ndarray:
        if self.tables:
            masks = (1 << members).sum(1)
            return np.array([t[masks] for t in self.tables])
        out = np.zeros((3, len(members)))
        for a in range(members.shape[1]):
            for b in range(a + 1, members.shape[1]):
                out += self.squares[:, members[:, a], members[:, b]]
        return out


def subset_means(pairs: DataFrame, topics: Sequence[str], size: int, value: str = "y", by: tuple[str, ...] = ("society",), complete: bool = False) -> DataFrame:
    """(by..., subset, pairs, mean): mean of a value of topic pairs (t1, t2) over the pairs within each subset of ``size`` topics.

    Subsets are numbered in lexicographic order.  The mean is over the pairs that have a value; with ``complete`` subsets that lack
    one are left out.  ``pairs`` counts those with and without a value; subsets without any give no row.  The input has one row for
    each pair."""
    spark, names = pairs.sparkSession, sorted(topics)
    n = len(names)
    place = F.map_from_arrays(F.array(*[F.lit(t) for t in names]), F.array(*[F.lit(i) for i in range(n)]))
    known = pairs.select(*by, F.try_element_at(place, "t1").alias("i"), F.try_element_at(place, "t2").alias("j"), F.coalesce(F.col(value).cast("double"), F.lit(float("nan"))).alias("v")).where("i is not null and j is not null and i <> j")
    # One row for each society, of at most n * (n - 1) / 2 pairs.
    squares = known.groupBy(*by).agg(F.collect_list("i").alias("i"), F.collect_list("j").alias("j"), F.collect_list("v").alias("v"))
    squares = cut_lineage(squares, "squares")  # means are read several times; the pairs behind them are computed once
    total, inside = comb(n, size), comb(size, 2)
    blocks = spark.range(0, -(-total // STEP), 1, max(1, min(-(-total // STEP), spark.sparkContext.defaultParallelism))).withColumnRenamed("id", "_block")
    tasks = blocks.join(F.broadcast(squares), F.lit(True)).select(*by, "_block", "i", "j", "v")
    k = len(by)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, sums = None, None
        for b in batches:
            for r in range(b.num_rows):
                key = tuple(b.column(c)[r].as_py() for c in range(k))
                if key != last:
                    i, j, v = (np.array(b.column(k + 1 + c)[r].as_py()) for c in range(3))
                    last, sums = key, SubsetSums(i.astype(int), j.astype(int), v.astype(float), n)
                first = b.column(k)[r].as_py() * STEP
                numbers = np.arange(first, min(first + STEP, total))
                s, seen, there = sums.of(unrank(numbers, n, size))
                keep = np.flatnonzero(seen == inside if complete else there > 0)
                own = [pa.array([x] * len(keep), b.schema.field(c).type) for c, x in enumerate(key)]
                yield pa.RecordBatch.from_arrays([*own, pa.array(numbers[keep]), pa.array(there[keep].astype(np.int64)), pa.array(s[keep] / np.maximum(seen[keep], 1), mask=seen[keep] == 0)], names=[*by, "subset", "pairs", "mean"])

    kinds = ", ".join(f"{c} {dict(pairs.dtypes)[c]}" for c in by)
    return tasks.mapInArrow(run, f"{kinds}{', ' if by else ''}subset long, pairs long, mean double")


def subset_ratios(means: DataFrame, a: str, b: str) -> DataFrame:
    """Ratios of the means of two societies over all combinations of their subsets: summary of the exhaustive grid.

    The grid is the product of two bounded subset tables, the feature itself."""
    x = means.where(F.col("society") == a).select(F.col("mean").alias("ma"))
    y = means.where(F.col("society") == b).select(F.col("mean").alias("mb"))
    r = F.try_divide(F.col("ma"), F.col("mb"))
    grid = x.join(F.broadcast(y), F.lit(True)).select(r.alias("ratio"))
    return grid.agg(F.count(F.lit(1)).alias("combinations"), F.min("ratio").alias("min_ratio"), F.percentile("ratio", F.lit(0.5)).alias("median_ratio"), F.max("ratio").alias("max_ratio"), F.avg((F.col("ratio") > 1).cast("double")).alias("share_above_1"))


def dispersion_grid(means: DataFrame, societies: Sequence[str]) -> DataFrame:
    """(off, on, ratio) of every combination of the societies' subsets: the population SD over the societies of the mean in
    each medium, and their ratio.  ``means`` is (society, subset, off, on): both media leave out the same topics.

    The combinations are the feature: 36 ** 3 for three societies and seven of nine topics."""
    grid = None
    for k, s in enumerate(societies):
        own = means.where(F.col("society") == s).select(F.col("off").alias(f"off{k}"), F.col("on").alias(f"on{k}"))
        grid = own if grid is None else grid.join(F.broadcast(own), F.lit(True))

    def sd(medium: str):
        x = F.array(*[F.col(f"{medium}{k}") for k in range(len(societies))])
        mean = F.aggregate(x, F.lit(0.0), lambda s, v: s + v) / len(societies)
        return F.sqrt(F.aggregate(F.transform(x, lambda v: (v - mean) * (v - mean)), F.lit(0.0), lambda s, v: s + v) / len(societies))

    return grid.select(sd("off").alias("off"), sd("on").alias("on")).withColumn("ratio", F.try_divide(F.col("off"), F.col("on")))


def dispersion_summary(grid: DataFrame) -> DataFrame:
    """One row: combinations, median and extremes of both dispersions, median, 5th percentile and least ratio, the share of
    ratios above 1 and the share of offline dispersions that an online one reaches."""
    most = grid.agg(F.max("on").alias("_on"))
    p = lambda c, q: F.percentile(c, F.lit(q))
    return grid.join(F.broadcast(most)).agg(
        F.count(F.lit(1)).alias("combinations"), p("off", 0.5).alias("off_median"), F.min("off").alias("off_min"), p("on", 0.5).alias("on_median"), F.max("on").alias("on_max"),
        p("ratio", 0.5).alias("ratio_median"), p("ratio", 0.05).alias("ratio_p5"), F.min("ratio").alias("ratio_min"),
        F.avg((F.col("ratio") > 1).cast("double")).alias("share_above_1"), F.avg((F.col("_on") >= F.col("off")).cast("double")).alias("share_overlap"),
    )


def set_gaps(means: DataFrame, pairs: Sequence[tuple[str, str]], marks: dict[tuple[str, str], Sequence[float]] | None = None) -> DataFrame:
    """(a, b, combinations, mean_gap, min_gap, max_gap, below): gaps \\|x - y\\| between all subsets' means of two societies.

    The product of the two distributions (25 million gaps for two times 5,005 sets) is never made: each x is merged into the
    sorted means of the other society, with their running sums.  ``below`` has for each mark the share of gaps under it.
    The other society's means are broadcast, at most ``MAX_MEANS`` of them."""
    spark, out = means.sparkSession, None
    for a, b in pairs:
        other = means.where(F.col("society") == b)
        if other.limit(MAX_MEANS + 1).count() > MAX_MEANS:
            raise ValueError(f"{b} has more than {MAX_MEANS} subsets")
        held = spark.sparkContext.broadcast(np.sort(other.select("mean").toArrow()["mean"].to_numpy()))
        limits = np.array((marks or {}).get((a, b), ()), float)

        def run(batches: Iterator[pa.RecordBatch], held=held, limits=limits) -> Iterator[pa.RecordBatch]:
            y = held.value
            sums = np.concatenate([[0.0], np.cumsum(y)])
            for batch in batches:
                x = batch.column(0).to_numpy()
                if not len(x) or not len(y):
                    continue
                at = np.searchsorted(y, x)
                gap = x * at - sums[at] + (sums[-1] - sums[at]) - x * (len(y) - at)
                least = np.minimum(np.abs(x - y[np.minimum(at, len(y) - 1)]), np.abs(x - y[np.maximum(at - 1, 0)]))
                most = np.maximum(np.abs(x - y[0]), np.abs(x - y[-1]))
                below = [int((np.searchsorted(y, x + t) - np.searchsorted(y, x - t, "right")).sum()) for t in limits]
                yield pa.RecordBatch.from_arrays([pa.array([len(x) * len(y)]), pa.array([float(gap.sum())]), pa.array([float(least.min())]), pa.array([float(most.max())]), pa.array([below], pa.list_(pa.int64()))], names=["n", "total", "least", "most", "under"])

        part = means.where(F.col("society") == a).select("mean").mapInArrow(run, "n long, total double, least double, most double, under array<long>")
        each = [F.sum(F.col("under")[k]) / F.sum("n") for k in range(len(limits))]
        part = part.agg(F.sum("n").alias("combinations"), (F.sum("total") / F.sum("n")).alias("mean_gap"), F.min("least").alias("min_gap"), F.max("most").alias("max_gap"), F.array(*each).cast("array<double>").alias("below"))
        part = part.select(F.lit(a).alias("a"), F.lit(b).alias("b"), "*")
        out = part if out is None else out.unionAll(part)
    return out
