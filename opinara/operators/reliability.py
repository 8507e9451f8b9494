"""Measurement error added to sums of products instead of rows.

Rows with the same observed topics form a group of complete rows.  Of Gaussian errors E on a group's rows X, only 1'E, X'E and E'E enter a
correlation, and these can be drawn as they are distributed: the part of E in the span of [1, X] is a matrix of normals in an
orthonormal basis of that span, and the rest gives a Wishart matrix.  So a draw costs as much as the topics and patterns
there are, whatever the number of rows, and no row is ever copied."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from opinara.operators.dimension import topic_arrays

#: Topics at most: the patterns of observed topics number up to 2 ** topics.
MAX_TOPICS = 20
#: Draws of one task.
DRAWS = 50


class Patterns:
    """Counts, sums and products of the rows of one source, by pattern of observed topics."""

    def __init__(self, rows: list, k: int):
        self.k, self.groups = k, []
        n, s, q = np.zeros(k), np.zeros(k), np.zeros(k)
        for r in rows:
            at = np.array([i for i in range(k) if r.mask >> i & 1])
            products = np.zeros((len(at) + 1, len(at) + 1))
            up = np.triu_indices(len(at) + 1)
            products[up] = r.sums
            products += np.triu(products, 1).T
            self.groups.append((at, products))
            n[at] += products[0, 0]
            s[at] += products[0, 1:]
            q[at] += np.diag(products)[1:]
        with np.errstate(invalid="ignore", divide="ignore"):
            self.variance = np.where(n > 0, q / n - (s / n) ** 2, 0.0)

    def mean_r(self, reliability: float, rng: np.random.Generator | None) -> float:
        """Mean \\|r\\| over all pairs of topics, pairwise complete, after errors that leave this reliability (none without rng)."""
        k = self.k
        n, left, square, cross = np.zeros((k, k)), np.zeros((k, k)), np.zeros((k, k)), np.zeros((k, k))
        for at, products in self.groups:
            p = products
            if rng is not None:
                p = noisy(p, np.sqrt(np.maximum(self.variance[at], 0) * (1 - reliability) / reliability), rng)
            both = np.ix_(at, at)
            n[both] += p[0, 0]
            left[both] += p[0, 1:][:, None]
            square[both] += np.diag(p)[1:][:, None]
            cross[both] += p[1:, 1:]
        i, j = np.triu_indices(k, 1)
        with np.errstate(invalid="ignore", divide="ignore"):
            m = n[i, j]
            cov = cross[i, j] / m - left[i, j] * left[j, i] / m**2
            r = cov / np.sqrt((square[i, j] / m - (left[i, j] / m) ** 2) * (square[j, i] / m - (left[j, i] / m) ** 2))
        r = np.abs(r[np.isfinite(r)])
        return float(r.mean()) if len(r) else float("nan")


def noisy(products: np.ndarray, sd: np.ndarray, rng: np.random.Generator) -> np.ndarray:
    """Products of [1, X + E] for rows whose [1, X] have the given ones, and errors of these standard deviations."""
    k, n = len(sd), int(round(products[0, 0]))
    values, vectors = np.linalg.eigh(products)
    kept = values > max(values[-1], 0) * 1e-12
    root = (vectors[:, kept] * np.sqrt(values[kept])).T  # [1, X] = Q @ root for an orthonormal Q
    rank = min(len(root), n)
    z = rng.standard_normal((len(root), k))
    rest = n - rank
    if rest >= k:  # Bartlett: a triangle of normals and roots of chi squares
        a = np.tril(rng.standard_normal((k, k)), -1)
        a[np.diag_indices(k)] = np.sqrt(rng.chisquare(rest - np.arange(k)))
        wishart = a @ a.T
    else:
        e = rng.standard_normal((rest, k))
        wishart = e.T @ e
    out = products.copy()
    mixed = root.T @ z * sd  # [1, X]'E
    out[:, 1:] += mixed
    out[1:, :] += mixed.T
    out[1:, 1:] += (z.T @ z + wishart) * np.outer(sd, sd)
    return out


def pattern_sums(values: DataFrame, topics: Sequence[str], key: str = "user_id", by: str = "source") -> DataFrame:
    """(source, mask, sums): of the rows of each source and pattern of observed topics, the products of (1, values), upper triangle."""
    if len(topics) > MAX_TOPICS:
        raise ValueError(f"more than {MAX_TOPICS} topics")
    names = sorted(topics)
    owned = values.withColumn("_key", F.struct(by, key))
    rows = topic_arrays(owned.select("_key", "topic", "value"), names, "_key").select(F.col(f"_key.{by}").alias("source"), "x")
    k = len(names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from opinara.functions.arrays import list_matrix

        held: dict = {}
        for b in batches:
            sources, x = np.array(b.column(0).to_pylist(), object), list_matrix(b.column(1), k)
            masks = (~np.isnan(x)) @ (1 << np.arange(k))
            for s in set(sources.tolist()):
                for m in np.unique(masks[sources == s]):
                    at = np.flatnonzero(m >> np.arange(k) & 1)
                    own = np.column_stack([np.ones(int(((sources == s) & (masks == m)).sum())), x[(sources == s) & (masks == m)][:, at]])
                    p = (own.T @ own)[np.triu_indices(len(at) + 1)]
                    held[s, int(m)] = held[s, int(m)] + p if (s, int(m)) in held else p
        if held:
            yield pa.RecordBatch.from_arrays([pa.array([s for s, _ in held]), pa.array([m for _, m in held]), pa.array([p.tolist() for p in held.values()], pa.list_(pa.float64()))], names=["source", "mask", "sums"])

    parts = rows.mapInArrow(run, "source string, mask long, sums array<double>").select("source", "mask", F.posexplode("sums").alias("pos", "v"))
    each = parts.groupBy("source", "mask", "pos").agg(F.sum("v").alias("v"))
    return each.groupBy("source", "mask").agg(F.array_sort(F.collect_list(F.struct("pos", "v"))).alias("x")).select("source", "mask", F.col("x.v").alias("sums"))


def reliability_grid(values: DataFrame, topics: Sequence[str], a: str, b: str, cells: Sequence[tuple[float, float, int]], seed: int = 0, key: str = "user_id") -> DataFrame:
    """(rho_a, rho_b, draws, mean_a, mean_b, gap, gap_lo, gap_hi, ratio, ratio_lo, ratio_hi): mean \\|r\\| of two sources, its gap and ratio, when
    errors lower every topic's reliability to rho; means over the draws and 95 % ranges.

    ``values`` is (source, key, topic, value); ``cells`` gives (rho_a, rho_b, draws); a cell (1, 1, 1) is the data without errors."""
    spark = values.sparkSession
    sums = pattern_sums(values.where(F.col("source").isin(a, b)), topics, key).collect()  # at most 2 ** topics patterns a source
    k = len(topics)
    shared = spark.sparkContext.broadcast({s: Patterns([r for r in sums if r.source == s], k) for s in (a, b)})
    jobs = [(c, float(ra), float(rb), lo, min(lo + DRAWS, n)) for c, (ra, rb, n) in enumerate(cells) for lo in range(0, n, DRAWS)]
    tasks = spark.createDataFrame(jobs, "cell int, rho_a double, rho_b double, lo int, hi int").repartition(max(1, min(len(jobs), 4 * spark.sparkContext.defaultParallelism)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shared.value
        for batch in batches:
            for cell, ra, rb, lo, hi in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                out = []
                for d in range(lo, hi):
                    x, y = (own[s].mean_r(rho, np.random.default_rng([seed, cell, d, side]) if rho < 1 else None) for side, (s, rho) in enumerate(((a, ra), (b, rb))))
                    out.append((cell, ra, rb, x, y))
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), (pa.int32(), *[pa.float64()] * 4), strict=True)], names=["cell", "rho_a", "rho_b", "x", "y"])

    drawn = tasks.mapInArrow(run, "cell int, rho_a double, rho_b double, x double, y double").withColumn("gap", F.col("x") - F.col("y")).withColumn("ratio", F.try_divide("x", "y"))
    limits = [F.percentile(c, F.lit(q)).alias(f"{c}_{n}") for c in ("gap", "ratio") for n, q in (("lo", 0.025), ("hi", 0.975))]
    found = drawn.groupBy("cell", "rho_a", "rho_b").agg(F.count(F.lit(1)).cast("int").alias("draws"), F.avg("x").alias("mean_a"), F.avg("y").alias("mean_b"), F.avg("gap").alias("mean_gap"), F.avg("ratio").alias("mean_ratio"), *limits)
    return found.select("rho_a", "rho_b", "draws", "mean_a", "mean_b", F.col("mean_gap").alias("gap"), "gap_lo", "gap_hi", F.col("mean_ratio").alias("ratio"), "ratio_lo", "ratio_hi")


def study_cells(rhos: Sequence[float] = (0.9, 0.7, 0.5, 0.3), draws: int = 500) -> list[tuple[float, float, int]]:
    """The cells of the study: no error; equal reliabilities; and for each reliability of the second source all lower ones of the first in
    steps of 0.05, with a tenth of the draws."""
    equal = [(r, r, draws) for r in rhos]
    unequal = [(round(0.05 * s, 2), r, max(50, draws // 10)) for r in rhos for s in range(1, 21) if round(0.05 * s, 2) < r]
    return [(1.0, 1.0, 1), *equal, *unequal]
