"""Simulated panels: linear manifolds with missing entries, and the missingness grid."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from opinara.functions import arrays, hashes, stats


#: Rows of a simulated matrix that are held at once.
PART = 100_000
SUMMED = 4096
#: Draws of a value whose noise is computed in one call, for a batch of rows.
DRAWS = 100


def manifold_parts(l: int, rows: int, n: int, missing: float, seed, pattern: str = "random") -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(values, 0 where missing; 1 where observed) of ``rows`` points of a random n-dimensional subspace of l dimensions, in
    runs of at most ``PART`` rows.

    Entries are missing at random, or ("rows") are observed by chance in proportion to an exponential number of their row
    and a factor from 0.5 to 1.5 of their column, scaled until a share ``1 - missing`` is observed."""
    if pattern not in ("random", "rows"):
        raise ValueError(f"unknown pattern {pattern!r}")
    rng = np.random.default_rng(seed)
    basis = np.linalg.qr(rng.normal(size=(l, n)))[0].T.astype(np.float32)
    if pattern == "rows":
        active = rng.exponential(size=rows)
        asked = rng.permutation(np.linspace(0.5, 1.5, l))
        scale = observation_scale(active, asked, 1 - missing)
    for s in range(0, rows, PART):
        m = min(PART, rows - s)
        x = rng.standard_normal((m, n), np.float32) @ basis
        share = 1 - missing if pattern == "random" else scale * np.outer(active[s : s + m], asked).astype(np.float32)
        seen = (rng.random(x.shape, np.float32) < share).astype(np.float32)
        x *= seen
        yield x, seen


def observation_scale(active: np.ndarray, asked: np.ndarray, share: float) -> float:
    """The factor at which min(factor * row * column, 1) is ``share`` on average."""
    order = np.sort(active)
    total = np.concatenate([[0.0], np.cumsum(order)])

    def mean(f: float) -> float:
        full = np.searchsorted(order, 1 / (f * asked))  # rows below are not cut at 1
        return float((f * asked * total[full] + len(order) - full).sum() / (len(order) * len(asked)))

    if share >= 1:
        return float("inf")
    lo, hi = 0.0, 1.0
    while mean(hi) < share:
        hi *= 2
    for _ in range(60):
        lo, hi = ((lo + hi) / 2, hi) if mean((lo + hi) / 2) < share else (lo, (lo + hi) / 2)
    return hi


def manifold(l: int, rows: int, n: int, missing: float, seed: int, pattern: str = "random") -> np.ndarray:
    """The same as one matrix with nan where an entry is missing."""
    return np.concatenate([np.where(seen > 0, x, np.nan) for x, seen in manifold_parts(l, rows, n, missing, seed, pattern)])


def observed_spectrum(parts: Iterable[tuple[np.ndarray, np.ndarray]]) -> dict:
    """Spectrum of the pairwise-available covariance of a matrix given in runs of rows (values, observed), with what was
    observed.  Products are summed in single precision within a few thousand rows, in double across them."""
    count = cross = total = seen = size = 0
    for whole, observed in parts:
        for s in range(0, len(whole), SUMMED):
            v, b = whole[s : s + SUMMED], observed[s : s + SUMMED]
            count, cross, total = count + (b.T @ b).astype(float), cross + (v.T @ v).astype(float), total + v.sum(0, dtype=float)
            seen, size = seen + float(b.sum(dtype=float)), size + b.size
    cov = stats.available_covariance(cross, count, total / np.maximum(np.diag(count), 1))
    return {"observed_share": float(seen / size), "min_pair_count": int(count.min()), "negative_eigenvalues": int((np.linalg.eigvalsh(cov) < 0).sum()), **stats.spectrum(cov)}


def missingness_grid(spark: SparkSession, l: int = 20, sizes=(1000, 10000), missing=(0.0, 0.5, 0.9), dims=(2, 5), reps: int = 3, patterns=("random", "rows"), seed: int = 0) -> DataFrame:
    """One row per simulated matrix; cells are independent and dealt out over the cluster."""
    cells = [(p, l, s, m, n, r) for p in patterns for s in sizes for m in missing for n in dims for r in range(reps)]
    jobs = spark.createDataFrame(cells, "pattern string, l int, n_rows long, missing double, n int, rep int").repartition(max(1, len(cells)))

    def run(frames):
        for f in frames:
            out = []
            for c in f.itertuples(index=False):
                s = [seed, patterns.index(c.pattern), c.l, c.n_rows, round(c.missing * 1000), c.n, c.rep]
                out.append(c._asdict() | observed_spectrum(manifold_parts(c.l, c.n_rows, c.n, c.missing, s, c.pattern)))
            yield pd.DataFrame(out)

    return jobs.mapInPandas(run, "pattern string, l int, n_rows long, missing double, n int, rep int, observed_share double, min_pair_count long, negative_eigenvalues int, pr double, erank double, srank double")


def row_scale(share: float) -> float:
    """The factor s at which min(1, s * a) is ``share`` on average for exponential a: s * (1 - exp(-1 / s))."""
    lo, hi = 0.0, 1e6
    for _ in range(200):
        mid = (lo + hi) / 2
        lo, hi = (mid, hi) if mid * (1 - np.exp(-1 / max(mid, 1e-300))) < share else (lo, mid)
    return hi


def thinned(values: DataFrame, missing: Iterable[float], reps: int, seed: int = 0) -> DataFrame:
    """``values`` (user_id, topic, value) with a share of the observed entries taken away, for each pattern, share and repetition.

    Pattern "random": every entry by itself; "rows": entries of a user in proportion to an exponential number of the user, at most
    all.  What stays is decided by hashes, so it is the same on every run; a repetition's entries are nested in the share: what a
    lower share takes away, a higher one does too."""
    u = lambda *parts: (F.conv(F.substring(F.md5(F.concat_ws(":", F.lit(str(seed)), *parts)), 1, 10), 16, 10).cast("double") + 0.5) / float(1 << 40)
    shares = F.array(*[F.struct(F.lit(float(m)).alias("missing"), F.lit(row_scale(1 - m)).alias("scale")) for m in missing])
    # Users are dealt out before entries are copied, so that sums by cell and user need no shuffle of the copies; an entry's
    # hashes are the same for all shares and patterns.
    rows = values.repartition("user_id").withColumn("rep", F.explode(F.sequence(F.lit(0), F.lit(reps - 1))))
    entry = u(F.lit("e"), F.col("rep").cast("string"), F.col("user_id").cast("string"), F.col("topic"))
    active = -F.log(u(F.lit("u"), F.col("rep").cast("string"), F.col("user_id").cast("string")))
    rows = rows.withColumns({"_e": entry, "_a": active}).withColumn("_m", F.explode(shares)).withColumn("pattern", F.explode(F.array(F.lit("random"), F.lit("rows"))))
    kept = F.when(F.col("pattern") == "random", 1 - F.col("_m.missing")).otherwise(F.least(F.lit(1.0), F.col("_m.scale") * F.col("_a")))
    return rows.where(F.col("_e") < kept).select("pattern", F.col("_m.missing").alias("missing"), "rep", "user_id", "topic", "value")


def cell_means(grid: DataFrame) -> DataFrame:
    return grid.groupBy("pattern", "n_rows", "missing", "n").agg(*[F.avg(c).alias(c) for c in ("pr", "erank", "srank")])


def variation(cells: DataFrame, axis: str, value: str = "pr") -> DataFrame:
    """Coefficient of variation of the cell means along one axis at fixed others."""
    rest = [c for c in ("pattern", "n_rows", "missing", "n") if c != axis]
    return cells.groupBy(*rest).agg(F.try_divide(F.stddev_samp(value), F.avg(value)).alias("cv"))


def direction(cells: DataFrame, value: str = "pr") -> DataFrame:
    """Change of a metric from the lowest to the highest missingness at fixed pattern, rows and dimension."""
    per = cells.groupBy("pattern", "n_rows", "n").agg(F.min_by(value, "missing").alias("at_lowest"), F.max_by(value, "missing").alias("at_highest"))
    return per.withColumn("relative_change", F.try_divide(F.col("at_highest") - F.col("at_lowest"), F.col("at_lowest")))


def dimension_error(cells: DataFrame, value: str = "pr") -> DataFrame:
    """Mean absolute error of a metric against the true dimension, and their Pearson and rank correlations, by pattern, rows
    and missingness."""
    from opinara.operators.correlation import safe_corr, spearman

    keys = ("pattern", "n_rows", "missing")
    error = cells.groupBy(*keys).agg(F.avg(F.abs(F.col(value) - F.col("n"))).alias("mae"), safe_corr(F.col("n").cast("double"), F.col(value)).alias("pearson"))
    return error.join(spearman(cells, "n", value, keys).select(*keys, F.col("rho").alias("spearman")), list(keys))


def noisy_reliability(values: DataFrame, reliability: float, draws: int, seed: int = 0) -> DataFrame:
    """Values with normal noise of the variance that lowers each topic's reliability to a target, once per draw.

    The noise is hashed from seed, draw, topic and user, so it is the same on every run and every cluster; values of no user get none
    and are null."""
    var = values.groupBy("topic").agg(F.var_samp("value").alias("_v"))

    size = DRAWS

    @F.arrow_udf("array<double>")
    def normals(first: pa.Array, text: pa.Array) -> pa.Array:
        start = first.to_numpy()
        order = np.argsort(start, kind="stable")
        start, text = start[order], text.take(pa.array(order))
        lists = [arrays.matrix_lists(hashes.hashed_normals(seed, range(start[s], min(start[s] + size, draws + 1)), text[s:e])) for s, e in arrays.runs(start[:, None])]
        return pa.concat_arrays(lists).take(pa.array(np.argsort(order))) if lists else pa.array([], pa.list_(pa.float64()))

    noise = F.when(F.col("user_id").isNotNull(), F.sqrt(F.col("_v") * F.lit((1 - reliability) / reliability)))
    noisy = values.join(F.broadcast(var), "topic").withColumn("_sd", noise).drop("_v")
    # A row carries the noise of a run of draws as a list, so that texts of many rows and draws are hashed in one call.
    noisy = noisy.withColumn("_first", F.explode(F.sequence(F.lit(1), F.lit(draws), F.lit(size))))
    noisy = noisy.withColumn("_z", normals("_first", F.concat_ws(":", "topic", F.col("user_id").cast("string"))))
    # No list is empty; a plain posexplode would be preceded by a filter that computes them all once more.
    noisy = noisy.select("*", F.posexplode_outer("_z").alias("_k", "_one"))
    return noisy.withColumns({"value": F.col("value") + F.col("_sd") * F.col("_one"), "draw": F.col("_first") + F.col("_k")}).drop("_sd", "_first", "_z", "_k", "_one")
