"""What pictures of two topics or of a panel's main directions are drawn from: correlation ellipses, stretched clouds, principal
components of complete rows, covariances rebuilt from stored components."""

from __future__ import annotations

import math
from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from opinara.operators.correlation import safe_corr
from opinara.operators.spectral import listwise_covariance, matrix


def _both(points: DataFrame, by: Sequence[str], x: str, y: str) -> DataFrame:
    return points.where(F.col(x).isNotNull() & F.col(y).isNotNull()).groupBy(*by).agg(F.count(F.lit(1)).alias("n"), safe_corr(F.col(x), F.col(y)).alias("r"), *[f(c).alias(f"_{k}{i}") for i, c in enumerate((x, y)) for k, f in (("m", F.avg), ("s", F.stddev_pop))]).where("n >= 5 and r is not null")


def _axis(sign: int) -> Column:
    """Variance of standardised points along the diagonal (1) or across it (-1)."""
    return F.greatest((1 + sign * F.col("r")) * F.col("n") / (F.col("n") - 1), F.lit(1e-12))


def ellipses(points: DataFrame, by: Sequence[str], x: str = "x", y: str = "y", stretch: float = 1.0) -> DataFrame:
    """(by..., n, r, angle, major, minor): the ellipse of each group's standardised points; its axes are the roots of the variances
    along them, to the power ``stretch``.

    Points that lack x or y are left out; groups of fewer than five points, or without spread in x or y, have no row.  The major
    axis lies at 45 degrees, for negative correlations at -45."""
    m = _both(points, by, x, y)
    most, least = F.greatest(_axis(1), _axis(-1)), F.least(_axis(1), _axis(-1))
    return m.select(*by, "n", "r", F.when(F.col("r") < 0, -45.0).otherwise(45.0).alias("angle"), F.pow(most, F.lit(stretch / 2)).alias("major"), F.pow(least, F.lit(stretch / 2)).alias("minor"))


def outlines(found: DataFrame, by: Sequence[str], sigmas: float = 2.0, points: int = 64) -> DataFrame:
    """(by..., point, x, y): places round each of ``ellipses``, from the end of the major axis on."""
    at = found.withColumn("point", F.explode(F.sequence(F.lit(0), F.lit(points - 1))))
    t, a = F.col("point") * F.lit(2 * math.pi / points), F.radians("angle")
    u, v = sigmas * F.col("major") * F.cos(t), sigmas * F.col("minor") * F.sin(t)
    return at.select(*by, "point", (u * F.cos(a) - v * F.sin(a)).alias("x"), (u * F.sin(a) + v * F.cos(a)).alias("y"))


def stretched_points(points: DataFrame, by: Sequence[str], x: str = "x", y: str = "y", stretch: float = 1.0) -> DataFrame:
    """``points`` with ``zx`` and ``zy``: standardised and stretched along the two diagonals, so that their ellipse is that of
    ``ellipses`` with the same ``stretch``.  Points of groups without an ellipse are left out."""
    keys = [f"_k{i}" for i in range(len(by))]
    m = _both(points, by, x, y).withColumnsRenamed(dict(zip(by, keys, strict=True)))
    cond = F.col(x).isNotNull() & F.col(y).isNotNull()
    for c, k in zip(by, keys, strict=True):
        cond = cond & F.col(c).eqNullSafe(F.col(k))
    along, across = (F.pow(_axis(s), F.lit((stretch - 1) / 2)) for s in (1, -1))
    p, q = (along + across) / 2, (along - across) / 2
    u, v = (F.col(x) - F.col("_m0")) / F.col("_s0"), (F.col(y) - F.col("_m1")) / F.col("_s1")
    return points.join(m, cond).select(*points.columns, (p * u + q * v).alias("zx"), (q * u + p * v).alias("zy"))


def listwise_components(wide: DataFrame, columns: Sequence[str]) -> DataFrame:
    """(component, eigenvalue, share, loadings, n, means) of the rows without a missing value, by falling eigenvalue.

    The covariance is one aggregate of the rows; its K x K numbers are decomposed in one task.  Of a component and its opposite the
    one whose heaviest loading is positive is given.  Fewer than two complete rows give no component."""
    names = list(columns)
    ok = wide.dropna("any", subset=names)
    moments = ok.agg(F.count(F.lit(1)).alias("n"), F.map_from_arrays(F.array(*[F.lit(c) for c in names]), F.array(*[F.avg(F.col(c)).cast("double") for c in names])).alias("means"))

    def finish(f: pd.DataFrame) -> pd.DataFrame:
        if f["cov"].isna().any():
            return pd.DataFrame({"component": [], "eigenvalue": [], "share": [], "loadings": pd.Series([], dtype=object)})
        values, vectors = np.linalg.eigh(matrix(f, "cov", names))
        values, vectors = values[::-1], vectors[:, ::-1]
        heavy = vectors[np.abs(vectors).argmax(0), np.arange(len(names))]
        vectors = vectors * np.where(heavy < 0, -1.0, 1.0)
        total = values.sum()
        return pd.DataFrame({"component": np.arange(1, len(names) + 1), "eigenvalue": values, "share": values / total if total > 0 else 0.0, "loadings": [dict(zip(names, map(float, v), strict=True)) for v in vectors.T]})

    found = listwise_covariance(wide, names).groupBy().applyInPandas(finish, "component int, eigenvalue double, share double, loadings map<string,double>")
    return found.join(F.broadcast(moments))  # one row


def listwise_scores(wide: DataFrame, columns: Sequence[str], components: DataFrame, key: Sequence[str]) -> DataFrame:
    """(key..., component, score) of each row without a missing value on each of ``components``."""
    names = list(columns)
    pick = lambda m: F.array(*[F.try_element_at(F.col(m), F.lit(c)) for c in names])
    # One row: K numbers for each component.
    held = components.select("component", pick("loadings").alias("v"), pick("means").alias("m")).agg(F.array_sort(F.collect_list(F.struct("component", "v", "m"))).alias("_c"))
    rows = wide.dropna("any", subset=names).select(*key, F.array(*[F.col(c).cast("double") for c in names]).alias("_x")).join(F.broadcast(held))
    flat = rows.select(*key, "_x", F.explode("_c").alias("_p"))
    off = F.zip_with("_x", F.col("_p.m"), lambda a, b: a - b)
    return flat.select(*key, F.col("_p.component").alias("component"), F.aggregate(F.zip_with(off, F.col("_p.v"), lambda a, b: a * b), F.lit(0.0), lambda s, v: s + v).alias("score"))


def rebuilt_covariance(report: DataFrame, by: Sequence[str] = ("year",)) -> DataFrame:
    """(by..., t1 <= t2, cov): the covariance that a loading report with all its components came from."""
    entries = F.array_sort(F.map_entries("loadings"))
    one = report.select(*by, "component", "eigenvalue", F.posexplode(entries).alias("i", "a"), entries.alias("e"))
    two = one.select(*by, "eigenvalue", "a", F.explode(F.slice("e", F.col("i") + 1, F.size("e") - F.col("i"))).alias("b"))
    return two.groupBy(*by, F.col("a.key").alias("t1"), F.col("b.key").alias("t2")).agg(F.sum(F.col("eigenvalue") * F.col("a.value") * F.col("b.value")).alias("cov"))
