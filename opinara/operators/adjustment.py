"""Comparing societies at equal topic similarity: density-ratio, strata and support weights, decompositions, LOESS.

Inputs are pair tables (society, similarity x, outcome y).  What SQL expresses stays in Spark; resampling of the at most
few hundred pairs of a society runs in numpy, one society a group.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from opinara.functions import stats

#: Pairs of a society; topics are few, so pairs are bounded.
MAX_PAIRS = 20_000


def bounded(pairs: DataFrame) -> DataFrame:
    if pairs.limit(MAX_PAIRS + 1).count() > MAX_PAIRS:
        raise ValueError(f"more than {MAX_PAIRS} topic pairs")
    return pairs


def density_ratio_weights(pairs: DataFrame, reference: str) -> DataFrame:
    """``pairs`` (society, x, y and others) with ``w``: the reference's density of x over the society's own; 1 for the reference.

    The densities are Gaussian kernel sums over the reference's and the society's own pairs, joined by society."""
    p = bounded(pairs)
    width = p.groupBy("society").agg(F.count(F.lit(1)).alias("n"), F.var_samp("x").alias("v")).select("society", (F.col("v") * F.pow(F.col("n").cast("double"), F.lit(-0.4))).alias("h2"), "n")
    ref = p.where(F.col("society") == reference).agg(F.array_sort(F.collect_list("x")).alias("ref"))
    ref = ref.join(width.where(F.col("society") == reference).select(F.col("h2").alias("ref_h2")))
    own = p.groupBy("society").agg(F.array_sort(F.collect_list("x")).alias("own")).join(width, "society")
    kernel = lambda points, h2, n: F.aggregate(points, F.lit(0.0), lambda s, v: s + F.exp(-(F.col("x") - v) * (F.col("x") - v) / (2 * h2))) / (n * F.sqrt(2 * np.pi * h2))
    w = kernel(F.col("ref"), F.col("ref_h2"), F.size("ref")) / F.greatest(kernel(F.col("own"), F.col("h2"), F.col("n")), F.lit(1e-300))
    w = F.when(F.col("society") == reference, F.lit(1.0)).otherwise(w)
    return p.join(F.broadcast(own), "society").join(F.broadcast(ref)).select(*p.columns, w.alias("w"))


def medium_weights(pairs: DataFrame, preferred: str, supported: bool = False) -> DataFrame:
    """(medium, reference, society, t1, t2, x, y, w): weights of sum 1 that give each society the similarities of its medium's
    reference, which is the preferred society if the medium has it, else the first by name; the reference's own pairs weigh the same.

    With ``supported`` only pairs that every society of the medium covers.  Pairs without medium, society, x or y are left out; a
    society whose x are all equal has no density and gets null weights."""
    own = bounded(pairs).where("medium is not null and society is not null and x is not null and y is not null").select("medium", "society", "t1", "t2", "x", "y")
    if supported:
        ends = own.groupBy("medium", "society").agg(F.min("x").alias("lo"), F.max("x").alias("hi")).groupBy("medium").agg(F.max("lo").alias("lo"), F.min("hi").alias("hi"))
        own = own.join(F.broadcast(ends), "medium").where(F.col("x").between(F.col("lo"), F.col("hi"))).drop("lo", "hi")
    spread = F.try_divide(F.var_samp("x"), F.pow(F.count(F.lit(1)).cast("double"), F.lit(0.4)))
    clouds = own.groupBy("medium", "society").agg(F.struct(F.array_sort(F.collect_list("x")).alias("points"), F.when(spread > 0, spread).alias("h2")).alias("cloud"))
    first = F.struct((F.col("society") != preferred).alias("other"), "society")
    refs = clouds.groupBy("medium").agg(F.min_by("society", first).alias("reference"), F.min_by("cloud", first).alias("ref"))
    rows = own.join(F.broadcast(clouds), ["medium", "society"]).join(F.broadcast(refs), "medium")  # as many points as pairs, which are bounded
    density = lambda c: F.aggregate(F.col(c).points, F.lit(0.0), lambda s, v: s + F.exp(-(F.col("x") - v) * (F.col("x") - v) / (2 * F.col(c).h2))) / (F.size(F.col(c).points) * F.sqrt(2 * np.pi * F.col(c).h2))
    w = F.when(F.col("society") == F.col("reference"), F.lit(1.0)).otherwise(density("ref") / F.when(density("cloud") < 1e-300, F.lit(1e-300)).otherwise(density("cloud")))
    rows = rows.select("medium", "reference", "society", "t1", "t2", "x", "y", w.alias("w"))
    total = Window.partitionBy("medium", "society")
    return rows.withColumn("w", F.try_divide(F.col("w"), F.sum("w").over(total)))


def density_ratio_mean(pairs: DataFrame, reference: str) -> DataFrame:
    """society, adjusted mean of y, effective sample size: each society reweighted to the reference's density of x."""
    rows = density_ratio_weights(pairs.select("society", "x", "y"), reference)
    return rows.groupBy("society").agg((F.sum(F.col("w") * F.col("y")) / F.sum("w")).alias("adjusted_mean"), (F.sum("w") * F.sum("w") / F.sum(F.col("w") * F.col("w"))).alias("ess"))


def reweighted_lines(pairs: DataFrame, reference: str) -> DataFrame:
    """(society, fit, n, intercept, slope, se, r2, p) of y on x, raw and, but for the reference, with the weights that give a society
    the reference's density of x."""
    from opinara.operators.correlation import wls

    rows = density_ratio_weights(pairs.select("society", "x", "y").where("x is not null and y is not null"), reference)
    raw = wls(rows, "x", "y", None, ("society",)).withColumn("fit", F.lit("raw"))
    return raw.unionByName(wls(rows.where(F.col("society") != reference), "x", "y", "w", ("society",)).withColumn("fit", F.lit("reweighted")))


def reweighted_similarity(pairs: DataFrame, reference: str) -> DataFrame:
    """(society, mean, sd, ess) of x under the weights that give a society the reference's density of x."""
    rows = density_ratio_weights(pairs.select("society", "x", "y").where("x is not null and y is not null"), reference)
    m = rows.groupBy("society").agg((F.sum(F.col("w") * F.col("x")) / F.sum("w")).alias("mean"), (F.sum("w") * F.sum("w") / F.sum(F.col("w") * F.col("w"))).alias("ess"))
    off = F.col("x") - F.col("mean")
    return rows.join(F.broadcast(m), "society").groupBy("society").agg(F.first("mean").alias("mean"), F.sqrt(F.sum(F.col("w") * off * off) / F.sum("w")).alias("sd"), F.first("ess").alias("ess"))


def strata_mean(pairs: DataFrame, reference: str, k: int = 5) -> DataFrame:
    """society, mean of y over the reference's quantile strata of x with the reference's shares; strata that a society
    lacks are left out and the rest scaled up (used_share)."""
    p = bounded(pairs)
    cuts = [i / k for i in range(k + 1)]
    edges = p.where(F.col("society") == reference).agg(F.percentile("x", F.array(*[F.lit(c) for c in cuts])).alias("e"))
    rows = p.join(F.broadcast(edges)).where((F.col("x") >= F.col("e")[0]) & (F.col("x") <= F.col("e")[k]))
    rows = rows.withColumn("stratum", F.least(F.size(F.filter("e", lambda e: e <= F.col("x"))) - 1, F.lit(k - 1)))
    per = rows.groupBy("society", "stratum").agg(F.count(F.lit(1)).alias("n"), F.avg("y").alias("m"))
    ref = per.where(F.col("society") == reference).select("stratum", (F.col("n") / F.sum("n").over(_all())).alias("share"))
    joined = per.join(ref, "stratum")
    return joined.groupBy("society").agg((F.sum(F.col("share") * F.col("m")) / F.sum("share")).alias("adjusted_mean"), F.sum("share").alias("used_share"))


def _all():
    from pyspark.sql import Window

    return Window.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)


def common_support(pairs: DataFrame) -> DataFrame:
    """Range of x that every society covers."""
    return pairs.groupBy("society").agg(F.min("x").alias("lo"), F.max("x").alias("hi")).agg(F.max("lo").alias("support_lo"), F.min("hi").alias("support_hi"))


def effective_size(rows: DataFrame, by: str, weight: str) -> DataFrame:
    w = F.col(weight)
    return rows.groupBy(by).agg(F.try_divide(F.sum(w) * F.sum(w), F.sum(w * w)).alias("ess"))


def decomposition(pairs: DataFrame, reference: str, methods: tuple[str, ...] = ("kde", "strata", "support"), draws: int = 500, seed: int = 0) -> DataFrame:
    """society, method, raw gap, its part due to similarity and the rest, with bootstrap limits of the rest."""
    p = bounded(pairs).select("society", "x", "y")
    ref = p.where(F.col("society") == reference).orderBy("x", "y").toPandas()

    def run(f: pd.DataFrame) -> pd.DataFrame:
        f = f.sort_values(["x", "y"])
        a, b = ref[["x", "y"]].to_numpy(), f[["x", "y"]].to_numpy()
        rng = np.random.default_rng(seed)
        out = []
        for m in methods:
            d = stats.split_gap(m, a[:, 0], a[:, 1], b[:, 0], b[:, 1])
            reps = []
            for _ in range(draws):
                i, j = rng.integers(0, len(a), len(a)), rng.integers(0, len(b), len(b))
                try:
                    reps.append(stats.split_gap(m, a[i, 0], a[i, 1], b[j, 0], b[j, 1])["society"])
                except (ZeroDivisionError, FloatingPointError):
                    continue
            lo, hi = np.nanquantile(reps, [0.025, 0.975]) if reps else (np.nan, np.nan)
            out.append({"society": f["society"].iloc[0], "method": m, "raw": d["raw"], "by_similarity": d["similarity"], "by_society": d["society"], "society_lo": float(lo), "society_hi": float(hi)})
        return pd.DataFrame(out)

    return p.where(F.col("society") != reference).groupBy("society").applyInPandas(run, "society string, method string, raw double, by_similarity double, by_society double, society_lo double, society_hi double")


def loess_curve(pairs: DataFrame, span: float = 0.5, points: int = 25) -> DataFrame:
    """society, x, fit: a local-linear curve of y on x."""

    def run(f: pd.DataFrame) -> pd.DataFrame:
        f = f.sort_values(["x", "y"])
        at = np.linspace(f["x"].min(), f["x"].max(), points)
        return pd.DataFrame({"society": f["society"].iloc[0], "x": at, "fit": stats.loess(f["x"].to_numpy(), f["y"].to_numpy(), at, span)})

    return bounded(pairs).select("society", "x", "y").groupBy("society").applyInPandas(run, "society string, x double, fit double")


def loess_at_pairs(pairs: DataFrame, span: float = 0.4) -> DataFrame:
    """(society, t1, t2, fit): a society's local-linear curve of y on x at each of its own pairs."""

    def run(f: pd.DataFrame) -> pd.DataFrame:
        x = f["x"].to_numpy(float)
        return f[["society", "t1", "t2"]].assign(fit=stats.loess(x, f["y"].to_numpy(float), x, span))

    return bounded(pairs).select("society", "t1", "t2", "x", "y").where("x is not null and y is not null").groupBy("society").applyInPandas(run, "society string, t1 string, t2 string, fit double")


def similarity_summary(pairs: DataFrame) -> DataFrame:
    """Per society: number, mean, population sd, extremes and quartiles of the similarities of its pairs."""
    q = lambda p: F.percentile("x", F.lit(p))
    return pairs.groupBy("society").agg(F.count("x").alias("pairs"), F.avg("x").alias("mean"), F.stddev_pop("x").alias("sd"), F.min("x").alias("least"), q(0.25).alias("q25"), q(0.5).alias("median"), q(0.75).alias("q75"), F.max("x").alias("most"))


def on_support(pairs: DataFrame) -> DataFrame:
    """Pairs whose similarity every society covers."""
    return pairs.join(F.broadcast(common_support(pairs)), F.col("x").between(F.col("support_lo"), F.col("support_hi"))).drop("support_lo", "support_hi")  # one row


def level_summary(pairs: DataFrame, reference: str, draws: int = 2000, seed: int = 0) -> DataFrame:
    """(what, society, value, lo, hi): each society's mean y, its ratio to and gap from the reference's, and over all
    societies the dispersion (population sd of mean Fisher z) and the range of means; limits by a bootstrap that resamples
    each society's pairs by itself.  Societies are few and have one row a pair of topics."""
    f = bounded(pairs).select("society", "y").where("y is not null").orderBy("society", "y").toPandas()
    rng = np.random.default_rng(seed)
    names = sorted(f["society"].unique())
    means, zs = {}, {}
    for s in names:
        y = f.loc[f["society"] == s, "y"].to_numpy(float)
        at = np.vstack([np.arange(len(y)), rng.integers(0, len(y), (draws, len(y)))])  # the first draw is the sample
        z = np.arctanh(np.clip(y, 0, 1 - 1e-12))
        means[s], zs[s] = y[at].mean(1), z[at].mean(1)
    rows = []

    def add(what: str, society: str, v: np.ndarray) -> None:
        lo, hi = np.quantile(v[1:], [0.025, 0.975])
        rows.append((what, society, float(v[0]), float(lo), float(hi)))

    for s in names:
        add("mean", s, means[s])
        if s != reference and reference in means:
            add("ratio", s, means[reference] / means[s])
            add("gap", s, means[reference] - means[s])
            add("z_gap", s, zs[reference] - zs[s])
    if names:
        add("dispersion", "all", np.std([zs[s] for s in names], axis=0))
        add("range", "all", np.ptp([means[s] for s in names], axis=0))
    return pairs.sparkSession.createDataFrame(rows, "what string, society string, value double, lo double, hi double")


def repairing(pairs: DataFrame, first: str, second: str, draws: int = 5000, seed: int = 0) -> DataFrame:
    """One row of ``stats.repairing_test`` for two societies' pair values (t1, t2, y); topics that both have."""
    rows = bounded(pairs).where(F.col("society").isin(first, second) & F.col("y").isNotNull()).select("society", "t1", "t2", "y").collect()
    maps = {s: {frozenset((r.t1, r.t2)): r.y for r in rows if r.society == s} for s in (first, second)}
    names = sorted({t for k in maps[first] for t in k} & {t for k in maps[second] for t in k})
    out = stats.repairing_test(maps[first], maps[second], names, draws, seed)
    return pairs.sparkSession.createDataFrame([tuple(out.values())], "concepts int, pairs int, diff double, diff_random double, p_diff double, corr double, corr_random double, p_corr double")


def loess_band(pairs: DataFrame, span: float = 0.5, points: int = 25, draws: int = 200, seed: int = 0) -> DataFrame:
    """society, x, mean, lo, hi of bootstrapped robust curves; societies of fewer than four pairs have none."""

    def run(f: pd.DataFrame) -> pd.DataFrame:
        f = f.sort_values(["x", "y"])
        x, y, rng = f["x"].to_numpy(), f["y"].to_numpy(), np.random.default_rng(seed)
        if len(f) < 4:
            return pd.DataFrame({"society": [], "x": [], "mean": [], "lo": [], "hi": []})
        at = np.linspace(x.min(), x.max(), points)
        reps = np.array([stats.loess(x[i], y[i], at, span, robust=3) for i in (rng.integers(0, len(x), len(x)) for _ in range(draws))])
        lo, hi = np.nanquantile(reps, [0.025, 0.975], axis=0)
        return pd.DataFrame({"society": f["society"].iloc[0], "x": at, "mean": np.nanmean(reps, axis=0), "lo": lo, "hi": hi})

    return bounded(pairs).select("society", "x", "y").groupBy("society").applyInPandas(run, "society string, x double, mean double, lo double, hi double")


def shapley(pairs: DataFrame, reference: str) -> DataFrame:
    """Shares of R2 of society dummies and of similarity."""
    f = bounded(pairs).select("society", "x", "y").orderBy("society", "x", "y").toPandas()
    levels = [s for s in sorted(f["society"].unique()) if s != reference]
    parts = {"society": np.column_stack([(f["society"] == s).to_numpy(float) for s in levels]), "similarity": f[["x"]].to_numpy()}
    return pairs.sparkSession.createDataFrame([{k: float(v) for k, v in stats.shapley_r2(f["y"].to_numpy(), parts).items()}], "society double, similarity double, total double")
