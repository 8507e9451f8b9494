"""Effective dimensionality: pairwise-available covariances, spectra and bootstraps.

Spark reduces N users to the K x K sums (counts, cross sums, column sums); numpy finishes K x K.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from opinara.functions import stats

#: Topics of a bootstrap: draws times the square of them are held by a task.
MAX_TOPICS = 200
SPECTRUM = "pr double, erank double, srank double"


def cross_sums(values: DataFrame, by: tuple[str, ...] = (), key: str = "user_id", weight: str | None = None) -> DataFrame:
    """(by, t1 <= t2, n, sxy) and, on the diagonal, sx: what the covariance needs, from values (key, topic, value)."""
    w = F.lit(1.0) if weight is None else F.col(weight).cast("double")
    own = values.where(F.col("value").isNotNull()).withColumn("_w", w).groupBy(*by, key).agg(F.array_sort(F.collect_list(F.struct("topic", "value", "_w"))).alias("v"))
    first = own.select(*by, "v", F.posexplode("v").alias("i", "a"))
    pairs = first.select(*by, "a", F.explode(F.slice("v", F.col("i") + 1, F.size("v") - F.col("i"))).alias("b"))
    x, y, wt = F.col("a.value"), F.col("b.value"), F.col("a._w")
    same = F.col("a.topic") == F.col("b.topic")
    return pairs.groupBy(*by, F.col("a.topic").alias("t1"), F.col("b.topic").alias("t2")).agg(F.sum(wt).alias("n"), F.sum(wt * x * y).alias("sxy"), F.sum(F.when(same, wt * x)).alias("sx"))


def available_covariance(values: DataFrame, by: tuple[str, ...] = (), key: str = "user_id") -> DataFrame:
    """(by, t1 <= t2, n, cov) with each topic's own mean over all its rows."""
    sums = cross_sums(values, by, key)
    mean = sums.where("t1 = t2").select(*by, F.col("t1").alias("_t"), (F.col("sx") / F.col("n")).alias("_m"))
    one = mean.select(*by, F.col("_t").alias("t1"), F.col("_m").alias("m1"))
    two = mean.select(*by, F.col("_t").alias("t2"), F.col("_m").alias("m2"))
    cov = F.when(F.col("n") > 1, (F.col("sxy") - F.col("n") * F.col("m1") * F.col("m2")) / (F.col("n") - 1)).otherwise(0.0)
    return sums.join(one, [*by, "t1"]).join(two, [*by, "t2"]).select(*by, "t1", "t2", F.col("n").cast("long").alias("n"), cov.alias("cov"))


def matrix(rows: pd.DataFrame, value: str, names: list[str]) -> np.ndarray:
    at = {t: i for i, t in enumerate(names)}
    out = np.zeros((len(names), len(names)))
    for a, b, v in zip(rows["t1"], rows["t2"], rows[value], strict=True):
        out[at[a], at[b]] = out[at[b], at[a]] = v
    return out


def spectra(values: DataFrame, by: tuple[str, ...] = ("year",), key: str = "user_id", on: str = "cov", ridge: float = 0.0) -> DataFrame:
    """PR, eRank and stable rank of each group's covariance or (``on="corr"``) correlation matrix."""
    cov = available_covariance(values, by, key)
    kinds = dict(values.dtypes)

    def finish(f: pd.DataFrame) -> pd.DataFrame:
        names = sorted(set(f["t1"]) | set(f["t2"]))
        c = matrix(f, "cov", names)
        s = stats.spectrum(stats.to_correlation(c, ridge) if on == "corr" else c + ridge * np.eye(len(c)))
        return pd.DataFrame([{k: f[k].iloc[0] for k in by} | {"k": len(names)} | s])

    # One group is a K x K matrix.
    return cov.groupBy(*by).applyInPandas(finish, ", ".join([*(f"{k} {kinds[k]}" for k in by), "k int", SPECTRUM]))


def loading_report(values: DataFrame, by: tuple[str, ...] = ("year",), key: str = "user_id") -> DataFrame:
    """Components of each group's covariance: eigenvalue, shares, loadings and top topics."""
    cov = available_covariance(values, by, key)
    kinds = dict(values.dtypes)

    def finish(f: pd.DataFrame) -> pd.DataFrame:
        names = sorted(set(f["t1"]) | set(f["t2"]))
        rows = stats.loadings(matrix(f, "cov", names), names)
        return pd.DataFrame([{k: f[k].iloc[0] for k in by} | r for r in rows])

    schema = ", ".join([*(f"{k} {kinds[k]}" for k in by), "component int", "eigenvalue double", "share double", "cumulative double", "loadings map<string,double>", "top array<string>"])
    return cov.groupBy(*by).applyInPandas(finish, schema)


def gram_participation_ratio(values: DataFrame, key: str = "word") -> DataFrame:
    """(trace G)**2 / |G|**2 of the covariance, without eigenvalues: exact while it is positive semidefinite."""
    cov = available_covariance(values, (), key)
    twice = F.when(F.col("t1") == F.col("t2"), 1.0).otherwise(2.0)
    return cov.agg(F.sum(F.when(F.col("t1") == F.col("t2"), F.col("cov"))).alias("tr"), F.sum(twice * F.col("cov") * F.col("cov")).alias("sq")).select(F.try_divide(F.col("tr") * F.col("tr"), F.col("sq")).alias("pr"))


#: Cumulative probabilities of a Poisson count of mean 1.
POISSON1 = np.cumsum([0.36787944117144233 / math.factorial(k) for k in range(12)])
#: Draws whose weights are made at once for a batch of users.
DRAWS = 256


def replicate_weights(keys: np.ndarray, draws: np.ndarray) -> np.ndarray:
    """(draw, key) Poisson(1) counts from hashes of both; draw 0 is the sample itself, every count 1."""
    x = keys.astype(np.uint64)[None] + (draws.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))[:, None]
    for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
        x = (x ^ (x >> np.uint64(shift))) * np.uint64(factor)
    u = ((x ^ (x >> np.uint64(31))) >> np.uint64(11)) * 2.0**-53
    return np.where(draws[:, None] == 0, 1.0, np.searchsorted(POISSON1, u, "right").astype(np.float64))


def bootstrap_sums(values: DataFrame, names: list[str], draws: int, seed: int, by: tuple[str, ...], key: str) -> DataFrame:
    """(by, draw, t1, t2, n, sxy, sx): the cross sums of every draw.

    A user's topics meet by one shuffle; each task then multiplies draw weights with the users' products, so what leaves it
    is one row for each draw and pair of topics, however many users it has."""
    own = values.where(F.col("value").isNotNull()).groupBy(*by, key).agg(F.collect_list(F.struct("topic", F.col("value").cast("double").alias("value"))).alias("v"))
    rows = own.select(*by, F.xxhash64(F.lit(seed), *by, key).alias("h"), F.col("v.topic").alias("topics"), F.col("v.value").alias("x"))
    schema = T.StructType([*[values.schema[c] for c in by], T.StructField("draw", T.IntegerType()), T.StructField("t1", T.StringType()), T.StructField("t2", T.StringType()), *[T.StructField(c, T.DoubleType()) for c in ("n", "sxy", "sx")]])
    at, k = {t: i for i, t in enumerate(names)}, len(names)
    first, second = np.triu_indices(k)
    same = first == second

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        sums: dict[tuple, np.ndarray] = {}
        for f in frames:
            v, seen = np.zeros((len(f), k)), np.zeros((len(f), k))
            for i, (topics, x) in enumerate(zip(f["topics"], f["x"], strict=True)):
                place = [at[t] for t in topics]
                v[i, place], seen[i, place] = x, 1.0
            products = np.concatenate([seen[:, first] * seen[:, second], v[:, first] * v[:, second], v[:, first[same]]], 1)
            hashes = f["h"].to_numpy()
            groups = f.groupby(list(by), sort=False).indices if by else {(): np.arange(len(f))}
            for g, rows_ in groups.items():
                g = g if isinstance(g, tuple) else (g,)
                total = sums.setdefault(g, np.zeros((draws + 1, products.shape[1])))
                for lo in range(0, draws + 1, DRAWS):
                    d = np.arange(lo, min(lo + DRAWS, draws + 1))
                    total[d] += replicate_weights(hashes[rows_], d) @ products[rows_]
        m = len(first)
        for g, total in sums.items():
            sx = np.full((draws + 1, m), np.nan)
            sx[:, same] = total[:, 2 * m :]
            out = {c: np.repeat(np.array([x]), (draws + 1) * m) for c, x in zip(by, g, strict=True)}
            out |= {"draw": np.repeat(np.arange(draws + 1, dtype=np.int32), m), "t1": np.tile(np.array(names, object)[first], draws + 1), "t2": np.tile(np.array(names, object)[second], draws + 1), "n": total[:, :m].ravel(), "sxy": total[:, m : 2 * m].ravel(), "sx": sx.ravel()}
            yield pd.DataFrame(out)

    parts = rows.mapInPandas(run, schema)
    return parts.groupBy(*by, "draw", "t1", "t2").agg(F.sum("n").alias("n"), F.sum("sxy").alias("sxy"), F.sum(F.nanvl("sx", F.lit(0.0))).alias("sx"))


def topic_names(rows: DataFrame) -> list[str]:
    """All topics in order; more than ``MAX_TOPICS`` raise ValueError, as they make too large a matrix."""
    names = sorted(r.topic for r in rows.select("topic").where("topic is not null").distinct().limit(MAX_TOPICS + 1).collect())
    if len(names) > MAX_TOPICS:
        raise ValueError(f"more than {MAX_TOPICS} topics make too large a matrix")
    return names


def draw_spectra(values: DataFrame, draws: int = 2000, seed: int = 0, by: tuple[str, ...] = ("year",), key: str = "user_id") -> DataFrame:
    """(by..., draw, k, pr, erank, srank) of the sample (draw 0) and of each draw of a row bootstrap: every user gets a Poisson(1)
    weight in each draw, hashed from seed, period, draw and user, so no rows are gathered or resampled; k topics have a value."""
    names = topic_names(values)
    at, k = {t: i for i, t in enumerate(names)}, len(names)
    schema = T.StructType([*[values.schema[c] for c in by], T.StructField("draw", T.IntegerType()), T.StructField("k", T.IntegerType()), *[T.StructField(c, T.DoubleType()) for c in ("pr", "erank", "srank")]])

    def finish(f: pd.DataFrame) -> pd.DataFrame:
        """All draws of a period: (draws + 1) K x K matrices."""
        a, b, d = f["t1"].map(at).to_numpy(), f["t2"].map(at).to_numpy(), f["draw"].to_numpy()
        n, s, mean = np.zeros((draws + 1, k, k)), np.zeros((draws + 1, k, k)), np.zeros((draws + 1, k))
        n[d, a, b] = n[d, b, a] = f["n"]
        s[d, a, b] = s[d, b, a] = f["sxy"]
        own = a == b
        mean[d[own], a[own]] = f["sx"].to_numpy()[own] / np.maximum(f["n"].to_numpy()[own], 1)
        used = (n > 0).any(0).any(0)  # topics of this period
        cov = np.where(n > 1, (s - n * mean[:, :, None] * mean[:, None]) / np.maximum(n - 1, 1), 0.0)[:, used][:, :, used]
        out = [stats.rank_numbers(e) for e in np.linalg.eigvalsh(cov)]
        return pd.DataFrame([{c: f[c].iloc[0] for c in by} | {"draw": i, "k": int(used.sum())} | o for i, o in enumerate(out)])

    sums = bootstrap_sums(values, names, draws, seed, by, key)
    return (sums.groupBy(*by) if by else sums.withColumn("_g", F.lit(0)).groupBy("_g")).applyInPandas(finish, schema)


def draw_limits(draws: DataFrame, by: tuple[str, ...], alpha: float) -> DataFrame:
    """Draw 0 of the three numbers, and quantiles and deviation of the others."""
    point = F.col("draw") == 0
    out = []
    for m in ("pr", "erank", "srank"):
        reps = F.when(~point, F.col(m))
        out += [F.max(F.when(point, F.col(m))).alias(m), F.percentile(reps, F.lit(alpha / 2)).alias(f"{m}_lo"), F.percentile(reps, F.lit(1 - alpha / 2)).alias(f"{m}_hi"), F.stddev_samp(reps).alias(f"{m}_se")]
    return draws.groupBy(*by).agg(*out)


def bootstrap_spectra(values: DataFrame, draws: int = 2000, seed: int = 0, by: tuple[str, ...] = ("year",), key: str = "user_id", alpha: float = 0.05) -> DataFrame:
    """One row: the numbers of ``draw_spectra`` averaged over ``by``, with limits."""
    mean = draw_spectra(values, draws, seed, by, key).groupBy("draw").agg(*[F.avg(m).alias(m) for m in ("pr", "erank", "srank")])
    return draw_limits(mean, (), alpha)


def spectral_table(values: DataFrame, draws: int = 2000, seed: int = 0, by: tuple[str, ...] = ("society", "medium"), over: tuple[str, ...] = (), key: str = "user_id", alpha: float = 0.05) -> DataFrame:
    """(by..., k, pr, pr_lo, pr_hi, pr_se, ..., pr_per_topic, ...): numbers of each group with limits, averaged over the periods
    ``over`` in each draw, and the numbers as shares of the topics of the group (their mean over the periods).  Rows without a group
    or period are left out."""
    each = draw_spectra(values, draws, seed, (*by, *over), key).groupBy(*by, "draw").agg(F.avg("k").alias("k"), *[F.avg(m).alias(m) for m in ("pr", "erank", "srank")])
    found = draw_limits(each, by, alpha).join(each.where("draw = 0").select(*by, "k"), list(by))
    return found.select(*by, "k", *[c for c in found.columns if c not in (*by, "k")], *[(F.col(m) / F.col("k")).alias(f"{m}_per_topic") for m in ("pr", "erank")])


def listwise_covariance(wide: DataFrame, columns: list[str]) -> DataFrame:
    """(t1 <= t2, cov) over rows without a missing value, in one aggregate."""
    ok = wide.dropna("any", subset=columns)
    pairs = [(a, b) for i, a in enumerate(columns) for b in columns[i:]]
    row = ok.agg(*[F.covar_samp(F.col(a), F.col(b)).alias(str(k)) for k, (a, b) in enumerate(pairs)])
    return row.select(F.explode(F.array(*[F.struct(F.lit(a).alias("t1"), F.lit(b).alias("t2"), F.col(str(k)).alias("cov")) for k, (a, b) in enumerate(pairs)])).alias("x")).select("x.*")
