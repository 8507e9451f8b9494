"""How far results depend on the topics chosen and on the order of explanations: spectra of all topic subsets, ranges over all
combinations of societies' subsets, shares of variance with their bounds, and means with their ranges.

Everything about rows is an aggregate; what tasks hold is a K x K matrix, or sums of a society for all draws."""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from math import comb

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from opinara.operators.adjustment import bounded
from opinara.operators.spectral import DRAWS, replicate_weights
from opinara.operators.subsets import STEP, unrank

#: Numbers of the matrices that one step of a task decomposes.
CELLS = 1 << 21


def rank_columns(values: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Participation ratio, exponential rank and stable rank of each row of eigenvalues, from the positive ones; nan without any."""
    v = np.maximum(values, 0.0)
    total = v.sum(1)
    with np.errstate(invalid="ignore", divide="ignore"):
        p = v / total[:, None]
        return total**2 / (v**2).sum(1), np.exp(-(p * np.log(p + 1e-12)).sum(1)), total / v.max(1)


def subset_spectra(cov: DataFrame, topics: Sequence[str], size: int, by: tuple[str, ...] = ("society", "year"), ridge: float = 0.0) -> DataFrame:
    """(by..., subset, pr, erank, srank) of every subset of ``size`` topics, numbered in lexicographic order.

    The covariance of pairwise available rows of a subset is a part of the whole one, so ``cov`` (by..., t1 <= t2, cov) is all that
    is needed.  Topics without a covariance count as zeros, other topics and null covariances are ignored; subsets without a
    positive eigenvalue have null numbers.  Executors unrank the subsets and decompose them in batches."""
    names = sorted(topics)
    n, total = len(names), comb(len(names), size)
    if not 0 < size <= n:
        raise ValueError(f"subsets of {size} of {n} topics")
    place = F.map_from_arrays(F.array(*[F.lit(t) for t in names]), F.array(*[F.lit(i) for i in range(n)]))
    cells = cov.select(*by, F.try_element_at(place, "t1").alias("i"), F.try_element_at(place, "t2").alias("j"), F.col("cov").cast("double").alias("v")).dropna("any", subset=["i", "j", "v"])
    step = max(1, min(STEP, CELLS // (size * size)))
    # One row for each group, of at most n * (n + 1) / 2 cells, copied for each block of subsets.
    squares = cells.groupBy(*by).agg(F.collect_list("i").alias("i"), F.collect_list("j").alias("j"), F.collect_list("v").alias("v"))
    tasks = squares.withColumn("_block", F.explode(F.sequence(F.lit(0), F.lit((total - 1) // step)).cast("array<long>")))
    if total > step:
        tasks = tasks.repartition(cov.sparkSession.sparkContext.defaultParallelism, *by, "_block")
    k = len(by)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for r in range(b.num_rows):
                i, j, v = (np.asarray(b.column(k + c)[r].as_py()) for c in range(3))
                c = ridge * np.eye(n)
                c[i, j] += v
                c[j[i != j], i[i != j]] += v[i != j]
                first = b.column(k + 3)[r].as_py() * step
                numbers = np.arange(first, min(first + step, total))
                m = unrank(numbers, n, size)
                found = rank_columns(np.linalg.eigvalsh(c[m[:, :, None], m[:, None]]))
                own = [pa.array([b.column(x)[r].as_py()] * len(numbers), b.schema.field(x).type) for x in range(k)]
                yield pa.RecordBatch.from_arrays([*own, pa.array(numbers), *[pa.array(f, mask=~np.isfinite(f)) for f in found]], names=[*by, "subset", "pr", "erank", "srank"])

    kinds = "".join(f"{c} {dict(cov.dtypes)[c]}, " for c in by)
    return tasks.select(*by, "i", "j", "v", "_block").mapInArrow(run, f"{kinds}subset long, pr double, erank double, srank double")


def range_grid(values: DataFrame, societies: Sequence[str], subsets: int) -> DataFrame:
    """(combination, off, on, ratio, opposed): for every combination of the societies' subsets the range over the societies of the
    number offline and of that online, the ratio of the two ranges, and whether the first society's number is higher online while
    all others' are lower.

    ``values`` is (society, subset, off, on) with ``subsets`` subsets of each society, both media on the same topics.  Combination
    c takes subset (c // subsets ** k) % subsets of society k.  A combination that lacks a number has null results."""
    spark, m = values.sparkSession, len(societies)
    # One row: the societies' numbers by subset, which combinations look up by their digits.
    held = values.agg(*[F.map_from_entries(F.collect_list(F.when(F.col("society") == s, F.struct("subset", F.struct("off", "on"))))).alias(f"s{k}") for k, s in enumerate(societies)])
    total = subsets**m
    grid = spark.range(0, total, 1, max(1, min(-(-total // STEP), 4 * spark.sparkContext.defaultParallelism))).withColumnRenamed("id", "combination").join(F.broadcast(held))
    each = [F.try_element_at(F.col(f"s{k}"), F.floor(F.col("combination") / subsets**k) % subsets) for k in range(m)]
    grid = grid.select("combination", F.transform(F.array(*each), lambda v: v["off"]).alias("_off"), F.transform(F.array(*each), lambda v: v["on"]).alias("_on"))
    known = F.forall("_off", lambda v: v.isNotNull()) & F.forall("_on", lambda v: v.isNotNull())
    up = F.transform(F.arrays_zip("_on", "_off"), lambda v: v["_on"] - v["_off"])
    opposed = (up[0] > 0) & F.forall(F.slice(up, 2, m), lambda v: v < 0)
    spread = lambda c: F.when(known, F.array_max(c) - F.array_min(c))
    return grid.select("combination", spread("_off").alias("off"), spread("_on").alias("on"), F.when(known, opposed).alias("opposed")).select("combination", "off", "on", F.try_divide("off", "on").alias("ratio"), "opposed")


def range_summary(grid: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """Combinations, median and extremes of both ranges, median, 5th percentile and least ratio, shares of ratios above 1 and of
    combinations in which societies move in opposite directions."""
    p = lambda c, q: F.percentile(c, F.lit(q))
    return grid.groupBy(*by).agg(
        F.count(F.lit(1)).alias("combinations"), p("off", 0.5).alias("off_median"), F.min("off").alias("off_min"), p("on", 0.5).alias("on_median"), F.max("on").alias("on_max"),
        p("ratio", 0.5).alias("ratio_median"), p("ratio", 0.05).alias("ratio_p5"), F.min("ratio").alias("ratio_min"),
        F.avg((F.col("ratio") > 1).cast("double")).alias("share_above_1"), F.avg(F.col("opposed").cast("double")).alias("share_opposed"),
    )


def draw_sums(rows: DataFrame, by: tuple[str, ...], columns: Sequence[str], draws: int, seed: int, key: Sequence[str]) -> DataFrame:
    """(by..., draw, n, columns...): the number of rows and the sums of columns in the sample (draw 0) and in each draw, in which a
    row counts by a Poisson(1) number hashed from seed, draw, ``by`` and ``key``.

    A task sends one row for each draw and group that it meets."""
    given = rows.select(*by, F.xxhash64(F.lit(seed), *by, *key).alias("_h"), *[F.col(c).cast("double").alias(c) for c in columns])
    kinds = dict(rows.dtypes)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        sums: dict[tuple, np.ndarray] = {}
        for f in frames:
            x = np.column_stack([np.ones(len(f)), f[list(columns)].to_numpy()])
            h = f["_h"].to_numpy()
            for g, at in f.groupby(list(by), sort=False, dropna=False).indices.items():
                total = sums.setdefault(g if isinstance(g, tuple) else (g,), np.zeros((draws + 1, x.shape[1])))
                for lo in range(0, draws + 1, DRAWS):
                    d = np.arange(lo, min(lo + DRAWS, draws + 1))
                    total[d] += replicate_weights(h[at], d) @ x[at]
        for g, total in sums.items():
            out = {c: [v] * (draws + 1) for c, v in zip(by, g, strict=True)} | {"draw": np.arange(draws + 1, dtype=np.int32)}
            yield pd.DataFrame(out | {c: total[:, i] for i, c in enumerate(["n", *columns])})

    schema = "".join(f"{c} {kinds[c]}, " for c in by) + ", ".join(["draw int", "n double", *[f"{c} double" for c in columns]])
    parts = given.mapInPandas(run, schema)
    return parts.groupBy(*by, "draw").agg(*[F.sum(c).alias(c) for c in ["n", *columns]]).where("n > 0")


def limits(rows: DataFrame, by: tuple[str, ...], values: Sequence[str], bounded_: Sequence[str], alpha: float) -> DataFrame:
    """Draw 0 of ``values`` by group, with quantiles of the other draws for ``bounded_``."""
    point = F.col("draw") == 0
    out = [F.max(F.when(point, F.col(c))).alias(c) for c in values]
    for c in bounded_:
        out += [F.percentile(F.when(~point, F.col(c)), F.lit(q)).alias(f"{c}_{end}") for end, q in (("lo", alpha / 2), ("hi", 1 - alpha / 2))]
    return rows.groupBy(*by).agg(*out)


SHARES = ("society", "similarity", "total", "unexplained", "society_first", "society_last", "similarity_first", "similarity_last")


def _shares(sums: DataFrame, by: tuple[str, ...]) -> DataFrame:
    """R2 of societies' means, of one line, and of parallel lines, from each society's sums."""
    within = lambda a, b: F.sum(F.col(f"s{a}") * F.col(f"s{b}") / F.col("n"))
    t = sums.groupBy(*by).agg(*[F.sum(c).alias(c) for c in ("n", "sx", "sy", "sxx", "sxy", "syy")], within("x", "x").alias("bxx"), within("x", "y").alias("bxy"), within("y", "y").alias("byy"))
    c = F.col
    xx, xy, yy = c("sxx") - c("sx") * c("sx") / c("n"), c("sxy") - c("sx") * c("sy") / c("n"), c("syy") - c("sy") * c("sy") / c("n")
    wxx, wxy, wyy = c("sxx") - c("bxx"), c("sxy") - c("bxy"), c("syy") - c("byy")
    ok: Column = yy > 1e-12 * c("syy")
    line = lambda a, b: F.when(a > 1e-12 * c("sxx"), b * b / a).otherwise(0.0)
    t = t.select(*by, "n", F.when(ok, 1 - wyy / yy).alias("a"), F.when(ok, line(xx, xy) / yy).alias("b"), F.when(ok, 1 - (wyy - line(wxx, wxy)) / yy).alias("t"))
    a, b, both = c("a"), c("b"), c("t")
    found = ((a + both - b) / 2, (b + both - a) / 2, both, 1 - both, a, both - b, b, both - a)
    return t.select(*by, c("n").cast("long").alias("pairs"), *[v.alias(name) for v, name in zip(found, SHARES, strict=True)])


def variance_shares(pairs: DataFrame, draws: int = 0, seed: int = 0, alpha: float = 0.05) -> DataFrame:
    """(scale, pairs, ...): how much of the variance of pair values societies and similarity explain, for the values themselves (``r``)
    and their Fisher z (``z``).

    ``society`` and ``similarity`` are Shapley shares of R2, ``*_first`` and ``*_last`` the R2 a factor adds when it enters first and
    last, between which the share is the middle; ``total`` is the R2 of both.  ``pairs`` is (society, t1, t2, x, y); pairs that
    lack society, x or y are left out; values without spread have null shares, similarities without spread explain nothing.  With
    ``draws`` the two shares have limits from draws of pairs within societies."""
    z = F.atanh(F.greatest(F.least(F.col("y"), F.lit(1 - 1e-12)), F.lit(-1 + 1e-12)))
    both = F.array(F.struct(F.lit("r").alias("scale"), F.col("y").alias("v")), F.struct(F.lit("z").alias("scale"), z.alias("v")))
    rows = bounded(pairs).where("society is not null and x is not null and y is not null").select("society", "t1", "t2", F.col("x").cast("double").alias("x"), F.explode(both).alias("s")).select("s.scale", "society", "t1", "t2", "x", F.col("s.v").alias("y"))
    mean = rows.groupBy("scale").agg(F.avg("x").alias("mx"), F.avg("y").alias("my"))  # two rows
    rows = rows.join(F.broadcast(mean), "scale").select("scale", "society", "t1", "t2", (F.col("x") - F.col("mx")).alias("sx"), (F.col("y") - F.col("my")).alias("sy"))
    rows = rows.withColumns({"sxx": F.col("sx") * F.col("sx"), "sxy": F.col("sx") * F.col("sy"), "syy": F.col("sy") * F.col("sy")})
    columns = ("sx", "sy", "sxx", "sxy", "syy")
    if not draws:
        return _shares(rows.groupBy("scale", "society").agg(F.count(F.lit(1)).alias("n"), *[F.sum(c).alias(c) for c in columns]), ("scale",))
    found = _shares(draw_sums(rows, ("scale", "society"), columns, draws, seed, ("t1", "t2")), ("scale", "draw"))
    return limits(found, ("scale",), ("pairs", *SHARES), ("society", "similarity"), alpha)


def level_frame(values: DataFrame, draws: int = 2000, seed: int = 0, alpha: float = 0.05) -> DataFrame:
    """(medium, society, value, value_lo, value_hi, range, range_lo, range_hi): each society's mean y in each medium, and the range of
    the societies' means in the medium, with limits from draws of pairs.

    ``values`` is (medium, society, t1, t2, y); rows without medium, society or y are left out."""
    rows = bounded(values).where("medium is not null and society is not null and y is not null")
    means = draw_sums(rows, ("medium", "society"), ("y",), draws, seed, ("t1", "t2")).select("medium", "society", "draw", (F.col("y") / F.col("n")).alias("value"))
    spread = means.groupBy("medium", "draw").agg((F.max("value") - F.min("value")).alias("range"))
    return limits(means, ("medium", "society"), ("value",), ("value",), alpha).join(limits(spread, ("medium",), ("range",), ("range",), alpha), "medium")


def common_topics(values: DataFrame, societies: Sequence[str], by: tuple[str, ...] = ()) -> DataFrame:
    """``values`` (by..., society, topic, value) of the societies, without the topics that one of them has no value of (in each group
    of ``by``), so that all are compared on identical items."""
    own = values.where(F.col("society").isin(list(societies)) & F.col("value").isNotNull())
    fielded = own.groupBy(*by, "topic").agg(F.count_distinct("society").alias("_n")).where(F.col("_n") == len(set(societies))).drop("_n")
    return own.join(fielded, [*by, "topic"], "left_semi").select(*values.columns)


def level_gaps(pairs: DataFrame, first: str, second: str, by: tuple[str, ...] = ("items",), draws: int = 2000, seed: int = 0, alpha: float = 0.05) -> DataFrame:
    """(by..., pairs_first, pairs_second, mean_first, mean_second, gap, ratio) of two societies' mean y, each of the last four with
    limits from draws of each society's own pairs.

    ``pairs`` is (by..., society, t1, t2, y); rows without y are left out, groups that lack one of the societies have no row."""
    rows = bounded(pairs).where(F.col("society").isin(first, second) & F.col("y").isNotNull())
    sums = draw_sums(rows, (*by, "society"), ("y",), draws, seed, ("t1", "t2"))
    pick = lambda s, v: F.max(F.when(F.col("society") == s, v))
    each = sums.groupBy(*by, "draw").agg(*[pick(s, v).alias(f"{c}_{k}") for k, s in (("first", first), ("second", second)) for c, v in (("pairs", F.col("n")), ("mean", F.col("y") / F.col("n")))])
    a, b = F.col("mean_first"), F.col("mean_second")
    each = each.where(a.isNotNull() & b.isNotNull()).withColumns({"gap": a - b, "ratio": F.try_divide(a, b)})
    measures = ("mean_first", "mean_second", "gap", "ratio")
    found = limits(each, by, ("pairs_first", "pairs_second", *measures), measures, alpha)
    return found.withColumns({c: F.col(c).cast("long") for c in ("pairs_first", "pairs_second")})
