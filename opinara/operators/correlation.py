"""Pairwise-complete correlations between topics, their inference and summaries.

Everything reduces users to one row per pair of topics: a self-join on the user key and one hash aggregate, partial in
the map tasks.  A user has at most K topics in a period, so the join makes at most K * (K - 1) / 2 rows of a user.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from opinara.functions import stats
from opinara.functions.scalar import clip, fisher_interval
from opinara.operators.panel import pooled_average
from opinara.operators.ranks import running_sums
from opinara.session import cut_lineage


def safe_corr(x: Column, y: Column) -> Column:
    """Pearson correlation; null instead of an error for constants and single rows."""
    return F.try_divide(F.covar_pop(x, y), F.stddev_pop(x) * F.stddev_pop(y))


def topic_pairs(values: DataFrame, keys: tuple[str, ...] = ("user_id", "year")) -> DataFrame:
    """Rows (keys, t1 < t2, x, y) of values (keys, topic, value) that both topics have.

    The topics of a key meet in an array, so that one shuffle does and pairs are made where the key's rows are."""
    own = values.where(F.col("value").isNotNull()).groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("topic", "value"))).alias("v"))
    first = own.select(*keys, "v", F.posexplode("v").alias("i", "a"))
    pairs = first.select(*keys, "a", F.explode(F.slice("v", F.col("i") + 2, F.greatest(F.size("v") - F.col("i") - 1, F.lit(0)))).alias("b"))
    return pairs.select(*keys, F.col("a.topic").alias("t1"), F.col("b.topic").alias("t2"), F.col("a.value").alias("x"), F.col("b.value").alias("y"))


def pairwise(pairs: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """n and Pearson r of each pair of topics (and period)."""
    return pairs.groupBy("t1", "t2", *by).agg(F.count(F.lit(1)).alias("n"), safe_corr(F.col("x"), F.col("y")).alias("r"))


def pairwise_with_average(pairs: DataFrame, period: str = "year") -> DataFrame:
    """Each period and, as "average", all periods together, in one pass of grouping sets."""
    sets = pairs.groupingSets([["t1", "t2", period], ["t1", "t2"]], "t1", "t2", period)
    out = sets.agg(F.grouping(period).alias("_all"), F.count(F.lit(1)).alias("n"), safe_corr(F.col("x"), F.col("y")).alias("r"))
    return out.select("t1", "t2", F.when(F.col("_all") == 1, "average").otherwise(F.col(period).cast("string")).alias("period"), "n", "r")


def period_values(panel: DataFrame, period: str = "year") -> DataFrame:
    """(user_id, topic, period, value): each period's means and, as "average", the users' averages over all posts, all
    within [-2, 2]."""
    each = panel.select("user_id", "topic", F.col(period).cast("string").alias("period"), clip(F.col("mean")).alias("value"))
    return each.unionByName(pooled_average(panel).select("user_id", "topic", F.lit("average").alias("period"), clip(F.col("average")).alias("value")))


def social_pairwise(panel: DataFrame, period: str = "year") -> DataFrame:
    """(period, t1 < t2, n, r) for every two topics that a period has, also those that no user shares (n = 0, no r).

    Users' values are compared: for "average" a user's mean over all posts, not each period's."""
    v = period_values(panel, period)
    found = pairwise(topic_pairs(v, ("user_id", "period")), ("period",))
    topics = v.select("period", "topic").distinct()  # K topics a period
    scaffold = topics.withColumnRenamed("topic", "t1").join(topics.select(F.col("period").alias("_p"), F.col("topic").alias("t2")), (F.col("period") == F.col("_p")) & (F.col("t1") < F.col("t2"))).drop("_p")
    return scaffold.join(found, ["period", "t1", "t2"], "left").select("period", "t1", "t2", F.coalesce("n", F.lit(0)).alias("n"), F.when(F.col("n") > 1, F.col("r")).alias("r"))


def with_intervals(table: DataFrame) -> DataFrame:
    lo, hi = fisher_interval(F.col("r"), F.col("n"))
    return table.withColumn("r_lo", lo).withColumn("r_hi", hi)


@F.pandas_udf(T.DoubleType())
def pearson_p(r: pd.Series, n: pd.Series) -> pd.Series:
    """Two-sided p-values, Arrow batches over one row per pair."""
    return pd.Series([stats.pearson_p(a, int(b)) for a, b in zip(r, n, strict=True)])


def with_p_values(table: DataFrame) -> DataFrame:
    return table.withColumn("p_value", pearson_p("r", "n"))


def shuffle_baseline(table: DataFrame) -> DataFrame:
    """Mean and standard deviation of r when one side is permuted: exactly 0 and 1 / sqrt(n - 1), for any values."""
    return table.withColumn("shuffled_mean", F.when(F.col("n") > 1, F.lit(0.0))).withColumn("shuffled_sd", F.when(F.col("n") > 1, 1 / F.sqrt((F.col("n") - 1).cast("double"))))


def overlap_counts(table: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """Least, median and greatest pair size."""
    aggs = (F.min("n").alias("min_n"), F.percentile("n", F.lit(0.5)).alias("median_n"), F.max("n").alias("max_n"))
    return table.groupBy(*by).agg(*aggs) if by else table.agg(*aggs)


def extreme_pairs(table: DataFrame, value: str) -> DataFrame:
    """The pairs of least and greatest value, ties by name."""
    least = table.orderBy(F.col(value), "t1", "t2").limit(1).withColumn("which", F.lit("low"))
    most = table.orderBy(F.desc(value), "t1", "t2").limit(1).withColumn("which", F.lit("high"))
    return least.unionAll(most)


def skewness_corrected(x: Column) -> Column:
    n = F.count(x).cast("double")
    return F.when(F.count(x) > 2, F.skewness(x) * F.sqrt(n * (n - 1)) / (n - 2))


def eta_squared(rows: DataFrame, group: str, value: str) -> DataFrame:
    """Between-group share of the sum of squares, from one aggregate per group."""
    per = rows.where(F.col(value).isNotNull()).groupBy(group).agg(F.count(F.lit(1)).alias("n"), F.sum(value).alias("s"), F.sum(F.col(value) * F.col(value)).alias("q"))
    total = per.agg(F.sum("n").alias("n"), F.sum("s").alias("s"), F.sum("q").alias("q"), F.sum(F.col("s") * F.col("s") / F.col("n")).alias("b"))
    return total.select(F.try_divide(F.col("b") - F.col("s") * F.col("s") / F.col("n"), F.col("q") - F.col("s") * F.col("s") / F.col("n")).alias("eta2"))


def dispersion(rows: DataFrame, group: str, value: str) -> DataFrame:
    """Population sd and range of the group means."""
    per = rows.groupBy(group).agg(F.avg(value).alias("m"))
    return per.agg(F.stddev_pop("m").alias("sd_of_means"), (F.max("m") - F.min("m")).alias("range_of_means"))


def abs_summary(table: DataFrame, value: str = "r", by: tuple[str, ...] = ()) -> DataFrame:
    """Summary of absolute correlations."""
    v = F.abs(F.col(value))
    aggs = (F.count(value).alias("pairs"), F.avg(v).alias("mean_abs"), F.percentile(v, F.lit(0.5)).alias("median_abs"), F.stddev_samp(v).alias("sd_abs"), F.min(v).alias("min_abs"), F.max(v).alias("max_abs"), skewness_corrected(v).alias("skew_abs"))
    return table.groupBy(*by).agg(*aggs) if by else table.agg(*aggs)


def ols(rows: DataFrame, x: str, y: str, weight: str | None = None, by: tuple[str, ...] = ()) -> DataFrame:
    """Slope, intercept and R2 of a (weighted) line, from sums."""
    ok = rows.where(F.col(x).isNotNull() & F.col(y).isNotNull())
    w = F.lit(1.0) if weight is None else F.col(weight)
    a, b = F.col(x), F.col(y)
    sums = ok.groupBy(*by).agg(F.sum(w).alias("w"), F.sum(w * a).alias("a"), F.sum(w * b).alias("b"), F.sum(w * a * a).alias("aa"), F.sum(w * a * b).alias("ab"), F.sum(w * b * b).alias("bb"))
    sxx, sxy, syy = (F.col(p) - F.col(q) * F.col(r) / F.col("w") for p, q, r in (("aa", "a", "a"), ("ab", "a", "b"), ("bb", "b", "b")))
    slope = F.try_divide(sxy, sxx)
    return sums.select(*by, slope.alias("slope"), (F.col("b") / F.col("w") - slope * F.col("a") / F.col("w")).alias("intercept"), F.try_divide(sxy * sxy, sxx * syy).alias("r2"))


def wls(rows: DataFrame, x: str, y: str, weight: str | None = None, by: tuple[str, ...] = ()) -> DataFrame:
    """Weighted line with the slope's standard error, its two-sided p and R2; n counts rows, as the weights are known."""
    ok = rows.where(F.col(x).isNotNull() & F.col(y).isNotNull())
    w = F.lit(1.0) if weight is None else F.col(weight).cast("double")
    a, b = F.col(x).cast("double"), F.col(y).cast("double")
    terms = {"n": F.lit(1), "w": w, "a": w * a, "b": w * b, "aa": w * a * a, "ab": w * a * b, "bb": w * b * b}
    sums = ok.groupBy(*by).agg(*[F.sum(v).alias(k) for k, v in terms.items()])
    sxx, sxy, syy = (F.col(p) - F.col(q) * F.col(r) / F.col("w") for p, q, r in (("aa", "a", "a"), ("ab", "a", "b"), ("bb", "b", "b")))
    line = sums.select(*by, "n", "w", "a", "b", sxx.alias("sxx"), sxy.alias("sxy"), syy.alias("syy")).withColumn("slope", F.try_divide("sxy", "sxx"))
    left = F.col("syy") - F.col("slope") * F.col("sxy")
    out = line.withColumn("se", F.when(F.col("n") > 2, F.sqrt(F.greatest(F.try_divide(left, (F.col("n") - 2) * F.col("sxx")), F.lit(0.0)))))
    out = out.select(*by, "n", ((F.col("b") - F.col("slope") * F.col("a")) / F.col("w")).alias("intercept"), "slope", "se", F.try_divide(F.col("slope") * F.col("sxy"), F.col("syy")).alias("r2"))
    return out.withColumn("p", t_p_value(F.try_divide("slope", "se"), F.col("n") - 2))


@F.pandas_udf(T.DoubleType())
def t_p_value(t: pd.Series, df: pd.Series) -> pd.Series:
    """Two-sided p of a t value, Arrow batches over one row per fit."""
    return pd.Series([None if pd.isna(a) or d <= 0 else stats.t_two_sided(float(a), float(d)) for a, d in zip(t, df, strict=True)], dtype="float64")


def by_strength(table: DataFrame, value: str = "r") -> DataFrame:
    """A pair table from the strongest correlation to the weakest."""
    return table.where(F.col(value).isNotNull()).withColumn("abs_r", F.abs(F.col(value))).orderBy(F.desc("abs_r"), "t1", "t2")


def spearman(rows: DataFrame, x: str, y: str, by: tuple[str, ...]) -> DataFrame:
    """Correlation of average ranks within groups; ranks from counts of values, so that ties need no window of rows.

    The rows are stored first: a mean that is computed again can have another last bit, and would not meet its rank."""
    ok = rows.where(F.col(x).isNotNull() & F.col(y).isNotNull()).select(*by, F.col(x).alias("_x"), F.col(y).alias("_y"))
    ok = cut_lineage(ok, "spearman")

    def ranks(c: str) -> DataFrame:
        n = ok.groupBy(*by, c).agg(F.count(F.lit(1)).alias("_n"))
        return running_sums(n, by, [c], "_n", "_upto").select(*by, c, (F.col("_upto") - (F.col("_n") - 1) / 2).alias(f"{c}_rank"))

    ranked = ok.join(ranks("_x"), [*by, "_x"]).join(ranks("_y"), [*by, "_y"])
    return ranked.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), safe_corr(F.col("_x_rank"), F.col("_y_rank")).alias("rho"))


def histogram_2d(rows: DataFrame, x: str, y: str, width: float = 0.25) -> DataFrame:
    """Counts of standardised points in square bins."""
    m = rows.agg(*[f(c).alias(f"{n}_{c}") for c in (x, y) for n, f in (("m", F.avg), ("s", F.stddev_pop))]).first()
    if m is None or not m[f"s_{x}"] or not m[f"s_{y}"]:
        return rows.sparkSession.createDataFrame([], "i int, j int, c long")
    bin_ = lambda c: F.floor((F.col(c) - m[f"m_{c}"]) / m[f"s_{c}"] / width).cast("int")
    return rows.where(F.col(x).isNotNull() & F.col(y).isNotNull()).groupBy(bin_(x).alias("i"), bin_(y).alias("j")).agg(F.count(F.lit(1)).alias("c"))


def points_from_histogram(bins: DataFrame, width: float = 0.25, seed: int = 0) -> DataFrame:
    """Points spread evenly in their bins, each by a hash of its bin and number: the same however the rows are dealt out."""
    points = bins.withColumn("k", F.explode(F.sequence(F.lit(1), F.col("c").cast("int"))))
    share = lambda axis: F.pmod(F.xxhash64(F.lit(seed), F.lit(axis), "i", "j", "k"), F.lit(1 << 52)) / float(1 << 52)
    return points.select(((F.col("i") + share("x")) * width).alias("x"), ((F.col("j") + share("y")) * width).alias("y"))
