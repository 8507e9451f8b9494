"""User panels: filters, semi and anti joins, per-user and per-topic aggregates, wide matrices."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

MAX_BROADCAST_USERS = 2_000_000


def usable(posts: DataFrame) -> DataFrame:
    """Rows that count as opinions: relevant (where the table says so) and with an opinion."""
    posts = posts.where(F.col("opinion").isNotNull())
    return posts.where("relevance = 1") if "relevance" in posts.columns else posts


def user_panel(opinions: DataFrame, period: str = "year") -> DataFrame:
    """cnt, total and mean of each user, topic and period; one shuffle, pre-aggregated in the map tasks."""
    return usable(opinions).groupBy("user_id", "topic", period).agg(F.count(F.lit(1)).alias("cnt"), F.sum("opinion").alias("total"), F.avg("opinion").alias("mean"))


def pooled_average(panel: DataFrame) -> DataFrame:
    """Post-weighted average of each user and topic over all periods."""
    return panel.groupBy("user_id", "topic").agg((F.sum("total") / F.sum("cnt")).alias("average"), F.sum("cnt").alias("cnt"))


def mean_of_periods(panel: DataFrame) -> DataFrame:
    """Unweighted mean of the period means."""
    return panel.groupBy("user_id", "topic").agg(F.avg("mean").alias("average"))


def weighted_average(rows: DataFrame, keys: Sequence[str], value: str, weight: str) -> DataFrame:
    return rows.groupBy(*keys).agg(F.try_divide(F.sum(F.col(value) * F.col(weight)), F.sum(weight)).alias("average"))


def opinion_lists(opinions: DataFrame, period: str = "year") -> DataFrame:
    """All opinions of a user, topic and period, ascending."""
    return usable(opinions).groupBy("user_id", "topic", period).agg(F.array_sort(F.collect_list("opinion")).alias("opinions"))


def keep_users(rows: DataFrame, users: DataFrame, anti: bool = False) -> DataFrame:
    """Rows of (or, with ``anti``, without) listed users.  The list is broadcast if it is small enough."""
    ids = users.select("user_id").distinct()
    few = ids.limit(MAX_BROADCAST_USERS + 1).count() <= MAX_BROADCAST_USERS
    return rows.join(F.broadcast(ids) if few else ids, "user_id", "left_anti" if anti else "left_semi")


def complete_periods(panel: DataFrame, topics: int, period: str = "year") -> DataFrame:
    """Periods in which every topic has rows."""
    return panel.groupBy(period).agg(F.count_distinct("topic").alias("n_topics")).where(F.col("n_topics") == topics)


def wide_matrix(panel: DataFrame, topics: Sequence[str], keys: Sequence[str] = ("user_id", "year"), value: str = "mean") -> DataFrame:
    """One column per topic; a pivot with given topics, so that Spark needs no pass to find them."""
    return panel.groupBy(*keys).pivot("topic", list(topics)).agg(F.first(value))


def long_matrix(wide: DataFrame, topics: Sequence[str], keys: Sequence[str]) -> DataFrame:
    return wide.unpivot(list(keys), list(topics), "topic", "value").where(F.col("value").isNotNull())


def users_and_posts(opinions: DataFrame, keys: Sequence[str] = ("topic", "year")) -> DataFrame:
    return usable(opinions).groupBy(*keys).agg(F.count_distinct("user_id").alias("users"), F.count(F.lit(1)).alias("posts"))


def coverage(panel: DataFrame, n_topics: int, period: str = "year", topics: Sequence[str] = ()) -> DataFrame:
    """Per period: users, users with two topics or more, mean topics per user, observed share of cells; with ``topics`` also the
    users of each of them, in a column ``users_<topic>``."""
    flag = lambda i: f"_has{i}"
    has = [F.max(F.when(F.col("topic") == t, 1).otherwise(0)).alias(flag(i)) for i, t in enumerate(topics)]
    per = panel.groupBy(period, "user_id").agg(F.count_distinct("topic").alias("k"), *has)
    return per.groupBy(period).agg(
        F.count(F.lit(1)).alias("users"),
        F.count_if(F.col("k") >= 2).alias("users_2plus"),
        F.avg("k").alias("mean_topics"),
        (F.sum("k") / (F.count(F.lit(1)) * n_topics)).alias("observed_share"),
        *[F.sum(flag(i)).alias(f"users_{t}") for i, t in enumerate(topics)],
    )


def describe(rows: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    """Respondents, answers, missing share and moments of a value."""
    return rows.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("respondents"),
        F.count(value).alias("answered"),
        (1 - F.count(value) / F.count(F.lit(1))).alias("missing_share"),
        F.avg(value).alias("mean"),
        F.stddev_samp(value).alias("sd"),
        F.min(value).alias("min"),
        F.max(value).alias("max"),
    )


def top_users(panel: DataFrame, k: int) -> DataFrame:
    """The k users of most posts, ties by id."""
    return panel.groupBy("user_id").agg(F.sum("cnt").alias("posts")).orderBy(F.desc("posts"), "user_id").limit(k)


def keep_first(rows: DataFrame, keys: Sequence[str], order: Sequence[Column | str]) -> DataFrame:
    """The first row of each key."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return rows.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")


def duplicate_keys(rows: DataFrame, keys: Sequence[str]) -> DataFrame:
    return rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).where("n > 1")


def assert_unique(rows: DataFrame, keys: Sequence[str]) -> DataFrame:
    """``rows``; ValueError if a key repeats."""
    bad = duplicate_keys(rows, keys).limit(3).collect()
    if bad:
        raise ValueError(f"repeated keys: {bad}")
    return rows


def shared_posts(a: DataFrame, b: DataFrame) -> DataFrame:
    """Post ids of both tables."""
    return a.select("post_id").intersect(b.select("post_id"))


def without_shared(a: DataFrame, b: DataFrame) -> DataFrame:
    return a.join(b.select("post_id").distinct(), "post_id", "left_anti")


def quality_report(posts: DataFrame) -> DataFrame:
    """Rows without relevance and relevant rows without an opinion, by topic."""
    return posts.groupBy("topic").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("relevance").isNull()).alias("no_relevance"), F.count_if((F.col("relevance") == 1) & F.col("opinion").isNull()).alias("no_opinion"))


def repair_users(rows: DataFrame, corrections: DataFrame) -> DataFrame:
    """Replaces user ids that aren't numbers by those of ``corrections`` (post_id, new_user_id); unresolved rows go."""
    fixed = rows.join(corrections, "post_id", "left")
    good = F.col("user_id").try_cast("long")
    return fixed.withColumn("user_id", F.coalesce(good, F.col("new_user_id").cast("long"))).where("user_id is not null").drop("new_user_id")


def attach_predictions(rows: DataFrame, predictions: DataFrame) -> DataFrame:
    return rows.join(predictions, "post_id", "left")


def compare_results(old: DataFrame, new: DataFrame, keys: Sequence[str], value: str, tolerance: float = 1e-9) -> DataFrame:
    """Keys only in one result, or in both with values that differ."""
    joined = old.select(*keys, F.col(value).alias("old_value")).join(new.select(*keys, F.col(value).alias("new_value")), list(keys), "full")
    state = F.when(F.col("old_value").isNull() & F.col("new_value").isNotNull(), "new_only").when(F.col("new_value").isNull() & F.col("old_value").isNotNull(), "old_only")
    state = state.when(F.abs(F.col("old_value") - F.col("new_value")) > tolerance, "changed").otherwise("same")
    return joined.withColumn("status", state)


def country_rows(rows: DataFrame, column: str, country: str, inside: bool = True) -> DataFrame:
    """Rows of one country, or all others; a missing country is another one."""
    same = F.col(column).eqNullSafe(F.lit(country))
    return rows.where(same if inside else ~same)


def numeric_columns(rows: DataFrame, keep: Sequence[str] = ()) -> DataFrame:
    """The numeric columns, by the schema alone, and those in ``keep``."""
    kinds = ("tinyint", "smallint", "int", "bigint", "float", "double")
    return rows.select(*[c for c, t in rows.dtypes if t in kinds or t.startswith("decimal") or c in keep])


def of_year(rows: DataFrame, year: int | str, column: str = "year") -> DataFrame:
    """Rows of a year or of the pooled "average", whether the column holds numbers or text."""
    return rows.where(F.col(column).cast("string") == str(year))


def without(rows: DataFrame, *columns: str) -> DataFrame:
    """``rows`` without columns that some inputs have."""
    return rows.drop(*columns)


def adults(rows: DataFrame, age: str, country: str, code: int | str, least: int = 18) -> DataFrame:
    return rows.where((F.col(age) >= least) & (F.col(country) == code))


def fielded_everywhere(rows: DataFrame, group: str, topics: Sequence[str]) -> DataFrame:
    """``rows`` without the topics that some group has no value of."""
    per = rows.groupBy(group).agg(*[F.count(t).alias(t) for t in topics])
    least = per.agg(*[F.min(t).alias(t) for t in topics]).first()
    return rows.drop(*[t for t in topics if not least[t]])


def analysed_only(rows: DataFrame, registry: DataFrame) -> DataFrame:
    """Rows of topics that the registry (platform, topic, analysed) marks as analysed, by the platform that they name."""
    known = registry.where("analysed").select("platform", "topic").distinct()
    return rows.join(known, ["platform", "topic"], "left_semi")


def period_lists(opinions: DataFrame, periods: Sequence[int], period: str = "year") -> DataFrame:
    """All opinions of a user and topic over the given periods as one list, ascending."""
    return usable(opinions).where(F.col(period).isin(list(periods))).groupBy("user_id", "topic").agg(F.array_sort(F.collect_list("opinion")).alias("opinions"))


def preferred_average(wide: DataFrame, years: Sequence[str], key: str = "user_id", names: Sequence[str] = ("average", "merged", "all")) -> DataFrame:
    """A user's value within [-2, 2]: the first of the ready-made averages that the table has a column of, else the mean of
    the years; users without any are left out."""
    from opinara.functions.scalar import clip, row_mean

    have = next((n for n in names if n in wide.columns), None)
    value = F.col(have) if have else row_mean([F.col(y) for y in years])
    return wide.select(key, clip(value.cast("double")).alias("value")).where("value is not null")


def source_rollup(rows: DataFrame, by: str, first: Sequence[str], mean: Sequence[str], order: str) -> DataFrame:
    """Per source the first value (in ``order``) of some columns and the mean of others."""
    return rows.groupBy(by).agg(*[F.min_by(c, order).alias(c) for c in first], *[F.avg(c).alias(c) for c in mean])


def topic_users(panel: DataFrame, period: str = "year") -> DataFrame:
    """Users of each topic in each period."""
    return panel.groupBy(period, "topic").agg(F.count_distinct("user_id").alias("users"))


def users_over_periods(panel: DataFrame, period: str = "year") -> DataFrame:
    """Users summed over periods (those of several periods count in each), and distinct users."""
    per = panel.select(period, "user_id").distinct()
    return per.agg(F.count(F.lit(1)).alias("sum_over_periods"), F.count_distinct("user_id").alias("unique_users"))


def hash_subset(rows: DataFrame, size: int, key: str, seed: int = 0) -> DataFrame:
    """``size`` rows chosen by a hash of their key, the same on every run.

    A threshold leaves a few more than ``size`` before the exact choice, so that no task gathers the table."""
    n = rows.count()
    digest = F.conv(F.substring(F.md5(F.concat_ws(":", F.lit(str(seed)), F.col(key).cast("string"))), 1, 12), 16, 10).cast("long")
    share = min(1.0, (size + 6 * size**0.5 + 10) / max(n, 1))
    near = rows.withColumn("_h", digest)
    near = near if share >= 1 else near.where(F.col("_h") < int(share * (1 << 48)))
    return near.orderBy("_h", key).limit(size).drop("_h")


def shuffled(rows: DataFrame, key: str, seed: int = 0) -> DataFrame:
    """All rows in the order of a hash of their key, with their place in ``shuffle_key``."""
    digest = F.conv(F.substring(F.md5(F.concat_ws(":", F.lit(str(seed)), F.col(key).cast("string"))), 1, 12), 16, 10).cast("long")
    return rows.withColumn("shuffle_key", digest).orderBy("shuffle_key", key)
