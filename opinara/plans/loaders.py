"""Result tables as later steps read them: one row per pair, canonical keys, one period, the analysed topics only."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from opinara.functions.scalar import pair_key
from opinara.operators.semantic import checked_topics
from opinara.sources.readers import exists

#: Variant of a similarity -> its column.
VARIANTS = {"top5": "similarity_top5", "static": "static_similarity_top5", "selected": "similarity", "curated": "similarity_curated", "question": "similarity_question"}


def pair_table(results: DataFrame, topics: Sequence[str] | None = None, period: str | None = "average") -> DataFrame:
    """(t1, t2, key, period, n, r, abs_r) of results (t1, t2, period, n, r): pairs of the given topics with a correlation,
    of one period or (None) of all."""
    rows = results.where(F.col("r").isNotNull())
    if topics is not None:
        rows = rows.where(F.col("t1").isin(list(topics)) & F.col("t2").isin(list(topics)))
    if period is not None:
        rows = rows.where(F.col("period").cast("string") == period)
    return rows.select("t1", "t2", pair_key(F.col("t1"), F.col("t2")).alias("key"), "period", "n", "r", F.abs("r").alias("abs_r"))


def similarity_table(table: DataFrame, variant: str = "top5", period: str | None = None) -> DataFrame:
    """(t1, t2, key, similarity) by variant; a table by period gives its pooled rows or those of ``period``."""
    if variant not in VARIANTS:
        raise ValueError(f"unknown variant {variant!r}: one of {sorted(VARIANTS)}")
    rows = table
    if "period" in table.columns:
        rows = rows.where(F.col("period").cast("string") == period) if period else rows.where(F.col("period").cast("string").isin("merged", "average"))
    column = VARIANTS[variant] if VARIANTS[variant] in table.columns else "similarity"
    return rows.select("t1", "t2", pair_key(F.col("t1"), F.col("t2")).alias("key"), F.col(column).cast("double").alias("similarity"))


def similarity_points(correlations: DataFrame, similarities: DataFrame) -> DataFrame:
    """(key, x, y): similarity and absolute correlation of each pair that has both, once."""
    s = similarities.where("similarity is not null").groupBy("key").agg(F.min("similarity").alias("x"))
    return correlations.groupBy("key").agg(F.min("abs_r").alias("y")).join(s, "key").select("key", "x", "y")


def signed_lookup(correlations: DataFrame, wanted: DataFrame) -> DataFrame:
    """``wanted`` (a, b) with the signed r of the pair in either order, null if there is none."""
    r = correlations.groupBy(pair_key(F.col("t1"), F.col("t2")).alias("_key")).agg(F.first("r", True).alias("r"))
    return wanted.withColumn("_key", pair_key(F.col("a"), F.col("b"))).join(r, "_key", "left").drop("_key")


def spectral_means(spectra: DataFrame, topics: DataFrame | None = None, source: str = "source", metric: str = "pr") -> DataFrame:
    """(source, mean, least, most) of a spectral metric over a source's periods; with ``topics`` (source, k) divided by k."""
    rows = spectra
    if topics is not None:
        rows = rows.join(F.broadcast(checked_topics(topics)), source).withColumn(metric, F.col(metric) / F.col("k"))
    return rows.groupBy(source).agg(F.avg(metric).alias("mean"), F.min(metric).alias("least"), F.max(metric).alias("most"))


def period_spectrum(spectra: DataFrame, bootstrap: DataFrame, period: str | None) -> DataFrame:
    """A source's spectral rows with the bootstrap limits of that period, else those over all periods if there is one period
    only (``periods`` = 1), else null limits."""
    rows = spectra if period is None else spectra.where(F.col("period").cast("string") == period)
    own = bootstrap.where(F.col("period").cast("string") == (period or "all")).select("source", F.col("lo").alias("_lo"), F.col("hi").alias("_hi"))
    only = bootstrap.where("period = 'all' and periods = 1").select("source", F.col("lo").alias("_lo1"), F.col("hi").alias("_hi1"))
    return rows.join(own, "source", "left").join(only, "source", "left").withColumn("lo", F.coalesce("_lo", "_lo1")).withColumn("hi", F.coalesce("_hi", "_hi1")).drop("_lo", "_hi", "_lo1", "_hi1")


def opinion_pair(values: DataFrame, a: str, b: str, key: str = "user_id") -> DataFrame:
    """(key, x, y): two topics' values of each row, without rows that have neither."""
    wide = values.where(F.col("topic").isin(a, b)).groupBy(key).agg(F.max(F.when(F.col("topic") == a, F.col("value"))).alias("x"), F.max(F.when(F.col("topic") == b, F.col("value"))).alias("y"))
    return wide.where("x is not null or y is not null")


def first_available(*tables: DataFrame) -> DataFrame:
    """The first of several tables of the same meaning that has rows; each has the columns of the first."""
    for t in tables:
        if t.take(1):
            return t.select(*tables[0].columns)
    return tables[0]


def keywords(table: DataFrame, k: int, word: str = "word", weight: str = "weight", topic: str = "topic") -> DataFrame:
    """(topic, word, weight, rank): the k heaviest words of each topic, trimmed, none empty, each once."""
    from pyspark.sql import Window

    rows = table.select(F.col(topic).cast("string").alias("topic"), F.trim(F.col(word).cast("string")).alias("word"), F.col(weight).cast("double").alias("weight")).where("word <> ''")
    once = rows.groupBy("topic", "word").agg(F.max("weight").alias("weight"))
    w = Window.partitionBy("topic").orderBy(F.desc("weight"), "word")
    return once.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def topic_path(spark, patterns: Sequence[str]) -> str | None:
    """The first of several places of a topic's file that exists."""
    return next((p for p in patterns if exists(spark, p)), None)


#: Places of a topic's averages below a root, in the order in which they are tried.
TOPIC_LAYOUTS = ("merged-{topic}.parquet", "us/merged-{topic}.parquet", "eu/merged-{topic}.parquet", "en/merged-{topic}.parquet", "{topic}/avg_opinion.parquet")


def topic_opinions(spark, root: str, topics: Sequence[str], users: DataFrame | None = None, layouts: Sequence[str] = TOPIC_LAYOUTS) -> DataFrame:
    """(topic, user_id, average, periods): users' mean over periods of each topic's file (user_id and a column for each period),
    found in the first layout that exists; with ``users`` of listed ones only.

    Ids that are no numbers and users without a value in any period are left out; repeated rows of a user count as further
    periods.  A topic without a file raises FileNotFoundError that names all places tried."""
    from opinara.operators.panel import keep_users

    out = None
    for topic in topics:
        tried = [f"{root}/{x.format(topic=topic)}" for x in layouts]
        path = topic_path(spark, tried)
        if path is None:
            raise FileNotFoundError(f"no file of topic {topic!r}; tried " + ", ".join(tried))
        table = spark.read.parquet(path)
        periods = [c for c in table.columns if c != "user_id"]
        rows = table.select(F.col("user_id").cast("string").try_cast("long").alias("user_id"), F.explode(F.array(*[F.col(f"`{c}`").cast("double") for c in periods])).alias("v"))
        part = rows.where("user_id is not null and v is not null").groupBy("user_id").agg(F.avg("v").alias("average"), F.count("v").alias("periods"))
        part = part.select(F.lit(topic).alias("topic"), "user_id", "average", "periods")
        out = part if out is None else out.unionAll(part)
    return out if users is None else keep_users(out, users).select("topic", "user_id", "average", "periods")


def concept_bridge(pairs: DataFrame, bridge: DataFrame) -> DataFrame:
    """Pairs of one source in the concepts of a bridge (topic, concept), canonically ordered; topics without a concept and
    pairs within one concept are left out.  The bridge has a row for each topic."""
    m = checked_topics(bridge)
    a = m.select(F.col("topic").alias("t1"), F.col("concept").alias("c1"))
    b = m.select(F.col("topic").alias("t2"), F.col("concept").alias("c2"))
    both = pairs.join(F.broadcast(a), "t1").join(F.broadcast(b), "t2").where("c1 <> c2")
    return both.select(F.least("c1", "c2").alias("a"), F.greatest("c1", "c2").alias("b"), "r")


def tutorial_candidates(offline_a: DataFrame, offline_b: DataFrame, online_a: DataFrame, online_b: DataFrame) -> DataFrame:
    """Concept pairs (a, b, r) that all four sources have, scored by the offline gap of |r| over the online gap, best first;
    ``by_gap`` numbers them by the signed offline gap instead."""
    from pyspark.sql import Window

    out = None
    for name, t in (("off_a", offline_a), ("off_b", offline_b), ("on_a", online_a), ("on_b", online_b)):
        part = t.where(F.col("r").isNotNull()).groupBy("a", "b").agg(F.min("r").alias(name))
        out = part if out is None else out.join(part, ["a", "b"])
    d = lambda x, y: F.abs(F.abs(x) - F.abs(y))
    out = out.withColumn("gap_off", d("off_a", "off_b")).withColumn("gap_on", d("on_a", "on_b"))
    out = out.withColumn("score", F.col("gap_off") / (F.col("gap_on") + 0.05))
    best = Window.orderBy(F.desc("score"), "a", "b")
    gap = Window.orderBy(F.desc(F.abs("off_a") - F.abs("off_b")), "a", "b")
    # One row a pair of concepts: at most a few hundred.
    return out.withColumn("rank", F.row_number().over(best)).withColumn("by_gap", F.row_number().over(gap))


def word_overlap(similarities: DataFrame, words: DataFrame, k: int) -> DataFrame:
    """(which, t1, t2, similarity, word_a, word_b): words of the least and the most similar pair of topics side by side by
    rank, among each topic's k heaviest (topic, word, weight)."""
    from opinara.operators.correlation import extreme_pairs

    ends = extreme_pairs(similarities, "similarity").select("which", "t1", "t2", "similarity")
    top = keywords(words, k).select("topic", "word", "rank")
    a = ends.join(top, F.col("t1").cast("string") == F.col("topic")).select("which", "t1", "t2", "similarity", "rank", F.col("word").alias("word_a"))
    b = ends.join(top, F.col("t2").cast("string") == F.col("topic")).select("which", "rank", F.col("word").alias("word_b"))
    return a.join(b, ["which", "rank"], "full").select("which", "rank", "t1", "t2", "similarity", "word_a", "word_b")


def shared_words(words: DataFrame, a: str, b: str, k: int) -> DataFrame:
    """(word, side): words of either topic's k heaviest, and whether both have them."""
    top = keywords(words, k)
    sides = top.where(F.col("topic").isin(a, b)).groupBy("word").agg(F.count_if(F.col("topic") == a).alias("na"), F.count_if(F.col("topic") == b).alias("nb"))
    return sides.select("word", F.when((F.col("na") > 0) & (F.col("nb") > 0), "both").when(F.col("na") > 0, a).otherwise(b).alias("side"))
