"""Driver tables in the roles of the domain: opinions, regions, rater labels, keyword vectors."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from opinara.functions.scalar import clip

ORDER_TOPICS = ("1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def opinions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """post_id, user_id, topic, year, opinion in [-2, 2]."""
    o = table(spark, sf_dir, "orders")
    return o.select(
        F.col("o_orderkey").alias("post_id"),
        F.col("o_custkey").alias("user_id"),
        F.col("o_orderpriority").alias("topic"),
        F.year("o_orderdate").alias("year"),
        clip(F.col("o_totalprice") / 90007.0 - 2.0).alias("opinion"),
    )


def event_opinions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """post_id, user_id, topic, day, opinion from the event stream."""
    return table(spark, sf_dir, "events").select(F.col("event_id").alias("post_id"), "user_id", F.col("event_type").alias("topic"), F.to_date("ts").alias("day"), F.col("value").alias("opinion"))


def region_users(spark: SparkSession, sf_dir: str, region: str) -> DataFrame:
    """Allow-list: distinct users of a region."""
    c, n, r = (table(spark, sf_dir, t) for t in ("customer", "nation", "region"))
    return c.join(n, F.col("c_nationkey") == F.col("n_nationkey")).join(r.where(F.col("r_name") == region), F.col("n_regionkey") == F.col("r_regionkey")).select(F.col("c_custkey").alias("user_id")).distinct()


def rater_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """post_id and three raters' labels; the third from the length of the text."""
    d = table(spark, sf_dir, "documents").select("doc_id", "n_chars")
    third = F.when(F.col("n_chars") % 7 == 0, F.lit(-99)).when(F.col("n_chars") > 1500, F.lit(1)).otherwise(F.lit(0))
    return table(spark, sf_dir, "labels").join(d, "doc_id").select(F.col("doc_id").alias("post_id"), F.col("quality").alias("rater_a"), F.col("toxic").alias("rater_b"), third.alias("rater_c"))


def survey(spark: SparkSession, sf_dir: str) -> DataFrame:
    """respondent_id, country, item (1..10) per customer; every eleventh item is missing."""
    item = F.when(F.col("c_custkey") % 11 != 0, (F.floor((F.col("c_acctbal") + 1000) / 1100) + 1).cast("int"))
    return table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("respondent_id"), F.col("c_nationkey").alias("country"), F.col("c_mktsegment").alias("segment"), item.alias("item"))


def keyword_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """word (vec_id), topic (label), vector and a weight."""
    return table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("word"), F.col("label").alias("topic"), F.col("embedding").alias("vector"), (F.col("vec_id") % 5 + 1).cast("double").alias("weight"))
