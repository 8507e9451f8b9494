"""Incremental panels: new posts fold into stored sums, windows close behind a watermark, files are handled once."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter


def windowed_opinions(events: DataFrame, window: str = "7 days", late: str = "1 day") -> DataFrame:
    """Count and mean of each topic in tumbling windows of event time; rows later than the watermark are dropped by
    the state store, which is what a watermark means."""
    timed = events.withColumn("ts", F.col("ts").cast("timestamp"))
    return timed.withWatermark("ts", late).groupBy(F.window("ts", window), "topic").agg(F.count(F.lit(1)).alias("cnt"), F.avg("opinion").alias("mean")).select(F.col("window.start").alias("start"), F.col("window.end").alias("end"), "topic", "cnt", "mean")


def distinct_posts(posts: DataFrame, late: str = "1 day") -> DataFrame:
    """Posts without repeats of an id within the watermark."""
    return posts.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late).dropDuplicatesWithinWatermark(["post_id"])


def merge_sums(stored: DataFrame, new: DataFrame) -> DataFrame:
    """Stored (user_id, topic, year, cnt, total) plus those of new posts."""
    return stored.unionByName(new).groupBy("user_id", "topic", "year").agg(F.sum("cnt").alias("cnt"), F.sum("total").alias("total"))


def sink_sums(posts: DataFrame, path: str, checkpoint: str) -> DataStreamWriter:
    """Writes each micro-batch's sums as a table of its own number: a batch that is run again replaces itself, so the
    union of all batches counts every post once.  ``read_sums`` folds them."""

    def write(batch: DataFrame, number: int) -> None:
        sums = batch.where("opinion is not null").groupBy("user_id", "topic", "year").agg(F.count(F.lit(1)).alias("cnt"), F.sum("opinion").alias("total"))
        sums.write.mode("overwrite").parquet(f"{path}/batch={number}")

    return posts.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)


def read_sums(spark, path: str) -> DataFrame:
    folded = spark.read.parquet(path).groupBy("user_id", "topic", "year").agg(F.sum("cnt").alias("cnt"), F.sum("total").alias("total"))
    return folded.withColumn("mean", F.col("total") / F.col("cnt"))
