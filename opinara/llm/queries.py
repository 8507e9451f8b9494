"""Queries of this subpackage for the driver: ``queries()`` and, where SQL can express them, ``oracle_sql()``."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from opinara.llm import ball_kmeans, decontam, hard_negatives, langid, maxent_lm, media, mixing, ngram_join, quality, substring_dedup, toxicity, urlfilter, warc


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return toxicity.classify(docs, toxicity.train(docs, table(spark, sf_dir, "labels")))


def op2_mpeg_audio(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media.read_media(media.media_column(table(spark, sf_dir, "documents")))


def op3_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = ngram_join.near_duplicates(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "class_id", "n_links", "copy_of", "n_words", "first")


def op4_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return langid.predict(docs, langid.train(docs))


def op5_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam.decontaminate(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op6_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return quality.classify(docs, quality.train(docs, table(spark, sf_dir, "labels")))


def op7_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup.remove_repeats(table(spark, sf_dir, "documents"))


def op8_url_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A page is labelled bad by the quality label of the document of its id."""
    pages = table(spark, sf_dir, "pages")
    return urlfilter.filter_urls(pages, urlfilter.labelled_urls(pages, table(spark, sf_dir, "labels")))


def op9_maxent_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return maxent_lm.language_scores(table(spark, sf_dir, "documents"))


def op10_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix_sources(table(spark, sf_dir, "documents"))


def op11_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Anchors are the rows whose id is divisible by 100; every seventh label is moved by one."""
    vectors, seventh = table(spark, sf_dir, "embeddings"), F.col("vec_id") % 7 == 0
    label = F.when(seventh, (F.col("label").cast("long") + 1) % 10).otherwise(F.col("label").cast("long"))
    return hard_negatives.hard_negatives(vectors, F.col("vec_id") % 100 == 0, label)


def op12_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.archive_pages(table(spark, sf_dir, "pages"))


def op13_ball_kmeans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ball_kmeans.ball_kmeans(table(spark, sf_dir, "embeddings"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_toxicity": op1_toxicity,
        "op2_mpeg_audio": op2_mpeg_audio,
        "op3_near_duplicates": op3_near_duplicates,
        "op4_language": op4_language,
        "op5_decontamination": op5_decontamination,
        "op6_quality": op6_quality,
        "op7_substring_dedup": op7_substring_dedup,
        "op8_url_rules": op8_url_rules,
        "op9_maxent_lm": op9_maxent_lm,
        "op10_source_mix": op10_source_mix,
        "op11_hard_negatives": op11_hard_negatives,
        "op12_warc": op12_warc,
        "op13_ball_kmeans": op13_ball_kmeans,
    }


def oracle_sql() -> dict[str, str]:
    label = "CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END"
    return {
        "op10_source_mix": mixing.oracle_sql(),
        "op11_hard_negatives": hard_negatives.oracle_sql(label=label),
        "op12_warc": warc.oracle_sql(),
        "op13_ball_kmeans": ball_kmeans.oracle_sql(),
    }
